"""The feature catalog, the study design and the data set that joins them to a table."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.operators.layout import quoted
from loomstat.operators.selectors import name_parts, split_name

IDENTITY = ("feature", "config", "feature_key", "feature_name", "family", "family_group")


class FeatureCatalog:
    """One row per feature, under ``feature`` or ``config`` + ``feature_key``; other columns are kept."""

    def __init__(self, frame: DataFrame):
        self.frame = self.normalized(frame)
        repeated = [r[0] for r in self.frame.groupBy("feature").count().where("count > 1").limit(5).collect()]
        if repeated:
            raise ValueError(f"the catalog repeats {repeated}")

    @staticmethod
    def normalized(frame: DataFrame) -> DataFrame:
        """With the columns feature, config and feature_key; config and key win over an old-style name."""
        has = set(frame.columns)
        if "feature" not in has and not {"config", "feature_key"} <= has:
            raise ValueError("a catalog needs feature, or config and feature_key")
        old = F.col("feature") if "feature" in has else F.lit(None).cast("string")
        config, key = (F.col(c) if c in has else F.lit(None).cast("string") for c in ("config", "feature_key"))
        made = F.when(config.isNotNull() & key.isNotNull(), F.concat_ws("__", config, key))
        parts = name_parts(old)
        rest = [F.col(quoted(c)) for c in frame.columns if c not in ("feature", "config", "feature_key")]
        return frame.select(F.coalesce(made, old, key).alias("feature"), F.coalesce(config, parts[0]).alias("config"), F.coalesce(key, parts[1], old).alias("feature_key"), *rest)

    @classmethod
    def load(cls, source: FeatureCatalog | DataFrame | str | None, spark=None) -> FeatureCatalog | None:
        if source is None or isinstance(source, FeatureCatalog):
            return source
        if isinstance(source, DataFrame):
            return cls(source)
        from loomstat.sources.tables import read_csv

        return cls(read_csv(spark, source))

    def _levels(self, column: str) -> list[str]:
        if column not in self.frame.columns:
            return []
        return [r[0] for r in self.frame.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]

    def families(self) -> list[str]:
        return self._levels("family")

    def family_groups(self) -> list[str]:
        return self._levels("family_group")

    def feature_names(self) -> list[str]:
        return [r[0] for r in self.frame.select("feature").collect()]

    def rows(self) -> list[dict]:
        """The dimension on the driver, for resolving selectors."""
        return [r.asDict() for r in self.frame.collect()]

    def __len__(self) -> int:
        return self.frame.count()

    def __contains__(self, name: str) -> bool:
        return not self.frame.where(F.col("feature") == name).isEmpty()

    def __repr__(self) -> str:
        return f"FeatureCatalog({', '.join(self.frame.columns)})"

    def validate(self, names: list[str], allow_missing: bool = False) -> list[str]:
        """Names that the catalog lacks; an error unless allowed."""
        there = set(self.feature_names())
        missing = [n for n in names if n not in there]
        if missing and not allow_missing:
            raise ValueError(f"not in the catalog: {missing[:5]}")
        return missing

    def annotate(self, table: DataFrame, on: str = "feature", columns: list[str] | None = None, lead: bool = True) -> DataFrame:
        """``table`` with the catalog's columns; identity columns first if ``lead``. Clashing names get ``_catalog``."""
        wanted = columns or [c for c in self.frame.columns if c != "feature"]
        named = {c: f"{c}_catalog" if c in table.columns else c for c in wanted}
        dim = self.frame.select(F.col("feature").alias("__key"), *[F.col(quoted(c)).alias(n) for c, n in named.items()])
        out = table.join(dim, table[on] == dim["__key"], "left").drop("__key")
        if not lead:
            return out
        first = [on] + [n for c, n in named.items() if c in IDENTITY]
        return out.select(*map(quoted, first), *[quoted(c) for c in out.columns if c not in first])


def annotate_results(table: DataFrame, catalog: FeatureCatalog | None) -> DataFrame:
    """Family, family group and configuration of result rows; nothing without a catalog."""
    if catalog is None:
        return table
    return catalog.annotate(table, columns=[c for c in ("family", "family_group", "config") if c in catalog.frame.columns], lead=False)


@dataclass(frozen=True)
class StudyDesign:
    """Which column plays which role."""

    group: str | None = None
    batch: str | None = None
    time: str | None = None
    event: str | None = None
    target: str | None = None
    roles: dict[str, str] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for c in (self.group, self.batch, self.time, self.event, self.target, *self.roles.values()) if c))


class Dataset:
    """A wide table, its feature columns, a catalog and a design."""

    def __init__(self, table: DataFrame, features: list[str] | None = None, catalog: FeatureCatalog | None = None, design: StudyDesign | None = None):
        self.table, self.catalog, self.design = table, catalog, design or StudyDesign()
        lacking = [c for c in self.design.columns() if c not in table.columns]
        if lacking:
            raise ValueError(f"columns of the design are missing: {lacking}")
        self.feature_columns = list(features) if features is not None else self._inferred()
        self.metadata_columns = [c for c in table.columns if c not in set(self.feature_columns)]

    def _inferred(self) -> list[str]:
        roles = set(self.design.columns())
        if self.catalog is not None:
            there = set(self.catalog.feature_names())
            found = [c for c in self.table.columns if c in there and c not in roles]
            if found:
                return found
            warnings.warn("no column is in the catalog; names with __ are taken as features", stacklevel=3)
        return [c for c in self.table.columns if "__" in c and c not in roles]

    @classmethod
    def from_export(cls, table: DataFrame, catalog: FeatureCatalog | None = None, drop_subject_id: bool = True, design: StudyDesign | None = None) -> Dataset:
        """A raw export: subject_id columns that look like features go; features that a catalog lacks become metadata."""
        if drop_subject_id:
            table = table.drop(*[c for c in table.columns if (p := split_name(c)) and p[1] == "subject_id"])
        out = cls(table, None, catalog, design)
        if catalog is not None:
            odd = [c for c in out.metadata_columns if split_name(c)]
            if odd:
                warnings.warn(f"not in the catalog, kept as metadata: {odd[:5]}", stacklevel=2)
        return out

    @property
    def features(self) -> DataFrame:
        return self.table.select(*map(quoted, self.feature_columns))

    @property
    def metadata(self) -> DataFrame:
        return self.table.select(*map(quoted, self.metadata_columns))

    @property
    def n_features(self) -> int:
        return len(self.feature_columns)

    def n_samples(self) -> int:
        return self.table.count()

    def groups(self) -> DataFrame | None:
        if self.design.group is None:
            return None
        if not self.table.where(F.col(quoted(self.design.group)).isNull()).isEmpty():
            raise ValueError("a sample has no group")
        return self.table.select(quoted(self.design.group))

    def y(self) -> DataFrame | None:
        """time and event, or the target, or nothing."""
        d = self.design
        if bool(d.time) != bool(d.event):
            raise ValueError("time and event go together")
        names = [d.time, d.event] if d.time else [d.target] if d.target else []
        return self.table.select(*map(quoted, names)) if names else None

    def __len__(self) -> int:
        return self.n_samples()

    def __repr__(self) -> str:
        return f"Dataset({self.n_features} features, {len(self.metadata_columns)} metadata columns)"


def split_observers(table: DataFrame, prefixes: list[str], ids: list[str]) -> dict[str, DataFrame]:
    """One table per observer prefix, names without it."""
    if len(prefixes) < 2:
        raise ValueError("at least two observers are needed")
    out = {}
    for p in prefixes:
        own = [c for c in table.columns if c.startswith(p)]
        if not own:
            raise ValueError(f"no column starts with {p}")
        out[p] = table.select(*map(quoted, ids), *[F.col(quoted(c)).alias(c[len(p) :]) for c in own])
    return out
