"""Choosing features: names, patterns, catalogs and scores.

Names are column names or values of a small feature dimension, so they are resolved on the driver and
become a projection of the plan; scores may be as many as features and are joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.operators.layout import numeric_columns, quoted


def split_name(name: str, prefixes: tuple[str, ...] = ()) -> tuple[str, str] | None:
    """(config, key) of ``[prefix]config__key``; None if either half is empty."""
    base = next((name[len(p) :] for p in prefixes if p and name.startswith(p)), name)
    config, found, key = base.partition("__")
    return (config, key) if found and config and key else None


def name_parts(c: Column) -> tuple[Column, Column]:
    """The same on a column of names without prefixes."""
    parts = F.split(c, "__", 2)
    ok = (F.size(parts) == 2) & (F.length(parts[0]) > 0) & (F.length(parts[1]) > 0)
    return F.when(ok, parts[0]), F.when(ok, parts[1])


@dataclass(frozen=True)
class Selectors:
    """What to choose: (name or key pattern OR family OR family group) AND configuration."""

    features: tuple[str, ...] = ()
    configs: tuple[str, ...] = ()
    families: tuple[str, ...] = ()
    family_groups: tuple[str, ...] = ()
    allow_missing: bool = False
    prefixes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Selection:
    chosen: list[str]
    unmatched: list[str] = field(default_factory=list)


def resolve(names: list[str], s: Selectors, catalog: list[dict] | None = None, metadata: tuple[str, ...] = ()) -> Selection:
    """The names that the selectors choose, in their order; a selector without any match is an error unless allowed.

    Patterns and configurations are globs with case; families and groups are compared whole, without case.
    """
    if not (s.features or s.configs or s.families or s.family_groups):
        raise ValueError("no selector given")
    if (s.families or s.family_groups) and catalog is None:
        raise ValueError("families need a catalog")
    by_name: dict[str, list[dict]] = {}
    for row in catalog or []:
        by_name.setdefault(row.get("feature") or f"{row.get('config')}__{row.get('feature_key')}", []).append(row)
        if not row.get("config") and row.get("feature_key"):
            by_name.setdefault(("*", row["feature_key"]), []).append(row)
    used: set[tuple[str, str]] = set()
    chosen = []
    for name in names:
        parts = split_name(name, s.prefixes)
        if name in metadata or parts is None and name not in by_name:
            continue
        config, key = parts or ("", name)
        rows = by_name.get(name) or by_name.get(f"{config}__{key}") or by_name.get(("*", key), [])
        hits = {("feature", p) for p in s.features if fnmatchcase(name, p) or fnmatchcase(key, p)}
        for kind, wanted, attribute in (("family", s.families, "family"), ("family_group", s.family_groups, "family_group")):
            own = {str(r[attribute]).lower() for r in rows if r.get(attribute) is not None}
            hits |= {(kind, w) for w in wanted if w.lower() in own}
        among = {("config", p) for p in s.configs if fnmatchcase(config, p)}
        used |= hits | among
        if (hits or not (s.features or s.families or s.family_groups)) and (among or not s.configs):
            chosen.append(name)
    asked = [("feature", x) for x in s.features] + [("config", x) for x in s.configs] + [("family", x) for x in s.families] + [("family_group", x) for x in s.family_groups]
    unmatched = [f"{k}:{x}" for k, x in asked if (k, x) not in used]
    if unmatched and not s.allow_missing:
        raise ValueError(f"selectors without a match: {unmatched}")
    return Selection(chosen, unmatched)


def analysis_features(df: DataFrame, s: Selectors | None = None, catalog: list[dict] | None = None) -> list[str]:
    """Literal names if all are there; else what the selectors choose; without any, all numeric columns."""
    if s is None:
        return numeric_columns(df)
    if s.features and not (s.configs or s.families or s.family_groups) and all(f in df.columns for f in s.features):
        return list(s.features)
    found = resolve(df.columns, Selectors(s.features, s.configs, s.families, s.family_groups, True, s.prefixes), catalog).chosen
    if not found:
        raise ValueError("no feature is chosen")
    return found


@dataclass(frozen=True)
class FeatureSplit:
    """Both tables (the removed one with metadata first) and the names of what was kept, removed and known as metadata."""

    kept: DataFrame
    removed: DataFrame
    kept_columns: tuple[str, ...]
    removed_columns: tuple[str, ...]
    metadata_columns: tuple[str, ...] = ()
    unmatched: tuple[str, ...] = ()
    kept_catalog: DataFrame | None = None
    removed_catalog: DataFrame | None = None


class FeatureRemover:
    """Remove chosen features: ``fit`` resolves the names, ``transform`` is a projection of the others."""

    def __init__(self, selectors: Selectors, catalog: list[dict] | None = None, metadata: tuple[str, ...] | str = "auto"):
        self.selectors, self.catalog, self.metadata = selectors, catalog, metadata

    def fit(self, df: DataFrame) -> FeatureRemover:
        auto = self.metadata == "auto"
        known = {r.get("feature") for r in self.catalog or []}
        meta = tuple(c for c in df.columns if split_name(c, self.selectors.prefixes) is None and c not in known) if auto else tuple(self.metadata)
        found = resolve(df.columns, self.selectors, self.catalog, meta)
        self.columns_, self.metadata_ = list(df.columns), [c for c in df.columns if c in meta]
        self.removed_, self.unmatched_ = found.chosen, found.unmatched
        self.kept_ = [c for c in df.columns if c not in set(found.chosen)]
        return self

    def feature_names_out(self) -> list[str]:
        return self.kept_

    def transform(self, df: DataFrame) -> DataFrame:
        if df.columns != self.columns_:
            raise ValueError("columns are not those of the fit")
        return df.select(*map(quoted, self.kept_))

    def split(self, df: DataFrame, catalog: DataFrame | None = None) -> FeatureSplit:
        kept = self.transform(df)
        removed = list(dict.fromkeys([*self.metadata_, *self.removed_]))
        cats = split_catalog(catalog, self.removed_) if catalog is not None else (None, None)
        return FeatureSplit(kept, df.select(*map(quoted, removed)), tuple(self.kept_), tuple(self.removed_), tuple(self.metadata_), tuple(self.unmatched_), *cats)


def split_table(df: DataFrame, selectors: Selectors, catalog: list[dict] | None = None, metadata: tuple[str, ...] | str = "auto", catalog_df: DataFrame | None = None) -> FeatureSplit:
    return FeatureRemover(selectors, catalog, metadata).fit(df).split(df, catalog_df)


def split_catalog(catalog: DataFrame, removed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Catalog rows of the kept and of the removed features. Rows without a configuration go by their key,
    if no row has the full name."""
    name = F.coalesce(F.concat_ws("__", "config", "feature_key"), F.lit("")) if "feature" not in catalog.columns else F.coalesce(F.col("feature"), F.concat_ws("__", "config", "feature_key"))
    keys = [p[1] for p in map(split_name, removed) if p]
    bare = F.col("config").isNull() if "config" in catalog.columns else F.lit(True)
    key = F.col("feature_key") if "feature_key" in catalog.columns else F.lit(None)
    gone = F.coalesce(name.isin(*removed) | (bare & key.isin(*keys)), F.lit(False)) if removed else F.lit(False)
    return catalog.where(~gone), catalog.where(gone)


class ScoreSelector:
    """Keep features whose score is at least (or at most) a threshold; scores are joined on the feature."""

    def __init__(self, scores: DataFrame, threshold: float, keep: str = "above", feature_column: str = "feature", score_column: str = "score", on_missing: str = "keep"):
        if keep not in ("above", "below") or on_missing not in ("keep", "drop"):
            raise ValueError("keep: above or below; on_missing: keep or drop")
        good = F.col("score") >= threshold if keep == "above" else F.col("score") <= threshold
        there = F.col("score").isNotNull() & ~F.isnan("score")
        self.scores = scores.select(F.col(feature_column).alias("feature"), F.col(score_column).cast("double").alias("score"))
        self.passes = F.when(there, good).otherwise(F.lit(on_missing == "keep"))

    def transform(self, long: DataFrame) -> DataFrame:
        return long.join(self.scores, "feature", "left").where(self.passes).drop("score")

    def keep_list(self, features: list[str], spark_df: DataFrame) -> list[str]:
        """For wide tables: the kept of ``features``, in their order."""
        rows = spark_df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
        kept = {r.feature for r in self.transform(rows).collect()}
        return [f for f in features if f in kept]
