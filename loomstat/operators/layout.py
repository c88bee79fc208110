"""Between wide tables, long tables (sample_id, feature, value) and arrays."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from loomstat.functions.scalars import known


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder that ``spark.checkpoint.dir`` names; only a session without that setting gets a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="loomstat-checkpoint-"))
    return df.checkpoint(eager=True)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def wide_to_long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """One row per sample and feature, NaN as NULL; an unpivot in one pass over the table."""
    wide = df.select(*map(quoted, ids), *[known(quoted(c)).alias(c) for c in features])
    return wide.unpivot([F.col(quoted(c)) for c in ids], [F.col(quoted(c)) for c in features], "feature", "value")


def long_to_wide(long: DataFrame, ids: list[str], features: list[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """One row per sample; ``features`` names the columns, so no pass is needed to find them."""
    return long.groupBy(*ids).pivot(feature, features).agg(F.first(value, ignorenulls=True))


def array_to_long(df: DataFrame, ids: list[str], array: str, prefix: str = "f", width: int = 2) -> DataFrame:
    """Elements of an array column as features ``prefix`` + position."""
    exploded = df.select(*map(quoted, ids), F.posexplode(array).alias("dim", "x"))
    name = F.concat(F.lit(prefix), F.lpad(F.col("dim").cast("string"), width, "0"))
    return exploded.select(*map(quoted, ids), "dim", name.alias("feature"), known("x").alias("value"))


def long_to_array(long: DataFrame, ids: list[str], order: str = "feature", value: str = "value") -> DataFrame:
    """One array per sample, elements in the order of the feature names."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(value).alias("v"))))
    return long.groupBy(*ids).agg(F.transform(pairs, lambda x: x["v"]).alias("features"))


def constant_features(long: DataFrame, threshold: float = 1e-12) -> DataFrame:
    """Features whose population standard deviation is at most ``threshold``; one without any value is not constant."""
    spread = long.groupBy("feature").agg(F.stddev_pop(known("value")).alias("sd"))
    return spread.where(F.col("sd") <= threshold).select("feature", "sd")


def validated(long: DataFrame, min_samples: int = 1, min_features: int = 1, allow_missing: bool = False) -> DataFrame:
    """``long`` itself, after a check of its size and, unless ``allow_missing``, of missing values."""
    got = long.agg(F.countDistinct("sample_id").alias("n"), F.countDistinct("feature").alias("p"), F.count_if(known("value").isNull()).alias("gaps")).first()
    if got.n < min_samples:
        raise ValueError(f"{got.n} samples; at least {min_samples} are needed")
    if got.p < min_features:
        raise ValueError(f"{got.p} features; at least {min_features} are needed")
    if got.gaps and not allow_missing:
        raise ValueError(f"{got.gaps} values are missing")
    return long


def check_names(given: list[str], fitted: list[str]) -> None:
    """A transform accepts the very features of the fit, in their order."""
    missing, extra = [c for c in fitted if c not in given], [c for c in given if c not in fitted]
    if missing:
        raise ValueError(f"features missing: {missing[:5]}")
    if extra:
        raise ValueError(f"features not seen in the fit: {extra[:5]}")
    if given != fitted:
        raise ValueError("features are in another order than in the fit")
