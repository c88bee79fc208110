"""Identifiers, duplicate rows and merges of two tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.scalars import normalized_id
from loomstat.operators.layout import quoted


def normalize_id_column(df: DataFrame, column: str, lower: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table with clean identifiers, and the rows that changed: the column, before, after."""
    clean = normalized_id(quoted(column), lower)
    changes = df.select(clean.alias(column), F.col(quoted(column)).cast("string").alias("before"), clean.alias("after"))
    return df.withColumn(column, clean), changes.where(~F.col("before").eqNullSafe(F.col("after")))


def resolve_duplicates(df: DataFrame, key: list[str], policy: str = "error", order_column: str | None = None, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Rows kept and rows dropped, one kept per key. Null keys are equal. ``row_id`` is the order of rows.

    Policies: error, first, last, most_complete (fewest nulls), min, max (of ``order_column``, nulls last
    either way). Ties go to the first row.
    """
    if policy == "error":
        repeated = df.groupBy(*map(quoted, key)).count().where("count > 1").limit(5).collect()
        if repeated:
            raise ValueError(f"repeated keys, such as {[tuple(r)[:-1] for r in repeated]}")
        return df, df.where(F.lit(False))
    if policy in ("min", "max") and order_column is None:
        raise ValueError(f"policy {policy} needs an order column")
    if policy == "first":
        order = [F.col(row_id)]
    elif policy == "last":
        order = [F.desc(row_id)]
    elif policy == "most_complete":
        nulls = reduce(lambda a, b: a + b, [F.col(quoted(c)).isNull().cast("int") for c in df.columns if c != row_id])
        order = [nulls, F.col(row_id)]
    elif policy in ("min", "max"):
        by = F.col(quoted(order_column))
        order = [by.asc_nulls_last() if policy == "min" else by.desc_nulls_last(), F.col(row_id)]
    else:
        raise ValueError(f"unknown policy {policy}")
    ranked = df.withColumn("__place", F.row_number().over(Window.partitionBy(*map(quoted, key)).orderBy(*order)))
    return ranked.where("__place = 1").drop("__place"), ranked.where("__place > 1").drop("__place")


@dataclass(frozen=True)
class MergeResult:
    merged: DataFrame
    left_only: DataFrame
    right_only: DataFrame
    matched_keys: DataFrame

    @property
    def n_matched(self) -> int:
        """Distinct keys on both sides."""
        return self.matched_keys.count()


CARDINALITY = {"one_to_one": (True, True), "1:1": (True, True), "one_to_many": (True, False), "1:m": (True, False), "many_to_one": (False, True), "m:1": (False, True), "many_to_many": (False, False), "m:m": (False, False)}


def merge_tables(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str = "left", validate: str | None = None, suffixes: tuple[str, str] = ("", "_clinical")) -> MergeResult:
    """An equi-join that matches null keys with each other, and what matched on neither side.

    Keys of one name become one column, keys of two names both stay; other columns of one name get the suffixes.
    """
    if len(left_on) != len(right_on):
        raise ValueError("as many keys on the left as on the right are needed")
    if how not in ("left", "right", "inner", "outer"):
        raise ValueError(f"unknown join {how}")
    if validate is not None:
        if validate not in CARDINALITY:
            raise ValueError(f"unknown cardinality {validate}")
        for side, keys, one in (("left", (left, left_on), CARDINALITY[validate][0]), ("right", (right, right_on), CARDINALITY[validate][1])):
            if one and not keys[0].groupBy(*map(quoted, keys[1])).count().where("count > 1").isEmpty():
                raise ValueError(f"keys of the {side} table are not unique ({validate})")
    shared = {l for l, r in zip(left_on, right_on) if l == r}
    clash = (set(left.columns) & set(right.columns)) - shared
    a = left.toDF(*[f"l{i}" for i in range(len(left.columns))])
    b = right.toDF(*[f"r{i}" for i in range(len(right.columns))])
    at = {c: F.col(f"l{i}") for i, c in enumerate(left.columns)}
    bt = {c: F.col(f"r{i}") for i, c in enumerate(right.columns)}
    on = reduce(Column.__and__, [at[l].eqNullSafe(bt[r]) for l, r in zip(left_on, right_on)])
    out = [F.coalesce(at[c], bt[c]).alias(c) if c in shared else at[c].alias(c + suffixes[0] if c in clash else c) for c in left.columns]
    out += [bt[c].alias(c + suffixes[1] if c in clash else c) for c in right.columns if c not in shared]
    names = [f"k{i}" for i in range(len(left_on))]
    keys_a = a.select(*[at[c].alias(n) for c, n in zip(left_on, names)])
    keys_b = b.select(*[bt[c].alias(n + "b") for c, n in zip(right_on, names)])
    both = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(n + "b")) for n in names])
    return MergeResult(
        a.join(b, on, {"outer": "full_outer"}.get(how, how)).select(*out),
        a.join(b, on, "left_anti").toDF(*left.columns),
        b.join(a, on, "left_anti").toDF(*right.columns),
        keys_a.join(keys_b, both, "left_semi").distinct().toDF(*left_on),
    )


def aligned(features: DataFrame, labels: DataFrame, key: str = "sample_id") -> DataFrame:
    """``features`` with the columns of ``labels``, whose samples must be the same; else an error names some."""
    a, b = features.select(key).distinct(), labels.select(key)
    if not b.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("labels are repeated for a sample")
    missing = [r[0] for r in a.join(b, key, "left_anti").limit(5).collect()]
    extra = [r[0] for r in b.join(a, key, "left_anti").limit(5).collect()]
    if missing or extra:
        raise ValueError(f"samples differ: without a label {missing}, without features {extra}")
    return features.join(labels, key)
