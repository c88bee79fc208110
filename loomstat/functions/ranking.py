"""Ranks and false discovery rates as window expressions; every window is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *by: str) -> Column:
    """Rank of non-null values within ``by``, ties averaged."""
    there = F.col(value).isNotNull()
    group = Window.partitionBy(*by, there)
    rank = F.rank().over(group.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, there, value)) - 1) / 2
    return F.when(there, rank.cast("double"))


def with_fdr(df: DataFrame, p: str = "p_value", to: str = "p_fdr", by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with Benjamini-Hochberg q values per family ``by``; missing p values count for nothing and stay missing.

    Tied p values share one q: the running minimum goes over a RANGE of p. Without ``by`` all tests
    are one family and meet in one task, so ``df`` should hold tests (features, pairs), not samples.
    """
    there = F.col(p).isNotNull() & ~F.isnan(p)
    family = [*map(F.col, by), there]
    m = F.count("*").over(Window.partitionBy(*family))
    rank = F.row_number().over(Window.partitionBy(*family).orderBy(p))
    ranked = df.withColumn("__raw", F.when(there, F.col(p) * m / rank))
    down = Window.partitionBy(*family).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(to, F.when(there, F.least(F.lit(1.0), F.min("__raw").over(down)))).drop("__raw")


def top_by(df: DataFrame, by: tuple[str, ...], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)
