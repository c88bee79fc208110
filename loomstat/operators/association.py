"""Features, components and modules against clinical variables and groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.ranking import top_by, with_fdr
from loomstat.functions.scalars import clinical_code, known, stripped, to_number
from loomstat.operators.agreement import correlated, correlation_p
from loomstat.operators.layout import quoted


def encode_clinical(long: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    """(sample_id, variable, code): each variable's strings as numbers, by one rule for the whole variable.

    Numbers if half of its values are; else, if any is a known word, the words' codes and NULL for the rest;
    else ranks of the distinct trimmed lower-case values, from 1.
    """
    rows = long.select("sample_id", F.col(variable).alias("variable"), F.col(value).cast("string").alias("value")).where("value is not null")
    rows = rows.withColumn("number", to_number("value")).withColumn("code", clinical_code("value")).withColumn("word", F.lower(stripped("value")))
    rule = rows.groupBy("variable").agg((F.count("number") * 2 >= F.count("*")).alias("numeric"), (F.count("code") > 0).alias("coded"))
    levels = rows.select("variable", "word").distinct()
    levels = levels.withColumn("level", F.row_number().over(Window.partitionBy("variable").orderBy("word")).cast("double"))
    out = rows.join(rule, "variable").join(levels, ["variable", "word"])
    code = F.when(F.col("numeric"), F.col("number")).when(F.col("coded"), F.col("code")).otherwise(F.col("level"))
    return out.select("sample_id", "variable", code.alias("value"))


def clinical_correlations(features: DataFrame, clinical: DataFrame, method: str = "spearman", min_pairs: int = 10) -> DataFrame:
    """(feature, variable, n, r) over pairwise complete samples; ``clinical`` is long: sample_id, variable, value.

    Variables with a single value are left out, as are pairs of fewer samples. A join on the sample:
    features x variables rows per sample, then aggregation."""
    usable = clinical.groupBy("variable").agg(F.count(known("value")).alias("m"), F.countDistinct(known("value")).alias("u")).where((F.col("m") >= min_pairs) & (F.col("u") > 1))
    traits = clinical.join(usable, "variable", "left_semi").select("sample_id", "variable", F.col("value").alias("trait"))
    pairs = features.select("sample_id", "feature", "value").join(traits, "sample_id")
    return correlated(pairs, ("feature", "variable"), "value", "trait", method).where(F.col("n") >= min_pairs)


def module_traits(eigengenes: DataFrame, traits: DataFrame, method: str = "spearman", min_pairs: int = 10) -> DataFrame:
    """(module, variable, n, r, p_value, p_fdr): one family of tests over the whole table."""
    found = clinical_correlations(eigengenes.withColumnRenamed("module", "feature"), traits, method, min_pairs)
    return with_fdr(correlation_p(found.where("r is not null"))).withColumnRenamed("feature", "module")


def module_membership(features: DataFrame, components: DataFrame, method: str = "spearman") -> DataFrame:
    """(feature, component, k_me): correlation of every feature with every component.

    A feature or component with a missing value has none with that other side."""
    pairs = features.select("sample_id", "feature", known("value").alias("value")).join(components.select("sample_id", "component", known("score").alias("score")), "sample_id")
    gaps = pairs.groupBy("feature", "component").agg(F.count_if(F.col("value").isNull() | F.col("score").isNull()).alias("gaps"))
    found = correlated(pairs, ("feature", "component"), "value", "score", method)
    return gaps.join(found, ["feature", "component"], "left").select("feature", "component", F.when(F.col("gaps") == 0, F.col("r")).alias("k_me"))


def hub_features(membership: DataFrame, clusters: DataFrame, top_n: int = 1) -> DataFrame:
    """(cluster, feature, k_me, rank): the most central features of each cluster by |k_ME| with its own component,
    named like the cluster. Ties go to the name; the sign is kept."""
    own = clusters.where(F.col("cluster").isNotNull()).select("feature", F.col("cluster").cast("string").alias("cluster"))
    rows = membership.join(own, "feature").where(F.col("component").cast("string") == F.col("cluster"))
    best = top_by(rows, ("cluster",), [F.abs("k_me").desc_nulls_last(), F.col("feature")], top_n)
    return best.select("cluster", "feature", "k_me", "rank")


def log_factorials(spark, n: int) -> DataFrame:
    """(i, lf) for 0 <= i <= n: a table that grows with the number of features, not of samples."""
    from loomstat.functions.tails import _lgamma

    return spark.createDataFrame(list(enumerate(_lgamma([i + 1.0 for i in range(n + 1)]).tolist())), "i long, lf double")


def group_enrichment(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """Over-representation of each group in each cluster, by Fisher's exact test (greater), with q values over all pairs.

    ``clusters``: feature, cluster; ``groups``: feature, group. Pairs without overlap are in the result."""
    both = clusters.select("feature", F.col("cluster").cast("string").alias("cluster")).join(groups.select("feature", F.col("group").cast("string").alias("group")), "feature")
    per_cluster = both.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    per_group = both.where("group is not null").groupBy("group").agg(F.count("*").alias("group_size"))
    overlap = both.groupBy("cluster", "group").agg(F.count("*").alias("n_overlap"))
    total = both.agg(F.count("*").alias("total_features"))
    # Levels by levels, both small dimensions: the result itself has a row for each pair.
    table = per_cluster.crossJoin(per_group).crossJoin(total).join(overlap, ["cluster", "group"], "left")
    table = table.withColumn("n_overlap", F.coalesce("n_overlap", F.lit(0).cast("long")))
    a, n, k, m = F.col("n_overlap"), F.col("total_features"), F.col("cluster_size"), F.col("group_size")
    table = table.withColumn("p_value", fisher_greater(a, k, m, n))
    odds = F.try_divide(a * (n - k - m + a), ((k - a) * (m - a)).cast("double"))
    above = a * (n - k - m + a) > 0
    table = table.withColumn("odds_ratio", F.coalesce(odds, F.when(above, F.lit(float("inf")))))
    done = with_fdr(table, "p_value", "fdr_q_value")
    return done.select("cluster", "group", "n_overlap", "cluster_size", "group_size", "total_features", "p_value", "odds_ratio", "fdr_q_value")


def fisher_greater(a: Column, k: Column, m: Column, n: Column) -> Column:
    """P(overlap >= a) of the hypergeometric distribution, summed in an Arrow UDF over result rows."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, k: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        lf = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, int(n.max()) + 1))))) if len(n) else np.zeros(1)
        choose = lambda x, y: lf[x] - lf[y] - lf[x - y]
        out = []
        for ai, ki, mi, ni in zip(a, k, m, n):
            i = np.arange(max(ai, ki + mi - ni, 0), min(ki, mi) + 1)
            out.append(min(1.0, math.fsum(np.exp(choose(mi, i) + choose(ni - mi, ki - i) - choose(ni, ki)))))
        return pd.Series(out)

    return tail(a, k, m, n)


def traits_long(table: DataFrame, sample: str, columns: list[str]) -> DataFrame:
    """Clinical columns as (sample_id, variable, value string)."""
    wide = table.select(F.col(quoted(sample)).alias("sample_id"), *[F.col(quoted(c)).cast("string").alias(c) for c in columns])
    return wide.unpivot(["sample_id"], [F.col(quoted(c)) for c in columns], "variable", "value")
