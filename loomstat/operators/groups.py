"""Tests between groups, per feature: ANOVA, Kruskal-Wallis, Brown-Forsythe; coverage of features.

Input is long: (feature, batch, value). Samples are summed per (feature, batch) with map-side partial
aggregation; everything after that has a few rows per feature. Rank tests sort within one feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.ranking import average_rank, with_fdr
from loomstat.functions.scalars import finite, known
from loomstat.functions.tails import chi2_sf, f_sf


def batch_counts(samples: DataFrame, batch: str = "batch") -> DataFrame:
    return samples.where(F.col(batch).isNotNull()).groupBy(F.col(batch).cast("string").alias("batch")).agg(F.count("*").alias("n_samples"))


def feature_qc(long: DataFrame, max_missing: float = 0.2, min_valid: int = 3, min_valid_per_batch: int = 2, min_batches: int = 2, min_unique: int = 2) -> DataFrame:
    """Coverage of each feature and whether it is kept. A missing batch is a level, "nan"."""
    rows = long.select("feature", F.coalesce(F.col("batch").cast("string"), F.lit("nan")).alias("batch"), known("value").alias("value"))
    per = rows.groupBy("feature", "batch").agg(F.count("*").alias("n"), F.count("value").alias("valid"))
    unique = rows.groupBy("feature").agg(F.countDistinct("value").alias("n_unique"))
    whole = per.groupBy("feature").agg(F.sum("n").alias("n_samples"), F.sum("valid").alias("n_valid"), F.count_if(F.col("valid") >= min_valid_per_batch).alias("valid_batches"), F.min("valid").alias("min_valid_per_batch"))
    missing = 1 - F.col("n_valid") / F.col("n_samples")
    keep = (F.col("n_valid") >= min_valid) & (missing <= max_missing) & (F.col("n_unique") >= min_unique) & (F.col("valid_batches") >= min_batches)
    return whole.join(unique, "feature").select("feature", "n_samples", "n_valid", missing.alias("missing_fraction"), "n_unique", "valid_batches", "min_valid_per_batch", keep.alias("keep"))


def center_statistics(long: DataFrame) -> DataFrame:
    """Count, mean and median per feature and batch."""
    value = known("value")
    return long.groupBy("feature", "batch").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def _moments(rows: DataFrame, value: str = "value") -> DataFrame:
    """Per feature: sums of squares between and within groups, around means, without cancellation."""
    per = rows.groupBy("feature", "batch").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("ss"))
    grand = Window.partitionBy("feature")
    total = F.sum("n").over(grand)
    center = F.sum(F.col("n") * F.col("mean")).over(grand) / total
    per = per.where("n > 0").withColumn("between", F.col("n") * F.pow(F.col("mean") - center, 2))
    return per.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("between").alias("ssb"), F.sum("ss").alias("ssw"))


def _f_statistic(m: DataFrame) -> Column:
    """F; infinite where groups differ and nothing varies within them; NULL where it has no meaning."""
    fits = (F.col("k") >= 2) & (F.col("n") > F.col("k")) & (F.col("ssb") + F.col("ssw") > 0)
    ratio = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k")))
    return F.when(fits, F.coalesce(ratio, F.lit(float("inf"))))


def anova(long: DataFrame) -> DataFrame:
    """(feature, n, k, anova_f, anova_p, eta_squared); NULL with fewer than two groups or no residual freedom."""
    rows = long.select("feature", "batch", finite("value").alias("value")).where("value is not null and batch is not null")
    m = _moments(rows)
    out = m.select("feature", "n", "k", _f_statistic(m).alias("anova_f"), F.try_divide("ssb", F.col("ssb") + F.col("ssw")).alias("eta"))
    return out.select("feature", "n", "k", "anova_f", f_sf("anova_f", F.col("k") - 1, F.col("n") - F.col("k")).alias("anova_p"), F.when(F.col("anova_f").isNotNull(), F.col("eta")).alias("eta_squared"))


def kruskal(long: DataFrame) -> DataFrame:
    """(feature, kruskal_h, kruskal_p, epsilon_squared), corrected for ties."""
    rows = long.select("feature", "batch", finite("value").alias("value")).where("value is not null and batch is not null")
    ranked = rows.withColumn("r", average_rank("value", "feature")).withColumn("t", F.count("*").over(Window.partitionBy("feature", "value")))
    # Each of t tied rows adds t^2 - 1, so a tie adds t^3 - t.
    per = ranked.groupBy("feature", "batch").agg(F.count("*").cast("double").alias("n"), F.sum("r").alias("r"), F.sum(F.pow("t", F.lit(2)) - 1).alias("ties"))
    m = per.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("ties").alias("ties"))
    n, k = F.col("n"), F.col("k")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.try_divide(F.col("ties"), F.pow(n, F.lit(3)) - n))
    out = m.select("feature", "n", "k", F.when((k >= 2) & (n > k), h).alias("kruskal_h"))
    eps = F.greatest((F.col("kruskal_h") - k + 1) / F.when(n > k, n - k), F.lit(0.0))
    return out.select("feature", "kruskal_h", chi2_sf("kruskal_h", k - 1).alias("kruskal_p"), F.when(F.col("kruskal_h").isNotNull(), eps).alias("epsilon_squared"))


def levene(long: DataFrame) -> DataFrame:
    """(feature, levene_stat, levene_p) around medians; groups of one value don't count."""
    rows = long.select("feature", "batch", finite("value").alias("value")).where("value is not null and batch is not null")
    centers = rows.groupBy("feature", "batch").agg(F.median("value").alias("center"), F.count("*").alias("size")).where("size >= 2")
    off = rows.join(centers, ["feature", "batch"]).select("feature", "batch", F.abs(F.col("value") - F.col("center")).alias("value"))
    m = _moments(off)
    out = m.select("feature", "n", "k", _f_statistic(m).alias("levene_stat"))
    return out.select("feature", "levene_stat", f_sf("levene_stat", F.col("k") - 1, F.col("n") - F.col("k")).alias("levene_p"))


def feature_statistics(raw: DataFrame, transformed: DataFrame | None = None) -> DataFrame:
    """All three tests with q values: ANOVA on the transformed values, the others on the raw ones."""
    raw = raw.select("feature", "batch", "value")
    a = anova(transformed if transformed is not None else raw)
    out = a.withColumnsRenamed({"n": "n_valid", "k": "n_batches"}).join(kruskal(raw), "feature", "left").join(levene(raw), "feature", "left")
    for test in ("anova", "kruskal", "levene"):
        out = with_fdr(out, f"{test}_p", f"{test}_q")
    return out
