"""Agreement of observers, per feature: ICC(2,1), correlations, bootstrap intervals.

Long input: (feature, subject, observer, value). Everything but the bootstrap is native aggregation;
the bootstrap resamples one feature's small subjects x observers matrix in an Arrow group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.ranking import average_rank, with_fdr
from loomstat.functions.scalars import feature_seed, fisher_interval, fisher_mean, known
from loomstat.functions.tails import f_sf, t_sf2


def complete_subjects(long: DataFrame) -> DataFrame:
    """Rows of subjects that every observer of the table has measured for the feature."""
    rows = long.select("feature", "subject", "observer", known("value").alias("value")).where("value is not null")
    observers = long.select("observer").distinct().count()
    n = F.count("*").over(Window.partitionBy("feature", "subject"))
    return rows.withColumn("__n", n).where(F.col("__n") == observers).drop("__n")


def icc(long: DataFrame, threshold: float = 0.8, min_subjects: int = 3) -> DataFrame:
    """Two-way random effects, absolute agreement, one rater. Features with too few complete subjects get NULLs."""
    rows = complete_subjects(long)
    g = Window.partitionBy("feature")
    mean = F.avg("value").over(g)
    rows = rows.withColumn("c", F.col("value") - mean)  # centered first, so sums of squares don't cancel
    total = rows.groupBy("feature").agg(F.sum(F.col("c") * F.col("c")).alias("sst"))
    subjects = rows.groupBy("feature", "subject").agg(F.avg("c").alias("m"), F.count("*").alias("k"))
    by_subject = subjects.groupBy("feature").agg(F.sum(F.col("k") * F.col("m") * F.col("m")).alias("ssb"), F.count("*").alias("n"), F.max("k").alias("k"))
    observers = rows.groupBy("feature", "observer").agg(F.avg("c").alias("m"), F.count("*").alias("n"))
    by_observer = observers.groupBy("feature").agg(F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sso"))
    n, k = F.col("n"), F.col("k")
    fits = (n >= min_subjects) & (k >= 2)
    s = total.join(by_subject, "feature").join(by_observer, "feature")
    s = s.withColumn("msb", F.when(fits, F.col("ssb") / (n - 1))).withColumn("mso", F.when(fits, F.col("sso") / (k - 1)))
    rest = F.greatest(F.col("sst") - F.col("ssb") - F.col("sso"), F.lit(0.0))
    noise = F.col("sst") * 1e-14  # what rounding leaves of an exact zero
    s = s.withColumn("mse", F.when(fits, F.when(rest <= noise, 0.0).otherwise(rest) / ((n - 1) * (k - 1))))
    below = F.col("msb") + (k - 1) * F.col("mse") + k * (F.col("mso") - F.col("mse")) / n
    value = F.when((F.col("sst") > 0) & (below > 0), (F.col("msb") - F.col("mse")) / below)
    ratio = F.when(F.col("mse") > 0, F.try_divide("msb", "mse")).when(F.col("msb") > 0, F.lit(float("inf")))
    s = s.select("feature", "n", "k", value.alias("icc_2_1"), F.when(value.isNotNull(), ratio).alias("f"), F.col("msb").alias("ms_between_subjects"), F.col("mso").alias("ms_between_observers"), F.col("mse").alias("ms_error"))
    s = s.withColumn("p_value", f_sf("f", n - 1, (n - 1) * (k - 1)))
    s = with_fdr(s, "p_value", "p_fdr")
    done = long.select("feature").distinct().join(s, "feature", "left")
    return done.withColumn("primary_icc_pass", F.coalesce(F.col("icc_2_1") >= threshold, F.lit(False)))


def icc_matrix(y: np.ndarray) -> np.ndarray:
    """ICC(2,1) of matrices stacked along the first axis (resamples x subjects x observers)."""
    _, n, k = y.shape
    c = y - y.mean(axis=(1, 2), keepdims=True)
    sst = (c**2).sum((1, 2))
    ssb = k * (c.mean(2) ** 2).sum(1)
    sso = n * (c.mean(1) ** 2).sum(1)
    msb, mso = ssb / (n - 1), sso / (k - 1)
    mse = np.maximum(sst - ssb - sso, 0) / ((n - 1) * (k - 1))
    below = msb + (k - 1) * mse + k * (mso - mse) / n
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((sst > 0) & (below > 0), (msb - mse) / below, np.nan)


def cluster_draws(groups: list, iterations: int, seed: int) -> np.ndarray:
    """Row numbers of bootstrap samples that draw whole clusters; each is cut or repeated to the number of rows."""
    rng, n = np.random.default_rng(seed), len(groups)
    members: dict = {}
    for i, g in enumerate(groups):
        members.setdefault(g, []).append(i)
    names = list(members)
    out = np.empty((iterations, n), np.int64)
    for b in range(iterations):
        picked = np.concatenate([members[names[j]] for j in rng.integers(0, len(names), len(names))])
        out[b] = np.resize(picked, n)
    return out


def bootstrap_interval(long: DataFrame, iterations: int = 1000, base_seed: int = 42, clusters: dict | None = None) -> DataFrame:
    """(feature, ci95_low, ci95_high) of the ICC; NULL if fewer than half of the resamples have one.

    ``clusters`` maps subjects to clusters that are drawn whole."""
    rows = complete_subjects(long)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["feature"].iloc[0]
        wide = pdf.pivot(index="subject", columns="observer", values="value").sort_index()
        y = wide.to_numpy(float)
        low = high = None
        if y.shape[0] >= 3 and y.shape[1] >= 2 and iterations > 0:
            if clusters:
                at = cluster_draws([clusters.get(s, s) for s in wide.index], iterations, base_seed)
            else:
                at = np.random.default_rng(feature_seed(name, base_seed)).integers(0, len(y), (iterations, len(y)))
            got = np.concatenate([icc_matrix(y[part]) for part in np.array_split(at, max(1, at.size // 200_000))])
            got = got[np.isfinite(got)]
            if len(got) >= max(1, iterations // 2):
                low, high = np.percentile(got, [2.5, 97.5])
        return pd.DataFrame({"feature": [name], "ci95_low": [low], "ci95_high": [high]}).astype({"ci95_low": float, "ci95_high": float})

    found = rows.groupBy("feature").applyInPandas(run, "feature string, ci95_low double, ci95_high double")
    return found.select("feature", known("ci95_low").alias("ci95_low"), known("ci95_high").alias("ci95_high"))


def correlated(pairs: DataFrame, by: tuple[str, ...], x: str, y: str, method: str = "pearson") -> DataFrame:
    """``by``, n, r: correlation over rows where both are there; NULL if either is constant.

    Ranks are taken among the complete pairs of each group; co-moments are of centered values."""
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method}")
    rows = pairs.select(*by, known(x).alias("x"), known(y).alias("y")).where("x is not null and y is not null")
    if method == "spearman":
        rows = rows.withColumn("rx", average_rank("x", *by)).withColumn("ry", average_rank("y", *by)).select(*by, F.col("rx").alias("x"), F.col("ry").alias("y"))
    spread = F.var_pop("x") * F.var_pop("y")
    m = rows.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), spread.alias("v"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    varies = (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("c", F.sqrt("v"))))
    return m.select(*by, "n", F.when(varies, r).alias("r"))


def correlation_p(df: DataFrame, r: str = "r", n: str = "n", to: str = "p_value") -> DataFrame:
    """With the two-sided p of a correlation, by the t distribution."""
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(F.col(r) * F.sqrt(F.try_divide(F.col(n) - 2, 1 - F.col(r) * F.col(r))))
    return df.withColumn(to, t_sf2(F.when(F.col(n) > 2, t), F.col(n) - 2))


def observer_pairs(long: DataFrame) -> DataFrame:
    """Complete rows of each two observers i < j: (feature, a, b, x, y). A self-join on (feature, subject)."""
    rows = complete_subjects(long)
    left = rows.select("feature", "subject", F.col("observer").alias("a"), F.col("value").alias("x"))
    right = rows.select("feature", "subject", F.col("observer").alias("b"), F.col("value").alias("y"))
    return left.join(right, ["feature", "subject"]).where("a < b").select("feature", "a", "b", "x", "y")


def pair_correlations(long: DataFrame, method: str = "pearson") -> DataFrame:
    """Two observers: (feature, estimate, ci95_low, ci95_high, p_value, p_fdr)."""
    found = correlation_p(correlated(observer_pairs(long), ("feature",), "x", "y", method))
    low, high = fisher_interval("r", "n", method == "spearman")
    out = found.select("feature", F.col("r").alias("estimate"), low.alias("ci95_low"), high.alias("ci95_high"), "p_value")
    return with_fdr(out)


def many_correlations(long: DataFrame, method: str = "pearson") -> DataFrame:
    """More observers: mean on Fisher's scale, median, sd and quartiles over all pairs of observers."""
    r = correlated(observer_pairs(long), ("feature", "a", "b"), "x", "y", method)
    sd = F.when(F.count("r") > 1, F.stddev_samp("r")).when(F.count("r") == 1, 0.0)
    quartile = lambda q: F.percentile("r", F.lit(q))
    return r.groupBy("feature").agg(fisher_mean("r").alias("mean"), F.median("r").alias("median"), sd.alias("sd"), quartile(0.25).alias("q25"), quartile(0.75).alias("q75"), F.min("r").alias("min"), F.max("r").alias("max"))


def reproducibility(long: DataFrame, min_valid: int = 3, iterations: int = 1000, threshold: float = 0.8, clusters: dict | None = None) -> dict[str, DataFrame]:
    """The tables icc, spearman and pearson for two or more observers."""
    observers = long.select("observer").distinct().count()
    if observers < 2:
        raise ValueError("at least two observers are needed")
    uneven = long.groupBy("feature", "subject").agg(F.countDistinct("observer").alias("k")).where(F.col("k") < observers).limit(1).collect()
    if uneven:
        raise ValueError(f"observers have not measured the same subjects and features: {uneven[0].feature}, {uneven[0].subject}")
    main = icc(long, threshold, min_valid).join(bootstrap_interval(long, iterations, clusters=clusters), "feature", "left")
    main = main.select("feature", "icc_2_1", "ci95_low", "ci95_high", "p_value", "p_fdr", "ms_between_subjects", "ms_between_observers", "ms_error", "primary_icc_pass")
    other = pair_correlations if observers == 2 else many_correlations
    return {"icc": main, "spearman": other(long, "spearman"), "pearson": other(long, "pearson")}
