"""Whole analyses and the tables behind figures; rendering is left to whatever reads them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.ranking import top_by
from loomstat.functions.scalars import histogram_bin, known, minus_log10
from loomstat.operators import catalogs, diagnostics, groups, layout, prep
from loomstat.sources import tables

#: Families that come first in feature order.
FAMILY_ORDER = ("morphology", "intensity", "histogram", "ivh", "glcm", "glrlm", "glszm", "gldzm", "ngtdm", "ngldm")


def feature_summary(stats: DataFrame, effect: str = "eta_squared", q: str = "anova_q") -> DataFrame:
    name = effect
    return stats.agg(
        F.count("*").alias("n_features"), F.median(effect).alias(f"median_{name}"), F.percentile(effect, F.lit(0.9)).alias(f"p90_{name}"), F.count_if(F.col(q) <= 0.05).alias("n_significant")
    )


def effect_summary(stats: DataFrame) -> DataFrame:
    """One row for the tests of all features: how large effects are, and how many q values are at most 0.05."""
    sizes = [f for e in ("eta_squared", "epsilon_squared") for f in (F.median(e).alias(f"median_{e}"), F.percentile(e, F.lit(0.9)).alias(f"p90_{e}"))]
    return stats.agg(F.count("*").alias("n_features"), *sizes, *[F.count_if(F.col(f"{t}_q") <= 0.05).alias(f"{t}_q_le_0_05") for t in ("anova", "kruskal", "levene")])


def dataset_summary(long: DataFrame, qc: DataFrame, matrix: DataFrame, n_raw: int, strategy: str) -> DataFrame:
    """One row of counts for a batch analysis of ``long``, of which coverage is ``qc`` and ``matrix`` is left for the whole-matrix
    statistics; ``n_raw`` features were there before any selection."""
    a = long.agg(F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("batch").alias("n_batches"))
    b = qc.agg(F.count("*").alias("n_features_selected"), F.count_if("keep").alias("n_features_kept_qc"), F.median("missing_fraction").alias("median_missing_fraction"))
    c = matrix.agg(F.countDistinct("sample_id").alias("n_samples_global"), F.countDistinct("feature").alias("n_features_global"))
    less = lambda x, y, to: (F.col(x) - F.col(y)).alias(to)
    return a.crossJoin(b).crossJoin(c).select(
        "n_samples", F.lit(n_raw).cast("long").alias("n_features_raw"), "n_features_selected", "n_features_kept_qc", F.lit(strategy).alias("global_missing_strategy"), "n_samples_global", "n_features_global",
        less("n_features_kept_qc", "n_features_global", "features_excluded_from_global"), less("n_samples", "n_samples_global", "samples_excluded_from_global"), "n_batches", "median_missing_fraction", less("n_features_selected", "n_features_kept_qc", "features_removed_qc"),
    )


def with_batch_counts(qc: DataFrame, long: DataFrame) -> DataFrame:
    """With the values that each batch has: n_batch_{batch}; a missing batch is "nan"."""
    rows = long.select("feature", F.coalesce(F.col("batch").cast("string"), F.lit("nan")).alias("batch"), "value")
    names = [r.batch for r in rows.select("batch").distinct().orderBy("batch").collect()]
    wide = rows.groupBy("feature").pivot("batch", names).agg(F.count(known("value")))
    return qc.join(wide.toDF("feature", *[f"n_batch_{n}" for n in names]), "feature", "left").fillna(0, [f"n_batch_{n}" for n in names])


def with_centers(stats: DataFrame, long: DataFrame) -> DataFrame:
    """With n, mean and median of each batch: center_{batch}_n, center_{batch}_mean, center_{batch}_median."""
    names = [r.batch for r in long.select(F.col("batch").cast("string").alias("batch")).where("batch is not null").distinct().orderBy("batch").collect()]
    wide = groups.center_statistics(long).withColumn("batch", F.col("batch").cast("string")).groupBy("feature").pivot("batch", names).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("median").alias("median"))
    return stats.join(wide.toDF("feature", *[c if c == "feature" else f"center_{c}" for c in wide.columns[1:]]), "feature", "left")


def top_hits(results: DataFrame, mode: str = "fdr", alpha: float = 0.05, per_panel: int | None = None) -> DataFrame:
    """Rows with status ok whose q (mode fdr) or p (nominal) is below ``alpha``, or all (ranked): the first by p in each model."""
    rows = results.where("status = 'ok'")
    if mode in ("fdr", "nominal"):
        rows = rows.where(F.col("p_fdr" if mode == "fdr" else "p_value") < alpha)
    elif mode != "ranked":
        raise ValueError(f"unknown mode {mode}")
    if per_panel is None:
        return rows.orderBy("model", "p_value", "feature")
    return top_by(rows, ("model",), [F.col("p_value").asc_nulls_last(), F.col("feature")], per_panel).drop("rank")


def value_column(value: str):
    """A display value of an association row."""
    if value == "neg_log10_p":
        return minus_log10("p_value")
    if value == "neg_log10_fdr":
        return minus_log10("p_fdr")
    if value == "log2_effect":
        return F.log2(F.greatest(F.col("effect"), F.lit(5e-324)))
    if value in ("coef", "effect", "statistic", "ci_low", "ci_high"):
        return F.col(value)
    raise ValueError(f"unknown value {value}")


def value_matrix(results: DataFrame, value: str, tiers: list[str]) -> DataFrame:
    """Features x tiers."""
    return results.withColumn("__v", value_column(value)).groupBy("feature").pivot("model", tiers).agg(F.first("__v", ignorenulls=True))


def tier_values(results: DataFrame, value: str = "neg_log10_p", tier: str | None = None) -> DataFrame:
    """``(feature, value)`` of one tier (the first by name, if none is named), for a bar track of a figure."""
    tiers = [r.model for r in results.select("model").distinct().orderBy("model").collect()]
    tier = tier if tier is not None else next(iter(tiers), None)
    if tier not in tiers:
        raise ValueError(f"unknown tier {tier}; there are {', '.join(tiers)}")
    return results.where(F.col("model") == tier).select("feature", value_column(value).alias("value"))


def association_workbook(results: DataFrame, path: str, mode: str = "fdr", alpha: float = 0.05, per_panel: int | None = 50) -> str:
    """A workbook with all associations and the top hits."""
    return tables.write_workbook({"associations": results, "top_hits": top_hits(results, mode, alpha, per_panel)}, path, tables.ASSOCIATIONS)


def batch_workbook(results: dict[str, DataFrame], path: str) -> str:
    return tables.write_workbook(results, path, tables.BATCH_EFFECTS)


def reproducibility_workbook(results: dict[str, DataFrame], path: str) -> str:
    return tables.write_workbook({n: results[n] for n in ("spearman", "pearson", "icc") if n in results}, path, tables.REPRODUCIBILITY)


def histogram(df: DataFrame, column: str, low: float = 0.0, width: float = 0.05, bins: int = 20) -> DataFrame:
    at = df.select(histogram_bin(column, low, width, bins).alias("bin")).where("bin is not null")
    return at.groupBy("bin").agg(F.count("*").alias("n")).select("bin", (F.col("bin") * width + low).alias("low"), "n")


def family_rank(family: str = "family") -> Column:
    """Place of a family among the fixed ones, one after them for any other, null for none."""
    at = F.array_position(F.array(*map(F.lit, FAMILY_ORDER)), F.col(family))
    return F.when(at > 0, at).when(F.col(family).isNotNull(), len(FAMILY_ORDER) + 1)


def family_order(df: DataFrame, family: str = "family") -> DataFrame:
    """``position`` by family - the fixed ones first, others by name, none last - then feature."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(family_rank(family).asc_nulls_last(), family, "feature")))


def family_blocks(ordered: DataFrame) -> DataFrame:
    """Runs of one family along ``position``: (block, family, start, end). A row per feature, so one task."""
    w = Window.orderBy("position")
    starts = (~F.lag("family").over(w).eqNullSafe(F.col("family")) | (F.row_number().over(w) == 1)).cast("int")
    runs = ordered.withColumn("__s", starts).withColumn("block", F.sum("__s").over(w))
    return runs.groupBy("block", "family").agg(F.min("position").alias("start"), F.max("position").alias("end"))


def volcano(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(model, feature, x, y, significant): log2 of ratios or plain coefficients against -log10 p."""
    rows = results.where("status = 'ok' and p_value > 0")
    ratio = F.col("effect_name").isin("HR", "OR")
    return rows.select("model", "feature", F.when(ratio, F.log2("effect")).otherwise(F.col("coef")).alias("x"), minus_log10("p_value").alias("y"), F.coalesce(F.col("p_fdr") < alpha, F.lit(False)).alias("significant"))


def manhattan(results: DataFrame, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Points in family order, and per model the largest significant p."""
    rows = results.where("status = 'ok' and p_value > 0")
    order = family_order(rows.select("feature", "family").distinct()).select("feature", "position")
    line = rows.where(F.col("p_fdr") < alpha).groupBy("model").agg(F.max("p_value").alias("largest_significant_p"))
    return rows.join(order, "feature").select("model", "feature", "family", "position", minus_log10("p_value").alias("y")), line


def linear_profile(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Least squares line and correlation per group."""
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by)
    return g.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.sqrt(F.regr_r2(y, x)).alias("abs_r"))


def density(long: DataFrame, by: list[str], points: int = 150) -> DataFrame:
    """Gaussian kernel density of each group on a grid over its range; groups are cut to sums per grid cell natively
    when large: values enter through a histogram of 2048 cells, so no group is gathered."""
    w = Window.partitionBy(*by)
    rows = long.where("value is not null").withColumn("lo", F.min("value").over(w)).withColumn("hi", F.max("value").over(w)).withColumn("n", F.count("*").over(w)).withColumn("sd", F.stddev_samp("value").over(w))
    cell = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 2047)).otherwise(0)
    cells = rows.withColumn("cell", cell).groupBy(*by, "lo", "hi", "n", "sd", "cell").agg(F.count("*").alias("c"), F.avg("value").alias("v"))
    grid = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    kernel = F.col("c") * F.exp(-F.pow((F.col("x") - F.col("v")) / h, F.lit(2)) / 2) / (F.col("n") * h * 2.5066282746310002)
    return grid.groupBy(*by, "i", "x").agg(F.sum(kernel).alias("density"))


#: Ways with missing values of the whole matrix, by the names that they may be asked for with.
STRATEGIES = {"complete-features": "complete_features", "complete-cases": "complete_cases", "median-impute": "median"}


def batch_effects(
    long: DataFrame, transform=None, strategy: str = "complete-features", permutations: int = 999, components: int = 20, harmonize: bool = True, max_missing: float = 0.5, min_valid: int = 20, min_valid_per_batch: int = 5,
    min_batches: int = 3, min_unique: int = 3, features: Sequence[str] | None = None, catalog: catalogs.FeatureCatalog | None = None, reference: str | None = None, parametric: bool = True, mean_only: bool = False, covariates: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Coverage, tests per feature, diagnostics of the whole matrix and the same after harmonization.

    ``long``: sample_id, batch, feature, value, and covariates if any. ``transform`` is any function of a long table; the default
    winsorizes, normalizes and scales. ``features`` are names to look at (all, if not given); features that fail coverage are
    left out of everything after it. Tables by feature get the ``catalog``'s columns.
    """
    n_raw = long.select("feature").distinct().count()
    if features is not None:
        long = long.where(F.col("feature").isin(list(features)))
    named = (lambda df: catalog.annotate(df)) if catalog is not None else (lambda df: df)
    qc = groups.feature_qc(long, max_missing, min_valid, min_valid_per_batch, min_batches, min_unique)
    kept = qc.where("keep").select("feature")
    if kept.isEmpty():
        raise ValueError("no feature passes coverage")
    raw = long.join(kept, "feature", "left_semi").persist()  # read by every test that follows; lost blocks are computed again
    prepared = (transform or (lambda x: prep.FeaturePrep().fit_transform(x)))(raw).persist()
    matrix = prep.imputed(prepared, STRATEGIES.get(strategy, strategy)).persist()
    stats = groups.feature_statistics(raw, prepared)
    out = {"dataset_summary": dataset_summary(long, qc, matrix, n_raw, strategy), "batch_counts": groups.batch_counts(long.select("sample_id", "batch").distinct()), "feature_qc": named(with_batch_counts(qc, long)), "feature_stats": named(with_centers(stats, raw))}
    arrays = layout.long_to_array(matrix, ["sample_id", "batch"])
    both = [diagnostics.global_diagnostics(arrays, "raw_transformed", components, permutations)]
    summary = [effect_summary(stats).select(F.lit("raw_transformed").alias("matrix"), "*")]
    if harmonize:
        corrected = prep.BatchHarmonizer(reference, parametric, mean_only=mean_only).fit_transform(matrix, list(covariates))
        corrected = corrected.join(matrix.select("sample_id", "feature", F.col("value").alias("__before")), ["sample_id", "feature"])
        bad = F.col("value").isNull() | F.isnan("value")
        out["combat_adjustment_notes"] = corrected.agg(F.count_if(bad).alias("replaced_values"))
        corrected = corrected.withColumn("value", F.when(bad, F.col("__before")).otherwise(F.col("value"))).drop("__before").persist()
        after = groups.feature_statistics(corrected)
        out["combat_feature_stats"] = named(with_centers(after, corrected))
        both.append(diagnostics.global_diagnostics(layout.long_to_array(corrected, ["sample_id", "batch"]), "combat", components, permutations))
        summary.append(effect_summary(after).select(F.lit("combat").alias("matrix"), "*"))
    for name, parts in (("global_diagnostics", both), ("feature_summary", summary)):
        out[name] = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out
