"""Tables behind figures: one row for each mark that a renderer draws, and one for what it writes beside them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.ranking import top_by
from loomstat.functions.scalars import discretization_label, histogram_bin, known, threshold_category
from loomstat.operators import agreement, network, reduce
from loomstat.plans.report import density, family_rank, histogram, reproducibility_workbook, volcano
from loomstat.sources import tables

#: A trait with at most so many values is drawn by group; features that a heat map can show.
MOST_GROUPS, MOST_SHOWN = 6, 2000


def display_order(names: Sequence[str], order: Sequence[str] | None = None, linkage: np.ndarray | None = None, labels: dict[str, str] | None = None) -> list[str]:
    """Features as a heat map shows them: in the order given, by the leaves of a tree, by label (ties as they
    come, without a label last), or as they are."""
    names = list(names)
    if order is not None:
        if missing := [n for n in order if n not in set(names)]:
            raise ValueError(f"{len(missing)} names of the order are unknown: {', '.join(missing[:5])}")
        return list(order)
    if linkage is not None:
        return [names[i] for i in network.leaves(linkage)]
    if labels is not None:
        return sorted(names, key=lambda n: (labels.get(n) is None, labels.get(n) or ""))
    return names


def heatmap(similarity: DataFrame, order: Sequence[str]) -> DataFrame:
    """``(x, y, feature_x, feature_y, similarity)`` of the cells shown, of ``similarity(feature_a, feature_b, similarity)``."""
    spark = similarity.sparkSession
    place = spark.createDataFrame(list(enumerate(order)), "i long, name string")
    at = lambda side, to: place.select(F.col("name").alias(f"feature_{side}"), F.col("i").alias(to))
    cells = similarity.join(at("a", "y"), "feature_a").join(at("b", "x"), "feature_b")
    cells = cells.select("x", "y", F.col("feature_b").alias("feature_x"), F.col("feature_a").alias("feature_y"), known("similarity").alias("similarity"))
    if cells.where("similarity is not null").isEmpty():
        raise ValueError("no similarity is finite")
    return cells


def heatmap_limits(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("similarity").alias("vmin"), F.max("similarity").alias("vmax"), F.countDistinct("feature_x").alias("n_features"))


def correlations(arrays: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(feature_a, feature_b, similarity)``: correlations of all pairs of at most ``MOST_SHOWN`` features of (sample_id, features
    array), each with itself too; 0 with a constant one. Samples enter through a distributed sum."""
    if len(names) > MOST_SHOWN:
        raise ValueError(f"a heat map of {len(names)} features; {MOST_SHOWN} at most")
    _, _, g = reduce.gramian(arrays)
    sd = np.sqrt(np.maximum(np.diag(g), 0))
    r = np.clip(g / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1)), -1, 1)
    np.fill_diagonal(r, 1)
    a, b = np.divmod(np.arange(len(names) ** 2), len(names))
    own = np.array(names, object)
    return arrays.sparkSession.createDataFrame(pd.DataFrame({"feature_a": own[a], "feature_b": own[b], "similarity": r.ravel()}), "feature_a string, feature_b string, similarity double")


def hub_significance(membership: DataFrame, significance: DataFrame, clusters: DataFrame, target: str, top_n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Points ``(feature, k_me, significance, in_target, label)`` - a label, the name after its last ``__``, for the
    target's ``top_n`` hubs - and the target's rank correlation ``(n, r, p_value)`` of membership and significance."""
    names = [r.component for r in membership.select("component").distinct().orderBy("component").collect()]
    if not names:
        raise ValueError("there is no component")
    own = membership.where(F.col("component") == (target if target in names else names[0])).select("feature", "k_me")
    points = own.join(significance.select("feature", "significance"), "feature").join(clusters.select("feature", F.col("cluster").cast("string").alias("cluster")), "feature", "left")
    points = points.withColumn("in_target", F.coalesce(F.col("cluster") == target, F.lit(False))).drop("cluster")
    hubs = top_by(points.where("in_target and k_me is not null").withColumn("__all", F.lit(1)), ("__all",), [F.desc(F.abs("k_me")), F.col("feature")], top_n)
    labels = hubs.select("feature", F.element_at(F.split("feature", "__"), -1).alias("label"))
    inside = points.where("in_target and k_me is not null and significance is not null").withColumn("module", F.lit(target))
    r = agreement.correlated(inside, ("module",), "k_me", "significance", "spearman")
    return points.join(labels, "feature", "left"), agreement.correlation_p(r).select("n", "r", "p_value")


def grouped_profile(rows: DataFrame) -> DataFrame:
    """A box for each value of ``trait``: ``(trait, n, whisker_low, q1, median, q3, whisker_high, n_outliers)`` of ``score``, whiskers
    at the last scores within 1.5 interquartile ranges of the box."""
    known_rows = rows.where("trait is not null and score is not null")
    box = known_rows.groupBy("trait").agg(F.count("*").alias("n"), *[F.percentile("score", F.lit(q)).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("score") >= F.col("q1") - reach) & (F.col("score") <= F.col("q3") + reach)
    return known_rows.join(box, "trait").groupBy("trait", "n", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("score"))).alias("whisker_low"), F.max(F.when(inside, F.col("score"))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))


def line_profile(rows: DataFrame) -> DataFrame:
    """The least squares line of ``score`` on ``trait``: ``(n, slope, intercept, r, p_value)``."""
    number = rows.select(F.col("trait").cast("double").alias("x"), F.col("score").alias("y"), F.lit("all").alias("one")).where("x is not null and y is not null")
    line = number.groupBy("one").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    r = agreement.correlation_p(agreement.correlated(number, ("one",), "x", "y"))
    return r.join(line, "one").select("n", "slope", "intercept", "r", "p_value")


def eigengene_profile(scores: DataFrame, trait: DataFrame, component: str) -> tuple[str, DataFrame]:
    """Scores ``(sample_id, component, score)`` of a component against ``trait(sample_id, trait)``: ("boxes", a box per
    value) for text, booleans or ``MOST_GROUPS`` values at most, else ("line", the regression)."""
    rows = scores.where(F.col("component") == component).select("sample_id", "score").join(trait.select("sample_id", "trait"), "sample_id")
    kind = dict(trait.dtypes)["trait"]
    few = kind in ("string", "boolean") or trait.where("trait is not null").select("trait").distinct().limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    return ("boxes", grouped_profile(rows)) if few else ("line", line_profile(rows))


def batch_distributions(before: DataFrame, after: DataFrame, features: Sequence[str], points: int = 150) -> DataFrame:
    """``(stage, feature, batch, i, x, density)``: the kernel density of each batch before and after harmonization.
    Batches of one value have none."""
    own = lambda df, stage: df.where(F.col("feature").isin(list(features))).select(F.lit(stage).alias("stage"), "feature", "batch", known("value").alias("value"))
    both = own(before, "before").unionAll(own(after, "after"))
    sizes = Window.partitionBy("stage", "feature", "batch")
    spread = both.withColumn("__sd", F.stddev_pop("value").over(sizes)).where("__sd > 1e-12").drop("__sd")
    return density(spread, ["stage", "feature", "batch"], points)


def reproducibility_values(sheets: dict[str, DataFrame]) -> DataFrame:
    """``(sheet, feature, value)`` of whichever of spearman, pearson and icc there are."""
    out = None
    for name in ("spearman", "pearson", "icc"):
        if name in sheets:
            c = "icc_2_1" if name == "icc" else "estimate" if "estimate" in sheets[name].columns else "mean"
            rows = sheets[name].select(F.lit(name).alias("sheet"), "feature", known(c).alias("value")).where("value is not null")
            out = rows if out is None else out.unionAll(rows)
    if out is None:
        raise ValueError("there is no sheet to show")
    return out


def reproducibility_histograms(values: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Bars ``(sheet, bin, low, n)``, 0.05 wide from 0, or 0.1 wide from -1 where a value is negative; and
    ``(sheet, n, mean, median, n_pass, pass_rate)``, the last two for icc only."""
    least = values.groupBy("sheet").agg(F.min("value").alias("least"))
    rows = values.join(least, "sheet")
    wide = F.col("least") < 0
    bins = F.when(wide, histogram_bin("value", -1.0, 0.1, 20)).otherwise(histogram_bin("value", 0.0, 0.05, 20))
    bars = rows.withColumn("bin", bins).where("bin is not null").groupBy("sheet", "bin", wide.alias("wide")).agg(F.count("*").alias("n"))
    bars = bars.select("sheet", "bin", F.when(F.col("wide"), F.col("bin") * 0.1 - 1).otherwise(F.col("bin") * 0.05).alias("low"), "n")
    passed = F.count_if((F.col("sheet") == "icc") & (F.col("value") >= threshold))
    stats = values.groupBy("sheet").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), passed.alias("n_pass"))
    icc = F.col("sheet") == "icc"
    return bars, stats.select("sheet", "n", "mean", "median", F.when(icc, F.col("n_pass")).alias("n_pass"), F.when(icc, F.col("n_pass") / F.col("n")).alias("pass_rate"))


def synteny(table: DataFrame, metric: str = "icc_2_1", thresholds: Sequence[float] = (0.5, 0.75, 0.9), group: str = "family", order: Sequence[str] | None = None) -> DataFrame:
    """``(feature, group, position, y, value, category, disc_label)``: features from the top in display order - groups, then
    discretization, then name, missing ones first - with how many thresholds each value reaches."""
    if metric not in table.columns or "feature" not in table.columns:
        raise ValueError(f"the table needs the columns feature and {metric}")
    if len(thresholds) > 4:
        raise ValueError("at most four thresholds")
    rows = table if group in table.columns else table.withColumn(group, F.lit("All Features"))
    has = {"is_discretised", "discretisation_param"} <= set(rows.columns)
    number = F.col("discretisation_param").cast("double") if "discretisation_param" in rows.columns else F.lit(0.0)
    label = F.when(F.coalesce(F.col("is_discretised"), F.lit(False)), discretization_label(number)).otherwise("None") if has else F.lit(None).cast("string")
    if order is None:
        rank: list[Column] = [family_rank(group).asc_nulls_first()] if group == "family" else []
        at = F.row_number().over(Window.orderBy(*rank, F.col(group).asc_nulls_first(), number.asc_nulls_first(), "feature")) - 1
        placed = rows.withColumn("position", at)
    else:
        wanted = table.sparkSession.createDataFrame(list(enumerate(order)), "position int, feature string")
        placed = wanted.join(rows, "feature", "left")
    value = known(metric)
    placed = placed.select("feature", F.col(group).alias("group"), F.col("position").cast("long").alias("position"), value.alias("value"), threshold_category(value, list(thresholds)).alias("category"), label.alias("disc_label"))
    return placed.withColumn("y", F.count("*").over(Window.partitionBy()) - 1 - F.col("position"))


def reproducibility_report(long: DataFrame | None = None, results: dict[str, DataFrame] | None = None, catalog: DataFrame | None = None, threshold: float = 0.8, workbook: str | None = None, folder: str | None = None, **options) -> dict[str, DataFrame]:
    """Agreement of readers (computed from ``long`` if it is given), the tables of its figures, and its files."""
    if long is None and results is None:
        raise ValueError("either readings or results are needed")
    sheets = agreement.reproducibility(long, threshold=threshold, **options) if long is not None else dict(results)
    values = reproducibility_values(sheets)
    bars, stats = reproducibility_histograms(values, threshold)
    first = sheets.get("icc", sheets.get("spearman", sheets.get("pearson")))
    metric = next(c for c in ("icc_2_1", "estimate", "mean") if c in first.columns)
    shown = first.join(catalog, "feature", "left") if catalog is not None else first
    out = sheets | {"_histograms": bars, "_statistics": stats, "_synteny": synteny(shown, metric)}
    public = {n: df for n, df in out.items() if not n.startswith("_")}
    if workbook:
        reproducibility_workbook(public, workbook)
    if folder:
        tables.write_report(public, folder)
    return out


def batch_figure(arrays: DataFrame, stats: DataFrame, method: str = "pca", alpha: float = 0.05, seed: int = 42) -> dict[str, DataFrame]:
    """Coordinates of samples in two dimensions, the histogram of ANOVA q values, and how many are at most ``alpha``."""
    q = stats.where("anova_q is not null")
    share = q.agg(F.count("*").alias("n_features"), F.count_if(F.col("anova_q") <= alpha).alias("n_significant"))
    return {"coordinates": reduce.embed_2d(arrays, method, seed), "q_histogram": histogram(q, "anova_q"), "q_summary": share.withColumn("percent", F.try_divide(100.0 * F.col("n_significant"), F.col("n_features")))}


def panel_grid(panels: int) -> tuple[int, int]:
    """Rows and columns of one to nine panels."""
    if not 1 <= panels <= 9:
        raise ValueError(f"one to nine panels, not {panels}")
    columns = panels if panels <= 3 else 2 if panels == 4 else 3
    return -(-panels // columns), columns


def volcano_limits(results: DataFrame, strategy: str = "clip", percentile: float = 99.0, shared: bool = False) -> DataFrame:
    """``(model, x_limit, y_limit)`` of each panel, or one row with model null: x shows -x_limit to x_limit."""
    if strategy not in ("clip", "include"):
        raise ValueError("strategy is clip or include")
    points = volcano(results)
    extent = F.max(F.abs("x")) if strategy == "include" else F.percentile(F.abs("x"), F.lit(percentile / 100))
    found = [F.when(extent.isNull(), 1.0).otherwise(F.greatest(extent, F.lit(1e-6)) * 1.08).alias("x_limit"), F.coalesce(F.max("y") * 1.08, F.lit(1.0)).alias("y_limit")]
    return points.agg(F.lit(None).cast("string").alias("model"), *found) if shared else points.groupBy("model").agg(*found)


def dendrogram(modules: network.CoexpressionModules, spark) -> tuple[DataFrame, DataFrame]:
    """Leaves ``(position, feature, module)`` from left to right, and joins ``(step, a, b, height, size)`` of the tree."""
    own = {f: m for f, m, *_ in modules.weights_}
    order = [modules.names_[i] for i in network.leaves(modules.linkage_)]
    leaves = spark.createDataFrame([(i, f, own.get(f, network.UNASSIGNED)) for i, f in enumerate(order)], "position long, feature string, module string")
    joins = [(i, int(a), int(b), float(h), int(n)) for i, (a, b, h, n) in enumerate(modules.linkage_)]
    return leaves, spark.createDataFrame(joins, "step long, a long, b long, height double, size long")
