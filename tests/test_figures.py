"""Tables behind figures, chains of steps and searches, against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import diagnostics, network, prep, reduce, search
from loomstat.plans import figures, report


def test_display_order():
    names = ["a", "b", "c", "d"]
    assert figures.display_order(names) == names
    assert figures.display_order(names, labels={"a": "y", "b": "x", "d": "x"}) == ["b", "d", "a", "c"]
    link = network.average_linkage(np.abs(np.subtract.outer([0.0, 5, 1, 6], [0.0, 5, 1, 6])))
    assert {frozenset(figures.display_order(names, linkage=link)[:2]), frozenset(figures.display_order(names, linkage=link)[2:])} == {frozenset("ac"), frozenset("bd")}
    assert figures.display_order(names, ["c", "a"], link, {}) == ["c", "a"]
    with pytest.raises(ValueError, match="unknown"):
        figures.display_order(names, ["a", "q"])


def test_heatmap(spark):
    x = np.random.default_rng(1).normal(size=(30, 4))
    x[:, 3] = 2
    arrays = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, features array<double>")
    sim = figures.correlations(arrays, ["a", "b", "c", "d"])
    cells = figures.heatmap(sim, ["c", "a"]).collect()
    want = np.corrcoef(x[:, :3].T)
    got = {(r.feature_y, r.feature_x): (r.y, r.x, r.similarity) for r in cells}
    assert len(got) == 4 and got["c", "a"][:2] == (0, 1) and got["c", "a"][2] == pytest.approx(want[2, 0])
    assert {r.similarity for r in sim.where("feature_a = 'd'").collect()} == {0.0, 1.0}
    with pytest.raises(ValueError, match="finite"):
        figures.heatmap(sim.withColumn("similarity", F.lit(float("nan"))), ["a"])


def test_profiles(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=40)
    y[0] = 30
    scores = spark.createDataFrame([(i, "m", float(v)) for i, v in enumerate(y)], "sample_id long, component string, score double")
    groups = spark.createDataFrame([(i, "ab"[i % 2] if i else "a") for i in range(40)], "sample_id long, trait string")
    kind, boxes = figures.eigengene_profile(scores, groups, "m")
    a = {r.trait: r for r in boxes.collect()}["a"]
    own = y[::2]
    q1, q3 = np.percentile(own, [25, 75])
    inside = own[(own >= q1 - 1.5 * (q3 - q1)) & (own <= q3 + 1.5 * (q3 - q1))]
    assert kind == "boxes" and a.median == pytest.approx(np.median(own)) and a.whisker_high == pytest.approx(inside.max()) and a.n_outliers == len(own) - len(inside) >= 1
    kind, line = figures.eigengene_profile(scores, spark.createDataFrame([(i, float(i)) for i in range(40)], "sample_id long, trait double"), "m")
    slope, intercept = np.polyfit(np.arange(40), y, 1)
    r = line.first()
    assert kind == "line" and r.slope == pytest.approx(slope) and r.intercept == pytest.approx(intercept) and r.r == pytest.approx(np.corrcoef(np.arange(40), y)[0, 1])


def test_densities_are_kernel_estimates(spark):
    x = np.random.default_rng(3).normal(size=200)
    rows = [("f", "p", float(v)) for v in x] + [("f", "flat", 1.0)] * 5
    long = spark.createDataFrame(rows, "feature string, batch string, value double")
    got = figures.batch_distributions(long, long.where("batch = 'flat'"), ["f"], 20).orderBy("i").collect()
    assert {(r.stage, r.batch) for r in got} == {("before", "p")} and len(got) == 20
    h = x.std(ddof=1) * 200**-0.2
    for r in got:
        want = np.exp(-(((r.x - x) / h) ** 2) / 2).sum() / (200 * h * np.sqrt(2 * np.pi))
        assert r.density == pytest.approx(want, rel=1e-3)


def test_reproducibility_report(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f, s, o, float(v)) for f in ("glcm__a", "x__b") for s in range(12) for base in (rng.normal(),) for o, v in (("r1", base), ("r2", base + rng.normal() / 9))]
    long = spark.createDataFrame(rows, "feature string, subject long, observer string, value double")
    families = spark.createDataFrame([("glcm__a", "glcm"), ("x__b", None)], "feature string, family string")
    out = figures.reproducibility_report(long, catalog=families, folder=str(tmp_path / "r"), iterations=20)
    assert (tmp_path / "r" / "icc").exists() and not (tmp_path / "r" / "_synteny").exists()
    assert [r.feature for r in out["_synteny"].orderBy("position").collect()] == ["x__b", "glcm__a"]
    stats = {r.sheet: r for r in out["_statistics"].collect()}
    assert stats["icc"].n_pass == 2 and stats["icc"].pass_rate == 1 and stats["pearson"].n_pass is None
    assert out["_histograms"].where("sheet = 'icc'").agg(F.sum("n")).first()[0] == 2
    with pytest.raises(ValueError, match="needed"):
        figures.reproducibility_report()


def test_synteny_without_values_and_with_an_order(spark):
    df = spark.createDataFrame([("a", 0.4), ("b", None), ("c", 0.95)], "feature string, icc double")
    got = figures.synteny(df, "icc", (0.5, 0.9), order=["c", "zz", "a"]).orderBy("position").collect()
    assert [(r.feature, r.y, r.category, r.group) for r in got] == [("c", 2, 2, "All Features"), ("zz", 1, None, None), ("a", 0, 0, "All Features")]
    with pytest.raises(ValueError, match="four"):
        figures.synteny(df, "icc", (1, 2, 3, 4, 5))


def test_family_order(spark):
    df = spark.createDataFrame([("f1", "ngldm"), ("f2", "statistics"), ("f3", "morphology"), ("f4", None), ("f5", "Alpha")], "feature string, family string")
    assert [r.feature for r in report.family_order(df).orderBy("position").collect()] == ["f3", "f1", "f5", "f2", "f4"]


def test_volcano_limits_and_panels(spark):
    rows = [("m", str(i), "ok", 0.5 / (i + 1), 0.01, float(i), None, None) for i in range(101)] + [("m", "bad", "fit_failed", 0.1, None, 1e9, None, None)]
    df = spark.createDataFrame(rows, "model string, feature string, status string, p_value double, p_fdr double, coef double, effect double, effect_name string")
    r = figures.volcano_limits(df).first()
    assert r.x_limit == pytest.approx(99 * 1.08) and r.y_limit == pytest.approx(-np.log10(0.5 / 101) * 1.08)
    assert figures.volcano_limits(df, "include", shared=True).first().x_limit == pytest.approx(108)
    assert figures.volcano_limits(df.where("false"), shared=True).first().x_limit == 1
    assert [figures.panel_grid(n) for n in (1, 3, 4, 7, 9)] == [(1, 1), (1, 3), (2, 2), (3, 3), (3, 3)]
    with pytest.raises(ValueError):
        figures.panel_grid(10)


def test_chain_and_grid_search(spark):
    x = np.random.default_rng(5).normal(size=(40, 6)) @ np.diag([5, 3, 1, 0.5, 0.2, 0.1])
    arrays = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, features array<double>")
    chain = search.Chain([("pca", reduce.PCA(2))])
    assert chain.get_params() == {"pca__n": 2, "pca__whiten": False}
    with pytest.raises(ValueError, match="unknown"):
        chain.set_params(pca__q=1)

    def close(fitted, test):
        back = fitted.inverse_transform(fitted.transform(test).drop("features"))
        both = back.select("sample_id", F.col("features").alias("again")).join(test, "sample_id").collect()
        return -float(np.mean([(np.array(r.again) - np.array(r.features)) ** 2 for r in both]))

    folded = search.hashed_folds(arrays, "sample_id", 2)
    found = search.grid_search(folded, chain, {"pca__n": [1, 3]}, {"mse": close}, 2)
    assert found.best == {"pca__n": 3} and found.scores.count() == 4 and found.fitted.steps[0][1].n == 3
    assert found.summary().where("rank = 1").first().candidate == 1
    assert chain.steps[0][1].n == 2
    with pytest.raises(ValueError, match="refit"):
        search.grid_search(folded, chain, {"pca__n": [1]}, {"a": close, "b": close}, 2)
    assert set(search.params(prep.FeaturePrep())) == {"winsor_lower", "winsor_upper", "skip_power", "standardize"}


def test_distances_of_equal_points(spark):
    rows = [(i, "ab"[i % 2], [1e3 + (i // 4), 2e3 - (i // 4)]) for i in range(40)]
    points = spark.createDataFrame(rows, "sample_id long, batch string, coords array<double>")
    got = diagnostics.neighbour_shares(points, 3).orderBy("row").collect()
    assert all(sum(r.shares) == 3 and abs(r.shares[0] - r.shares[1]) == 1 and r.shares["ab".index(r.batch)] == 1 for r in got)


def test_harmonizer_variants(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 5)) * [1, 2, 3, 4, 5] + np.repeat([0, 3], 15)[:, None]
    rows = [(i, "ab"[i // 15], f"f{j}", float(x[i, j])) for i in range(30) for j in range(5)]
    long = spark.createDataFrame(rows, "sample_id long, batch string, feature string, value double")

    def plain(parametric, mean_only):
        """By the definition, on the whole matrix."""
        grand, out = x.mean(0), np.empty_like(x)
        at = [np.arange(15), np.arange(15, 30)]
        sd = np.sqrt(np.mean(np.concatenate([x[i] - x[i].mean(0) for i in at]) ** 2, axis=0))
        z = (x - grand) / sd
        for i in at:
            g, d = z[i].mean(0), np.ones(5) if mean_only else z[i].var(0, ddof=1)
            if not parametric:
                w = np.array([[0.0 if a == b else np.exp(np.sum(-0.5 * np.log(2 * np.pi * d[b]) - (z[i, a] - g[b]) ** 2 / (2 * d[b]))) for b in range(5)] for a in range(5)])
                w /= w.sum(1, keepdims=True)
                g, d = w @ g, w @ d
            elif mean_only:
                t2 = g.var(ddof=1)
                g = (t2 * g + g.mean()) / (t2 + 1)
            out[i] = (z[i] - g) / np.sqrt(d) * sd + grand
        return out

    for parametric, mean_only in ((True, True), (False, False)):
        got = prep.BatchHarmonizer(parametric=parametric, mean_only=mean_only).fit_transform(long).toPandas().pivot(index="sample_id", columns="feature", values="value").to_numpy()
        assert np.allclose(got, plain(parametric, mean_only), atol=1e-9), (parametric, mean_only)
