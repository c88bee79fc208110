"""The library's own operators against plain NumPy definitions and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat import catalogue
from loomstat.functions import ranking, scalars, tails
from loomstat.operators import agreement, association, catalogs, diagnostics, groups, ingest, models, network, prep, reduce, selectors
from loomstat.plans import report
from loomstat.sources import tables
from loomstat.streaming import apply


def long_of(spark, x, batch=None, names=None):
    rows = [(i, batch[i] if batch is not None else None, names[j] if names else f"f{j}", None if x[i, j] != x[i, j] else float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "sample_id long, batch string, feature string, value double")


def test_tails():
    assert tails.f_tail(np.array([3.0]), np.array([2.0]), np.array([10.0]))[0] == pytest.approx((1 + 2 * 3 / 10) ** -5, rel=1e-12)
    assert tails.gammaincc(np.array([1.0]), np.array([2.5]))[0] == pytest.approx(math.exp(-2.5), rel=1e-12)
    assert tails.gammaincc(np.array([0.5]), np.array([8.0]))[0] == pytest.approx(math.erfc(math.sqrt(8)), rel=1e-9)
    assert tails.t_tails(np.array([2.0]), np.array([1.0]))[0] == pytest.approx(1 - 2 / math.pi * math.atan(2), rel=1e-9)
    assert tails.t_quantile(0.975, 1e6) == pytest.approx(1.959966, abs=1e-4)


def test_group_tests(spark):
    x = np.array([[1.0], [2], [3], [4], [5], [6]])
    long = long_of(spark, x, list("aaabbb"))
    a, k = groups.anova(long).first(), groups.kruskal(long).first()
    assert a.anova_f == pytest.approx(13.5) and a.eta_squared == pytest.approx(13.5 / 17.5)
    assert k.kruskal_h == pytest.approx(27 / 7) and k.epsilon_squared == pytest.approx((27 / 7 - 1) / 4)
    assert groups.levene(long).first().levene_stat == pytest.approx(0)
    one = groups.anova(long_of(spark, x, list("aaaaaa"))).first()
    assert one.anova_f is None and one.anova_p is None
    flat = groups.anova(long_of(spark, np.array([[1.0], [1], [2], [2]]), list("aabb"))).first()
    assert flat.anova_f == math.inf and flat.anova_p == 0


def test_fdr_with_ties_and_gaps(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, None), (4, 0.5), (5, 0.02)], "id int, p_value double")
    got = {r.id: r.p_fdr for r in ranking.with_fdr(df).collect()}
    assert got[3] is None and got[1] == pytest.approx(0.02666667) and got[2] == got[5] == pytest.approx(0.02666667) and got[4] == 0.5


def test_icc(spark):
    y = np.array([[9, 8, 9], [7, 7, 6], [5, 4, 5], [3, 3, 2]], float)
    rows = [("x", i, f"o{j}", float(y[i, j])) for i in range(4) for j in range(3)] + [("same", i, f"o{j}", float(i)) for i in range(4) for j in range(3)] + [("flat", i, f"o{j}", 5.0) for i in range(4) for j in range(3)]
    long = spark.createDataFrame(rows, "feature string, subject long, observer string, value double")
    got = {r.feature: r for r in agreement.icc(long).collect()}
    assert got["x"].icc_2_1 == pytest.approx(agreement.icc_matrix(y[None])[0]) and got["x"].primary_icc_pass
    assert got["same"].icc_2_1 == pytest.approx(1) and got["same"].p_value == 0
    assert got["flat"].icc_2_1 is None and not got["flat"].primary_icc_pass
    ci = {r.feature: r for r in agreement.bootstrap_interval(long, 100).collect()}
    assert ci["x"].ci95_low <= got["x"].icc_2_1 <= ci["x"].ci95_high and ci["flat"].ci95_low is None
    out = agreement.reproducibility(long, iterations=20)
    assert out["icc"].count() == 3 and out["pearson"].columns == ["feature", "mean", "median", "sd", "q25", "q75", "min", "max"]


def test_ingest(spark):
    df = spark.createDataFrame([(" 001\t",), ("a  b",), ("",), ("nan",), ("NONE",), ("AbC",)], "id string")
    clean, changes = ingest.normalize_id_column(df, "id")
    assert [r.id for r in clean.collect()] == ["001", "a b", None, None, None, "AbC"] and changes.count() == 5
    dup = spark.createDataFrame([(1, 1, None), (1, 2, 5), (None, 3, 1), (None, 4, 2)], "k int, row_id int, v int")
    assert sorted(r.row_id for r in ingest.resolve_duplicates(dup, ["k"], "most_complete")[0].collect()) == [2, 3]
    assert sorted(r.row_id for r in ingest.resolve_duplicates(dup, ["k"], "min", "v")[0].collect()) == [2, 3]
    with pytest.raises(ValueError, match="repeated"):
        ingest.resolve_duplicates(dup, ["k"])
    left, right = spark.createDataFrame([("1",), ("2",), (None,)], "a string"), spark.createDataFrame([("1", 5), (None, 6), ("9", 7)], "b string, v int")
    m = ingest.merge_tables(left, right, ["a"], ["b"])
    assert m.n_matched == 2 and [r.b for r in m.right_only.collect()] == ["9"] and m.merged.where("v = 6").count() == 1
    with pytest.raises(ValueError, match="unique"):
        ingest.merge_tables(left.unionAll(left), right, ["a"], ["b"], validate="1:1")


def test_selectors_and_catalog(spark):
    names = ["id", "fbn__mean", "fbn__volume", "fbs__volume"]
    assert selectors.resolve(names, selectors.Selectors(features=("vol*",), configs=("fbn",))).chosen == ["fbn__volume"]
    assert selectors.resolve(names, selectors.Selectors(configs=("fb?",))).chosen == names[1:]
    with pytest.raises(ValueError, match="without a match"):
        selectors.resolve(names, selectors.Selectors(features=("nothing",)))
    assert selectors.split_name("R1_fbn__a__b", ("R1_",)) == ("fbn", "a__b") and selectors.split_name("__x") is None
    cat = catalogs.FeatureCatalog(spark.createDataFrame([("fbn", "mean", "A"), ("fbs", "volume", "B")], "config string, feature_key string, family string"))
    assert cat.families() == ["A", "B"] and "fbn__mean" in cat and cat.validate(["q"], True) == ["q"]
    wide = spark.createDataFrame([("p", 1.0, 2.0, 3.0)], names if False else "id string, fbn__mean double, fbn__volume double, fbs__volume double")
    data = catalogs.Dataset(wide, catalog=cat)
    assert data.feature_columns == ["fbn__mean", "fbs__volume"] and data.metadata_columns == ["id", "fbn__volume"]


def test_clinical_codes(spark):
    rows = [(0, "n", "1"), (1, "n", " 2.5 "), (2, "n", "x"), (0, "b", "yes"), (1, "b", "FEMALE"), (2, "b", "maybe"), (0, "o", "mild"), (1, "o", "severe"), (2, "o", "Mild "), (3, "n", "1d")]
    df = spark.createDataFrame(rows, "sample_id int, variable string, value string")
    got = {(r.variable, r.sample_id): r.value for r in association.encode_clinical(df).collect()}
    assert got[("n", 1)] == 2.5 and got[("n", 2)] is None and got[("n", 3)] is None and got[("b", 1)] == 0 and got[("b", 2)] is None and got[("o", 2)] == 1 and got[("o", 1)] == 2


def test_prep_and_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.lognormal(size=80), np.full(80, 10.0), np.full(80, np.nan)])
    long = long_of(spark, x).drop("batch")
    fitted = prep.FeaturePrep().fit(long)
    got = fitted.transform(long).groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()
    got = {r.feature: r for r in got}
    assert got["f0"].m == pytest.approx(0, abs=1e-9) and got["f0"].s == pytest.approx(1) and got["f1"].m == 0 and got["f2"].m is None
    long.write.parquet(str(tmp_path / "in"))
    apply.write_transformed(apply.read_long(spark, str(tmp_path / "in"), "sample_id long, feature string, value double"), fitted, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    a = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("value")).first()[0]
    assert a == pytest.approx(fitted.transform(long).agg(F.sum("value")).first()[0])


def test_combat_takes_shifts_out(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    batch = ["ab"[i % 2] for i in range(60)]
    x[1::2] = x[1::2] * 2 + 3
    out = prep.BatchHarmonizer().fit_transform(long_of(spark, x, batch))
    gap = {r.batch: r.m for r in out.groupBy("batch").agg(F.avg("value").alias("m")).collect()}
    assert abs(gap["a"] - gap["b"]) < 0.2
    ref = prep.BatchHarmonizer("a").fit_transform(long_of(spark, x, batch)).where("batch = 'a' and feature = 'f0'").orderBy("sample_id").toPandas()
    assert np.allclose(ref.value, x[0::2, 0])
    unseen = prep.BatchHarmonizer(on_unseen="error").fit(long_of(spark, x, batch))
    with pytest.raises(ValueError, match="unseen"):
        unseen.transform(long_of(spark, x, ["z"] * 60))


def array_frame(spark, x):
    return spark.createDataFrame([(i, "b", row.tolist()) for i, row in enumerate(x)], "sample_id long, batch string, features array<double>")


def test_reducers(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 3)) @ rng.standard_normal((3, 6)) + 5
    df = array_frame(spark, x)
    pca = reduce.PCA(3).fit(df)
    back = pca.inverse_transform(pca.transform(df).drop("features")).orderBy("sample_id").toPandas()
    assert np.allclose(np.stack(back.features.tolist()), x) and pca.explained_ratio_.sum() == pytest.approx(1)
    assert reduce.PCA(0.5).fit(df).n_components_ <= 3
    for kind in (reduce.MDS(2), reduce.TSNE(2, max_iter=60), reduce.Spectral(2), reduce.Isomap(2), reduce.LLE(2)):
        assert kind.fit_transform(df).where(F.size("components") == 2).count() == 40
    assert reduce.Isomap(2).fit(df).transform(df).count() == 40
    with pytest.raises(NotImplementedError):
        reduce.MDS(2).fit(df).transform(df)
    with pytest.raises(ImportError):
        reduce.UMAP(2).fit(df)


def test_modules_are_found(spark):
    rng = np.random.default_rng(42)
    base = rng.standard_normal((60, 3))
    x = np.column_stack([base[:, [g]] + 0.3 * rng.standard_normal((60, 12)) for g in range(3)])
    m = network.CoexpressionModules(min_module_size=5, soft_power=4).fit(array_frame(spark, x))
    own = [m.labels_[12 * g : 12 * g + 12] for g in range(3)]
    assert all(len(set(o)) == 1 for o in own) and len({o[0] for o in own}) == 3
    assert sorted(network.leaves(m.linkage_)) == list(range(36))


def test_models(spark):
    rng = np.random.default_rng(0)
    n = 150
    x = rng.standard_normal((n, 2))
    y = 2 * x[:, 0] + rng.standard_normal(n)
    long = long_of(spark, np.column_stack([x, np.ones(n)]))
    meta = spark.createDataFrame([(i, float(y[i]), float(y[i] > 0), float(rng.exponential() * math.exp(-x[i, 0])), 1.0, f"g{i % 15}") for i in range(n)], "sample_id long, y double, b double, t double, e double, g string")
    cont = {r.feature: r for r in models.associations(long, meta, outcome=["y"]).collect()}
    assert cont["f0"].status == "ok" and cont["f0"].p_value < 1e-10 and cont["f2"].status == "constant_feature"
    native = {r.feature: r for r in models.ols_hc3(long.join(meta, "sample_id")).collect()}
    assert cont["f0"].coef == pytest.approx(native["f0"].coef) and cont["f0"].se == pytest.approx(native["f0"].se) and cont["f0"].p_value == pytest.approx(native["f0"].p_value, rel=1e-6)
    for kind, outcome, extra in (("binary", ["b"], {}), ("survival", ["t", "e"], {}), ("survival", ["t", "e"], {"group": "g"}), ("binary", ["b"], {"group": "g"}), ("binary", ["b"], {"group": "g", "mixed_method": "gee"}), ("continuous", ["y"], {"group": "g"})):
        got = {r.feature: r for r in models.associations(long, meta, kind, outcome, **extra).collect()}
        assert got["f0"].status == "ok" and got["f0"].coef > 0.5 and got["f0"].p_value < 0.01 < got["f1"].p_value, (kind, extra, got["f0"])


def test_diagnostics(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 2))
    x[30:] += 4
    pts = spark.createDataFrame([(i, "ab"[i // 30], x[i].tolist()) for i in range(60)], "sample_id long, batch string, coords array<double>")
    p = diagnostics.permanova(pts, 99).first()
    assert p.permanova_f > 50 and p.permanova_p == pytest.approx(0.01)
    assert diagnostics.silhouette(pts).first()[0] > 0.6 and diagnostics.lisi(pts, 10).first()[0] < 1.2 and diagnostics.kbet(pts).first()[0] > 0.9


def test_batch_effects_whole(spark, sf):
    long = catalogue.features(spark, sf).where("dim < 3").select("sample_id", "batch", "feature", "value").cache()
    out = report.batch_effects(long, permutations=9, components=2, strategy="median")
    assert {"dataset_summary", "batch_counts", "feature_qc", "feature_stats", "global_diagnostics", "feature_summary", "combat_feature_stats"} <= set(out)
    assert out["global_diagnostics"].count() == 2 and out["feature_stats"].count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b", 1e-9, None), (2, "c", 2.5, True)], "i int, s string, x double, b boolean")
    import zipfile

    with zipfile.ZipFile(tables.write_workbook({"one": df, "_hidden": df}, str(tmp_path / "r.xlsx"))) as z:
        assert "xl/worksheets/sheet1.xml" in z.namelist() and "xl/worksheets/sheet2.xml" not in z.namelist()
    tables.write_csv(df.drop("b"), str(tmp_path / "c"), True)
    assert tables.read_csv(spark, str(tmp_path / "c")).count() == 2
    assert tables.sidecar_catalog(spark, str(tmp_path / "t.csv")) is None


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, "glcm"), (0.05, "shape"), (None, None)], "x double, f string")
    got = df.select(scalars.histogram_bin("x").alias("b"), scalars.family_name("f").alias("n"), scalars.threshold_category("x", [0.01, 0.5]).alias("t"), scalars.discretization_label("x").alias("d")).collect()
    assert [tuple(r) for r in got] == [(19, "GLCM", 2, "1"), (1, "Shape", 1, "0.05"), (None, None, None, "None")]


def test_some_queries_run(spark, sf):
    for name in ("wide_to_long", "catalog_annotate", "batch_anova", "repro_icc", "hub_features", "group_enrichment", "histogram", "tier_matrix"):
        assert catalogue.QUERIES[name](spark, sf).count() > 0, name
