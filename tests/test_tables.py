"""Workbooks, splits into files, and tables of results."""

import re
import zipfile

import pytest

from loomstat.operators.selectors import Selectors
from loomstat.plans import report
from loomstat.sources import tables

RESULT = "model string, feature string, status string, p_value double, p_fdr double, coef double, effect double, statistic double, ci_low double, ci_high double"


def results(spark):
    rows = [("a", f"f{i}", "ok", p, min(1.0, p * 3), float(i), 2.0**i, 1.0, 0.0, 1.0) for i, p in enumerate((1e-6, 0.02, 0.9))]
    return spark.createDataFrame([*rows, ("b", "f0", "fit_failed", None, None, None, None, None, None, None), ("b", "f1", "ok", 0.04, 0.04, 5.0, 1.0, 1.0, 0.0, 1.0)], RESULT)


def test_workbook_formats(spark, tmp_path):
    path = report.association_workbook(results(spark), str(tmp_path / "a.xlsx"), per_panel=1)
    with zipfile.ZipFile(path) as z:
        styles, first, second = (z.read(f"xl/{n}.xml").decode() for n in ("styles", "worksheets/sheet1", "worksheets/sheet2"))
        names = re.findall('sheet name="([^"]*)"', z.read("xl/workbook.xml").decode())
    codes = re.findall('numFmtId="([0-9]+)" formatCode="([^"]*)"', styles)
    assert names == ["associations", "top_hits"] and {c for _, c in codes} == {"0.00E+00", "0.0000", "0.000"}
    order = re.findall('<xf numFmtId="([0-9]+)"', styles)
    style = lambda ref: dict(codes)[order[int(re.search(f'r="{ref}" s="([0-9]+)"', first)[1]) - 2]]
    assert style("D2") == "0.00E+00" and style("D3") == "0.0000" and style("F2") == "0.000"
    assert first.count("<row ") == 6 and second.count("<row ") == 3 and 'width="' in first and "frozen" in first


def test_number_formats():
    assert [tables.BATCH_EFFECTS(c, v) for c, v in (("anova_p", 1e-5), ("anova_q", 0.5), ("eta_squared", 0.5), ("n_valid", 3))] == ["0.00E+00", "0.0000", "0.000", "0.00"]
    assert [tables.REPRODUCIBILITY(c, v) for c, v in (("p_fdr", 0.5), ("ms_error", 4.0), ("icc_2_1", 0.9))] == ["0.0000", "0.00", "0.000"]


def test_top_hits_and_tier_values(spark):
    df = results(spark)
    keys = lambda rows: [(r.model, r.feature) for r in rows.collect()]
    assert keys(report.top_hits(df)) == [("a", "f0"), ("b", "f1")]
    assert keys(report.top_hits(df, "nominal")) == [("a", "f0"), ("a", "f1"), ("b", "f1")]
    assert sorted(keys(report.top_hits(df, "ranked", per_panel=2))) == [("a", "f0"), ("a", "f1"), ("b", "f1")]
    assert {r.feature: r.value for r in report.tier_values(df, "log2_effect").collect()} == {"f0": 0, "f1": 1, "f2": 2}
    with pytest.raises(ValueError, match="tier"):
        report.tier_values(df, tier="z")
    with pytest.raises(ValueError, match="mode"):
        report.top_hits(df, "best")


def test_split_to_files(spark, tmp_path):
    spark.createDataFrame([("p1", 1.0, 2.0, 3.0)], "id string, a__mean double, a__volume double, b__mean double").coalesce(1).write.option("header", True).csv(str(tmp_path / "in" / "t"))
    catalog = spark.createDataFrame([("a", "mean", "firstorder"), ("a", "volume", "shape"), ("b", "mean", "firstorder")], "config string, feature_key string, family string")
    out = tables.split_to_files(spark, str(tmp_path / "in" / "t"), str(tmp_path / "out"), Selectors(families=("Shape",), features=("nothing*",), allow_missing=True), catalog)
    row = tables.read_csv(spark, out["manifest"]).first()
    assert tuple(row.asDict()) == tables.MANIFEST
    assert (row.families, row.removed_columns, row.metadata_columns, row.unmatched_selectors) == ("Shape", "a__volume", "id", "feature:nothing*") and (row.n_kept_columns, row.n_removed_columns) == (3, 1)
    assert tables.read_csv(spark, out["removed"]).columns == ["id", "a__volume"] and tables.read_csv(spark, out["kept_catalog"]).count() == 2
