"""Urls that hold the magic which begins records."""

from pyspark.sql import functions as F

from loomstat.llm import warc


def test_magic_in_urls(spark, tmp_path):
    urls = ["http://h/WARC/1.1/spec", "http://h/a", "WARC/1.", "http://h/WARC%2F1.x", "http://h/WARC%252F1.x", "http://h/WARC/1.0WARC/1.1", "http://h/b", None]
    rows = [(i, urls[i % len(urls)], f"<p>page {i}</p>" * 10) for i in range(120)]
    at = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), at)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = warc.read(spark, at)
        assert sorted(r.page_id for r in warc.pages(records).select("page_id").collect()) == [i for i, _, _ in rows]
        got = records.select(F.regexp_extract("head", "urn:page:([0-9]+)", 1).cast("long").alias("id"), warc.target().alias("url")).collect()
        assert {r.id: r.url for r in got} == {i: u for i, u, _ in rows}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
