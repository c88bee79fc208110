"""WARC round trips and main text."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomstat.llm import htmltext, queries, warc

PAGES = "page_id long, url string, html string"


def plain_warc(rows):
    first, out = {}, []
    for i, _, h in rows:
        raw = (h or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        if len(raw) >= 100:
            first[d] = min(i, first.get(d, i))
    for i, _, h in rows:
        raw = (h or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        to = first.get(d, i)
        out.append((i, len(raw), d, "response" if to == i else "revisit", None if to == i else to))
    return sorted(out)


def columns(df):
    return sorted(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def hard_pages():
    record = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n"
    html = [None, "", "x", "é" * 60, "a\r\n\r\nb", record, record * 3 + "end", "WARC/1.1\r\n\r\n", "\r\n\r\n", "\r\n\r\nWARC/1.", "x" * 99, "x" * 100, "x" * 99, "x" * 100, "y" * 30000 + record, "\x00\n\r"]
    return [(i, f"http://h/{i} \r\nX: y" if i % 3 else None, h) for i, h in enumerate(html)]


@pytest.mark.parametrize("bytes_per_split", ["128m", "700", "5000"])
def test_warc_round_trip(spark, tmp_path, bytes_per_split):
    rows = hard_pages() + [(i, "http://h/", f"<p>page {i % 40}</p>" * 20 + ["", "\r\n\r\n", "\r", "WARC/1."][i % 4]) for i in range(100, 180)]
    at = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, PAGES).withColumn("size", F.lit(3)).withColumn("digest", F.lit("clash")).repartition(3), at)
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_per_split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert columns(warc.pages(warc.read(spark, at))) == plain_warc(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_warc_files_have_whole_records(spark, tmp_path):
    rows = hard_pages()
    at = tmp_path / "w"
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), str(at))
    data = b"".join(p.read_bytes() for p in sorted(at.glob("part-*")))
    n = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        data, n = rest[size + 4 :], n + 1
    assert n == len(rows)


def test_warc_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.pages(warc.read(spark, str(tmp_path / "w"))).count() == 0
    warc.write(spark.createDataFrame([(None, None, "z" * 200), (None, None, "z" * 200), (5, "u", "z" * 200)], PAGES), str(tmp_path / "v"))
    got = [tuple(r) for r in warc.pages(warc.read(spark, str(tmp_path / "v"))).select("page_id", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted([(5, "response", None), (None, "revisit", 5), (None, "revisit", 5)], key=str)


CASES = [
    ("", ""),
    ("<p>One</p><p>Two &amp; &eacute;</p>", "One\nTwo & é"),
    ("<article><h1>T</h1><p>a  b\n c<br>d<p>e</article>", "T\na b c d\ne"),
    ("<nav><a href=x>m</a></nav><article><p>body</p></article><footer>f</footer>", "body"),
    ("<head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><article><p>x</p></article>", "x"),
    ("<div class='ad'>buy</div><main><p>x</p><aside>s</aside><p>y</p></main><div id=comments>c</div>", "x\ny"),
    ("<article><p>one</p><div class='comment-list'><p>no</p></div><form><input>f</form><p>two</p></article>", "one\ntwo"),
    ("<article><p><b>bold<p>next</article>", "bold\nnext"),
    ("<article><pre>a\n  b</pre><ul><li>i<li>j</ul></article>", "a b\ni\nj"),
    ("<article><p>Die Kopfzeile</p></article", "Die Kopfzeile"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_main_text(html, text):
    assert htmltext.main_text(html) == text


def test_ratio_finds_unmarked_content():
    menu = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(12))
    body = "".join(f"<p>{'Sentence of the story goes on and on. ' * 6}{i}</p>" for i in range(8))
    got = htmltext.main_text(f"<html><body><div><ul>{menu}</ul></div><div>{body}</div><div><ul>{menu}</ul></div></body></html>")
    assert got.count("\n") == 7 and "Link" not in got and got.endswith("7")


def test_pages_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op5_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.n_chars == len(r.text)
        assert not any(x in r.text for x in ("<p>", "<br", "</", "track(", "&copy;", "&amp;"))


def test_extract_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None, "clash", 4), (2, "u", "<p>x" + "y" * 300000, "clash", 5), (2, "u", "<p>" * 3000 + "deep", "k", 6)], "page_id long, url string, html string, text string, `a.b` int")
    got = htmltext.extract(df).collect()
    assert [len(r.text) for r in got] == [0, 300001, 4] and got[0]["a.b"] == 4
    assert htmltext.extract(df.where("false")).count() == 0
