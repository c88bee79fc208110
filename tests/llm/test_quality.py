"""Quality scores: accuracy on the held-out part, and odd tables; the pipeline against its parts."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomstat.llm import queries, quality, sentencepiece, tokencount
from test_jaccard import plain_kept


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op6_quality(spark, d).toPandas()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.9
    assert (held.predicted == held.quality).mean() > 0.85


def test_votes_are_exact_neighbours():
    rng = np.random.default_rng(1)
    words = [b"alpha beta gamma ", b"XX!! 99 ## zz ", b"the cat sat on ", b"$$$ buy now "]
    texts = [b"".join(words[j] for j in rng.integers(0, 4, 30)) for _ in range(60)]
    counts = np.stack([quality.terms(t) for t in texts])
    labels = (np.arange(60) % 3 == 0).astype(np.float32)
    space = quality.fit_space(counts, labels)
    got = quality.vote(counts, space, k=5)
    x = quality.weighted(counts, space.idf) @ space.axes
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(60):
        c = space.voters @ x[i]
        near = np.argsort(-c)
        w = np.maximum(c[near[:5]], 0) ** 8
        if c[near[4]] - c[near[5]] > 1e-5:
            assert abs(got[i] - (w * labels[near[:5]]).sum() / w.sum()) < 1e-4


def test_fit_holds_the_sample_once(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet").crossJoin(spark.range(3)).withColumn("doc_id", F.col("doc_id") * 3 + F.col("id")) for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").where("quality in (0, 1)").orderBy("doc_id").select("text", "quality").collect()
    counts = np.stack([quality.terms((r.text or "").encode()) for r in rows]).astype(np.float16).astype(np.float32)
    some = counts.any(1)
    assert some.sum() > 1000 and (counts < 60000).all() and all(sum(r.quality == q for r in rows) <= 1500 for q in (0, 1))  # all of them are sampled
    tracemalloc.start()
    got = quality.fit(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = quality.fit_space(counts[some], np.array([r.quality for r in rows], np.float32)[some])
    for name in ("idf", "axes", "voters", "labels"):
        assert np.array_equal(getattr(got, name), getattr(want, name)), name
    # the counts, 256 texts' weights on the way (three arrays) and the search's matrices; copies of all counts don't fit
    assert peak < counts[some].nbytes + 4 * 256 * quality.TERMS * 4 + (8 << 20)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "good text here", "x"), (2, "BAD!!! 999", "y"), (3, None, "z"), (4, "", "z"), (None, "w " * 100000, "z"), (1, "good text here", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, None), (8, 1), (1, 1), (2, 5)], "doc_id long, quality int")
    space = quality.fit(docs, labels)
    got = quality.score(docs, space).toPandas()
    assert got.columns.tolist() == ["doc_id", "text", "score"] and got.score.between(0, 1).all()
    assert quality.score(docs.where("false"), space).count() == 0
    none = quality.fit(docs, labels.where("false"))
    assert quality.score(docs, none).toPandas().score.eq(0.5).all()


def test_labels_and_ids_are_no_inputs(spark):
    docs = spark.createDataFrame([(1, "good text here"), (2, "BAD!!! 999 ###"), (5, "good words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    space = quality.fit(docs, labels)
    a = [r.score for r in quality.score(docs, space).orderBy("text").collect()]
    b = [r.score for r in quality.score(docs.withColumn("doc_id", F.col("doc_id") * 7), space).orderBy("text").collect()]
    assert a == b


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, kept = docs, [docs.toPandas()]
    assert len(corpus_pipeline.STAGES) == 4
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        assert name == "sentencepiece" or at.columns == docs.columns
        kept.append(at.toPandas())
    start, good, single, mixed, done = kept
    assert set(good.doc_id) < set(start.doc_id) and set(single.doc_id) <= set(good.doc_id) and set(mixed.doc_id) <= set(single.doc_id)
    assert sorted(single.doc_id) == plain_kept(list(zip(good.doc_id, good.text)))
    assert len(done) == len(mixed) and set(done.columns) == {*docs.columns, "ids"}
    model = sentencepiece.surface(tokencount.public("piece_bpe_32k.model"))
    assert all(model.decode(list(i)) == t for i, t in zip(done.ids, done.text))
    run = corpus_pipeline.run(spark, sf).toPandas()
    assert sorted(run.doc_id) == sorted(done.doc_id)


def test_pipeline_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids int, copies string"
    rows = [(i, None if i == 3 else f"Some ordinary words of a page number {i // 2}.", None, None if i % 2 else "s", None, i, "c") for i in range(40)] + [(None, "no id", "en", "s", 5, 0, "c"), (7, "same id", "en", "s", 5, 0, "c")]
    for at in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, sf)
            at.count()
        assert "ids" in at.columns
