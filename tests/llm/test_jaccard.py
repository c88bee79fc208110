"""Near duplicates of the pipeline against brute-force similarity of five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from loomstat.llm import jaccard, simhash


def plain_kept(rows, words=5, similarity=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(b" ".join(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a == b or a and len(a & b) >= similarity * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted({root(i) for i in ids})


def near_copies():
    """Groups of copies at similarities from about 0.6 to 1, chains, a shared passage, and texts without words."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    passage = rng.choices(words, k=60)
    texts = [None, "", " \n", "one", "ONE", "two words"]
    for g in range(60):
        base = rng.choices(words, k=rng.randrange(60, 400)) + (passage if g % 3 == 0 else [])
        texts.append(" ".join(base))
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy
    return list(enumerate(texts))


def test_stage_equals_brute_force(spark, sf):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()) == plain_kept(rows)


def test_stage_over_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect())
    assert got == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_rows_that_repeat_an_id(spark, sf):
    """Only rows of one group stand in for each other, whatever their ids."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(7, a, "p"), (7, a, "p"), (7, b, "q"), (8, a + " more", "r"), (9, b, "s"), (3, c, "t"), (3, c + " end", "u"), (None, c, "v"), (None, c, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect())
    assert [i for i, _ in got] == [0, 0, 3, 7, 7] and {t for i, t in got if i == 7} == {a, b} and got[0][1] == got[1][1] == c
    assert corpus_pipeline.near_dedup_stage(spark, docs, sf).columns == docs.columns


def test_close_fingerprints_are_candidates(spark):
    """Groups by similarity are as brute force has them; fingerprints within 2 bits alone leave more groups."""
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = simhash.near_duplicates(docs, words=5, similarity=0.8).toPandas()
    assert sorted(linked.component.unique()) == plain_kept(rows) and linked.groupby("group").component.nunique().eq(1).all()
    close = simhash.near_duplicates(docs, words=5)
    assert close.select("component").distinct().count() > linked.component.nunique()


def test_signatures(spark):
    """Words of signatures differ where their minima do, and near copies stay within the limit."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    rows, want = [], []
    for kept in (1000, 950, 900, 700, 100, 0):
        other = np.concatenate((base[:kept], rng.integers(0, 1 << 63, 1000 - kept, dtype=np.uint64)))
        a, b = jaccard.minima(base), jaccard.minima(other)
        want.append(int(((a ^ b) >> np.uint64(20) & np.uint64(15) != 0).sum()))
        rows.append((len(rows), jaccard.signature(a).tolist(), jaccard.signature(b).tolist()))
    df = spark.createDataFrame(rows, "i int, ga array<long>, gb array<long>")
    assert [r.n for r in df.select("i", jaccard.apart("ga", "gb").alias("n")).orderBy("i").collect()] == want
    assert want[0] == 0 and max(want[:3]) <= jaccard.most_apart(0.8) == 62 < want[4]


@pytest.mark.parametrize("tile", [2048, 64])
def test_large_loose_group(spark, sf, tile, monkeypatch):
    """Many copies of one text, most pairs of which are below the similarity and share bands; with tiles of all sizes."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=150)
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.randrange(0, 14)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()) == plain_kept(rows)


def test_least_hashes_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(8)
    for n in (3, 146, 500, 4000):
        for kept in (0.9, 0.905, 0.95, 1.0):  # of n hashes: similarities of 0.82 and more
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)
            same = max(round(n * kept), n - n // 10)
            other = np.concatenate((base[:same], rng.integers(0, 1 << 63, n - same, dtype=np.uint64) << np.uint64(1)))
            a, b = ((np.sort(x)[: jaccard.SHORT] >> np.uint64(32)).astype(np.uint32) for x in (base, other))
            assert jaccard.likely(a, n <= jaccard.SHORT, b, n <= jaccard.SHORT, 0.8)
    a, b = (np.sort(rng.integers(0, 1 << 32, 200, dtype=np.uint32)) for _ in range(2))
    assert not jaccard.likely(a, True, b, True, 0.8) and not jaccard.likely(a, False, b, False, 0.8)
