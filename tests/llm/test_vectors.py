"""Nearest neighbours and embedding near-dedup against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.llm import neighbours, queries, vectordedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def clean(rows):
    out = []
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v):
            out.append((i, np.array(v, np.float64)))
    return out


def brute_nearest(rows, k=5):
    rows = clean(rows)
    out = {}
    for i, v in rows:
        if i % 50:
            continue
        near = [(-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in rows if j != i and len(w) == len(v)]
        out[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return out


def brute_dedup(rows, t=0.95):
    good, out = clean(rows), {}
    parent = {i: i for i, _ in good}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = {i: 0 for i, _ in rows}
    for a in range(len(good)):
        for b in range(a):
            (i, v), (j, w) = good[a], good[b]
            if len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= t:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    for i, _ in rows:
        c = root(i) if i in parent else i
        out[i] = (links[i], c, c == i)
    return out


def planted(n=600, dim=24, seed=3):
    """Clusters of near copies at all similarities around the threshold, exact copies, and odd rows."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 6, dim))
    rows = []
    for b in base:
        for _ in range(5):
            rows.append((b + rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.3])).astype(np.float32).tolist())
        rows.append(rows[-1])
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [1.0] * (dim - 1) + [float("inf")], [None] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0]]
    return list(enumerate(rows + odd))


def test_nearest_finds_nine_tenths(spark):
    rows = planted()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    want = brute_nearest(rows)
    assert set(got.query_id) == {q for q, w in want.items() if w}
    hits = total = 0
    exact = dict(clean(rows))
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, len(part) + 1))
        order = list(zip(-part.score, part.id))
        assert order == sorted(order)
        for j, s in zip(part.id, part.score):
            v, w = exact[q], exact[j]
            assert s == pytest.approx(v @ w / (np.linalg.norm(v) * np.linalg.norm(w)), abs=1e-12)
        hits += len({j for j, _ in want[q]} & set(part.id))
        total += len(want[q])
    assert hits >= 0.9 * total


def test_nearest_over_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op1_nearest(spark, sf).toPandas()
    want = brute_nearest(rows)
    assert got.groupby("query_id").size().eq(5).all() and len(got) == 5 * len(want)
    pairs = set(zip(got.query_id, got.vec_id))
    assert sum((q, j) in pairs for q, w in want.items() for j, _ in w) >= 0.9 * len(got)


def test_copies_ties_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0], 1) for i in range(60)] + [(60, [0.0, 1.0], 1)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).toPandas()
    assert got[got.query_id == 0].sort_values("rank").id.tolist() == [1, 2, 3, 4, 5]
    assert got[got.query_id == 50].sort_values("rank").id.tolist() == [0, 1, 2, 3, 4]
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (7, [1.0, 0.1], 1)], SCHEMA)
    assert neighbours.nearest(few, F.col("vec_id") % 50 == 0).select("query_id", "rank", "id").collect() == [(0, 1, 7)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(df, F.col("vec_id") % 50 == 0).count() == 0
    assert vectordedup.near_duplicates(df).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 2.0], 1), (4, None, None)], SCHEMA)
    assert neighbours.nearest(odd, F.col("vec_id") % 50 == 0).count() == 0
    got = vectordedup.near_duplicates(odd).toPandas()
    assert len(got) == 2 and got.n_links.eq(0).all() and got.kept.all()


@pytest.mark.parametrize("tile", [4096, 40])
def test_dedup_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vectordedup, "TILE", tile)
    rows = planted()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in vectordedup.near_duplicates(df).collect()}
    assert got == brute_dedup(rows)


def test_dedup_over_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op4_embedding_dedup(spark, sf).collect()}
    assert got == brute_dedup(rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame(pd.DataFrame({"vec_id": [0, 1], "embedding": [[1.0, 0.0], [1.0, 0.01]], "id": [9, 9], "rank": ["a", "b"], "vector": [1, 2], "rep": [1, 2], "n_links": [5, 5]}))
    assert neighbours.nearest(df, F.col("vec_id") % 50 == 0).select("query_id", "id").collect() == [(0, 1)]
    assert {tuple(r)[:3] for r in vectordedup.near_duplicates(df).collect()} == {(0, 1, 0), (1, 1, 0)}
