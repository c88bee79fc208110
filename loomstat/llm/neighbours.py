"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables has ``width``-wide cells along ``projections`` Gaussian directions;
a vector lies in one bucket per table. A query visits buckets - its own and perturbed ones - in the
order of the estimated probability that a near neighbour lies there: along a direction a neighbour
at cosine c of a query with projection p is normal with mean c p and variance 1 - c^2. It stops when
the estimate for the table reaches the share that all tables together need for ``recall``. There is
no cap on buckets. c is the query's own: its k-th best cosine in a sample of at most ``sample`` vectors, which
is never above its k-th best cosine in the whole table (all vectors are indexed), so a dense group elsewhere
ends no query early. Candidates of all visited buckets are reranked by their exact cosine.

Buckets are split by a hash of the ids where they hold more than ``tile`` vectors. Equal vectors are
indexed once, with their ``k + 1`` smallest ids, which is all that a list of k with ties to smaller ids needs.
Vectors that are null, empty, zero, or hold null or non-finite components take no part. Repeated ids
are one candidate each per row; a query does not find rows with its own id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import stacked, unit, usable

TABLES, PROJECTIONS, WIDTH = 6, 8, 2.5


def phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


class Hashes:
    def __init__(self, dim: int, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.a = rng.standard_normal((tables, dim, projections))
        self.b = rng.random((tables, projections)) * width
        self.width, self.tables = width, tables

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        """One long for the cells of each row."""
        out = np.zeros(cells.shape[:-1], np.int64)
        for i in range(cells.shape[-1]):
            out = out * 1000003 + cells[..., i]
        return out

    def index(self, x: np.ndarray, table: int) -> np.ndarray:
        return self.bucket(np.floor((x @ self.a[table] + self.b[table]) / self.width).astype(np.int64))

    def probes(self, q: np.ndarray, table: int, c: float, share: float) -> np.ndarray:
        """Buckets for one query in order of estimated success, until the estimates sum to ``share``."""
        p, s = q @ self.a[table], math.sqrt(max(1 - c * c, 1e-6))
        center = np.floor((c * p + self.b[table]) / self.width).astype(np.int64)
        reach = np.arange(-4, 5)
        cells = center[:, None] + reach  # projections x options
        low = cells * self.width - self.b[table][:, None]
        chance = phi((low + self.width - c * p[:, None]) / s) - phi((low - c * p[:, None]) / s)
        cost = -np.log(np.maximum(chance, 1e-300))
        most = 64
        while True:
            # The best `most` of a product of sorted lists come from the best `most` of each part.
            total, chosen = np.zeros(1), np.zeros((1, 0), np.int64)
            for i in range(len(cells)):
                all_ = total[:, None] + cost[i][None, :]
                take = np.argsort(all_, axis=None, kind="stable")[:most]
                r, o = np.divmod(take, len(reach))
                total, chosen = all_.ravel()[take], np.concatenate((chosen[r], cells[i][o][:, None]), axis=1)
            sums = np.cumsum(np.exp(-total))
            if sums[-1] >= share or len(total) < most:
                return self.bucket(chosen[: int(np.searchsorted(sums, share)) + 1])
            most *= 4


def similarity(queries: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each query, a cosine that at least k other vectors of the sample reach: a lower bound of its k-th best in the table."""
    if len(sample) <= k:
        return np.zeros(len(queries))
    g = queries @ sample.T
    g[g > 1 - 1e-9] = -1.0  # itself, or a multiple of it
    return np.clip(np.partition(g, len(sample) - k, axis=1)[:, len(sample) - k], 0.0, 0.95)


def nearest(df: DataFrame, queries: Column, k: int = 5, recall: float = 0.98, sample: int = 1000, tile: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding", **shape: float) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest found of each row that ``queries`` selects."""
    rows = df.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("asks"))
    first = F.slice(F.array_sort(F.collect_list("id")), 1, k + 1)
    # Copies: partial lists of the smallest ids per salt, then of those. No list is longer than a salt's share of the copies.
    kinds = rows.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    kinds = cut(kinds)
    again = kinds.where("copies > 1").select(F.col("vector").alias("v"), F.col("id").alias("rep"))
    ranked = rows.join(again, F.col("vector") == F.col("v")).select("rep", "id")
    salted = ranked.groupBy("rep", F.pmod(F.xxhash64("id"), F.lit(4096)).alias("salt")).agg(first.alias("ids"))
    more = salted.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    n = kinds.count()
    if not n:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    # About twice the sample comes below the bound, so that no task has to choose among more.
    low = F.lit(2**63 - 1 if n <= 2 * sample else 2 * sample * 2**63 // n)
    got = kinds.where(F.xxhash64("id").bitwiseAND(F.lit(2**63 - 1)) <= low).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    by_size: dict[int, list] = {}
    for x in got:
        by_size.setdefault(len(x), []).append(x.values.to_numpy(zero_copy_only=False))
    known = {d: unit(np.stack(v)) for d, v in by_size.items()}
    tables = int(shape.get("tables", TABLES))
    share = 1 - (1 - recall) ** (1 / tables)

    def place(batches: Iterator[pa.RecordBatch], asking: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x) for x in b.column(1)])
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                h, u = Hashes(int(d), **shape), unit(stacked(part.column(1)))
                aims = similarity(u, known.get(int(d), np.zeros((0, int(d)))), k) if asking else ()
                for t in range(tables):
                    if asking:
                        found = [h.probes(q, t, float(c), share) for q, c in zip(u, aims)]
                        owner = np.repeat(np.arange(len(u)), [len(x) for x in found])
                        bucket = np.concatenate(found) if found else np.zeros(0, np.int64)
                        taken = part.take(pa.array(owner))
                    else:
                        bucket, taken = h.index(u, t), part
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), t * 100000 + d, np.int64)), pa.array(bucket), *taken.columns], ["space", "bucket", "id", "vector"])

    schema = "space long, bucket long, id long, vector array<double>"
    data = kinds.select("id", "vector").mapInArrow(lambda it: place(it, False), schema)
    asks = rows.where("asks").select("id", "vector").mapInArrow(lambda it: place(it, True), schema)
    large = kinds.select("id", "vector").mapInArrow(lambda it: place(it, False), schema).groupBy("space", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    large = large.select("space", "bucket", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    data = data.join(large, ["space", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("asks", F.lit(False))
    asks = asks.join(large, ["space", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("asks", F.lit(True))
    columns = ["space", "bucket", "part", "asks", "id", "vector"]

    def scan(t: pa.Table) -> pa.Table:
        flags = t["asks"].to_numpy(zero_copy_only=False)
        ids, x = t["id"].to_numpy(), stacked(t["vector"].combine_chunks())
        q, qx, c, cx = ids[flags], x[flags], ids[~flags], x[~flags]
        out: tuple[list, list, list] = ([], [], [])
        qn, cn, cu = np.sqrt(np.einsum("ij,ij->i", qx, qx)), np.sqrt(np.einsum("ij,ij->i", cx, cx)), unit(cx) if len(cx) else cx
        for at in range(0, len(q) if len(c) else 0, 256):
            near = unit(qx[at : at + 256]) @ cu.T
            own = min(k + 1, len(c))
            floor = np.partition(near, len(c) - own, axis=1)[:, len(c) - own] - 1e-9
            i, j = np.nonzero(near >= floor[:, None])  # with all ties
            exact = np.einsum("ij,ij->i", qx[at + i], cx[j]) / (qn[at + i] * cn[j])
            for o, v in zip(out, (q[at + i], c[j], exact)):
                o.append(v)
        done = [np.concatenate(o) if o else np.zeros(0, kind) for o, kind in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table([pa.array(v) for v in done], ["query_id", "rep", "score"])

    found = data.select(*columns).unionAll(asks.select(*columns)).groupBy("space", "bucket", "part").applyInArrow(scan, "query_id long, rep long, score double")
    # A vector and its copies: the k + 1 smallest ids stand for all of them.
    found = found.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rep"))
    found = found.withColumn("r", top).where(F.col("r") <= k + 1)
    found = found.join(more, "rep", "left").select("query_id", F.explode(F.coalesce("ids", F.array("rep"))).alias("id"), "score").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
