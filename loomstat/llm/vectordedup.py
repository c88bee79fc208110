"""Near-duplicate embeddings by a subspace pigeonhole join.

Cosine >= t between unit vectors means a squared distance of 2 - 2 t at most. A rotation (a
Hadamard matrix with random signs) spreads it evenly over ``BLOCKS`` low-dimensional blocks; at
least one block of a pair holds no more than its share of that budget. In each block the vectors
are range-joined: the signs of the first coordinates give a cell, and a vector also visits every
cell of a greater number that comes nearer to it than the block's budget. A pair that meets in a block
is a candidate there if its distance in the block is within the budget and in no earlier block is;
so every pair is counted once without gathering pairs. Candidates are verified by the exact cosine
of the original vectors in double precision.

Coordinates are rounded to integers before the rotation, whose sums are then exact, so that every
task decides alike; the budget is widened by what the rounding can change. Cells that hold more
than ``TILE`` vectors are cut into tiles. A tile returns, per vector, its links and one link that
keeps the tile's connected parts together, never pairs. Equal vectors are joined once.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id,
link with nothing; vectors of different lengths never link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut
from .vectors import distinct, stacked, unit, usable

BLOCKS, TILE, SCALE = 8, 4096, float(1 << 16)
#: Candidate pairs verified at a time.
PAIRS = 1 << 16


class Rotation:
    """Unit vectors as integers, rotated; sums of squares stay below 2^53."""

    def __init__(self, dim: int, threshold: float, seed: int = 5):
        size = max(8, 1 << (dim - 1).bit_length())
        h = np.ones((1, 1))
        while len(h) < size:
            h = np.block([[h, h], [h, -h]])
        self.matrix = (np.random.default_rng([seed, dim]).integers(0, 2, size) * 2 - 1)[:, None][:dim] * h[:dim]
        blocks = min(BLOCKS, size)
        self.blocks = [slice(i * size // blocks, (i + 1) * size // blocks) for i in range(blocks)]
        distance = np.sqrt(max(2 - 2 * threshold, 0)) * SCALE + np.sqrt(dim) + 2  # each vector is off by sqrt(dim) / 2 at most
        self.budget = distance * distance * size / blocks

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.rint(unit(x) * SCALE) @ self.matrix


def near_cells(y: np.ndarray, bits: int, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether at home) for the cells that rows of block coordinates live in or visit."""
    bits = min(bits, y.shape[1])
    weights = 1 << np.arange(bits)
    home = (y[:, :bits] >= 0) @ weights
    rows, flips, cost = np.arange(len(y)), np.zeros(len(y), np.int64), np.zeros(len(y))
    for i in range(bits):  # flip bit i too, where the boundaries crossed are near enough
        more = cost + y[rows, i] ** 2
        ok = more <= budget
        rows, flips, cost = np.concatenate((rows, rows[ok])), np.concatenate((flips, flips[ok] | 1 << i)), np.concatenate((cost, more[ok]))
    cells = home[rows] ^ flips
    take = cells >= home[rows]
    return rows[take], cells[take], flips[take] == 0


def join_tile(k: int, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, home: np.ndarray, visit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a tile: (id, number of rows linked, smallest id of the tile's connected part). ``home``
    rows are compared with all others; of two that live in the cell, the smaller id is on the home side."""
    r = Rotation(x.shape[1], threshold)
    y = r(x)
    h, o = np.flatnonzero(home), np.flatnonzero(~home)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    block = r.blocks[k]
    square = np.einsum("ij,ij->i", y[:, block], y[:, block])
    names, at = np.unique(ids, return_inverse=True)
    links, parent = np.zeros(len(names), np.int64), np.arange(len(names))
    for s in range(0, len(h), 256):
        rows = h[s : s + 256]
        distance = square[rows][:, None] + square[o][None, :] - 2 * (y[rows][:, block] @ y[o][:, block].T)
        i, j = np.nonzero((distance <= r.budget) & (visit[o][None, :] | (ids[rows][:, None] < ids[o][None, :])))
        for p in range(0, len(i), PAIRS):
            a, b = rows[i[p : p + PAIRS]], o[j[p : p + PAIRS]]
            for earlier in r.blocks[:k]:
                d = y[a, earlier] - y[b, earlier]
                keep = np.einsum("ij,ij->i", d, d) > r.budget
                a, b = a[keep], b[keep]
            linked = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= threshold
            a, b = at[a[linked]], at[b[linked]]
            links += np.bincount(a, weights=copies_of(names, ids, copies)[b], minlength=len(names)).astype(np.int64)
            links += np.bincount(b, weights=copies_of(names, ids, copies)[a], minlength=len(names)).astype(np.int64)
            while True:  # hook the greater root under the smaller until the ends of all links agree
                ra, rb = parent[a], parent[b]
                apart = ra != rb
                if not apart.any():
                    break
                np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
                while (parent != parent[parent]).any():
                    parent = parent[parent]
    some = links > 0
    return names[some], links[some], names[parent[some]]


def copies_of(names: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    out = np.zeros(len(names))
    out[np.searchsorted(names, ids)] = copies
    return out


def links(reps: DataFrame, threshold: float, n: int) -> DataFrame:
    """``(id, n, other)`` from all tiles for vectors ``reps(vector, rep, copies)``."""
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / (TILE // 2))), 1, 8))

    def place(batches: Iterator[pa.RecordBatch], values: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x) for x in b.column(0)])
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                rotation = Rotation(int(d), threshold)
                y = rotation(stacked(part.column(0)))
                for k, block in enumerate(rotation.blocks):
                    rows, cells, home = near_cells(y[:, block], bits, rotation.budget)
                    out = [pa.array(np.full(len(rows), d * BLOCKS + k)), pa.array(cells), pa.array(~home)]
                    taken = part.take(pa.array(rows)) if values else None
                    yield pa.RecordBatch.from_arrays(out + (taken.columns if values else []), ["space", "cell", "visit"] + (["vector", "rep", "copies"] if values else []))

    key = "space long, cell long, visit boolean"
    sizes = reps.mapInArrow(lambda it: place(it, False), key).groupBy("space", "cell").agg(F.count("*").alias("all"), F.count_if(~F.col("visit")).alias("homes"))
    parts = cut(sizes.where("homes > 0").select("space", "cell", F.ceil(F.col("homes") / TILE).cast("int").alias("nh"), F.ceil(F.col("all") / TILE).cast("int").alias("no")))
    placed = reps.mapInArrow(lambda it: place(it, True), f"{key}, vector array<double>, rep long, copies long").join(parts, ["space", "cell"])
    # Every row is on the other side of all tiles with its part; rows at home are on the home side too.
    part = lambda count, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    homes = placed.where("not visit").withColumn("home", F.lit(True)).withColumn("i", part("nh", 1)).withColumn("j", every("no"))
    others = placed.withColumn("home", F.lit(False)).withColumn("i", every("nh")).withColumn("j", part("no", 2))
    columns = ["space", "cell", "i", "j", "home", "visit", "vector", "rep", "copies"]

    def run(t: pa.Table) -> pa.Table:
        flags = [t[c].to_numpy(zero_copy_only=False) for c in ("home", "visit")]
        k = t["space"][0].as_py() % BLOCKS
        out = join_tile(k, t["rep"].to_numpy(), t["copies"].to_numpy(), stacked(t["vector"].combine_chunks()), *flags, threshold)
        return pa.table([pa.array(v) for v in out], ["id", "n", "other"])

    return homes.select(*columns).unionAll(others.select(*columns)).groupBy("space", "cell", "i", "j").applyInArrow(run, "id long, n long, other long")


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``df``."""
    reps = cut(distinct(df, id_col, vector_col))
    found = cut(links(reps, threshold, reps.count()))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    labels = components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = reps.select("rep", "copies").join(labels, F.col("rep") == F.col("node"), "left").select("rep", "copies", F.coalesce("root", "rep").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    done = named.join(least, "root").join(counts, F.col("rep") == F.col("id"), "left").select("rep", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    done = cut(reps.select("vector", F.col("rep").alias("of")).join(done, F.col("of") == F.col("rep")).select("vector", "component_id", "n_links"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(usable(vector_col) & F.col(id_col).isNotNull(), F.col(vector_col).cast("array<double>")).alias("own"))
    linked = rows.where("own is not null").join(done, F.col("own") == F.col("vector")).select("id", "n_links", "component_id")
    alone = rows.where("own is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
