"""How far batches separate in a space of few components: PERMANOVA, silhouette, kBET, LISI.

Input: points (sample_id, batch, coords array<double>). Observed statistics of PERMANOVA are sums. Distances
between all samples are the statistic's own definition of silhouette and LISI, so these take time quadratic in
samples, but neither memory nor exchanged rows: points are packed into blocks by order of sample_id and kept in
the shared checkpoint folder; a task holds one block and reads the blocks of all one after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions.tails import gammaincc
from loomstat.operators.layout import cut

#: Samples aimed at in a block (least, most; twice as many at the very most), rows of a block compared at once with another, pairs whose differences are taken at once.
FEWEST, BLOCK, STRIP, PAIRS = 128, 4096, 128, 1 << 16
#: Of squared distances below this share of the squared norms too little is left in ``x x + y y - 2 x y``.
NEAR = 1e-6


class Blocks:
    """Points packed by order of sample_id: ``df(part, seq, n, codes binary, x binary)``, float64 rows and int32 positions in ``names``."""

    def __init__(self, points: DataFrame):
        rows = points.where("batch is not null").select("sample_id", F.col("batch").cast("string").alias("batch"), F.col("coords").cast("array<double>").alias("coords"))
        sizes = {r["batch"]: r["count"] for r in rows.groupBy("batch").count().collect()}
        self.spark, self.names, self.n = points.sparkSession, sorted(sizes), sum(sizes.values())
        self.counts = np.array([sizes[b] for b in self.names], dtype=np.int64)
        aim = min(BLOCK, max(FEWEST, self.n // (4 * self.spark.sparkContext.defaultParallelism)))
        names = pa.array(self.names, pa.string())

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, seq, held = TaskContext.get().partitionId(), 0, []

            def block(k: int) -> pa.RecordBatch:
                t = pa.Table.from_batches(held).combine_chunks()
                own, left = t.slice(0, k), t.slice(k)
                held[:] = left.to_batches()
                coords = own["coords"].combine_chunks()
                if coords.null_count or len(pc.unique(pc.list_value_length(coords))) > 1:
                    raise ValueError("points without coordinates or of different dimensions")
                x = coords.flatten().to_numpy(zero_copy_only=False).astype(float)
                codes = pc.index_in(own["batch"], value_set=names).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int32)
                return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n": k, "codes": codes.tobytes(), "x": x.tobytes()}], schema)

            for b in batches:
                held.append(b)
                while sum(map(len, held)) >= 2 * aim:
                    yield block(2 * aim)
                    seq += 1
            if k := sum(map(len, held)):
                yield block(k)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int32()), ("codes", pa.binary()), ("x", pa.binary())])
        sorted_rows = rows.repartitionByRange(max(1, -(-self.n // aim)), "sample_id").sortWithinPartitions("sample_id")
        self.df = cut(sorted_rows.mapInArrow(pack, "part int, seq int, n int, codes binary, x binary"))
        meta = sorted((r.part, r.seq, r.n) for r in self.df.select("part", "seq", "n").collect())  # a row per block
        self.starts = dict(zip([m[:2] for m in meta], np.cumsum([0, *(m[2] for m in meta)])[:-1].tolist()))

    def labels(self) -> np.ndarray:
        """Positions in ``names`` of all points, in the least bytes that hold them."""
        kind, starts = np.min_scalar_type(max(len(self.names) - 1, 0)), self.starts
        out = np.empty(self.n, kind)
        for first, codes in self.df.select("part", "seq", "codes").rdd.map(lambda r: (starts[r.part, r.seq], np.frombuffer(r.codes, np.int32).astype(kind))).toLocalIterator():
            out[first : first + len(codes)] = codes
        return out


def _opened(starts: dict, row: Any, dims: int | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of the first point, codes and the first ``dims`` coordinates of a block."""
    x = np.frombuffer(row.x).reshape(row.n, -1)
    return starts[row.part, row.seq], np.frombuffer(row.codes, np.int32), x if dims is None else np.ascontiguousarray(x[:, :dims])


def blocks_of(points: DataFrame | Blocks) -> Blocks:
    return points if isinstance(points, Blocks) else Blocks(points)


def _against_all(blocks: Blocks, own: RDD | None, begin: Callable[..., Any], schema: str, dims: int | None = None) -> DataFrame:
    """Rows of ``begin(element).rows()`` after ``add(first row, codes, x)`` of every block, for each element of ``own``
    (default: each block, given like to ``add``). Elements begin with what tells them apart; all blocks pass by each in any order."""
    starts, given = blocks.starts, own is not None

    def run(pairs: Iterator[tuple[Any, Any]]) -> Iterator[tuple]:
        states: dict = {}
        last, right = None, None
        for left, row in pairs:
            key = left[0] if given else (left.part, left.seq)
            if key not in states:
                states[key] = begin(*left) if given else begin(*_opened(starts, left, dims))
            if last is not row:
                last, right = row, _opened(starts, row, dims)
            states[key].add(*right)
        for state in states.values():
            yield from state.rows()

    stream = blocks.df.coalesce(1).rdd  # read on from block to block by each task, never gathered
    return blocks.spark.createDataFrame((blocks.df.rdd if own is None else own).cartesian(stream).mapPartitions(run), schema, verifySchema=False)


def _extended(x: np.ndarray, left: bool) -> np.ndarray:
    """Rows whose products are squared distances."""
    square, one = (x * x).sum(1)[:, None], np.ones((len(x), 1))
    return np.concatenate([-2 * x, square, one] if left else [x, one, square], axis=1)


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of pairs as they are defined: squares of differences summed from the first coordinate to the last."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        to = slice(at, at + PAIRS)
        d = x[i[to]] - y[j[to]]
        d *= d
        out[to] = np.sqrt(np.cumsum(d, axis=1, out=d)[:, -1])
    return out


def permanova(points: DataFrame, permutations: int = 999, seed: int = 42, blocks: Blocks | None = None) -> DataFrame:
    """One row: permanova_f, permanova_r2, permanova_p of Euclidean distances.

    For Euclidean distances the sums of squares are those around means, so a permutation costs one pass over
    the points and no distances. Permutations are dealt to tasks by number and seeded by it; all labels are sent, points pass by in blocks."""
    rows = points.where("batch is not null").select("batch", F.posexplode("coords").alias("dim", "x"))
    per = rows.groupBy("batch", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("*")).alias("ss"))
    got = per.toPandas()  # batches x components
    sizes = got[got.dim == 0].set_index("batch").n if len(got) else pd.Series(dtype=float)
    n, k = float(sizes.sum()), len(sizes)
    within = float(got.ss.sum())
    grand = got.groupby("dim").apply(lambda g: (g.n * g.m).sum() / g.n.sum(), include_groups=False) if len(got) else pd.Series(dtype=float)
    between = float((got.n * (got.m - got.dim.map(grand)) ** 2).sum()) if len(got) else 0.0
    spark = points.sparkSession
    schema = "permanova_f double, permanova_r2 double, permanova_p double"
    if k < 2 or n <= k or between + within <= 0:
        return spark.createDataFrame([(None, None, None)], schema)
    if within <= 0:
        return spark.createDataFrame([(float("inf"), 1.0, None)], schema)
    f = (between / (k - 1)) / (within / (n - k))
    total = between + within
    if not permutations:
        return spark.createDataFrame([(f, between / total, 1.0)], schema)
    blocks = blocks or Blocks(points)
    shared = spark.sparkContext.broadcast(blocks.labels())
    middle, counts = grand.sort_index().to_numpy(float), blocks.counts
    least = (f - 1e-12 * f) * (k - 1) / (n - k)

    class Permuted:
        def __init__(self, _: int, numbers: list[int]):
            self.own = [np.random.default_rng([seed, i]).permutation(shared.value) for i in numbers]
            self.sums = np.zeros((len(numbers), len(middle), k))

        def add(self, first: int, codes: np.ndarray, x: np.ndarray) -> None:
            columns = np.ascontiguousarray((x - middle).T)
            for sums, own in zip(self.sums, self.own):
                at = own[first : first + len(x)].astype(np.intp)
                for d, c in enumerate(columns):
                    sums[d] += np.bincount(at, weights=c, minlength=k)

        def rows(self) -> list[tuple]:
            ssb = (self.sums**2 / counts).sum((1, 2))
            return [(int((ssb / np.maximum(total - ssb, 1e-300) >= least).sum()),)]

    each = max(1, min(-(-permutations // 64), (16 << 20) // shared.value.nbytes))  # labels of so many permutations at once in a task
    own = spark.sparkContext.parallelize([(at, list(range(at, min(at + each, permutations)))) for at in range(0, permutations, each)], -(-permutations // each))
    hits = _against_all(blocks, own, Permuted, "hits long").agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("h"))
    return hits.select(F.lit(f).alias("permanova_f"), F.lit(between / total).alias("permanova_r2"), ((F.col("h") + 1) / F.lit(float(permutations + 1))).alias("permanova_p"))


class _Means:
    """Sums of distances from the points of a block to those of each batch."""

    def __init__(self, counts: np.ndarray, first: int, codes: np.ndarray, x: np.ndarray):
        self.counts, self.first, self.codes, self.x = counts, first, codes, x
        self.left, self.square = _extended(x, True), (x * x).sum(1)
        self.sums = np.zeros((len(x), len(counts)))

    def add(self, first: int, codes: np.ndarray, x: np.ndarray) -> None:
        right, square = _extended(x, False).T, (x * x).sum(1)
        member = np.zeros((len(x), len(self.counts)))
        member[np.arange(len(x)), codes] = 1
        for at in range(0, len(self.x), STRIP):
            d = self.left[at : at + STRIP] @ right
            own = self.square[at : at + STRIP]
            some = np.flatnonzero(d.min(1) <= NEAR * (own + square.max()))
            i, j = np.divmod(np.flatnonzero(d[some] <= NEAR * (own[some][:, None] + square)), len(x))  # of near ones nothing is left in the difference
            i = some[i]
            d[i, j] = 0
            np.sqrt(d, out=d)
            d[i, j] = _exact(self.x[at : at + STRIP], x, i, j)
            self.sums[at : at + STRIP] += d @ member

    def rows(self) -> Iterator[tuple]:
        own, i, counts = self.codes, np.arange(len(self.x)), self.counts
        inside = self.sums[i, own] / np.maximum(counts[own] - 1, 1)
        means = self.sums / counts
        means[i, own] = np.inf
        other = means.min(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            s = np.where((counts[own] > 1) & np.isfinite(other), (other - inside) / np.maximum(np.maximum(inside, other), 1e-300), 0.0)
        return zip((self.first + i).tolist(), s.tolist())


def silhouettes(points: DataFrame | Blocks, dims: int | None = None) -> DataFrame:
    """(row, silhouette) per point; 0 in a batch of one. ``dims``: only so many coordinates count."""
    blocks = blocks_of(points)
    counts = blocks.counts
    return _against_all(blocks, None, lambda *own: _Means(counts, *own), "row long, silhouette double", dims)


def silhouette(points: DataFrame | Blocks, dims: int | None = None) -> DataFrame:
    return silhouettes(points, dims).agg(F.avg("silhouette").alias("silhouette"))


class _Nearest:
    """The ``k`` nearest others of a block's points among the blocks so far: ``d``, then ``row``, ascending in each row.

    Products of whole blocks only pick pairs within a margin for rounding; distances that decide are taken from differences."""

    def __init__(self, names: list[str], k: int, rows: np.ndarray, codes: np.ndarray, x: np.ndarray):
        self.names, self.k, self.own, self.codes, self.x = names, k, rows, codes, x
        self.left, self.square = _extended(x, True), (x * x).sum(1)
        self.d, self.row, self.code = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max), np.full((len(x), k), -1)

    def add(self, first: int, codes: np.ndarray, x: np.ndarray) -> None:
        right, most, k = _extended(x, False), (x * x).sum(1).max(), self.k
        rounding = 8 * (x.shape[1] + 8) * (self.square + most)
        left, eps = self.left, np.finfo(float).eps
        # Single precision, where its margin is small beside the neighbourhoods and nothing in it over- or underflows.
        if 1e-20 < self.square.max() + most < 1e30 and (rounding * (single := np.finfo(np.float32).eps) <= 0.02 * self.d[:, -1] ** 2).mean() > 0.9 and np.isfinite(self.d).all():
            left, right, eps = self.left.astype(np.float32), right.astype(np.float32), single
        right = right.T
        for at in range(0, len(self.x), STRIP):
            d = left[at : at + STRIP] @ right
            margin = rounding[at : at + STRIP] * eps
            last = self.d[at : at + STRIP, -1]
            limit = last * last * (1 + 1e-12) + margin
            if len(x) > k + 1 and np.isinf(last).any():  # the point itself may be among them, so one more
                limit = np.minimum(limit, np.partition(d, k, axis=1)[:, k] + 2 * margin)
            some = np.flatnonzero(d.min(1) <= limit)
            i, j = np.divmod(np.flatnonzero(d[some] <= limit[some][:, None]), len(x))
            i = some[i]
            other = self.own[at + i] != first + j
            i, j = i[other], j[other]
            exact = _exact(self.x[at : at + STRIP], x, i, j)
            better = (exact < last[i]) | ((exact == last[i]) & (first + j < self.row[at + i, -1]))
            if better.any():
                self._merge(at + i[better], exact[better], first + j[better], codes[j[better]])

    def _merge(self, i: np.ndarray, d: np.ndarray, row: np.ndarray, code: np.ndarray) -> None:
        at = np.unique(i)
        i = np.concatenate([np.repeat(at, self.k), i])
        d, row, code = np.concatenate([self.d[at].ravel(), d]), np.concatenate([self.row[at].ravel(), row]), np.concatenate([self.code[at].ravel(), code])
        order = np.lexsort((row, d, i))
        begins = np.searchsorted(i[order], at)
        order = order[begins[:, None] + np.arange(self.k)]
        self.d[at], self.row[at], self.code[at] = d[order], row[order], code[order]

    def rows(self) -> Iterator[tuple]:
        n, b = len(self.x), len(self.names)
        i, j = np.nonzero(self.code >= 0)
        counts = np.bincount(i * b + self.code[i, j], minlength=n * b).reshape(n, b)
        return zip(self.own.tolist(), [self.names[c] for c in self.codes], counts.tolist())


def neighbour_shares(points: DataFrame | Blocks, k: int, dims: int | None = None) -> DataFrame:
    """(row, batch, shares): for each point, the batch counts among its ``k`` nearest others; ties to the earlier sample."""
    blocks = blocks_of(points)
    names, most = blocks.names, max(1, min(k, blocks.n - 1))
    return _against_all(blocks, None, lambda first, codes, x: _Nearest(names, most, first + np.arange(len(x)), codes, x), "row long, batch string, shares array<long>", dims)


def lisi(points: DataFrame | Blocks, k: int = 30, dims: int | None = None) -> DataFrame:
    """Median over points of the inverse Simpson index of batches among ``k`` neighbours."""
    total = F.aggregate("shares", F.lit(0).cast("long"), lambda a, b: a + b)
    squares = F.aggregate("shares", F.lit(0.0), lambda a, b: a + b * b)
    return neighbour_shares(points, k, dims).select(F.try_divide(total * total, squares).alias("v")).agg(F.median("v").alias("lisi_batch"))


def kbet(points: DataFrame | Blocks, k: int | None = None, alpha: float = 0.05, n_test: int = 500, seed: int = 42, dims: int | None = None) -> DataFrame:
    """Share of at most ``n_test`` drawn points whose neighbourhood differs from the batch sizes by a chi-squared test.

    Only the drawn points look for neighbours, a few to a task, each among all points."""
    blocks = blocks_of(points)
    n, names, starts = blocks.n, blocks.names, blocks.starts
    if len(names) < 2 or n < 3:
        return blocks.spark.createDataFrame([(None,)], "kbet_rejection_rate double")
    k = min(k or min(50, max(10, round(0.1 * n))), n - 1)
    share = [int(c) / n for c in blocks.counts]
    drawn = np.sort(np.random.default_rng(seed).choice(n, size=min(n_test, n), replace=False))

    def pick(row: Any) -> list[tuple]:
        first, codes, x = _opened(starts, row, dims)
        at = drawn[(drawn >= first) & (drawn < first + len(x))] - first
        return [(first + at, codes[at], x[at])] if len(at) else []

    rows, codes, x = (np.concatenate(c) for c in zip(*blocks.df.rdd.flatMap(pick).collect()))  # n_test points at most
    groups = np.array_split(np.arange(len(rows)), min(len(rows), 32))
    own = blocks.spark.sparkContext.parallelize([(at, rows[g], codes[g], x[g]) for at, g in enumerate(groups)], len(groups))
    near = _against_all(blocks, own, lambda _, *of: _Nearest(names, k, *of), "row long, batch string, shares array<long>", dims)
    chi = sum((F.col("shares")[i] - k * p) * (F.col("shares")[i] - k * p) / (k * p) for i, p in enumerate(share))
    limit = _chi2_limit(alpha, len(names) - 1)
    return near.select(F.avg((chi > limit).cast("double")).alias("kbet_rejection_rate"))


def _chi2_limit(alpha: float, df: int) -> float:
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if float(gammaincc(np.array([df / 2]), np.array([mid / 2]))[0]) > alpha else (low, mid)
    return high


def global_diagnostics(arrays: DataFrame, label: str, components: int = 20, permutations: int = 999) -> DataFrame:
    """One row for a matrix (sample_id, batch, features array): its components and all statistics above."""
    from loomstat.operators.groups import anova
    from loomstat.operators.reduce import PCA

    spark: SparkSession = arrays.sparkSession
    size = arrays.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("p"), F.countDistinct("batch").alias("b")).first()
    head = [F.lit(label).alias("matrix"), F.lit(size.n).alias("n_samples"), F.lit(size.p).alias("n_features"), F.lit(size.b).alias("n_batches")]
    m = min(components, (size.n or 0) - 1, size.p or 0)
    names = "pc_components_used int, pc1_variance double, pc2_variance double, pc1_anova_p double, pc2_anova_p double, permanova_f double, permanova_r2 double, permanova_p double, silhouette_pc double, kbet_rejection_rate double, lisi_batch double"
    if size.n < 3 or (size.p or 0) < 2:
        return spark.createDataFrame([(None,) * 11], names).select(*head, "*")
    pca = PCA(m).fit(arrays)
    points = pca.transform(arrays).withColumnRenamed("components", "coords")
    long = points.select("batch", F.posexplode("coords").alias("dim", "value")).where("dim < 2").withColumn("feature", F.col("dim").cast("string"))
    ps = {r.feature: r.anova_p for r in anova(long).collect()}
    first = lambda df: df.first()[0] if size.b > 1 else None
    blocks = Blocks(points)  # packed once for all that follows
    per = permanova(points, permutations, blocks=blocks).first()
    ratio = pca.explained_ratio_.tolist()
    row = (m, ratio[0], ratio[1] if m > 1 else None, ps.get("0"), ps.get("1"), *per, first(silhouette(blocks, 10)), first(kbet(blocks, dims=10)), first(lisi(blocks, dims=10)))
    return spark.createDataFrame([row], names).select(*head, "*")
