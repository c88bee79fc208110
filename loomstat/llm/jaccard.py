"""Near duplicates by the Jaccard similarity of word shingles: SimHash fingerprints and MinHash bands propose, whole
shingle sets decide.

A text is the set of the XXH64 of its ``words``-word shingles. Texts with close SimHash fingerprints are candidates;
at a similarity of 0.8 few pairs are that close. ``BANDS`` keys of ``ROWS`` minima each put texts
into buckets; two texts of similarity s share one with probability 1 - (1 - s^ROWS)^BANDS, which is 0.99994 at
0.8 and more above it. First each member of a bucket meets the leader of the bucket, and what its fingerprint
proposes; then every pair of a bucket that is not yet in one component, so leaders save comparisons and lose no link.
Before whole sets are moved for a pair that meets in a bucket, four bits of each of its minima are compared: a pair of
similarity s differs in (1 - s) 15 / 16 of them on average, and the limit is one that a pair at the similarity asked for
exceeds with probability ``MISSED`` at most (62 of 192 at 0.8). In large buckets, that is done in tiles inside a task, and
the least hashes of both sets are compared there too.

Texts: null or without words -> the empty set, a group of its own. Texts with equal sets are collapsed first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, trimmed
from .shingles import bit_majority, each_hashes

BANDS, ROWS = 32, 6
#: Probability that a pair at the similarity is not compared for its minima.
MISSED = 3e-6
_RNG = np.random.default_rng(17)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Members of a bucket on each side of a tile (a bucket of up to a 32nd of it is joined); hashes of a set that go there.
TILE, SHORT = 2048, 512
#: Shingles taken against all factors at a time.
WIDE = 2048


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the text's hashes under each factor."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), WIDE):
        np.minimum(least, ((hashes[None, at : at + WIDE] * FACTORS[:, None]) ^ MASKS[:, None]).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """The text's ``BANDS`` bucket keys."""
    rows = least.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for i in range(ROWS):
        out = (out ^ rows[:, i]) * MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen to a word."""
    bits = least >> np.uint64(20) & np.uint64(15)
    return np.bitwise_or.reduce(bits.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64)


def apart(a: str, b: str) -> Column:
    """In how many minima two signatures differ."""
    words = []
    for i in range(BANDS * ROWS // 16):
        x = f"({a}[{i}] ^ {b}[{i}])"
        y = f"({x} | shiftrightunsigned({x}, 1))"
        words.append(f"bit_count(({y} | shiftrightunsigned({y}, 2)) & 1229782938247303441L)")
    return F.expr(" + ".join(words))


def most_apart(similarity: float) -> int:
    """Minima in which all but ``MISSED`` of the pairs at the similarity differ at most."""
    n, p = BANDS * ROWS, (1 - similarity) * 15 / 16
    left, k = 1.0, -1
    while left > MISSED:
        k += 1
        left -= math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return k


def lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(k) for k in rows]), pa.int32()), pa.array(flat, pa.int64()))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The high halves of the ``SHORT`` least hashes of sets."""
    for b in batches:
        short = [(np.frombuffer(x.as_buffer(), np.uint64)[:SHORT] >> np.uint64(32)).astype(np.uint32).tobytes() for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(short, pa.binary())], ["kind", "short"])


def likely(a: np.ndarray, whole_a: bool, b: np.ndarray, whole_b: bool, similarity: float) -> bool:
    """Whether sets of which these are the least may be similar: for whole ones but for collisions of half hashes, for
    others but for 4.7 standard errors of the share of common ones among the least of both."""
    if not (whole_a and whole_b):
        limit = min(x[-1] for x, whole in ((a, whole_a), (b, whole_b)) if not whole)
        a, b = a[: np.searchsorted(a, limit, "right")], b[: np.searchsorted(b, limit, "right")]
    shared = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - shared
    slack = 2 if whole_a and whole_b else 4.7 * math.sqrt(similarity * (1 - similarity) * union)
    return shared + slack >= similarity * union


def join_tile(t: pa.Table, similarity: float) -> pa.Table:
    """Pairs of a bucket's tile that may be similar: of ``home`` members with all others of other components, two that
    are both outside the bucket's largest component once."""
    home, minor, kinds, roots, sizes = (t[c].to_numpy(zero_copy_only=False) for c in ("home", "minor", "a", "root", "sa"))
    words = t["ga"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(kinds), -1)
    signs = (words[:, :, None] >> (np.arange(16, dtype=np.uint64) * np.uint64(4)) & np.uint64(15)).astype(np.uint8).reshape(len(kinds), -1)
    short = [np.frombuffer(x.as_buffer(), np.uint32) for x in t["short"].combine_chunks()]
    o, limit, out = np.flatnonzero(~home), most_apart(similarity), []
    for h in np.flatnonzero(home).tolist():
        near = o[(roots[o] != roots[h]) & (~minor[o] | (kinds[o] > kinds[h]))]
        near = near[np.minimum(sizes[near], sizes[h]) >= similarity * np.maximum(sizes[near], sizes[h]) - 1e-9]
        near = near[(signs[near] != signs[h]).sum(1) <= limit]
        out += [(kinds[h], kinds[i]) for i in near.tolist() if likely(short[h], sizes[h] <= SHORT, short[i], sizes[i] <= SHORT, similarity)]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def large_buckets(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` that may be similar, out of members ``(key, minor, root, a, sa, ga)`` of buckets. A bucket is cut into
    tiles of at most about ``TILE`` x ``TILE`` members, which are compared inside a task, so that pairs that share a bucket and
    no more are never rows."""
    short = sets.join(rows.select(F.col("a").alias("kind")).distinct(), "kind").select("kind", "set").mapInArrow(trimmed(shorten), "kind long, short binary")
    parts = rows.groupBy("key").agg(F.ceil(F.count_if("minor") / TILE).cast("int").alias("nh"), F.ceil(F.count("*") / TILE).cast("int").alias("no"))
    placed = rows.join(short, F.col("a") == F.col("kind")).join(parts, "key")
    part = lambda count, salt: F.pmod(F.xxhash64("a", F.lit(salt)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    homes = placed.where("minor").withColumn("home", F.lit(True)).withColumn("i", part("nh", 1)).withColumn("j", every("no"))
    others = placed.withColumn("home", F.lit(False)).withColumn("i", every("nh")).withColumn("j", part("no", 2))
    columns = ["key", "i", "j", "home", "minor", "root", "a", "sa", "ga", "short"]
    tiles = homes.select(*columns).unionAll(others.select(*columns)).groupBy("key", "i", "j")
    return tiles.applyInArrow(lambda t: join_tile(t, similarity), "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int, seed: int, similarity: float, close_pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(id, fp, component, group, hash)`` per row: component is the smallest id linked through texts of ``similarity``
    or more, null if the group has no id; group is a number of the group, hash the text's. ``close_pairs`` gives pairs ``(a, b)`` of close fingerprints out of ``(fp)``."""
    text = F.col(text_col).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, sizes, fps, keys, signs = [], [], [], [], []
            for h in each_hashes(b.column(2), words, seed):
                s = np.unique(h)
                kinds.append(int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                sizes.append(len(s))
                fps.append(bit_majority(h) if len(h) else 0)
                least = minima(s)
                keys.append(band_keys(least) if len(s) else np.zeros(0, np.int64))
                signs.append(signature(least))
            made = [pa.array(kinds, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists(keys), lists(signs)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["id", "hash", "kind", "size", "fp", "keys", "sign"])

    f = cut(rows.mapInArrow(trimmed(sketch), "id long, hash long, kind long, size long, fp long, keys array<long>, sign array<long>"))
    # Equal sets of shingles that repeat differently have fingerprints of their own; one of them stands for the set.
    own = cut(f.groupBy("kind").agg(F.min("id").alias("least"), F.min("hash").alias("hash"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sign").alias("sign")))
    placed = own.select("kind", "hash", "size", "sign", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    held = cut(placed.join(shared, "key"))

    # Of texts with one fingerprint the first stands for all against close fingerprints.
    first = own.where("size > 0").groupBy("fp").agg(F.min(F.struct("kind", "size", "hash")).alias("r"), F.count("*").alias("n")).select("fp", "n", "r.*")
    end = lambda at: first.select(F.col("fp").alias(at), F.col("kind").alias(f"{at}_kind"), F.col("size").alias(f"{at}_size"), F.col("hash").alias(f"{at}_hash"))
    close = close_pairs(first.select("fp")).join(end("a"), "a").join(end("b"), "b").select("a_kind", "a_size", "a_hash", "b_kind", "b_size", "b_hash")
    twins = own.where("size > 0").join(first.where("n > 1").select("fp", F.col("kind").alias("b"), F.col("size").alias("sb"), F.col("hash").alias("hb")), "fp").where("kind <> b").select("kind", "size", "hash", "b", "sb", "hb")
    near = cut(close.unionAll(twins).toDF("a", "sa", "ha", "b", "sb", "hb"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(h).tobytes() for h in each_hashes(b.column(1), words, seed)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["kind", "set"])

    # Copies of a text are one row before any join, so that no text is dealt out often.
    texts = rows.groupBy("hash").agg(F.first("text").alias("text"))
    asked = held.select("kind", "hash").unionAll(near.select("a", "ha")).unionAll(near.select("b", "hb")).distinct()
    sets = cut(texts.join(asked, "hash").select("kind", "text").mapInArrow(trimmed(whole), "kind long, set binary"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # Sizes alone rule out many pairs, and minima most of the others.
    fit = (F.least("sa", "sb") >= similarity * F.greatest("sa", "sb") - 1e-9) & (apart("ga", "gb") <= most_apart(similarity))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of ``(a, b)`` that are similar."""
        p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        p = p.join(sets.select(F.col("kind").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("kind").alias("b"), F.col("set").alias("y")), "b")
        return cut(p.select("a", "b", "x", "y").mapInArrow(trimmed(check), "a long, b long"))

    leader = F.min(F.struct(F.xxhash64("kind").alias("h"), "kind", "size", "sign")).alias("l")
    lead = held.groupBy("key").agg(leader).select(F.col("key").alias("lkey"), F.col("l.kind").alias("b"), F.col("l.size").alias("sb"), F.col("l.sign").alias("gb"))
    member = held.select("key", F.col("kind").alias("a"), F.col("size").alias("sa"), F.col("sign").alias("ga"))
    led = member.join(lead, (F.col("key") == F.col("lkey")) & (F.col("a") != F.col("b")) & fit).select("a", "b")
    labels = cut(components(verified(led.unionAll(near.select("a", "b")))).select(F.col("node").alias("kind"), F.col("root").alias("label")))
    at = held.join(labels, "kind", "left").select("key", "kind", "size", "sign", F.coalesce("label", "kind").alias("root"))
    # Only buckets of several components are left to compare: what is outside a bucket's largest one, with all others.
    spread = at.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = spread.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("m")).where("roots > 1").select("key", F.col("all").alias("n"), F.col("m.root").alias("main"))
    left = cut(at.join(most, "key").select("key", "n", (F.col("root") != F.col("main")).alias("minor"), "root", F.col("kind").alias("a"), F.col("size").alias("sa"), F.col("sign").alias("ga")))
    few = left.where(F.col("n") <= TILE // 32)
    minor = few.where("minor").select(F.col("key").alias("mkey"), F.col("root").alias("other"), F.col("a").alias("b"), F.col("sa").alias("sb"), F.col("ga").alias("gb"))
    met = few.join(minor, (F.col("key") == F.col("mkey")) & (F.col("root") != F.col("other")) & fit).select("a", "b")
    rest = verified(met.unionAll(large_buckets(left.where(F.col("n") > TILE // 32), sets, similarity)))
    # Components that these links join, by their labels.
    label = lambda at: labels.select(F.col("kind").alias(at), F.col("label").alias(f"{at}_label"))
    between = rest.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    joined = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    rooted = own.join(labels, "kind", "left").select("kind", "fp", "least", F.coalesce("label", "kind").alias("root"))
    rooted = cut(rooted.join(joined, "root", "left").select("kind", "least", F.coalesce("top", "root").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("kind", "component", "root")
    return f.select("id", "fp", "hash", "kind").join(named, "kind").select("id", "fp", "component", F.col("root").alias("group"), "hash")
