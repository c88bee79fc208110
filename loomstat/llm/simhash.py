"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. Two fingerprints at 2 or fewer differing bits
agree in at least one whole segment (pigeonhole), and every other segment pair differs in at
most 2 bits. Each segment, read as a 23-bit word, is decoded to the indices of all codewords of
the perfect binary Golay code within distance 4: one index, or six when the word lies at distance
3 from the code. Any two words within distance 2 share an index, so joining on (segment, its exact
bits, an index of the next segment) finds every close pair; the pairs are verified on all bits.

Texts: null or without words -> fingerprint 0, linked like any other. Equal fingerprints are
collapsed before the join, so exact copies cost nothing. Where a similarity of the texts themselves
is asked for, close fingerprints are candidates, and ``jaccard`` adds others and decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import components, cut
from .shingles import bit_majority, each_hashes

#: Bits of each segment of a fingerprint, lowest first: offset and width.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the [23, 12, 7] code.
GENERATOR = 0b101011100011


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``(id, fp long)`` for every row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bit_majority(h) if len(h) else 0 for h in each_hashes(b.column(1), words, seed)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the three low bytes of a word; for each syndrome, the error patterns of weight
    4 or less, padded with the first; and which of them are not padding."""

    def remainder(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - 11)
        return v

    syndromes = np.array([[remainder((b << (8 * i)) & 0x7FFFFF) for b in range(256)] for i in range(3)], np.int64)
    one = [remainder(1 << i) for i in range(23)]
    by: list[list[int]] = [[] for _ in range(2048)]
    by[0].append(0)
    for i in range(23):
        by[one[i]].append(1 << i)
        for j in range(i):
            by[one[i] ^ one[j]].append(1 << i | 1 << j)
            for k in range(j):
                by[one[i] ^ one[j] ^ one[k]].append(1 << i | 1 << j | 1 << k)
                for m in range(k):
                    by[one[i] ^ one[j] ^ one[k] ^ one[m]].append(1 << i | 1 << j | 1 << k | 1 << m)
    most = max(map(len, by))
    patterns = np.array([x + x[:1] * (most - len(x)) for x in by], np.int64)
    return syndromes, patterns, np.arange(most)[None, :] < np.array([len(x) for x in by])[:, None]


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (the 12 high bits of a systematic codeword) near each 23-bit word, and a mask."""
    s, patterns, real = golay()
    syndrome = s[0][words & 255] ^ s[1][words >> 8 & 255] ^ s[2][words >> 16]
    return (words[:, None] ^ patterns[syndrome]) >> 11, real[syndrome]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of unsigned fingerprints, and the position of the fingerprint that each belongs to."""
    segments = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    keys, owners = [], []
    for i, exact in enumerate(segments):
        index, real = golay_indices(segments[(i + 1) % 3])
        keys.append(((i << 34 | exact << 12)[:, None] | index)[real])
        owners.append(np.nonzero(real)[0])
    return np.concatenate(keys), np.concatenate(owners)


def close_pairs(fps: DataFrame, bucket: int = 64) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` within 2 bits of each other.

    Keys held by up to ``bucket`` fingerprints are self-joined. A key held by more gives its
    fingerprints to an exact way without pairs: two words within 2 bits have a word within 1 bit
    of both, so each is listed under the 65 words around it; a list has 65 members at most, and
    its members are linked to the smallest of those that verify.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, owners = fuzzy_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[owners])], ["key", "fp"])

    keys = fps.mapInArrow(run, "key long, fp long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = cut(keys.join(shared, "key"))
    few = held.where(F.col("n") <= bucket)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    found = a.join(b, (a.key == b.key) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    many = held.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = many.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("word"), "fp")
    lists = around.groupBy("word").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return found.unionAll(lists.select("a", F.explode("all").alias("b")).where("a <> b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, similarity: float | None = None) -> DataFrame:
    """``(id, fp, component)`` per row: component is the smallest id linked through fingerprints
    at 2 or fewer differing bits. Rows with a null id keep their fingerprint and take the component
    of their group (null if the group has no id).

    With a ``similarity``, what links is that Jaccard similarity or more of the texts' shingle sets, and
    fingerprints only propose: few pairs at 0.8 have fingerprints within 2 bits, so MinHash bands propose too.
    Then there are also a number of each ``group`` (ids that repeat may be in several) and the text's xxhash64, ``hash``.
    """
    if similarity is not None:
        return jaccard.near_duplicates(df, id_col, text_col, words, seed, similarity, close_pairs)
    f = cut(fingerprints(df, id_col, text_col, words, seed))
    own = cut(f.groupBy("fp").agg(F.min("id").alias("least")))
    labels = components(close_pairs(own.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = cut(own.join(labels, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return f.join(named, "fp").select("id", "fp", "component")
