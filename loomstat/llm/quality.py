"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its pairs of neighbouring bytes and the shapes of its words (lower case,
capitals, signs, digits, words that repeat the one before or one before that), hashed into ``TERMS`` columns
and weighted by 1 + log of the count and the inverse document frequency. A truncated singular value decomposition of a bounded
sample of labelled texts gives the space; the sample's vectors are the voters. Their number is the
documented bound ``sample``, whatever the corpus's size, so they are broadcast; every document is
compared with all voters, block by block, by exact cosines, and the ``k`` nearest vote with their
similarity, raised to ``power``, as weight.

Null and empty texts have no terms; such a document gets the share of good labels in the sample, as does
every document if no labelled text is left to learn from (0.5 if there is no label at all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import derived, release

#: Columns of the term space: hashed byte pairs, then word shapes.
PAIRS, SHAPES = 4096, 16
TERMS = PAIRS + SHAPES
#: Weight of a word shape against a byte pair, of which there are many more.
EMPHASIS = 6
BUCKET = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
#: Kinds of bytes: 0 space, 1 lower case and beyond ASCII, 2 capital, 3 digit, 4 common stop, 5 other sign.
KIND = np.full(256, 5, np.int64)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[97:123] = KIND[128:] = 1
KIND[65:91], KIND[48:58], KIND[[33, 44, 46, 63, 39, 45]] = 2, 3, 4


@dataclass
class Space:
    """What the documents are compared with: idf, the space's axes, voters and their labels."""

    idf: np.ndarray
    axes: np.ndarray
    voters: np.ndarray
    labels: np.ndarray
    prior: float


def terms(text: bytes) -> np.ndarray:
    """Counts of a text's terms."""
    out = np.zeros(TERMS, np.float32)
    raw = np.frombuffer(text, np.uint8)
    if len(raw) > 1:
        counts = np.zeros(65536, np.int64)
        for at in range(0, len(raw) - 1, 1 << 20):
            part = raw[at : at + (1 << 20) + 1].astype(np.int64)
            counts += np.bincount(part[:-1] << 8 | part[1:], minlength=65536)
        out[:PAIRS] = np.bincount(BUCKET, weights=counts, minlength=PAIRS)
    words = text.split()
    if words:
        kinds = np.bincount(KIND[raw], minlength=6)
        again = len(words) - len(set(words))
        share = np.array([*kinds[1:] / kinds[1:].sum(), again / len(words), sum(map(eq, words, words[1:])) / len(words), text.count(b"\n") / len(words)])
        # Shares act as counts relative to the text's length, so they weigh alike in short and long texts.
        out[PAIRS : PAIRS + len(share)] = share * 64
    return out


def weighted(counts: np.ndarray, idf: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Weights of the counts, in ``out`` if given, which may be the counts themselves."""
    out = np.empty(counts.shape, np.result_type(counts, idf)) if out is None else out
    for at in range(0, len(counts), 256):
        x = np.log1p(counts[at : at + 256]) * idf
        x[:, PAIRS:] *= EMPHASIS
        np.divide(x, np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), out=out[at : at + 256])
    return out


def packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """The columns in which a text's counts are not 0, and those counts."""
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes(), counts[at].astype(np.float16).tobytes()


def unpacked(at: pa.ChunkedArray, counts: pa.ChunkedArray) -> np.ndarray:
    """The counts of texts, as ``packed`` gives them."""
    out = np.zeros((len(at), TERMS), np.float32)
    for row, a, c in zip(out, at, counts):
        row[np.frombuffer(a.as_buffer(), np.uint16)] = np.minimum(np.frombuffer(c.as_buffer(), np.float16).astype(np.float32), 60000)
    return out


def fit_space(counts: np.ndarray, labels: np.ndarray, rank: int = 48, seed: int = 7, reuse: bool = False) -> Space:
    """Truncated singular value decomposition of the sample by subspace iteration; ``reuse`` lets weights take the place of counts."""
    if not len(labels):
        return Space(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = weighted(counts, idf, counts if reuse else None)
    q = np.random.default_rng(seed).standard_normal((TERMS, min(rank + 8, len(x)))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ v.T)[:, :rank]
    return Space(idf, axes, unit(x @ axes), labels.astype(np.float32), float(labels.mean()))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vote(counts: np.ndarray, s: Space, k: int = 15, power: float = 8.0) -> np.ndarray:
    if not len(s.labels):
        return np.full(len(counts), s.prior)
    cosine = unit(weighted(counts, s.idf) @ s.axes) @ s.voters.T
    k = min(k, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** power
    total = weight.sum(1)
    out = np.where(total > 0, (weight * s.labels[near]).sum(1) / np.maximum(total, 1e-300), s.prior)
    return np.clip(np.where(counts.any(1), out, s.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = 3000, rank: int = 48, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Space:
    """Learn from at most ``sample`` labelled documents: of each label up to half as many, those first in a hashed order of ids."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    rows = rows if usable is None else rows.where(usable)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    order = [F.xxhash64(F.col("id"), F.lit("sample")), "id"]
    # Two top-k selections, one per label, so that both are there however rare one is.
    picked = rows.where("label = 0").orderBy(*order).limit(sample // 2).unionAll(rows.where("label = 1").orderBy(*order).limit(sample // 2))
    picked = picked.dropDuplicates(["id"])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    joined = texts.join(F.broadcast(picked), "id").select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, counts = zip(*[packed(terms(x.as_py() or b"")) for x in b.column(2)]) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["id", "label", "at", "counts"])

    # The driver holds the counts once, and those of a text only where it has terms.
    got = joined.mapInArrow(run, "id long, label int, at binary, counts binary").toArrow()
    got = got.filter(pc.greater(pc.binary_length(got["at"]), 0)).sort_by("id")
    y, counts = got["label"].to_numpy().astype(np.float32), unpacked(got["at"], got["counts"])
    del got
    space = fit_space(counts, y, rank, reuse=True)
    del counts
    release()
    return space


def score(docs: DataFrame, space: Space, text_col: str = "text", to: str = "score", k: int = 15, power: float = 8.0, keep: bool = True) -> DataFrame:
    """``docs`` with a column ``to`` between 0 and 1, in place of any of that name; without the text if not ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(texts: pa.Array) -> list[pa.Array]:
        out = [np.zeros(0)]
        for at in range(0, len(texts), 256):
            part = texts.slice(at, 256)
            out.append(vote(np.stack([terms(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in part]), shared.value, k, power))
        return [pa.array(np.concatenate(out), pa.float64())]

    return derived(docs, text_col, () if keep else (text_col,), {to: DoubleType()}, run)
