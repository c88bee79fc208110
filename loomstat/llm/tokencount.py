"""Token counts without token ids.

The piece count of a pre-token is worked out once by the tokenizer's library and kept; each
document's count is the sum over its distinct pre-tokens of frequency times piece count. The join
is a hash join inside each task against a bounded memo of piece counts: a shuffle by pre-token
would move every word of the corpus and send the commonest words to single tasks.

A pre-token is what stands between spaces, tabs, line feeds and carriage returns. That is exact
for tokenizers that drop white space (``.json``) and for SentencePiece models none of whose pieces
has a space mark after another character (``.model``; spaces then belong to the pre-token).
Null texts count as empty.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo

#: Pre-tokens remembered by a Python worker, and bytes of text counted together.
KEEP, GROUP = 200_000, 1 << 22


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def library(path: str):
    """The tokenizer of a .json file, without truncation or padding; one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def counter(path: str) -> tuple[Memo, Callable[[str], list[str]], Callable[[list[str]], list[int]]]:
    """A memo of piece counts, how a text is cut into pre-tokens, and how pre-tokens are counted."""
    if path.endswith(".model"):
        from .sentencepiece import model

        m = model(path)
        return Memo(KEEP), m.chunks, lambda words: [len(m.chunk_ids(w)) // 4 for w in words]
    t = library(path)

    def cut(text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    return Memo(KEEP), cut, lambda words: [len(e.ids) for e in t.encode_batch_fast(words, add_special_tokens=False)]


def count_all(texts: list[str], path: str) -> list[int]:
    memo, cut, count = counter(path)
    bags = [Counter(cut(t)) for t in texts]
    new = memo.missing(set().union(*bags))
    memo.update(zip(new, count(new)))
    return [sum([memo[w] * n for w, n in bag.items()]) for bag in bags]


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, counts, group, size = [], [], [], 0
            for x in b.column(1):
                group.append(x.as_py() or "")
                sizes.append(len(x.as_buffer()) if x.is_valid else 0)
                size += sizes[-1]
                if size >= GROUP:
                    counts += count_all(group, path)
                    group, size = [], 0
            counts += count_all(group, path) if group else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(sizes, np.int64)), pa.array(np.array(counts, np.int64))], ["id", "n_bytes", "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, n_tokens long")
