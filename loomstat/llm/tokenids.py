"""Token ids of documents in binary shards, compressed by Re-Pair.

Encoding: a text is cut before each white-space run that follows a visible character. The
byte-level tokenizer never makes a token across such a place, so each distinct stretch is encoded
by the tokenizer's library once and remembered. New stretches go to it many in a row, as one text,
whose ids are told apart by the bytes that they stand for. Texts with white space outside ASCII go to
the library whole.

File format: a Parquet table, one row per block of documents, in ascending order of id (nulls
first). A block's columns ``rules``, ``spans`` and ``sequence`` are little-endian 32-bit integers.
Ids below ``terminals`` stand for themselves; nonterminal ``terminals + r`` stands for the pair
``rules[2 r], rules[2 r + 1]`` and ``spans[r]`` ids in all, so a reader finds the symbols under
any range of ids from a running sum, and decodes only those. ``starts`` holds where each document
begins in the block, ``before`` how many ids of the shard precede the block.

Compression: Re-Pair in rounds. Each round takes the most frequent pairs of neighbouring symbols
together and replaces what occurrences don't overlap, left to right, until a round saves too little.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHOLE, Pool, dealt, restored, slices, trimmed
from .tokencount import library

#: Ids below this stand for themselves.
TERMINALS = 1 << 16
#: Ids in a block (a longer document has a block of its own); bytes of texts encoded together; stretches in a row.
BLOCK, GROUP, ROW = 1 << 20, 1 << 22, 256
#: Rules added in a round; uses that a rule needs; share of the symbols that a round must save; rounds.
RULES, LEAST, GAIN, ROUNDS = 4096, 8, 0.02, 8
#: Slots in which pairs are counted; stretches remembered by a Python worker.
SLOTS, KEEP = 1 << 18, 600_000
WHITE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
#: What a text has whose white space is more than single spaces and line feeds between visible characters.
ODD = "  |\n\n| \n|\n |^[ \n]|[ \n]$|" + WHITE.pattern[:-1] + "\t\r\x0b\x0c]"
SPACES = " \t\n\r\x0b\x0c"
#: A word of Latin letters, after a space or line feed, and signs after it.
WORD = "^(?P<core>\n?[A-Za-zÀ-ÖØ-öø-ʯ]+)(?P<tail>[.,;:!?)]+)$"
STRETCH = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
SCHEMA = "shard int, before long, n long, ids array<long>, starts array<long>, rules binary, spans binary, sequence binary"


def stretches(text: str) -> list[str]:
    return [text] if WHITE.search(text) else STRETCH.findall(text)


def split(names: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words with signs after them: both are pieces for the byte-level tokenizer, whose pattern ends one where letters end."""
    found, none = pc.extract_regex(names, WORD), pa.scalar(None, pa.string())
    there = found.is_valid()
    tails = pc.binary_join_element_wise(pa.scalar(WHOLE), found.field("tail"), "")
    return pc.if_else(there, found.field("core"), none), pc.if_else(there, tails, none)


@cache
def pool(path: str) -> Pool:
    """Ids of stretches, by a tokenizer's file."""
    t = library(path)
    width = np.zeros(t.get_vocab_size() + 1, np.int64)  # bytes that an id stands for
    for token, i in t.get_vocab().items():
        width[i] = len(token)
    for i, token in t.get_added_tokens_decoder().items():
        width[i] = len(token.content.encode())

    def ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.int32) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, np.int32), np.array([len(x) for x in found], np.int64)

    def run(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        led = pc.invert(pc.starts_with(names, WHOLE))
        rows = names.filter(led)
        given = rows.to_numpy(zero_copy_only=False).tolist()
        flat, _ = ids([(" " + " ".join(given[i : i + ROW])).replace(" \n", "\n") for i in range(0, len(given), ROW)])
        bounds = np.cumsum(pc.binary_length(rows).to_numpy() + 1 - pc.starts_with(rows, "\n").to_numpy(zero_copy_only=False))
        ends = np.cumsum(width[flat])
        at = np.searchsorted(ends, bounds)
        if len(rows) and not (at[-1] + 1 == len(flat) and (ends[at] == bounds).all()):
            flat, sizes = ids(restored(given, " "))
        else:
            sizes = np.diff(at, prepend=-1)
        if len(rows) == len(names):
            return flat, sizes
        rest, counts = ids([n[len(WHOLE) :] for n in names.filter(pc.invert(led)).to_pylist()])
        led = led.to_numpy(zero_copy_only=False)
        size = np.zeros(len(names), np.int64)
        size[led], size[~led] = sizes, counts
        of = np.repeat(led, size)
        out = np.zeros(len(of), np.int32)
        out[of], out[~of] = flat, rest
        return out, size

    return Pool(run, KEEP, split)


def encode_all(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (null: none), one after another, and how many each has."""
    return pool(path).ids_of(*dealt(texts, ODD, stretches, WHOLE))


def compress(ids: np.ndarray, terminals: int = TERMINALS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: rules (n x 2), the number of ids under each, and the sequence left."""
    seq = ids.astype(np.uint32)
    rules, spans = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        if len(seq) < 2 * LEAST:
            break
        slot = seq[:-1] * np.uint32(0x9E3779B1)
        slot += seq[1:] * np.uint32(0x85EBCA77)
        slot >>= np.uint32(32 - SLOTS.bit_length() + 1)
        often = np.bincount(slot, minlength=SLOTS)
        floor = max(LEAST, int(np.partition(often, -RULES)[-RULES]))
        at = np.flatnonzero((often >= floor).take(slot))
        s, pairs = slot.take(at), seq.take(at).astype(np.int64) << 24 | seq.take(at + 1)
        # One pair has each slot; what shares it waits for a later round.
        table = np.zeros(SLOTS, np.int64)
        table[s] = pairs
        own = table.take(s) == pairs
        at, s = at[own], s[own]
        enough = (np.bincount(s, minlength=SLOTS) >= floor).take(s)
        at, s = at[enough], s[enough]
        # In a run of overlapping occurrences every other one is replaced.
        head = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        place = np.arange(len(at)) - np.repeat(head, np.diff(head, append=len(at)))
        even = (place & 1) == 0
        at, s = at[even], s[even]
        uses = np.bincount(s, minlength=SLOTS)
        keep = (uses >= LEAST).take(s)
        at, s = at[keep], s[keep]
        if len(at) < GAIN * len(seq):
            break
        made = np.flatnonzero(uses >= LEAST)
        number = np.zeros(SLOTS, np.uint32)
        number[made] = np.arange(len(made)) + terminals + len(rules)
        new = np.stack((table[made] >> 24, table[made] & 0xFFFFFF), axis=1)
        width = lambda s: np.where(s < terminals, 1, spans[np.maximum(s - terminals, 0)] if len(spans) else 1)
        spans = np.concatenate((spans, width(new[:, 0]) + width(new[:, 1])))
        rules = np.concatenate((rules, new))
        seq[at] = number.take(s)
        left = np.ones(len(seq), bool)
        left[at + 1] = False
        seq = seq[left]
    return rules, spans, seq.astype(np.int64)


def expand(rules: np.ndarray, spans: np.ndarray, sequence: np.ndarray, start: int = 0, end: int | None = None, terminals: int = TERMINALS) -> np.ndarray:
    """Ids from ``start`` to ``end`` of a compressed block; only symbols that reach into it, and rules that they need, are expanded."""
    rules, spans, sequence = (x.astype(np.int64) for x in (rules.reshape(-1, 2), spans, sequence))
    ends = np.cumsum(np.concatenate((np.ones(terminals, np.int64), spans))[sequence])
    end = int(ends[-1]) if end is None and len(ends) else end or 0
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
    part = sequence[first:last]
    offset = start - (int(ends[first - 1]) if first else 0)
    needed, todo = np.zeros(len(rules), bool), np.unique(part[part >= terminals]) - terminals
    while len(todo):
        needed[todo] = True
        below = np.unique(rules[todo]) - terminals
        below = below[below >= 0]
        todo = below[~needed[below]]
    name = np.concatenate((np.arange(terminals), terminals + np.cumsum(needed) - 1))
    rules, spans, part = name[rules[needed]], spans[needed], name[part]
    size = np.concatenate((np.ones(terminals, np.int64), spans))
    # The ids under every nonterminal, one after another; rules refer to earlier rules only.
    begin = np.concatenate((np.arange(terminals), terminals + np.cumsum(spans) - spans))
    flat = np.concatenate((np.arange(terminals, dtype=np.uint32), np.zeros(int(spans.sum()), np.uint32)))

    def under(symbols: np.ndarray) -> np.ndarray:
        sizes = size.take(symbols)
        ends = np.cumsum(sizes)
        small = np.int32 if len(flat) + (int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
        where = np.repeat((begin.take(symbols) - (ends - sizes)).astype(small), sizes)
        where += np.arange(len(where), dtype=small)
        return flat.take(where)

    known = terminals
    while known < terminals + len(rules):  # all rules whose parts are known, together
        block = rules[known - terminals :]
        unknown = np.flatnonzero((block >= known).any(axis=1))
        upto = known + (int(unknown[0]) if len(unknown) else len(block))
        out = under(rules[known - terminals : upto - terminals].ravel())
        flat[begin[known] : begin[known] + len(out)] = out
        known = upto
    return under(part)[offset : offset + end - start]


def write(df: DataFrame, to: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty), append ``end_id``, and write shards in ascending order of id to ``to``."""

    def block(shard: int, before: int, ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in parts], np.int64)
        rules, spans, seq = compress(np.concatenate(parts))
        starts = (np.cumsum(sizes) - sizes).tolist()
        row = {"shard": shard, "before": before, "n": int(sizes.sum()), "ids": ids, "starts": starts, "rules": rules.astype("<u4").tobytes(), "spans": spans.astype("<u4").tobytes(), "sequence": seq.astype("<u4").tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("rules", pa.binary()), ("spans", pa.binary()), ("sequence", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        ids: list = []
        parts: list[np.ndarray] = []
        size = 0
        for b in batches:
            at = 0
            for group in slices(b.column(1), GROUP):
                flat, lengths = encode_all(group, tokenizer)
                ends = np.cumsum(lengths + 1)
                own = np.zeros(len(flat) + len(group), bool)
                own[ends - 1] = True
                all_ids = np.full(len(own), end_id, np.int64)
                all_ids[~own] = flat
                for i, part in zip(b.column(0).slice(at, len(group)).to_pylist(), np.split(all_ids, ends[:-1])):
                    ids.append(i)
                    parts.append(part)
                    size += len(part)
                    if size >= BLOCK:
                        yield block(shard, before, ids, parts)
                        before += size
                        ids, parts, size = [], [], 0
                at += len(group)
        if ids:
            yield block(shard, before, ids, parts)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(trimmed(run), SCHEMA).write.parquet(to)


def read(df: DataFrame) -> DataFrame:
    """Per document of a written table: ``(id, start, n_tokens, ids_crc32)``; start counts the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                get = lambda name: b.column(b.schema.get_field_index(name))[row]  # noqa: B023, E731
                rules, spans, seq = (np.frombuffer(get(x).as_buffer(), "<u4") for x in ("rules", "spans", "sequence"))
                ids = expand(rules, spans, seq).astype("<u4")
                starts = np.array(get("starts").as_py(), np.int64)
                sizes = np.diff(starts, append=len(ids))
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), sizes.tolist())]
                shard = pa.array(np.full(len(starts), get("shard").as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([shard, pa.array(get("ids").as_py(), pa.int64()), pa.array(starts + get("before").as_py()), pa.array(sizes), pa.array(crc, pa.int64())], ["shard", "id", "at", "n_tokens", "ids_crc32"])

    docs = df.mapInArrow(run, "shard int, id long, at long, n_tokens long, ids_crc32 long")
    shards = df.groupBy("shard").agg(F.sum("n").alias("n"))
    first = shards.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    return docs.join(first, "shard").select("id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
