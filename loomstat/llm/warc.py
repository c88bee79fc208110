"""WARC writing, and reading by boundary-chain verification.

Writing: every page is a record; of pages with the same payload of ``revisit_from`` bytes or more,
the one with the smallest id is a response and the others are revisits that refer to it and carry
no payload. Records are built and written by Spark's own expressions and text writer (the record
separator is the line separator), so files appear through the committer of whatever store they go to.

Reading: Spark's text reader splits files at ``WARC/1.``, which begins every record - and may stand
inside payloads. (No proper end of this magic is also its start, so a reader that meets it across
the edge of a buffer or split can't miss it, as it could with the line breaks before it.) A first pass
emits, per candidate, its offset and the offset of its successor according to its own length. Within
a split the chain is followed to where it leaves the split; pointer jumping over those exits, from
the start of each file, finds where the real chain enters each split. A second pass follows it from
there and cuts the real records out of the split, candidates inside payloads included; only records
that reach into another split are put together by a shuffle.

Null html: an empty payload. Null url or id: the header is left out, and the id is null when read.
Rows with equal ids and payloads are all responses if they have the smallest id. Empty table: no records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

BREAK = "\r\n\r\n"
MAGIC = "WARC/1."
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def guarded(url: str) -> Column:
    """The url without the magic, which would cut the record's own header; ``target`` undoes it."""
    return F.regexp_replace(F.regexp_replace(url, r"WARC%((?:25)*)2F1\.", "WARC%25$12F1."), r"WARC/1\.", "WARC%2F1.")


def target(head: str = "head") -> Column:
    """The url of a record that ``write`` made, as it was given to it but for control characters and spaces."""
    url = F.expr(f"nullif(regexp_extract({head}, '(?i)\\r\\nWARC-Target-URI *: *([^\\r]*)', 1), '')")
    return F.regexp_replace(F.regexp_replace(url, r"WARC%2F1\.", "WARC/1."), r"WARC%25((?:25)*)2F1\.", "WARC%$12F1.")


def write(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 100, broadcast_rows: int = 1 << 20) -> None:
    """Write WARC files under the folder ``to``. Digests that several pages have (40 bytes each with the id) are
    broadcast if there are ``broadcast_rows`` at most."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7f]", "").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    long = rows.where(F.col("size") >= revisit_from).select("id", "digest")
    least = cut(long.groupBy(F.unhex("digest").alias("same")).agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # Payloads stay where they are read if the digests with copies are few; else they are shuffled once.
    least = F.broadcast(least) if least.count() <= broadcast_rows else least.hint("merge")
    rows = rows.join(least, F.unhex("digest") == F.col("same"), "left")
    again = F.col("least").isNotNull() & ~F.col("id").eqNullSafe(F.col("least"))

    def header(name: str, value, when=F.lit(True)):
        return F.when(when & F.col("id").isNotNull() if name == "WARC-Record-ID" else when, F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")

    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    block = F.concat(F.lit(HTTP), F.when(again, F.lit("")).otherwise(F.col("payload").cast("string")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\n")),
        header("WARC-Record-ID", name("id")), header("WARC-Date", F.lit(DATE)),
        header("WARC-Target-URI", guarded("url"), F.col("url").isNotNull()),
        header("WARC-Refers-To", name("least"), again), header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), again),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", BREAK).text(to)


LENGTH = re.compile(rb"\r\n *content-length *: *([0-9]{1,18})", re.IGNORECASE)


def needed(raw: bytes) -> tuple[int, int] | None:
    """Where the block of a record begins in what follows its magic, and where it ends; None if it is no record."""
    end = raw.find(BREAK.encode())
    found = LENGTH.search(raw, 0, end) if end >= 0 else None
    return (end + len(BREAK), end + len(BREAK) + int(found[1])) if found else None


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, rel, reach, size): where each line begins in its split, how far its own length would
    have it reach, and its size. Lines of a split come in order."""
    now, rel = None, 0
    for b in batches:
        rels, reach, sizes = [], [], []
        for f, s, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if (f, s) != now:
                now, rel = (f, s), 0
            raw = v.as_py()
            ends = needed(raw)
            rels.append(rel)
            reach.append(ends[1] if ends else None)
            sizes.append(len(raw))
            rel += len(raw) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rels, pa.int64()), pa.array(reach, pa.int64()), pa.array(sizes, pa.int64())], ["file", "split", "rel", "reach", "size"])


def leave(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate leaves its split, and the last candidate before that."""
    pdf = pdf.sort_values("offset")
    out: dict[int, tuple[int | None, int]] = {}
    for o, n in zip(pdf["offset"].tolist()[::-1], pdf["next"].tolist()[::-1]):
        out[o] = (None, o) if n is None or n != n else out.get(int(n), (int(n), o))
    exits = pd.array([out[o][0] for o in pdf["offset"]], dtype="Int64")
    return pdf[["file", "split", "offset"]].assign(exit=exits, last=[out[o][1] for o in pdf["offset"]])


def carve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, offset, split, head, block): real records of a split; parts of those that reach beyond one, without a head."""
    state: dict = {"key": None}
    out: list[tuple] = []

    def done() -> None:
        if state["key"] is not None and state["parts"]:
            value = MAGIC.encode().join(state["parts"])
            ends = needed(value) if state["own"] else None
            at = state["start"] if state["own"] else state["owner"]
            if at is not None:
                whole = bool(ends) and ends[1] <= len(value)
                out.append((state["key"][0], at, state["key"][1], *(parsed(value) if whole else (None, value))))
        state["parts"] = []

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], [n for n, _ in FIELDS])
        out.clear()
        return made

    for b in batches:
        for f, s, v, base, entry, owner in zip(*(b.column(i).to_pylist() if i != 2 else b.column(i) for i in range(6))):
            if (f, s) != state["key"]:
                done()
                state = {"key": (f, s), "rel": 0, "next": entry, "own": False, "start": None, "owner": owner, "parts": []}
            raw = v.as_py()
            offset = base + state["rel"] - len(MAGIC)
            state["rel"] += len(raw) + len(MAGIC)
            if offset < 0:
                continue  # before the file's first magic
            if offset == state["next"]:
                done()
                ends = needed(raw)
                state |= {"own": True, "start": offset, "next": offset + len(MAGIC) + ends[1] + len(BREAK) if ends else None}
            state["parts"].append(raw)
        if out:
            yield flush()
    done()
    if out:
        yield flush()


FIELDS = (("file", "string"), ("offset", "long"), ("split", "long"), ("head", "string"), ("block", "binary"))
KINDS = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())


def parsed(value: bytes) -> tuple[str | None, bytes | None]:
    """Head and block of a record; a record that the file's end cuts off has what is there."""
    ends = needed(value)
    return (value[: ends[0] - len(BREAK)].decode("utf-8", "replace"), value[ends[0] : ends[1]]) if ends else (None, None)


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [parsed(MAGIC.encode().join(x["block"] for x in parts)) for parts in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["file", "offset", "head", "block"])


def read(spark: SparkSession, at: str) -> DataFrame:
    """``(file, offset, head string, block binary)`` for each real record of the files under ``at``."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    lines = spark.read.option("lineSep", MAGIC).text(at).select(*meta, F.col("value").cast("binary").alias("value"))
    found = cut(lines.mapInArrow(candidates, "file string, split long, rel long, reach long, size long"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    per = found.groupBy("file", "split").agg(F.max(F.col("rel") + F.col("size") + len(MAGIC)).alias("length"))
    bases = cut(per.select("file", "split", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base")))
    offset = F.col("base") + F.col("rel") - len(MAGIC)
    links = found.join(bases, ["file", "split"]).select("file", "split", offset.alias("offset"), (offset + len(MAGIC) + F.col("reach") + len(BREAK)).alias("next")).where("offset >= 0")
    exits = cut(links.groupBy("file", "split").applyInPandas(leave, "file string, split long, offset long, exit long, last long"))
    # Pointer jumping: reached grows from the file starts; jump doubles its reach each round.
    jump = exits.where("exit is not null").select("file", "offset", "exit")
    entries = jump.select("file", F.col("exit").alias("offset")).distinct()
    jump = cut(jump.join(entries, ["file", "offset"], "left_semi").unionAll(jump.where("offset = 0")))
    reached, n = cut(exits.where("offset = 0").select("file", "offset")), -1
    while (m := reached.count()) != n:
        n = m
        over = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = cut(reached.unionAll(over).distinct())
        far = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("far"))
        jump = cut(jump.join(far, ["file", "exit"], "left").select("file", "offset", F.coalesce("far", "exit").alias("exit")))
    enters = exits.join(reached, ["file", "offset"], "left_semi").select("file", "split", F.col("offset").alias("entry"), "last")
    splits = bases.join(enters, ["file", "split"], "left").withColumn("owner", F.last("last", True).over(before))
    # One row for each split of the files: a millionth of their bytes, and no more than the driver holds of each split as it is.
    # A join that shuffled the lines would lose their order.
    splits = F.broadcast(cut(splits.select("file", "split", "base", "entry", "owner")))
    placed = lines.join(splits, ["file", "split"]).select("file", "split", "value", "base", "entry", "owner")
    records = placed.mapInArrow(carve, ", ".join(f"{n} {t}" for n, t in FIELDS))
    parts = records.where("head is null").groupBy("file", "offset").agg(F.sort_array(F.collect_list(F.struct("split", "block"))).alias("all"))
    joined = parts.mapInArrow(put_together, "file string, offset long, head string, block binary").where("head is not null")
    return records.where("head is not null").select("file", "offset", "head", "block").unionAll(joined)


def field(name: str):
    return F.expr(f"nullif(regexp_extract(head, '(?i)\\r\\n{name} *: *([^\\r]*)', 1), '')")


def pages(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``; a revisit's payload is that of the record it refers to."""
    number = lambda n: F.expr(f"try_cast(regexp_extract(head, '(?i)\\r\\n{n} *: *<urn:page:(-?[0-9]+)>', 1) as long)")
    start = F.length(F.expr("substring_index(decode(substring(block, 1, 65536), 'ISO-8859-1'), '\\r\\n\\r\\n', 1)")) + len(BREAK)
    payload = F.substring(F.col("block"), start + 1, F.octet_length("block"))
    rows = cut(records.select(number("WARC-Record-ID").alias("page_id"), F.lower(field("WARC-Type")).alias("record_type"), number("WARC-Refers-To").alias("refers_to"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest")))
    found = rows.where("record_type = 'response'").select(F.col("page_id").alias("ref"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    used = rows.where("record_type = 'revisit'")
    found = found.dropDuplicates(["ref"])
    again = used.join(found, used.refers_to == found.ref, "left").select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
    return rows.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionAll(again)
