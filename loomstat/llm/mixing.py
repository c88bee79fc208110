"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Sizes are words, ``[^\\x20\\x09-\\x0D]+``; a null text has none. Sources in order of code points, the
null source last, get the weights in turn and share the sum of all sizes; a target stops at ``most``
times its source's size, and what is over is shared again by weight among the others.

Every document of a source is expected target / size-of-source times. The documents are put in
order of size class (eighths of octaves), then of the MD5 of their id; expected copies are summed
along that order, one offset drawn per source is added, and a document is emitted once for each
integer that the sum crosses. Prefix sums come in three steps - size classes of a source, slices of
a class (leading digits of the MD5, more of them the more documents a class has), documents of a
slice - so no source and no group of equal sizes is sorted in one task, and the slicing does not
change the result. Results depend on ids and sizes only, so reruns agree.

Empty tables give no rows; documents without words may be emitted but take 0 words; repeated rows
count as documents of their own; rows with a null id come first within their slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a slice on average at most, or the square root of all if that is more.
SLICE = 256


def size_class(size: Column) -> Column:
    """16 x bits of the size + its three bits after the first: eighths of an octave."""
    bits = F.when(size > 0, F.length(F.bin(size))).otherwise(0)
    top = F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0)))
    return (bits * 16 + top).cast("int")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: the level at which all shares, stopped at
    ``most`` times the size, sum to all sizes. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # Sources fill up in the order of cap / weight; level[j] holds if the first j are full.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "i")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    since = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(since)
    levels = caps.withColumn("level", level)
    holds = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("c"), "i", "level"))).over(whole)["level"]
    return levels.withColumn("target", F.least("cap", F.coalesce(holds, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` per document, and the columns named in ``keep``."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    names = [f"keep_{c}" for c in keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("digest"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    rows = rows.withColumn("class", size_class(F.col("size")))
    narrow = cut(rows.drop(*names))  # texts are scanned once for all counts

    def same(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
        there = b.select(*[F.col(n).alias(f"b_{n}") if n in names else F.col(n) for n in b.columns])
        on = [a[n].eqNullSafe(there[f"b_{n}"]) if n == "source" else a[n] == there[f"b_{n}"] for n in names]
        return a.join(there, on, "left").drop(*[f"b_{n}" for n in names])

    classes = narrow.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    wanted = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    limit = F.greatest(F.lit(float(SLICE)), F.sqrt(F.sum("n").over(Window.partitionBy())))
    digits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / limit) / 4)).cast("int")
    earlier = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    placed = classes.select("source", "class", digits.alias("digits"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("class_first"))
    placed = same(placed, wanted, "source")
    cut_off = F.expr("substring(digest, 1, digits)")
    sliced = same(narrow, placed, "source", "class").withColumn("slice", cut_off)
    within = Window.partitionBy("source", "class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = same(narrow, placed, "source", "class").withColumn("slice", cut_off).groupBy("source", "class", "slice").agg(F.count("*").alias("m"))
    counts = counts.select("source", "class", "slice", F.coalesce(F.sum("m").over(within), F.lit(0)).alias("slice_first"))
    all_placed = same(sliced, counts, "source", "class", "slice")
    inside = F.row_number().over(Window.partitionBy("source", "class", "slice").orderBy("digest", "doc_id", "size"))
    rank = F.col("class_first") + F.col("slice_first") + inside
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    ranked = all_placed.withColumn("rank", rank).withColumn("rate", rate).withColumn("offset", offset)
    copies = (F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))).cast("long")
    done = ranked.withColumn("copies", F.least(copies, F.ceil("rate")))  # rounding of long sums can't add a copy
    done = done.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    if not keep:
        return done
    # Other columns cross the network once: rows of one id, source and size stand in for each other, the first for the first.
    alike = ["doc_id", "source", "size"]
    wide = rows.select(*alike, *names).withColumn("k", F.row_number().over(Window.partitionBy(*alike).orderBy(F.xxhash64(*names))))
    found = done.select(*[F.col(c).alias(f"of_{c}") for c in alike], "source_size", "target", "copies", "taken")
    found = found.withColumn("of_k", F.row_number().over(Window.partitionBy(*[f"of_{c}" for c in alike]).orderBy("copies")))
    on = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    both = wide.join(found, on & (F.col("k") <= F.col("of_k")) & (F.col("k") >= F.col("of_k")))
    return both.select(*alike, "source_size", "target", "copies", "taken", *[F.col(n).alias(c) for n, c in zip(names, keep)])


ORACLE = """
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
classed AS (
  SELECT *, CASE WHEN size > 0 THEN length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) ELSE 0 END AS class FROM rows),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
caps AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, [5.0::DOUBLE, 2.0, 1.0][1 + i % 3] AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM sized)),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
held AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, i LIMIT 1),
wanted AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM held), 'inf'::DOUBLE) * weight) AS target FROM levels),
ranked AS (
  SELECT c.doc_id, c.size, w.source_size, w.target,
         CASE WHEN w.source_size > 0 THEN w.target / w.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY c.source ORDER BY class, digest, doc_id NULLS FIRST, size) AS rank,
         ('0x' || substr(md5('42:' || coalesce(c.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM classed c JOIN wanted w ON c.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
       (least(floor(rank * rate + shift) - floor((rank - 1) * rate + shift), ceil(rate)) * size)::BIGINT AS taken
FROM ranked
"""
