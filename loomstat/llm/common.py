"""Shared pieces: table access, lineage cuts in the shared checkpoint folder, and distributed connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the cluster's shared checkpoint folder and forget its lineage.

    The folder is what ``spark.checkpoint.dir`` names; only a session without that setting
    (tests on one machine) gets a temporary folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomstat-checkpoint-"))
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as ``edges(a long, b long)``.

    Returns ``(node, root)`` for every node that has an edge to another node; the root is an
    arbitrary member, the same for all nodes of a component. Each round points every node at the
    neighbour that comes first in a hashed order (so chains of pointers stay short), jumps the
    pointers, and contracts the edges; the graph at least halves. No group of neighbours and no
    set of links is gathered in one task or on the driver.
    """

    def order(c: str) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    e = cut(edges.select(*pair("a", "b")).where("a <> b").distinct())
    layers: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(e.select("b", "a"))
        first = both.groupBy("node").agg(F.min(order("other")).alias("best"))
        p = first.select("node", F.least(order("node"), "best")["id"].alias("root"))
        p = cut(p)
        for _ in range(2):
            p = p.join(p.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root"))
        p = cut(p)
        layers.append(p)
        left = p.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = p.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = cut(e.join(left, "a").join(right, "b").select(*pair("ra", "rb")).where("a <> b").distinct())
    if not layers:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = layers.pop()
    while layers:
        over = out.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = layers.pop().join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, for files that an operator writes and reads back."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomstat-checkpoint-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` whose names, in any case, are none of ``names``."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def quoted(name: str) -> Column:
    """A column by its literal name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def release() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, which at the end of a task gives memory that is free back to the system: workers stay
    for the next stage, beside whose workers it would count."""

    def through(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        release()

    return through


def derived(df: DataFrame, column: str, drop: tuple[str, ...], made: dict[str, DataType], run: Callable[[pa.Array], list[pa.Array]], weight: int = 2 << 20) -> DataFrame:
    """``df`` without the columns ``drop``, and the columns ``made`` (in place of any of those names) that ``run``
    makes from batches of ``column``. Inside the task columns have names of their own, so any names will do.
    Batches are taken in slices of about ``weight`` bytes, so that what is made of a large one is never there at once."""
    rest = without(df, *made, *drop)
    names, new = [f"c{i}" for i in range(len(rest))], [f"m{i}" for i in range(len(made))]
    rows = df.select(*[quoted(c).alias(n) for c, n in zip(rest, names)], quoted(column).alias("given"))
    schema = StructType([*rows.schema.fields[:-1], *[StructField(n, kind) for n, kind in zip(new, made.values())]])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            step = max(1, whole.num_rows * weight // max(whole.nbytes, weight))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *run(b.columns[-1])], [*names, *new])

    return rows.mapInArrow(trimmed(batches), schema).toDF(*rest, *made)


class Memo(dict):
    """A dictionary that remembers between ``keep`` and twice as many recently added or used entries."""

    def __init__(self, keep: int):
        super().__init__()
        self.keep, self.old = keep, {}

    def missing(self, keys) -> list:
        """Bring in what the older half has of ``keys``; return the rest. All of ``keys`` stay until the next call."""
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()
        want, old = [k for k in keys if k not in self], self.old
        for k in want:
            if k in old:
                self[k] = old[k]
        return [k for k in want if k not in old]


class Pool:
    """Ids of stretches of text, each worked out once while it is remembered.

    ``run`` gives the ids of new stretches: all in one array, and how many each has. ``split`` names the two stretches
    whose ids together are those of a new one (null, if there are none); neither is split further. Beyond ``keep``
    stretches (or ``WIDE`` times as many bytes) those met once are forgotten, and then the rarer ones.
    """

    WIDE = 24

    def __init__(self, run: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], keep: int, split: Callable[[pa.Array], tuple[pa.Array, pa.Array]] | None = None):
        self.run, self.keep, self.split = run, keep, split
        self.numbers: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.size = self.begin = self.uses = self.width = np.zeros(0, np.int64)

    def ids_of(self, names: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, given as their stretches in a row and how many each has; and how many ids each text has."""
        coded = names.dictionary_encode()
        each = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = np.fromiter(map(self.numbers.get, each, repeat(-1)), np.int64, len(each))
        if len(new := np.flatnonzero(own < 0)):
            own[new] = np.arange(len(self.numbers), len(self.numbers) + len(new))
            self.numbers.update(zip([each[i] for i in new.tolist()], own[new].tolist()))
            self.learn(coded.dictionary.take(pa.array(new)))
        at = own.take(coded.indices.to_numpy())
        size = self.size.take(at)
        out = self.gathered(at, size)
        lengths = np.diff(np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))])
        self.uses += np.bincount(at, minlength=len(self.uses))
        if len(self.uses) > self.keep or self.width.sum() > self.WIDE * self.keep:
            self.forget()
        return out, lengths

    def learn(self, fresh: pa.Array) -> None:
        """Add the ids of stretches that have just got the last numbers."""
        first, made, parts = len(self.size), np.zeros(len(fresh), bool), []
        if self.split:
            cores, tails = self.split(fresh)
            made = cores.is_valid().to_numpy(zero_copy_only=False)
            parts = [x.drop_null().to_numpy(zero_copy_only=False).tolist() for x in (cores, tails)]
            more = [x for x in dict.fromkeys(chain(*parts)) if x not in self.numbers]
            self.numbers.update(zip(more, range(len(self.numbers), len(self.numbers) + len(more))))
            fresh, made = pa.concat_arrays([fresh, pa.array(more, pa.string())]), np.concatenate((made, np.zeros(len(more), bool)))
        self.width = np.concatenate((self.width, pc.binary_length(fresh).to_numpy().astype(np.int64)))
        self.uses = np.concatenate((self.uses, np.zeros(len(fresh), np.int64)))
        self.begin, self.size = (np.concatenate((x, np.zeros(len(fresh), np.int64))) for x in (self.begin, self.size))
        self.put(first + np.flatnonzero(~made), *self.run(fresh.filter(pa.array(~made))))
        if made.any():
            both = np.stack([np.fromiter(map(self.numbers.__getitem__, x), np.int64, len(x)) for x in parts], axis=1)
            size = self.size.take(both)
            self.put(first + np.flatnonzero(made), self.gathered(both.ravel(), size.ravel()), size.sum(1))

    def put(self, at: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.begin[at], self.size[at] = len(self.ids) + np.cumsum(size) - size, size
        self.ids = np.concatenate((self.ids, ids))

    def gathered(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of stretches, by number, in a row."""
        ends = np.cumsum(size)
        where = np.repeat((self.begin.take(at) - (ends - size)).astype(np.int32), size)  # both are below 2^31 in a group of texts
        where += np.arange(len(where), dtype=np.int32)
        return self.ids.take(where)

    def forget(self) -> None:
        often = np.argsort(-self.uses, kind="stable")
        half = (np.arange(len(often)) < self.keep // 2) & (np.cumsum(self.width[often]) <= self.WIDE * self.keep // 2)
        stay = np.sort(often[half & (self.uses[often] > 1)])
        size = self.size[stay]
        self.ids = self.gathered(stay, size)
        self.begin, self.size, self.uses, self.width = np.cumsum(size) - size, size, self.uses[stay] // 2, self.width[stay]
        keys = list(self.numbers)
        self.numbers = {keys[i]: n for n, i in enumerate(stay.tolist())}


#: Before the name of a stretch that is given whole.
WHOLE = "\r"


def dealt(texts: pa.Array, odd: str, other: Callable[[str], list[str]], first: str = "") -> tuple[pa.Array, np.ndarray]:
    """The stretches of all texts (null: none) in a row by name, and how many each text has.

    A text is cut at single spaces and before line feeds; a stretch after a space is named by itself
    without it, one after a line feed by itself, and a text's first one has ``first`` before its name.
    The stretches of a text in which the pattern ``odd`` (RE2) is found, which is to be there for carriage returns, are what
    ``other`` says, named by themselves after ``WHOLE``."""
    texts = texts.fill_null("")
    some = pc.greater(pc.binary_length(texts), 0)
    fast = pc.and_not(some, pc.match_substring_regex(texts, odd))
    lines = pc.replace_substring(texts.filter(fast), "\n", " \n")
    cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(first), lines, "") if first else lines, " ")
    if len(cut) < len(texts):
        slow = pa.array([[WHOLE + s for s in other(x)] if x else [] for x in texts.filter(pc.invert(fast)).to_pylist()], pa.list_(pa.string()))
        at = fast.to_numpy(zero_copy_only=False)
        order = np.argsort(np.concatenate((np.flatnonzero(at), np.flatnonzero(~at))), kind="stable")
        cut = pa.concat_arrays([cut, slow]).take(pa.array(order))
    return cut.flatten(), cut.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def slices(texts: pa.Array, weight: int) -> Iterator[pa.Array]:
    """The texts in runs of about ``weight`` bytes."""
    ends = np.cumsum(pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + weight)))
        yield texts.slice(at, end - at)
        at = end


def restored(names: list[str], lead: str) -> list[str]:
    """Stretches by their names; ``lead`` stands for the space before one."""
    return [n if n[:1] == "\n" else n[1:] if n[:1] == WHOLE else lead + n for n in names]
