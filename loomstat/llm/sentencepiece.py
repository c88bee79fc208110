"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice over a text has an edge for every vocabulary piece and, for characters that no piece
covers, an unknown edge (its UTF-8 bytes, where the model falls back on bytes). One pass keeps a
backpointer for each position. Only positions in a window as long as the longest piece can still
be extended; whenever the paths from all of them meet in one boundary, everything before it is
final, its ids are committed and forgotten. Memory is the window plus what is not yet committed.

Unigram models: the path with the greatest sum of scores. BPE models: a path is admissible if each
two neighbouring pieces merge to themselves; exactly one admissible path leads to every position,
and it is the result of the merges, so ids equal those of the SentencePiece library.

Where no piece has a space mark after another character, all paths meet before every such mark;
those stretches are encoded once and remembered. New ones are encoded in alphabetical order, so that
the pass over each starts where it parts from the one before.

Null and empty texts have no ids; ids decode to the very text, spaces included, except characters
that a model without byte fallback can't express.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from .common import WHOLE, Pool, dealt, derived, restored, slices

MARK = "▁"
#: Stretches remembered by a Python worker; longer ones than LONG are streamed without; bytes of texts encoded together.
KEEP, LONG, GROUP = 200_000, 64, 1 << 21
UNKNOWN_PENALTY = 10.0


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a serialized protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        n = shift = 0
        while True:
            n |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return n

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[i : i + size]
            i += size


def contents(path: str) -> tuple[list[str], list[float], list[int], bool, bool]:
    """Pieces, scores and types of a model file, whether it is a BPE model, and whether texts get a space before."""
    with open(path, "rb") as f:
        top = list(fields(f.read()))
    pieces = [dict(fields(x)) for k, x in top if k == 1]
    trainer = dict(fields(next((x for k, x in top if k == 2), b"")))
    normal = dict(fields(next((x for k, x in top if k == 3), b"")))
    if normal.get(2) or normal.get(4, 1) or trainer.get(24):
        raise ValueError("only models that leave texts as they are (identity normalization, spaces kept) are supported")
    scores = [float(np.frombuffer(p.get(2, bytes(4)), "<f4")[0]) for p in pieces]
    return [p[1].decode() for p in pieces], scores, [p.get(3, 1) for p in pieces], trainer.get(3, 1) == 2, bool(normal.get(3, 1))


class Model:
    """Pieces, scores and kind of a SentencePiece model file."""

    def __init__(self, pieces: list[str], scores: list[float], types: list[int], bpe: bool, prefix: bool = True):
        self.bpe, self.prefix = bpe, prefix
        self.ids = {p: i for i, (p, t) in enumerate(zip(pieces, types)) if t in (1, 4)}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = next((i for i, t in enumerate(types) if t == 2), 0)
        self.bytes = [self.unknown] * 256
        for i, (p, t) in enumerate(zip(pieces, types)):
            if t == 6:
                self.bytes[int(p[3:5], 16)] = i
        self.fallback = self.unknown not in self.bytes
        self.worst = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.separable = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.pattern = self.boundaries()
        self.lines = self.separable and not any("\n" in p for p in self.ids)
        self.pool = Pool(self.encode_new, KEEP)
        # Pieces by rank: single characters, which are never merged, then the best score first.
        self.ranked = sorted(self.ids, key=lambda p: (len(p) > 1, -self.score[p]))
        self.rank = {p: r for r, p in enumerate(self.ranked)}
        self.number = [self.ids[p] for p in self.ranked]
        self.halves = [(r, r) for r in range(len(self.ranked))]
        self.agree: dict[int, bool] = {}
        self.trie: list = [-1, {}]  # of reversed pieces: rank or -1, and what may stand before
        for r, p in enumerate(self.ranked):
            if bpe and len(p) > 1:
                parts = self.merged(p, 2)
                if len(parts) != 2 or self.merged(p) != [p]:
                    continue  # the merges never make it
                self.halves[r] = self.rank[parts[0]], self.rank[parts[1]]
            node = self.trie
            for c in reversed(p):
                node = node[1].setdefault(c, [-1, {}])
            node[0] = r

    def boundaries(self) -> re.Pattern:
        """Cuts a text where no piece reaches across: before space marks, around control characters
        that are in no piece, and before signs that follow nothing but signs and marks in any piece."""
        inside = set().union(*self.ids)
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        signs = {c for c in inside if not c.isalpha() and c != MARK}
        while bad := {b for p in self.ids for a, b in zip(p, p[1:]) if b in signs and a not in signs and a != MARK}:
            signs -= bad
        some = re.escape("".join(sorted(signs)))
        one = f"[{alone}]|" if alone else ""
        two = f"|{MARK}*[{some}][^{MARK}{alone}]*" if some else ""
        return re.compile(f"{one}{MARK}*[^{MARK}{alone}{some}]+{two}|{MARK}+")

    def merged(self, text: str, until: int = 1) -> list[str]:
        """BPE merges of a short text, by the definition: best score first, leftmost first."""
        parts = list(text)
        while len(parts) > until:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def admissible(self, a: int, b: int) -> bool:
        """Whether the merges leave the boundary between pieces of ranks a and b alone: undo their
        last merges, later ones first, and see if one across the boundary would have come before."""
        limit = len(self.ranked)
        while True:
            across = self.rank.get(self.ranked[a] + self.ranked[b])
            if across is not None and across < limit:
                return False
            first_left = a > b
            for left in (first_left, not first_left):
                if left and self.halves[a][1] != a:
                    limit, a = a, self.halves[a][1]
                    break
                if not left and self.halves[b][0] != b:
                    limit, b = b + 1, self.halves[b][0]
                    break
            else:
                return True

    def advance(self, window: str, back: list[int], last: list[int], best: list[float]) -> None:
        """Extend the backpointers to the end of ``window``. back[n]: length of the last piece of the
        path to position n (0: no path); last[n]: its rank (-1: unknown character or none)."""
        if len(self.agree) > KEEP:
            self.agree.clear()
        (self.merge_on if self.bpe else self.sum_on)(window, back, last, best)

    def merge_on(self, window: str, back: list[int], last: list[int], best: list[float]) -> None:
        """``advance`` of a BPE model: the longest piece that the merges leave alone behind what leads to it."""
        top, agree = self.trie[1], self.agree
        for n in range(len(back), len(window) + 1):
            i = n - 1
            node = top.get(window[i])
            size, piece = 1, -1
            if node is not None and node[0] >= 0:
                found = []
                while True:
                    r, before = node
                    if r >= 0 and (back[i] or not i):
                        found.append((i, r))
                    if not i:
                        break
                    i -= 1
                    node = before.get(window[i])
                    if node is None:
                        break
                size = 0
                for i, r in reversed(found):
                    a = last[i]
                    if a >= 0:
                        known = agree.get(a << 24 | r)
                        if known is None:
                            known = agree[a << 24 | r] = self.admissible(a, r)
                        if not known:
                            continue
                    size, piece = n - i, r
                    break
            back.append(size)
            last.append(piece)

    def sum_on(self, window: str, back: list[int], last: list[int], best: list[float]) -> None:
        """``advance`` of a unigram model: the piece with the best sum of scores up to its end."""
        for n in range(len(back), len(window) + 1):
            node, i, options = self.trie, n, []
            while i:
                i -= 1
                node = node[1].get(window[i])
                if node is None:
                    break
                if node[0] >= 0 and (i == 0 or back[i]):
                    options.append((best[i] + self.score[self.ranked[node[0]]], n - i, node[0]))
            if not any(size == 1 for _, size, _ in options):
                options.append((best[n - 1] + self.worst, 1, -1))
            value, size, piece = max(options, key=lambda o: o[0])
            back.append(size)
            last.append(piece)
            best.append(value)

    def stream(self, blocks: Iterable[str]) -> Iterator[bytes]:
        """Ids of a text that comes in blocks, in parts, each as soon as it is certain."""
        window, back, last, best = "", [0], [-1], [0.0]
        for block in blocks:
            window += block
            self.advance(window, back, last, best)
            n = len(window)
            ends = {i for i in range(max(n - self.longest + 1, 0), n + 1) if back[i] or i == 0}
            while len(ends) > 1:
                i = max(ends)
                ends.remove(i)
                ends.add(i - back[i])
            if met := ends.pop():
                yield self.path(window, back, last, met)
                window, back, last, best = window[met:], [0, *back[met + 1 :]], last[met:], [x - best[met] for x in best[met:]] if not self.bpe else best
        yield self.path(window, back, last, len(window))

    def path(self, window: str, back: list[int], last: list[int], end: int) -> bytes:
        """Ids on the path to a position, as 32-bit integers."""
        out: list[int] = []
        number = self.number
        while end > 0:
            r = last[end]
            if r >= 0:
                out.append(number[r])
            elif self.fallback:
                out += [self.bytes[x] for x in reversed(window[end - 1].encode())]
            else:
                out.append(self.unknown)
            end -= back[end]
        out.reverse()
        return array("i", out).tobytes()

    def chunk_ids(self, chunk: str) -> bytes:
        if len(chunk) <= LONG:
            back, last, best = [0], [-1], [0.0]
            self.advance(chunk, back, last, best)
            return self.path(chunk, back, last, len(chunk))
        return b"".join(self.stream(chunk[i : i + LONG] for i in range(0, len(chunk), LONG)))

    def encode_new(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches, one after another, and how many each has."""
        texts = restored(names.to_pylist(), MARK)
        out = [b""] * len(texts)
        back, last, best, before = [0], [-1], [0.0], ""
        for i in sorted(range(len(texts)), key=texts.__getitem__):
            text = texts[i]
            if len(text) > LONG:
                out[i] = self.chunk_ids(text)
                continue
            same = 0
            for a, b in zip(text, before):
                if a != b:
                    break
                same += 1
            del back[same + 1 :], last[same + 1 :], best[same + 1 :]
            self.advance(text, back, last, best)
            out[i], before = self.path(text, back, last, len(text)), text
        return np.frombuffer(b"".join(out), np.int32), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return self.pattern.findall(text) if self.separable else [text]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), one after another, and how many each has."""
        odd = f"{MARK}|  |\r|^ " if self.lines else ""  # with marks in a row, or all
        return self.pool.ids_of(*dealt(texts, odd, self.chunks, "" if self.prefix else WHOLE))


class Surface:
    """What ids decode to; the part of a model that decoding needs."""

    def __init__(self, pieces: list[str], types: list[int], prefix: bool):
        self.prefix = prefix
        parts = [bytes([int(p[3:5], 16)]) if t == 6 else b"" if t == 3 else " ⁇ ".encode() if t == 2 else p.replace(MARK, " ").encode() for p, t in zip(pieces, types)]
        self.size = np.array([len(x) for x in parts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def decode_all(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """Texts of the lists that begin at ``starts`` (one more than lists) of ``ids``."""
        sizes = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        where = np.repeat(self.begin[ids] - ends[:-1], sizes) + np.arange(int(ends[-1]))
        raw, bounds = self.bytes[where].tobytes(), ends[starts].tolist()
        out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in out]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


@cache
def surface(path: str) -> Surface:
    pieces, _, types, _, prefix = contents(path)
    return Surface(pieces, types, prefix)


@cache
def model(path: str) -> Model:
    return Model(*contents(path))


def encoded(texts: pa.Array, path: str) -> pa.Array:
    """Lists of ids."""
    found = [model(path).encode_all(x) for x in slices(texts, GROUP)] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    flat, sizes = map(np.concatenate, zip(*found))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32()))


def decoded(lists: pa.Array, path: str) -> pa.Array:
    """Texts of lists of ids (null: empty)."""
    lists = lists.fill_null([])
    ids, starts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
    out: list[str] = []
    for i in range(0, len(starts) - 1, 64):
        own = starts[i : i + 65].astype(np.int64)
        out += surface(path).decode_all(ids[own[0] : own[-1]].astype(np.int64), own - own[0])
    return pa.array(out, pa.string())


def encode(df: DataFrame, path: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``df`` with a column ``to`` of ids (array<int>, empty for null texts); all its columns stay,
    but one that is named ``to`` gives way."""

    return derived(df, text_col, (), {to: ArrayType(IntegerType())}, lambda texts: [encoded(texts, path)])


def round_trip(df: DataFrame, path: str, text_col: str = "text", to: str = "ids", same: str = "round_trip") -> DataFrame:
    """``df`` without the text, with a column ``to`` of its ids and one, ``same``, of whether they decode to it
    (null: to an empty one), both made in one pass. Columns of these names give way."""

    def run(texts: pa.Array) -> list[pa.Array]:
        ids = encoded(texts, path)
        return [ids, pc.equal(decoded(ids, path), texts.fill_null(""))]

    return derived(df, text_col, (text_col,), {to: ArrayType(IntegerType()), same: BooleanType()}, run)


def decode(df: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with a column ``to``: the text of the ids (empty for null); a column of that name gives way."""

    return derived(df, ids_col, (), {to: StringType()}, lambda lists: [decoded(lists, path)])
