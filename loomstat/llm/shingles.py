"""Word shingles of texts: their hashes, all at once, and the majority of their bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Shingles hashed at a time, and bytes of text taken together.
CHUNK, GROUP = 1 << 16, 1 << 20
PRIMES = tuple(map(np.uint64, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)))
#: A byte's bits spread over the eight bytes of a word.
LANES = (((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)


def bit_majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half of the 64-bit ``hashes``."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    lanes = LANES[hashes.view(np.uint8).reshape(-1, 8)]
    for at in range(0, n, 255):  # a lane holds a count of up to 255
        counts += lanes[at : at + 255].sum(0).view(np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def xxh64(data: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of ``data``. Slices under 32 bytes are hashed side by side."""
    from xxhash import xxh64_intdigest

    def rotated(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint64(by) | x >> np.uint64(64 - by)

    padded = data + bytes(8)
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    raw = np.frombuffer(padded, np.uint8)
    p1, p2, p3, p4, p5 = PRIMES
    acc = np.uint64((seed + int(p5)) & 0xFFFFFFFFFFFFFFFF) + sizes.astype(np.uint64)
    for lane in range(3):
        at = np.flatnonzero((sizes >= 8 * lane + 8) & (sizes < 32))
        k = rotated(eight[starts[at] + 8 * lane] * p2, 31) * p1
        acc[at] = rotated(acc[at] ^ k, 27) * p1 + p4
    at = np.flatnonzero(sizes & 4)
    k = (eight[starts[at] + (sizes[at] & -8)] & np.uint64(0xFFFFFFFF)) * p1
    acc[at] = rotated(acc[at] ^ k, 23) * p2 + p3
    for byte in range(3):
        at = np.flatnonzero((sizes & 3) > byte)
        k = raw[starts[at] + (sizes[at] & -4) + byte].astype(np.uint64) * p5
        acc[at] = rotated(acc[at] ^ k, 11) * p1
    acc = (acc ^ acc >> np.uint64(33)) * p2
    acc = (acc ^ acc >> np.uint64(29)) * p3
    acc ^= acc >> np.uint64(32)
    for i in np.flatnonzero(sizes >= 32).tolist():
        acc[i] = xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]], seed)
    return acc


def shingle_hashes(texts: list[bytes], words: int = 3, seed: int = 42) -> list[np.ndarray]:
    """The XXH64 of all ``words``-word shingles of each text, repeats included.

    A text of fewer words is one shingle; one without words has none."""
    lines = [b" ".join(t.lower().split()) for t in texts]  # on bytes: A-Z only, and exactly \x20 \x09-\x0D
    data = b"\n".join(lines)
    bounds = np.cumsum([0] + [len(x) + 1 for x in lines])
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    where = np.searchsorted(spaces, bounds)
    starts, sizes, counts = [], [], []
    for i, line in enumerate(lines):
        own = spaces[where[i] : where[i + 1]]
        n = max(len(own) + 2 - words, 1) if line else 0
        if n:
            first = np.concatenate(([bounds[i]], own[: n - 1] + 1))
            last = np.concatenate((own[words - 1 :], [bounds[i + 1] - 1]))[-n:]
            starts.append(first)
            sizes.append(last - first)
        counts.append(n)
    if not starts:
        return [np.zeros(0, np.uint64)] * len(texts)
    first, size = np.concatenate(starts), np.concatenate(sizes)
    hashes = np.concatenate([xxh64(data, first[k : k + CHUNK], size[k : k + CHUNK], seed) for k in range(0, len(first), CHUNK)])
    ends = np.cumsum(counts)
    return [hashes[e - n : e] for e, n in zip(ends.tolist(), counts)]


def each_hashes(column: pa.Array, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The shingle hashes of each text of a binary column (null: none)."""
    group: list[bytes] = []
    size = 0
    for x in column:
        group.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
        size += len(group[-1])
        if size >= GROUP:
            yield from shingle_hashes(group, words, seed)
            group, size = [], 0
    yield from shingle_hashes(group, words, seed)
