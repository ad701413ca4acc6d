"""Vectorised word work on the bytes of many texts at once: word borders, word and shingle hashes, merged count tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.shared import SLICE_BYTES

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse among 64-bit numbers
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of a word from which on its hash is a cryptographic one: long words can be built that share a polynomial hash.
BUILT = 256


def powers(n: int, of: np.uint64) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), of, np.uint64), dtype=np.uint64)])[:n]


LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))


class Prefixes:
    """Hashes of stretches of a byte array by prefix sums; equal stretches hash alike wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTERS[data] * powers(len(data), BASE), dtype=np.uint64)])
        self.undo = powers(len(data) + 1, INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.undo[start]


def borders(data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte array."""
    inside = np.concatenate([[False], ~space[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def words_of(data: np.ndarray, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words; long arrays are taken in parts that end at white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data):
            gap = np.flatnonzero(SPACE[data[end:end + limit]])
            end = end + int(gap[0]) if len(gap) else min(end + limit, len(data))
            if len(gap):
                break
        part = data[at:end]
        start, stop = borders(part)
        hashes = mixed(Prefixes(part).of(start, stop) + (stop - start).astype(np.uint64))
        for i in np.flatnonzero(stop - start >= BUILT):
            hashes[i] = int.from_bytes(blake2b(part[start[i]:stop[i]].tobytes(), digest_size=8).digest(), "big")
        parts.append((start + at, stop + at, hashes))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one line feed between two, and where each text starts (one entry more than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    return np.frombuffer(b"\n".join(raw), np.uint8), starts


def word_runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and for each text where its words start (one entry more than texts)."""
    data, offsets = joined(texts)
    starts, _, hashes = words_of(data)
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on, as far as they go: the last ``size`` - 1 entries are not full."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(size):
        n = len(hashes) - k
        if n > 0:
            out[:n] += hashes[k:] * np.uint64(2 * pow(3, 20 + k, 1 << 61) + 1)
    return mixed(out)


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of fewer words is one shingle, none without words."""
    hashes, at = word_runs(texts)
    whole = shingles(hashes, size)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            yield np.unique(whole[a:b - size + 1])
        elif b > a:
            yield shingles(np.append(hashes[a:b], np.uint64(b - a)), size)[:1]
        else:
            yield np.zeros(0, np.uint64)


#: Cells of a count table that travel together.
CHUNK = 1 << 15


def packed(table: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    """A task's count table as rows (chunk, part, counts); chunks without counts are left out."""
    for k in range(0, len(table), CHUNK):
        some = table[k:k + CHUNK]
        if some.any():
            raw = zlib.compress(some.astype(np.int64).tobytes(), 1)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // CHUNK], pa.int32()), "part": pa.array([part], pa.int32()), "counts": pa.array([raw], pa.binary())})


PACKED = "chunk int, part int, counts binary"


def summed(rows: DataFrame, cells: int) -> np.ndarray:
    """The sum of all tasks' count tables, added up by chunk on the executors in two steps. ``cells`` bounds what returns."""
    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for chunk, part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.frombuffer(zlib.decompress(raw), np.int64)
                sums[chunk, part] = sums[chunk, part] + counts if (chunk, part) in sums else counts
        for (chunk, part), counts in sums.items():
            raw = zlib.compress(counts.tobytes(), 1)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "part": pa.array([part], pa.int32()), "counts": pa.array([raw], pa.binary())})

    some = rows.withColumn("part", F.pmod("part", F.lit(16))).repartition("chunk", "part").mapInArrow(add, PACKED)
    some = some.withColumn("part", F.lit(0)).repartition("chunk").mapInArrow(add, PACKED)
    out = np.zeros(cells, np.int64)
    for row in some.collect():
        counts = np.frombuffer(zlib.decompress(row.counts), np.int64)
        out[row.chunk * CHUNK:row.chunk * CHUNK + len(counts)] += counts
    return out
