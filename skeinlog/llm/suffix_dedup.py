"""Suffix-array dedup: bytes covered by long strings that an earlier document has, too.

Only suffixes that can share ``LENGTH`` bytes are sorted, and only by these bytes. A difference cover of the period picks
the sample positions: whatever two positions a shared string has, some shift below the period takes both to sample
positions, so both contain one sample string of ``LENGTH - period + 1`` bytes at the same distance. Sample strings that
occur in one document only rule out every suffix that holds none but such; they are the precomputed ranks that settle
most suffixes without a look at them. What is left is sorted one bucket at a time.

Texts are packed into blocks of about ``BLOCK`` bytes in a bucketed table; a block is what one task holds. A block sends,
for each bucket of hash values, the distinct hashes of its strings in rising order, as differences; a bucket merges what
all blocks sent, and answers each block with a bit for each hash. So neither a string that many documents share nor a hot
group of copies makes more than one entry for each block, and nothing but bits is joined back to the texts. Whole texts
are compared first, so that a copy sends no strings at all.

Buckets are ranges of hash values, not of leading bytes: equal strings meet as well, frequent beginnings don't make a
large bucket, and order inside a bucket matters to equality only. Hashes of the compared strings have 64 bits.

Defined cases: null text has no bytes. Texts shorter than ``LENGTH`` stay whole. Null ids count as larger than all others
and as equal to each other; rows of equal ids take nothing from each other. Columns other than doc_id and text are not
read.
"""

from __future__ import annotations

import uuid
import zlib
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.shared import sliced, written
from skeinlog.llm.words import Prefixes, mixed
from skeinlog.session import scratch_path

LENGTH, PERIOD = 50, 21
#: Bytes of a block, and hashes of a bucket, about.
BLOCK, BUCKET = 4 << 20, 2 << 20
NO_ID = (1 << 63) - 1


def difference_cover(period: int) -> list[int]:
    """The smallest set whose pairwise differences give every residue of the period, first in order."""
    from itertools import combinations
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            some = (0, *rest)
            if len({(a - b) % period for a in some for b in some}) == period:
                return list(some)
    return list(range(period))


def hashes_at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of ``length`` from the rising positions ``at``, part by part, so that memory stays small."""
    out = np.zeros(len(at), np.uint64)
    for low in range(0, len(data), BLOCK):
        a, b = np.searchsorted(at, [low, low + BLOCK])
        if a < b:
            out[a:b] = Prefixes(data[low:low + BLOCK + length]).of(at[a:b] - low, at[a:b] - low + length)
    return mixed(out)


class Block:
    """The texts of a block: their bytes, ids and offsets, without those that are copies of a smaller id's text."""

    def __init__(self, data: bytes, ids: bytes, sizes: bytes, copies: list[int]):
        self.data = np.frombuffer(data, np.uint8)
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.copy = np.zeros(len(self.ids), bool)
        self.copy[copies] = True

    def positions(self, length: int, cover: list[int] | None = None, period: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Positions from which ``length`` bytes stay in their text, and the number of that text; copies have none."""
        fits = np.flatnonzero((self.sizes >= length) & ~self.copy)
        room = self.sizes[fits] - length + 1  # positions of a text
        spans = -(-room // period)
        of = np.repeat(np.arange(len(fits), dtype=np.int32), spans)
        at = (np.arange(len(of)) - (np.cumsum(spans) - spans)[of]) * period
        if cover:
            at, of = (at[:, None] + np.array(cover)[None, :]).ravel(), np.repeat(of, len(cover))
            held = at < room[of]
            at, of = at[held], of[held]
        return at + self.start[fits][of], fits.astype(np.int32)[of]


def rising(hashes: np.ndarray) -> np.ndarray:
    """The order of the hashes, equal ones by place. Sorting numbers is far faster than sorting places by numbers, so each
    place takes the low bits of its hash; the few hashes that differ in those bits only are put right afterwards."""
    low = np.uint64(len(hashes).bit_length())
    lost = np.uint64(max(0, (int(hashes.max()).bit_length() if len(hashes) else 0) + int(low) - 64))
    order = ((hashes >> lost) << low) | np.arange(len(hashes), dtype=np.uint64)
    order.sort()
    order = (order & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    if lost:
        line = hashes[order]
        tops = line >> lost
        for top in np.unique(tops[1:][line[1:] < line[:-1]]):
            a, b = np.searchsorted(tops, top), np.searchsorted(tops, top, "right")
            order[a:b] = order[a:b][np.argsort(line[a:b], kind="stable")]
    return order


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Rising; by sorting, as numpy's own way goes by a hash table."""
    line = np.sort(hashes)
    return line[np.concatenate([[True], line[1:] != line[:-1]])] if len(line) else line


def grouped(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, for each entry its number among them, and the least and greatest id of each."""
    order = rising(hashes)
    line = hashes[order]
    new = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    which = np.empty(len(line), np.int64)
    which[order] = np.cumsum(new) - 1
    sorted_ids = ids[order]
    if not len(first):
        return line, which, sorted_ids, sorted_ids
    return line[first], which, np.minimum.reduceat(sorted_ids, first), np.maximum.reduceat(sorted_ids, first)


def planes(x: np.ndarray) -> bytes:
    """Unsigned numbers by significance: as many low bytes as the largest needs, the top one compressed."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    top = zlib.compress(raw[-1].tobytes(), 1)
    return bytes([width]) + len(x).to_bytes(4, "little") + raw[:-1].tobytes() + top


def unplaned(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:5], "little")
    raw = np.zeros((n, 8), np.uint8)
    cut = 5 + n * (width - 1)
    raw[:, :width - 1] = np.frombuffer(blob[5:cut], np.uint8).reshape(width - 1, n).T
    raw[:, width - 1] = np.frombuffer(zlib.decompress(blob[cut:]), np.uint8)
    return raw.reshape(-1).view("<u8").astype(np.uint64)


def sent(block: int, hashes: np.ndarray, low: np.ndarray | None, bits: int, buckets: int):
    """Rows (bucket, block, hashes, ids) of distinct rising hashes of ``bits`` bits; ids less the least of the row's."""
    shift = np.uint64(bits - (buckets - 1).bit_length())
    edges = np.searchsorted(hashes >> shift, np.arange(buckets + 1, dtype=np.uint64)) if buckets > 1 else np.array([0, len(hashes)])
    out = []
    for k in range(buckets):
        part = hashes[edges[k]:edges[k + 1]]
        if len(part):
            ids = None if low is None else low[edges[k]:edges[k + 1]]
            base = 0 if ids is None else int(ids.min())
            out.append((k, block, int(part[0]).to_bytes(8, "little") + planes(np.diff(part)), base, None if ids is None else planes((ids - base).astype(np.uint64))))
    if out:
        columns = zip(*out, strict=True)
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "block", "hashes", "base", "ids"])


SENT = "bucket int, block bigint, hashes binary, base bigint, ids binary"


def answers(rows: DataFrame) -> DataFrame:
    """Rows (block, bits): for each bucket's hashes of a block, whether another block has it, with a smaller id if ids are sent."""
    def merge(table: pa.Table) -> pa.Table:
        sizes, hashes, ids = [], [], []
        for raw, base, low in zip(table["hashes"].to_pylist(), table["base"].to_pylist(), table["ids"].to_pylist(), strict=True):
            steps = unplaned(raw[8:])
            part = np.concatenate([[np.uint64(int.from_bytes(raw[:8], "little"))], steps]).astype(np.uint64)
            hashes.append(np.cumsum(part, dtype=np.uint64))
            ids.append(unplaned(low).astype(np.int64) + base if low is not None else np.zeros(len(part), np.int64))
            sizes.append(len(part))
        _, which, least, _ = grouped(np.concatenate(hashes), np.concatenate(ids))
        if table["ids"][0].as_py() is None:
            flag = np.bincount(which)[which] > 1  # a block sends a hash once
        else:
            flag = least[which] < np.concatenate(ids)
        ends = np.cumsum(sizes)
        bits = [np.packbits(flag[e - n:e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "n": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary())})

    parts = rows.groupBy("bucket").applyInArrow(merge, "block bigint, bucket int, n int, bits binary")
    return parts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "bits"))).alias("answer"))


def told(answer: list[dict] | None, n: int) -> np.ndarray:
    """The bits of all buckets in order; a block that sent nothing got none."""
    parts = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]).astype(bool) for a in answer or ()]
    out = np.concatenate(parts) if parts else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError("an answer doesn't fit its block")
    return out


def _pack(docs: DataFrame) -> DataFrame:
    """Rows (block, data, ids, sizes, same): texts as UTF-8 bytes, one after the other, and the hash of each."""
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, limit=BLOCK):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            ids = np.array([NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            null = np.array([i is None for i in batch.column("doc_id").to_pylist()], np.uint8)
            row = [number, b"".join(raw), ids.tobytes(), null.tobytes(), np.array([len(r) for r in raw], np.int64).tobytes(), b"".join(md5(r).digest() for r in raw)]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds, strict=True)], ["block", "data", "ids", "null_ids", "sizes", "same"])
            number += 1

    return docs.select("doc_id", "text").mapInArrow(run, "block bigint, data binary, ids binary, null_ids binary, sizes binary, same binary")


def _bucketed(blocks: DataFrame, parts: int) -> DataFrame:
    """The blocks as a table bucketed by block in the shared folder, so that joins on it leave the texts where they are."""
    spark, name = blocks.sparkSession, f"blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(parts, "block").option("compression", "zstd").option("path", scratch_path(spark, "suffix-blocks")).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018 - resolved: the files outlast the name
    spark.sql(f"DROP TABLE {name}")
    return table


def _doc_hashes(blocks: DataFrame) -> DataFrame:
    """Rows (same, block, low): the least id of each distinct text of a block, for texts long enough to be removed."""
    def run(batches):
        for batch in batches:
            for block, ids, sizes, same in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "sizes", "same")), strict=True):
                long = np.frombuffer(sizes, np.int64) >= LENGTH
                low: dict[bytes, int] = {}
                for i, (doc, fits) in enumerate(zip(np.frombuffer(ids, np.int64).tolist(), long, strict=True)):
                    if fits:
                        key = same[16 * i:16 * i + 16]
                        low[key] = min(doc, low.get(key, NO_ID))
                yield pa.RecordBatch.from_arrays([pa.array([*low], pa.binary()), pa.array([block] * len(low), pa.int64()), pa.array([*low.values()], pa.int64())], ["same", "block", "low"])

    return blocks.select("block", "ids", "sizes", "same").mapInArrow(run, "same binary, block bigint, low bigint")


def _copies(blocks: DataFrame) -> DataFrame:
    """Rows (block, earlier): the hashes of its texts that another block has with a smaller id."""
    rows = _doc_hashes(blocks)
    least = rows.groupBy("same").agg(F.min("low").alias("least"), F.count("*").alias("n")).filter("n > 1").select("same", "least")
    return rows.join(least, "same").filter("least < low").groupBy("block").agg(F.collect_list("same").alias("earlier"))


def _block(row: dict) -> Block:
    ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
    earlier, low = set(row["earlier"] or ()), {}
    same = [row["same"][16 * i:16 * i + 16] for i in range(len(ids))]
    for key, doc in zip(same, ids.tolist(), strict=True):
        low[key] = min(doc, low.get(key, NO_ID))
    copies = [i for i, (key, doc) in enumerate(zip(same, ids.tolist(), strict=True)) if sizes[i] >= LENGTH and (key in earlier or doc > low[key])]
    return Block(row["data"], row["ids"], row["sizes"], copies)


def _sampled(block: Block, bits: int):
    cover = difference_cover(PERIOD)
    at, of = block.positions(LENGTH - PERIOD + 1, cover, PERIOD)
    return at, of, hashes_at(block.data, at, LENGTH - PERIOD + 1) >> np.uint64(64 - bits)


def _samples(block: Block, bits: int):
    at, of, hashes = _sampled(block, bits)
    return at, of, grouped(hashes, block.ids[of])


def _candidates(block: Block, answer: list[dict] | None, bits: int):
    """Positions of strings that hold a sample string of several documents, with hashes and the numbers of their texts."""
    at, of, (some, which, low, high) = _samples(block, bits)
    hit = (told(answer, len(some)) | (low < high))[which]
    at, of = at[hit], of[hit]
    size = len(block.data) + 1  # the string starts up to a period before the sample, in the same text
    first = np.maximum(at - (PERIOD - 1), block.start[of])
    mark = np.cumsum(np.bincount(first, minlength=size) - np.bincount(at + 1, minlength=size))
    at, of = block.positions(LENGTH)
    keep = mark[at] > 0
    at, of = at[keep], of[keep]
    return at, of, grouped(hashes_at(block.data, at, LENGTH), block.ids[of])


def _rows(batches, columns):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in columns}


KEPT = ["block", "data", "ids", "null_ids", "sizes", "same", "earlier"]


def removed_spans(size: int, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each byte of a text is covered by a string that starts at one of ``starts``."""
    edge = np.bincount(starts, minlength=size + length + 1)[:size + length + 1].astype(np.int64)
    edge[length:] -= np.bincount(starts, minlength=size + 1)[:size + 1]
    return np.cumsum(edge)[:size] > 0


def deduplicated(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256; with ``texts`` also ``kept``, the remaining bytes."""
    spark = docs.sparkSession
    blocks = _bucketed(_pack(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    bits = min(62, max(24, total.bit_length() + 9))
    power = lambda n: 1 << max(0, (int(n) // BUCKET).bit_length())
    cover = len(difference_cover(PERIOD)) / PERIOD
    buckets, later = power(total * cover), power(total / 4)
    copies = written(_copies(blocks), "suffix-copies")
    known = blocks.join(copies, "block", "left").select(*KEPT)

    def first(batches):
        for row in _rows(batches, KEPT):
            yield from sent(row["block"], distinct(_sampled(_block(row), bits)[2]), None, bits, buckets)

    shared = written(answers(known.mapInArrow(first, SENT)), "suffix-samples").withColumnRenamed("answer", "samples")
    known = known.join(shared, "block", "left")

    def second(batches):
        for row in _rows(batches, [*KEPT, "samples"]):
            some, _, low, _ = _candidates(_block(row), row["samples"], bits)[2]
            yield from sent(row["block"], some, low, 64, later)

    strings = written(answers(known.mapInArrow(second, SENT)), "suffix-strings").withColumnRenamed("answer", "strings")
    known = known.join(strings, "block", "left")
    extra = ", kept binary" if texts else ""

    def third(batches):
        for row in _rows(batches, [*KEPT, "samples", "strings"]):
            block = _block(row)
            at, of, (some, which, low, _) = _candidates(block, row["samples"], bits)
            starts = told(row["strings"], len(some))[which] | (block.ids[of] > low[which])
            at, of = at[starts], of[starts]
            edge = np.searchsorted(of, np.arange(len(block.ids) + 1))
            out = []
            for i, (doc, size, begin) in enumerate(zip(block.ids.tolist(), block.sizes.tolist(), block.start.tolist(), strict=True)):
                gone = np.full(size, True) if block.copy[i] else removed_spans(size, at[edge[i]:edge[i + 1]] - begin)
                left = block.data[begin:begin + size][~gone].tobytes()
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((None if row["null_ids"][i] else doc, size, int(gone.sum()), runs, sha256(left).hexdigest(), left))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][:6 if texts else 5]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:len(kinds)])

    return known.mapInArrow(third, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{extra}")
