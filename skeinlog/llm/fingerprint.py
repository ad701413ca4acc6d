"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the ``k`` smallest distinct hashes of a text's five-word shingles. Sketches of parts merge into the sketch
of the whole: sort, drop repeats, keep the k smallest. Fewer than k hashes are the whole set, and then every estimate is
exact. Written as text: URL-safe base64 of the hashes in rising order, eight bytes each, most significant byte first.

Defined cases: null text counts as empty; empty texts and texts without words have the empty sketch, which is like
another empty one (1.0) and unlike all others (0.0). A text of fewer than five words is one shingle. In the ring of
documents, ids descend, null ids come last, equal ids are ordered by text; a single document follows itself. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.shared import sliced
from skeinlog.llm.words import shingle_sets

WORDS, K = 5, 128
#: Most blocks of neighbouring ids; a block streams through one task, so its size is no matter of memory.
BLOCKS = 10_000


def sketches(texts: list[str | None], k: int = K) -> list[np.ndarray]:
    return [s[:k] for s in shingle_sets(texts, WORDS)]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard index: the share of the union's bottom k that both have."""
    union = merged(a, b, k)
    if not len(union):
        return 1.0
    return float((np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)).mean())


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first text's shingles that the second has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merged(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.urlsafe_b64encode(a.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.urlsafe_b64decode(text), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Per row: doc_id and the fingerprint of its text."""
    def run(batches):
        for batch in sliced(batches):
            found = [to_text(s) for s in sketches(batch.column("text").to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many leading characters of the following one, or all of it."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _ring(docs: DataFrame) -> DataFrame:
    """Rows (block, guest, doc_id, text), sorted: each block holds neighbouring ids, then the rows its last one looks at.

    Only the heads of the blocks, ``BLOCKS`` ids at most, pass the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = min(BLOCKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    cuts = rows.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    splits = [-float("inf"), *sorted({*cuts} or {0.0}), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket", handleInvalid="keep")
    last = len(splits)
    placed = cut.transform(rows.withColumn("_at", F.col("doc_id").cast("double"))).withColumn(
        "block", F.when(F.col("doc_id").isNull(), last).otherwise(last - 1 - F.col("_bucket")).cast("int"))
    heads = sorted(placed.groupBy("block").agg(F.max("doc_id").alias("head")).collect())
    guests = [(h.head, heads[i - 1].block) for i, h in enumerate(heads)]
    looks = spark.createDataFrame(guests, "head bigint, to int")
    both = placed.join(F.broadcast(looks), placed["doc_id"].eqNullSafe(looks["head"]), "left").select(
        "doc_id", "text", F.explode(F.when(F.col("to").isNull(), F.array(F.struct("block", F.lit(False).alias("guest")))).otherwise(
            F.array(F.struct("block", F.lit(False).alias("guest")), F.struct(F.col("to").alias("block"), F.lit(True).alias("guest"))))).alias("at"))
    both = both.select("at.block", "at.guest", "doc_id", "text")
    return both.repartition(parts, "block").sortWithinPartitions("block", "guest", F.col("doc_id").desc_nulls_last(), "text")


def digests(docs: DataFrame, k: int = K) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and how like they and the next document's are."""
    names = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
             "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def run(batches):
        waiting = None  # the last row seen, whose next one is not known yet
        for batch in sliced(batches):
            blocks, guests, ids, texts = (c.to_pylist() for c in batch.columns)
            found = sketches(texts, k)
            rows, out = [waiting, *zip(blocks, guests, ids, texts, found, strict=True)], []
            for row, after in zip(rows, rows[1:], strict=False):
                if row and not row[1]:
                    out.append((row, after))
            waiting = rows[-1]
            changed = [edited(row[3], after[3]) for row, after in out]
            size, at = 0, 0
            new: list[np.ndarray] = []
            for i, text in enumerate(changed):  # the edited texts again in slices
                size += len(text)
                if size > 2 << 20 or i + 1 == len(changed):
                    new += sketches(changed[at:i + 1], k)
                    size, at = 0, i + 1
            columns = zip(*((row[2], len(row[3]), sha256(text.encode()).hexdigest(), to_text(row[4]), to_text(sketch), resemblance(row[4], sketch, k),
                             resemblance(row[4], after[4], k)) for (row, after), text, sketch in zip(out, changed, new, strict=True)), strict=True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, names.values(), strict=True)], [*names])

    return _ring(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
