"""Projection tables: one row per event and layer, written for pruning by layer and session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows, not of compressed files, that one task sorts and writes.
SORTED_BYTES = 128 << 20


def _held(events: DataFrame) -> int:
    """Bytes that the rows take up when they are sorted: 16 a column, and the text."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in events.schema if isinstance(f.dataType, T.StringType)]
    return events.agg(F.sum(sum(texts, F.lit(16 * len(events.columns))).cast("bigint"))).first()[0] or 0


def write_projection(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partitioned by layer and range-placed by session and line, so files carry tight session bounds.

    The range split is over (session, line): a session with a third of the rows spans many files. Their number goes by the
    bytes of the rows: texts shrink much in a shuffle, and by its bytes a task would get too many of them.
    """
    parts = max(1, -(-_held(events) // SORTED_BYTES))
    (events.repartitionByRange(parts, "layer", "session_id", "line").sortWithinPartitions("session_id", "line")
     .write.mode(mode).partitionBy("layer").parquet(path))


def scan_projection(spark: SparkSession, path: str, layer: str, session_id: str | None = None, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path).filter(F.col("layer") == layer)
    if session_id is not None:
        rows = rows.filter(F.col("session_id") == session_id)
    return rows.select(*columns) if columns else rows


def replace_sessions(spark: SparkSession, path: str, fresh: DataFrame, target: str) -> None:
    """A new version of a projection where the rows of the given sessions are replaced.

    Written beside the old one; the caller publishes the new path. An interrupted write leaves the old one whole.
    """
    old = spark.read.parquet(path)
    kept = old.join(fresh.select("session_id").distinct(), "session_id", "left_anti")
    write_projection(kept.unionByName(fresh), target)


def raw_record(raw: DataFrame, session_id: str, line: int) -> DataFrame:
    """The exact source record of a raw id."""
    return raw.filter((F.col("session_id") == session_id) & (F.col("line") == line))
