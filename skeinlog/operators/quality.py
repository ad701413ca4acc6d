"""Contract checks as queries: each returns what breaks a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.operators import ordered


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Count of rows breaking each rule, in one pass. A rule states what has to hold; NULL counts as broken."""
    broken = [F.count_if(~F.coalesce(holds, F.lit(False))).alias(name) for name, holds in rules.items()]
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules]))
    return rows.agg(*broken).select(pairs.alias("p")).select("p.*")


def ownership(events: DataFrame, refs: DataFrame, raw: DataFrame) -> DataFrame:
    """Dangling references, repeated event ids, references into another session."""
    joined = refs.join(raw.withColumnRenamed("session_id", "_raw_session"), "raw_id", "left")
    counts = joined.agg(F.count_if(F.col("_raw_session").isNull()).alias("dangling_ref"),
                        F.count_if(F.col("_raw_session") != F.col("session_id")).alias("foreign_session"))
    repeated = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        counts.select(F.lit("dangling_ref").alias("rule"), F.col("dangling_ref").alias("n")),
        counts.select(F.lit("foreign_session").alias("rule"), F.col("foreign_session").alias("n")),
        repeated.select(F.lit("duplicate_event_id").alias("rule"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def range_violations(ranges: DataFrame) -> DataFrame:
    """Ranges that start inside an earlier range of the file, by a running maximum of the ends.

    Ranges starting on the same line are put together first, so the order key is unique.
    """
    per_start = ranges.groupBy("file", "start").agg(F.max("end").alias("_reach"))
    swept = ordered.scan(per_start, ["file"], "start", _open=ordered.RunningMax(F.col("_reach"), inclusive=False))
    return ranges.join(swept.filter("_open >= start").select("file", "start"), ["file", "start"], "left_semi")


def digest(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Order-sensitive digest per session.

    Each row digest is bound to its place, and place-bound digests are added up as numbers, so the digest of
    a session needs no sorted list and two builds can be compared at any size.
    """
    fields = F.concat(*[F.concat(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"),
                                 F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    row = F.sha2(F.concat(F.col(order).cast("string"), F.lit("|"), fields), 256)
    parts = [F.sum(F.conv(F.substring(row, i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(1, 64, 8)]
    joined = F.concat_ws("-", *[F.col(f"p{i}").cast("string") for i in range(1, 64, 8)])
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"), *parts).select("session_id", "rows", F.sha2(joined, 256).alias("digest"))


def differing_sessions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sessions whose digest or row count differs between two builds, or that only one of them has."""
    r = right.select("session_id", F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    both = left.join(r, "session_id", "full_outer")
    return both.filter(~F.col("digest").eqNullSafe(F.col("_digest")) | ~F.col("rows").eqNullSafe(F.col("_rows"))).select("session_id")
