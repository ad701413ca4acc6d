"""Unions, de-duplication and conflict rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_project_lists(configured: DataFrame, discovered: DataFrame) -> DataFrame:
    """One row per root: a discovered row wins over a configured one, first-seen position kept."""
    both = discovered.withColumns({"priority": F.lit(0), "origin": F.lit("discovered")}).unionByName(
        configured.withColumns({"priority": F.lit(1), "origin": F.lit("configured")}))
    order = F.struct("priority", "pos")
    return both.groupBy("root").agg(F.min_by("stat", order).alias("stat"), F.min_by("origin", order).alias("origin"),
                                    F.min("pos").alias("first_seen"))


def union_layers(main: DataFrame, protocol: DataFrame, raw: DataFrame) -> DataFrame:
    parts = [df.withColumn("layer", F.lit(layer)) for df, layer in ((main, "main"), (protocol, "protocol"), (raw, "raw"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def resolve_duplicates(candidates: DataFrame) -> DataFrame:
    """Several files for one identity: equal fingerprints keep the canonical file, differing ones reject all.

    ``candidates``: identity, fingerprint, file, canonical (file name equals the identity).
    """
    order = F.struct((~F.col("canonical")).alias("c"), F.col("file"))
    return candidates.groupBy("identity").agg(
        F.count(F.lit(1)).alias("files"), F.min_by("file", order).alias("kept"),
        (F.min("fingerprint") != F.max("fingerprint")).alias("conflict"),
    ).withColumn("kept", F.when(~F.col("conflict"), F.col("kept")))


def first_per_fingerprint(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Repeated notifications collapse to their first copy."""
    return (
        rows.groupBy(*keys).agg(F.min_by(F.struct(order, *columns), order).alias("_r"), F.count(F.lit(1)).alias("copies"))
        .select(*keys, "_r.*", "copies")
    )


def demote_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose identity occurs more than once move to the protocol layer."""
    repeated = rows.filter(identified(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys, F.lit(True).alias("_dup"))
    return rows.join(repeated, keys, "left").withColumn("layer", F.when(F.col("_dup"), "protocol").otherwise("main")).drop("_dup")


def identified(keys: list[str]) -> Column:
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(key).isNotNull()
    return cond


def shared_lineage(records: DataFrame) -> DataFrame:
    """Pairs of sessions with a record id in common, each pair once, counted by shared ids.

    A record id that many sessions share would make every pair of them, so ids are first reduced to the
    sessions holding them and only the earliest holder is paired with the others: copies point to their
    origin, and the number of pairs stays linear in the input.
    """
    origin = records.groupBy("uuid").agg(F.min(F.struct("rank", "session_id")).alias("o"), F.count_distinct("session_id").alias("n")).filter("n > 1")
    return (
        records.select("uuid", "session_id").distinct().join(origin.select("uuid", F.col("o.session_id").alias("origin")), "uuid")
        .filter("session_id <> origin").groupBy("origin", "session_id").agg(F.count(F.lit(1)).alias("shared"))
    )
