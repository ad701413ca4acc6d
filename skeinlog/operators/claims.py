"""Events from raw rows by claims: every event states which rows it wants, each row picks one event, the rest stand alone.

A unit is a raw row or one block of it (block -1 for a whole row). A claim names a unit, an event and the event's kind; one
unit of an event is its lead. Of all claims on a unit the one of least priority wins, then the least event id: one aggregate
over the claims. An event that does not win its lead does not happen, and the units it won fall back. A unit without an
event becomes one of its own, by its own kind. So every unit is in exactly one event, whatever the claims say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = ["session_id", "line", "block"]
CLAIM = [*UNIT, "event_id", "kind", "priority", "lead"]


def event_name(line: Column, block: Column) -> Column:
    return F.concat_ws(":", F.lit("event"), line.cast("string"), block.cast("string"))


def stated(rows: DataFrame, line: Column, block: Column, lead_line: Column, lead_block: Column, kind: str, priority: int) -> DataFrame:
    """Claims on (line, block) by the events whose leads are (lead_line, lead_block); ``rows`` hold session_id."""
    return rows.select("session_id", line.cast("bigint").alias("line"), block.cast("int").alias("block"), event_name(lead_line, lead_block).alias("event_id"),
                       F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), ((line == lead_line) & (block == lead_block)).alias("lead"))


def resolved(units: DataFrame, claims: DataFrame) -> DataFrame:
    """``units`` (session_id, line, block, kind) with ``event_id``, the event's ``kind`` and ``part`` (lead, member, own)."""
    won = claims.groupBy(*UNIT).agg(F.min(F.struct("priority", "event_id", "lead", "kind")).alias("_w"))
    won = won.select(*UNIT, "_w.event_id", "_w.lead", F.col("_w.kind").alias("_kind"))
    happens = won.filter("lead").select("session_id", "event_id")
    held = won.join(happens, ["session_id", "event_id"], "left_semi")
    met = units.join(held, UNIT, "left")
    part = F.when(F.col("event_id").isNull(), "own").when(F.col("lead"), "lead").otherwise("member")
    return met.select(*[c for c in units.columns if c != "kind"], F.coalesce("event_id", event_name(F.col("line"), F.col("block"))).alias("event_id"),
                      F.coalesce("_kind", "kind").alias("kind"), part.alias("part"))


def events(placed: DataFrame) -> DataFrame:
    """One row for each event: its first line, kind, layer, and how many units it has."""
    layer = F.when(F.col("kind") == "protocol", "protocol").otherwise("main")
    return placed.groupBy("session_id", "event_id").agg(
        F.min("line").alias("line"), F.min_by("kind", F.struct(F.col("part") == "member", "line", "block")).alias("kind"), F.count("*").alias("units")).withColumn("layer", layer)
