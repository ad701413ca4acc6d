"""Lookups between sessions that are plain equi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_related_title(sessions: DataFrame, column: str, name: str) -> DataFrame:
    """Title of the session another column points to, '' when there is none. Size decides how it is joined."""
    titles = sessions.select(F.col("session_id").alias(column), F.col("title").alias("_t"))
    return sessions.join(titles, column, "left").withColumn(name, F.coalesce("_t", F.lit(""))).drop("_t")


def workflow_evidence(runs: DataFrame, journal: DataFrame) -> DataFrame:
    """Runs whose journal holds one start and one result per agent. ``journal``: run_id, agent, entry."""
    per_agent = journal.groupBy("run_id", "agent").agg(
        F.count_if(F.col("entry") == "started").alias("s"), F.count_if(F.col("entry") == "result").alias("r"))
    per_run = per_agent.groupBy("run_id").agg(F.count(F.lit(1)).alias("agents"), F.bool_and((F.col("s") == 1) & (F.col("r") == 1)).alias("complete"))
    return runs.join(per_run, "run_id")
