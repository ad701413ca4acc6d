"""Streaming runs over the given tables, each read to its end; results equal the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.functions import numbers
from skeinlog.plans import bind
from skeinlog.plans.cache_queries import OBSERVATIONS_SQL, accounting_rows
from skeinlog.plans.registry import query
from skeinlog.session import scratch_path, table
from skeinlog.streaming import ingest, state


def event_stream(spark, root):
    """The events table as a stream of files, in the columns of the binding."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = table(spark, root, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)


def run_to_end(stream, spark, label):
    """Run a query over everything available into a table of the shared folder."""
    path = scratch_path(spark, label)
    q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, f"{label}-log"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(path)


def cache_stream(spark, root):
    rows = accounting_rows(spark, root, bind.bound_events(event_stream(spark, root)))
    rows = rows.withColumn("ms", numbers.epoch_ms(F.col("ts_text"))).drop("turn_id", "ts_text")
    return run_to_end(state.cache_observations(rows), spark, "stream-cache").filter("is_token")


@query("str_03_streaming_cache_state", bind.with_events(f"WITH {OBSERVATIONS_SQL} SELECT session_id, event_id, state, reuse_bps, previous_event_id, elapsed_ms FROM obs"))
def _(spark, root):
    return cache_stream(spark, root).select("session_id", "event_id", "state", "reuse_bps", "previous_event_id", "elapsed_ms")


@query("str_04_pending_closed_by_boundary")
def _(spark, root):
    from skeinlog.plans.lifecycle_queries import cell_rows
    batch = cell_rows(spark, root)
    folder = scratch_path(spark, "cells")
    batch.write.parquet(folder)
    stream = spark.readStream.schema(batch.schema).parquet(folder)
    return run_to_end(state.scripted_operations(stream), spark, "stream-cells").drop("late")


@query("str_05_late_rows_kept", bind.with_events(f"""
WITH {OBSERVATIONS_SQL} SELECT state, count(*) AS rows FROM obs WHERE state = 'unknown_or_non_monotonic_timestamp' GROUP BY 1"""))
def _(spark, root):
    late = cache_stream(spark, root).filter("state = 'unknown_or_non_monotonic_timestamp'")
    return late.groupBy("state").agg(F.count(F.lit(1)).alias("rows"))


@query("str_02_changed_prefix", "SELECT doc_id FROM documents WHERE doc_id % 9 = 0")
def _(spark, root):
    """Files whose accepted lines are no longer what they were."""
    from skeinlog.sources import files
    d = table(spark, root, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    now = files.line_digests(d.select("file", F.col("p").alias("line"), "text"))
    seen = now.select("file", "line", F.when((F.col("line") == 0) & (F.col("file") % 9 == 0), "old").otherwise(F.col("line_digest")).alias("line_digest"))
    return files.prefix_changes(now, seen).select(F.col("file").alias("doc_id"))


@query("str_01_incremental_ingest", """
SELECT count(*) AS lines, count(DISTINCT doc_id) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS revised FROM documents""")
def _(spark, root):
    """Documents as line files in three steps: a first load, files that grew, and files rewritten from the start."""
    folder, d = scratch_path(spark, "incoming"), table(spark, root, "documents").withColumn("part", F.col("doc_id") % 3)
    line = F.to_json(F.struct("doc_id", "text", F.col("revision").alias("revision")))

    def put(rows, revision, mode):
        rows.withColumn("revision", F.lit(revision)).select(line.alias("value"), "part").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").text(folder)
    taken = ingest.GrowingFiles(spark, folder, scratch_path(spark, "taken-in"), "*.txt")
    put(d.filter("part <> 2"), 0, "overwrite")
    taken.take_in(1)
    put(d.filter("part = 2"), 0, "append")
    taken.take_in(2)
    put(d.filter("part = 1"), 1, "overwrite")
    taken.take_in(3)
    taken.take_in(3)
    v = F.from_json("text", "doc_id bigint, text string, revision int")
    kept = taken.lines().join(ingest.listing(spark, folder, "*.txt").select("file"), "file", "left_semi").select(v.alias("v"))
    return kept.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("v.doc_id").alias("documents"), F.sum(F.length("v.text")).alias("characters"),
                    F.sum("v.revision").cast("bigint").alias("revised"))


@query("str_06_session_replacement", bind.with_events("SELECT session_id, count(*) AS rows FROM ev GROUP BY 1"))
def _(spark, root):
    """Sessions that arrive in three batches: an outdated generation of some, then the present one in two parts."""
    path, folder = scratch_path(spark, "stream-sessions"), scratch_path(spark, "session-batches")
    rows = bind.bound_events(table(spark, root, "events")).select("session_id", "line", "event_id", "kind")
    early = F.col("line") % 2 == 0
    for batch in (rows.filter(early).withColumn("generation", F.lit(0)), rows.filter(early).withColumn("generation", F.lit(1)), rows.filter(~early).withColumn("generation", F.lit(1))):
        batch.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("session_id string, line bigint, event_id string, kind string, generation int").option("maxFilesPerTrigger", 1).parquet(folder)
    stream = stream.select(*[F.col(c) for c in ("session_id", "line", "event_id", "kind", "generation")])
    stream.writeStream.foreachBatch(ingest.session_sink(path)).option("checkpointLocation", scratch_path(spark, "stream-sessions-log")).trigger(availableNow=True).start().awaitTermination()
    return ingest.current_sessions(spark, path).groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"))
