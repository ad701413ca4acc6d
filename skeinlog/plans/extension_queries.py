"""Queries over the extension surface: source registry, hooks, SQL functions, table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.functions import sql_surface
from skeinlog.operators import search
from skeinlog.plans import bind
from skeinlog.plans.record_queries import claude_lines, codex_lines, deepseek_lines
from skeinlog.plans.registry import query
from skeinlog.session import table
from skeinlog.sources import files, registry


@query("udf_01_source_registry", bind.with_events("""
SELECT 'codex' AS source_kind, session_id, count(*) AS rows FROM ev WHERE NOT (role = 'user' AND k % 10 IN (8, 9)) GROUP BY 2
UNION ALL SELECT 'claude', session_id, count(*) FROM ev WHERE kind <> 'token_count' GROUP BY 2
UNION ALL SELECT 'deepseek', session_id, count(*) + 1 FROM ev GROUP BY 2"""))
def _(spark, root):
    raw = registry.all_raw({"codex": files.parsed(codex_lines(spark, root)), "claude": files.parsed(claude_lines(spark, root)), "deepseek": files.parsed(deepseek_lines(spark, root))})
    return raw.groupBy("source_kind", "session_id").agg(F.count(F.lit(1)).alias("rows"))


@query("flt_11_source_kind_guard", bind.with_events("""
SELECT 'claude' AS source_kind, session_id || ':raw:' || line AS raw_id FROM ev WHERE kind <> 'token_count'"""))
def _(spark, root):
    raw = registry.all_raw({"codex": files.parsed(codex_lines(spark, root)), "claude": files.parsed(claude_lines(spark, root))})
    return registry.of_kind(raw, "claude").select("source_kind", "raw_id")


@query("udf_02_query_hooks", bind.with_events("""
SELECT event_id, 'row' AS part, 1 AS events FROM ev WHERE layer = 'main' AND k % 2 = 0 UNION ALL SELECT CAST(k % 2 = 0 AS VARCHAR), 'facet', count(*) FROM ev GROUP BY 1"""))
def _(spark, root):
    """A family adds a row fact, a filter on it and a facet of it; the query layer applies all three."""
    spec = registry.SourceSpec("demo", "*.jsonl", lambda parsed: parsed, "codex",
                               row_facts=lambda rows: rows.withColumn("scripted", F.col("k") % 2 == 0),
                               row_filter=lambda params: F.col("scripted") if params.get("scripted") else F.lit(True),
                               facets={"scripted": lambda rows: rows.groupBy("scripted").agg(F.count(F.lit(1)).alias("events"))})
    events = bind.events(spark, root)
    rows = registry.select_rows(spec, events.filter(search.structural(search.Filters())), {"scripted": True})
    counted = registry.facet(spec, "scripted", events).select(F.col("scripted").cast("string").alias("event_id"), F.lit("facet").alias("part"), "events")
    return rows.select("event_id", F.lit("row").alias("part"), F.lit(1).cast("bigint").alias("events")).unionByName(counted)


@query("udf_03_sql_functions", bind.with_events(r"""
SELECT event_id, CAST(len(regexp_extract_all(search_text, '(?i)alpha1\s+needle')) AS INTEGER) AS hits, left(trim(regexp_replace(preview, '\s+', ' ', 'g')), 12) || '...' AS short,
  CASE WHEN input_tokens > 0 THEN cached_tokens * 10000 // input_tokens END AS bps FROM ev"""))
def _(spark, root):
    sql_surface.register(spark)
    bind.events(spark, root).createOrReplaceTempView("transcript_events")
    return spark.sql("""SELECT event_id, transcript_match_count(search_text, 'alpha1  NEEDLE') AS hits, transcript_preview(preview, 15) AS short,
        transcript_reuse_bps(input_tokens, cached_tokens) AS bps FROM transcript_events""")


@query("udf_04_table_function", """
SELECT o_orderkey, i AS pos, o_orderkey * 3 + i AS seq, 100 + CASE i WHEN 0 THEN 0 WHEN 1 THEN o_custkey ELSE o_custkey + 1 END AS time, 't' || i AS text
FROM (SELECT *, unnest(range(3)) AS i FROM orders)""")
def _(spark, root):
    sql_surface.register(spark)
    table(spark, root, "orders").createOrReplaceTempView("packed_orders")
    return spark.sql("""SELECT o_orderkey, CAST(m.pos AS BIGINT) AS pos, m.seq, m.time, m.text FROM packed_orders,
        LATERAL transcript_packed_members(o_orderkey * 3, 100L, array(o_custkey, 1L), array('t0', 't1', 't2')) m""")
