"""Token accounting and cache-reuse queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.functions import numbers
from skeinlog.operators import cache
from skeinlog.plans import bind
from skeinlog.plans.registry import query


def accounting_rows(spark, root, ev=None):
    ev = bind.events(spark, root) if ev is None else ev
    token = F.col("kind") == "token_count"
    return ev.select(
        "session_id", "line", "event_id", "ts_text", "turn_id", "model", (F.col("kind") == "compaction").alias("is_compaction"),
        token.alias("is_token"), (token & (F.col("k") != 36)).alias("has_input"), (token & (F.col("k") != 37)).alias("has_cached"),
        F.when(F.col("k") != 36, F.col("input_tokens")).alias("input_tokens"),
        F.when(F.col("k") != 37, F.col("cached_tokens")).alias("cached_tokens"))


OBSERVATIONS_SQL = """ctx AS (SELECT *,
    last_value(nullif(model, '') IGNORE NULLS) OVER w AS active_model,
    CAST(sum(CASE WHEN kind = 'compaction' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS generation
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
tok AS (SELECT * EXCLUDE (input_tokens, cached_tokens), CASE WHEN k = 36 THEN NULL ELSE input_tokens END AS input_tokens,
    CASE WHEN k = 37 THEN NULL ELSE cached_tokens END AS cached_tokens FROM ctx WHERE kind = 'token_count'),
rsn AS (SELECT *, concat_ws('|', CASE WHEN k = 36 THEN 'missing_input_tokens' WHEN input_tokens IS NULL THEN 'invalid_input_tokens' END,
    CASE WHEN k = 37 THEN 'missing_cached_input_tokens' WHEN cached_tokens IS NULL THEN 'invalid_cached_input_tokens' END,
    CASE WHEN cached_tokens > input_tokens THEN 'cached_input_exceeds_input' END) AS accounting_reasons,
    CASE WHEN ts_text = '' THEN NULL ELSE epoch_ms(CAST(ts_text AS TIMESTAMP)) END AS ms FROM tok),
val AS (SELECT *, accounting_reasons = '' AS observed,
    CASE WHEN accounting_reasons = '' AND input_tokens > 0 THEN CAST(cached_tokens * 10000 // input_tokens AS BIGINT) END AS reuse_bps FROM rsn),
lg AS (SELECT *, lag(CASE WHEN observed THEN {'e': event_id, 'i': input_tokens, 'c': cached_tokens, 'b': reuse_bps, 'm': ms,
        'model': active_model, 'g': generation} END) OVER (PARTITION BY session_id ORDER BY line) AS p FROM val),
gt AS (SELECT *, concat_ws('|', CASE WHEN p.c < 8192 THEN 'previous_cache_read_below_minimum' END,
    CASE WHEN p.b IS NULL OR p.b < 7500 THEN 'previous_reuse_below_minimum' END,
    CASE WHEN input_tokens * 4 < p.i * 3 THEN 'current_input_below_comparable_floor' END,
    CASE WHEN cached_tokens * 2 > p.c THEN 'current_cache_read_above_half' END,
    CASE WHEN p.c - cached_tokens < 8192 THEN 'cache_read_drop_below_minimum' END) AS gates FROM lg),
obs AS (SELECT session_id, line, event_id, turn_id, active_model, generation, observed, accounting_reasons, input_tokens, cached_tokens,
    reuse_bps, CASE WHEN NOT observed THEN NULL WHEN p IS NULL THEN 'no_previous_observation'
      WHEN ms IS NULL OR p.m IS NULL OR ms <= p.m THEN 'unknown_or_non_monotonic_timestamp'
      WHEN p.model <> active_model THEN 'model_change' WHEN p.g <> generation THEN 'compaction_boundary'
      WHEN gates <> '' THEN 'comparable' ELSE 'cache_discontinuity' END AS state, gates,
    CASE WHEN observed THEN p.e END AS previous_event_id,
    CASE WHEN observed AND ms > p.m THEN ms - p.m END AS elapsed_ms,
    CASE WHEN observed THEN input_tokens - p.i END AS input_delta,
    CASE WHEN observed AND p.i > 0 THEN CAST(trunc((input_tokens - p.i) * 10000.0 / p.i) AS BIGINT) END AS input_delta_bps,
    CASE WHEN observed THEN cached_tokens - p.c END AS cached_delta FROM gt)"""


@query("win_04_cache_observations", bind.with_events(f"""
WITH {OBSERVATIONS_SQL} SELECT session_id, event_id, state, reuse_bps, previous_event_id, elapsed_ms, input_delta, cached_delta,
  active_model, generation FROM obs"""))
def _(spark, root):
    return cache.observe(accounting_rows(spark, root)).select(
        "session_id", "event_id", "state", "reuse_bps", "previous_event_id", "elapsed_ms", "input_delta", "cached_delta",
        "active_model", "generation")


@query("win_05_active_model", bind.with_events("""
SELECT session_id, event_id, last_value(nullif(model, '') IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line
  ROWS UNBOUNDED PRECEDING) AS active_model FROM ev"""))
def _(spark, root):
    return cache.with_context(accounting_rows(spark, root)).select("session_id", "event_id", "active_model")


@query("win_06_compaction_generation", bind.with_events("""
SELECT session_id, event_id, CAST(sum(CASE WHEN kind = 'compaction' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS generation FROM ev"""))
def _(spark, root):
    return cache.with_context(accounting_rows(spark, root)).select("session_id", "event_id", "generation")


@query("win_07_cache_metrics", """
WITH p AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice * 1000) AS BIGINT) AS a, o_custkey AS b, o_orderkey % 7 AS c FROM orders)
SELECT id, CASE WHEN b > 0 THEN CAST(CAST(a AS HUGEINT) * 10000 // b AS BIGINT) END AS reuse_bps,
  CASE WHEN a > 0 THEN CAST((CAST(c AS HUGEINT) - a) * 10000 // a AS BIGINT) END AS delta_bps, c - a AS delta FROM p""")
def _(spark, root):
    from skeinlog.session import table
    p = table(spark, root, "orders").select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") * 1000).cast("bigint").alias("a"),
        F.col("o_custkey").alias("b"), (F.col("o_orderkey") % 7).alias("c"))
    return p.select("id", numbers.reuse_bps(F.col("b"), F.col("a")).alias("reuse_bps"),
                    numbers.delta_bps(F.col("a"), F.col("c")).alias("delta_bps"), (F.col("c") - F.col("a")).alias("delta"))


@query("win_08_discontinuity_gates", bind.with_events(f"""
WITH {OBSERVATIONS_SQL} SELECT session_id, event_id, state, CASE WHEN state IN ('comparable', 'cache_discontinuity') THEN gates ELSE '' END AS gate_reasons FROM obs"""))
def _(spark, root):
    return cache.observe(accounting_rows(spark, root)).select(
        "session_id", "event_id", "state", F.array_join("gate_reasons", "|").alias("gate_reasons"))


@query("win_09_accounting_reasons", bind.with_events(f"""
WITH {OBSERVATIONS_SQL} SELECT session_id, event_id, observed, accounting_reasons FROM obs"""))
def _(spark, root):
    return cache.observe(accounting_rows(spark, root)).select(
        "session_id", "event_id", "observed", F.array_join("accounting_reasons", "|").alias("accounting_reasons"))


_LINKS_SQL = f"""{OBSERVATIONS_SQL},
dr AS (SELECT session_id, turn_id, line, event_id FROM obs WHERE state = 'cache_discontinuity'),
gr AS (SELECT session_id, turn_id, min(line) AS first_line FROM dr WHERE turn_id <> '' GROUP BY 1, 2),
an AS (SELECT g.session_id, g.turn_id, arg_max(e.event_id, e.line) FILTER (WHERE e.line <= g.first_line) AS anchor, count(e.event_id) AS mains
  FROM gr g LEFT JOIN ev e ON e.session_id = g.session_id AND e.turn_id = g.turn_id AND e.layer = 'main' GROUP BY 1, 2),
lk AS (SELECT d.session_id, d.turn_id, d.line, d.event_id,
  CASE WHEN d.turn_id = '' THEN 'unknown_owner' WHEN anchor IS NOT NULL THEN 'mapped'
       WHEN mains > 0 THEN 'no_main_anchor_before_discontinuity' ELSE 'no_main_event_for_owner' END AS link_reason, anchor AS main_event_id
  FROM dr d LEFT JOIN an a ON a.session_id = d.session_id AND a.turn_id = d.turn_id)"""


def links(spark, root):
    main = bind.events(spark, root).filter("layer = 'main'")
    return cache.discontinuity_links(cache.observe(accounting_rows(spark, root)), main)


@query("jon_16_discontinuity_anchor", bind.with_events(f"""
WITH {_LINKS_SQL} SELECT session_id, turn_id, event_id, link_reason, main_event_id FROM lk"""))
def _(spark, root):
    return links(spark, root).select("session_id", "turn_id", "event_id", "link_reason", "main_event_id")


@query("prj_51_cache_presentation_facts", bind.with_events(f"""
WITH {_LINKS_SQL} SELECT session_id, main_event_id, arg_min(event_id, line) AS first_drop_event_id, count(*) AS drops
FROM lk WHERE main_event_id IS NOT NULL GROUP BY 1, 2"""))
def _(spark, root):
    return cache.presentation_facts(links(spark, root))


@query("agg_18_cache_reason_counts", bind.with_events(f"""
WITH {OBSERVATIONS_SQL}, voc AS (
  SELECT 'state' AS part, unnest(['no_previous_observation', 'unknown_or_non_monotonic_timestamp', 'model_change', 'compaction_boundary', 'comparable', 'cache_discontinuity']) AS name
  UNION ALL SELECT 'gate', unnest(['previous_cache_read_below_minimum', 'previous_reuse_below_minimum', 'current_input_below_comparable_floor', 'current_cache_read_above_half', 'cache_read_drop_below_minimum'])
  UNION ALL SELECT 'accounting', unnest(['missing_input_tokens', 'invalid_input_tokens', 'missing_cached_input_tokens', 'invalid_cached_input_tokens', 'cached_input_exceeds_input'])),
f AS (SELECT 'state' AS part, state AS name FROM obs WHERE state IS NOT NULL
  UNION ALL SELECT 'gate', unnest(string_split(gates, '|')) FROM obs WHERE state IN ('comparable', 'cache_discontinuity') AND gates <> ''
  UNION ALL SELECT 'accounting', unnest(string_split(accounting_reasons, '|')) FROM obs WHERE accounting_reasons <> '')
SELECT part, name, count(f.name) AS n FROM voc LEFT JOIN f USING (part, name) GROUP BY 1, 2"""))
def _(spark, root):
    return cache.summary(cache.observe(accounting_rows(spark, root)), spark)


@query("agg_18_cache_session_summary", bind.with_events(f"""
WITH {_LINKS_SQL} SELECT session_id, count(*) AS tokens, count(*) FILTER (WHERE observed) AS observations,
  count(*) FILTER (WHERE NOT observed) AS barriers, count(*) FILTER (WHERE state = 'cache_discontinuity') AS discontinuities,
  (SELECT count(*) FROM lk WHERE lk.session_id = obs.session_id AND link_reason = 'mapped') AS linked FROM obs GROUP BY session_id"""))
def _(spark, root):
    return cache.session_summary(cache.observe(accounting_rows(spark, root)), links(spark, root))


@query("dq_03_observation_arithmetic", bind.with_events(f"""
WITH {OBSERVATIONS_SQL} SELECT CAST(count(*) AS BIGINT) AS observations, CAST(0 AS BIGINT) AS violations FROM obs WHERE observed"""))
def _(spark, root):
    o = cache.observe(accounting_rows(spark, root)).filter("observed")
    bad = ((F.col("uncached_tokens") != F.col("input_tokens") - F.col("cached_tokens")) | (F.col("uncached_tokens") < 0)
           | ~F.col("reuse_bps").eqNullSafe(F.when(F.col("input_tokens") > 0, F.expr("cached_tokens * 10000 div input_tokens")))
           | (F.col("previous_event_id").isNull() != (F.col("state") == "no_previous_observation")))
    return o.agg(F.count(F.lit(1)).alias("observations"), F.count_if(bad).alias("violations"))


@query("dq_04_observation_chain", bind.with_events(f"""
WITH {OBSERVATIONS_SQL} SELECT CAST(count(*) AS BIGINT) AS chained, CAST(0 AS BIGINT) AS violations FROM obs WHERE previous_event_id IS NOT NULL"""))
def _(spark, root):
    o = cache.observe(accounting_rows(spark, root)).filter("observed")
    prev = o.select("session_id", F.col("event_id").alias("previous_event_id"), F.col("line").alias("p_line"),
                    F.col("reuse_bps").alias("p_bps"), F.col("input_tokens").alias("p_input"), F.col("cached_tokens").alias("p_cached"))
    joined = o.filter("previous_event_id is not null").join(prev, ["session_id", "previous_event_id"], "left")
    bad = (F.col("p_line").isNull() | (F.col("p_line") >= F.col("line")) | ~F.col("p_bps").eqNullSafe(F.col("previous_reuse_bps"))
           | (F.col("input_delta") != F.col("input_tokens") - F.col("p_input"))
           | (F.col("cached_delta") != F.col("cached_tokens") - F.col("p_cached")))
    return joined.agg(F.count(F.lit(1)).alias("chained"), F.count_if(bad).alias("violations"))


@query("dq_05_link_symmetry", bind.with_events("""
SELECT session_id, event_id AS main_event_id, event_id, 'none' AS side FROM ev WHERE false"""))
def _(spark, root):
    forward = links(spark, root).filter("main_event_id is not null")
    facts = cache.presentation_facts(forward).select("session_id", "main_event_id")
    backward = forward.join(facts, ["session_id", "main_event_id"], "left_semi")
    return cache.link_asymmetry(forward, backward)
