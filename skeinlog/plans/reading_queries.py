"""Trajectory, folding and navigation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.functions import classify, vocabulary as V
from skeinlog.operators import trajectory
from skeinlog.plans import bind
from skeinlog.plans.registry import query
from skeinlog.plans.summary_queries import PLAN_SQL, quoted

LANES_SQL = f"""la AS (SELECT *, CASE WHEN kind IN ({quoted(V.INPUT_KINDS)}) THEN 'input' WHEN kind IN ({quoted(V.MODEL_KINDS)}) THEN 'model'
    WHEN kind IN ({quoted(V.TOOL_KINDS)}) THEN 'tools' WHEN role = 'assistant' THEN 'model' ELSE 'other' END AS lane, nullif(turn_id, '') AS rt
  FROM ev WHERE layer = 'main'),
ix AS (SELECT *, row_number() OVER w - 1 AS idx, lag(lane) OVER w AS prev_lane, count(*) OVER (PARTITION BY session_id) AS n,
    last_value(rt IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_turn
  FROM la WINDOW w AS (PARTITION BY session_id ORDER BY line)),
op AS (SELECT *, rt IS NOT NULL AND rt IS DISTINCT FROM prev_turn AS opens FROM ix),
gp AS (SELECT *, CASE WHEN lane = 'tools' THEN last_value(CASE WHEN lane = 'tools' AND (opens OR prev_lane IS DISTINCT FROM 'tools') THEN 'tools:' || event_id END IGNORE NULLS)
    OVER (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING) END AS group_id FROM op)"""


def projected(spark, root):
    return trajectory.project(bind.events(spark, root).filter("layer = 'main'"))


@query("win_10_tool_groups", bind.with_events(f"WITH {LANES_SQL} SELECT session_id, event_id, lane, group_id FROM gp"))
def _(spark, root):
    return trajectory.with_groups(projected(spark, root)).select("session_id", "event_id", "lane", "group_id")


@query("win_11_turn_boundaries", bind.with_events(f"WITH {LANES_SQL} SELECT session_id, rt AS turn_id, idx AS sequence_index FROM op WHERE opens"))
def _(spark, root):
    return trajectory.turn_boundaries(projected(spark, root))


@query("win_10_narrative_items", bind.with_events(f"""WITH {LANES_SQL}
SELECT session_id, line, 0 AS part, 'turn-boundary' AS item, rt AS ref FROM op WHERE opens
UNION ALL SELECT session_id, line, 1, CASE WHEN lane = 'other' THEN 'other' ELSE 'narrative' END, event_id FROM op WHERE lane <> 'tools'
UNION ALL SELECT session_id, min(line), 1, 'tool-group', group_id FROM gp WHERE group_id IS NOT NULL GROUP BY session_id, group_id"""))
def _(spark, root):
    return trajectory.narrative(trajectory.with_groups(projected(spark, root)))


@query("agg_14_tool_group_summary", bind.with_events(f"""WITH {LANES_SQL}
SELECT session_id, group_id, count(*) AS events, count(*) FILTER (WHERE status IN ('failed', 'declined') OR severity = 'error') AS failures,
  arg_min(event_id, line) AS first_event_id, arg_max(event_id, line) AS last_event_id,
  array_to_string(list_sort(list_distinct(list(nullif(tool_name, '')))), '|') AS tool_names, 'summary' AS display_state
FROM gp WHERE group_id IS NOT NULL GROUP BY 1, 2"""))
def _(spark, root):
    return trajectory.tool_groups(trajectory.with_groups(projected(spark, root)))


@query("agg_15_density_bins", bind.with_events(f"""WITH {LANES_SQL},
b AS (SELECT *, CAST(least(greatest(1, least(n, 12)) - 1, floor((idx + 0.5) / n * greatest(1, least(n, 12)))) AS BIGINT) AS bin FROM op)
SELECT session_id, bin, min(idx) AS start_index, max(idx) AS end_index, count(*) AS events, count(*) FILTER (WHERE lane = 'input') AS input,
  count(*) FILTER (WHERE lane = 'model') AS model, count(*) FILTER (WHERE lane = 'tools') AS tools, count(*) FILTER (WHERE lane = 'other') AS other FROM b GROUP BY 1, 2"""))
def _(spark, root):
    return trajectory.density(projected(spark, root), 12)


@query("win_23_nearest_event", bind.with_events(f"""WITH {LANES_SQL}
SELECT session_id, event_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY abs(idx - (0.37::DOUBLE * n - 0.5::DOUBLE)), idx) AS rn FROM op) WHERE rn = 1"""))
def _(spark, root):
    return trajectory.nearest_event(projected(spark, root), 0.37)


@query("flt_13_reading_categories", bind.with_events(f"""
WITH c AS (SELECT session_id, line, event_id, unnest(list_filter([
  CASE WHEN kind = 'user_message' THEN 'user_messages' END, CASE WHEN kind = 'assistant_message' THEN 'assistant_messages' END,
  CASE WHEN {PLAN_SQL} = 'update' THEN 'update_plan' END, CASE WHEN {PLAN_SQL} <> '' THEN 'plans' END,
  CASE WHEN kind = 'command' AND status = 'failed' THEN 'failed_commands' END, CASE WHEN kind = 'command' THEN 'commands' END,
  CASE WHEN kind = 'patch' AND status = 'success' THEN 'patch_applied' END, CASE WHEN kind = 'patch' AND status = 'failed' THEN 'patch_failed' END,
  CASE WHEN kind = 'patch' THEN 'patches' END,
  CASE WHEN severity <> 'normal' OR status = 'failed' OR kind IN ('error', 'abort', 'rollback', 'compaction') THEN 'errors_warnings' END,
  CASE WHEN kind = 'mcp_call' OR starts_with(tool_name, 'mcp__') THEN 'mcp_calls' END, CASE WHEN kind = 'web_search' THEN 'web_searches' END], lambda x: x IS NOT NULL)) AS category
  FROM ev WHERE layer = 'main')
SELECT session_id, event_id, category, lag(event_id) OVER w AS previous_event_id, lead(event_id) OVER w AS next_event_id FROM c
WINDOW w AS (PARTITION BY session_id, category ORDER BY line)"""))
def _(spark, root):
    return trajectory.navigation(bind.events(spark, root).filter("layer = 'main'")).drop("line")


CONDITIONS_SQL = {
    "searchHit": "contains(search_text, 'needle2')",
    "importantEvent": f"(kind IN ({quoted(V.IMPORTANT_KINDS)}) OR {PLAN_SQL} <> '' OR severity <> 'normal' OR status = 'failed')",
    "updatePlanCall": f"{PLAN_SQL} = 'update'",
    "userInputRequest": "(tool_name = 'request_user_input' OR subtype = 'request_user_input')",
    "readableReasoning": "(kind = 'reasoning' AND k % 2 = 1)",
    "failedStatus": "status = 'failed'", "errorSeverity": "severity = 'error'", "abnormalSeverity": "severity <> 'normal'",
    "reviewCommand": "false", "touchedFiles": "(file_a <> '' OR file_b <> '')",
}


def state_sql(profile) -> str:
    kinds, fallback, conditions = profile
    rank = {s: i for i, s in enumerate(V.DISPLAY_STATES)}
    parts = ["CASE kind " + " ".join(f"WHEN '{k}' THEN {rank[s]}" for k, s in kinds.items()) + " END"] if kinds else ["NULL"]
    parts += [f"CASE WHEN {CONDITIONS_SQL[c]} THEN {rank[s]} END" for c, s in conditions.items()]
    return f"(['hidden', 'collapsed', 'summary', 'expanded'])[coalesce(greatest({', '.join(parts)}), {rank[fallback]}) + 1]"


def folded(spark, root):
    return bind.events(spark, root).filter("layer = 'main'").withColumns({
        "has_readable_reasoning": F.col("k") % 2 == 1, "declared_requests": F.array().cast("array<string>")})



@query("prj_39_display_states", bind.with_events(
    "SELECT event_id, " + ", ".join(f"{state_sql(p)} AS {name}" for name, p in V.FOLDING_PROFILES.items()) + " FROM ev WHERE layer = 'main'"))
def _(spark, root):
    hit = F.contains("search_text", F.lit("needle2"))
    return folded(spark, root).select("event_id", *[classify.display_state(p, hit).alias(n) for n, p in V.FOLDING_PROFILES.items()])


@query("prj_40_display_overrides", bind.with_events(f"""
SELECT event_id, CASE WHEN k = 5 THEN 'expanded' ELSE {state_sql(V.FOLDING_PROFILES['debug'])} END AS state FROM ev WHERE layer = 'main'"""))
def _(spark, root):
    rows = folded(spark, root)
    chosen = rows.filter("k in (5, 6)").select("session_id", "event_id", F.when(F.col("k") == 5, "expanded").otherwise("sideways").alias("override"))
    return classify.with_overrides(rows, chosen, V.FOLDING_PROFILES["debug"]).select("event_id", "state")


_CUSTOM = ({"command": "summary", "patch": "expanded"}, "hidden", {"failedStatus": "summary", "touchedFiles": "collapsed"})
_EXTRA = ({"command": "collapsed", "error": "sideways"}, "collapsed", {"failedStatus": "expanded", "unknown": "hidden"})


@query("udf_05_custom_folding_rules", bind.with_events(f"""
SELECT event_id, {state_sql(({'command': 'collapsed', 'patch': 'expanded'}, 'collapsed', {'failedStatus': 'expanded', 'touchedFiles': 'collapsed'}))} AS state FROM ev WHERE layer = 'main'"""))
def _(spark, root):
    return folded(spark, root).select("event_id", classify.display_state(classify.merged_profile(_CUSTOM, _EXTRA), F.lit(False)).alias("state"))
