"""Session summaries, rankings, catalogues and row-local classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.functions import classify, numbers, text, vocabulary as V
from skeinlog.operators import aggregates, ordered
from skeinlog.plans import bind
from skeinlog.plans.registry import query
from skeinlog.session import table

PLAN_SQL = """CASE WHEN kind = 'proposed_plan' AND subtype = 'proposed_plan' AND tool_name = '' THEN 'artifact'
  WHEN kind = 'other_tool_call' AND subtype = 'update_plan' AND tool_name = 'update_plan' THEN 'update' ELSE '' END"""


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def counts_sql(family: str) -> str:
    protocol_issue = " OR (layer = 'protocol' AND (status = 'failed' OR severity = 'error'))" if family == "deepseek" else ""
    return f"""SELECT session_id, count(DISTINCT nullif(turn_id, '')) AS turns,
  count(*) FILTER (WHERE layer <> 'protocol' AND kind IN ('user_message', 'assistant_message')) AS messages,
  count(*) FILTER (WHERE layer <> 'protocol' AND kind = 'user_message') AS user_messages,
  count(*) FILTER (WHERE layer <> 'protocol' AND kind = 'assistant_message') AS assistant_messages,
  count(*) FILTER (WHERE layer <> 'protocol' AND kind = 'reasoning') AS reasoning,
  count(*) FILTER (WHERE layer <> 'protocol' AND kind IN ({quoted(V.TOOL_CALL_KINDS[family])})) AS tool_calls,
  count(*) FILTER (WHERE layer <> 'protocol' AND kind = 'command' AND status = 'failed') AS failed_commands,
  count(*) FILTER (WHERE (layer <> 'protocol' AND (status = 'failed' OR severity <> 'normal')){protocol_issue}) AS issue_events,
  count(*) FILTER (WHERE layer <> 'protocol' AND kind = 'patch') AS patches,
  count(*) FILTER (WHERE layer <> 'protocol' AND kind = 'compaction') AS compactions,
  count(*) FILTER (WHERE layer <> 'protocol' AND kind = 'abort') AS aborts,
  count(*) FILTER (WHERE layer <> 'protocol' AND kind = 'error') AS errors,
  count(*) FILTER (WHERE layer = 'protocol') AS protocol,
  count(*) FILTER (WHERE layer <> 'protocol' AND {PLAN_SQL} = 'artifact') AS plan_artifacts,
  count(*) FILTER (WHERE layer <> 'protocol' AND {PLAN_SQL} <> '') AS plan_events FROM ev GROUP BY 1"""


for _family in ("codex", "claude", "deepseek"):
    def _build(spark, root, family=_family):
        return aggregates.session_counts(bind.events(spark, root), family)
    query(f"agg_01_session_counts_{_family}", bind.with_events(counts_sql(_family)))(_build)


@query("agg_02_tool_usage", bind.with_events("""
SELECT session_id, tool_name, count(*) AS uses FROM ev WHERE layer <> 'protocol' AND tool_name <> '' GROUP BY 1, 2"""))
def _(spark, root):
    return aggregates.tool_usage(bind.events(spark, root)).select("session_id", "tool_name", "uses")


@query("agg_03_failed_commands", bind.with_events("""
SELECT session_id, event_id, preview, exit_code, position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line) AS position
  FROM ev WHERE layer <> 'protocol' AND kind = 'command' AND status = 'failed') WHERE position <= 100"""))
def _(spark, root):
    return aggregates.failed_commands(bind.events(spark, root)).select(
        "session_id", "event_id", "preview", "exit_code", F.col("position").cast("bigint").alias("position"))


@query("osl_04_slow_commands", bind.with_events("""
SELECT session_id, event_id, duration_ms, position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY duration_ms DESC, line) AS position
  FROM ev WHERE layer <> 'protocol' AND kind = 'command') WHERE position <= 25"""))
def _(spark, root):
    return aggregates.slow_commands(bind.events(spark, root)).select(
        "session_id", "event_id", "duration_ms", F.col("position").cast("bigint").alias("position"))


@query("agg_04_patched_files", bind.with_events("""
SELECT session_id, file, count(*) AS uses FROM (SELECT session_id, unnest([file_a, file_b]) AS file FROM ev WHERE kind = 'patch' AND layer <> 'protocol')
WHERE file <> '' GROUP BY 1, 2"""))
def _(spark, root):
    return aggregates.patched_files(bind.events(spark, root)).select("session_id", "file", "uses")


@query("agg_05_max_observed_tokens", bind.with_events("""
SELECT session_id, max(CASE WHEN subtype = '' THEN input_tokens END) AS max_observed FROM ev GROUP BY 1"""))
def _(spark, root):
    warning = (F.col("layer") == "protocol") & (F.col("subtype") == "")
    return aggregates.max_observed(bind.events(spark, root), warning)


@query("agg_06_response_usage", bind.with_events("""
WITH u AS (SELECT session_id, CAST(floor(line / 3) AS BIGINT) AS m, line, input_tokens, cached_tokens FROM ev WHERE kind = 'token_count'),
f AS (SELECT *, row_number() OVER (PARTITION BY session_id, m ORDER BY line) AS rn FROM u)
SELECT session_id, count(*) AS response_count, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens,
  CAST(sum(coalesce(cached_tokens, 0)) AS BIGINT) AS cache_read_tokens, max(coalesce(input_tokens, 0)) AS max_observed FROM f WHERE rn = 1 GROUP BY 1"""))
def _(spark, root):
    ev = bind.events(spark, root).filter("kind = 'token_count'")
    zero = F.lit(0).cast("bigint")
    rows = ev.select("session_id", "line", F.floor(F.col("line") / 3).cast("string").alias("message_id"),
                     F.coalesce("input_tokens", zero).alias("input_tokens"), zero.alias("output_tokens"),
                     zero.alias("cache_creation_tokens"), F.coalesce("cached_tokens", zero).alias("cache_read_tokens"))
    return aggregates.response_usage(rows).select("session_id", "response_count", "input_tokens", "cache_read_tokens", "max_observed")


@query("agg_07_stats_by_kind", bind.with_events("""
SELECT session_id, CASE WHEN layer = 'protocol' THEN 'protocol' ELSE 'timeline' END AS part,
  CASE WHEN layer = 'protocol' THEN subtype ELSE kind END AS name, count(*) AS events FROM ev GROUP BY 1, 2, 3"""))
def _(spark, root):
    return aggregates.stats_by_kind(bind.events(spark, root))


_CATALOGUE_SQL = """WITH v AS (SELECT layer, CASE WHEN layer = 'protocol' THEN coalesce(nullif(subtype, ''), kind) ELSE kind END AS value FROM ev)
SELECT layer, value, count(*) AS events FROM v WHERE value <> '' GROUP BY 1, 2"""


@query("agg_08_kind_catalogue", bind.with_events(_CATALOGUE_SQL))
def _(spark, root):
    return aggregates.kind_catalogue(bind.events(spark, root))


@query("agg_10_catalogue_merge", bind.with_events(_CATALOGUE_SQL))
def _(spark, root):
    return aggregates.merge_catalogues(aggregates.kind_catalogue(bind.events(spark, root), ["session_id"]))


@query("osl_06_catalogue_order", bind.with_events(f"""
WITH c AS ({_CATALOGUE_SQL}) SELECT layer, value, events, row_number() OVER (PARTITION BY layer ORDER BY events DESC, value) AS place FROM c"""))
def _(spark, root):
    counted = aggregates.kind_catalogue(bind.events(spark, root))
    by = ordered.Window.partitionBy("layer").orderBy(F.desc("events"), "value")
    return counted.withColumn("place", F.row_number().over(by).cast("bigint"))


@query("osl_08_kind_group_order", bind.with_events("""
WITH g(kind, kind_group, group_priority, kind_priority) AS (VALUES ('user_message', 'conversationPlanning', 10, 0),
  ('assistant_message', 'conversationPlanning', 10, 2), ('proposed_plan', 'conversationPlanning', 10, 3), ('command', 'commonWork', 20, 0),
  ('patch', 'commonWork', 20, 3), ('web_search', 'commonWork', 20, 4), ('mcp_call', 'commonWork', 20, 5), ('other_tool_call', 'commonWork', 20, 7),
  ('error', 'issuesRisks', 30, 0), ('reasoning', 'agentSystem', 80, 0), ('compaction', 'agentSystem', 80, 7)),
k AS (SELECT kind, count(*) AS events FROM ev GROUP BY 1)
SELECT k.kind, coalesce(kind_group, 'other') AS kind_group, events,
  row_number() OVER (ORDER BY coalesce(group_priority, 100), coalesce(kind_priority, 2147483647), k.kind) AS place FROM k LEFT JOIN g USING (kind)"""))
def _(spark, root):
    kinds = bind.events(spark, root).groupBy("kind").agg(F.count(F.lit(1)).alias("events"))
    grouped = kinds.join(F.broadcast(classify.kind_group_dimension(spark)), "kind", "left").select(
        "kind", F.coalesce("kind_group", F.lit("other")).alias("kind_group"), "events",
        F.coalesce("group_priority", F.lit(100)).alias("g"), F.coalesce("kind_priority", F.lit(2147483647)).alias("p"))
    return ordered.place(grouped, [F.asc("g"), F.asc("p"), F.asc("kind")]).drop("g", "p")


@query("osl_03_top_tools", bind.with_events("""
WITH t AS (SELECT session_id, tool_name, count(*) AS uses, min(line) AS f FROM ev WHERE layer <> 'protocol' AND tool_name <> '' GROUP BY 1, 2)
SELECT session_id, tool_name, uses, position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY uses DESC, f) AS position FROM t) WHERE position <= 5"""))
def _(spark, root):
    top = aggregates.top_per_session(aggregates.tool_usage(bind.events(spark, root)), "tool_name")
    return top.select("session_id", "tool_name", "uses", F.col("position").cast("bigint").alias("position"))


@query("osl_03_top_tools_by_name", bind.with_events("""
WITH t AS (SELECT session_id, tool_name, count(*) AS uses FROM ev WHERE layer <> 'protocol' AND tool_name <> '' GROUP BY 1, 2)
SELECT session_id, tool_name, uses, position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY uses DESC, tool_name) AS position FROM t) WHERE position <= 5"""))
def _(spark, root):
    top = aggregates.top_per_session(aggregates.tool_usage(bind.events(spark, root)), "tool_name", ties="tool_name")
    return top.select("session_id", "tool_name", "uses", F.col("position").cast("bigint").alias("position"))


@query("agg_11_project_catalogue", """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS cwd, length(html) AS bytes FROM pages)
SELECT 'w/' || cwd AS cwd, count(*) AS sessions, CAST(sum(bytes) AS BIGINT) AS bytes, max(page_id) AS updated_at FROM p GROUP BY 1""")
def _(spark, root):
    """Every session names its folder twice, with one kind of separator and with the other, and once with one at the end."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    cwds = F.array(F.concat(F.lit("w/"), host), F.concat(F.lit("w\\"), host), F.concat(F.lit("w/"), host, F.lit("/")))
    return aggregates.project_catalogue(table(spark, root, "pages").select(
        F.col("page_id").alias("session_id"), cwds.alias("cwds"), F.length("html").alias("bytes"), F.col("page_id").alias("updated_at")))


@query("agg_13_time_range", bind.with_events("""
SELECT session_id, coalesce(min(CASE WHEN k % 10 <> 0 THEN nullif(ts_text, '') END), '') AS started_at,
  coalesce(max(CASE WHEN k % 10 <> 0 THEN nullif(ts_text, '') END), '') AS updated_at FROM ev GROUP BY 1"""))
def _(spark, root):
    return aggregates.time_range(bind.events(spark, root), owned=F.col("k") % 10 != 0)


@query("agg_17_item_status_counts", """
SELECT o_custkey AS owner, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'in_progress' ELSE 'completed' END AS status, count(*) AS items
FROM orders GROUP BY 1, 2""")
def _(spark, root):
    o = table(spark, root, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed")
    return aggregates.item_status_counts(o.select(F.col("o_custkey").alias("owner"), status.alias("status")), ["owner"])


@query("agg_21_project_list_merge", """
WITH a AS (SELECT s_nationkey AS root, 0 AS priority, s_suppkey AS pos, s_acctbal AS stat FROM supplier
  UNION ALL SELECT c_nationkey, 1, c_custkey + 1000000000, 0 FROM customer)
SELECT CAST(root AS BIGINT) AS root, arg_min(stat, (priority, pos)) AS stat, arg_min(CASE priority WHEN 0 THEN 'discovered' ELSE 'configured' END, (priority, pos)) AS origin,
  min(pos) AS first_seen FROM a GROUP BY 1""")
def _(spark, root):
    from skeinlog.operators import setops
    discovered = table(spark, root, "supplier").select(F.col("s_nationkey").cast("bigint").alias("root"), F.col("s_suppkey").alias("pos"), F.col("s_acctbal").alias("stat"))
    configured = table(spark, root, "customer").select(F.col("c_nationkey").cast("bigint").alias("root"), (F.col("c_custkey") + 1000000000).alias("pos"), F.lit(0.0).alias("stat"))
    return setops.merge_project_lists(configured, discovered)


@query("agg_22_representative_lifecycle_row", bind.with_events("""
WITH r AS (SELECT session_id, CAST(floor(line / 40) AS BIGINT) AS call_id, line, CASE k % 5 WHEN 0 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 2 END AS rank, k % 5 AS m FROM ev)
SELECT session_id, call_id, arg_max(line, (rank, line)) AS line, CASE arg_max(m, (rank, line)) WHEN 0 THEN 'start' WHEN 1 THEN 'progress' WHEN 2 THEN 'progress' ELSE 'terminal' END AS phase
FROM r GROUP BY 1, 2"""))
def _(spark, root):
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("begin", "update", "delta", "end", "declined")]), (F.col("k") % 5 + 1).cast("int"))
    rows = bind.events(spark, root).select("session_id", F.floor(F.col("line") / 40).alias("call_id"), "line",
                                           F.concat(F.lit("exec_command_"), suffix).alias("payload_type"))
    r = aggregates.representative(rows, ["session_id", "call_id"], classify.lifecycle_dimension(spark), ["line"])
    return r.select("session_id", "call_id", "line", "phase")


@query("prj_05_logical_event", bind.with_conversations("""
SELECT event_id, kind, length(text) > 1600 AS has_long_output FROM cv"""))
def _(spark, root):
    c = bind.conversations(spark, root)
    return c.select("event_id", "kind", classify.has_long_output(text.truncate(F.col("text")), F.col("text")).alias("has_long_output"))


@query("prj_06_protocol_text_class", """
WITH t AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '<skill>' WHEN 1 THEN '<environment_context>' WHEN 2 THEN '# AGENTS.md instructions' WHEN 3 THEN '<image a>'
    WHEN 4 THEN '<permissions instructions>' WHEN 5 THEN '' ELSE '<user_shell_command>' END || html AS body, CASE WHEN page_id % 2 = 0 THEN 'developer' ELSE 'user' END AS role FROM pages)
SELECT page_id, CASE WHEN role = 'developer' THEN (CASE page_id % 7 WHEN 0 THEN 'skill_injection' WHEN 1 THEN 'environment_context' WHEN 2 THEN '' WHEN 4 THEN 'developer_permissions' ELSE 'meta_block' END)
  ELSE (CASE page_id % 7 WHEN 0 THEN 'skill_injection' WHEN 1 THEN 'environment_context' WHEN 2 THEN 'agents_instructions' WHEN 3 THEN 'image_wrapper' WHEN 6 THEN 'user_shell_command' ELSE 'meta_block' END) END AS subtype FROM t""")
def _(spark, root):
    heads = ["<skill>", "<environment_context>", "# AGENTS.md instructions", "<image a>", "<permissions instructions>", "", "<user_shell_command>"]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("page_id") % 7 + 1).cast("int"))
    role = F.when(F.col("page_id") % 2 == 0, "developer").otherwise("user")
    p = table(spark, root, "pages")
    return p.select("page_id", classify.protocol_text_class(F.concat(head, F.col("html")), role).alias("subtype"))


@query("prj_07_tool_kind", bind.with_events("""
WITH t AS (SELECT event_id, f.family, tool_name AS name FROM ev, (VALUES ('codex'), ('claude'), ('deepseek')) f(family) WHERE tool_name <> ''),
n AS (SELECT event_id, family, CASE WHEN family = 'codex' THEN name WHEN name IN ('exec_command', 'shell_command') THEN 'Bash' WHEN name = 'apply_patch' THEN 'MultiEdit' WHEN name = 'web_search' THEN 'WebFetch' ELSE name END AS tool_name FROM t)
SELECT event_id, family, tool_name, CASE WHEN family = 'deepseek' THEN CASE WHEN tool_name = 'Bash' THEN 'command' ELSE 'other_tool_call' END
  WHEN tool_name IN ('exec_command', 'shell_command', 'Bash') THEN 'command' WHEN tool_name IN ('apply_patch', 'MultiEdit') THEN 'patch' WHEN tool_name IN ('web_search', 'WebFetch') THEN 'web_search'
  WHEN starts_with(tool_name, 'mcp__') THEN 'mcp_call' ELSE 'other_tool_call' END AS tool_kind FROM n"""))
def _(spark, root):
    ev, name = bind.events(spark, root).filter("tool_name <> ''").select("event_id", "tool_name"), F.col("tool_name")
    block = F.when(name.isin("exec_command", "shell_command"), "Bash").when(name == "apply_patch", "MultiEdit").when(name == "web_search", "WebFetch").otherwise(name)
    calls = ev.withColumn("family", F.explode(F.array(*map(F.lit, ("codex", "claude", "deepseek"))))).withColumn("tool_name", F.when(F.col("family") == "codex", name).otherwise(block))
    return classify.with_tool_kind(calls, spark).select("event_id", "family", "tool_name", "tool_kind")


@query("prj_08_lifecycle_descriptor", bind.with_events("""
WITH w AS (SELECT event_id, (CASE k % 4 WHEN 0 THEN 'exec_command' WHEN 1 THEN 'patch_apply' WHEN 2 THEN 'hook' ELSE 'collab_close' END) || (CASE k % 3 WHEN 0 THEN '_begin' WHEN 1 THEN '_end' ELSE '_declined' END) AS payload_type, k FROM ev)
SELECT event_id, payload_type, CASE k % 4 WHEN 0 THEN 'command' WHEN 1 THEN 'patch' WHEN 2 THEN 'hook' ELSE 'collaboration' END AS family,
  CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS rank, k % 4 = 2 OR (k % 4 = 3 AND k % 3 = 1) AS standalone
FROM w WHERE NOT (k % 4 = 3 AND k % 3 = 2)"""))
def _(spark, root):
    stem = F.element_at(F.array(*[F.lit(x) for x in ("exec_command", "patch_apply", "hook", "collab_close")]), (F.col("k") % 4 + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("_begin", "_end", "_declined")]), (F.col("k") % 3 + 1).cast("int"))
    rows = bind.events(spark, root).select("event_id", F.concat(stem, suffix).alias("payload_type"))
    dim = classify.lifecycle_dimension(spark)
    return rows.join(F.broadcast(dim), rows["payload_type"] == dim["wire_type"]).select("event_id", "payload_type", "family", "rank", "standalone")


@query("prj_09_tool_registries", bind.with_events("""
SELECT event_id, tool_name, CASE tool_name WHEN 'exec_command' THEN 'Exec command' WHEN 'shell_command' THEN 'Shell command' WHEN 'apply_patch' THEN 'Apply patch'
  WHEN 'update_plan' THEN 'Plan update' WHEN 'request_user_input' THEN 'User input' ELSE '' END AS title,
  CASE WHEN tool_name IN ('exec_command', 'shell_command') THEN 'command' WHEN tool_name = 'apply_patch' THEN 'patch' ELSE 'other_tool_call' END AS ordinary_kind FROM ev WHERE tool_name <> ''"""))
def _(spark, root):
    ev = bind.events(spark, root).filter("tool_name <> ''").select("event_id", "tool_name")
    return ev.join(F.broadcast(classify.tool_dimension(spark)), "tool_name", "left").select(
        "event_id", "tool_name", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("ordinary_kind", F.lit("other_tool_call")).alias("ordinary_kind"))


@query("prj_10_plan_facet", bind.with_events(f"SELECT event_id, {PLAN_SQL} AS plan_category FROM ev"))
def _(spark, root):
    return bind.events(spark, root).select(
        "event_id", classify.plan_category(F.col("kind"), F.col("subtype"), F.col("tool_name")).alias("plan_category"))


@query("prj_11_call_status", bind.with_events("""
WITH g AS (SELECT session_id, CAST(floor(line / 30) AS BIGINT) AS call_id, bool_or(status = 'declined') AS d, bool_or(status = 'failed') AS f, bool_or(status = 'success') AS s,
  max(exit_code) AS x FROM ev GROUP BY 1, 2)
SELECT session_id, call_id, CASE WHEN d THEN 'declined' WHEN f OR (x IS NOT NULL AND x <> 0) THEN 'failed' WHEN s OR x = 0 THEN 'success' ELSE 'incomplete' END AS status FROM g"""))
def _(spark, root):
    g = bind.events(spark, root).groupBy("session_id", F.floor(F.col("line") / 30).alias("call_id")).agg(
        F.bool_or(F.col("status") == "declined").alias("d"), F.bool_or(F.col("status") == "failed").alias("f"),
        F.bool_or(F.col("status") == "success").alias("s"), F.max("exit_code").alias("x"))
    return g.select("session_id", "call_id", classify.call_status(F.col("d"), F.col("f"), F.col("x"), F.col("s")).alias("status"))


@query("prj_13_session_summary", bind.with_events("""
WITH s AS (SELECT session_id, count(*) AS raw_event_count, count(*) FILTER (WHERE layer = 'protocol') AS protocol_count,
    count(*) FILTER (WHERE kind = 'command' AND status = 'failed') AS failed_command_count, least(100, count(*) FILTER (WHERE kind = 'command' AND status = 'failed')) AS failed_commands_listed FROM ev GROUP BY 1),
t AS (SELECT session_id, tool_name, count(*) AS uses, min(line) AS f FROM ev WHERE tool_name <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY uses DESC, f) AS rn FROM t),
a AS (SELECT session_id, string_agg(tool_name || ':' || uses, ',' ORDER BY rn) AS top_tools FROM r WHERE rn <= 5 GROUP BY 1)
SELECT s.session_id, s.raw_event_count, s.protocol_count, s.failed_command_count, s.failed_commands_listed, coalesce(top_tools, '') AS top_tools,
  coalesce(p.session_id, '') AS parent_session_id FROM s LEFT JOIN a ON a.session_id = s.session_id
  LEFT JOIN s p ON p.session_id = CAST(CAST(s.session_id AS BIGINT) // 10 AS VARCHAR) AND CAST(s.session_id AS BIGINT) >= 10"""))
def _(spark, root):
    from skeinlog.operators import sessions
    return sessions.summary_rows(bind.events(spark, root), parent=F.when(
        F.col("session_id").cast("bigint") >= 10, F.floor(F.col("session_id").cast("bigint") / 10).cast("string")))


@query("prj_18_session_title", bind.with_conversations(r"""
WITH u AS (SELECT *, trim(string_split(text, chr(10))[1]) AS l FROM cv WHERE role = 'user'),
c AS (SELECT session_id, line, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '^[-*+]\s+', ''), '</?[^>]+>', ' ', 'g'), '[*_`~]+', '', 'g'), '\s+', ' ', 'g')) AS t FROM u),
d AS (SELECT session_id, line, CASE WHEN length(t) <= 120 THEN t ELSE substr(t, 1, 117) || '...' END AS title FROM c WHERE t <> '')
SELECT session_id, arg_min(title, line) AS title FROM d GROUP BY 1"""))
def _(spark, root):
    from skeinlog.operators import sessions
    return sessions.titles(bind.conversations(spark, root))


@query("prj_38_trajectory_lane", bind.with_events(f"""
SELECT event_id, CASE WHEN kind IN ({quoted(V.INPUT_KINDS)}) THEN 'input' WHEN kind IN ({quoted(V.MODEL_KINDS)}) THEN 'model'
  WHEN kind IN ({quoted(V.TOOL_KINDS)}) THEN 'tools' WHEN role = 'user' THEN 'input' WHEN tool_name <> '' THEN 'tools' WHEN role = 'assistant' THEN 'model' ELSE 'other' END AS lane FROM ev"""))
def _(spark, root):
    c = F.col
    return bind.events(spark, root).select(
        "event_id", classify.trajectory_lane(c("kind"), c("subtype"), c("role"), c("tool_name")).alias("lane"))


@query("scl_01_truncate", r"""
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE substr(t, 1, 237) || '...' END AS preview,
  CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 397) || '...' END AS verbatim
FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def _(spark, root):
    d = table(spark, root, "documents")
    return d.select("doc_id", text.truncate(F.col("text")).alias("preview"), text.truncate_verbatim(F.col("text"), 400).alias("verbatim"))


@query("scl_02_iso_timestamp", bind.with_events("""
SELECT event_id, CASE WHEN k % 10 = 3 THEN '' ELSE ts_text END AS iso, CASE WHEN k % 10 = 3 OR ts_text = '' THEN NULL ELSE epoch_ms(CAST(ts_text AS TIMESTAMP)) END AS ms FROM ev"""))
def _(spark, root):
    raw = F.when(F.col("k") % 10 == 3, F.lit("not a time")).otherwise(F.col("ts_text"))
    return bind.events(spark, root).select("event_id", numbers.iso_text(raw).alias("iso"), numbers.epoch_ms(raw).alias("ms"))


@query("scl_03_number_formats", """
WITH x AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)
SELECT id, CAST(round(v + (v % 1000) * 1000000 / 1e6) AS BIGINT) AS ms,
  CASE WHEN v <= 0 THEN '' WHEN v < 1024 THEN v || ' B' WHEN v < 10240 THEN printf('%.1f KB', v / 1024.0) WHEN v < 1048576 THEN CAST(floor(v / 1024.0 + 0.5) AS BIGINT) || ' KB' ELSE printf('%.1f MB', v / 1048576.0) END AS bytes,
  CASE WHEN v < 1000 THEN v || ' ms' WHEN v < 60000 THEN (CASE WHEN v % 1000 = 0 THEN CAST(v // 1000 AS VARCHAR) ELSE printf('%.1f', v / 1000.0 + CASE WHEN v % 250 = 0 THEN 0.001 ELSE 0 END) END) || ' s'
    ELSE (CASE WHEN v % 60000 = 0 THEN CAST(v // 60000 AS VARCHAR) ELSE printf('%.1f', v / 60000.0 + CASE WHEN v % 15000 = 0 THEN 0.001 ELSE 0 END) END) || ' min' END AS elapsed,
  format('{:,}', v) AS grouped FROM x""")
def _(spark, root):
    v = F.floor("o_totalprice")
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("id"), numbers.duration_ms(v / 1000, (v % 1000) * 1000000).alias("ms"),
        numbers.byte_text(v).alias("bytes"), numbers.elapsed_text(v).alias("elapsed"), numbers.grouped_text(v).alias("grouped"))


@query("scl_04_first_and_unique", bind.with_events("""
SELECT event_id, coalesce(nullif(tool_name, ''), nullif(role, ''), kind) AS first_value,
  array_to_string(list_filter([tool_name, role, kind], lambda x, i: x <> '' AND list_position([tool_name, role, kind], x) = i), '|') AS unique_values FROM ev"""))
def _(spark, root):
    ev = bind.events(spark, root)
    return ev.select("event_id", text.first_non_empty(F.col("tool_name"), F.col("role"), F.col("kind")).alias("first_value"),
                     F.array_join(text.unique_non_empty(F.array("tool_name", "role", "kind", "kind", F.lit("  "))), "|").alias("unique_values"))


@query("scl_06_safe_integer", bind.with_events("""
SELECT event_id, input_tokens - 50000 AS v, CASE WHEN input_tokens - 50000 >= 0 THEN input_tokens - 50000 END AS safe FROM ev"""))
def _(spark, root):
    v = F.col("input_tokens") - 50000
    return bind.events(spark, root).select("event_id", v.alias("v"), numbers.safe_count(v).alias("safe"))


@query("scl_07_xml_tags", r"""
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
  trim(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)) AS heading,
  CASE WHEN len(regexp_extract_all(html, '<article>')) = 1 AND len(regexp_extract_all(html, '</article>')) = 1 THEN trim(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), ' ' || chr(10) || chr(9) || chr(13)) END AS strict_body,
  regexp_extract('<p class="x">' || html, '^<([A-Za-z][\w:-]*)(?:\s|>)', 1) AS leading FROM pages""")
def _(spark, root):
    p, html = table(spark, root, "pages"), F.col("html")
    return p.select("page_id", text.xml_tag(html, "title").alias("title"), text.xml_tag(html, "h1", True).alias("heading"),
                    text.strict_tag(html, "article").alias("strict_body"),
                    text.leading_tag_name(F.concat(F.lit('<p class="x">'), html)).alias("leading"))


@query("scl_10_humanize", bind.with_events("""
WITH w AS (SELECT event_id, unnest(string_split(kind, '_')) AS w, generate_subscripts(string_split(kind, '_'), 1) AS i FROM ev)
SELECT event_id, string_agg(upper(w[1]) || w[2:], ' ' ORDER BY i) AS label FROM w GROUP BY 1"""))
def _(spark, root):
    return bind.events(spark, root).select("event_id", text.humanize(F.col("kind")).alias("label"))
