"""Queries over transcript records. The records are derived from the given tables by Spark and read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.functions import classify, records as R, search_json, text
from skeinlog.operators import aggregates, pairing, quality, sessions
from skeinlog.plans import bind
from skeinlog.plans.registry import query
from skeinlog.session import materialize, scratch_path, table
from skeinlog.sources import claude, codex, deepseek, files, sinks, layout

def session_file():
    return F.concat(F.lit("sessions/"), "session_id", F.lit(".jsonl"))


def _json(column):
    return F.to_json(column)


def landed(lines):
    """Derived transcripts as a table of lines in the shared folder, where the sources find them."""
    return materialize(lines, "records")


def codex_lines(spark, root):
    """One rollout line per event: calls, messages, accounting rows, command ends, typed items, broken and blank lines."""
    ev, k = bind.events(spark, root), F.col("k")
    call = F.concat(F.lit("call_"), (k % 20).cast("string"))

    def line(kind, payload):
        return _json(F.struct(F.col("ts_text").alias("timestamp"), F.lit(kind).alias("type"), payload.alias("payload")))
    request = line("response_item", F.struct(F.lit("function_call").alias("type"), call.alias("call_id"), F.col("tool_name").alias("name"),
                                             F.concat(F.lit('{"cmd":"ls '), k.cast("string"), F.lit('"}')).alias("arguments")))
    spoken = line("response_item", F.struct(F.lit("message").alias("type"), F.col("role"), F.array(
        F.struct(F.lit("output_text").alias("type"), F.col("preview").alias("text")), F.struct(F.lit("output_text").alias("type"), F.lit("tail").alias("text"))).alias("content")))
    usage = F.struct(F.col("input_tokens"), F.col("cached_tokens").alias("cached_input_tokens"), (F.col("input_tokens") + 5).alias("total_tokens"))
    limits = F.struct(F.struct((k / 2).alias("used_percent"), F.lit(300).alias("window_minutes"), (F.lit(1700000000) + k).alias("resets_at")).alias("primary"))
    accounting = line("event_msg", F.struct(F.lit("token_count").alias("type"), F.col("turn_id"), F.when(k % 2 == 0, F.struct(F.lit(None).cast("bigint").alias("input_tokens"),
        F.lit(None).cast("bigint").alias("cached_input_tokens"), F.lit(7).cast("bigint").alias("total_tokens"), usage.alias("last_token_usage"))).otherwise(
        F.struct(F.col("input_tokens"), F.col("cached_tokens").alias("cached_input_tokens"), F.lit(7).cast("bigint").alias("total_tokens"), F.lit(None).cast(
            "struct<input_tokens:bigint,cached_input_tokens:bigint,total_tokens:bigint>").alias("last_token_usage"))).alias("info"), limits.alias("rate_limits")))
    ended = line("event_msg", F.struct(F.lit("exec_command_end").alias("type"), call.alias("call_id"), F.array(F.lit("bash"), F.lit("-lc"), F.concat(F.lit("run "), k.cast("string"))).alias("command"),
                                       (k % 3).alias("exit_code"), F.struct((k % 5).alias("secs"), (k * 1000000).alias("nanos")).alias("duration")))
    typed = line("event_msg", F.struct(F.lit("item_completed").alias("type"), F.col("session_id").alias("thread_id"), F.struct(
        F.lit("CommandExecution").alias("type"), F.concat(F.lit("item_"), k.cast("string")).alias("id"), F.lit("completed").alias("status"), F.array(F.lit("ls")).alias("command")).alias("item")))
    asked = line("event_msg", F.struct(F.lit("user_message").alias("type"), F.col("preview").alias("message"), F.col("turn_id")))
    body = (F.when(F.col("tool_name") != "", request).when(F.col("role") == "assistant", spoken).when(F.col("kind") == "token_count", accounting)
            .when((F.col("kind") == "error") & (k % 4 == 0), typed).when(F.col("kind") == "error", ended)
            .when(k % 10 == 9, '{"type": "event_msg", ').when(k % 10 == 8, "   ").otherwise(asked))
    return landed(ev.select("session_id", session_file().alias("file"), "line", body.alias("text"), "k", "kind"))


def codex_raw(spark, root):
    return codex.to_raw(files.parsed(codex_lines(spark, root)))


@query("src_02_rollout_read", bind.with_events("""
SELECT session_id || ':raw:' || line AS raw_id, CASE WHEN tool_name <> '' OR role = 'assistant' THEN 'response_item' ELSE 'event_msg' END AS record_type,
  CASE WHEN tool_name <> '' THEN 'function_call' WHEN role = 'assistant' THEN 'message' WHEN kind = 'token_count' THEN 'token_count' WHEN kind = 'error' THEN 'exec_command_end' ELSE 'user_message' END AS payload_type
FROM ev WHERE NOT (role = 'user' AND k % 10 IN (8, 9))"""))
def _(spark, root):
    return codex_raw(spark, root).select("raw_id", "record_type", "payload_type")


@query("src_17_read_errors", bind.with_events("""
SELECT 'sessions/' || session_id || '.jsonl' AS file, line, 'malformed_json' AS code FROM ev WHERE role = 'user' AND k % 10 = 9"""))
def _(spark, root):
    return files.read_errors(files.parsed(codex_lines(spark, root))).select("file", "line", "code")


@query("prj_01_rollout_projection", bind.with_events("""
SELECT session_id || ':raw:' || line AS raw_id, ts_text, role, CASE WHEN kind = 'token_count' OR role = 'user' THEN turn_id ELSE '' END AS turn_id,
  CASE WHEN tool_name <> '' OR (kind = 'error' AND k % 4 <> 0) THEN 'call_' || (k % 20) WHEN kind = 'error' THEN 'item_' || k ELSE '' END AS call_id,
  CASE WHEN kind = 'error' AND k % 4 = 0 THEN 'shell_command' ELSE tool_name END AS tool_name,
  CASE WHEN kind = 'error' AND k % 4 <> 0 THEN k % 3 END AS exit_code, CASE WHEN kind = 'error' AND k % 4 <> 0 THEN (k % 5) * 1000 + k ELSE 0 END AS duration_ms,
  CASE WHEN kind = 'error' AND k % 4 <> 0 THEN 'bash -lc run ' || k ELSE '' END AS command_text, CASE WHEN role = 'assistant' THEN preview || chr(10) || 'tail' WHEN role = 'user' THEN preview ELSE '' END AS message_text
FROM (SELECT * REPLACE (CASE WHEN role = 'user' THEN '' ELSE role END AS role), role AS r0 FROM ev) e WHERE NOT (r0 = 'user' AND k % 10 IN (8, 9))""".replace(
    "CASE WHEN kind = 'token_count' OR role = 'user' THEN turn_id", "CASE WHEN kind = 'token_count' OR r0 = 'user' THEN turn_id").replace("WHEN role = 'user' THEN preview ELSE", "WHEN r0 = 'user' THEN preview ELSE")))
def _(spark, root):
    return codex_raw(spark, root).select("raw_id", "ts_text", "role", "turn_id", "call_id", "tool_name", "exit_code", "duration_ms", "command_text", "message_text")


@query("prj_04_typed_items", bind.with_events("""
SELECT event_id, 'exec_command_end' AS payload_type, 'item_' || k AS call_id, 'shell_command' AS tool_name FROM ev WHERE kind = 'error' AND k % 4 = 0"""))
def _(spark, root):
    lines = files.parsed(codex_lines(spark, root))
    item = R.typed_item(R.typed_reads(F.col("record")), F.col("session_id"))
    return lines.withColumn("t", item).filter("t is not null").select(F.concat(F.lit("e"), F.col("line").cast("string")).alias("event_id"), "t.payload_type", "t.call_id", "t.tool_name")


ACCOUNTING_SQL = """SELECT event_id, CASE WHEN k % 2 = 0 THEN 'last_token_usage' ELSE 'info' END AS source, input_tokens IS NOT NULL AS has_input, cached_tokens IS NOT NULL AS has_cached,
  input_tokens, cached_tokens, CASE WHEN k % 2 = 0 THEN input_tokens + 5 ELSE 7 END AS total_tokens FROM ev WHERE kind = 'token_count' AND NOT (k % 2 = 0 AND input_tokens IS NULL AND cached_tokens IS NULL)"""


@query("prj_15_token_accounting_pick", bind.with_events(ACCOUNTING_SQL))
def _(spark, root):
    rows = files.parsed(codex_lines(spark, root).filter("kind = 'token_count'"))
    return rows.withColumn("a", R.token_accounting(F.col("record"))).select(
        F.concat(F.lit("e"), F.col("line").cast("string")).alias("event_id"), *[F.col(f"a.{c}").alias(c) for c in ("source", "has_input", "has_cached", "input_tokens", "cached_tokens", "total_tokens")])


@query("prj_16_token_entries", bind.with_events("""
WITH t AS (SELECT * FROM ev WHERE kind = 'token_count')
SELECT event_id, 'info.total_tokens' AS path, 'total_tokens' AS field, 7.0::DOUBLE AS value FROM t
UNION ALL SELECT event_id, 'info.input_tokens', 'input_tokens', input_tokens::DOUBLE FROM t WHERE k % 2 = 1 AND input_tokens IS NOT NULL
UNION ALL SELECT event_id, 'info.cached_input_tokens', 'cached_input_tokens', cached_tokens::DOUBLE FROM t WHERE k % 2 = 1 AND cached_tokens IS NOT NULL
UNION ALL SELECT event_id, 'info.last_token_usage.input_tokens', 'input_tokens', input_tokens::DOUBLE FROM t WHERE k % 2 = 0 AND input_tokens IS NOT NULL
UNION ALL SELECT event_id, 'info.last_token_usage.cached_input_tokens', 'cached_input_tokens', cached_tokens::DOUBLE FROM t WHERE k % 2 = 0 AND cached_tokens IS NOT NULL
UNION ALL SELECT event_id, 'info.last_token_usage.total_tokens', 'total_tokens', (input_tokens + 5)::DOUBLE FROM t WHERE k % 2 = 0 AND input_tokens IS NOT NULL"""))
def _(spark, root):
    rows = files.parsed(codex_lines(spark, root).filter("kind = 'token_count'"))
    return rows.select(F.concat(F.lit("e"), F.col("line").cast("string")).alias("event_id"), F.explode(R.token_entries(F.col("record"))).alias("t")).select("event_id", "t.*")


@query("prj_17_usage_limits", bind.with_events("""
SELECT event_id, 'primary' AS key, '5h' AS "window", CASE WHEN k = 99 THEN '50.5%' WHEN k % 2 = 0 THEN (100 - k // 2) || '%' ELSE (99 - k // 2) || '.5%' END AS remaining,
  strftime(make_timestamp((1700000000 + k) * 1000000), '%Y-%m-%dT%H:%M:%S.%gZ') AS resets_at FROM ev WHERE kind = 'token_count'"""))
def _(spark, root):
    rows = files.parsed(codex_lines(spark, root).filter("kind = 'token_count'"))
    return rows.select(F.concat(F.lit("e"), F.col("line").cast("string")).alias("event_id"), F.explode(R.usage_limits(F.col("record"))).alias("t")).select("event_id", "t.*")


_LEAVES = "concat_ws(chr(10), {})".format

#: Leaves of every payload in the order of its keys; null fields are not written, empty texts are no leaves.
SEARCH_TEXT_SQL = f"""
SELECT session_id || ':raw:' || line AS raw_id, CASE WHEN role = 'assistant' THEN preview || chr(10) || 'tail' WHEN role = 'user' THEN preview
  WHEN kind = 'token_count' THEN {_LEAVES("""'token_count', nullif(turn_id, ''), CASE WHEN k % 2 = 1 THEN input_tokens END, CASE WHEN k % 2 = 1 THEN cached_tokens END, 7,
    CASE WHEN k % 2 = 0 THEN input_tokens END, CASE WHEN k % 2 = 0 THEN cached_tokens END, CASE WHEN k % 2 = 0 THEN input_tokens + 5 END,
    (k // 2) || CASE WHEN k % 2 = 1 THEN '.5' ELSE '' END, 300, 1700000000 + k""")}
  WHEN kind = 'error' AND k % 4 = 0 THEN {_LEAVES("'item_completed', session_id, 'CommandExecution', 'item_' || k, 'completed', 'ls'")}
  WHEN kind = 'error' THEN {_LEAVES("'exec_command_end', 'call_' || (k % 20), 'bash', '-lc', 'run ' || k, k % 3, k % 5, k * 1000000")}
  ELSE {_LEAVES("""'function_call', 'call_' || (k % 20), tool_name, '{"cmd":"ls ' || k || '"}'""")} END AS search_text FROM ev WHERE NOT (role = 'user' AND k % 10 IN (8, 9))"""


@query("prj_24_full_search_text", bind.with_events(SEARCH_TEXT_SQL))
def _(spark, root):
    return codex.with_search_text(codex_raw(spark, root)).select("raw_id", "search_text")


@query("prj_45_event_construction", bind.with_events("""
WITH c AS (SELECT session_id, CASE WHEN kind = 'error' AND k % 4 = 0 THEN 'item_' || k ELSE 'call_' || (k % 20) END AS call_id, min(line) AS line, max(CASE WHEN kind = 'error' AND k % 4 <> 0 THEN k % 3 END) AS x FROM ev WHERE tool_name <> '' OR kind = 'error' GROUP BY 1, 2)
SELECT session_id, line, 'main' AS layer, CASE WHEN x IS NOT NULL AND x <> 0 THEN 'failed' WHEN x = 0 THEN 'success' ELSE 'incomplete' END AS status FROM c
UNION ALL SELECT session_id, line, CASE WHEN kind = 'token_count' THEN 'protocol' ELSE 'main' END, '' FROM ev WHERE kind = 'token_count' OR role = 'assistant' OR (role = 'user' AND k % 10 NOT IN (8, 9))"""))
def _(spark, root):
    return codex.to_logical(codex_raw(spark, root), classify.tool_dimension(spark)).select("session_id", "line", "layer", "status")


def claude_lines(spark, root):
    ev, k = bind.events(spark, root), F.col("k")
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("u"), (k % 25).cast("string")).alias("id"), F.lit("Bash").alias("name"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("boolean").alias("is_error"))
    said = F.struct(F.lit("text").alias("type"), F.col("preview").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("id", "string"), ("name", "string"), ("tool_use_id", "string"), ("is_error", "boolean"))])
    result = F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("u"), (k % 25).cast("string")).alias("tool_use_id"), (k % 2 == 0).alias("is_error"))
    usage = F.struct(k.alias("input_tokens"), F.lit(2).alias("output_tokens"), (k * 2).alias("cache_read_input_tokens"))
    message = F.struct(F.concat(F.lit("msg"), F.floor(F.col("line") / 200).cast("string")).alias("id"), F.when(F.col("tool_name") != "", F.array(said, tool)).when(F.col("kind") == "error", F.array(result)).otherwise(F.array(said)).alias("content"),
                       F.when(F.col("role") == "assistant", usage).alias("usage"))
    record = F.to_json(F.struct(F.when((F.col("kind") == "error") | (F.col("role") == "user"), "user").otherwise("assistant").alias("type"), F.col("ts_text").alias("timestamp"), F.col("event_id").alias("uuid"), (k % 7 == 3).alias("isMeta"), message.alias("message")))
    body = F.when(k == 9, "{broken").otherwise(record)
    return landed(ev.filter("kind <> 'token_count'").select("session_id", session_file().alias("file"), "line", body.alias("text")))


@query("src_03_block_transcript_read", bind.with_events("""
SELECT session_id || ':raw:' || line AS raw_id, CASE WHEN k = 9 THEN 'malformed' WHEN kind = 'error' OR role = 'user' THEN 'user' ELSE 'assistant' END AS record_type,
  CASE WHEN k = 9 THEN 'malformed_json' WHEN kind = 'error' THEN 'tool_result' ELSE 'text' END AS payload_type FROM ev WHERE kind <> 'token_count'"""))
def _(spark, root):
    return claude.to_raw(files.parsed(claude_lines(spark, root))).select("raw_id", "record_type", "payload_type")


@query("prj_02_block_projection", bind.with_events("""
SELECT session_id || ':raw:' || line AS raw_id, CASE WHEN k = 9 OR kind = 'error' THEN '' ELSE preview END AS message_text, k <> 9 AND k % 7 = 3 AS is_meta,
  CASE WHEN k <> 9 AND tool_name <> '' THEN 1 ELSE 0 END AS calls, CASE WHEN k <> 9 AND kind = 'error' THEN 1 ELSE 0 END AS results, CASE WHEN k <> 9 AND role = 'assistant' THEN k END AS input_tokens FROM ev WHERE kind <> 'token_count'"""))
def _(spark, root):
    raw = claude.to_raw(files.parsed(claude_lines(spark, root)))
    return raw.select("raw_id", "message_text", "is_meta", F.size("tool_calls").alias("calls"), F.size("tool_results").alias("results"), "input_tokens")


@query("jon_02_block_call_results", bind.with_events("""
WITH b AS (SELECT session_id, 'u' || (k % 25) AS call_id, line, tool_name <> '' AS is_call FROM ev WHERE k <> 9 AND (tool_name <> '' OR kind = 'error')),
g AS (SELECT session_id, call_id, count(*) FILTER (WHERE is_call) AS c, count(*) FILTER (WHERE NOT is_call) AS r, min(line) FILTER (WHERE is_call) AS cl, min(line) FILTER (WHERE NOT is_call) AS rl FROM b GROUP BY 1, 2)
SELECT session_id, call_id, session_id || ':raw:' || cl || ':1' AS call_event_id, session_id || ':raw:' || rl || ':0' AS result_event_id FROM g WHERE c = 1 AND r = 1 AND rl > cl"""))
def _(spark, root):
    raw = claude.to_raw(files.parsed(claude_lines(spark, root)))
    return pairing.matched_pairs(claude.call_rows(raw)).select("session_id", "call_id", "call_event_id", "result_event_id")


@query("agg_06_block_response_usage", bind.with_events("""
WITH u AS (SELECT session_id, line // 200 AS m, line, k FROM ev WHERE role = 'assistant' AND k <> 9), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY session_id, m ORDER BY line) = 1)
SELECT session_id, count(*) AS response_count, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(k * 2) AS BIGINT) AS cache_read_tokens, max(k) AS max_observed FROM f GROUP BY 1"""))
def _(spark, root):
    raw = claude.to_raw(files.parsed(claude_lines(spark, root))).filter("record_type = 'assistant' and input_tokens is not null")
    return aggregates.response_usage(raw).select("session_id", "response_count", "input_tokens", "cache_read_tokens", "max_observed")


@query("prj_45_block_events", bind.with_events("""
SELECT session_id, line, 0 AS block, CASE WHEN role = 'user' THEN 'user_message' ELSE 'assistant_message' END AS kind FROM ev WHERE kind NOT IN ('token_count', 'error') AND k <> 9
UNION ALL SELECT session_id, line, 1, 'tool_call' FROM ev WHERE tool_name <> '' AND k <> 9"""))
def _(spark, root):
    return claude.block_events(claude.to_raw(files.parsed(claude_lines(spark, root)))).select("session_id", "line", "block", "kind")


def deepseek_lines(spark, root):
    """A header line, then one storage record per event; accounting rows become packed rows of three members."""
    ev, k = bind.events(spark, root), F.col("k")
    first = ev.groupBy("session_id").agg(F.min("line").alias("_first"))
    head = first.select("session_id", session_file().alias("file"), F.lit(1).cast("bigint").alias("line"), F.to_json(F.struct(
        F.lit("session").alias("type"), F.when(F.col("session_id").cast("bigint") % 10 == 3, 7).otherwise(0).alias("version"), F.col("session_id").alias("id"), F.lit(1700000000000).alias("createdAt"), F.lit("/work").alias("cwd"))).alias("text"))
    packed = F.to_json(F.struct(F.when(k % 2 == 0, "text-chunks").otherwise("reasoning-chunks").alias("type"), (F.col("line") * 3).alias("seq0"), (F.lit(1700000000000) + k).alias("time0"), F.struct(
        (k % 5).alias("turn"), F.lit(1).alias("step"), F.lit(0).alias("index"), F.when(k == 12, F.array(k)).otherwise(F.array(k, k + 1)).alias("dt"), F.array(F.lit("a"), F.concat(F.lit("b"), k.cast("string")), F.lit("c")).alias("texts")).alias("data")))
    plain = F.to_json(F.struct(F.when(F.col("role") == "user", "user/message").when(F.col("tool_name") != "", "tool/call").otherwise("assistant/message").alias("type"), (F.col("line") * 3).alias("seq"), (F.lit(1700000000000) + k).alias("time"),
                               F.struct((k % 5).alias("turn"), F.nullif("tool_name", F.lit("")).alias("name")).alias("data")))
    body = ev.select("session_id", session_file().alias("file"), (F.col("line") + 2).alias("line"), F.when(F.col("kind") == "token_count", packed).otherwise(plain).alias("text"))
    return landed(head.unionByName(body))


@query("src_07_header_records", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN user_id % 10 = 3 THEN 7 ELSE 0 END AS version, '/work' AS cwd, user_id % 10 <> 3 AS supported FROM events""")
def _(spark, root):
    return deepseek.headers(files.parsed(deepseek_lines(spark, root))).select("session_id", F.col("version").cast("int").alias("version"), "cwd", "supported")


@query("src_09_packed_members", bind.with_events("""
SELECT session_id, line * 3 + i AS seq, 1700000000000 + k + CASE i WHEN 0 THEN 0 WHEN 1 THEN k ELSE 2 * k + 1 END AS time, CASE i WHEN 0 THEN 'a' WHEN 1 THEN 'b' || k ELSE 'c' END AS text
FROM (SELECT *, unnest(range(3)) AS i FROM ev WHERE kind = 'token_count' AND k <> 12)"""))
def _(spark, root):
    m = files.packed_members(files.parsed(deepseek_lines(spark, root)))
    return m.select(F.regexp_extract("file", r"/(\d+)\.jsonl", 1).alias("session_id"), "seq", "time", "text")


@query("src_09_packed_errors", bind.with_events("""
SELECT 'sessions/' || session_id || '.jsonl' AS file, line + 2 AS line, 'malformed_packed_row' AS code FROM ev WHERE kind = 'token_count' AND k = 12"""))
def _(spark, root):
    return files.packed_errors(files.parsed(deepseek_lines(spark, root))).select("file", "line", "code")


@query("prj_03_event_log_projection", bind.with_events("""
SELECT session_id || ':raw:' || (line + 1) AS raw_id, CASE WHEN kind = 'token_count' THEN CASE WHEN k % 2 = 0 THEN 'text-chunks' ELSE 'reasoning-chunks' END WHEN role = 'user' THEN 'user/message' WHEN tool_name <> '' THEN 'tool/call' ELSE 'assistant/message' END AS payload_type,
  CASE WHEN role = 'user' THEN 'user' WHEN tool_name <> '' THEN '' ELSE 'assistant' END AS role, line * 3 AS seq0, line * 3 + CASE WHEN kind = 'token_count' THEN 2 ELSE 0 END AS seq_end, CASE WHEN k % 5 > 0 THEN 'turn:' || (k % 5) ELSE '' END AS turn_id,
  strftime(make_timestamp((1700000000000 + k) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS ts_text, tool_name FROM ev"""))
def _(spark, root):
    raw = deepseek.to_raw(files.parsed(deepseek_lines(spark, root).filter("line > 1 or session_id = ''")))
    return raw.filter("payload_type <> 'session'").select("raw_id", "payload_type", "role", "seq0", "seq_end", "turn_id", "ts_text", "tool_name")


@query("src_10_session_index_sidecar", bind.with_events("""
WITH x AS (SELECT session_id, arg_max(CASE WHEN k % 2 = 0 THEN 'T' || k ELSE '' END, line) AS t, arg_max('2024-01-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0'), line) AS u FROM ev WHERE role = 'user' GROUP BY 1),
s AS (SELECT session_id, coalesce(max(nullif(ts_text, '')), '') AS updated_at FROM ev GROUP BY 1)
SELECT s.session_id, coalesce(nullif(t, ''), 'own ' || s.session_id) AS title, greatest(updated_at, coalesce(u, '')) AS updated_at FROM s LEFT JOIN x USING (session_id)"""))
def _(spark, root):
    ev, k = bind.events(spark, root), F.col("k")
    entries = ev.filter("role = 'user'").select("session_id", "line", F.when(k % 2 == 0, F.concat(F.lit("T"), k.cast("string"))).otherwise("").alias("title"), F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("updated_at"))
    base = aggregates.time_range(ev).withColumn("title", F.concat(F.lit("own "), "session_id"))
    return sessions.apply_index(base, sessions.last_index_entries(entries)).select("session_id", "title", "updated_at")


@query("src_11_cwd_screen", bind.with_events("""
SELECT DISTINCT 'sessions/' || session_id || '.jsonl' AS file, '/w/' || (k % 3) AS cwd FROM ev WHERE kind = 'error'"""))
def _(spark, root):
    ev = bind.events(spark, root)
    body = F.when(F.col("kind") == "error", F.to_json(F.struct(F.struct(F.concat(F.lit("/w/"), (F.col("k") % 3).cast("string")).alias("cwd")).alias("payload")))).otherwise('{"payload":{"other":1}}')
    return files.with_cwd(ev.select(session_file().alias("file"), "line", body.alias("text")))


@query("src_13_changed_files", """
SELECT doc_id, source FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""")
def _(spark, root):
    d = table(spark, root, "documents")
    now = d.select(F.col("doc_id").alias("file"), F.octet_length("text").alias("bytes"), F.lit(1).alias("mtime"), F.sha2("text", 256).alias("file_digest"), "source")
    manifest = now.filter("file % 5 <> 0").withColumn("file_digest", F.when(F.col("file") % 7 == 0, "stale").otherwise(F.col("file_digest"))).drop("source")
    return files.changed_files(now, manifest).select(F.col("file").alias("doc_id"), "source")


@query("src_14_line_digests", """
SELECT doc_id, i AS line, sha256(string_split(text, chr(10))[i]) AS line_digest FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""")
def _(spark, root):
    d = table(spark, root, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return files.line_digests(d.select("doc_id", (F.col("p") + 1).cast("bigint").alias("line"), "text")).select("doc_id", "line", "line_digest")


@query("src_14_file_digests", """
WITH d AS (SELECT text, count(*) AS n FROM documents GROUP BY 1) SELECT n AS copies, count(*) AS files FROM d GROUP BY 1""")
def _(spark, root):
    lines = table(spark, root, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("file", (F.col("p") + 1).alias("line"), "text")
    d = files.file_digests(lines)
    return d.groupBy("file_digest").agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("files"))


def projection(spark, root, label):
    """Projection written to the shared folder; returns its path."""
    ev = bind.events(spark, root).select("session_id", "line", "event_id", "layer", "kind", "status", "tool_name", "preview", "search_text")
    path = scratch_path(spark, label)
    sinks.write_projection(ev, path)
    return path


@query("src_15_projection_sink", bind.with_events("SELECT layer, session_id, count(*) AS rows, max(line) AS last_line FROM ev GROUP BY 1, 2"))
def _(spark, root):
    return spark.read.parquet(projection(spark, root, "projection")).groupBy("layer", "session_id").agg(F.count(F.lit(1)).alias("rows"), F.max("line").alias("last_line"))


@query("src_16_projection_scan", bind.with_events("SELECT event_id, kind FROM ev WHERE layer = 'main' AND session_id = '17'"))
def _(spark, root):
    return sinks.scan_projection(spark, projection(spark, root, "projection"), "main", "17", ["event_id", "kind"])


@query("dq_08_stored_equals_source", bind.with_events("SELECT session_id FROM ev WHERE false"))
def _(spark, root):
    columns = ["event_id", "layer", "kind", "status", "preview"]
    source = bind.events(spark, root)
    return quality.differing_sessions(quality.digest(source, columns, "line"), quality.digest(spark.read.parquet(projection(spark, root, "projection")), columns, "line"))


@query("dq_06_projection_digest", bind.with_events("SELECT session_id, count(*) AS rows, bool_or(k = 5) AS differs FROM ev GROUP BY 1"))
def _(spark, root):
    ev = bind.events(spark, root)
    columns = ["event_id", "kind", "status"]
    one = quality.digest(ev, columns, "line")
    other = quality.digest(ev.withColumn("status", F.when(F.col("k") == 5, "changed").otherwise(F.col("status"))), columns, "line")
    changed = quality.differing_sessions(one, other).withColumn("_d", F.lit(True))
    return one.join(changed, "session_id", "left").select("session_id", "rows", F.coalesce("_d", F.lit(False)).alias("differs"))


@query("dq_01_shape_rules", bind.with_events("""
SELECT 'session_id_present' AS rule, count(*) FILTER (WHERE session_id = '') AS n FROM ev UNION ALL SELECT 'known_layer', 0 FROM (SELECT 1)
UNION ALL SELECT 'timestamp_present', count(*) FILTER (WHERE ts_text = '') FROM ev UNION ALL SELECT 'tool_rows_have_status', count(*) FILTER (WHERE tool_name <> '' AND status = '') FROM ev"""))
def _(spark, root):
    c = F.col
    return quality.violations(bind.events(spark, root), {
        "session_id_present": c("session_id") != "", "known_layer": c("layer").isin("main", "protocol", "raw"),
        "timestamp_present": c("ts_text") != "", "tool_rows_have_status": (c("tool_name") == "") | (c("status") != "")})


@query("src_12_raw_readback", bind.with_events("SELECT session_id, line, search_text FROM ev WHERE session_id = '42' AND line = 5"))
def _(spark, root):
    return sinks.raw_record(bind.events(spark, root), "42", 5).select("session_id", "line", "search_text")


@query("src_01_plain_wins", """
WITH f AS (SELECT 'd/' || (doc_id // 2) || '.jsonl' AS logical_path, CASE WHEN n_chars % 2 = 0 THEN '.zst' ELSE '' END AS ext, doc_id, n_chars FROM documents)
SELECT logical_path, CASE WHEN bool_or(ext = '') THEN logical_path ELSE logical_path || '.zst' END AS file, NOT bool_or(ext = '') AS compressed FROM f GROUP BY 1""")
def _(spark, root):
    n = F.col("doc_id")
    name = F.concat(F.lit("d/"), F.floor(n / 2).cast("string"), F.lit(".jsonl"), F.when(F.col("n_chars") % 2 == 0, ".zst").otherwise(""))
    listed = table(spark, root, "documents").select(name.alias("file"), F.col("n_chars").alias("bytes"), F.lit(0).alias("mtime"))
    return files.prefer_plain(listed).select("logical_path", "file", "compressed")


_LAYOUT_SQL = """n AS (SELECT doc_id, doc_id % 9 AS m, 'c' || (doc_id // 9 % 11) AS container, 's' || (doc_id // 9) AS session, 'a' || (doc_id // 9 % 5) AS agent, 'r' || (doc_id // 9 % 3) AS run FROM documents),
lf AS (SELECT doc_id, m, container, session,
  CASE m WHEN 0 THEN 'transcript' WHEN 1 THEN 'subagent' WHEN 2 THEN 'metadata' WHEN 3 THEN 'marker' WHEN 4 THEN 'journal' WHEN 5 THEN 'child' WHEN 6 THEN 'manifest' END AS role,
  CASE WHEN m IN (1, 2, 3, 5) THEN agent END AS agent_id, CASE WHEN m IN (4, 5, 6) THEN run END AS run_id FROM n)"""


def layout_files(spark, root):
    """A file of one of nine places, two of them outside the layout, for every document."""
    n = F.col("doc_id")
    m, part = n % 9, F.floor(n / 9)
    base = F.concat(F.lit("/home/projects/"), F.lit("c"), (part % 11).cast("string"), F.lit("/s"), part.cast("string"))
    agent, run = F.concat(F.lit("/agent-a"), (part % 5).cast("string")), F.concat(F.lit("r"), (part % 3).cast("string"))
    tails = [".jsonl", F.concat(F.lit("/subagents"), agent, F.lit(".jsonl")), F.concat(F.lit("/subagents"), agent, F.lit(".meta.json")), F.concat(F.lit("/subagents"), agent, F.lit(".forked-skill.marker.json")),
             F.concat(F.lit("/subagents/workflows/"), run, F.lit("/journal.jsonl")), F.concat(F.lit("/subagents/workflows/"), run, agent, F.lit(".jsonl")), F.concat(F.lit("/workflows/"), run, F.lit(".json")),
             "/../up.jsonl", "/deep/er/x.jsonl"]
    tail = F.get(F.array(*[F.lit(t) if isinstance(t, str) else t for t in tails]), m.cast("int"))
    return layout.placed(table(spark, root, "documents").select("doc_id", F.concat(base, tail).alias("file")), "/home/projects")


@query("src_04_container_layout", f"""
WITH {_LAYOUT_SQL} SELECT doc_id, role, CASE WHEN role IS NOT NULL THEN container END AS container, CASE WHEN role IS NOT NULL THEN session END AS session, agent_id, run_id FROM lf""")
def _(spark, root):
    return layout_files(spark, root).select("doc_id", "role", "container", "session", "agent_id", "run_id")


@query("src_05_derived_transcripts", f"""
WITH {_LAYOUT_SQL}, sib AS (SELECT container, session, agent_id, bool_or(role = 'metadata') AS has_meta, bool_or(role = 'marker') AS has_mark FROM lf WHERE role IN ('metadata', 'marker') GROUP BY 1, 2, 3)
SELECT s.container, s.session, s.agent_id, coalesce(has_meta, false) AS has_metadata, CASE WHEN coalesce(has_mark, false) THEN 'forked_skill' ELSE 'subagent' END AS derived_kind
FROM lf s JOIN lf p ON p.container = s.container AND p.session = s.session AND p.role = 'transcript' LEFT JOIN sib ON sib.container = s.container AND sib.session = s.session AND sib.agent_id = s.agent_id WHERE s.role = 'subagent'""")
def _(spark, root):
    return layout.derived_transcripts(layout_files(spark, root)).select("container", "session", "agent_id", F.col("metadata_file").isNotNull().alias("has_metadata"), "derived_kind")


@query("src_06_workflow_journal", """
WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE NOT (doc_id % 7 = 0 AND trim(string_split(text, chr(10))[1]) <> ''))
SELECT doc_id AS run_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sequence, CASE WHEN i % 2 = 1 THEN 'started' ELSE 'result' END AS kind, 'k' || length(t) AS key FROM e WHERE trim(t) <> ''""")
def _(spark, root):
    """A journal line for each line of a document; one document in seven has a broken line, so its journal gives nothing."""
    j = table(spark, root, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("p", "t"))
    i = (F.col("p") + 1).cast("bigint")
    key = F.concat(F.lit("k"), F.length("t").cast("string"))
    good = F.when(i % 2 == 1, F.to_json(F.struct(F.lit("started").alias("type"), key.alias("key"), F.lit("a").alias("agentId")))).otherwise(
        F.to_json(F.struct(F.lit("result").alias("type"), key.alias("key"), F.lit("a").alias("agentId"), F.struct(F.array(F.col("t")).alias("types")).alias("result"))))
    line = F.when(F.trim("t") == "", F.col("t")).when((F.col("file") % 7 == 0) & (i == 1), '{"type":"started"').otherwise(good)
    return layout.journal_records(j.select("file", i.alias("line"), line.alias("text"))).select(F.col("file").alias("run_id"), "sequence", "kind", "key")


@query("src_08_torn_tail", """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)
SELECT doc_id, i AS line FROM e WHERE NOT (i = len(l))""")
def _(spark, root):
    d = table(spark, root, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return files.committed(d.select("doc_id", (F.col("p") + 1).cast("bigint").alias("line"), (F.col("p") + 1 == F.col("n")).alias("torn"))).select("doc_id", "line")


def with_payload(spark, root):
    """Page texts with an embedded image payload."""
    p = table(spark, root, "pages")
    payload = F.concat(F.when(F.col("page_id") % 3 == 0, "iVBORw0K").when(F.col("page_id") % 3 == 1, "/9j/").otherwise("AAAA"), F.expr("repeat('QUJD', cast(page_id % 5 + 1 as int))"), F.when(F.col("page_id") % 2 == 0, "QQ==").otherwise(""))
    return p.select("page_id", F.concat(F.lit("see data:image/png;base64,"), payload, F.lit(" and "), "html").alias("text"), "url")


_PAYLOAD_SQL = """pl AS (SELECT page_id, url, (CASE page_id % 3 WHEN 0 THEN 'iVBORw0K' WHEN 1 THEN '/9j/' ELSE 'AAAA' END) || repeat('QUJD', CAST(page_id % 5 + 1 AS INT)) || CASE WHEN page_id % 2 = 0 THEN 'QQ==' ELSE '' END AS payload FROM pages)"""


@query("src_18_embedded_images", f"""
WITH {_PAYLOAD_SQL} SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime, CAST(octet_length(from_base64(payload)) AS BIGINT) AS bytes, sha256(payload) AS identity FROM pl""")
def _(spark, root):
    return with_payload(spark, root).select("page_id", F.explode(R.image_refs(F.col("text"))).alias("i")).select("page_id", "i.mime", F.col("i.bytes").cast("bigint").alias("bytes"), "i.identity")


@query("prj_26_redact_data_urls", "SELECT page_id, 'see [data URL omitted] and ' || html AS text FROM pages")
def _(spark, root):
    return with_payload(spark, root).select("page_id", search_json.redact_data_urls(F.col("text")).alias("text"))


@query("prj_25_search_projection", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '{"url":"' || url || '","n":' || page_id || '}' ELSE '{"url":"' || url || '"}' END AS text FROM pages""")
def _(spark, root):
    p = table(spark, root, "pages")
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"url":"'), "url", F.lit('","n":'), F.col("page_id").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"url":"'), "url", F.lit('","signature":"zzz"}')))
    return p.select("page_id", search_json.search_projection(body).alias("text"))


@query("prj_27_mojibake_repair", "SELECT doc_id, text FROM documents")
def _(spark, root):
    """Texts of the given tables were decoded well, so they stay; broken ones are covered by the tests."""
    return table(spark, root, "documents").select("doc_id", search_json.repair_mojibake(F.col("text")).alias("text"))


def patches(spark, root):
    """A patch text per part: a header per file, one or two hunks, added, removed and context lines."""
    p, n = table(spark, root, "part"), F.col("p_partkey")
    start = (n % 50 + 1).cast("string")
    body = F.concat(F.lit("*** Begin Patch\n*** Update File: src/f"), n.cast("string"), F.lit(".py\n@@ -"), start, F.lit(",3 +"), start, F.lit(",4 @@\n keep\n-old\n+new\n"), F.expr("repeat('+more\n', cast(p_size % 4 as int))"),
                    F.when(n % 2 == 0, F.concat(F.lit("*** Add File: lib/g"), (n % 7).cast("string"), F.lit(".py\n+one\n"))).otherwise(""), F.lit("*** End Patch"))
    return p.select(n.alias("event_id"), body.alias("patch"), (F.col("p_size") % 4).cast("bigint").alias("more"))


@query("prj_30_patch_files", """
SELECT p_partkey AS event_id, 'src/f' || p_partkey || '.py' || CASE WHEN p_partkey % 2 = 0 THEN '|lib/g' || (p_partkey % 7) || '.py' ELSE '' END AS files FROM part""")
def _(spark, root):
    return patches(spark, root).select("event_id", F.array_join(R.patch_files(F.col("patch")), "|").alias("files"))


@query("prj_28_patch_lines", """
WITH l AS (SELECT p_partkey AS event_id, 'src/f' || p_partkey || '.py' AS file, p_partkey % 50 + 1 AS s, unnest(range(3 + p_size % 4)) AS i FROM part)
SELECT event_id, file, CASE i WHEN 0 THEN 'context' WHEN 1 THEN 'removed' ELSE 'added' END AS kind, CASE WHEN i < 2 THEN s + i END AS old_line, CASE WHEN i = 0 THEN s WHEN i > 1 THEN s + i - 1 END AS new_line, CASE i WHEN 0 THEN 'keep' WHEN 1 THEN 'old' WHEN 2 THEN 'new' ELSE 'more' END AS content FROM l
UNION ALL SELECT p_partkey, 'lib/g' || (p_partkey % 7) || '.py', 'added', NULL, 1, 'one' FROM part WHERE p_partkey % 2 = 0""")
def _(spark, root):
    from skeinlog.operators import patches as P
    return P.patch_lines(patches(spark, root)).select("event_id", "file", "kind", "old_line", "new_line", "content")


@query("prj_29_diff_stats", """
SELECT p_partkey AS event_id, CAST(1 + p_size % 4 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS added, CAST(1 AS BIGINT) AS removed FROM part""")
def _(spark, root):
    return patches(spark, root).withColumn("s", R.diff_stats(F.col("patch"))).select("event_id", "s.added", "s.removed")


@query("prj_32_patch_success", bind.with_events("""
SELECT event_id, CASE WHEN k % 8 = 0 THEN false WHEN k % 8 = 1 THEN true WHEN k % 8 = 2 THEN NULL WHEN k % 8 = 3 THEN true WHEN k % 8 = 4 THEN k % 3 = 0 WHEN k % 8 = 5 THEN false WHEN k % 8 = 6 THEN true END AS success FROM ev"""))
def _(spark, root):
    m = F.col("k") % 8
    out = F.when(m == 5, "Error: invalid patch").when(m == 6, "Done").otherwise("nothing to say")
    return bind.events(spark, root).select("event_id", R.patch_success(F.when(m == 0, "failed").when(m == 1, "success").when(m == 2, "incomplete"), F.when(m == 3, True), F.when(m == 4, F.col("k") % 3), [out]).alias("success"))


@query("prj_33_command_output", bind.with_events("""
SELECT event_id, CASE WHEN k % 3 = 0 THEN CAST(k AS INTEGER) WHEN k % 3 = 1 THEN CAST(k AS INTEGER) END AS exit_code, CASE WHEN k % 3 = 2 THEN CAST(k AS INTEGER) END AS process_id,
  CASE WHEN k % 3 = 0 THEN '2 s' ELSE '1.5000 seconds' END AS wall_time, preview AS body FROM ev"""))
def _(spark, root):
    k = F.col("k").cast("string")
    native = F.concat(F.lit("Wall time: 1.5000 seconds\nProcess "), F.when(F.col("k") % 3 == 1, "exited with code ").otherwise("running with session ID "), k, F.lit("\nOutput:\n"), "preview")
    plain = F.concat(F.lit("Exit code: "), k, F.lit("\nWall time: 2 s\nOutput:\n"), "preview")
    return bind.events(spark, root).select("event_id", R.command_output(F.when(F.col("k") % 3 == 0, plain).otherwise(native)).alias("o")).select("event_id", "o.*")


@query("prj_34_command_language", bind.with_events(r"""
SELECT event_id, CASE k % 7 WHEN 0 THEN 'bash' WHEN 1 THEN 'powershell' WHEN 2 THEN 'batch' WHEN 3 THEN 'powershell' WHEN 4 THEN (CASE WHEN k % 2 = 0 THEN 'powershell' ELSE 'shell' END) WHEN 5 THEN 'zsh' ELSE 'shell' END AS language FROM ev"""))
def _(spark, root):
    k = F.col("k")
    command = F.element_at(F.array(*[F.lit(c) for c in ('"/bin/bash" -lc ls', "C:\\W\\pwsh.exe -NoLogo", "cmd /c dir", "Get-Content a.txt", "git status", "zsh -c x", "make all")]), (k % 7 + 1).cast("int"))
    return bind.events(spark, root).select("event_id", R.command_language(command, F.when(k % 2 == 0, "C:\\bin\\pwsh.exe").otherwise("bash")).alias("language"))


@query("prj_35_background_request", bind.with_events("""
SELECT event_id, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'input' ELSE 'poll' END AS action, CASE WHEN k % 5 <> 0 THEN CAST(k AS INTEGER) END AS process_id FROM ev"""))
def _(spark, root):
    k = F.col("k")
    args = F.when(k % 5 == 0, "[1]").otherwise(F.concat(F.lit('{"session_id":'), k.cast("string"), F.when(k % 3 == 0, ',"chars":"y"}').when(k % 3 == 1, ',"chars":""}').otherwise("}")))
    return bind.events(spark, root).select("event_id", R.background_request(args).alias("r")).select("event_id", "r.action", "r.process_id")


@query("txt_06_command_search_text", bind.with_events(r"""
SELECT event_id, concat_ws(chr(10), preview, CASE WHEN k % 2 = 0 THEN 'out ' || k END, CASE WHEN k % 3 = 0 THEN 'tail' END) AS text FROM ev"""))
def _(spark, root):
    k = F.col("k")
    out = F.when(k % 2 == 0, F.concat(F.lit("out "), k.cast("string"))).otherwise("")
    return bind.events(spark, root).select("event_id", R.command_search_text(F.array(F.col("preview"), out, out, F.when(k % 3 == 0, "tail").otherwise(""), F.col("preview"))).alias("text"))


@query("prj_19_review_phase", bind.with_events("""
SELECT event_id, CASE WHEN k % 4 = 0 THEN 'entered' WHEN k % 4 = 1 THEN 'exited' WHEN k % 4 = 2 AND k % 3 <> 0 THEN 'entered' END AS phase FROM ev"""))
def _(spark, root):
    k = F.col("k")
    item = F.struct(F.lit("EnteredReviewMode").alias("type"))
    kind = F.when(k % 4 == 0, "entered_review_mode").when(k % 4 == 1, "exited_review_mode").when(k % 4 == 2, "item_completed").otherwise("other")
    thread = F.when((k % 4 == 2) & (k % 3 == 0), "elsewhere").when(k % 2 == 0, F.col("session_id"))
    rec = F.try_parse_json(F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(kind.alias("type"), thread.alias("thread_id"), F.when(k % 4 == 2, item).alias("item")).alias("payload"))))
    return bind.events(spark, root).withColumn("record", rec).select("event_id", R.review_phase(F.col("record"), F.col("session_id")).alias("phase"))


@query("prj_20_attachment_summary", bind.with_events("""
SELECT event_id, 1 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS total, 1 AS inline, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS files, 0 AS invalid, sha256(length('u' || k) || ':u' || k || CASE WHEN k % 2 = 0 THEN length('f' || k) || ':f' || k ELSE '' END) AS identity FROM ev"""))
def _(spark, root):
    k = F.col("k").cast("string")

    def image(url, file):
        return F.struct(F.lit("input_image").alias("type"), F.lit(None).cast("string").alias("text"), url.alias("image_url"), file.alias("file_id"))
    none = F.lit(None).cast("string")
    said = F.struct(F.lit("input_text").alias("type"), F.lit("hi").alias("text"), none.alias("image_url"), none.alias("file_id"))
    one, two = image(F.concat(F.lit("u"), k), none), image(none, F.concat(F.lit("f"), k))
    rec = F.try_parse_json(F.to_json(F.struct(F.struct(F.when(F.col("k") % 2 == 0, F.array(said, one, two)).otherwise(F.array(said, one)).alias("content")).alias("payload"))))
    return bind.events(spark, root).withColumn("a", R.attachment_summary(rec)).select("event_id", "a.*")


@query("prj_21_external_input", bind.with_events("SELECT event_id, CASE WHEN k % 4 = 0 THEN 'tool ' || k WHEN k % 4 = 1 THEN 'tool ' || k END AS name FROM ev"))
def _(spark, root):
    k = F.col("k")
    name = F.concat(F.lit("tool "), k.cast("string"))
    parts = F.array(F.struct(F.when(k % 4 == 2, "mystery").otherwise("input_text").alias("type"), F.lit("x").alias("text")))
    arr = F.to_json(F.struct(F.struct(F.lit("function_call_output").alias("type"), name.alias("name"), parts.alias("output")).alias("payload")))
    plain = F.to_json(F.struct(F.struct(F.lit("function_call_output").alias("type"), name.alias("name"), F.lit("text").alias("output"), F.when(k % 4 == 3, "c1").alias("call_id")).alias("payload")))
    rec = F.try_parse_json(F.when((k % 4).isin(1, 2), arr).otherwise(plain))
    return bind.events(spark, root).select("event_id", R.external_input(rec).alias("name"))


@query("prj_22_async_message", bind.with_events("SELECT event_id, CASE k % 3 WHEN 0 THEN preview WHEN 1 THEN 'a' || preview END AS text FROM ev"))
def _(spark, root):
    k = F.col("k")
    legacy = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("agent_message").alias("type"), F.when(k % 3 == 0, "async").otherwise("inline").alias("delivery"), F.col("preview").alias("message")).alias("payload")))
    content = F.array(F.struct(F.lit("Text").alias("type"), F.lit("a").alias("text")), F.struct(F.lit("Other").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("Text").alias("type"), F.col("preview").alias("text")))
    item = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("item_completed").alias("type"), F.struct(F.lit("AgentMessage").alias("type"), F.lit("async").alias("delivery"), content.alias("content")).alias("item")).alias("payload")))
    return bind.events(spark, root).select("event_id", R.async_message(F.try_parse_json(F.when(k % 3 == 1, item).otherwise(legacy))).alias("text"))


@query("prj_23_history_facts", bind.with_events("""
SELECT event_id, 'model' AS key, 'm' || k AS value FROM ev WHERE k % 3 = 0 UNION ALL SELECT event_id, 'service_tier', 'fast' FROM ev WHERE k % 3 = 0
UNION ALL SELECT event_id, 'item_id', 'i' || k FROM ev WHERE k % 3 = 1 UNION ALL SELECT event_id, 'realtime_session_id', 'rs' FROM ev WHERE k % 3 = 1"""))
def _(spark, root):
    k = F.col("k")
    settings = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("thread_settings_applied").alias("type"), F.struct(F.concat(F.lit("m"), k.cast("string")).alias("model"), F.lit("fast").alias("service_tier")).alias("thread_settings")).alias("payload")))
    item = F.to_json(F.struct(F.lit("realtime_item").alias("type"), F.struct(F.lit("realtime_session_started").alias("type"), F.concat(F.lit("i"), k.cast("string")).alias("id"), F.lit("rs").alias("realtime_session_id")).alias("payload")))
    rec = F.try_parse_json(F.when(k % 3 == 0, settings).when(k % 3 == 1, item).otherwise('{"type":"event_msg","payload":{"type":"realtime_conversation_sdp"}}'))
    return bind.events(spark, root).select("event_id", F.explode(R.history_facts(rec)).alias("key", "value"))


@query("prj_12_human_user", bind.with_events("""
SELECT event_id, role = 'user' AND k % 7 <> 0 AND k % 5 NOT IN (1, 2) AS human FROM ev"""))
def _(spark, root):
    k = F.col("k")
    body = F.when(k % 5 == 1, "<local-command-stdout>hi</local-command-stdout>").when(k % 5 == 2, "<command-name>/fork</command-name> <command-args>x</command-args>").when(
        k % 5 == 3, "<command-name>/a</command-name><command-name>/b</command-name>").otherwise(F.col("preview"))
    return bind.events(spark, root).select("event_id", R.is_human(F.col("role"), k % 7 == 0, F.lit(False), F.lit(""), F.lit(False), body).alias("human"))


@query("prj_36_derived_kind", bind.with_events("""
SELECT event_id, CASE WHEN k % 5 = 0 THEN 'subagent' WHEN k % 5 = 1 THEN 'review' WHEN k % 5 = 2 THEN 'subagent' ELSE '' END AS derived_kind FROM ev"""))
def _(spark, root):
    m = F.col("k") % 5
    return bind.events(spark, root).select("event_id", classify.derived_session_kind(F.when(m == 0, "subagent").otherwise(""), F.when(m == 1, "Deep Review 2").otherwise("previewer"), F.when(m <= 2, "p").otherwise("")).alias("derived_kind"))


@query("prj_41_output_rows", bind.with_events("""
SELECT event_id, kind, contains(lower(preview), 'alpha3') OR contains(lower(search_text), 'alpha3') AS has_search_hit, CASE WHEN k < 20 THEN 'inherited_context' ELSE '' END AS fork_segment FROM ev"""))
def _(spark, root):
    return bind.events(spark, root).select("event_id", "kind", text.event_hit(F.col("preview"), F.col("search_text"), "alpha3").alias("has_search_hit"), F.when(F.col("k") < 20, "inherited_context").otherwise("").alias("fork_segment"))


@query("prj_42_permission_change", bind.with_events("""
SELECT event_id, CASE k % 4 WHEN 0 THEN 'preset' WHEN 1 THEN 'mode' END AS field, CASE WHEN k % 4 < 2 THEN 'v' || k END AS value FROM ev"""))
def _(spark, root):
    k = F.col("k")
    value = F.concat(F.lit("v"), k.cast("string"))
    data = F.when(k % 4 == 0, F.to_json(F.struct(value.alias("preset")))).when(k % 4 == 1, F.to_json(F.struct(value.alias("mode")))).otherwise(F.to_json(F.struct(value.alias("policy"), value.alias("extra"))))
    kind = F.when(k % 4 == 0, "permission/preset").when(k % 4 == 1, "sandbox/mode").otherwise("approval/policy")
    return bind.events(spark, root).select("event_id", R.permission_change(kind, data).alias("p")).select("event_id", "p.field", "p.value")


@query("prj_43_todo_snapshot", bind.with_events("""
SELECT event_id, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 2 END AS items FROM ev"""))
def _(spark, root):
    k = F.col("k")
    todos = F.array(F.struct(F.lit("one").alias("content"), F.when(k % 3 == 0, "odd").otherwise("pending").alias("status")), F.struct(F.when(k % 5 == 0, "one").otherwise("two").alias("content"), F.lit("completed").alias("status")))
    return bind.events(spark, root).select("event_id", F.size(R.todo_snapshot(F.to_json(F.struct(todos.alias("todos"))))).alias("n")).select("event_id", F.when(F.col("n") >= 0, F.col("n")).alias("items"))


@query("prj_44_retry_facts", bind.with_events("""
SELECT event_id, CASE WHEN k > 0 AND (k % 4 = 0 OR (k % 4 IN (1, 3) AND k <= 50)) THEN k END AS retry FROM ev"""))
def _(spark, root):
    k = F.col("k")
    data = F.to_json(F.struct(F.lit("r").alias("retryId"), F.lit(1).alias("turn"), F.lit(1).alias("step"), F.when(k % 4 == 2, "").otherwise("p").alias("provider"), F.when(k % 4 == 0, "always").otherwise("normal").alias("mode"), k.alias("retry"), F.lit(50).alias("maxRetries"), F.lit(5).alias("delayMs")))
    return bind.events(spark, root).select("event_id", R.retry_facts(data)["retry"].alias("retry"))


@query("prj_46_analyzer_ids", """
SELECT page_id, 'subagent:' || replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') || ':a%20b' AS id FROM pages""")
def _(spark, root):
    p = table(spark, root, "pages")
    return p.select("page_id", R.analyzer_id("subagent", F.col("url"), F.lit("a b")).alias("id"))


@query("prj_47_session_metadata", bind.with_events("""
SELECT session_id, array_to_string(list_sort(list_distinct(list(CASE WHEN k % 4 = 0 THEN '/w' || (k % 3) END))), '|') AS cwds, arg_max(CASE WHEN k % 9 = 2 THEN 'T' || k END, line) FILTER (WHERE k % 9 = 2) AS title, arg_min('v' || (k % 5), line) AS version,
  coalesce(min(nullif(ts_text, '')), '') AS started_at FROM ev GROUP BY 1"""))
def _(spark, root):
    k = F.col("k")
    rows = bind.events(spark, root).select("session_id", "line", "ts_text", F.when(k % 4 == 0, F.concat(F.lit("/w"), (k % 3).cast("string"))).otherwise("").alias("cwd"),
                                           F.when(k % 9 == 2, F.concat(F.lit("T"), k.cast("string"))).alias("title"), F.concat(F.lit("v"), (k % 5).cast("string")).alias("version"))
    return sessions.metadata(rows).select("session_id", F.array_join("cwd_set", "|").alias("cwds"), "title", "version", "started_at")


@query("prj_48_task_notifications", bind.with_events("""
SELECT event_id, CASE WHEN k % 4 IN (0, 3) THEN 't' || k END AS task_id, CASE WHEN k % 4 IN (0, 3) THEN CASE WHEN k % 4 = 3 THEN 'failed' ELSE 'completed' END END AS status, CASE WHEN k % 4 = 3 THEN k % 3 END AS exit_code FROM ev"""))
def _(spark, root):
    k = F.col("k")

    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    body = F.concat(tag("task-id", F.concat(F.lit("t"), k.cast("string"))), tag("tool-use-id", F.lit("c1")), tag("status", F.when(k % 4 == 1, "unknown").when(k % 4 == 3, "Failed").otherwise("completed")),
                    tag("summary", F.when(k % 4 == 3, F.concat(F.lit("ended (exit code "), (k % 3).cast("string"), F.lit(")"))).otherwise("fine")), F.when(k % 4 == 2, tag("summary", F.lit("again"))).otherwise(""))
    return bind.events(spark, root).select("event_id", R.task_notification(F.concat(F.lit(" <task-notification>"), body, F.lit("</task-notification> "))).alias("n")).select("event_id", "n.task_id", "n.status", "n.exit_code")


@query("prj_49_exact_key_payloads", bind.with_events("""
SELECT event_id, CASE WHEN k % 3 <> 2 THEN 'r' || k END AS request_id, CASE WHEN k % 4 = 0 THEN 'fork' END AS command FROM ev"""))
def _(spark, root):
    k = F.col("k")
    asked = F.to_json(F.struct(F.concat(F.lit("r"), k.cast("string")).alias("requestId"), F.lit("bash").alias("toolName"), F.when(k % 3 == 0, "why").alias("reason"), F.when(k % 3 == 2, 1).alias("other")))
    run = F.to_json(F.struct(F.lit("c").alias("commandId"), F.when(k % 4 == 1, "Fork!").otherwise("fork").alias("name"), F.struct(F.when(k % 4 == 2, "agent").otherwise("user").alias("kind")).alias("source"), F.when(k % 4 == 3, 1).alias("extra")))
    return bind.events(spark, root).select("event_id", R.approval_asked(asked)["requestId"].alias("request_id"), R.command_run(run)["name"].alias("command"))


@query("prj_50_subagent_descriptor", bind.with_events("SELECT event_id, CASE WHEN k % 4 IN (1, 2) THEN 'a' || k END AS agent FROM ev"))
def _(spark, root):
    k = F.col("k")
    data = F.to_json(F.struct((k % 4).alias("version"), F.concat(F.lit("a"), k.cast("string")).alias("id")))
    return bind.events(spark, root).select("event_id", R.subagent_descriptor(data)["id"].alias("agent"))


@query("prj_31_edit_evidence", bind.with_events("SELECT event_id, CASE WHEN k % 3 <> 0 AND k % 4 <> 0 THEN 'a.py|b.py' END AS files FROM ev"))
def _(spark, root):
    k = F.col("k")

    def file(path, lines):
        return F.struct(path.alias("path"), F.array(F.struct(lines.alias("lines"))).alias("hunks"))
    some, none = F.array(F.lit("+x")), F.array().cast("array<string>")
    rec = F.try_parse_json(F.to_json(F.struct(F.struct(F.array(file(F.lit("a.py"), some), file(F.when(k % 3 == 0, "").otherwise("b.py"), F.when(k % 4 == 0, none).otherwise(some))).alias("files")).alias("bashEditDiff"))))
    return bind.events(spark, root).select("event_id", F.array_join(R.edit_evidence(rec), "|").alias("files"))


@query("scl_05_safe_json", bind.with_events("SELECT event_id, CASE WHEN k % 3 <> 0 THEN k END AS n, k % 3 <> 0 AS ok FROM ev"))
def _(spark, root):
    k = F.col("k")
    v = F.try_parse_json(F.when(k % 3 == 0, "{bad").otherwise(F.concat(F.lit('{"n":'), k.cast("string"), F.lit("}"))))
    return bind.events(spark, root).select("event_id", R.get(v, "$.n", "bigint").alias("n"), v.isNotNull().alias("ok"))


@query("scl_08_array_helpers", bind.with_events("SELECT event_id, CAST(k + k + 1 AS BIGINT) AS total, k % 2 = 0 AS any_even_first, CAST(k AS BIGINT) AS head FROM ev"))
def _(spark, root):
    a = F.array(F.col("k"), F.col("k") + 1)
    return bind.events(spark, root).select("event_id", F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.exists(F.slice(a, 1, 1), lambda x: x % 2 == 0).alias("any_even_first"), F.get(F.filter(a, lambda x: x >= 0), F.lit(0)).alias("head"))


@query("scl_09_exact_keys", bind.with_events("SELECT event_id, k % 3 = 0 AS exact, CASE WHEN k % 3 = 1 THEN 'c' ELSE '' END AS residual FROM ev"))
def _(spark, root):
    k = F.col("k")
    rec = F.when(k % 3 == 0, '{"a":1,"b":null}').when(k % 3 == 1, '{"a":1,"b":2,"c":3}').otherwise('{"a":1}')
    return bind.events(spark, root).select("event_id", search_json.has_only_keys(rec, ["a", "b"]).alias("exact"), F.array_join(search_json.residual_keys(rec, ["a", "b"]), "|").alias("residual"))


@query("scl_11_hashing", bind.with_events("SELECT event_id, sha256(length(kind) || ':' || kind || length(tool_name) || ':' || tool_name) AS framed FROM ev"))
def _(spark, root):
    def framed(c):
        return F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return bind.events(spark, root).select("event_id", F.sha2(F.concat(framed(F.col("kind")), framed(F.col("tool_name"))), 256).alias("framed"))


@query("scl_12_goal_status", bind.with_events("""
SELECT event_id, CASE k % 6 WHEN 0 THEN 'budget_limited' WHEN 1 THEN 'usage_limited' WHEN 2 THEN 'complete' WHEN 3 THEN 'in_progress' WHEN 4 THEN 'not_started_yet' ELSE '' END AS status FROM ev"""))
def _(spark, root):
    s = F.element_at(F.array(*[F.lit(x) for x in ("budgetLimited", "usagelimited", " Completed ", "inProgress", "not started-yet", "")]), (F.col("k") % 6 + 1).cast("int"))
    return bind.events(spark, root).select("event_id", R.goal_status(s).alias("status"))


@query("src_02_line_numbered_scan", "SELECT count(*) AS lines, count(*) AS positions, CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS torn FROM events")
def _(spark, root):
    """Written as text files and read back by the splittable scan: every line gets one place, in order."""
    path = scratch_path(spark, "lines")
    ev = bind.events(spark, root).select("line", F.to_json(F.struct("line", "kind")).alias("value"))
    ev.repartitionByRange(8, "line").sortWithinPartitions("line").select("value").write.text(path)
    lines = files.read_lines(spark, path, "part-*").withColumn("source_line", F.get_json_object("text", "$.line").cast("bigint"))
    first = lines.groupBy("file").agg(F.min("source_line").alias("_from"))
    seen = lines.join(first, "file")
    return seen.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("file", "line").alias("positions"),
                    F.count_if(F.col("source_line") != F.col("_from") + F.col("line") - 1).alias("out_of_order"), F.count_if("torn").alias("torn"))
