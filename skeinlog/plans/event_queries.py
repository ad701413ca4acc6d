"""Events of the block and event-log families: each raw row, or block of one, in exactly one event."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.operators import claims
from skeinlog.plans import bind
from skeinlog.plans.record_queries import landed, session_file
from skeinlog.plans.registry import query
from skeinlog.sources import claude, deepseek, files, registry


def block_lines(spark, root):
    """A line per event: talk, thinking, calls, results, compactions with summaries, service errors, told and broken rows."""
    ev, k = bind.events(spark, root), F.col("k")

    def block(kind, **more):
        return F.struct(F.lit(kind).alias("type"), *[more.get(n, F.lit(None).cast("string")).alias(n) for n in ("text", "thinking", "id", "name", "tool_use_id")])

    def record(kind, *blocks, model=None, **flags):
        said = F.struct(*([F.array(*blocks).alias("content")] if blocks else []), (F.lit(model) if model else F.lit("m")).alias("model"))
        return F.to_json(F.struct(F.lit(kind).alias("type"), F.col("ts_text").alias("timestamp"), *[f.alias(n) for n, f in flags.items()], said.alias("message")))
    yes, call = F.lit(True), F.concat(F.lit("u"), (k % 25).cast("string"))
    said = block("text", text=F.col("preview"))
    body = (F.when(F.col("tool_name") != "", record("assistant", said, block("tool_use", id=call, name=F.col("tool_name"))))
            .when(F.col("kind") == "error", record("user", block("tool_result", tool_use_id=call)))
            .when((F.col("role") == "user") & (k % 10 == 9), "{broken")
            .when((F.col("role") == "user") & (k % 7 == 3), record("user", said, isMeta=yes))
            .when((F.col("role") == "user") & (k % 10 == 8), record("user", block("text", text=F.lit(" \n"))))
            .when(F.col("role") == "user", record("user", said))
            .when(F.col("kind") == "compaction", record("system", subtype=F.lit("compact_boundary")))
            .when(F.col("kind") == "reasoning", record("assistant", block("thinking", thinking=F.col("preview")), block("text", text=F.lit(""))))
            .when(F.col("kind") == "proposed_plan", record("assistant", said, isApiErrorMessage=yes))
            .when((F.col("kind") == "token_count") & (k % 10 == 9), record("user", said, isCompactSummary=yes))
            .when(F.col("kind") == "token_count", record("system", subtype=F.lit("informational")))
            .when(k % 31 == 5, record("assistant", said, model="<synthetic>")).otherwise(record("assistant", said)))
    return landed(ev.select("session_id", session_file().alias("file"), "line", body.alias("text")))


BLOCK_SQL = """
WITH u AS (
  SELECT session_id, line, 0 AS block, 'assistant_message' AS kind, '' AS id, 0 AS part FROM ev WHERE tool_name <> ''
  UNION ALL SELECT session_id, line, 1, 'protocol', 'u' || (k % 25), 1 FROM ev WHERE tool_name <> ''
  UNION ALL SELECT session_id, line, 0, 'protocol', 'u' || (k % 25), 2 FROM ev WHERE kind = 'error'
  UNION ALL SELECT session_id, line, CASE WHEN k % 10 = 9 OR k % 7 = 3 THEN -1 ELSE 0 END, CASE WHEN k % 10 = 9 OR k % 7 = 3 THEN 'protocol' ELSE 'user_message' END, '', 0
    FROM ev WHERE role = 'user' AND NOT (k % 10 = 8 AND k % 7 <> 3)
  UNION ALL SELECT session_id, line, -1, 'compaction', '', 3 FROM ev WHERE kind = 'compaction'
  UNION ALL SELECT session_id, line, 0, 'reasoning', '', 0 FROM ev WHERE kind = 'reasoning'
  UNION ALL SELECT session_id, line, -1, 'error', '', 0 FROM ev WHERE kind = 'proposed_plan'
  UNION ALL SELECT session_id, line, -1, 'protocol', '', CASE WHEN k % 10 = 9 THEN 4 ELSE 0 END FROM ev WHERE kind = 'token_count'
  UNION ALL SELECT session_id, line, CASE WHEN k % 31 = 5 THEN -1 ELSE 0 END, CASE WHEN k % 31 = 5 THEN 'protocol' ELSE 'assistant_message' END, '', 0 FROM ev WHERE kind = 'assistant_message'
), g AS (
  SELECT session_id, id, min(line) FILTER (WHERE part = 1) AS cl, CASE WHEN count(*) FILTER (WHERE part = 2) = 1 THEN min(line) FILTER (WHERE part = 2) END AS rl
  FROM u WHERE id <> '' GROUP BY 1, 2 HAVING count(*) FILTER (WHERE part = 1) = 1
), s AS (
  SELECT *, count(*) FILTER (WHERE part = 3) OVER (PARTITION BY session_id ORDER BY line) AS seg FROM u WHERE part IN (3, 4)
), b AS (
  SELECT session_id, min(line) FILTER (WHERE part = 3) AS cl, min(line) FILTER (WHERE part = 4) AS rl FROM s WHERE seg > 0 GROUP BY session_id, seg
), x AS (
  SELECT u.session_id, u.line, u.block, u.kind, CASE WHEN part = 1 AND u.line = g.cl THEN g.cl WHEN part = 2 AND u.line = g.rl AND g.rl > g.cl THEN g.cl WHEN part = 3 THEN b.cl WHEN part = 4 THEN c.cl END AS lead, part
  FROM u LEFT JOIN g ON g.session_id = u.session_id AND g.id = u.id AND u.id <> '' LEFT JOIN b ON part = 3 AND b.session_id = u.session_id AND b.cl = u.line LEFT JOIN b c ON part = 4 AND c.session_id = u.session_id AND c.rl = u.line
), r AS (
  SELECT session_id, line, block, CASE WHEN lead IS NULL THEN 'event:' || line || ':' || block WHEN part IN (1, 2) THEN 'event:' || lead || ':1' ELSE 'event:' || lead || ':-1' END AS event_id,
    CASE WHEN lead IS NULL THEN kind WHEN part IN (1, 2) THEN 'tool_call' ELSE 'compaction' END AS kind,
    CASE WHEN lead IS NULL THEN 'own' WHEN part IN (1, 3) THEN 'lead' ELSE 'member' END AS part FROM x
)
"""


@query("prj_45_block_claims", bind.with_events(f"{BLOCK_SQL} SELECT session_id, line, block, event_id, kind, part FROM r"))
def _(spark, root):
    return claude.to_logical(files.parsed(block_lines(spark, root))).select("session_id", "line", "block", "event_id", "kind", "part")


EVENTS_OF_R = """SELECT session_id, event_id, min(line) AS line, arg_min(kind, (part = 'member', line)) AS kind, count(*) AS units,
  CASE WHEN arg_min(kind, (part = 'member', line)) = 'protocol' THEN 'protocol' ELSE 'main' END AS layer FROM r GROUP BY 1, 2"""


@query("udf_01_block_family_events", bind.with_events(f"{BLOCK_SQL} {EVENTS_OF_R}"))
def _(spark, root):
    return registry.logical_events("claude", files.parsed(block_lines(spark, root)))


def log_lines(spark, root):
    """A header a session, then a record per event: messages, streamed rows, calls, results, compactions, replaced surfaces."""
    ev, k = bind.events(spark, root), F.col("k")
    turn, step = F.floor(F.col("line") / 2500), k % 3

    def record(kind, *data, **more):
        return F.to_json(F.struct(F.lit(kind).alias("type"), (F.col("line") * 3).alias("seq"), *[m.alias(n) for n, m in more.items()], F.struct(turn.alias("turn"), *data).alias("data")))
    call, spoken = F.concat(F.lit("c"), (k % 25).cast("string")).alias("callId"), step.alias("step")
    replaced, id_ = F.struct(F.lit("replace").alias("kind")), F.concat(F.lit("z"), F.floor(F.col("line") / 1000).cast("string")).alias("compactionId")
    body = (F.when(F.col("tool_name") != "", record("tool/call", call)).when((F.col("kind") == "error") & (k % 9 == 4), record("tool/result", call, surfaceOp=replaced))
            .when(F.col("kind") == "error", record("tool/result", call)).when((F.col("role") == "user") & (k % 10 == 9), "{broken")
            .when((F.col("role") == "user") & (k % 4 == 1), record("user/message", F.struct(F.lit("plugin").alias("kind")).alias("source"))).when(F.col("role") == "user", record("user/message"))
            .when(F.col("kind") == "compaction", record("compaction/start", id_)).when(F.col("kind") == "reasoning", record("compaction/summary", id_))
            .when(F.col("kind") == "token_count", record("assistant/chunk", spoken)).when(k % 6 == 1, record("assistant/message", spoken)).otherwise(record("step/start", spoken)))
    first = ev.groupBy("session_id").agg(F.min("line").alias("_first"))
    version = F.when(F.col("session_id").cast("bigint") % 10 == 3, 7).otherwise(4)
    head = first.select("session_id", session_file().alias("file"), F.lit(1).cast("bigint").alias("line"), F.to_json(F.struct(F.lit("session").alias("type"), version.alias("version"), F.col("session_id").alias("id"))).alias("text"))
    return landed(head.unionByName(ev.select("session_id", session_file().alias("file"), (F.col("line") + 2).alias("line"), body.alias("text"))))


LOG_SQL = """
WITH e AS (
  SELECT session_id, line + 2 AS line, k, line // 2500 AS turn, k % 3 AS step, 'c' || (k % 25) AS cid, 'z' || (line // 1000) AS zid,
    CASE WHEN tool_name <> '' THEN 'call' WHEN kind = 'error' THEN CASE WHEN k % 9 = 4 THEN 'replaced' ELSE 'result' END WHEN role = 'user' THEN CASE WHEN k % 10 = 9 THEN 'broken' WHEN k % 4 = 1 THEN 'told' ELSE 'user' END
      WHEN kind = 'compaction' THEN 'start' WHEN kind = 'reasoning' THEN 'summary' WHEN kind = 'token_count' THEN 'chunk' WHEN k % 6 = 1 THEN 'said' ELSE 'step' END AS part
  FROM ev WHERE CAST(session_id AS BIGINT) % 10 <> 3
), z AS (SELECT session_id, zid, min(line) AS lead FROM e WHERE part = 'start' GROUP BY 1, 2 HAVING count(*) = 1
), g AS (
  SELECT session_id, cid, min(line) FILTER (WHERE part = 'call') AS cl, CASE WHEN count(*) FILTER (WHERE part = 'result') = 1 THEN min(line) FILTER (WHERE part = 'result') END AS rl
  FROM e WHERE part IN ('call', 'result') GROUP BY 1, 2 HAVING count(*) FILTER (WHERE part = 'call') = 1
), st AS (
  SELECT session_id, turn, step, min(line) FILTER (WHERE part = 'said') AS said, min(line) FILTER (WHERE part = 'chunk') AS shown FROM e WHERE part IN ('said', 'chunk') GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE part = 'chunk') > 0
), x AS (
  SELECT e.*, CASE WHEN part IN ('start', 'summary') AND z.lead <= line THEN z.lead WHEN part = 'call' THEN g.cl WHEN part = 'result' AND line = g.rl AND g.rl > g.cl THEN g.cl
    WHEN part = 'chunk' THEN coalesce(st.said, st.shown) WHEN part = 'said' AND line = st.said THEN st.said END AS lead, st.said
  FROM e LEFT JOIN z ON z.session_id = e.session_id AND z.zid = e.zid LEFT JOIN g ON g.session_id = e.session_id AND g.cid = e.cid LEFT JOIN st ON st.session_id = e.session_id AND st.turn = e.turn AND st.step = e.step
), r AS (
  SELECT session_id, line, -1 AS block, 'event:' || coalesce(lead, line) || ':-1' AS event_id,
    CASE WHEN lead IS NOT NULL THEN CASE WHEN part IN ('start', 'summary') THEN 'compaction' WHEN part IN ('call', 'result') THEN 'tool_call' WHEN said IS NULL THEN 'partial_message' ELSE 'assistant_message' END
      WHEN part IN ('call', 'result') THEN 'tool_call' WHEN part = 'start' THEN 'compaction' WHEN part = 'said' THEN 'assistant_message' WHEN part = 'user' THEN 'user_message' ELSE 'protocol' END AS kind,
    CASE WHEN lead IS NULL THEN 'own' WHEN lead = line THEN 'lead' ELSE 'member' END AS part FROM x
  UNION ALL SELECT DISTINCT session_id, 1, -1, 'event:1:-1', 'protocol', 'own' FROM ev WHERE CAST(session_id AS BIGINT) % 10 <> 3
)
"""


@query("prj_45_log_claims", bind.with_events(f"{LOG_SQL} SELECT session_id, line, block, event_id, kind, part FROM r"))
def _(spark, root):
    return deepseek.to_logical(files.parsed(log_lines(spark, root))).select("session_id", "line", "block", "event_id", "kind", "part")


@query("udf_01_log_family_events", bind.with_events(f"{LOG_SQL} {EVENTS_OF_R}"))
def _(spark, root):
    return registry.logical_events("deepseek", files.parsed(log_lines(spark, root)))


@query("lif_20_each_row_in_one_event", bind.with_events(f"""{LOG_SQL}, n AS (SELECT session_id, line, block, count(DISTINCT event_id) AS events, count(*) AS copies FROM r GROUP BY 1, 2, 3)
SELECT events, copies, count(*) AS units FROM n GROUP BY 1, 2"""))
def _(spark, root):
    placed = deepseek.to_logical(files.parsed(log_lines(spark, root)))
    each = placed.groupBy(*claims.UNIT).agg(F.count_distinct("event_id").alias("events"), F.count("*").alias("copies"))
    return each.groupBy("events", "copies").agg(F.count("*").alias("units"))
