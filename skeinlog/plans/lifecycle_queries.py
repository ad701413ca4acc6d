"""Lifecycle queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import classify
from skeinlog.operators import aggregates, lifecycle, ordered, pairing, windows
from skeinlog.plans import bind
from skeinlog.plans.registry import query
from skeinlog.plans.relation_queries import TREE_SQL, tree
from skeinlog.session import table


def tagged(prefix, n):
    return F.concat(F.lit(prefix), (F.col("k") % n).cast("string"))


@query("lif_04_hook_lifecycle", bind.with_events("""
WITH h AS (SELECT session_id, k % 8 AS call_id, line, event_id, CASE k % 3 WHEN 0 THEN 'hook_begin' WHEN 1 THEN 'hook_end' ELSE 'hook_declined' END AS t, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS rank FROM ev WHERE tool_name <> '')
SELECT session_id, call_id, arg_max(event_id, (rank, line)) AS event_id, CASE WHEN max(rank) = 1 THEN 'start' ELSE 'terminal' END AS phase FROM h GROUP BY 1, 2"""))
def _(spark, root):
    wire = F.element_at(F.array(*[F.lit(x) for x in ("hook_begin", "hook_end", "hook_declined")]), (F.col("k") % 3 + 1).cast("int"))
    rows = bind.events(spark, root).filter("tool_name <> ''").select("session_id", (F.col("k") % 8).alias("call_id"), "line", "event_id", wire.alias("payload_type"))
    r = aggregates.representative(rows, ["session_id", "call_id"], classify.lifecycle_dimension(spark), ["event_id"])
    return r.select("session_id", "call_id", "event_id", "phase")


@query("lif_08_approvals", bind.with_events("""
WITH r AS (SELECT session_id, 'r' || (k % 25) AS request_id, line, CASE WHEN tool_name <> '' THEN 'asked' ELSE 'decided' END AS part, CASE WHEN k % 4 = 0 THEN 'unavailable' ELSE 'approved' END AS outcome, k = 13 AS malformed FROM ev WHERE tool_name <> '' OR role = 'assistant'),
g AS (SELECT session_id, request_id, count(*) FILTER (WHERE part = 'asked') AS a, count(*) FILTER (WHERE part = 'decided') AS d, bool_or(malformed) AS m, min(line) FILTER (WHERE part = 'asked') AS al, min(line) FILTER (WHERE part = 'decided') AS dl, arg_min(outcome, line) FILTER (WHERE part = 'decided') AS o FROM r GROUP BY 1, 2),
v AS (SELECT *, NOT m AND a = 1 AND d <= 1 AND (dl IS NULL OR dl > al) AS ok FROM g)
SELECT session_id, request_id, CASE WHEN NOT ok THEN 'fallback' WHEN d = 1 THEN 'recorded' ELSE 'incomplete' END AS status, CASE WHEN ok AND o = 'unavailable' THEN 'warning' ELSE 'normal' END AS severity,
  al AS asked_line, CASE WHEN ok THEN dl END AS decided_line, CASE WHEN ok THEN o END AS outcome FROM v"""))
def _(spark, root):
    asked = F.col("tool_name") != ""
    rows = bind.events(spark, root).filter(asked | (F.col("role") == "assistant")).select(
        "session_id", tagged("r", 25).alias("request_id"), "line", F.when(asked, "asked").otherwise("decided").alias("part"),
        F.when(F.col("k") % 4 == 0, "unavailable").otherwise("approved").alias("outcome"), (F.col("k") == 13).alias("malformed"))
    return lifecycle.approvals(rows)


@query("lif_09_commands", bind.with_events("""
WITH r AS (SELECT session_id, 'c' || (k % 25) AS command_id, line, CASE WHEN tool_name <> '' THEN 'run' ELSE 'done' END AS part, CASE WHEN k % 4 = 0 THEN 'error' ELSE 'success' END AS result FROM ev WHERE tool_name <> '' OR role = 'assistant'),
g AS (SELECT session_id, command_id, count(*) FILTER (WHERE part = 'run') AS a, count(*) FILTER (WHERE part = 'done') AS d, min(line) FILTER (WHERE part = 'run') AS run_line, min(line) FILTER (WHERE part = 'done') AS done_line, arg_min(result, line) FILTER (WHERE part = 'done') AS o FROM r GROUP BY 1, 2)
SELECT session_id, command_id, run_line, done_line, CASE WHEN o = 'error' THEN 'failed' ELSE 'success' END AS status FROM g WHERE a = 1 AND d = 1 AND done_line > run_line"""))
def _(spark, root):
    run = F.col("tool_name") != ""
    rows = bind.events(spark, root).filter(run | (F.col("role") == "assistant")).select(
        "session_id", tagged("c", 25).alias("command_id"), "line", F.when(run, "run").otherwise("done").alias("part"),
        F.when(F.col("k") % 4 == 0, "error").otherwise("success").alias("result"))
    return lifecycle.commands(rows)


RETRY_SQL = """rt AS (SELECT session_id, 'r' || (k % 9) AS retry_id, line, CASE WHEN tool_name <> '' THEN 'scheduled' ELSE 'started' END AS part, CASE WHEN k = 40 THEN 'p2' ELSE 'p1' END AS policy,
    row_number() OVER (PARTITION BY session_id, k % 9, tool_name <> '' ORDER BY line) AS retry FROM ev WHERE tool_name <> '' OR role = 'assistant')"""


@query("lif_10_retry_chains", bind.with_events(f"""
WITH {RETRY_SQL}, a AS (SELECT session_id, retry_id, retry, count(*) FILTER (WHERE part = 'scheduled') AS ns, count(*) FILTER (WHERE part = 'started') AS nt, min(line) FILTER (WHERE part = 'scheduled') AS s, min(line) FILTER (WHERE part = 'started') AS t, min(policy) AS p1, max(policy) AS p2 FROM rt GROUP BY 1, 2, 3),
g AS (SELECT session_id, retry_id, CAST(sum(ns) AS BIGINT) AS schedules, min(p1) <> max(p2) AS mixed, bool_or(t < s) AS early, bool_or(nt > 0 AND ns = 0) AS stray, count(*) FILTER (WHERE ns > 0 AND nt = 0) AS unstarted, arg_max(nt, retry) AS last_started FROM a GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN schedules = 0 THEN 'no scheduled retry' WHEN mixed THEN 'inconsistent identity or numbering' WHEN early THEN 'started before scheduled'
  WHEN unstarted > CASE WHEN last_started = 0 THEN 1 ELSE 0 END THEN 'gap before a later retry' WHEN stray THEN 'start without schedule' ELSE '' END AS reason FROM g)
SELECT session_id, retry_id, schedules, reason, CASE WHEN reason <> '' THEN 'fallback' WHEN last_started > 0 THEN 'started' ELSE 'scheduled' END AS status FROM r"""))
def _(spark, root):
    sched = F.col("tool_name") != ""
    rows = bind.events(spark, root).filter(sched | (F.col("role") == "assistant")).select(
        "session_id", tagged("r", 9).alias("retry_id"), "line", F.when(sched, "scheduled").otherwise("started").alias("part"), F.when(F.col("k") == 40, "p2").otherwise("p1").alias("policy"))
    return lifecycle.retry_chains(ordered.scan(rows, ["session_id", "retry_id", "part"], "line", retry=ordered.RowNumber()))


WORKFLOW_SQL = """wn AS (SELECT session_id, 'w' || (line // 1000) AS run_id, line, k, row_number() OVER (PARTITION BY session_id, line // 1000 ORDER BY line) AS n, count(*) OVER (PARTITION BY session_id, line // 1000) AS c FROM ev),
wf AS (SELECT session_id, run_id, line, CASE WHEN n = 1 THEN 'run-start' WHEN n = c AND c % 2 = 0 THEN 'run-end' WHEN n % 2 = 0 THEN 'agent-start' ELSE 'agent-end' END AS part, n // 2 AS member,
    CASE WHEN n = c AND c % 2 = 0 THEN (CASE k % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'error' ELSE 'cancelled' END) WHEN k = 13 THEN 'odd' ELSE (CASE k % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'cancelled' END) END AS outcome FROM wn)"""


def workflow_rows(spark, root):
    run = F.concat(F.lit("w"), F.floor(F.col("line") / 1000).cast("string"))
    ev = bind.events(spark, root).select("session_id", run.alias("run_id"), "line", "k")
    r = ordered.scan(ev, ["session_id", "run_id"], "line", n=ordered.RowNumber())
    r = r.join(ev.groupBy("session_id", "run_id").agg(F.count(F.lit(1)).alias("c")), ["session_id", "run_id"])
    ends = (F.col("n") == F.col("c")) & (F.col("c") % 2 == 0)
    part = F.when(F.col("n") == 1, "run-start").when(ends, "run-end").when(F.col("n") % 2 == 0, "agent-start").otherwise("agent-end")

    def pick(*names):
        return F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("k") % 3 + 1).cast("int"))
    return r.select("session_id", "run_id", "line", part.alias("part"), F.floor(F.col("n") / 2).alias("member"),
                    F.when(ends, pick("completed", "error", "cancelled")).when(F.col("k") == 13, "odd").otherwise(pick("completed", "failed", "cancelled")).alias("outcome"))


_WORKFLOW = f"""{WORKFLOW_SQL}, mb AS (SELECT session_id, run_id, member, count(*) FILTER (WHERE part = 'agent-start') AS s, count(*) FILTER (WHERE part = 'agent-end') AS e, min(outcome) FILTER (WHERE part = 'agent-end') AS o FROM wf WHERE part LIKE 'agent%' GROUP BY 1, 2, 3),
mr AS (SELECT session_id, run_id, count(*) AS members, bool_or(e = 1 AND o = 'odd') AS bad, count(*) FILTER (WHERE e = 0) AS open, count(*) FILTER (WHERE o = 'completed') AS completed, count(*) FILTER (WHERE o = 'failed') AS failed, count(*) FILTER (WHERE o = 'cancelled') AS cancelled FROM mb GROUP BY 1, 2),
rr AS (SELECT session_id, run_id, max(outcome) FILTER (WHERE part = 'run-end') AS stop FROM wf GROUP BY 1, 2),
fin AS (SELECT rr.session_id, rr.run_id, coalesce(members, 0) AS members, coalesce(open, 0) AS open, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(cancelled, 0) AS cancelled, stop,
  CASE WHEN coalesce(bad, false) THEN 'invalid member' WHEN stop IS NOT NULL AND coalesce(open, 0) > 0 THEN 'member left open' ELSE '' END AS reason FROM rr LEFT JOIN mr USING (session_id, run_id))"""


@query("lif_11_workflow_runs", bind.with_events(f"""WITH {_WORKFLOW} SELECT session_id, run_id, reason,
  CASE WHEN reason <> '' THEN 'fallback' WHEN stop = 'completed' THEN 'success' WHEN stop = 'error' THEN 'failed' WHEN stop = 'cancelled' THEN 'cancelled' ELSE 'incomplete' END AS status FROM fin"""))
def _(spark, root):
    return lifecycle.workflow_runs(workflow_rows(spark, root)).select("session_id", "run_id", "reason", "status")


@query("agg_20_workflow_member_outcomes", bind.with_events(f"WITH {_WORKFLOW} SELECT session_id, run_id, members, completed, failed, cancelled, open FROM fin"))
def _(spark, root):
    return lifecycle.workflow_runs(workflow_rows(spark, root)).select("session_id", "run_id", "members", "completed", "failed", "cancelled", "open")


@query("lif_16_compactions", bind.with_events("""
WITH c AS (SELECT session_id, 'x' || (k % 15) AS compaction_id, line, CASE k % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'summary' WHEN 2 THEN 'prune' ELSE 'end' END AS part, CASE WHEN k % 7 = 0 THEN 'error' ELSE 'ok' END AS outcome, preview FROM ev)
SELECT session_id, compaction_id, CASE WHEN count(*) FILTER (WHERE part = 'end') = 0 THEN 'incomplete' WHEN arg_max(outcome, line) FILTER (WHERE part = 'end') = 'error' THEN 'failed' ELSE 'success' END AS status,
  coalesce(arg_max(preview, line) FILTER (WHERE part = 'summary'), '') AS summary, count(*) FILTER (WHERE part = 'prune') AS prunes FROM c GROUP BY 1, 2"""))
def _(spark, root):
    part = F.element_at(F.array(*[F.lit(x) for x in ("start", "summary", "prune", "end")]), (F.col("k") % 4 + 1).cast("int"))
    rows = bind.events(spark, root).select("session_id", tagged("x", 15).alias("compaction_id"), "line", part.alias("part"),
                                           F.when(F.col("k") % 7 == 0, "error").otherwise("ok").alias("outcome"), F.col("preview").alias("text"))
    return lifecycle.compactions(rows)


@query("lif_06_goals_by_condition", bind.with_events("""
WITH g AS (SELECT session_id, k % 20 AS condition, line, CASE WHEN role = 'user' THEN 'initial' WHEN role = 'assistant' THEN 'terminal' ELSE 'hook' END AS part, CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'complete' END AS state FROM ev WHERE role <> '' OR kind = 'error'),
a AS (SELECT session_id, condition, count(*) FILTER (WHERE part = 'initial') AS i, count(*) FILTER (WHERE part = 'terminal') AS t, count(*) FILTER (WHERE part = 'hook') AS h, min(line) FILTER (WHERE part = 'initial') AS f, min(line) FILTER (WHERE part = 'terminal') AS l, arg_min(state, line) FILTER (WHERE part = 'terminal') AS s FROM g GROUP BY 1, 2),
v AS (SELECT *, i = 1 AND t <= 1 AND (l IS NULL OR l > f) AS ok FROM a)
SELECT session_id, condition, CASE WHEN NOT ok THEN 'fallback' WHEN t = 0 THEN 'active' ELSE s END AS status, CASE WHEN ok THEN h ELSE 0 END AS hooks FROM v"""))
def _(spark, root):
    part = F.when(F.col("role") == "user", "initial").when(F.col("role") == "assistant", "terminal").otherwise("hook")
    rows = bind.events(spark, root).filter("role <> '' or kind = 'error'").select(
        "session_id", (F.col("k") % 20).alias("condition"), "line", part.alias("part"), F.when(F.col("k") % 3 == 0, "failed").otherwise("complete").alias("state"))
    return lifecycle.goals_by_condition(rows)


@query("lif_06_goals_by_descent", f"""
WITH RECURSIVE {bind.EVENTS_SQL}, {TREE_SQL},
r AS (SELECT session_id, line, uuid, parent_uuid, 'g' || (line // 400) AS condition, k,
    CASE WHEN role = 'user' AND k % 9 = 1 THEN 'initial' WHEN kind = 'compaction' AND k % 7 = 2 THEN 'terminal' WHEN kind = 'token_count' AND k % 8 = 3 THEN 'hook' WHEN kind = 'error' AND k % 6 = 2 THEN 'error' END AS part FROM tr),
f AS (SELECT session_id, condition, count(*) FILTER (WHERE part = 'initial') AS i, count(*) FILTER (WHERE part = 'terminal') AS t, min(line) FILTER (WHERE part = 'initial') AS a, min(line) FILTER (WHERE part = 'terminal') AS z, min(k) FILTER (WHERE part = 'terminal') AS zk
  FROM r WHERE part IN ('initial', 'terminal') GROUP BY 1, 2),
g AS (SELECT *, i = 1 AND t <= 1 AND (z IS NULL OR z > a) AS single FROM f),
c AS (SELECT r.*, a, z FROM r JOIN g USING (session_id, condition) WHERE single AND part <> 'initial' AND line > a AND parent_uuid IS NOT NULL),
wk AS (SELECT session_id, line, a, parent_uuid AS cur FROM c UNION ALL SELECT wk.session_id, wk.line, a, tr.parent_uuid FROM wk JOIN tr ON tr.session_id = wk.session_id AND tr.uuid = wk.cur WHERE CAST(wk.cur AS BIGINT) > a),
d AS (SELECT c.* FROM c JOIN (SELECT DISTINCT session_id, line FROM wk WHERE CAST(cur AS BIGINT) = a) USING (session_id, line)),
h AS (SELECT d.session_id, d.condition, d.line, e.line AS above, CASE WHEN d.k % 16 = 3 THEN e.line IS NULL ELSE e.line IS NOT NULL AND e.condition = d.condition END AS fine, d.k % 16 <> 3 AS counts
  FROM d LEFT JOIN r e ON e.part = 'error' AND e.session_id = d.session_id AND e.uuid = d.parent_uuid WHERE d.part = 'hook' AND (z IS NULL OR d.line < z OR CAST(d.parent_uuid AS BIGINT) = z)),
hs AS (SELECT session_id, condition, count(*) AS hooks, count(*) FILTER (WHERE NOT fine) AS bad FROM h GROUP BY 1, 2),
es AS (SELECT d.session_id, d.condition, count(*) AS errors, count(*) FILTER (WHERE o.above IS NULL) AS stray FROM d LEFT JOIN (SELECT DISTINCT session_id, condition, above FROM h WHERE fine AND counts) o ON o.session_id = d.session_id AND o.condition = d.condition AND o.above = d.line
  WHERE part = 'error' AND (z IS NULL OR d.line < z) GROUP BY 1, 2),
ts AS (SELECT session_id, condition, count(*) AS ended FROM d WHERE part = 'terminal' GROUP BY 1, 2),
v AS (SELECT g.*, hooks, errors, single AND coalesce(ended, 0) = t AND coalesce(bad, 0) = 0 AND coalesce(stray, 0) = 0 AS ok FROM g LEFT JOIN hs USING (session_id, condition) LEFT JOIN es USING (session_id, condition) LEFT JOIN ts USING (session_id, condition))
SELECT session_id, condition, CASE WHEN NOT ok THEN 'fallback' WHEN t = 0 THEN 'active' WHEN zk % 2 = 0 THEN 'complete' ELSE 'failed' END AS status, CAST(CASE WHEN ok THEN coalesce(hooks, 0) ELSE 0 END AS BIGINT) AS hooks, CAST(CASE WHEN ok THEN coalesce(errors, 0) ELSE 0 END AS BIGINT) AS hook_errors FROM v""")
def _(spark, root):
    t, k = tree(spark, root), F.col("k")
    part = (F.when((F.col("role") == "user") & (k % 9 == 1), "initial").when((F.col("kind") == "compaction") & (k % 7 == 2), "terminal")
            .when((F.col("kind") == "token_count") & (k % 8 == 3), "hook").when((F.col("kind") == "error") & (k % 6 == 2), "error"))
    rows = t.select("session_id", F.concat(F.lit("g"), F.floor(F.col("line") / 400).cast("string")).alias("condition"), "line", "uuid", "parent_uuid", part.alias("part"), F.lit(True).alias("valid"),
                    F.when(k % 16 == 3, 0).otherwise(1).alias("errors"), F.lit("tool").alias("tool_use_id"), F.when(k % 2 == 0, "complete").otherwise("failed").alias("state")).filter("part is not null")
    return lifecycle.goals_by_descent(rows, t.select("session_id", "uuid", "parent_uuid"))


@query("lif_14_partial_messages", bind.with_events("""
WITH c AS (SELECT session_id, line // 2500 AS turn, k % 2 AS step, 'text' AS channel, line, search_text AS text FROM ev WHERE role = 'assistant'),
o AS (SELECT * FROM c WHERE (session_id, turn, step) NOT IN (SELECT (session_id, line // 2500, k % 2) FROM ev WHERE role = 'user' AND k % 3 = 0))
SELECT session_id, turn, step, channel, count(*) AS chunks, left(string_agg(text, '' ORDER BY line), 16000) AS text FROM o GROUP BY 1, 2, 3, 4"""))
def _(spark, root):
    ev = bind.events(spark, root)
    step = [F.floor(F.col("line") / 2500).alias("turn"), (F.col("k") % 2).alias("step")]
    chunks = ev.filter("role = 'assistant'").select("session_id", *step, F.lit("text").alias("channel"), "line", F.col("search_text").alias("text"))
    return lifecycle.partial_messages(chunks, ev.filter("role = 'user' and k % 3 = 0").select("session_id", *step))


@query("lif_15_embedded_streams", """
WITH s AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM s),
q AS (SELECT doc_id AS event_id, pos, word AS text, pos % 3 AS block, CASE WHEN pos >= 30 AND pos % 7 = 0 THEN 'block-end' ELSE 'delta' END AS kind FROM p)
SELECT event_id, block, min(pos) AS first, count(*) FILTER (WHERE kind = 'delta') AS deltas, coalesce(arg_min(text, pos) FILTER (WHERE kind = 'block-end'), left(string_agg(text, '' ORDER BY pos) FILTER (WHERE kind = 'delta'), 16000), '') AS text,
  count(*) FILTER (WHERE kind = 'block-end') > 0 AS finished FROM q GROUP BY 1, 2""")
def _(spark, root):
    words = F.split("text", " ")
    stream = F.transform(words, lambda w, i: F.struct(F.when((i >= 30) & (i % 7 == 0), "block-end").otherwise("delta").alias("kind"), (i % 3).alias("block"), w.alias("text")))
    out = lifecycle.embedded_stream(table(spark, root, "documents").select(F.col("doc_id").alias("event_id"), stream.alias("stream")))
    return out.select("event_id", F.col("block").cast("bigint").alias("block"), F.col("first").cast("bigint").alias("first"), "deltas", "text", "finished")


@query("lif_17_async_outcomes", bind.with_events("""
WITH la AS (SELECT session_id, 't' || (k % 40) AS task_id, line, CASE WHEN k % 2 = 0 THEN 'background_command' ELSE 'async_agent' END AS kind FROM ev WHERE kind = 'command'),
so AS (SELECT session_id, task_id, min(line) AS l, min(kind) AS kind FROM la GROUP BY 1, 2 HAVING count(*) = 1),
nt AS (SELECT session_id, 't' || (k % 40) AS task_id, line, CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM ev WHERE kind = 'user_message'),
x AS (SELECT so.session_id, so.task_id, kind, arg_max(nt.status, nt.line) AS st FROM so LEFT JOIN nt ON nt.session_id = so.session_id AND nt.task_id = so.task_id AND nt.line > so.l GROUP BY 1, 2, 3)
SELECT session_id, task_id, kind, CASE WHEN st IS NULL THEN 'in_progress' WHEN st = 'failed' THEN 'failed' ELSE 'success' END AS outcome FROM x"""))
def _(spark, root):
    ev = bind.events(spark, root)
    task = tagged("t", 40)
    a = ev.filter("kind = 'command'").select("session_id", task.alias("task_id"), task.alias("call_id"), F.when(F.col("k") % 2 == 0, "background_command").otherwise("async_agent").alias("kind"), F.col("line").alias("launch_line"))
    b = ev.filter("kind = 'user_message'").select("session_id", task.alias("task_id"), task.alias("call_id"), "line", F.col("event_id").alias("fingerprint"), F.when(F.col("k") % 5 == 0, "failed").otherwise("completed").alias("status"))
    sole = pairing.unique_rows(a, ["session_id", "task_id"]).select(*a.columns)
    return lifecycle.async_outcomes(pairing.launch_notifications(sole, b)).select("session_id", "task_id", "kind", "outcome")


@query("lif_18_plan_rows", bind.with_events("""
SELECT session_id, event_id, CASE WHEN kind = 'proposed_plan' THEN 'artifact' ELSE 'update' END AS plan_category, preview FROM ev
WHERE (kind = 'proposed_plan' AND subtype = 'proposed_plan' AND tool_name = '') OR (kind = 'other_tool_call' AND subtype = 'update_plan' AND tool_name = 'update_plan')"""))
def _(spark, root):
    return lifecycle.plan_rows(bind.events(spark, root)).select("session_id", "event_id", "plan_category", "preview")


@query("lif_19_declared_requests", bind.with_events("""
WITH s AS (SELECT event_id, k, 'await tools.' || CASE WHEN tool_name = '' THEN 'exec_command' ELSE tool_name END || '({a: 1});' || CASE WHEN k % 5 = 0 THEN ' await tools.update_plan({b: 2});' ELSE '' END || CASE WHEN k % 7 = 0 THEN ' if (x) { y(); }' ELSE '' END || CASE WHEN k % 11 = 0 THEN ' tools.late' ELSE '' END AS src, tool_name FROM ev)
SELECT event_id, CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN '' ELSE (CASE WHEN tool_name = '' THEN 'exec_command' ELSE tool_name END) || CASE WHEN k % 5 = 0 AND tool_name <> 'update_plan' THEN '|update_plan' ELSE '' END END AS declared FROM s"""))
def _(spark, root):
    return scripts(spark, root).select("event_id", F.array_join("declared_requests", "|").alias("declared"))


def scripts(spark, root):
    k = F.col("k")
    tool = F.when(F.col("tool_name") == "", "exec_command").otherwise(F.col("tool_name"))
    source = F.concat(F.lit("await tools."), tool, F.lit("({a: 1});"), F.when(k % 5 == 0, " await tools.update_plan({b: 2});").otherwise(""),
                      F.when(k % 7 == 0, " if (x) { y(); }").otherwise(""), F.when(k % 11 == 0, " tools.late").otherwise(""))
    ev = bind.events(spark, root)
    return ev.withColumn("declared_requests", lifecycle.declared_requests(source))


@query("agg_09_request_catalogue", bind.with_events("""
WITH s AS (SELECT CASE WHEN tool_name = '' THEN 'exec_command' ELSE tool_name END AS t, k FROM ev WHERE k % 7 <> 0 AND k % 11 <> 0),
u AS (SELECT t AS request FROM s UNION ALL SELECT 'update_plan' FROM s WHERE k % 5 = 0 AND t <> 'update_plan') SELECT request, count(*) AS events FROM u GROUP BY 1"""))
def _(spark, root):
    return aggregates.request_catalogue(scripts(spark, root))


@query("flt_06_request_filter", bind.with_events("""
SELECT event_id, 'request' AS asked FROM ev WHERE layer = 'main' AND k % 3 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 AND (k % 5 = 0 OR tool_name = 'update_plan')
UNION ALL SELECT event_id, 'script' FROM ev WHERE layer = 'main' AND k % 3 <> 0 AND (k % 7 = 0 OR k % 11 = 0)"""))
def _(spark, root):
    from skeinlog.functions import vocabulary as V
    from skeinlog.operators import search
    known = [t for t, *_ in V.SCRIPTED_TOOLS]
    rows = scripts(spark, root).withColumn("kind", F.when(F.col("k") % 3 != 0, search.SCRIPTED).otherwise(F.col("kind")))
    asked = {"request": search.Filters(request="update_plan"), "unknown": search.Filters(request="no_such_tool"), "script": search.Filters(kind=search.SCRIPT_ONLY)}
    return reduce(DataFrame.unionByName, [rows.filter(search.structural(f, known)).select("event_id", F.lit(name).alias("asked")) for name, f in asked.items()])


@query("lif_20_every_record_shown_once", bind.with_events("""
SELECT session_id, event_id AS raw_id, 'protocol' AS layer, coalesce(nullif(subtype, ''), kind) AS subtype FROM ev WHERE layer = 'protocol' OR kind = 'error'"""))
def _(spark, root):
    ev = bind.events(spark, root)
    raw = ev.select("session_id", F.col("event_id").alias("raw_id"), F.col("subtype").alias("payload_type"), F.col("kind").alias("record_type"))
    owned = ev.filter("layer = 'main' and kind <> 'error'").select(F.col("event_id").alias("raw_id"))
    return lifecycle.fallback_rows(raw, owned)


GOAL_ROWS_SQL = """gr AS (SELECT o_custkey AS session_id, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
gw AS (SELECT session_id, seq, n, (n - 1) // 6 AS cyc, (n - 1) % 6 AS p FROM gr),
gl AS (SELECT session_id, seq, n, 'g' || cyc AS goal_id, p + 1 + CASE WHEN seq % 23 = 0 THEN 1 ELSE 0 END AS revision,
    ['create', 'edit', 'pause', 'resume', 'complete', 'block'][p + 1] AS op, ['active', 'active', 'paused', 'active', 'complete', 'blocked'][p + 1] AS phase FROM gw)"""


def goal_rows(spark, root):
    o = table(spark, root, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("seq"))
    r = ordered.scan(o, ["session_id"], "seq", n=ordered.RowNumber())
    cycle, p = F.floor((F.col("n") - 1) / 6), (F.col("n") - 1) % 6

    def pick(*names):
        return F.element_at(F.array(*[F.lit(x) for x in names]), (p + 1).cast("int"))
    return r.select(
        "session_id", "seq", pick("create", "edit", "pause", "resume", "complete", "block").alias("operation"), F.concat(F.lit("g"), cycle.cast("string")).alias("goal_id"),
        (p + 1 + F.when(F.col("seq") % 23 == 0, 1).otherwise(0)).alias("revision"), pick("active", "active", "paused", "active", "complete", "blocked").alias("phase"),
        F.when(p >= 1, "edited").otherwise("first").alias("objective"), F.lit(3).alias("max_rounds"), F.lit(0).alias("rounds"), cycle.alias("created_at"), F.col("n").alias("at"))


@query("lif_12_goal_revisions", f"""
WITH RECURSIVE {GOAL_ROWS_SQL}, st AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS goal, CAST(0 AS BIGINT) AS rev, '' AS phase, false AS accepted FROM gl WHERE n = 1
  UNION ALL SELECT g.session_id, g.n, g.seq, CASE WHEN ok THEN g.goal_id ELSE s.goal END, CASE WHEN ok THEN g.revision ELSE s.rev END, CASE WHEN ok THEN g.phase ELSE s.phase END, ok
  FROM st s JOIN gl g ON g.session_id = s.session_id AND g.n = s.n + 1,
  LATERAL (SELECT CASE WHEN g.op = 'create' THEN g.revision = 1 AND s.phase IN ('', 'complete') ELSE g.goal_id = s.goal AND g.revision = s.rev + 1 AND
    CASE g.op WHEN 'edit' THEN g.phase = s.phase WHEN 'pause' THEN s.phase = 'active' WHEN 'resume' THEN s.phase IN ('active', 'paused', 'blocked') WHEN 'complete' THEN s.phase <> 'complete' ELSE s.phase = 'active' END END AS ok))
SELECT session_id, seq, accepted, phase AS state FROM st WHERE n > 0""")
def _(spark, root):
    return lifecycle.goal_revisions(goal_rows(spark, root)).select("session_id", "seq", "accepted", "state")


@query("lif_13_inbox_replay")
def _(spark, root):
    k = F.col("k")
    ev = bind.events(spark, root).select("session_id", F.col("line").alias("seq"), "k", "role", "event_id")
    prior = ordered.scan(ev.withColumn("m", F.concat(F.lit("m"), F.col("seq").cast("string"))), ["session_id"], "seq", waiting=ordered.Lag(F.col("m")))
    part = F.when(k % 3 == 2, "message").otherwise("splice")
    rows = prior.select("session_id", "seq", part.alias("part"), F.lit("next-turn").alias("target"), F.lit(0).alias("start"), F.when(k % 3 == 1, 1).otherwise(0).alias("removed"),
                        F.when(k % 3 == 0, F.col("m")).alias("inserted"), F.lit(False).alias("canceled"), F.col("waiting").alias("message_id"))
    return lifecycle.inbox_replay(rows)


@query("lif_07_task_states", bind.with_events("""
WITH r AS (SELECT session_id, line, role = 'user' AS shot, CAST(k % 4 AS VARCHAR) AS id, k, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line) AS ep FROM ev WHERE role = 'user' OR kind = 'command'),
o AS (SELECT *, shot OR k % 11 <> 0 AS alive, CASE WHEN shot OR (k % 11 <> 0 AND k % 3 = 0) THEN 'do' WHEN k % 11 = 0 THEN 'Task #' || id END AS said, CASE WHEN k % 2 = 0 THEN 'pending' ELSE 'completed' END AS status FROM r),
a AS (SELECT *, id || ':' || coalesce(last_value(said IGNORE NULLS) OVER w, 'Task #' || id) || ':' || status AS task, coalesce(lag(alive) OVER w, false) AS was, lead(line) OVER w IS NULL AS ends FROM o WINDOW w AS (PARTITION BY session_id, ep, id ORDER BY line)),
l AS (SELECT session_id, ep + 1 AS ep, string_agg(task, ',' ORDER BY id) AS list FROM a WHERE ends AND alive GROUP BY 1, 2)
SELECT a.session_id, line, shot AND coalesce(list, '') <> task AS novel, CAST(sum(CAST(alive AS INTEGER) - CAST(was AS INTEGER)) OVER (PARTITION BY a.session_id, a.ep ORDER BY line) AS INTEGER) AS tasks
FROM a LEFT JOIN l ON l.session_id = a.session_id AND l.ep = a.ep"""))
def _(spark, root):
    k = F.col("k")
    ev = bind.events(spark, root).filter("role = 'user' or kind = 'command'").select("session_id", "line", "k", "role")
    item = F.struct(tagged("", 4).alias("id"), F.lit("do").alias("subject"), F.when(k % 2 == 0, "pending").otherwise("completed").alias("status"))
    rows = ev.select("session_id", "line", F.when(F.col("role") == "user", "snapshot").otherwise("update").alias("part"), tagged("", 4).alias("task_id"),
                     F.when(k % 3 == 0, "do").otherwise("").alias("subject"), F.when(k % 11 == 0, "deleted").when(k % 2 == 0, "pending").otherwise("completed").alias("status"), F.to_json(F.array(item)).alias("items"))
    return lifecycle.task_states(rows)


@query("win_03_turn_ownership")
def _(spark, root):
    return lifecycle.turn_ownership(ownership_rows(spark, root))


def ownership_rows(spark, root):
    k, kind = F.col("k"), F.col("kind")
    part = (F.when((kind == "error") & (k % 20 == 0), "rollback").when((kind == "error") & (k % 5 == 1), "started").when((kind == "error") & (k % 5 == 2), "completed")
            .when((kind == "error") & (k % 5 == 3), "context").when(F.col("role") == "user", "user").otherwise("other"))
    return bind.events(spark, root).select("session_id", "line", "event_id", part.alias("part"), F.when(k % 4 != 0, F.col("turn_id")).otherwise("").alias("turn_id"),
                                           F.when(k % 2 == 0, "event_msg").otherwise("response_item").alias("envelope"), tagged("m", 2).alias("text"))


@query("lif_01_scripted_operations")
def _(spark, root):
    return lifecycle.scripted_operations(cell_rows(spark, root))


def cell_rows(spark, root):
    k = F.col("k")
    rows = windows.turn_epochs(bind.events(spark, root).select("session_id", "line", "event_id", "kind", "k", "turn_id", "role", "tool_name"), (F.col("kind") == "error") & (k % 10 == 0))
    part = F.when(F.col("tool_name") != "", "exec").when(F.col("role") == "user", "wait").otherwise("result")
    return rows.filter("tool_name <> '' or role <> ''").select(
        "session_id", (k % 4).alias("cell_id"), "line", "epoch", part.alias("part"), F.col("event_id").alias("operation_id"),
        (F.col("epoch") - F.when(k % 30 == 0, 1).otherwise(0)).alias("call_epoch"), F.concat(F.lit("w"), (k % 2).cast("string")).alias("call_id"), (k % 3 == 0).alias("pending"))


CALLS_SQL = """tc AS (SELECT session_id, line, line + 1 + k * 3 AS end_line, CASE WHEN tool_name <> '' THEN 'exec' ELSE 'write' END AS tool, k % 2 AS process_id, k % 9 = 0 AS ends, k % 10 <> 5 AS reached, event_id FROM ev WHERE tool_name <> '' OR role <> ''),
tg AS (SELECT *, CAST(sum(CASE WHEN tool = 'exec' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS gen, max(CASE WHEN tool = 'exec' THEN end_line END) OVER (PARTITION BY session_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy,
    min(CASE WHEN tool = 'exec' THEN line END) OVER (PARTITION BY session_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM tc WINDOW w AS (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
cr AS (SELECT * FROM tg WHERE tool = 'exec' AND coalesce(busy < line, true) AND (nx IS NULL OR end_line < nx)),
wr AS (SELECT w.*, c.event_id AS origin FROM tg w JOIN cr c ON c.session_id = w.session_id AND c.gen = w.gen AND c.process_id = w.process_id WHERE w.tool = 'write' AND w.line > c.end_line AND (w.nx IS NULL OR w.end_line < w.nx))"""


@query("lif_03_terminal_continuations", bind.with_events(f"""
WITH {CALLS_SQL} SELECT w.session_id, w.event_id AS write_event_id, origin AS origin_event_id, w.process_id FROM wr w WHERE reached
AND NOT EXISTS (SELECT 1 FROM tc o WHERE o.session_id = w.session_id AND o.tool = 'write' AND o.process_id = w.process_id AND o.line <> w.line AND o.line <= w.end_line AND o.end_line >= w.line)
AND NOT EXISTS (SELECT 1 FROM wr o WHERE o.session_id = w.session_id AND o.gen = w.gen AND o.process_id = w.process_id AND o.ends AND o.end_line < w.end_line)"""))
def _(spark, root):
    k, exec_row = F.col("k"), F.col("tool_name") != ""
    calls = bind.events(spark, root).filter(exec_row | (F.col("role") != "")).select(
        "session_id", "line", (F.col("line") + 1 + k * 3).alias("end_line"), F.when(exec_row, "exec").otherwise("write").alias("tool"), (k % 2).alias("process_id"),
        (k % 9 == 0).alias("ends"), (k % 10 != 5).alias("reached"), "event_id")
    return lifecycle.terminal_continuations(calls)


@query("lif_02_operation_facts", bind.with_events("""
WITH sp AS (SELECT session_id, event_id AS span_id, line AS st, line + 700 AS en FROM ev WHERE tool_name <> ''),
m AS (SELECT e.event_id, min(span_id) AS span_id, min(e.line) AS line FROM ev e JOIN sp ON sp.session_id = e.session_id AND e.line BETWEEN st AND en WHERE e.tool_name = '' GROUP BY 1 HAVING count(*) = 1)
SELECT sp.span_id AS operation_id, count(m.event_id) AS nested, arg_min(m.event_id, m.line) AS first_nested FROM sp LEFT JOIN m USING (span_id) GROUP BY 1"""))
def _(spark, root):
    ev = bind.events(spark, root).withColumn("file", F.col("session_id"))
    spans = ev.filter("tool_name <> ''").select("session_id", "file", F.col("event_id").alias("span_id"), F.col("line").alias("start"), (F.col("line") + 700).alias("end"))
    inner = ev.filter("tool_name = ''").select("session_id", "file", "event_id", F.col("line").alias("min_line"), F.col("line").alias("max_line"))
    return lifecycle.operation_facts(spans, pairing.containing_span(inner, spans).join(inner.select("event_id", "min_line"), "event_id"))


@query("lif_05_goal_events", bind.with_events("""
WITH s AS (SELECT session_id, line, event_id, 's' || (k % 4) AS sig, CASE WHEN k % 3 = 0 THEN 'complete' ELSE 'active' END AS status FROM ev WHERE role = 'user'),
l AS (SELECT *, lag(status) OVER (PARTITION BY session_id ORDER BY line) AS p FROM s),
t AS (SELECT *, CASE WHEN p IS NULL THEN 'created' WHEN p <> status THEN 'updated' ELSE '' END AS transition FROM l),
sp AS (SELECT session_id, 's' || (k % 4) AS sig, event_id AS span_id, line AS st, line + 500 AS en FROM ev WHERE tool_name <> ''),
m AS (SELECT t.session_id, t.line, span_id, st, CASE WHEN t.line <= en THEN 0 ELSE 1 END AS d FROM t JOIN sp ON sp.session_id = t.session_id AND sp.sig = t.sig AND t.line BETWEEN st AND en + 1 WHERE transition <> ''),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id, line ORDER BY d, st DESC) = 1),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY session_id, span_id ORDER BY d, line) = 1)
SELECT t.session_id, t.event_id, transition, c.span_id AS tool_event_id FROM t LEFT JOIN c ON c.session_id = t.session_id AND c.line = t.line WHERE transition <> ''"""))
def _(spark, root):
    ev, sig = bind.events(spark, root), tagged("s", 4)
    none = F.lit(None).cast("bigint")
    shots = ev.filter("role = 'user'").select("session_id", "line", "event_id", sig.alias("signature"), F.lit("one").alias("identity"), none.alias("created_at"), F.lit("o").alias("objective"),
                                             F.when(F.col("k") % 3 == 0, "complete").otherwise("active").alias("status"), none.alias("token_budget"))
    spans = ev.filter("tool_name <> ''").select("session_id", sig.alias("signature"), F.col("event_id").alias("span_id"), F.col("line").alias("start"), (F.col("line") + 500).alias("end"))
    return lifecycle.goal_events(windows.goal_transitions(shots), spans)
