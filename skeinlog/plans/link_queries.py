"""Join queries: pairing, mirroring, containment, ownership, navigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.functions import numbers
from skeinlog.operators import pairing, windows
from skeinlog.plans import bind
from skeinlog.plans.registry import query
from skeinlog.plans.window_queries import EPOCH_SQL, is_boundary
from skeinlog.session import table

PAIR_ROWS_SQL = """pr AS (SELECT session_id, line, event_id, 'c' || CAST(k // 3 AS VARCHAR) AS call_id, tool_name <> '' AS is_call, role = 'assistant' AS is_result,
    status, exit_code, duration_ms FROM ev),
pg AS (SELECT session_id, call_id, count(*) FILTER (WHERE is_call) AS calls, count(*) FILTER (WHERE is_result) AS results, min(line) FILTER (WHERE is_call) AS call_line,
    min(line) FILTER (WHERE is_result) AS result_line, arg_min(event_id, line) FILTER (WHERE is_call) AS call_event_id, arg_min(event_id, line) FILTER (WHERE is_result) AS result_event_id
  FROM pr WHERE is_call OR is_result GROUP BY 1, 2),
pi AS (SELECT *, CASE WHEN calls = 0 THEN 'missing_call' WHEN calls <> 1 OR results > 1 THEN 'ambiguous_call_id' WHEN results = 0 THEN 'missing_output'
    WHEN result_line <= call_line THEN 'output_before_call' ELSE '' END AS issue FROM pg)"""


def pair_rows(spark, root):
    return bind.events(spark, root).select(
        "session_id", "line", "event_id", F.concat(F.lit("c"), F.floor(F.col("k") / 3).cast("string")).alias("call_id"),
        (F.col("tool_name") != "").alias("is_call"), (F.col("role") == "assistant").alias("is_result"), "status", "exit_code", "duration_ms")


@query("jon_01_call_groups", bind.with_events(f"""
WITH {PAIR_ROWS_SQL} SELECT session_id, call_id, count(*) AS rows, min(line) AS first_line, max(line) AS last_line,
  arg_min(event_id, line) FILTER (WHERE is_call) AS request_event_id, arg_max(event_id, line) FILTER (WHERE is_result) AS output_event_id,
  bool_or(status = 'declined') AS declined, bool_or(status = 'failed') AS failed, max(exit_code) AS exit_code, max(duration_ms) AS duration_ms FROM pr GROUP BY 1, 2"""))
def _(spark, root):
    return pairing.call_groups(pair_rows(spark, root))


@query("jon_02_calls_with_results", bind.with_events(f"""
WITH {PAIR_ROWS_SQL} SELECT c.session_id, c.line, c.event_id, c.call_id, p.result_event_id, p.result_event_id IS NOT NULL AS complete
FROM pr c LEFT JOIN pi p ON p.session_id = c.session_id AND p.call_line = c.line AND p.issue = '' WHERE c.is_call"""))
def _(spark, root):
    return pairing.calls_with_results(pair_rows(spark, root))


@query("jon_03_calls_and_results", bind.with_events(f"""
WITH {PAIR_ROWS_SQL} SELECT session_id, call_event_id, result_event_id FROM pi WHERE issue = ''
UNION ALL SELECT r.session_id, CASE WHEN is_call THEN event_id END, CASE WHEN is_result THEN event_id END FROM pr r
WHERE (is_call OR is_result) AND NOT EXISTS (SELECT 1 FROM pi p WHERE p.issue = '' AND p.session_id = r.session_id AND r.line IN (p.call_line, p.result_line))"""))
def _(spark, root):
    return pairing.calls_and_results(pair_rows(spark, root))


@query("jon_04_pairing_issues", bind.with_events(f"WITH {PAIR_ROWS_SQL} SELECT session_id, call_id, calls, results, issue FROM pi"))
def _(spark, root):
    return pairing.call_pairs(pair_rows(spark, root)).select("session_id", "call_id", "calls", "results", "issue")


def _adjacent_sql(rows: str, matches: str, columns: str) -> str:
    """Greedy pairs of neighbours, restated as runs of matches."""
    return bind.with_events(f"""WITH {rows},
nx AS (SELECT *, row_number() OVER w AS pos, lead(x) OVER w AS nxt FROM (SELECT *, r AS x FROM rw r) WINDOW w AS (PARTITION BY session_id ORDER BY line)),
mt AS (SELECT *, coalesce({matches}, false) AS m FROM nx),
gp AS (SELECT *, coalesce(max(CASE WHEN NOT m THEN pos END) OVER (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING), 0) AS gap FROM mt)
SELECT {columns} FROM gp WHERE m AND (pos - gap) % 2 = 1""")


@query("jon_05_web_search_pairs", _adjacent_sql(
    """rw AS (SELECT session_id, line, event_id, CASE WHEN tool_name <> '' THEN 'call' WHEN role = 'assistant' THEN 'end' ELSE '' END AS part, 'a' || (k % 4) AS action, turn_id,
      CASE WHEN ts_text = '' THEN NULL ELSE epoch_ms(CAST(ts_text AS TIMESTAMP)) END AS ms FROM ev)""",
    """part <> nxt.part AND part <> '' AND nxt.part <> '' AND (action = nxt.action OR (turn_id <> '' AND turn_id = nxt.turn_id AND abs(ms - nxt.ms) <= 7200000))""",
    "session_id, event_id, nxt.event_id AS next_event_id"))
def _(spark, root):
    part = F.when(F.col("tool_name") != "", "call").when(F.col("role") == "assistant", "end").otherwise("")
    rows = bind.events(spark, root).select(
        "session_id", "line", "event_id", part.alias("part"), F.concat(F.lit("a"), (F.col("k") % 4).cast("string")).alias("action"),
        "turn_id", numbers.epoch_ms(F.col("ts_text")).alias("ms"))
    return pairing.web_search_pairs(rows, 7_200_000).select("session_id", "event_id", "next_event_id")


@query("jon_06_mirrored_messages", _adjacent_sql(
    "rw AS (SELECT session_id, line, event_id, role AS envelope, 'm' || (k % 3) AS text FROM ev WHERE role <> '')",
    "envelope <> nxt.envelope AND text = nxt.text", "session_id, event_id, nxt.event_id AS next_event_id"))
def _(spark, root):
    rows = bind.events(spark, root).filter("role <> ''").select(
        "session_id", "line", "event_id", F.col("role").alias("envelope"), F.lit("user").alias("role"),
        F.concat(F.lit(" m"), (F.col("k") % 3).cast("string"), F.lit("  ")).alias("text"), F.lit(None).cast("string").alias("digest"))
    return pairing.mirrored_messages(rows).select("session_id", "event_id", "next_event_id")


@query("jon_07_response_mirrors", bind.with_events(f"""
WITH {EPOCH_SQL}, i AS (SELECT session_id, epoch, k % 20 AS rid, min(event_id) AS e, min(k % 2) AS b FROM ep WHERE role = 'user' GROUP BY 1, 2, 3 HAVING count(*) = 1),
o AS (SELECT session_id, epoch, k % 20 AS rid, min(event_id) AS e, min(k % 2) AS b FROM ep WHERE role = 'assistant' GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT i.session_id, i.rid AS response_id, i.epoch, i.e AS item_event_id, o.e AS owner_event_id FROM i JOIN o USING (session_id, epoch, rid) WHERE i.b = o.b"""))
def _(spark, root):
    rows = windows.turn_epochs(bind.events(spark, root).select("session_id", "line", "event_id", "kind", "k", "turn_id", "role"), is_boundary())
    rows = rows.select("session_id", "epoch", (F.col("k") % 20).alias("response_id"), "event_id", (F.col("k") % 2).alias("body"), "role")
    return pairing.response_mirrors(rows.filter("role = 'user'").drop("role"), rows.filter("role = 'assistant'").drop("role"))


@query("jon_08_reasoning_mirrors", _adjacent_sql(
    "rw AS (SELECT session_id, line, event_id, CASE WHEN role = 'user' THEN 'a' ELSE 'b' END AS envelope, CASE WHEN k % 5 = 0 THEN '' ELSE repeat('x', CAST(k % 7 AS INT)) || CASE WHEN k % 3 = 0 THEN 'y' ELSE '' END END AS text FROM ev WHERE role <> '')",
    "envelope <> nxt.envelope AND text <> '' AND nxt.text <> '' AND (contains(text, nxt.text) OR contains(nxt.text, text))", "session_id, event_id, nxt.event_id AS next_event_id"))
def _(spark, root):
    k = F.col("k")
    body = F.when(k % 5 == 0, "").otherwise(F.concat(F.expr("repeat('x', cast(k % 7 as int))"), F.when(k % 3 == 0, "y").otherwise("")))
    rows = bind.events(spark, root).filter("role <> ''").select(
        "session_id", "line", "event_id", F.when(F.col("role") == "user", "a").otherwise("b").alias("envelope"), body.alias("text"))
    return pairing.reasoning_mirrors(rows).select("session_id", "event_id", "next_event_id")


def refs_of(spark, root):
    """Logical events with one to three raw rows each: the row itself and rows shortly before it."""
    ev = bind.events(spark, root)
    ids = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("k") % 3), lambda i: F.concat(F.lit("e"), (F.col("line") - i).cast("string")))
    return pairing.event_refs(ev.filter("kind <> 'error'").select("session_id", "event_id", "layer", ids.alias("raw_refs")))


REFS_SQL = "rf AS (SELECT session_id, event_id, layer, i AS pos, 'e' || (line - i) AS raw_id FROM (SELECT *, unnest(range(k % 3 + 1)) AS i FROM ev WHERE kind <> 'error'))"


@query("jon_09_event_to_raw", bind.with_events(f"""
WITH {REFS_SQL} SELECT rf.event_id, rf.pos, rf.raw_id, r.kind AS raw_kind FROM rf JOIN ev r ON r.event_id = rf.raw_id"""))
def _(spark, root):
    raw = bind.events(spark, root).select(F.col("event_id").alias("raw_id"), F.col("kind").alias("raw_kind"))
    return refs_of(spark, root).join(raw, "raw_id").select("event_id", F.col("pos").cast("bigint").alias("pos"), "raw_id", "raw_kind")


@query("jon_32_raw_to_events", bind.with_events(f"""
WITH {REFS_SQL}, o AS (SELECT raw_id, count(DISTINCT event_id) AS owners, min(event_id) AS e, min(layer) AS layer FROM rf GROUP BY 1)
SELECT r.event_id AS raw_id, coalesce(owners, 0) AS owners, CASE WHEN owners = 1 THEN e END AS owner_event_id, CASE WHEN owners = 1 THEN o.layer ELSE '' END AS owner_layer
FROM ev r LEFT JOIN o ON o.raw_id = r.event_id"""))
def _(spark, root):
    raw = bind.events(spark, root).select(F.col("event_id").alias("raw_id"))
    return pairing.owners_of_raw(raw, refs_of(spark, root))


@query("jon_28_consumed_rows_excluded", bind.with_events(f"""
WITH {REFS_SQL} SELECT event_id AS raw_id, kind FROM ev WHERE event_id NOT IN (SELECT raw_id FROM rf)"""))
def _(spark, root):
    raw = bind.events(spark, root).select(F.col("event_id").alias("raw_id"), "kind")
    refs = refs_of(spark, root)
    return pairing.without_consumed(raw, refs.filter("layer = 'main'"), refs.filter("layer = 'protocol'"))


@query("dq_02_reference_ownership", bind.with_events(f"""
WITH {REFS_SQL} SELECT 'dangling_ref' AS rule, count(*) AS n FROM rf WHERE raw_id NOT IN (SELECT event_id FROM ev)
UNION ALL SELECT 'duplicate_event_id', count(*) FROM (SELECT event_id FROM ev GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'foreign_session', count(*) FROM rf JOIN ev r ON r.event_id = rf.raw_id WHERE r.session_id <> rf.session_id"""))
def _(spark, root):
    from skeinlog.operators import quality
    ev = bind.events(spark, root)
    return quality.ownership(ev, refs_of(spark, root), ev.select(F.col("event_id").alias("raw_id"), "session_id"))


@query("jon_10_supplementary_rows", bind.with_events("""
WITH c AS (SELECT session_id, event_id, k AS uuid, k % 17 AS call_id FROM ev WHERE kind = 'patch'), o AS (SELECT session_id, event_id AS raw_id, k FROM ev WHERE kind = 'user_message')
SELECT DISTINCT c.event_id, o.raw_id FROM c JOIN o ON o.session_id = c.session_id AND (o.k = c.uuid OR o.k % 17 = c.call_id OR o.k - 1 = c.uuid)"""))
def _(spark, root):
    ev, k = bind.events(spark, root), F.col("k")
    calls = ev.filter("kind = 'patch'").select("session_id", "event_id", k.alias("uuid"), (k % 17).alias("call_id"))
    other = ev.filter("kind = 'user_message'")
    raw = F.col("event_id").alias("raw_id")
    return pairing.supplementary_rows(calls, other.select("session_id", raw, k.alias("uuid")), other.select("session_id", raw, (k % 17).alias("call_id")),
                                      other.select("session_id", raw, (k - 1).alias("parent_uuid")))


LAUNCH_SQL = """la AS (SELECT session_id, 't' || (k % 12) AS task_id, 'c' || (k % 12) AS call_id, CASE WHEN k % 2 = 0 THEN 'background_command' ELSE 'async_agent' END AS kind, line AS launch_line FROM ev WHERE kind = 'command'),
nt AS (SELECT session_id, 't' || (k % 12) AS task_id, 'c' || (k % 12) AS call_id, line, 'f' || (k % 24) AS fingerprint, CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM ev WHERE kind = 'user_message')"""


def launches(spark, root):
    ev, k = bind.events(spark, root), F.col("k")

    def tag(p, n):
        return F.concat(F.lit(p), (k % n).cast("string"))
    a = ev.filter("kind = 'command'").select("session_id", tag("t", 12).alias("task_id"), tag("c", 12).alias("call_id"),
                                             F.when(k % 2 == 0, "background_command").otherwise("async_agent").alias("kind"), F.col("line").alias("launch_line"))
    b = ev.filter("kind = 'user_message'").select("session_id", tag("t", 12).alias("task_id"), tag("c", 12).alias("call_id"), "line",
                                                  tag("f", 24).alias("fingerprint"), F.when(k % 5 == 0, "failed").otherwise("completed").alias("status"))
    return a, b


@query("jon_11_launch_notifications", bind.with_events(f"""
WITH {LAUNCH_SQL}, so AS (SELECT session_id, task_id, min(call_id) AS call_id, min(launch_line) AS launch_line FROM la GROUP BY 1, 2 HAVING count(*) = 1),
d AS (SELECT nt.session_id, nt.task_id, nt.call_id, fingerprint, min(line) AS line, arg_min(status, line) AS status, count(*) AS copies FROM nt JOIN so USING (session_id, task_id, call_id) WHERE line > launch_line GROUP BY 1, 2, 3, 4),
s AS (SELECT session_id, task_id, call_id, count(*) AS n, CAST(sum(copies) AS BIGINT) AS copies, arg_max(status, line) AS st FROM d GROUP BY 1, 2, 3)
SELECT la.session_id, la.task_id, la.call_id, la.kind, coalesce(n, 0) AS notifications, coalesce(copies, 0) AS copies, st AS terminal_status,
  CASE WHEN st IS NOT NULL THEN 'terminal' WHEN la.kind = 'background_command' THEN 'backgrounded' ELSE 'async_launched' END AS phase FROM la LEFT JOIN s USING (session_id, task_id, call_id)"""))
def _(spark, root):
    return pairing.launch_notifications(*launches(spark, root))


@query("jon_12_nearest_goal_call", bind.with_events("""
WITH sp AS (SELECT session_id, 's' || (k % 4) AS signature, event_id AS span_id, line AS st, line + 500 AS en FROM ev WHERE tool_name <> ''),
pt AS (SELECT session_id, 's' || (k % 4) AS signature, line FROM ev WHERE role = 'user'),
m AS (SELECT p.session_id, p.line, span_id, st, CASE WHEN p.line <= en THEN 0 ELSE 1 END AS distance FROM pt p JOIN sp s ON s.session_id = p.session_id AND s.signature = p.signature AND p.line BETWEEN st AND en + 1),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id, line ORDER BY distance, st DESC) = 1)
SELECT session_id, span_id, line FROM b QUALIFY row_number() OVER (PARTITION BY session_id, span_id ORDER BY distance, line) = 1"""))
def _(spark, root):
    ev, sig = bind.events(spark, root), F.concat(F.lit("s"), (F.col("k") % 4).cast("string")).alias("signature")
    spans = ev.filter("tool_name <> ''").select("session_id", sig, F.col("event_id").alias("span_id"), F.col("line").alias("start"), (F.col("line") + 500).alias("end"))
    return pairing.nearest_span(ev.filter("role = 'user'").select("session_id", sig, "line"), spans, 1000)


@query("jon_13_event_containment", bind.with_events("""
WITH sp AS (SELECT session_id, k % 2 AS file, event_id AS span_id, line AS st, line + 700 AS en FROM ev WHERE tool_name <> ''),
e AS (SELECT session_id, k % 2 AS file, event_id, line AS lo, line + (k % 3) * 100 AS hi FROM ev WHERE tool_name = '')
SELECT e.event_id, min(span_id) AS span_id FROM e JOIN sp ON sp.session_id = e.session_id AND sp.file = e.file AND lo >= st AND hi <= en GROUP BY 1 HAVING count(*) = 1"""))
def _(spark, root):
    ev = bind.events(spark, root).withColumn("file", F.col("k") % 2)
    spans = ev.filter("tool_name <> ''").select("session_id", "file", F.col("event_id").alias("span_id"), F.col("line").alias("start"), (F.col("line") + 700).alias("end"))
    inner = ev.filter("tool_name = ''").select("session_id", "file", "event_id", F.col("line").alias("min_line"), (F.col("line") + (F.col("k") % 3) * 100).alias("max_line"))
    return pairing.containing_span(inner, spans)


OWNER_LINES_SQL = """ol AS (SELECT o_orderkey % 3 AS file, o_orderkey // 3 AS line, (o_orderkey // 300) * 2 + o_custkey % 2 AS session_id FROM orders),
isl AS (SELECT *, line - row_number() OVER (PARTITION BY file, session_id ORDER BY line) AS g FROM ol),
rg AS (SELECT file, session_id, min(line) AS st, max(line) AS en FROM isl GROUP BY file, session_id, g)"""


def owner_lines(spark, root):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, root, "orders").select((k % 3).alias("file"), F.floor(k / 3).alias("line"), (F.floor(k / 300) * 2 + c % 2).alias("session_id"))


@query("jon_14_line_ranges", f"WITH {OWNER_LINES_SQL} SELECT file, session_id, st AS start, en AS \"end\" FROM rg")
def _(spark, root):
    return pairing.line_ranges(owner_lines(spark, root))


@query("jon_14_range_owner", f"""
WITH {OWNER_LINES_SQL}, r2 AS (SELECT file, 's' || session_id AS owner, st, en + session_id % 3 AS en FROM rg), p AS (SELECT file, line FROM ol WHERE line % 2 = 0)
SELECT p.file, p.line, count(r2.owner) AS open, CASE WHEN count(r2.owner) = 1 THEN min(r2.owner) END AS owner
FROM p LEFT JOIN r2 ON r2.file = p.file AND p.line BETWEEN st AND en GROUP BY 1, 2""")
def _(spark, root):
    lines = owner_lines(spark, root)
    ranges = pairing.line_ranges(lines).select("file", F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("owner"), "start", (F.col("end") + F.col("session_id") % 3).alias("end"))
    return pairing.range_owner(lines.filter("line % 2 = 0").select("file", "line"), ranges).select("file", "line", "open", "owner")


@query("dq_07_range_overlaps", f"""
WITH {OWNER_LINES_SQL}, r2 AS (SELECT file, session_id AS owner, st, en + session_id % 3 AS en FROM rg)
SELECT file, owner, st AS start, en AS "end" FROM r2 a WHERE EXISTS (SELECT 1 FROM r2 b WHERE b.file = a.file AND b.st < a.st AND b.en >= a.st)""")
def _(spark, root):
    from skeinlog.operators import quality
    ranges = pairing.line_ranges(owner_lines(spark, root)).select("file", F.col("session_id").alias("owner"), "start", (F.col("end") + F.col("session_id") % 3).alias("end"))
    return quality.range_violations(ranges).select("file", "owner", "start", "end")


@query("jon_15_review_parents", bind.with_events("""
WITH b AS (SELECT *, CASE WHEN ts_text = '' THEN NULL ELSE epoch_ms(CAST(ts_text AS TIMESTAMP)) END AS ms FROM ev),
r AS (SELECT event_id AS review_id, ms AS s, ms + 60000 AS u FROM b WHERE kind = 'user_message' AND ms IS NOT NULL),
m AS (SELECT session_id AS parent_id, ms AS e, CASE WHEN k % 2 = 0 THEN ms + 90000 END AS x FROM b WHERE tool_name <> '' AND ms IS NOT NULL),
p AS (SELECT review_id, parent_id FROM r JOIN m ON e BETWEEN s - 200000 AND s + 200000 WHERE abs(e - s) <= 5000 OR (e <= s + 5000 AND (x IS NULL OR x >= s - 30000) AND x IS NOT NULL AND abs(x - u) <= 120000))
SELECT review_id, min(parent_id) AS parent_id FROM p GROUP BY 1 HAVING count(DISTINCT parent_id) = 1"""))
def _(spark, root):
    ev = bind.events(spark, root).withColumn("ms", numbers.epoch_ms(F.col("ts_text"))).filter("ms is not null")
    reviews = ev.filter("kind = 'user_message'").select(F.col("event_id").alias("review_id"), F.col("ms").alias("started_ms"), (F.col("ms") + 60000).alias("updated_ms"))
    markers = ev.filter("tool_name <> ''").select(F.col("session_id").alias("parent_id"), F.col("ms").alias("entered_ms"), F.when(F.col("k") % 2 == 0, F.col("ms") + 90000).alias("exited_ms"))
    return pairing.review_parents(reviews, markers)


@query("jon_17_parent_titles", """
SELECT c.c_custkey AS session_id, coalesce(p.c_name, '') AS parent_title FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_custkey // 7 AND c.c_custkey % 3 <> 0""")
def _(spark, root):
    from skeinlog.operators import relations
    c = table(spark, root, "customer")
    s = c.select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_custkey") % 3 != 0, F.floor(F.col("c_custkey") / 7)).alias("parent_id"), F.col("c_name").alias("title"))
    return relations.with_related_title(s, "parent_id", "parent_title").select("session_id", "parent_title")


@query("jon_21_subagent_parent", bind.with_events("""
WITH c AS (SELECT session_id, k % 30 AS agent_id, min(event_id) AS call_event_id FROM ev WHERE kind = 'command' GROUP BY 1, 2 HAVING count(*) = 1),
a AS (SELECT session_id, k % 30 AS agent_id, min(event_id) AS transcript_id FROM ev WHERE kind = 'reasoning' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT session_id, agent_id, transcript_id, call_event_id FROM a LEFT JOIN c USING (session_id, agent_id)"""))
def _(spark, root):
    ev, agent = bind.events(spark, root), (F.col("k") % 30).alias("agent_id")
    return pairing.unique_join(ev.filter("kind = 'reasoning'").select("session_id", agent, F.col("event_id").alias("transcript_id")),
                               ev.filter("kind = 'command'").select("session_id", agent, F.col("event_id").alias("call_event_id")),
                               ["session_id", "agent_id"], "left")


@query("jon_22_forked_skill_sidecars", bind.with_events("""
WITH l AS (SELECT session_id, k % 5 AS skill, k % 9 AS agent, min(event_id) AS launch_id FROM ev WHERE kind = 'command' GROUP BY 1, 2, 3 HAVING count(*) = 1),
s AS (SELECT session_id, k % 5 AS skill, k % 9 AS agent, min(event_id) AS sidecar_id FROM ev WHERE kind = 'user_message' GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT session_id, skill, agent, launch_id, sidecar_id FROM l JOIN s USING (session_id, skill, agent)"""))
def _(spark, root):
    ev, keys = bind.events(spark, root), [(F.col("k") % 5).alias("skill"), (F.col("k") % 9).alias("agent")]
    return pairing.unique_join(ev.filter("kind = 'command'").select("session_id", *keys, F.col("event_id").alias("launch_id")),
                               ev.filter("kind = 'user_message'").select("session_id", *keys, F.col("event_id").alias("sidecar_id")),
                               ["session_id", "skill", "agent"])


@query("jon_23_workflow_run_evidence", """
WITH j AS (SELECT l_orderkey AS run_id, l_partkey % 4 AS agent, count(*) FILTER (WHERE l_linestatus = 'O') AS started, count(*) FILTER (WHERE l_linestatus = 'F') AS done FROM lineitem GROUP BY 1, 2),
r AS (SELECT run_id, count(*) AS agents, bool_and(started = 1 AND done = 1) AS complete FROM j GROUP BY 1)
SELECT o_orderkey AS run_id, agents, complete FROM orders JOIN r ON run_id = o_orderkey WHERE o_orderstatus = 'F'""")
def _(spark, root):
    from skeinlog.operators import relations
    o, li = table(spark, root, "orders"), table(spark, root, "lineitem")
    journal = li.select(F.col("l_orderkey").alias("run_id"), (F.col("l_partkey") % 4).alias("agent"), F.when(F.col("l_linestatus") == "O", "started").otherwise("result").alias("entry"))
    return relations.workflow_evidence(o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id")), journal)


@query("jon_24_prune_triples", bind.with_events("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line) AS seq FROM ev),
o AS (SELECT session_id, seq AS original_seq, k % 3 AS call_id, k % 2 AS envelope FROM n WHERE role = 'assistant'),
p AS (SELECT session_id, seq - (k % 6 + 1) AS original_seq, min(seq) AS prune_seq FROM n WHERE tool_name <> '' GROUP BY 1, 2 HAVING count(*) = 1),
r AS (SELECT session_id, seq - 1 AS prune_seq, seq AS replacement_seq, k % 3 AS call_id, k % 2 AS envelope FROM n WHERE kind <> 'error')
SELECT o.session_id, original_seq, prune_seq, replacement_seq, o.call_id FROM o JOIN p USING (session_id, original_seq) JOIN r USING (session_id, prune_seq) WHERE r.call_id = o.call_id AND r.envelope = o.envelope"""))
def _(spark, root):
    from skeinlog.operators import ordered
    k = F.col("k")
    n = ordered.scan(bind.events(spark, root).select("session_id", "line", "k", "role", "tool_name", "kind"), ["session_id"], "line", seq=ordered.RowNumber())
    body = ["session_id", "seq", (k % 3).alias("call_id"), (k % 2).alias("envelope")]
    prunes = n.filter("tool_name <> ''").select("session_id", (F.col("seq") - (k % 6 + 1)).alias("original_seq"), F.col("seq").alias("prune_seq"))
    return pairing.prune_triples(n.filter("role = 'assistant'").select(*body), prunes, n.filter("kind <> 'error'").select(*body))


@query("jon_25_approval_targets", bind.with_events("""
WITH a AS (SELECT session_id, event_id, k % 40 AS call_id FROM ev WHERE kind = 'user_message'),
t AS (SELECT session_id, k % 40 AS call_id, event_id FROM ev WHERE kind = 'command' UNION ALL SELECT session_id, k % 40, event_id FROM ev WHERE kind = 'patch'),
u AS (SELECT session_id, call_id, min(event_id) AS target_event_id FROM t GROUP BY 1, 2 HAVING count(DISTINCT event_id) = 1)
SELECT a.session_id, a.event_id, a.call_id, target_event_id FROM a LEFT JOIN u USING (session_id, call_id)"""))
def _(spark, root):
    ev, call = bind.events(spark, root), (F.col("k") % 40).alias("call_id")

    def of(kind):
        return ev.filter(F.col("kind") == kind).select("session_id", "event_id", call)
    return pairing.approval_targets(of("user_message"), of("command"), of("patch"))


@query("jon_26_realtime_reference", bind.with_events("""
WITH t AS (SELECT session_id, turn_id, k % 25 AS item, min(event_id) AS target_id FROM ev WHERE role = 'assistant' AND turn_id <> '' GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT e.session_id, e.event_id, target_id FROM ev e LEFT JOIN t ON t.session_id = e.session_id AND t.turn_id = e.turn_id AND t.item = e.k % 25 WHERE e.role = 'user'"""))
def _(spark, root):
    ev, item = bind.events(spark, root), (F.col("k") % 25).alias("item")
    targets = pairing.unique_rows(ev.filter("role = 'assistant' and turn_id <> ''").select("session_id", "turn_id", item, F.col("event_id").alias("target_id")), ["session_id", "turn_id", "item"])
    return ev.filter("role = 'user'").select("session_id", "turn_id", item, "event_id").join(targets, ["session_id", "turn_id", "item"], "left").select("session_id", "event_id", "target_id")


@query("jon_27_subagent_activity", bind.with_events("""
WITH c AS (SELECT session_id, k AS call_id, min(event_id) AS owner_event_id FROM ev WHERE tool_name <> '' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT a.session_id, a.event_id AS raw_id, a.k AS call_id, owner_event_id FROM ev a LEFT JOIN c ON c.session_id = a.session_id AND c.call_id = a.k WHERE a.role = 'user' AND a.k % 4 <> 0"""))
def _(spark, root):
    ev = bind.events(spark, root)
    activity = ev.filter("role = 'user'").select("session_id", F.col("event_id").alias("raw_id"), F.col("k").alias("call_id"))
    calls = ev.filter("tool_name <> ''").select("session_id", "event_id", F.col("k").alias("call_id"))
    return pairing.attach_activity(activity, calls, activity.filter("call_id % 4 = 0"))


@query("jon_30_phase_events", bind.with_events("""
WITH e AS (SELECT 'r' || (line % 5000) AS raw_id, min(event_id) AS e, count(DISTINCT event_id) AS n FROM ev WHERE role = 'assistant' GROUP BY 1)
SELECT p.event_id AS operation_id, 'r' || (p.line % 5000) AS raw_id, CASE WHEN n = 1 THEN e ELSE '' END AS event_id FROM ev p LEFT JOIN e ON e.raw_id = 'r' || (p.line % 5000) WHERE p.tool_name <> ''"""))
def _(spark, root):
    ev, raw = bind.events(spark, root), F.concat(F.lit("r"), (F.col("line") % 5000).cast("string")).alias("raw_id")
    return pairing.phase_events(ev.filter("tool_name <> ''").select(F.col("event_id").alias("operation_id"), raw), ev.filter("role = 'assistant'").select(raw, "event_id"))


@query("jon_31_label_navigation", """
WITH s AS (SELECT 's' || c_custkey AS session_id, 'n' || (c_custkey % 1000) AS source_session_id, 's' || (c_custkey // 5) AS parent_id, c_nationkey % 2 = 0 AS inferred FROM customer),
n AS (SELECT session_id AS label, session_id, parent_id, inferred FROM s UNION ALL SELECT source_session_id, session_id, parent_id, inferred FROM s),
f AS (SELECT label, count(*) AS n, min(session_id) AS session_id, min(parent_id) AS parent_id, bool_or(inferred) AS inferred FROM n GROUP BY 1),
l AS (SELECT 's' || (o_custkey // 5) AS owner_id, CASE WHEN o_orderkey % 3 = 0 THEN 's' || (o_custkey * 2) ELSE 'n' || (o_custkey % 1200) END AS label FROM orders),
r AS (SELECT owner_id, l.label, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN parent_id = owner_id AND NOT inferred THEN 'resolved' ELSE 'unconfirmed' END AS navigation, session_id FROM l LEFT JOIN f USING (label))
SELECT owner_id, label, navigation, CASE WHEN navigation = 'resolved' THEN session_id END AS target_id FROM r""")
def _(spark, root):
    c, o = table(spark, root, "customer"), table(spark, root, "orders")

    def tag(p, e):
        return F.concat(F.lit(p), e.cast("string"))
    key, cust = F.col("c_custkey"), F.col("o_custkey")
    sessions = c.select(tag("s", key).alias("session_id"), tag("n", key % 1000).alias("source_session_id"), tag("s", F.floor(key / 5)).alias("parent_id"), (F.col("c_nationkey") % 2 == 0).alias("inferred"))
    labels = o.select(tag("s", F.floor(cust / 5)).alias("owner_id"), F.when(F.col("o_orderkey") % 3 == 0, tag("s", cust * 2)).otherwise(tag("n", cust % 1200)).alias("label"))
    return pairing.label_navigation(labels, sessions)
