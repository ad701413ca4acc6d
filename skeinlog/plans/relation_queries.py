"""Queries over relations between sessions and records, and over sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.operators import dispatches, graph, ordered, setops
from skeinlog.plans import bind
from skeinlog.plans.record_queries import landed, session_file
from skeinlog.plans.registry import query
from skeinlog.session import materialize, table
from skeinlog.sources import deepseek, files

EDGES_SQL = """ed AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 31 = 0 AND c_custkey > 0 THEN c_custkey + 1 WHEN c_custkey % 31 = 1 AND c_custkey > 7 THEN c_custkey - 1
    WHEN c_custkey < 7 THEN NULL ELSE c_custkey // 7 END AS parent FROM customer),
kn AS (SELECT e.node, p.node AS parent FROM ed e LEFT JOIN ed p ON p.node = e.parent),
wk AS (SELECT node, node AS cur, 0 AS d FROM kn UNION ALL SELECT wk.node, kn.parent, d + 1 FROM wk JOIN kn ON kn.node = wk.cur WHERE kn.parent IS NOT NULL AND d < 64),
ch AS (SELECT node, max(d) AS d, arg_max(cur, d) AS cur, bool_or(d > 0 AND cur = node) AS on_cycle FROM wk GROUP BY 1)"""


def edges(spark, root):
    n = F.col("c_custkey")
    parent = (F.when((n % 31 == 0) & (n > 0), n + 1).when((n % 31 == 1) & (n > 7), n - 1).when(n >= 7, F.floor(n / 7)))
    return table(spark, root, "customer").select(n.alias("node"), parent.alias("parent"))


@query("grf_01_fork_chains", f"""
WITH RECURSIVE {EDGES_SQL} SELECT node, CASE WHEN d < 64 THEN cur END AS root, CASE WHEN d < 64 THEN CAST(d AS BIGINT) END AS depth, d >= 64 AS endless FROM ch""")
def _(spark, root):
    return graph.chains(edges(spark, root))


@query("grf_02_cycle_members_cleared", f"""
WITH RECURSIVE {EDGES_SQL} SELECT ed.node, CASE WHEN NOT on_cycle THEN parent END AS parent FROM ed JOIN ch USING (node)""")
def _(spark, root):
    return graph.without_cycles(edges(spark, root))


@query("osl_07_parents_first", f"""
WITH RECURSIVE {EDGES_SQL} SELECT node, CAST(d AS BIGINT) AS depth FROM ch WHERE d < 64""")
def _(spark, root):
    return graph.chains(edges(spark, root)).filter("not endless").select("node", "depth").orderBy("depth", "node")


@query("grf_04_conflict_propagation", """
WITH RECURSIVE ed AS (SELECT c_custkey AS node, CASE WHEN c_custkey >= 7 THEN c_custkey // 7 END AS parent FROM customer),
bad AS (SELECT node FROM ed WHERE node % 211 = 5 UNION SELECT ed.node FROM ed JOIN bad ON ed.parent = bad.node) SELECT node FROM bad""")
def _(spark, root):
    n = F.col("c_custkey")
    e = table(spark, root, "customer").select(n.alias("node"), F.when(n >= 7, F.floor(n / 7)).alias("parent"))
    return graph.propagate_conflicts(e, e.filter("node % 211 = 5"))


@query("set_03_conflicts_removed", """
WITH RECURSIVE ed AS (SELECT c_custkey AS node, CASE WHEN c_custkey >= 7 THEN c_custkey // 7 END AS parent FROM customer),
bad AS (SELECT node FROM ed WHERE node % 211 = 5 UNION SELECT ed.node FROM ed JOIN bad ON ed.parent = bad.node)
SELECT node, parent FROM ed WHERE node NOT IN (SELECT node FROM bad)""")
def _(spark, root):
    n = F.col("c_custkey")
    e = table(spark, root, "customer").select(n.alias("node"), F.when(n >= 7, F.floor(n / 7)).alias("parent"))
    return e.join(graph.propagate_conflicts(e, e.filter("node % 211 = 5")), "node", "left_anti")


TREE_SQL = """tn AS (SELECT *, lag(line, 1) OVER w AS p1, lag(line, 2) OVER w AS p2 FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY line)),
tr AS (SELECT session_id, line, CAST(line AS VARCHAR) AS uuid, CAST(CASE WHEN k % 3 = 0 THEN coalesce(p2, p1) ELSE p1 END AS VARCHAR) AS parent_uuid, role, kind, k FROM tn)"""


def tree(spark, root):
    ev = bind.events(spark, root).select("session_id", "line", "role", "kind", "k")
    one = ordered.scan(ev, ["session_id"], "line", p1=ordered.Lag(F.col("line")))
    two = ordered.scan(materialize(one, "records"), ["session_id"], "line", p2=ordered.Lag(F.col("p1")))
    parent = F.when(F.col("k") % 3 == 0, F.coalesce("p2", "p1")).otherwise(F.col("p1"))
    return materialize(two.select("session_id", "line", F.col("line").cast("string").alias("uuid"), parent.cast("string").alias("parent_uuid"), "role", "kind", "k"), "records")


@query("grf_03_turn_inheritance", f"""
WITH RECURSIVE {bind.EVENTS_SQL}, {TREE_SQL}, vl AS (SELECT session_id, uuid, parent_uuid, CASE WHEN role = 'user' THEN 'p' || uuid END AS value FROM tr),
wk AS (SELECT session_id, uuid, uuid AS cur, value, parent_uuid AS up FROM vl UNION ALL SELECT wk.session_id, wk.uuid, vl.uuid, vl.value, vl.parent_uuid FROM wk JOIN vl ON vl.session_id = wk.session_id AND vl.uuid = wk.up WHERE wk.value IS NULL)
SELECT session_id, uuid, max(value) AS value FROM wk GROUP BY 1, 2""")
def _(spark, root):
    t = tree(spark, root)
    return graph.nearest_ancestor_value(t.select("session_id", "line", "uuid", "parent_uuid", F.when(F.col("role") == "user", F.concat(F.lit("p"), "uuid")).alias("value")))


@query("grf_05_fork_point_ancestry", f"""
WITH RECURSIVE {bind.EVENTS_SQL}, {TREE_SQL}, wk AS (SELECT session_id, uuid AS point, uuid, parent_uuid AS up, 0 AS steps, k = 13 AS bad FROM tr WHERE kind = 'error' AND k % 10 = 0
  UNION ALL SELECT wk.session_id, point, tr.uuid, tr.parent_uuid, steps + 1, tr.k = 13 FROM wk JOIN tr ON tr.session_id = wk.session_id AND tr.uuid = wk.up)
SELECT session_id, point, uuid, CAST(steps AS BIGINT) AS steps FROM wk WHERE (session_id, point) NOT IN (SELECT (session_id, point) FROM wk WHERE bad)""")
def _(spark, root):
    t = tree(spark, root)
    points = t.filter("kind = 'error' and k % 10 = 0").select("session_id", F.col("uuid").alias("point"))
    rows = t.select("session_id", "uuid", "parent_uuid")
    return graph.ancestry(rows.unionByName(t.filter("k = 13").select(*rows.columns)), points)


NUMBERED_SQL = "rn AS (SELECT session_id, k, row_number() OVER (PARTITION BY session_id ORDER BY line) AS n FROM ev)"


def numbered(spark, root):
    return ordered.scan(bind.events(spark, root).select("session_id", "line", "k"), ["session_id"], "line", n=ordered.RowNumber())


@query("grf_06_dispatch_depths", f"""
WITH RECURSIVE {bind.EVENTS_SQL}, {NUMBERED_SQL},
nd AS (SELECT session_id, 'd' || n AS node_id, CASE WHEN k % 19 = 0 THEN 'd' || (n + 1) WHEN n < 4 THEN 'r' ELSE 'd' || (n // 2) END AS parent_id, n FROM rn),
wk AS (SELECT session_id, node_id, n, 1 AS depth FROM nd WHERE parent_id = 'r' UNION ALL SELECT nd.session_id, nd.node_id, nd.n, depth + 1 FROM wk JOIN nd ON nd.session_id = wk.session_id AND nd.parent_id = wk.node_id WHERE nd.n > wk.n)
SELECT nd.session_id, nd.node_id, CAST(depth AS BIGINT) AS depth, CASE WHEN depth IS NOT NULL THEN '' WHEN nd.parent_id = 'd' || (nd.n + 1) THEN 'parent ' || nd.parent_id || ' is not an earlier dispatch in root r'
  ELSE 'dispatch ancestry exceeds the supported depth for ' || nd.node_id END AS reason FROM nd LEFT JOIN wk USING (session_id, node_id)""")
def _(spark, root):
    r, n = numbered(spark, root), F.col("n")
    id_ = lambda x: F.concat(F.lit("d"), x.cast("string"))
    parent = F.when(F.col("k") % 19 == 0, id_(n + 1)).when(n < 4, "r").otherwise(id_(F.floor(n / 2)))
    nodes = r.select("session_id", id_(n).alias("node_id"), F.lit("r").alias("root_id"), parent.alias("parent_id"), F.lit("Read").alias("name"), n.alias("seq"), F.lit("").alias("reason"))
    calls = r.select("session_id", F.lit("r").alias("call_id"), F.lit("run_code").alias("name"), F.lit(0).alias("seq")).distinct()
    return dispatches.depths(materialize(nodes, "dispatch-nodes"), calls).select("session_id", "node_id", "depth", "reason")


def dispatch_lines(spark, root):
    """Two outer calls a session, then a nested dispatch per event: its start, for every other one its end, and broken ones."""
    k, n, s = F.col("k"), F.col("n"), F.col("session_id")
    id_ = lambda x: F.concat(F.lit("d"), x.cast("string"))

    def record(kind, seq, *data):
        return F.to_json(F.struct(F.lit(kind).alias("type"), seq.alias("seq"), F.struct(*data).alias("data")))

    def dispatch(kind, seq, arguments):
        top = F.when(k == 17, "r1").otherwise("r0")
        parent = F.when(k % 19 == 0, id_(n + 1)).when(k == 23, id_(n)).when(n < 4, top).when(s.cast("bigint") % 3 == 0, id_(n - 1)).otherwise(id_(F.floor(n / 2)))
        return record(kind, seq, id_(n).alias("subCallId"), top.alias("rootCallId"), parent.alias("parentCallId"), F.when(k != 41, "Read").alias("name"), arguments.alias("arguments"))
    path, other = F.struct(k.alias("path"), F.lit(1).alias("a")), F.struct(F.lit(1).alias("a"), k.alias("path"))  # one object, in either order
    started = F.when(k != 47, dispatch("tool/ptc-dispatch-start", n * 3, path))
    again = F.when(k == 37, dispatch("tool/code-dispatch-start", n * 3 + 1, path))
    ended = (F.when(k == 31, dispatch("tool/ptc-dispatch", n * 3 - 1, other)).when(k == 43, dispatch("tool/ptc-dispatch", n * 3 + 2, F.struct(F.lit(2).alias("a"), k.alias("path"))))
             .when((n % 2 == 0) & (k != 41) | (k == 47), dispatch("tool/ptc-dispatch", n * 3 + 2, other)))
    r = numbered(spark, root)
    body = r.select("session_id", "n", F.posexplode(F.array(started, again, ended)).alias("i", "text")).filter("text is not null").select("session_id", (n * 3 + F.col("i")).alias("line"), "text")
    call = lambda i, tool: record("tool/call", F.lit(i), F.lit(f"r{i}").alias("callId"), F.lit(tool).alias("name"))
    head = F.to_json(F.struct(F.lit("session").alias("type"), F.when(s.cast("bigint") % 10 == 3, 7).otherwise(4).alias("version"), s.alias("id")))
    first = r.select("session_id").distinct().select("session_id", F.posexplode(F.array(head, call(0, "Run_Code"), call(1, "bash"))).alias("i", "text")).select("session_id", (F.col("i").cast("bigint") - 2).alias("line"), "text")
    return landed(first.unionByName(body).select("session_id", session_file().alias("file"), (F.col("line") + 3).alias("line"), "text"))


@query("grf_06_code_dispatches", f"""
WITH RECURSIVE {bind.EVENTS_SQL}, {NUMBERED_SQL},
nd AS (SELECT session_id, n, k, 'd' || n AS id, CASE WHEN k = 17 THEN 'r1' ELSE 'r0' END AS top, n * 3 + CASE WHEN k = 47 THEN 2 WHEN k = 31 THEN -1 ELSE 0 END AS seq,
  CASE WHEN k % 19 = 0 THEN 'd' || (n + 1) WHEN k = 23 THEN 'd' || n WHEN n < 4 THEN CASE WHEN k = 17 THEN 'r1' ELSE 'r0' END WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN 'd' || (n - 1) ELSE 'd' || (n // 2) END AS up
  FROM rn WHERE CAST(session_id AS BIGINT) % 10 <> 3),
ok AS (SELECT * FROM nd WHERE k NOT IN (31, 37, 41, 43)),
jd AS (SELECT nd.session_id, nd.n, nd.id, nd.up, nd.top, nd.seq, CASE WHEN nd.k IN (37, 43) THEN 'ambiguous dispatch identity ' || nd.id WHEN nd.k = 31 THEN 'settlement precedes start for ' || nd.id
    WHEN nd.k = 41 THEN 'missing durable dispatch identity' WHEN nd.top = 'r1' THEN 'root r1 is not an outer run_code call' WHEN nd.up = nd.top THEN '' WHEN nd.up = nd.id THEN 'cyclic dispatch ancestry at ' || nd.id
    WHEN p.id IS NULL OR p.seq >= nd.seq OR p.top <> nd.top THEN 'parent ' || nd.up || ' is not an earlier dispatch in root ' || nd.top ELSE '' END AS reason
  FROM nd LEFT JOIN ok p ON p.session_id = nd.session_id AND p.id = nd.up),
wk AS (SELECT session_id, id, 1 AS chain FROM jd WHERE reason = '' AND up = top UNION ALL SELECT jd.session_id, jd.id, chain + 1 FROM wk JOIN jd ON jd.session_id = wk.session_id AND jd.up = wk.id WHERE jd.reason = '')
SELECT jd.session_id, CASE WHEN reason = 'missing durable dispatch identity' THEN NULL ELSE jd.id END AS node_id, seq, CAST(chain AS BIGINT) AS chain, CAST(CASE WHEN chain <= 256 THEN chain END AS BIGINT) AS depth,
  CASE WHEN reason = '' AND (chain IS NULL OR chain > 256) THEN 'dispatch ancestry exceeds the supported depth for ' || jd.id ELSE reason END AS reason
FROM jd LEFT JOIN wk ON wk.session_id = jd.session_id AND wk.id = jd.id""")
def _(spark, root):
    parsed = materialize(files.parsed(dispatch_lines(spark, root)), "dispatch-records")
    nodes = dispatches.identities(deepseek.dispatch_rows(parsed))
    return dispatches.depths(nodes, deepseek.call_rows(parsed)).select("session_id", "node_id", "seq", "chain", "depth", "reason")


FORKS_SQL = """pp AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line) - 1 AS pos, 'd' || line AS digest, ts_text, kind AS shape, layer, event_id, k, preview FROM ev),
cu AS (SELECT session_id, 10 + CAST(session_id AS BIGINT) % 20 AS cut FROM ev GROUP BY 1),
cc AS (SELECT 'f' || session_id AS session_id, 0 AS pos, 'meta' AS digest, '2024-01-10T00:00:00.000Z' AS ts_text, 'session_meta' AS shape FROM cu
  UNION ALL SELECT 'f' || session_id, pos + 1, CASE WHEN pos < cut THEN digest ELSE 'x' || digest END, ts_text, CASE WHEN pos < cut OR k % 2 = 0 THEN shape ELSE shape || '2' END
  FROM pp JOIN cu USING (session_id) ),
mt AS (SELECT 'f' || session_id AS session_id, session_id AS parent_id, least(cut, count(*)) AS matched, count(*) AS n FROM pp JOIN cu USING (session_id) GROUP BY session_id, cut),
fk AS (SELECT m.session_id, m.parent_id, m.matched, '2024-01-10T00:00:00.000Z' AS forked_at FROM mt m WHERE m.matched = m.n OR (
  NOT EXISTS (SELECT 1 FROM pp WHERE pp.session_id = m.parent_id AND pos >= matched AND ts_text = '') AND (
    NOT EXISTS (SELECT 1 FROM pp WHERE pp.session_id = m.parent_id AND pos >= matched AND ts_text <= '2024-01-10T00:00:00.000Z')
    OR EXISTS (SELECT 1 FROM pp JOIN cc ON cc.session_id = m.session_id AND cc.pos = matched + 1 WHERE pp.session_id = m.parent_id AND pp.pos = matched AND pp.shape <> cc.shape))))"""

FORKED_AT = "2024-01-10T00:00:00.000Z"


def parent_rows(spark, root):
    ev = bind.events(spark, root).select("session_id", "line", "ts_text", "kind", "layer", "event_id", "k", "preview")
    r = ordered.scan(ev, ["session_id"], "line", pos=ordered.RowNumber())
    return materialize(r.withColumns({"pos": F.col("pos") - 1, "digest": F.concat(F.lit("d"), F.col("line").cast("string")), "shape": F.col("kind")}), "records")


def child_rows(parents):
    """A fork child of every session: a metadata row, a copied prefix, and rows of its own for the rest."""
    user = F.col("session_id").cast("bigint")
    cut = 10 + user % 20
    own = F.col("pos") >= cut
    child = F.concat(F.lit("f"), "session_id").alias("session_id")
    body = parents.select(
        child, (F.col("pos") + 1).alias("pos"), F.when(own, F.concat(F.lit("x"), "digest")).otherwise(F.col("digest")).alias("digest"), "ts_text",
        F.when(~own | (F.col("k") % 2 == 0), F.col("shape")).otherwise(F.concat("shape", F.lit("2"))).alias("shape"))
    head = parents.filter("pos = 0").select(
        child, F.lit(0).cast("bigint").alias("pos"), F.lit("meta").alias("digest"), F.lit(FORKED_AT).alias("ts_text"), F.lit("session_meta").alias("shape"))
    relation = parents.filter("pos = 0").select(child, F.col("session_id").alias("parent_id"))
    return head.unionByName(body), relation


def forks_of(spark, root):
    parents = parent_rows(spark, root)
    children, relation = child_rows(parents)
    return parents, children, graph.confirmed_forks(graph.copied_prefix(children, parents, relation), children, parents)


@query("jon_18_copied_prefix", bind.with_events(f"WITH {FORKS_SQL} SELECT session_id, parent_id, matched FROM mt"))
def _(spark, root):
    parents = parent_rows(spark, root)
    children, relation = child_rows(parents)
    return graph.copied_prefix(children, parents, relation)


@query("jon_18_confirmed_forks", bind.with_events(f"WITH {FORKS_SQL} SELECT session_id, parent_id, matched, forked_at FROM fk"))
def _(spark, root):
    return forks_of(spark, root)[2]


@query("grf_08_fork_segments", bind.with_events(f"""
WITH {FORKS_SQL} SELECT cc.session_id, cc.pos, CASE WHEN matched IS NULL THEN '' WHEN cc.pos = 0 THEN 'fork_metadata' WHEN cc.pos <= matched THEN 'inherited_context' ELSE 'continuation' END AS segment
FROM cc LEFT JOIN fk USING (session_id)"""))
def _(spark, root):
    _, children, forks = forks_of(spark, root)
    return graph.segment_rows(children, forks).select("session_id", "pos", "segment")


@query("flt_10_owned_history", bind.with_events(f"""
WITH {FORKS_SQL} SELECT cc.session_id, cc.pos, cc.digest FROM cc LEFT JOIN fk USING (session_id) WHERE matched IS NULL OR cc.pos = 0 OR cc.pos > matched"""))
def _(spark, root):
    _, children, forks = forks_of(spark, root)
    return graph.segment_rows(children, forks).filter("segment <> 'inherited_context'").select("session_id", "pos", "digest")


@query("set_06_child_continuation", bind.with_events(f"""
WITH {FORKS_SQL} SELECT cc.session_id, cc.pos FROM cc JOIN fk USING (session_id) WHERE cc.pos > matched"""))
def _(spark, root):
    _, children, forks = forks_of(spark, root)
    return graph.segment_rows(children, forks).filter("segment = 'continuation'").select("session_id", "pos")


@query("grf_08_crossing_events", bind.with_events(f"""
WITH {FORKS_SQL}, g AS (SELECT cc.session_id, cc.pos // 4 AS event_id, count(DISTINCT CASE WHEN cc.pos = 0 THEN 'm' WHEN cc.pos <= matched THEN 'i' ELSE 'c' END) AS n FROM cc JOIN fk USING (session_id) WHERE cc.pos > 3 GROUP BY 1, 2)
SELECT DISTINCT session_id FROM g WHERE n > 1"""))
def _(spark, root):
    _, children, forks = forks_of(spark, root)
    seg = graph.segment_rows(children, forks).filter("pos > 3").withColumn("raw_id", F.col("digest"))
    refs = seg.select("session_id", F.floor(F.col("pos") / 4).alias("event_id"), "raw_id")
    return graph.crossing_forks(refs, seg)


@query("agg_16_inherited_context", bind.with_events(f"""
WITH {FORKS_SQL} SELECT fk.session_id, fk.parent_id, count(*) FILTER (WHERE layer <> 'protocol') AS main_events, count(*) FILTER (WHERE layer = 'protocol') AS protocol_events,
  least(12, count(*) FILTER (WHERE layer <> 'protocol')) AS preview_events, greatest(0, count(*) FILTER (WHERE layer <> 'protocol') - 12) AS omitted_previews,
  arg_min(ts_text, pos) AS started_at, arg_max(ts_text, pos) AS updated_at FROM fk JOIN pp ON pp.session_id = fk.parent_id AND pos < matched GROUP BY 1, 2"""))
def _(spark, root):
    parents, _, forks = forks_of(spark, root)
    return graph.inherited_summary(parents.withColumn("has_text", F.col("preview") != ""), forks).drop("fork_point")


@query("agg_16_inherited_previews", bind.with_events(f"""
WITH {FORKS_SQL}, r AS (SELECT fk.session_id, fk.parent_id, pos, event_id, ts_text, preview, row_number() OVER (PARTITION BY fk.session_id ORDER BY pos DESC) AS back, count(*) OVER (PARTITION BY fk.session_id) AS n
  FROM fk JOIN pp ON pp.session_id = fk.parent_id AND pos < matched WHERE layer <> 'protocol')
SELECT session_id, parent_id, pos, event_id, ts_text, preview, least(n, 12) - back + 1 AS place FROM r WHERE back <= 12"""))
def _(spark, root):
    parents, _, forks = forks_of(spark, root)
    return graph.inherited_previews(parents, forks).select("session_id", "parent_id", "pos", "event_id", "ts_text", "preview", "place")


@query("grf_11_fork_point_target", bind.with_events(f"""
WITH {FORKS_SQL} SELECT fk.session_id, coalesce(arg_max(event_id, pos) FILTER (WHERE layer <> 'protocol' AND k % 2 = 0), arg_max(event_id, pos)) AS fork_point
FROM fk JOIN pp ON pp.session_id = fk.parent_id AND pos < matched GROUP BY 1"""))
def _(spark, root):
    parents, _, forks = forks_of(spark, root)
    return graph.inherited_summary(parents.withColumn("has_text", F.col("k") % 2 == 0), forks).select("session_id", "fork_point")


@query("grf_07_superseded_parents", bind.with_events("""
WITH a AS (SELECT session_id, max(ts_text) AS last_ts, bool_and(ts_text <> '') AS all_timed, bool_or(layer = 'main') AS has_main FROM ev GROUP BY 1),
f AS (SELECT session_id, CAST(CAST(session_id AS BIGINT) // 2 AS VARCHAR) AS parent_id, CASE WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN '2024-01-30T12:00:00.000Z' ELSE '2024-02-10T00:00:00.000Z' END AS forked_at, CAST(session_id AS BIGINT) % 2 = 1 AS derived FROM a WHERE CAST(session_id AS BIGINT) > 1),
o AS (SELECT parent_id, min(session_id) AS child_id, min(forked_at) AS superseded_at FROM f WHERE NOT derived GROUP BY 1 HAVING count(*) = 1)
SELECT o.parent_id, o.child_id, superseded_at FROM o JOIN a p ON p.session_id = o.parent_id JOIN a c ON c.session_id = o.child_id WHERE p.all_timed AND p.last_ts <= superseded_at AND c.has_main"""))
def _(spark, root):
    ev = bind.events(spark, root)
    activity = ev.groupBy("session_id").agg(F.max("ts_text").alias("last_ts"), F.bool_and(F.col("ts_text") != "").alias("all_timed"), F.bool_or(F.col("layer") == "main").alias("has_main"))
    s = F.col("session_id").cast("bigint")
    forks = activity.filter(s > 1).select("session_id", F.floor(s / 2).cast("string").alias("parent_id"),
                                          F.when(s % 3 == 0, "2024-01-30T12:00:00.000Z").otherwise("2024-02-10T00:00:00.000Z").alias("forked_at"), (s % 2 == 1).alias("derived"))
    return graph.superseded(forks, activity)


@query("grf_09_history_boundary", bind.with_events("""
WITH n AS (SELECT session_id, k, row_number() OVER (PARTITION BY session_id ORDER BY line) AS n, count(*) OVER (PARTITION BY session_id) AS c FROM ev),
b AS (SELECT session_id, bool_or(k = 61) AS broken, max(c) AS c FROM n GROUP BY 1)
SELECT session_id, 'p' || session_id AS parent_id, 2 + CAST(session_id AS BIGINT) AS start, 1 + CAST(session_id AS BIGINT) AS inherited FROM b
WHERE NOT broken AND 2 + CAST(session_id AS BIGINT) <= c AND CAST(session_id AS BIGINT) % 5 <> 0"""))
def _(spark, root):
    s = F.col("session_id").cast("bigint")
    r = ordered.scan(bind.events(spark, root).select("session_id", "line", "k"), ["session_id"], "line", n=ordered.RowNumber())
    rows = r.select("session_id", "line", (F.col("n") - 1 + F.when(F.col("k") == 61, 1).otherwise(0)).alias("ordinal"),
                    F.when(F.col("n") == 1, 2 + s).alias("start_ordinal"), F.concat(F.lit("p"), "session_id").alias("parent_id"),
                    F.concat(F.when(s % 5 == 0, "q").otherwise("p"), "session_id").alias("meta_of"))
    return graph.history_boundary(rows)


@query("grf_10_record_digest", """
SELECT event_id, sha256('{"event":"' || event_type || '","k":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ',"user":' || user_id || '}') AS digest FROM events""")
def _(spark, root):
    from skeinlog.functions import search_json
    e = table(spark, root, "events")
    record = F.to_json(F.struct(F.col("user_id").alias("user"), F.date_format("ts", "yyyy").alias("timestamp"), F.lit(None).cast("string").alias("none"),
                                F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("event_type").alias("event")), {"ignoreNullFields": "false"})
    return e.select("event_id", F.sha2(search_json.canonical_record(record), 256).alias("digest"))


@query("grf_12_lineage", """
WITH s AS (SELECT c_custkey AS session_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey // 3 + 100 END AS parent_id, CASE WHEN c_custkey % 3 = 0 THEN 'subagent' ELSE 'user' END AS origin, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 7 END AS seed_length FROM customer)
SELECT s.session_id, CASE WHEN s.origin = 'subagent' AND p.session_id IS NOT NULL THEN s.parent_id END AS owner_id,
  CASE WHEN p.session_id IS NOT NULL AND (s.origin <> 'subagent' OR coalesce(s.seed_length, 0) > 0) THEN s.parent_id END AS forked_from, CASE WHEN coalesce(s.seed_length, 0) > 0 THEN s.seed_length END AS boundary
FROM s LEFT JOIN s p ON p.session_id = s.parent_id""")
def _(spark, root):
    n = F.col("c_custkey")
    s = table(spark, root, "customer").select(n.alias("session_id"), F.when(n % 4 != 0, F.floor(n / 3) + 100).alias("parent_id"),
                                              F.when(n % 3 == 0, "subagent").otherwise("user").alias("origin"), F.when(n % 5 == 0, n % 7).alias("seed_length"))
    return graph.lineage(s)


@query("grf_13_unique_descendant", f"""
WITH RECURSIVE {bind.EVENTS_SQL}, {TREE_SQL}, wk AS (SELECT session_id, uuid AS point, uuid, parent_uuid AS up FROM tr WHERE kind = 'compaction'
  UNION ALL SELECT wk.session_id, point, tr.uuid, tr.parent_uuid FROM wk JOIN tr ON tr.session_id = wk.session_id AND tr.uuid = wk.up)
SELECT wk.session_id, point, wk.uuid AS goal_uuid FROM wk JOIN tr ON tr.session_id = wk.session_id AND tr.uuid = wk.uuid WHERE tr.role = 'user' AND tr.k % 5 = 0""")
def _(spark, root):
    t = tree(spark, root)
    paths = graph.ancestry(t.select("session_id", "uuid", "parent_uuid"), t.filter("kind = 'compaction'").select("session_id", F.col("uuid").alias("point")))
    goals = t.filter("role = 'user' and k % 5 = 0").select("session_id", "uuid")
    return paths.join(goals, ["session_id", "uuid"]).select("session_id", "point", F.col("uuid").alias("goal_uuid"))


@query("jon_19_foreign_parent", """
WITH r AS (SELECT DISTINCT l_orderkey AS session_id, l_partkey AS uuid FROM lineitem), f AS (SELECT session_id, session_id // 2 AS foreign_id FROM r UNION SELECT session_id, session_id // 3 FROM r),
s AS (SELECT DISTINCT f.session_id, f.foreign_id FROM f JOIN r a ON a.session_id = f.session_id JOIN r b ON b.session_id = f.foreign_id AND b.uuid = a.uuid WHERE f.session_id <> f.foreign_id)
SELECT session_id, min(foreign_id) AS parent_id FROM s GROUP BY 1 HAVING count(*) = 1""")
def _(spark, root):
    r = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("uuid"))
    s = F.col("session_id")
    refs = r.select("session_id", F.floor(s / 2).alias("foreign_id")).unionByName(r.select("session_id", F.floor(s / 3).alias("foreign_id")))
    return graph.unique_foreign_parent(r, refs)


@query("jon_19_copied_by_reference", bind.with_events("""
WITH n AS (SELECT session_id, k, row_number() OVER (PARTITION BY session_id ORDER BY line) - 1 AS pos FROM ev)
SELECT session_id, 'p' AS parent_id, coalesce(min(pos) FILTER (WHERE k >= 90), max(pos) + 1) AS copied FROM n GROUP BY 1 HAVING copied > 0"""))
def _(spark, root):
    r = ordered.scan(bind.events(spark, root).select("session_id", "line", "k"), ["session_id"], "line", n=ordered.RowNumber())
    rows = r.select("session_id", (F.col("n") - 1).alias("pos"), F.when(F.col("k") < 90, "p").alias("reference"))
    return graph.copied_by_reference(rows, rows.select("session_id").distinct().withColumn("parent_id", F.lit("p")))


@query("jon_20_pointer_forks", """
WITH s AS (SELECT md5(CAST(c_custkey AS VARCHAR)) AS session_id, c_nationkey % 2 AS container, c_custkey FROM customer),
p AS (SELECT session_id AS parent_id, container, substr(md5(CAST(c_custkey // 2 + 1 AS VARCHAR)), 1, CAST(8 + c_custkey % 3 AS INT)) AS prefix FROM s WHERE c_custkey % 5 = 0),
m AS (SELECT p.parent_id, p.prefix, min(s.session_id) AS child_id FROM p JOIN s ON s.container = p.container AND starts_with(s.session_id, p.prefix) AND s.session_id <> p.parent_id GROUP BY 1, 2 HAVING count(DISTINCT s.session_id) = 1)
SELECT child_id, min(parent_id) AS parent_id FROM m GROUP BY 1 HAVING count(*) = 1""")
def _(spark, root):
    n = F.col("c_custkey")
    s = table(spark, root, "customer").select(F.md5(n.cast("string")).alias("session_id"), (F.col("c_nationkey") % 2).alias("container"), "c_custkey")
    prefix = F.md5((F.floor(n / 2) + 1).cast("string")).substr(F.lit(1), (8 + n % 3).cast("int"))
    return graph.pointer_forks(s.filter("c_custkey % 5 = 0").select(F.col("session_id").alias("parent_id"), "container", prefix.alias("prefix")), s)


@query("set_01_layer_union", bind.with_events("""
SELECT layer, session_id, count(*) AS rows FROM (SELECT session_id, layer FROM ev UNION ALL SELECT session_id, 'raw' FROM ev) GROUP BY 1, 2"""))
def _(spark, root):
    ev = bind.events(spark, root)
    cols = ["session_id", "line", "event_id", "kind"]
    u = setops.union_layers(ev.filter("layer = 'main'").select(*cols), ev.filter("layer = 'protocol'").select(*cols), ev.select(*cols))
    return u.groupBy("layer", "session_id").agg(F.count(F.lit(1)).alias("rows"))


@query("set_02_duplicate_transcripts", """
WITH d AS (SELECT 'id' || (doc_id // 2) AS identity, CASE WHEN doc_id % 6 < 4 THEN 'same' || (doc_id // 2) ELSE sha256(text) END AS fingerprint, CASE WHEN doc_id % 4 = 1 THEN 'id' || (doc_id // 2) ELSE 'x' || doc_id END AS file FROM documents)
SELECT identity, count(*) AS files, count(DISTINCT fingerprint) > 1 AS conflict, CASE WHEN count(DISTINCT fingerprint) = 1 THEN arg_min(file, (file <> identity, file)) END AS kept FROM d GROUP BY 1""")
def _(spark, root):
    d, n = table(spark, root, "documents"), F.col("doc_id")
    half = F.floor(n / 2).cast("string")
    ident = F.concat(F.lit("id"), half)
    c = d.select(ident.alias("identity"), F.when(n % 6 < 4, F.concat(F.lit("same"), half)).otherwise(F.sha2("text", 256)).alias("fingerprint"),
                 F.when(n % 4 == 1, ident).otherwise(F.concat(F.lit("x"), n.cast("string"))).alias("file"))
    return setops.resolve_duplicates(c.withColumn("canonical", F.col("file") == F.col("identity"))).select("identity", "files", "conflict", "kept")


@query("set_02_document_copies", """
SELECT sha256(text) AS fingerprint, count(*) AS copies, min(doc_id) AS kept FROM documents GROUP BY 1""")
def _(spark, root):
    d = table(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    return d.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("kept"))


@query("set_04_distinct_values", bind.with_events("""
SELECT DISTINCT session_id, file FROM (SELECT session_id, unnest([file_a, file_b]) AS file FROM ev) WHERE file <> ''"""))
def _(spark, root):
    return bind.events(spark, root).select("session_id", F.explode(F.array_distinct("touched_files")).alias("file")).distinct()


@query("set_05_shared_lineage", """
WITH r AS (SELECT DISTINCT p_name || p_brand AS uuid, p_size AS session_id FROM part), o AS (SELECT uuid, min(session_id) AS origin FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT origin, session_id, count(*) AS shared FROM r JOIN o USING (uuid) WHERE session_id <> origin GROUP BY 1, 2""")
def _(spark, root):
    r = table(spark, root, "part").select(F.concat("p_name", "p_brand").alias("uuid"), F.col("p_size").alias("session_id"), F.col("p_size").alias("rank"))
    return setops.shared_lineage(r)


@query("set_07_notification_dedup", bind.with_events("""
SELECT session_id, k % 12 AS call_key, k % 24 AS fingerprint, min(line) AS line, arg_min(event_id, line) AS event_id, count(*) AS copies FROM ev WHERE role = 'user' GROUP BY 1, 2, 3"""))
def _(spark, root):
    rows = bind.events(spark, root).filter("role = 'user'").select("session_id", (F.col("k") % 12).alias("call_key"), (F.col("k") % 24).alias("fingerprint"), "line", "event_id")
    return setops.first_per_fingerprint(rows, ["session_id", "call_key", "fingerprint"], "line", ["event_id"])


@query("set_08_duplicate_identities", bind.with_events("""
WITH c AS (SELECT session_id, k, count(*) AS n FROM ev WHERE role = 'assistant' GROUP BY 1, 2)
SELECT e.event_id, CASE WHEN n > 1 THEN 'protocol' ELSE 'main' END AS layer FROM ev e JOIN c ON c.session_id = e.session_id AND c.k = e.k WHERE role = 'assistant'"""))
def _(spark, root):
    rows = bind.events(spark, root).filter("role = 'assistant'").select("session_id", "k", "event_id")
    return setops.demote_duplicates(rows, ["session_id", "k"]).select("event_id", "layer")
