"""Filter, search, timeline, session list and file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.functions import paths, text
from skeinlog.operators import aggregates, ordered, search
from skeinlog.operators.search import Filters
from skeinlog.plans import bind
from skeinlog.plans.registry import query
from skeinlog.session import table

SESSIONS_SQL = """ss AS (SELECT session_id, coalesce(min(nullif(ts_text, '')), '') AS started_at,
  coalesce(max(nullif(ts_text, '')), '') AS updated_at, count(*) AS event_total,
  count(*) FILTER (WHERE kind = 'command' AND status = 'failed') AS failed_commands FROM ev GROUP BY 1)"""


def sessions_of(events):
    return (
        aggregates.time_range(events)
        .join(events.groupBy("session_id").agg(
            F.count(F.lit(1)).alias("event_total"),
            F.count_if((F.col("kind") == "command") & (F.col("status") == "failed")).alias("failed_commands")), "session_id")
    )


def as_search_rows(conversations):
    """Conversation turns in the columns the search operators read."""
    return conversations.select(
        "session_id", "line", "event_id", "kind", F.lit("").alias("subtype"), F.lit("main").alias("layer"),
        F.lit("").alias("ts_text"), F.lit("").alias("status"), F.lit("").alias("tool_name"),
        text.truncate(F.col("text")).alias("preview"), F.col("text").alias("search_text"))


# Phrase as the checking engine spells it; \s there is the ASCII set, which is all the inputs hold.
def rx(phrase: str) -> str:
    return "(?i)" + r"\s+".join(phrase.split())


def duck_snippet(column: str, phrase: str) -> str:
    at = f"(length(regexp_extract({column}, '(?is)^(.*?)(?:{rx(phrase)[4:]})', 1)))"
    return f"""CASE WHEN NOT regexp_matches({column}, '{rx(phrase)}') THEN '' ELSE
      (CASE WHEN {at} > 80 THEN '...' ELSE '' END)
      || trim(regexp_replace(substr({column}, greatest(0, {at} - 80) + 1,
           least(length({column}), {at} + 180) - greatest(0, {at} - 80)), '\\s+', ' ', 'g'))
      || (CASE WHEN {at} + 180 < length({column}) THEN '...' ELSE '' END) END"""


@query("flt_01_layer_filter", bind.with_events("""
SELECT session_id, event_id, kind, layer FROM ev WHERE layer = 'protocol'"""))
def _(spark, root):
    return bind.events(spark, root).filter(search.structural(Filters(layer="protocol"))).select(
        "session_id", "event_id", "kind", "layer")


@query("flt_02_kind_status_tool_filter", bind.with_events("""
SELECT session_id, event_id, kind, status, tool_name FROM ev
WHERE layer = 'main' AND (kind = 'mcp_call' OR subtype = 'mcp_call') AND status = 'success' AND contains(lower(tool_name), '__srv')"""))
def _(spark, root):
    f = Filters(kind="mcp_call", status="success", tool="__SRV")
    return bind.events(spark, root).filter(search.structural(f)).select("session_id", "event_id", "kind", "status", "tool_name")


@query("flt_03_file_filter", bind.with_events("""
SELECT session_id, event_id FROM ev WHERE layer = 'main'
AND (contains(lower(replace(file_a, chr(92), '/')), 'lib/f1') OR contains(lower(replace(file_b, chr(92), '/')), 'lib/f1')
     OR contains(lower(replace('Sessions/' || session_id || '.jsonl', chr(92), '/')), 'lib/f1'))"""))
def _(spark, root):
    ev = search.with_filter_files(bind.events(spark, root), F.concat(F.lit("Sessions/"), "session_id", F.lit(".jsonl")))
    return ev.filter(search.structural(Filters(file="LIB\\f1"))).select("session_id", "event_id")


@query("flt_04_session_date_range", bind.with_events(f"""
WITH {SESSIONS_SQL} SELECT session_id, started_at, updated_at FROM ss
WHERE coalesce(nullif(updated_at, ''), started_at) >= '2024-01-05T00:00:00.000Z'
  AND coalesce(nullif(updated_at, ''), started_at) <= '2024-01-30T23:59:59.999Z'"""))
def _(spark, root):
    f = Filters(date_from="2024-01-05", date_to="2024-01-30")
    return sessions_of(bind.events(spark, root)).filter(search.in_date_range(f)).select("session_id", "started_at", "updated_at")


@query("flt_05_phrase_predicate", f"""
SELECT doc_id, source FROM documents WHERE regexp_matches(text, '{rx('the that')}')""")
def _(spark, root):
    return table(spark, root, "documents").filter(text.matches_phrase(F.col("text"), " The   that ")).select("doc_id", "source")


@query("flt_07_active_expression_switch", bind.with_events("""
SELECT session_id, count(*) AS events FROM ev WHERE layer = 'main' AND contains(tool_name, 'patch') GROUP BY 1"""))
def _(spark, root):
    f = Filters(tool="patch", date_from="2024-01-01")
    assert not search.has_active_expression(f) and search.has_active_expression(Filters(q="x"))
    ev = bind.events(spark, root)
    return ev.filter(search.structural(f)).groupBy("session_id").agg(F.count(F.lit(1)).alias("events"))


@query("flt_08_project_membership", """
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '') AS cwd FROM pages)
SELECT page_id, cwd FROM p WHERE cwd = '/thther.example.org/en' OR starts_with(cwd, '/thther.example.org/en/')""")
def _(spark, root):
    cwd = F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "")
    p = table(spark, root, "pages").select("page_id", cwd.alias("cwd"))
    return p.filter(paths.inside_root(F.array("cwd"), "/thther.example.org/en/"))


@query("flt_09_file_activity", bind.with_events(r"""
SELECT session_id, line, event_id, kind, status, ts_text, tool_name,
  substr(trim(regexp_replace(preview, '\s+', ' ', 'g')), 1, 120) AS summary,
  CASE WHEN kind = 'patch' THEN 'patch_record' ELSE 'recorded_path' END AS association
FROM ev WHERE layer = 'main' AND 'src/g3.py' IN (file_a, regexp_replace(file_b, '^\./', ''))"""))
def _(spark, root):
    return search.file_activity(bind.events(spark, root), "src/./g3.py", "/work/project")


@query("flt_12_event_lookup", bind.with_events("""
SELECT session_id, event_id, kind, preview FROM ev WHERE session_id = '7' AND layer = 'main' AND event_id = 'e2'"""))
def _(spark, root):
    return search.event_by_id(bind.events(spark, root), "7", "e2").select("session_id", "event_id", "kind", "preview")


@query("txt_01_match_count", f"""
SELECT doc_id, CAST(greatest(len(regexp_extract_all(CASE WHEN length(t) <= 240 THEN t ELSE substr(t, 1, 237) || '...' END, '{rx('the that')}')),
   len(regexp_extract_all(text, '{rx('the that')}'))) AS BIGINT) AS match_count FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def _(spark, root):
    d = table(spark, root, "documents")
    return d.select("doc_id", text.event_match_count(text.truncate(F.col("text")), F.col("text"), "the that").alias("match_count"))


@query("txt_02_hit_flag", bind.with_events(f"""
SELECT event_id, regexp_matches(preview, '{rx('alpha1 beta')}') OR regexp_matches(search_text, '{rx('alpha1 beta')}') AS hit FROM ev"""))
def _(spark, root):
    return bind.events(spark, root).select(
        "event_id", text.event_hit(F.col("preview"), F.col("search_text"), "Alpha1  BETA").alias("hit"))


@query("txt_03_snippet", bind.with_events(f"""
SELECT event_id, {duck_snippet('search_text', 'needle3')} AS snippet FROM ev"""))
def _(spark, root):
    return bind.events(spark, root).select(
        "event_id", text.event_snippet(F.lit(""), F.col("search_text"), "needle3").alias("snippet"))


_PROJECT_SEARCH = bind.with_events(f"""
WITH st AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line) - 1 AS timeline_index FROM ev WHERE layer = 'main'),
h AS (SELECT *, CASE WHEN regexp_matches(preview, '{rx('alpha1 beta')}') THEN {duck_snippet('preview', 'alpha1 beta')}
        ELSE {duck_snippet('search_text', 'alpha1 beta')} END AS snip
      FROM st WHERE regexp_matches(preview, '{rx('alpha1 beta')}') OR regexp_matches(search_text, '{rx('alpha1 beta')}')),
r AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS event_count,
        row_number() OVER (PARTITION BY session_id ORDER BY ts_text DESC, timeline_index DESC) AS rn FROM h)
SELECT session_id, event_count, event_id AS latest_event_id, ts_text AS latest_ts, snip AS latest_snippet,
  timeline_index AS latest_timeline_index FROM r WHERE rn = 1""")


@query("txt_04_project_search", _PROJECT_SEARCH)
def _(spark, root):
    return search.project_search(bind.events(spark, root), Filters(q="alpha1 beta"))


@query("osl_02_search_order", f"""
SELECT row_number() OVER (ORDER BY latest_ts DESC, latest_timeline_index DESC, session_id) AS place, session_id, latest_ts
FROM ({_PROJECT_SEARCH}) QUALIFY place <= 150""")
def _(spark, root):
    top = search.order_search(search.project_search(bind.events(spark, root), Filters(q="alpha1 beta"))).limit(150)
    return ordered.place(top, [F.desc("latest_ts"), F.desc("latest_timeline_index"), F.asc("session_id")]).select(
        "place", "session_id", "latest_ts")


@query("agg_19_search_totals", f"""
SELECT count(*) AS total, CAST(coalesce(sum(event_count), 0) AS BIGINT) AS matching_event_total FROM ({_PROJECT_SEARCH})""")
def _(spark, root):
    return search.search_totals(search.project_search(bind.events(spark, root), Filters(q="alpha1 beta")))


@query("txt_04_project_search_no_phrase", bind.with_events(f"""
WITH {SESSIONS_SQL}, st AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line) - 1 AS timeline_index FROM ev
  WHERE layer = 'main' AND kind = 'command' AND session_id IN (SELECT session_id FROM ss WHERE updated_at >= '2024-01-20T00:00:00.000Z')),
r AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS event_count,
        row_number() OVER (PARTITION BY session_id ORDER BY ts_text DESC, timeline_index DESC) AS rn FROM st)
SELECT session_id, event_count, event_id AS latest_event_id, ts_text AS latest_ts, preview AS latest_snippet,
  timeline_index AS latest_timeline_index FROM r WHERE rn = 1"""))
def _(spark, root):
    ev = bind.events(spark, root)
    return search.project_search(ev, Filters(kind="command", date_from="2024-01-20"), sessions_of(ev))


@query("txt_04_conversation_search", bind.with_conversations(f"""
WITH st AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line) - 1 AS timeline_index FROM cv),
h AS (SELECT * FROM st WHERE regexp_matches(text, '{rx('and the')}'))
SELECT session_id, count(*) AS event_count, arg_max(event_id, timeline_index) AS latest_event_id, '' AS latest_ts,
  max(timeline_index) AS latest_timeline_index FROM h GROUP BY 1"""))
def _(spark, root):
    return search.project_search(as_search_rows(bind.conversations(spark, root)), Filters(q="and the")).drop("latest_snippet")


@query("txt_05_timeline_search", bind.with_events(f"""
SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY line) - 1 AS timeline_index,
  regexp_matches(preview, '{rx('beta tail')}') OR regexp_matches(search_text, '{rx('beta tail')}') AS hit,
  CAST(greatest(len(regexp_extract_all(preview, '{rx('beta tail')}')), len(regexp_extract_all(search_text, '{rx('beta tail')}'))) AS BIGINT) AS match_count
FROM ev WHERE layer = 'main' AND status = 'failed'"""))
def _(spark, root):
    rows = search.timeline(bind.events(spark, root), Filters(status="failed", q="beta tail"))
    return rows.select("session_id", "event_id", "timeline_index", "hit", "match_count")


@query("txt_05_timeline_totals", bind.with_events(f"""
SELECT session_id, count(*) AS total,
  CAST(sum(greatest(len(regexp_extract_all(preview, '{rx('alpha1')}')), len(regexp_extract_all(search_text, '{rx('alpha1')}')))) AS BIGINT) AS search_match_count,
  count(*) FILTER (WHERE regexp_matches(preview, '{rx('alpha1')}') OR regexp_matches(search_text, '{rx('alpha1')}')) AS search_event_count
FROM ev WHERE layer = 'main' GROUP BY 1"""))
def _(spark, root):
    return search.timeline_totals(search.annotated(bind.events(spark, root), Filters(q="alpha1")))


@query("osl_05_timeline_page", bind.with_events("""
SELECT session_id, event_id, timeline_index FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line) - 1 AS timeline_index FROM ev WHERE layer = 'main')
WHERE timeline_index >= 10 AND timeline_index < 30"""))
def _(spark, root):
    rows = search.timeline(bind.events(spark, root), Filters())
    return search.timeline_page(rows, 10, 20).select("session_id", "event_id", "timeline_index")


@query("win_01_timeline_ordinal", bind.with_events("""
SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY line) - 1 AS ordinal FROM ev"""))
def _(spark, root):
    rows = ordered.scan(bind.events(spark, root).select("session_id", "line", "event_id"), ["session_id"], "line",
                        ordinal=ordered.RowNumber())
    return rows.select("session_id", "event_id", (F.col("ordinal") - 1).alias("ordinal"))


@query("win_21_latest_match_pick", bind.with_events("""
SELECT session_id, event_id AS latest_event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_text DESC, line DESC) AS rn FROM ev WHERE status = 'failed') WHERE rn = 1"""))
def _(spark, root):
    return (bind.events(spark, root).filter("status = 'failed'").groupBy("session_id")
            .agg(F.max_by("event_id", F.struct("ts_text", "line")).alias("latest_event_id")))


@query("jon_29_sessions_with_match", bind.with_events(f"""
WITH {SESSIONS_SQL} SELECT session_id, started_at, event_total FROM ss
WHERE session_id IN (SELECT session_id FROM ev WHERE layer = 'main' AND kind = 'patch' AND status = 'declined')"""))
def _(spark, root):
    ev = bind.events(spark, root)
    return search.sessions_with_match(sessions_of(ev), ev, Filters(kind="patch", status="declined")).select(
        "session_id", "started_at", "event_total")


def _sorted_sessions(sort: str, order: str):
    sql = bind.with_events(f"""
WITH {SESSIONS_SQL} SELECT place, session_id FROM (
  SELECT row_number() OVER (ORDER BY {order}, session_id) AS place, session_id FROM ss) WHERE place <= 150""")

    def build(spark, root):
        top = search.sort_sessions(sessions_of(bind.events(spark, root)), sort).limit(150)
        keys = {"started-asc": [F.asc("started_at")], "events-desc": [F.desc("event_total")],
                "failures-desc": [F.desc("failed_commands")]}.get(sort, [F.desc("updated_at")])
        return ordered.place(top, [*keys, F.asc("session_id")]).select("place", "session_id")
    query(f"osl_01_sessions_{sort.replace('-', '_')}", sql)(build)


for _sort, _order in (("updated-desc", "updated_at DESC"), ("started-asc", "started_at"),
                      ("events-desc", "event_total DESC"), ("failures-desc", "failed_commands DESC")):
    _sorted_sessions(_sort, _order)


@query("agg_12_file_suggestions", bind.with_events(r"""
WITH f AS (SELECT session_id, line, unnest([file_a, file_b]) AS file FROM ev WHERE layer = 'main'),
d AS (SELECT session_id, line, regexp_replace(replace(file, chr(92), '/'), '^\./', '') AS file FROM f WHERE file <> ''),
e AS (SELECT DISTINCT session_id, line, lower(file) AS key, file FROM d)
SELECT arg_min(file, (session_id, line)) AS file, count(*) AS event_count FROM e GROUP BY key ORDER BY 2 DESC, 1 LIMIT 80"""))
def _(spark, root):
    return search.file_suggestions(bind.events(spark, root))


@query("prj_14_filter_files", bind.with_events("""
SELECT event_id, array_to_string(list_distinct_ordered, '|') AS filter_files FROM (
  SELECT event_id, list_filter(['sessions/' || session_id || '.jsonl', file_a, file_b], lambda x: x <> '') AS list_distinct_ordered FROM ev)"""))
def _(spark, root):
    ev = search.with_filter_files(bind.events(spark, root), F.concat(F.lit("sessions/"), "session_id", F.lit(".jsonl")))
    return ev.select("event_id", F.array_join("filter_files", "|").alias("filter_files"))


@query("prj_37_path_identity_key", r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?:/', '') AS path FROM pages),
n AS (SELECT page_id, '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM p)
SELECT page_id, CASE WHEN path = '/thther.example.org' THEN '' WHEN starts_with(path, '/thther.example.org/')
  THEN substr(path, length('/thther.example.org/') + 1) ELSE path END AS key FROM n""")
def _(spark, root):
    path = F.regexp_replace("url", "^https?:/", "")
    return table(spark, root, "pages").select("page_id", paths.identity_key(path, "/thther.example.org/").alias("key"))
