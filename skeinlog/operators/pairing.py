"""Joins of the transcript model. A pairing holds only when both sides are unique.

Uniqueness is an aggregate, not a window: calls and results of a key are reduced to one row with their
counts before anything is joined, so a key that half the table shares costs one partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.operators import ordered, sweeps
from skeinlog.session import materialize


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once; rows with a null key have no identity and are left out."""
    others = [c for c in df.columns if c not in keys]
    named = df.filter(" and ".join(f"{k} is not null" for k in keys))
    one = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*others)).alias("_r"))
    return one.filter("_n = 1").select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def unique_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join where each side contributes only keys it holds once."""
    return unique_rows(left, keys).join(unique_rows(right, keys), keys, how)


def call_pairs(rows: DataFrame) -> DataFrame:
    """One row per call id: the call, its result and why they do not pair.

    ``rows``: session_id, call_id, line, is_call, is_result, event_id. Rows without a call id are ignored.
    """
    call, result = F.when(F.col("is_call"), F.col("line")), F.when(F.col("is_result"), F.col("line"))
    grouped = rows.filter("call_id is not null and (is_call or is_result)").groupBy("session_id", "call_id").agg(
        F.count(call).alias("calls"), F.count(result).alias("results"),
        F.min(call).alias("call_line"), F.min(result).alias("result_line"),
        F.min_by("event_id", call).alias("call_event_id"), F.min_by("event_id", result).alias("result_event_id"))
    issue = (F.when(F.col("calls") == 0, "missing_call")
             .when((F.col("calls") != 1) | (F.col("results") > 1), "ambiguous_call_id")
             .when(F.col("results") == 0, "missing_output")
             .when(F.col("result_line") <= F.col("call_line"), "output_before_call").otherwise(""))
    return grouped.withColumn("issue", issue)


def matched_pairs(rows: DataFrame) -> DataFrame:
    return call_pairs(rows).filter("issue = ''").select(
        "session_id", "call_id", "call_line", "result_line", "call_event_id", "result_event_id")


def calls_with_results(rows: DataFrame) -> DataFrame:
    """Every call with its result where the pair is unambiguous; the other calls stay incomplete."""
    pairs = matched_pairs(rows).select("session_id", F.col("call_line").alias("line"), "result_event_id")
    return (
        rows.filter("is_call").select("session_id", "line", "event_id", "call_id")
        .join(pairs, ["session_id", "line"], "left")
        .withColumn("complete", F.col("result_event_id").isNotNull())
    )


def calls_and_results(rows: DataFrame) -> DataFrame:
    """Pairs, plus unmatched calls and unmatched results as events of their own."""
    pairs = matched_pairs(rows)
    used = pairs.select("session_id", F.col("call_line").alias("line")).unionByName(
        pairs.select("session_id", F.col("result_line").alias("line")))
    lone = rows.filter("is_call or is_result").join(used, ["session_id", "line"], "left_anti").select(
        "session_id", F.when(F.col("is_call"), F.col("event_id")).alias("call_event_id"),
        F.when(F.col("is_result"), F.col("event_id")).alias("result_event_id"))
    return pairs.select("session_id", "call_event_id", "result_event_id").unionByName(lone)


def call_groups(rows: DataFrame) -> DataFrame:
    """All rows of a call id reduced to one tool event. Flags and picks only; members are never collected."""
    return rows.filter("call_id is not null").groupBy("session_id", "call_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("line").alias("first_line"), F.max("line").alias("last_line"),
        F.min_by("event_id", F.when(F.col("is_call"), F.col("line"))).alias("request_event_id"),
        F.max_by("event_id", F.when(F.col("is_result"), F.col("line"))).alias("output_event_id"),
        F.bool_or(F.col("status") == "declined").alias("declined"), F.bool_or(F.col("status") == "failed").alias("failed"),
        F.max("exit_code").alias("exit_code"), F.max("duration_ms").alias("duration_ms"))


def adjacent_pairs(rows: DataFrame, columns: list[str], matches) -> DataFrame:
    """Pairs of neighbouring rows that match, each row in at most one pair, earliest pair first.

    In a run of consecutive matches only every other one is taken, counted from the start of the run.
    """
    near = ordered.scan(rows, ["session_id"], "line", _pos=ordered.RowNumber(), _next=ordered.Lead(F.struct("line", *columns)))
    near = materialize(near.withColumn("_m", F.coalesce(matches(F.col("_next")), F.lit(False))), "neighbours")
    gaps = ordered.scan(near, ["session_id"], "line", _gap=ordered.LastValue(F.when(~F.col("_m"), F.col("_pos"))))
    since = F.col("_pos") - F.coalesce("_gap", F.lit(0))
    return gaps.filter(F.col("_m") & (since % 2 == 1)).select(
        "session_id", "line", *columns, F.col("_next.line").alias("next_line"),
        *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def web_search_pairs(rows: DataFrame, tolerance_ms: int = 1000) -> DataFrame:
    """Search call and search end in neighbouring rows: same action, or same turn within the tolerance."""
    def matches(nxt: Column) -> Column:
        kinds = (F.col("part") != nxt["part"]) & F.col("part").isin("call", "end") & nxt["part"].isin("call", "end")
        same_action = (F.col("action") != "") & (F.col("action") == nxt["action"])
        close = (F.col("turn_id") != "") & (F.col("turn_id") == nxt["turn_id"]) & (F.abs(F.col("ms") - nxt["ms"]) <= tolerance_ms)
        return kinds & (same_action | close)
    return adjacent_pairs(rows, ["event_id", "part", "action", "turn_id", "ms"], matches)


def mirrored_messages(rows: DataFrame) -> DataFrame:
    """The two recorded copies of one message, next to each other; the second copy is consumed."""
    def matches(nxt: Column) -> Column:
        return ((F.col("envelope") != nxt["envelope"]) & (F.col("role") == nxt["role"])
                & (F.trim("text") == F.trim(nxt["text"])) & F.col("digest").eqNullSafe(nxt["digest"]))
    return adjacent_pairs(rows, ["event_id", "envelope", "role", "text", "digest"], matches)


def reasoning_mirrors(rows: DataFrame) -> DataFrame:
    """Neighbouring reasoning rows where one text holds the other."""
    def matches(nxt: Column) -> Column:
        a, b = F.trim("text"), F.trim(nxt["text"])
        return (F.col("envelope") != nxt["envelope"]) & (a != "") & (b != "") & (F.contains(b, a) | F.contains(a, b))
    return adjacent_pairs(rows, ["event_id", "envelope", "text"], matches)


def response_mirrors(items: DataFrame, owners: DataFrame) -> DataFrame:
    """Typed item and response row of one response within a turn epoch, both unique, bodies equal."""
    keys = ["session_id", "response_id", "epoch"]
    i = unique_rows(items, keys).select(*keys, F.col("event_id").alias("item_event_id"), F.col("body").alias("item_body"))
    o = unique_rows(owners, keys).select(*keys, F.col("event_id").alias("owner_event_id"), "body")
    return i.join(o, keys).filter("item_body = body").drop("item_body", "body")


def event_refs(events: DataFrame) -> DataFrame:
    """Bridge from logical events to the raw rows they were read from."""
    return events.select("session_id", "event_id", "layer", F.posexplode("raw_refs").alias("pos", "raw_id"))


def owners_of_raw(raw: DataFrame, refs: DataFrame) -> DataFrame:
    """Raw rows with the layer of their owning event: its layer when there is one owner, '' otherwise."""
    owned = refs.groupBy("raw_id").agg(F.count_distinct("event_id").alias("owners"), F.min("event_id").alias("owner"), F.min("layer").alias("layer"))
    return raw.join(owned, "raw_id", "left").select(
        "raw_id", F.coalesce("owners", F.lit(0)).alias("owners"),
        F.when(F.col("owners") == 1, F.col("owner")).alias("owner_event_id"),
        F.when(F.col("owners") == 1, F.col("layer")).otherwise("").alias("owner_layer"))


def without_consumed(rows: DataFrame, *consumed: DataFrame) -> DataFrame:
    taken = consumed[0].select("raw_id")
    for more in consumed[1:]:
        taken = taken.unionByName(more.select("raw_id"))
    return rows.join(taken.distinct(), "raw_id", "left_anti")


def supplementary_rows(calls: DataFrame, by_uuid: DataFrame, by_tool_use: DataFrame, by_parent: DataFrame) -> DataFrame:
    """Side rows that belong to a call, found three ways; a row found twice counts once."""
    parts = [
        calls.join(by_uuid, ["session_id", "uuid"]), calls.join(by_tool_use, ["session_id", "call_id"]),
        calls.join(by_parent, F.expr("uuid = parent_uuid") & (calls["session_id"] == by_parent["session_id"])).drop(by_parent["session_id"]),
    ]
    picked = [p.select("event_id", "raw_id") for p in parts]
    return picked[0].unionByName(picked[1]).unionByName(picked[2]).distinct()


def nearest_span(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Point -> span of the same signature that holds it or ends just before it: the closest, then the latest.

    A span serves one point and a point one span. Most points are settled without a pair: the span that started
    last still holds the point, or no span does and the one that ended on the line before is looked up. Only
    points under an older span that a later one no longer covers are compared with the spans of their bucket.
    """
    keys = ["session_id", "signature"]
    at = points.select(*keys, "line").distinct()
    started = spans.groupBy(*keys, F.col("start").alias("line")).agg(F.max(F.struct("end", "span_id")).alias("top"))
    swept = _open_spans(spans, at, keys)
    stops = started.select(*keys, "line", F.struct(F.col("line").alias("start"), "top.end", "top.span_id").alias("_s"), F.lit(0).alias("part"))
    asked = at.select(*keys, "line", F.lit(None).cast(stops.schema["_s"].dataType).alias("_s"), F.lit(1).alias("part"))
    edges = stops.unionByName(asked).withColumn("at", F.col("line") * 2 + F.col("part"))
    latest = ordered.scan(edges, keys, "at", last=ordered.LastValue(F.col("_s"))).filter("part = 1").select(*keys, "line", "last")
    placed = materialize(latest.join(swept.select(*keys, "line", "open"), [*keys, "line"]), "nearest")
    held = placed.filter("last.end >= line").select(*keys, "line", "last.span_id", "last.start", F.lit(0).alias("distance"))

    ended = spans.groupBy(*keys, (F.col("end") + 1).alias("line")).agg(F.max(F.struct("start", "span_id")).alias("_e"))
    after = placed.filter("open = 0").join(ended, [*keys, "line"]).select(*keys, "line", "_e.span_id", "_e.start", F.lit(1).alias("distance"))

    cut = spans.select(*keys, "span_id", "start", "end", F.explode(F.sequence(
        F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_bucket"))
    met = placed.filter("open > 0 and last.end < line").withColumn("_bucket", F.floor(F.col("line") / width)).join(cut, [*keys, "_bucket"]).filter(
        (F.col("line") >= F.col("start")) & (F.col("line") <= F.col("end")))
    older = met.groupBy(*keys, "line").agg(F.max(F.struct("start", "end", "span_id")).alias("_o")).select(
        *keys, "line", "_o.span_id", "_o.start", F.lit(0).alias("distance"))
    chosen = held.unionByName(after).unionByName(older)
    return chosen.groupBy("session_id", "span_id").agg(F.min_by("line", F.struct("distance", "line")).alias("line"))


def _open_spans(spans: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Spans open at each line of a group: their number, and the sums of their bounds.

    A sweep over span edges, so neither overlapping spans nor many points make pairs. Where one span is open,
    the sums are its bounds.
    """
    zero = F.lit(0).cast("bigint")
    opened = spans.groupBy(*keys, F.col("start").alias("line")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("start").alias("s"), F.sum("end").alias("e")).withColumn("part", F.lit(0))
    asked = points.select(*keys, "line").distinct().withColumns({"n": zero, "s": zero, "e": zero, "part": F.lit(1)})
    closed = spans.groupBy(*keys, F.col("end").alias("line")).agg(
        (-F.count(F.lit(1))).alias("n"), (-F.sum("start")).alias("s"), (-F.sum("end")).alias("e")).withColumn("part", F.lit(2))
    edges = materialize(opened.unionByName(asked).unionByName(closed).withColumn("at", F.col("line") * 3 + F.col("part")), "edges")
    swept = ordered.scan(edges, keys, "at", open=ordered.RunningSum(F.col("n")), start=ordered.RunningSum(F.col("s")), end=ordered.RunningSum(F.col("e")))
    return swept.filter("part = 1").select(*keys, "line", "open", "start", "end")


def containing_span(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Events lying inside exactly one span of their file. ``events``: min_line, max_line."""
    return sweeps.sole_container(events, spans, ["session_id", "file"])


def line_ranges(lines: DataFrame) -> DataFrame:
    """Consecutive lines of one owner in a file as ranges."""
    keyed = ordered.scan(lines, ["file", "session_id"], "line", _rn=ordered.RowNumber())
    return keyed.groupBy("file", "session_id", (F.col("line") - F.col("_rn")).alias("_island")).agg(
        F.min("line").alias("start"), F.max("line").alias("end")).drop("_island")


def range_owner(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points of files with ``open``, how many ranges cover them, and ``owner`` where exactly one does."""
    return sweeps.sole_owner(points, ranges, ["file"])


def review_parents(reviews: DataFrame, markers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Review session -> the one primary session whose review marker fits it, among those of equal ``keys``.

    Fits when the marker opens within 5 s of the start, or encloses the start (5 s / 30 s slack) and closes within 120 s
    of the last update. Either is a range of times, the latter with a bound on when the marker opened; one parent fits
    where the least and the greatest fitting parent are the same. No review meets a marker.
    """
    keys = keys or []
    reviews = reviews.filter("started_ms is not null").withColumn("_u", F.coalesce("updated_ms", "started_ms"))
    markers = markers.filter("entered_ms is not null")
    s, near, late, close = F.col("started_ms"), 5_000, 30_000, 120_000
    opens = sweeps.extremes_near(
        markers.select(*keys, F.col("entered_ms").alias("at"), F.col("parent_id").alias("value")),
        reviews.select(*keys, F.col("review_id").alias("ask_id"), (s - near).alias("low")), keys, 2 * near)
    closes = sweeps.extremes(
        markers.filter("exited_ms is not null").select(*keys, F.col("exited_ms").alias("at"), F.col("entered_ms").alias("by"), F.col("parent_id").alias("value")),
        reviews.select(*keys, F.col("review_id").alias("ask_id"), F.greatest(s - late, F.col("_u") - close).alias("low"), (F.col("_u") + close).alias("high"), (s + near).alias("upto")), keys, 2 * close)
    both = opens.unionByName(closes).groupBy("ask_id").agg(F.min("least").alias("parent_id"), F.max("greatest").alias("_other"))
    return both.filter("parent_id = _other").select(F.col("ask_id").alias("review_id"), "parent_id")


def review_markers(rows: DataFrame) -> DataFrame:
    """Open/close marker pairs of a session: an exit closes the marker opened last, or stands alone."""
    before = ordered.scan(rows, ["session_id"], "line", _prev=ordered.Lag(F.col("phase")))
    opens = (F.col("phase") == "entered") | ~F.col("_prev").eqNullSafe(F.lit("entered"))
    stored = materialize(before.withColumn("_new", opens.cast("bigint")), "markers")
    marked = ordered.scan(stored, ["session_id"], "line", marker=ordered.RunningSum(F.col("_new")))
    return marked.groupBy("session_id", "marker").agg(
        F.max(F.when(F.col("phase") == "entered", F.col("ms"))).alias("entered_ms"),
        F.max(F.when(F.col("phase") == "exited", F.col("ms"))).alias("exited_ms"))


def launch_notifications(launches: DataFrame, notifications: DataFrame) -> DataFrame:
    """Background launches with the notifications that report on them.

    Keys are task id and call id; a task launched twice is ambiguous. Notifications precede nothing: only
    later ones count. Equal texts collapse, the last distinct one is terminal.
    """
    sole = unique_rows(launches.select("session_id", "task_id", "call_id", "kind", "launch_line"), ["session_id", "task_id"])
    met = notifications.join(sole, ["session_id", "task_id", "call_id"]).filter("line > launch_line")
    distinct = met.groupBy("session_id", "task_id", "call_id", "kind", "fingerprint").agg(
        F.min("line").alias("line"), F.min_by("status", "line").alias("status"), F.count(F.lit(1)).alias("copies"))
    summed = distinct.groupBy("session_id", "task_id", "call_id").agg(
        F.count(F.lit(1)).alias("notifications"), F.sum("copies").alias("copies"), F.max_by("status", "line").alias("terminal_status"))
    return launches.join(summed, ["session_id", "task_id", "call_id"], "left").select(
        "session_id", "task_id", "call_id", "kind", F.coalesce("notifications", F.lit(0)).alias("notifications"),
        F.coalesce("copies", F.lit(0)).alias("copies"), "terminal_status",
        F.when(F.col("terminal_status").isNotNull(), "terminal")
        .when(F.col("kind").isin("background_command", "background_mcp", "monitor"), "backgrounded").otherwise("async_launched").alias("phase"))


def prune_triples(results: DataFrame, prunes: DataFrame, replacements: DataFrame) -> DataFrame:
    """Original result, prune row and replacement at the next sequence number, each used once."""
    p = unique_rows(prunes.select("session_id", "original_seq", "prune_seq"), ["session_id", "original_seq"])
    r = replacements.select("session_id", (F.col("seq") - 1).alias("prune_seq"), F.col("call_id").alias("new_call_id"), F.col("envelope").alias("new_envelope"), F.col("seq").alias("replacement_seq"))
    o = results.select("session_id", F.col("seq").alias("original_seq"), "call_id", "envelope")
    return (
        p.join(unique_rows(o, ["session_id", "original_seq"]), ["session_id", "original_seq"])
        .join(unique_rows(r, ["session_id", "prune_seq"]), ["session_id", "prune_seq"])
        .filter("prune_seq > original_seq and call_id = new_call_id and envelope = new_envelope")
        .select("session_id", "original_seq", "prune_seq", "replacement_seq", "call_id")
    )


def approval_targets(approvals: DataFrame, direct: DataFrame, nested: DataFrame) -> DataFrame:
    """Approved call -> the single event that runs it, either directly or as a nested dispatch."""
    both = direct.select("session_id", "call_id", "event_id").unionByName(nested.select("session_id", "call_id", "event_id"))
    target = both.groupBy("session_id", "call_id").agg(F.min("event_id").alias("target_event_id"), F.max("event_id").alias("_o")).filter("target_event_id = _o").drop("_o")
    return approvals.join(target, ["session_id", "call_id"], "left")


def label_navigation(labels: DataFrame, sessions: DataFrame) -> DataFrame:
    """Agent label -> child session: resolved, missing, ambiguous, or unconfirmed when the relation is inferred.

    ``labels``: owner_id, label. ``sessions``: session_id, source_session_id, parent_id, inferred.
    """
    names = sessions.select("session_id", "parent_id", "inferred", F.explode(F.array_distinct(F.array("session_id", "source_session_id"))).alias("label"))
    found = names.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("session_id", "parent_id", "inferred")).alias("s"))
    child = (F.col("s.parent_id") == F.col("owner_id")) & ~F.col("s.inferred")
    status = (F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(child, "resolved").otherwise("unconfirmed"))
    return labels.join(found, "label", "left").select("owner_id", "label", status.alias("navigation"),
                                                      F.when(status == "resolved", F.col("s.session_id")).alias("target_id"))


def phase_events(phases: DataFrame, events: DataFrame) -> DataFrame:
    """Phase -> the event read from its call row when there is one such event, else ''."""
    owners = events.groupBy("raw_id").agg(F.min("event_id").alias("e"), F.max("event_id").alias("_o"))
    return phases.join(owners, "raw_id", "left").select(
        "operation_id", "raw_id", F.when(F.col("e") == F.col("_o"), F.col("e")).otherwise("").alias("event_id"))


def attach_activity(activity: DataFrame, calls: DataFrame, consumed: DataFrame) -> DataFrame:
    """Subagent activity rows attached to the coordination call they name, unless already used."""
    left = activity.join(consumed.select("raw_id").distinct(), "raw_id", "left_anti")
    return left.join(unique_rows(calls.select("session_id", "call_id", F.col("event_id").alias("owner_event_id")), ["session_id", "call_id"]),
                     ["session_id", "call_id"], "left").select("session_id", "raw_id", "call_id", "owner_event_id")
