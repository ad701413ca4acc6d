"""Event filters, phrase search, timelines, session lists and file queries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import paths, text
from skeinlog.operators import ordered


# The kind of a scripted operation, and the name by which those without a declared request are asked for.
SCRIPTED, SCRIPT_ONLY = "code_mode_operation", "code_mode_script_operation"


@dataclass(frozen=True)
class Filters:
    layer: str = "main"
    kind: str = ""
    status: str = ""
    tool: str = ""
    file: str = ""
    q: str = ""
    date_from: str = ""
    date_to: str = ""
    request: str = ""
    sort: str = "updated-desc"


def has_active_expression(f: Filters) -> bool:
    """True when the filter switches a session list to match-annotated results (tool and dates do not)."""
    return any(v.strip() for v in (f.q, f.file, f.kind, f.status, f.request))


def structural(f: Filters, known_requests: list[str] | None = None) -> Column:
    """Every filter but the phrase and the dates; cheap comparisons come first."""
    cond = F.lit(True)
    if f.layer:
        cond = cond & (F.col("layer") == f.layer)
    scripted = (F.col("layer") == "main") & (F.col("kind") == SCRIPTED)
    if f.kind == SCRIPT_ONLY:
        cond = cond & scripted & (F.coalesce(F.size("declared_requests"), F.lit(0)) <= 0)
    elif f.kind:
        cond = cond & ((F.col("kind") == f.kind) | (F.col("subtype") == f.kind))
    if f.status:
        cond = cond & (F.col("status") == f.status)
    if f.tool:
        cond = cond & F.contains(F.lower("tool_name"), F.lit(f.tool.lower()))
    if f.file:
        needle = f.file.replace("\\", "/").lower()
        cond = cond & F.exists("filter_files", lambda p: F.contains(paths.search_key(p), F.lit(needle)))
    if f.request:
        # A request name outside the registry matches nothing.
        cond = cond & scripted & (F.array_contains("declared_requests", f.request)
                       if known_requests is None or f.request in known_requests else F.lit(False))
    return cond


def with_filter_files(events: DataFrame, source_file: Column | None = None) -> DataFrame:
    parts = F.concat(F.array(source_file), "touched_files") if source_file is not None else F.col("touched_files")
    return events.withColumn("filter_files", F.array_distinct(F.filter(parts, lambda p: p != "")))


def in_date_range(f: Filters) -> Column:
    activity = text.first_non_empty(F.col("updated_at"), F.col("started_at"))
    cond = F.lit(True)
    if f.date_from:
        cond = cond & (activity >= f"{f.date_from}T00:00:00.000Z")
    if f.date_to:
        cond = cond & (activity <= f"{f.date_to}T23:59:59.999Z")
    return cond


def annotated(events: DataFrame, f: Filters) -> DataFrame:
    """Structural matches; text is reduced to hit, count and snippet before any shuffle, and only hits have the latter two."""
    preview, body = F.col("preview"), F.col("search_text")
    rows = events.filter(structural(f)).withColumn("hit", text.event_hit(preview, body, f.q) if f.q else F.lit(True))
    shown = text.event_snippet(preview, body, f.q) if f.q else preview
    count = text.event_match_count(preview, body, f.q) if f.q else F.lit(0).cast("bigint")
    return rows.select("session_id", "line", "event_id", "ts_text", "hit", F.when(F.col("hit"), shown).otherwise("").alias("snippet"),
                       F.when(F.col("hit"), count).otherwise(F.lit(0).cast("bigint")).alias("match_count"))


def project_search(events: DataFrame, f: Filters, sessions: DataFrame | None = None) -> DataFrame:
    """One row per session with a match: number of matching events and the latest of them.

    Only hits take their text along; the latest one of each session gives the one snippet that is cut.
    """
    if sessions is not None and (f.date_from or f.date_to):
        events = events.join(sessions.filter(in_date_range(f)).select("session_id"), "session_id", "left_semi")
    preview, body = F.col("preview"), F.col("search_text")
    rows = events.filter(structural(f)).withColumn("hit", text.event_hit(preview, body, f.q) if f.q else F.lit(True))
    said = F.when(F.col("hit"), F.struct("event_id", "ts_text", "preview", *(["search_text"] if f.q else [])))
    placed = ordered.scan(rows.select("session_id", "line", said.alias("_said")), ["session_id"], "line", _at=ordered.RowNumber())
    hits = placed.filter("_said is not null")
    latest = hits.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.max_by(F.struct("_said", "_at"), F.struct("_said.ts_text", "_at")).alias("_last"))
    shown = text.event_snippet(F.col("_last._said.preview"), F.col("_last._said.search_text"), f.q) if f.q else F.col("_last._said.preview")
    return latest.select("session_id", "event_count", F.col("_last._said.event_id").alias("latest_event_id"), F.col("_last._said.ts_text").alias("latest_ts"),
                         shown.alias("latest_snippet"), (F.col("_last._at") - 1).alias("latest_timeline_index"))


def order_search(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("latest_ts"), F.desc("latest_timeline_index"), "session_id")


def search_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"),
                       F.coalesce(F.sum("event_count"), F.lit(0)).alias("matching_event_total"))


def timeline(events: DataFrame, f: Filters) -> DataFrame:
    """Structural rows of every session, annotated with hits; the phrase removes nothing."""
    numbered = ordered.scan(annotated(events, f), ["session_id"], "line", timeline_index=ordered.RowNumber())
    return numbered.withColumn("timeline_index", F.col("timeline_index") - 1)


def timeline_totals(rows: DataFrame) -> DataFrame:
    """Totals of annotated rows; they need no place in the timeline."""
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"), F.sum("match_count").alias("search_match_count"),
        F.count_if("hit").alias("search_event_count"))


def pagination(offset: int | None = None, limit: int | None = None, default: int = 150, most: int = 500) -> tuple[int, int]:
    offset = 0 if offset is None else offset
    limit = default if limit is None else limit
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative and limit must be positive")
    return offset, min(most, limit)


def timeline_page(rows: DataFrame, offset: int | None = None, limit: int | None = None) -> DataFrame:
    """A page read from the stored index: no sort and no skipped rows."""
    offset, limit = pagination(offset, limit)
    return rows.filter((F.col("timeline_index") >= offset) & (F.col("timeline_index") < offset + limit))


def sessions_with_match(sessions: DataFrame, events: DataFrame, f: Filters) -> DataFrame:
    """Unannotated session list: dates, then existence of one structural match."""
    kept = sessions.filter(in_date_range(f))
    if f.kind or f.status or f.tool or f.file or f.request:
        found = events.filter(structural(f)).select("session_id").distinct()
        kept = kept.join(found, "session_id", "left_semi")
    return kept


def sort_sessions(sessions: DataFrame, sort: str = "updated-desc") -> DataFrame:
    keys = {
        "started-asc": [F.asc("started_at")],
        "events-desc": [F.desc("event_total")],
        "failures-desc": [F.desc("failed_commands")],
    }.get(sort, [F.desc(text.first_non_empty(F.col("updated_at"), F.col("started_at")))])
    return sessions.orderBy(*keys, "session_id")


def file_suggestions(events: DataFrame, layer: str = "main", limit: int = 80, root: str = "") -> DataFrame:
    """Files by number of events touching them; one event counts a file once whatever its spelling."""
    exploded = (
        events.filter(F.col("layer") == layer)
        .select("session_id", "line", F.explode("touched_files").alias("raw_file"))
        .withColumn("file", paths.display_path(F.col("raw_file"), root))
        .withColumn("key", paths.search_key(F.col("file")))
        .filter("key <> ''")
    )
    first = F.struct("session_id", "line")
    per_event = exploded.groupBy("key", "session_id", "line").agg(F.min("file").alias("file"))
    counted = per_event.groupBy("key").agg(F.count(F.lit(1)).alias("event_count"), F.min_by("file", first).alias("file"))
    return counted.orderBy(F.desc("event_count"), "file").limit(limit).select("file", "event_count")


def file_activity(events: DataFrame, file: str, root: str = "") -> DataFrame:
    """Main events whose recorded paths include exactly this path."""
    key = paths.identity_key(F.lit(file), root)
    return (
        events.filter((F.col("layer") == "main") & F.exists("touched_files", lambda p: paths.identity_key(p, root) == key))
        .select("session_id", "line", "event_id", "kind", "status", "ts_text", "tool_name",
                text.collapse(F.col("preview")).substr(1, 120).alias("summary"),
                F.when(F.col("kind") == "patch", "patch_record").otherwise("recorded_path").alias("association"))
    )


def event_by_id(events: DataFrame, session_id: str, event_id: str, layer: str = "main") -> DataFrame:
    return events.filter((F.col("session_id") == session_id) & (F.col("layer") == layer) & (F.col("event_id") == event_id))


def without_phrase(f: Filters) -> Filters:
    return replace(f, q="")
