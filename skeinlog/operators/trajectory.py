"""Reading order of a session: lanes, tool groups, turn boundaries, density bins, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import classify
from skeinlog.operators import ordered
from skeinlog.session import materialize


def project(events: DataFrame) -> DataFrame:
    """Main events with their lane, reliable turn id and index."""
    c = F.col
    rows = events.select(
        "session_id", "line", "event_id", "tool_name", "status", "severity",
        classify.trajectory_lane(c("kind"), c("subtype"), c("role"), c("tool_name")).alias("lane"),
        classify.reliable_turn_id(c("turn_id")).alias("reliable_turn"))
    numbered = ordered.scan(
        rows, ["session_id"], "line", idx=ordered.RowNumber(),
        prev_lane=ordered.Lag(c("lane")), prev_turn=ordered.LastValue(c("reliable_turn"), inclusive=False))
    opens = c("reliable_turn").isNotNull() & ~c("reliable_turn").eqNullSafe(c("prev_turn"))
    return materialize(numbered.withColumn("idx", c("idx") - 1).withColumn("opens_turn", opens), "trajectory")


def turn_boundaries(projected: DataFrame) -> DataFrame:
    return projected.filter("opens_turn").select("session_id", F.col("reliable_turn").alias("turn_id"), F.col("idx").alias("sequence_index"))


def with_groups(projected: DataFrame) -> DataFrame:
    """Tool rows carry the id of the group they belong to, named after its first event."""
    tools = F.col("lane") == "tools"
    starts = tools & (F.col("opens_turn") | ~F.col("prev_lane").eqNullSafe(F.lit("tools")))
    marked = projected.withColumn("_start", F.when(starts, F.concat(F.lit("tools:"), F.col("event_id"))))
    grouped = ordered.scan(marked, ["session_id"], "line", group_id=ordered.LastValue(F.col("_start")))
    return grouped.withColumn("group_id", F.when(tools, F.col("group_id"))).drop("_start")


def tool_groups(grouped: DataFrame, state: Column | None = None) -> DataFrame:
    """One row per group. Names form a set bounded by the tool registry; member ids stay on the event rows."""
    name = F.col("tool_name")
    failed = classify.is_failure(F.col("status"), F.col("severity"))
    rank = classify.state_rank(state) if state is not None else F.lit(2)
    return (
        grouped.filter("group_id is not null").groupBy("session_id", "group_id").agg(
            F.count(F.lit(1)).alias("events"), F.count_if(failed).alias("failures"),
            F.min_by("event_id", "line").alias("first_event_id"), F.max_by("event_id", "line").alias("last_event_id"),
            F.array_join(F.sort_array(F.collect_set(F.when(name != "", name))), "|").alias("tool_names"),
            F.max(rank).alias("_rank"))
        .withColumn("display_state", classify.rank_state(F.col("_rank"))).drop("_rank")
    )


def narrative(grouped: DataFrame) -> DataFrame:
    """Items of the reading order: boundaries, single events, and one item per tool group."""
    c = F.col
    boundaries = grouped.filter("opens_turn").select(
        "session_id", "line", F.lit(0).alias("part"), F.lit("turn-boundary").alias("item"), c("reliable_turn").alias("ref"))
    singles = grouped.filter("lane <> 'tools'").select(
        "session_id", "line", F.lit(1).alias("part"),
        F.when(c("lane") == "other", "other").otherwise("narrative").alias("item"), c("event_id").alias("ref"))
    groups = grouped.filter("group_id = concat('tools:', event_id)").select(
        "session_id", "line", F.lit(1).alias("part"), F.lit("tool-group").alias("item"), c("group_id").alias("ref"))
    return boundaries.unionByName(singles).unionByName(groups)


def density(projected: DataFrame, width: int) -> DataFrame:
    """Event counts by lane in at most ``width`` bins of equal sequence length."""
    sizes = projected.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    bins = F.greatest(F.lit(1), F.least(F.col("n"), F.lit(width)))
    bin_of = F.least(bins - 1, F.floor((F.col("idx") + 0.5) / F.col("n") * bins))
    binned = projected.join(sizes, "session_id").withColumn("bin", bin_of)
    return binned.groupBy("session_id", "bin").agg(
        F.min("idx").alias("start_index"), F.max("idx").alias("end_index"), F.count(F.lit(1)).alias("events"),
        *[F.count_if(F.col("lane") == lane).alias(lane) for lane in ("input", "model", "tools", "other")])


def nearest_event(projected: DataFrame, fraction: float) -> DataFrame:
    """Event closest to a fraction of the sequence, the earlier one of two equally close."""
    clamped = min(1.0, max(0.0, fraction))
    sizes = projected.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    distance = F.abs(F.col("idx") - (F.lit(clamped) * F.col("n") - 0.5))
    return (
        projected.join(sizes, "session_id").groupBy("session_id")
        .agg(F.min_by(F.struct("event_id", "idx"), F.struct(distance, F.col("idx"))).alias("_e"))
        .select("session_id", "_e.event_id", "_e.idx")
    )


def category_predicates(hit: Column) -> dict[str, Column]:
    c = F.col
    plan = classify.plan_category(c("kind"), c("subtype"), c("tool_name"))
    kind, status = c("kind"), c("status")
    return {
        "search_hits": hit,
        "user_messages": kind == "user_message",
        "assistant_messages": kind == "assistant_message",
        "update_plan": plan == "update",
        "plans": plan != "",
        "failed_commands": (kind == "command") & (status == "failed"),
        "commands": kind == "command",
        "patch_applied": (kind == "patch") & (status == "success"),
        "patch_failed": (kind == "patch") & (status == "failed"),
        "patches": kind == "patch",
        "errors_warnings": (c("severity") != "normal") | (status == "failed")
        | kind.isin("error", "abort", "rollback", "compaction"),
        "mcp_calls": (kind == "mcp_call") | F.startswith(c("tool_name"), F.lit("mcp__")),
        "web_searches": kind == "web_search",
    }


def navigation(events: DataFrame, hit: Column | None = None) -> DataFrame:
    """Events by reading category with the previous and next member of the category."""
    hit = F.lit(False) if hit is None else hit
    names = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in category_predicates(hit).items()]))
    members = events.select("session_id", "line", "event_id", F.explode(names).alias("category"))
    return ordered.scan(
        members, ["session_id", "category"], "line",
        previous_event_id=ordered.Lag(F.col("event_id")), next_event_id=ordered.Lead(F.col("event_id")))
