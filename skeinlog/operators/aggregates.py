"""Per-session counters, rankings and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.functions import classify, vocabulary as V

# The counter names of a session summary.
COUNTERS = ["turns", "messages", "user_messages", "assistant_messages", "reasoning", "tool_calls", "failed_commands",
            "issue_events", "patches", "compactions", "aborts", "errors", "protocol", "plan_artifacts", "plan_events"]


def session_counts(events: DataFrame, family: str = "codex") -> DataFrame:
    kind, main = F.col("kind"), F.col("layer") != "protocol"
    failed = F.col("status") == "failed"
    plan = classify.plan_category(kind, F.col("subtype"), F.col("tool_name"))
    tool_call = kind.isin(V.TOOL_CALL_KINDS[family])
    if family == "codex":
        tool_call = tool_call | ((kind == "goal") & (F.col("tool_name") != ""))
    issue = main & (failed | (F.col("severity") != "normal"))
    if family == "deepseek":
        issue = issue | (~main & (failed | (F.col("severity") == "error")))

    def n(cond: Column) -> Column:
        return F.count_if(cond)

    return events.groupBy("session_id").agg(
        F.count_distinct(F.nullif(F.col("turn_id"), F.lit(""))).alias("turns"),
        n(main & kind.isin("user_message", "assistant_message")).alias("messages"),
        n(main & (kind == "user_message")).alias("user_messages"),
        n(main & (kind == "assistant_message")).alias("assistant_messages"),
        n(main & (kind == "reasoning")).alias("reasoning"),
        n(main & tool_call).alias("tool_calls"),
        n(main & (kind == "command") & failed).alias("failed_commands"),
        n(issue).alias("issue_events"),
        n(main & (kind == "patch")).alias("patches"),
        n(main & (kind == "compaction")).alias("compactions"),
        n(main & (kind == "abort")).alias("aborts"),
        n(main & (kind == "error")).alias("errors"),
        n(~main).alias("protocol"),
        n(main & (plan == "artifact")).alias("plan_artifacts"),
        n(main & (plan != "")).alias("plan_events"),
    )


def tool_usage(events: DataFrame) -> DataFrame:
    return (
        events.filter((F.col("layer") != "protocol") & (F.col("tool_name") != ""))
        .groupBy("session_id", "tool_name")
        .agg(F.count(F.lit(1)).alias("uses"), F.min("line").alias("first_line"))
    )


def patched_files(events: DataFrame) -> DataFrame:
    return (
        events.filter((F.col("layer") != "protocol") & (F.col("kind") == "patch"))
        .select("session_id", "line", F.explode("touched_files").alias("file"))
        .groupBy("session_id", "file")
        .agg(F.count(F.lit(1)).alias("uses"), F.min("line").alias("first_line"))
    )


def top_per_session(counted: DataFrame, name: str, k: int = 5, ties: str = "first_line") -> DataFrame:
    """Highest counts per session. The rank filter runs before the shuffle too, so k rows per task leave it."""
    by = Window.partitionBy("session_id").orderBy(F.desc("uses"), ties, name)
    return counted.withColumn("position", F.row_number().over(by)).filter(F.col("position") <= k)


def failed_commands(events: DataFrame, k: int = 100) -> DataFrame:
    commands = events.filter((F.col("layer") != "protocol") & (F.col("kind") == "command") & (F.col("status") == "failed"))
    by = Window.partitionBy("session_id").orderBy("line")
    return _command_rows(commands, by, k)


def slow_commands(events: DataFrame, k: int = 25) -> DataFrame:
    commands = events.filter((F.col("layer") != "protocol") & (F.col("kind") == "command"))
    by = Window.partitionBy("session_id").orderBy(F.desc("duration_ms"), "line")
    return _command_rows(commands, by, k)


def _command_rows(commands: DataFrame, by, k: int) -> DataFrame:
    return (
        commands.select("session_id", "line", "event_id", "ts_text", "preview", "status", "exit_code",
                        F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"))
        .withColumn("position", F.row_number().over(by)).filter(F.col("position") <= k)
    )


def stats_by_kind(events: DataFrame) -> DataFrame:
    """Timeline counts by kind and protocol counts by subtype; every layer but protocol is timeline."""
    protocol = F.col("layer") == "protocol"
    return events.groupBy(
        "session_id", F.when(protocol, "protocol").otherwise("timeline").alias("part"),
        F.when(protocol, F.col("subtype")).otherwise(F.col("kind")).alias("name"),
    ).agg(F.count(F.lit(1)).alias("events"))


def kind_catalogue(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Values of the kind facet per layer; scripted operations without a declared request count twice."""
    keys = keys or []
    protocol = F.col("layer") == "protocol"
    value = F.trim(F.when(protocol, F.coalesce(F.nullif("subtype", F.lit("")), "kind")).otherwise(F.col("kind")))
    rows = events.select(*keys, "layer", value.alias("value"))
    if "declared_requests" in events.columns:
        scripted = events.filter((F.col("layer") == "main") & (F.col("kind") == "code_mode_operation")
                                 & (F.size("declared_requests") == 0))
        rows = rows.unionByName(scripted.select(*keys, "layer", F.lit("code_mode_script_operation").alias("value")))
    return rows.filter("value <> ''").groupBy(*keys, "layer", "value").agg(F.count(F.lit(1)).alias("events"))


def merge_catalogues(per_session: DataFrame) -> DataFrame:
    return per_session.groupBy("layer", "value").agg(F.sum("events").alias("events"))


def request_catalogue(events: DataFrame) -> DataFrame:
    """Number of events that declare a tool; a tool named twice in one event counts once."""
    return (
        events.select(F.explode(F.array_distinct("declared_requests")).alias("request"))
        .groupBy("request").agg(F.count(F.lit(1)).alias("events"))
    )


def time_range(events: DataFrame, owned: Column | None = None) -> DataFrame:
    stamp = F.nullif(F.col("ts_text"), F.lit(""))
    stamp = F.when(owned, stamp) if owned is not None else stamp
    return events.groupBy("session_id").agg(
        F.coalesce(F.min(stamp), F.lit("")).alias("started_at"), F.coalesce(F.max(stamp), F.lit("")).alias("updated_at"))


def first_per_message(rows: DataFrame, value_columns: list[str]) -> DataFrame:
    """Usage is repeated on every block row of a response: keep the first row per message id."""
    first = [F.min_by(c, "line").alias(c) for c in value_columns]
    return rows.filter(F.col("message_id") != "").groupBy("session_id", "message_id").agg(*first)


def response_usage(rows: DataFrame) -> DataFrame:
    fields = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]
    first = first_per_message(rows, fields)
    total = {f: F.coalesce(F.col(f), F.lit(0)) for f in fields}
    return first.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("response_count"), *[F.sum(total[f]).alias(f) for f in fields],
        F.max(total["input_tokens"]).alias("max_observed"))


def representative(rows: DataFrame, keys: list[str], lifecycle: DataFrame, columns: list[str]) -> DataFrame:
    """Row of the furthest lifecycle phase per key, the latest one among equals."""
    ranked = rows.join(F.broadcast(lifecycle), rows["payload_type"] == lifecycle["wire_type"])
    pick = F.max_by(F.struct(*columns, "phase", "family"), F.struct("rank", "line"))
    return ranked.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def max_observed(events: DataFrame, warning: Column) -> DataFrame:
    """Most input tokens of a session at its usage warnings; null for a session without one."""
    return events.groupBy("session_id").agg(F.max(F.when(warning, F.col("input_tokens"))).alias("max_observed"))


def project_catalogue(sessions: DataFrame) -> DataFrame:
    """Sessions, bytes and last update of every working folder; a session counts once for a folder, however spelt.

    ``sessions``: session_id, cwds, bytes, updated_at.
    """
    folder = F.regexp_replace(F.regexp_replace(F.trim("cwd"), r"\\+", "/"), "(?<=.)/+$", "")
    spelt = sessions.select("session_id", "bytes", "updated_at", F.explode("cwds").alias("cwd")).withColumn("cwd", folder).filter("cwd <> ''")
    once = spelt.groupBy("session_id", "cwd").agg(F.max("bytes").alias("bytes"), F.max("updated_at").alias("updated_at"))
    return once.groupBy("cwd").agg(F.count(F.lit(1)).alias("sessions"), F.sum("bytes").alias("bytes"), F.max("updated_at").alias("updated_at"))


def item_status_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("items"))
