"""Session rows: metadata folded from records, titles, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import classify, text
from skeinlog.operators import aggregates


def titles(messages: DataFrame, prefer_last: bool = False) -> DataFrame:
    """Title of each session: first (or last) user message that yields an informative line."""
    protocol = classify.protocol_text_class(text.trim(F.col("text")), F.lit("user")) != ""
    usable = messages.filter(F.col("kind") == "user_message").select(
        "session_id", "line", text.title_candidate(F.col("text"), protocol).alias("title")).filter("title <> ''")
    pick = F.max_by if prefer_last else F.min_by
    return usable.groupBy("session_id").agg(pick("title", "line").alias("title"))


def derived_title(kind: Column, nickname: Column, task: Column) -> Column:
    base = F.when(kind == "review", "Review").otherwise("Subagent")
    named = (F.coalesce(nickname, F.lit("")) != "") & (F.lower(nickname) != F.lower(base))
    label = F.when(named, F.concat_ws(" ", base, nickname)).otherwise(F.concat(base, F.lit(" session")))
    return text.truncate(F.concat(label, F.lit(": "), task), text.DERIVED_TITLE_LIMIT)


def apply_index(sessions: DataFrame, index: DataFrame) -> DataFrame:
    """Sidecar titles override, and a later sidecar time extends the session."""
    later = F.greatest("updated_at", F.coalesce("index_updated_at", F.lit("")))
    return (
        sessions.join(index, "session_id", "left")
        .withColumn("title", F.coalesce(F.nullif("index_title", F.lit("")), "title"))
        .withColumn("updated_at", later).drop("index_title", "index_updated_at")
    )


def last_index_entries(lines: DataFrame) -> DataFrame:
    """Last sidecar line per id."""
    return lines.groupBy("session_id").agg(
        F.max_by("title", "line").alias("index_title"), F.max_by("updated_at", "line").alias("index_updated_at"))


#: A session's list of failed commands, where one is shown, ends here; their number doesn't.
LISTED_FAILURES = 100


def summary_rows(events: DataFrame, parent: Column) -> DataFrame:
    """One row per session with totals, its five most used tools and its parent when that is known."""
    failed = F.count_if((F.col("layer") != "protocol") & (F.col("kind") == "command") & (F.col("status") == "failed"))
    totals = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("raw_event_count"), F.count_if(F.col("layer") == "protocol").alias("protocol_count"),
        failed.alias("failed_command_count"), F.least(F.lit(LISTED_FAILURES).cast("bigint"), failed).alias("failed_commands_listed"))
    top = aggregates.top_per_session(aggregates.tool_usage(events), "tool_name").groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "tool_name", "uses"))).alias("tools"))
    text_of = F.array_join(F.transform("tools", lambda t: F.concat(t["tool_name"], F.lit(":"), t["uses"].cast("string"))), ",")
    known = totals.select(F.col("session_id").alias("parent_session_id"))
    return (
        totals.join(top, "session_id", "left").withColumn("_parent", parent)
        .join(known, F.col("_parent") == F.col("parent_session_id"), "left")
        .select("session_id", "raw_event_count", "protocol_count", "failed_command_count", "failed_commands_listed",
                F.coalesce(text_of, F.lit("")).alias("top_tools"), F.coalesce("parent_session_id", F.lit("")).alias("parent_session_id"))
    )


def metadata(records: DataFrame) -> DataFrame:
    """Facts of a session folded from its records. Working folders form a set bounded by the distinct ones."""
    stamp = F.nullif(F.col("ts_text"), F.lit(""))
    return records.groupBy("session_id").agg(
        F.array_sort(F.collect_set(F.nullif("cwd", F.lit("")))).alias("cwd_set"),
        F.max_by("title", F.when(F.coalesce("title", F.lit("")) != "", F.col("line"))).alias("title"),
        F.min_by("version", F.when(F.coalesce("version", F.lit("")) != "", F.col("line"))).alias("version"),
        F.coalesce(F.min(stamp), F.lit("")).alias("started_at"), F.coalesce(F.max(stamp), F.lit("")).alias("updated_at"))
