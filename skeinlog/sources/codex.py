"""Rollout transcripts with an envelope of type and payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import numbers, records as R, text
from skeinlog.functions.search_json import full_search_text
from skeinlog.session import materialize


# Paths of the text fields of a record; each is read once, by name, before anything is derived.
PATHS = {
    "record_type": "$.type", "role": "$.payload.role", "turn_id": "$.payload.turn_id", "call_id": "$.payload.call_id", "callId": "$.payload.callId",
    "name": "$.payload.name", "tool_name": "$.payload.tool_name", "tool": "$.payload.tool", "status": "$.payload.status",
    "message": "$.payload.message", "body": "$.payload.text", "ts": "$.timestamp", **R.TYPED_PATHS,
}


def to_raw(parsed: DataFrame) -> DataFrame:
    """Raw rows of the readable lines. ``parsed``: session_id, file, line, text, record."""
    v, p = F.col("record"), "$.payload"
    read = parsed.filter("record is not null").withColumns({f"_{name}": R.text_at(v, path) for name, path in PATHS.items()})
    r = {name: F.col(f"_{name}") for name in PATHS}

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(r[n], F.lit("")) for n in names], F.lit(""))
    typed = R.typed_item(r, F.col("session_id"))
    base = read.select(
        "session_id", F.concat("session_id", F.lit(":raw:"), F.col("line").cast("string")).alias("raw_id"), "file", "line", "text", "record",
        numbers.iso_text(r["ts"]).alias("ts_text"), r["record_type"].alias("record_type"),
        F.coalesce(typed["payload_type"], r["payload_type"]).alias("payload_type"), r["role"].alias("role"), r["turn_id"].alias("turn_id"),
        F.coalesce(typed["call_id"], first("call_id", "callId")).alias("call_id"),
        F.coalesce(typed["tool_name"], first("name", "tool_name", "tool")).alias("tool_name"),
        r["status"].alias("status"), first("message", "body").alias("_said"), R.get(v, f"{p}.exit_code", "bigint").alias("exit_code"),
        numbers.duration_ms(R.get(v, f"{p}.duration.secs", "double"), R.get(v, f"{p}.duration.nanos", "double")).alias("duration_ms"),
        F.coalesce(F.array_join(R.get(v, f"{p}.command", "array<string>"), " "), R.get(v, f"{p}.command"), F.lit("")).alias("command_text"),
        F.coalesce(F.map_keys(R.get(v, f"{p}.changes", "map<string,variant>")), F.array().cast("array<string>")).alias("touched_files"))
    message = F.when(F.col("payload_type") == "message", R.content_text(F.col("record"), f"{p}.content")).when(
        F.col("payload_type").isin("user_message", "agent_message"), F.col("_said")).otherwise("")
    named = F.concat_ws(" ", F.nullif("tool_name", F.lit("")), R.get(F.col("record"), f"{p}.arguments"))
    preview = (F.when(F.col("message_text") != "", F.col("message_text")).when(F.col("payload_type") == "function_call", named)
               .when(F.col("command_text") != "", F.col("command_text")).otherwise(F.coalesce(F.nullif("payload_type", F.lit("")), "record_type")))
    return base.withColumn("message_text", message).withColumn("preview", text.truncate(preview)).drop("_said")


def with_search_text(raw: DataFrame) -> DataFrame:
    """Full search text. Messages have theirs in the JVM; only the other payloads are walked.

    The walk reads the line itself, since a VARIANT does not keep the order of keys.
    """
    walked = F.when(F.col("message_text") == "", F.get_json_object("text", "$.payload"))
    return raw.withColumn("search_text", F.when(F.col("message_text") != "", F.col("message_text")).otherwise(full_search_text(walked)))


def to_logical(raw: DataFrame, tools: DataFrame) -> DataFrame:
    """Conversation, tool and protocol events. Rows of one call become one event; every other row its own.

    The facts of the rows are written once, so that a record is not parsed again for either kind of row.
    """
    from skeinlog.functions.classify import call_severity, call_status, protocol_text_class
    raw = materialize(raw.select("session_id", "line", "ts_text", "call_id", "tool_name", "payload_type", "role", "status", "exit_code", "message_text", "preview"), "raw-facts")
    calls = raw.filter("call_id <> ''").groupBy("session_id", "call_id").agg(
        F.min("line").alias("line"), F.min_by("ts_text", "line").alias("ts_text"), F.min_by("preview", "line").alias("preview"),
        F.max_by("tool_name", F.when(F.col("tool_name") != "", -F.col("line"))).alias("tool_name"), F.max("exit_code").alias("exit_code"),
        F.bool_or(F.col("status") == "declined").alias("declined"), F.bool_or(F.col("status") == "failed").alias("failed"),
        F.bool_or(F.col("payload_type").isin("function_call_output", "custom_tool_call_output")).alias("answered"))
    state = call_status(F.col("declined"), F.col("failed"), F.col("exit_code"), F.col("answered"))
    tool_events = calls.join(F.broadcast(tools.select("tool_name", "ordinary_kind")), "tool_name", "left").select(
        "session_id", "line", "ts_text", F.lit("main").alias("layer"), F.coalesce("ordinary_kind", F.lit("other_tool_call")).alias("kind"),
        F.coalesce("tool_name", F.lit("")).alias("tool_name"), state.alias("status"), call_severity(state).alias("severity"), "preview")
    rest = raw.filter("call_id = ''")
    protocol = protocol_text_class(F.col("message_text"), F.col("role"))
    spoken = (F.col("payload_type").isin("message", "user_message", "agent_message")) & (F.col("message_text") != "") & (protocol == "")
    kind = (F.when(spoken & ((F.col("role") == "user") | (F.col("payload_type") == "user_message")), "user_message")
            .when(spoken & (F.col("role") == "developer"), "developer_message").when(spoken, "assistant_message")
            .when(F.col("payload_type") == "reasoning", "reasoning").when(F.col("payload_type") == "context_compacted", "compaction")
            .when(F.col("payload_type") == "turn_aborted", "abort").when(F.col("payload_type") == "thread_rolled_back", "rollback")
            .when(F.col("payload_type").isin("error", "stream_error"), "error").when(F.col("payload_type") == "warning", "warning"))
    others = rest.select(
        "session_id", "line", "ts_text", F.when(kind.isNotNull(), "main").otherwise("protocol").alias("layer"), F.coalesce(kind, F.lit("protocol")).alias("kind"),
        F.lit("").alias("tool_name"), F.lit("").alias("status"), F.when(kind == "error", "error").when(kind == "warning", "warning").otherwise("normal").alias("severity"), "preview")
    return tool_events.unionByName(others)
