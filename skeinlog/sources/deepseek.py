"""Event-log transcripts with a header record and sequence numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import records as R, text
from skeinlog.operators.claims import resolved, stated
from skeinlog.session import materialize
from skeinlog.sources.files import PACKED

# Header versions that can be read.
FORMAT_VERSIONS = [0, 4]


def headers(parsed: DataFrame) -> DataFrame:
    """First record of each file. ``supported`` tells whether its version can be read."""
    v = F.col("record")
    return parsed.filter("line = 1").select(
        "file", R.text_at(v, "$.id").alias("session_id"), R.get(v, "$.version", "bigint").alias("version"), R.get(v, "$.createdAt", "bigint").alias("created_ms"),
        R.text_at(v, "$.cwd").alias("cwd"), R.text_at(v, "$.parentSession").alias("parent_id"), R.get(v, "$.seedLength", "bigint").alias("seed_length"),
        F.coalesce((R.text_at(v, "$.type") == "session") & R.get(v, "$.version", "bigint").isin(*FORMAT_VERSIONS), F.lit(False)).alias("supported"))


def unsupported(headed: DataFrame) -> DataFrame:
    return headed.filter("not supported").select("file", F.lit(1).cast("bigint").alias("line"), F.lit("unsupported_version").alias("code"),
                                                 F.coalesce(F.col("version").cast("string"), F.lit("")).alias("message"))


def to_raw(parsed: DataFrame) -> DataFrame:
    """Raw rows; a packed row stands for all its members. ``parsed``: session_id, file, line, record."""
    v = F.col("record")
    kind = R.text_at(v, "$.type")
    packed = kind.isin(*PACKED)
    members = F.coalesce(F.size(R.get(v, "$.data.texts", "array<string>")), F.size(R.get(v, "$.data.args", "array<string>")))
    seq0 = F.coalesce(R.get(v, "$.seq0", "bigint"), R.get(v, "$.seq", "bigint"))
    ms = F.coalesce(R.get(v, "$.time0", "bigint"), R.get(v, "$.time", "bigint"), R.get(v, "$.createdAt", "bigint"))
    turn = R.get(v, "$.data.turn", "bigint")
    human = (kind == "user/message") & F.coalesce(R.get(v, "$.data.source.kind"), F.lit("user")).isin("user", "human")
    role = (F.when(human, "user").when(packed | kind.isin("assistant/message", "assistant/chunk", "assistant/attempt"), "assistant")
            .when(kind.isin("system/message", "developer/message"), "system").otherwise(""))
    return parsed.filter("record is not null").select(
        "session_id", F.concat("session_id", F.lit(":raw:"), (F.col("line") - 1).cast("string")).alias("raw_id"), "file", "line", (F.col("line") - 1).alias("record_ordinal"),
        kind.alias("payload_type"), role.alias("role"), seq0.alias("seq0"), F.when(packed, seq0 + members - 1).otherwise(seq0).alias("seq_end"),
        F.when(packed, members).otherwise(1).alias("member_count"), F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")).alias("ts_text"),
        F.when(turn > 0, F.concat(F.lit("turn:"), turn.cast("string"))).otherwise("").alias("turn_id"),
        F.when(kind.isin("tool/call", "tool/result"), R.text_at(v, "$.data.name", "$.data.message.toolCallId", "$.data.callId")).otherwise("").alias("tool_name"),
        text.truncate(F.when(packed, F.concat(kind, F.lit(" seqs "), seq0.cast("string"), F.lit(".."), (seq0 + members - 1).cast("string"), F.lit(" ("), members.cast("string"), F.lit(" members)")))
                      .otherwise(F.concat_ws(" ", kind, R.get(v, "$.data.text")))).alias("preview"), "record")


#: Records of a nested dispatch, by format version.
DISPATCHED = {"tool/code-dispatch-start": "start", "tool/ptc-dispatch-start": "start", "tool/code-dispatch": "end", "tool/ptc-dispatch": "end"}


def dispatch_rows(parsed: DataFrame) -> DataFrame:
    """Starts and ends of nested dispatches with the facts they state; arguments as JSON text with sorted keys."""
    v = F.col("record")
    part = F.create_map(*[F.lit(x) for pair in DISPATCHED.items() for x in pair])[R.text_at(v, "$.type")]
    fact = lambda name: R.text_at(v, f"$.data.{name}")
    facts = parsed.filter(part.isNotNull()).select(
        "file", "session_id", "line", R.get(v, "$.seq", "bigint").alias("seq"), part.alias("part"), fact("subCallId").alias("node_id"), fact("rootCallId").alias("root_id"),
        fact("parentCallId").alias("parent_id"), fact("name").alias("name"), R.json_at(v, "$.data.arguments").alias("arguments"))
    return of_supported(facts, parsed).drop("file")


def call_rows(parsed: DataFrame) -> DataFrame:
    """Outer calls by id."""
    v = F.col("record")
    calls = parsed.filter(R.text_at(v, "$.type") == "tool/call").select(
        "file", "session_id", R.text_at(v, "$.data.callId").alias("call_id"), R.text_at(v, "$.data.name").alias("name"), R.get(v, "$.seq", "bigint").alias("seq")).filter("call_id <> ''")
    return of_supported(calls, parsed).drop("file")


#: Rows of a streamed answer, rows of a compaction.
STREAMED = [*PACKED, "assistant/chunk"]
COMPACTION = ["compaction/start", "compaction/summary", "compaction/prune", "compaction/end"]


def of_supported(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """``rows`` of the files whose header can be read."""
    return rows.join(headers(parsed).filter("not supported").select("file"), "file", "left_anti")


def supported_lines(parsed: DataFrame) -> DataFrame:
    """Lines of the files whose header can be read."""
    return of_supported(parsed, parsed)


def units(parsed: DataFrame) -> DataFrame:
    """One unit a record, with the kind it has alone. A replaced surface and what no human wrote are protocol."""
    v = F.col("record")
    type_ = F.coalesce(R.text_at(v, "$.type"), F.lit(""))
    human = F.coalesce(R.get(v, "$.data.source.kind"), F.lit("user")).isin("user", "human")
    appended = F.coalesce(R.text_at(v, "$.surfaceOp.kind"), F.lit("")) != "replace"
    kind = (F.when((type_ == "user/message") & human & appended, "user_message").when((type_ == "assistant/message") & appended, "assistant_message")
            .when((type_ == "tool/call") | ((type_ == "tool/result") & appended), "tool_call").when(type_ == "compaction/start", "compaction").otherwise("protocol"))
    return parsed.select(
        "session_id", "line", F.lit(-1).alias("block"), F.when(v.isNull(), "protocol").otherwise(kind).alias("kind"), type_.alias("type"), F.coalesce(appended, F.lit(True)).alias("appended"),
        R.get(v, "$.data.turn", "bigint").alias("turn"), R.get(v, "$.data.step", "bigint").alias("step"),
        F.coalesce(F.nullif(R.text_at(v, "$.data.callId", "$.data.message.toolCallId"), F.lit("")), F.lit("")).alias("call_id"), F.coalesce(R.text_at(v, "$.data.compactionId"), F.lit("")).alias("compaction_id"))


def claims(units: DataFrame) -> DataFrame:
    """Compactions claim the rows of their id from the start on; calls their one later result; the final message of a step
    its streamed rows; the first streamed row of a step without one the others, as a partial answer."""
    whole, line = F.lit(-1), F.col("line")
    def at(condition):
        return F.min(F.when(condition, line))
    started = units.filter(F.col("type").isin(*COMPACTION) & (F.col("compaction_id") != "")).select("session_id", "compaction_id", "line", "type")
    leads = started.groupBy("session_id", "compaction_id").agg(F.count_if(F.col("type") == "compaction/start").alias("n"), at(F.col("type") == "compaction/start").alias("lead")).filter("n = 1")
    compacted = started.join(leads, ["session_id", "compaction_id"]).filter("line >= lead")
    is_call = F.col("type") == "tool/call"
    pairs = units.filter(F.col("type").isin("tool/call", "tool/result") & F.col("appended") & (F.col("call_id") != "")).groupBy("session_id", "call_id").agg(
        F.count_if(is_call).alias("calls"), F.count_if(~is_call).alias("results"), at(is_call).alias("c"), at(~is_call).alias("r")).filter("calls = 1")
    steps = units.filter("turn is not null and step is not null").filter(F.col("type").isin(*STREAMED) | ((F.col("type") == "assistant/message") & F.col("appended")))
    spoken = F.col("type") == "assistant/message"
    first = steps.groupBy("session_id", "turn", "step").agg(at(spoken).alias("said"), at(~spoken).alias("shown")).filter("shown is not null")
    rows = steps.filter(~spoken).join(first, ["session_id", "turn", "step"])
    ended, open_ = rows.filter("said is not null"), rows.filter("said is null")
    parts = [
        stated(compacted, line, whole, F.col("lead"), whole, "compaction", 1),
        stated(pairs, F.col("c"), whole, F.col("c"), whole, "tool_call", 2), stated(pairs.filter("results = 1 and r > c"), F.col("r"), whole, F.col("c"), whole, "tool_call", 2),
        stated(first.filter("said is not null"), F.col("said"), whole, F.col("said"), whole, "assistant_message", 3), stated(ended, line, whole, F.col("said"), whole, "assistant_message", 3),
        stated(open_, line, whole, F.col("shown"), whole, "partial_message", 3)]
    return reduce(DataFrame.unionByName, parts)


def to_logical(parsed: DataFrame) -> DataFrame:
    """Records of readable files with the event each one is in."""
    some = materialize(units(supported_lines(parsed)), "units")  # read by every kind of claim, parsed once
    return resolved(some.select("session_id", "line", "block", "kind"), claims(some))
