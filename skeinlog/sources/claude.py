"""Message transcripts made of content blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import numbers, records as R, text
from skeinlog.operators import ordered
from skeinlog.operators.claims import resolved, stated
from skeinlog.session import materialize


def blocks(record: Column) -> Column:
    """Content blocks; a plain text content counts as one text block."""
    block = "struct<type:string,text:string,thinking:string,id:string,name:string,tool_use_id:string,is_error:boolean,input:variant,content:variant>"
    listed = F.try_variant_get(record, "$.message.content", f"array<{block}>")
    plain = F.when(R.kind_at(record, "$.message.content") == "STRING", F.array(F.struct(
        F.lit("text").alias("type"), R.get(record, "$.message.content").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (
            ("thinking", "string"), ("id", "string"), ("name", "string"), ("tool_use_id", "string"), ("is_error", "boolean"), ("input", "variant"), ("content", "variant"))])))
    return F.coalesce(plain, listed, F.array().cast(f"array<{block}>"))


def to_raw(parsed: DataFrame) -> DataFrame:
    """Raw rows of all lines; an unreadable line stays as a malformed row, with its text in ``raw_text``."""
    v, broken = F.col("record"), F.col("record").isNull()
    rows = parsed.withColumn("blocks", blocks(v))
    first_type = F.get("blocks", F.lit(0))["type"]
    texts = F.filter(F.transform("blocks", lambda b: F.coalesce(b["text"], b["thinking"], F.lit(""))), lambda t: t != "")
    usage = "$.message.usage"
    return rows.select(
        "session_id", F.concat("session_id", F.lit(":raw:"), F.col("line").cast("string")).alias("raw_id"), "file", "line",
        F.when(broken, "malformed").otherwise(R.text_at(v, "$.type")).alias("record_type"),
        F.when(broken, "malformed_json").otherwise(F.coalesce(first_type, R.text_at(v, "$.type"))).alias("payload_type"),
        numbers.iso_text(R.get(v, "$.timestamp")).alias("ts_text"), R.text_at(v, "$.uuid").alias("uuid"), R.text_at(v, "$.parentUuid").alias("parent_uuid"),
        R.text_at(v, "$.promptId").alias("prompt_id"), R.text_at(v, "$.message.id").alias("message_id"), R.text_at(v, "$.message.model").alias("model"),
        F.coalesce(F.nullif(R.text_at(v, "$.message.role"), F.lit("")), F.when(R.text_at(v, "$.type").isin("user", "assistant"), R.text_at(v, "$.type")).otherwise("system")).alias("role"),
        F.coalesce(R.get(v, "$.isMeta", "boolean"), F.lit(False)).alias("is_meta"), F.coalesce(R.get(v, "$.isCompactSummary", "boolean"), F.lit(False)).alias("is_summary"),
        R.text_at(v, "$.origin.kind").alias("origin"), F.array_join(texts, "\n").alias("message_text"),
        F.when(broken, text.truncate(F.col("text"))).otherwise(text.truncate(F.array_join(texts, " "))).alias("preview"),
        F.when(broken, F.col("text")).alias("raw_text"),
        R.get(v, f"{usage}.input_tokens", "bigint").alias("input_tokens"), R.get(v, f"{usage}.output_tokens", "bigint").alias("output_tokens"),
        R.get(v, f"{usage}.cache_creation_input_tokens", "bigint").alias("cache_creation_tokens"), R.get(v, f"{usage}.cache_read_input_tokens", "bigint").alias("cache_read_tokens"),
        F.filter(F.transform("blocks", lambda b, i: F.struct(i.alias("block"), b["type"].alias("type"), b["id"].alias("id"), b["name"].alias("name"))), lambda b: b["type"] == "tool_use").alias("tool_calls"),
        F.filter(F.transform("blocks", lambda b, i: F.struct(i.alias("block"), b["type"].alias("type"), b["tool_use_id"].alias("id"), F.coalesce(b["is_error"], F.lit(False)).alias("is_error"))),
                 lambda b: b["type"] == "tool_result").alias("tool_results"), "blocks")


def call_rows(raw: DataFrame) -> DataFrame:
    """Calls and results as rows of one ordered stream. Their order, ``line``, is the line and the block in it."""
    def rows(column: str, is_call: bool) -> DataFrame:
        return raw.select("session_id", "line", "raw_id", F.explode(column).alias("b")).select(
            "session_id", F.struct("line", F.col("b.block").alias("block")).alias("line"), F.nullif("b.id", F.lit("")).alias("call_id"),
            F.concat_ws(":", "raw_id", F.col("b.block").cast("string")).alias("event_id"), F.lit(is_call).alias("is_call"), F.lit(not is_call).alias("is_result"))
    return rows("tool_calls", True).unionByName(rows("tool_results", False))


def block_events(raw: DataFrame) -> DataFrame:
    """One event per text, thinking or tool block."""
    b = raw.filter("record_type in ('user', 'assistant')").select("session_id", "line", "role", "ts_text", F.posexplode("blocks").alias("block", "b"))
    kind = (F.when(F.col("b.type") == "thinking", "reasoning").when(F.col("b.type") == "tool_use", "tool_call")
            .when((F.col("b.type") == "text") & (F.col("role") == "user"), "user_message").when(F.col("b.type") == "text", "assistant_message"))
    return b.select("session_id", "line", "block", "ts_text", kind.alias("kind"), F.coalesce("b.text", "b.thinking", "b.name", F.lit("")).alias("text")).filter("kind is not null")


def units(parsed: DataFrame) -> DataFrame:
    """What events are made of: rows that stand as a whole (block -1), else their blocks, each with the kind it has alone.

    Rows: unreadable lines, errors of the service, synthetic and system rows, rows of a user that no human wrote. Text
    blocks of white space are nothing. A row with tool results is known by its blocks only.
    """
    v, broken = F.col("record"), F.col("record").isNull()
    flag = lambda path: F.coalesce(R.get(v, path, "boolean"), F.lit(False))
    said = lambda path: F.coalesce(R.text_at(v, path), F.lit(""))
    rows = parsed.select(
        "session_id", "line", broken.alias("_broken"), said("$.type").alias("_type"), said("$.subtype").alias("_sub"), flag("$.isApiErrorMessage").alias("_failed"),
        (said("$.message.model") == "<synthetic>").alias("_made"), flag("$.isCompactSummary").alias("summary"),
        (flag("$.isMeta") | flag("$.isCompactSummary") | (said("$.origin.kind") == "task-notification")).alias("_told"), blocks(v).alias("_blocks"))
    answers = F.exists("_blocks", lambda b: b["type"] == "tool_result")
    talk = F.col("_type").isin("user", "assistant")
    alone = (F.when(F.col("_broken"), "protocol").when(F.col("_sub").isin("compact_boundary") & ~talk, "compaction").when(~talk, "protocol")
             .when((F.col("_type") == "assistant") & F.col("_failed"), "error").when((F.col("_type") == "assistant") & F.col("_made"), "protocol")
             .when((F.col("_type") == "user") & F.col("_told") & ~answers, "protocol").when(F.size("_blocks") == 0, "protocol"))
    rows = rows.withColumns({"_alone": alone, "_answers": answers})
    one = rows.filter("_alone is not null").select(
        "session_id", "line", F.lit(-1).alias("block"), F.col("_alone").alias("kind"), F.lit("").alias("type"), F.lit("").alias("call_id"), "summary")
    b = rows.filter("_alone is null").select("session_id", "line", "_type", "_answers", "summary", F.posexplode("_blocks").alias("block", "b"))
    blank = (F.col("b.type") == "text") & (F.trim(F.regexp_replace(F.coalesce("b.text", F.lit("")), r"\s+", " ")) == "") & ~F.col("_answers")
    kind = (F.when(F.col("_answers"), "protocol").when(F.col("b.type") == "text", F.concat("_type", F.lit("_message")))
            .when((F.col("b.type") == "thinking") & (F.col("_type") == "assistant"), "reasoning").otherwise("protocol"))
    call = F.when(F.col("b.type") == "tool_use", F.col("b.id")).when(F.col("b.type") == "tool_result", F.col("b.tool_use_id"))
    several = b.filter(~F.coalesce(blank, F.lit(False))).select(
        "session_id", "line", "block", kind.alias("kind"), F.coalesce("b.type", F.lit("")).alias("type"), F.coalesce(call, F.lit("")).alias("call_id"), "summary")
    return one.unionByName(several)


def claims(units: DataFrame) -> DataFrame:
    """Compactions claim their boundary and the first summary behind it; a call whose id is its own claims its one later result."""
    marks = units.filter("block = -1 and (kind = 'compaction' or summary)")
    cut = ordered.scan(marks, ["session_id"], "line", _part=ordered.RunningSum((F.col("kind") == "compaction").cast("bigint"))).filter("_part > 0")
    groups = cut.groupBy("session_id", "_part").agg(F.min(F.when(F.col("kind") == "compaction", F.col("line"))).alias("lead"), F.min(F.when(F.col("kind") != "compaction", F.col("line"))).alias("summary"))
    whole = F.lit(-1)
    calls, at = units.filter("call_id <> ''"), F.struct("line", "block")
    is_call = F.col("type") == "tool_use"
    pairs = calls.groupBy("session_id", "call_id").agg(
        F.count_if(is_call).alias("calls"), F.count_if(~is_call).alias("results"), F.min(F.when(is_call, at)).alias("c"), F.min(F.when(~is_call, at)).alias("r")).filter("calls = 1")
    lead = F.col("c.line"), F.col("c.block")
    parts = [
        stated(groups, F.col("lead"), whole, F.col("lead"), whole, "compaction", 1), stated(groups.filter("summary is not null"), F.col("summary"), whole, F.col("lead"), whole, "compaction", 1),
        stated(pairs, *lead, *lead, "tool_call", 2), stated(pairs.filter("results = 1 and r > c"), F.col("r.line"), F.col("r.block"), *lead, "tool_call", 2)]
    return reduce(DataFrame.unionByName, parts)


def to_logical(parsed: DataFrame) -> DataFrame:
    """Units with the event each one is in."""
    some = materialize(units(parsed), "units")  # read by every kind of claim, parsed once
    return resolved(some.select("session_id", "line", "block", "kind"), claims(some))
