"""Cache-reuse accounting: observations, comparison with the previous one, drops and their anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions import numbers, vocabulary as V
from skeinlog.operators import ordered
from skeinlog.session import materialize


def _listed(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]), lambda x: x.isNotNull())


def accounting_reasons(has_input: Column, has_cached: Column, input_tokens: Column, cached: Column) -> Column:
    """Why an accounting row cannot be observed. Absent and present-but-unusable are told apart."""
    return _listed(
        (~has_input, V.ACCOUNTING_REASONS[0]), (has_input & input_tokens.isNull(), V.ACCOUNTING_REASONS[1]),
        (~has_cached, V.ACCOUNTING_REASONS[2]), (has_cached & cached.isNull(), V.ACCOUNTING_REASONS[3]),
        (cached > input_tokens, V.ACCOUNTING_REASONS[4]))


def gate_reasons(prev_input: Column, prev_cached: Column, prev_bps: Column, now_input: Column, now_cached: Column) -> Column:
    """Gates that keep a drop from counting, in order. The token bounds keep every product inside 64 bits."""
    return _listed(
        (prev_cached < V.MIN_PREVIOUS_CACHED, V.GATE_REASONS[0]),
        (prev_bps.isNull() | (prev_bps < V.MIN_PREVIOUS_REUSE_BPS), V.GATE_REASONS[1]),
        (now_input * 4 < prev_input * 3, V.GATE_REASONS[2]),
        (now_cached * 2 > prev_cached, V.GATE_REASONS[3]),
        (prev_cached - now_cached < V.MIN_CACHED_DROP, V.GATE_REASONS[4]))


def with_context(rows: DataFrame) -> DataFrame:
    """Active model and compaction generation at every owned row."""
    return ordered.scan(
        rows, ["session_id"], "line",
        active_model=ordered.LastValue(F.nullif(F.trim("model"), F.lit(""))),
        generation=ordered.RunningSum(F.col("is_compaction").cast("bigint")))


def observe(rows: DataFrame) -> DataFrame:
    """Accounting rows with their observation and its comparison to the row before.

    ``rows``: session_id, line, event_id, ts_text, turn_id, model, is_compaction, is_token, has_input,
    has_cached, input_tokens, cached_tokens. An accounting row that cannot be observed is a barrier:
    the next one has no previous observation.
    """
    reasons = accounting_reasons(F.col("has_input"), F.col("has_cached"), F.col("input_tokens"), F.col("cached_tokens"))
    tokens = (
        with_context(rows).filter("is_token")
        .withColumn("accounting_reasons", reasons)
        .withColumn("observed", F.size("accounting_reasons") == 0)
        .withColumn("reuse_bps", F.when(F.col("observed"), numbers.reuse_bps(F.col("input_tokens"), F.col("cached_tokens"))))
        .withColumn("_ms", numbers.epoch_ms(F.col("ts_text")))
    )
    # Only accounting rows go on; stored, they are not worked out again for each side of the next scan.
    tokens = materialize(tokens, "accounting")
    seen = F.when(F.col("observed"), F.struct(
        "event_id", "input_tokens", "cached_tokens", "reuse_bps", "_ms", "active_model", "generation"))
    lagged = ordered.scan(tokens, ["session_id"], "line", _prev=ordered.Lag(seen))
    p = F.col("_prev")
    c = F.col
    elapsed = F.when(p["_ms"].isNotNull() & (c("_ms") > p["_ms"]), c("_ms") - p["_ms"])
    gates = gate_reasons(p["input_tokens"], p["cached_tokens"], p["reuse_bps"], c("input_tokens"), c("cached_tokens"))
    state = (F.when(p.isNull(), V.COMPARISON_STATES[0]).when(elapsed.isNull(), V.COMPARISON_STATES[1])
             .when(p["active_model"] != c("active_model"), V.COMPARISON_STATES[2])
             .when(p["generation"] != c("generation"), V.COMPARISON_STATES[3])
             .when(F.size(gates) > 0, V.COMPARISON_STATES[4]).otherwise(V.COMPARISON_STATES[5]))
    state = F.when(c("observed"), state)
    return lagged.select(
        "session_id", "line", "event_id", "ts_text", "turn_id", "active_model", "generation", "observed",
        "accounting_reasons", "input_tokens", "cached_tokens",
        F.when(c("observed"), c("input_tokens") - c("cached_tokens")).alias("uncached_tokens"), "reuse_bps",
        state.alias("state"),
        F.when(state.isin(V.COMPARISON_STATES[4:]), gates).otherwise(F.array().cast("array<string>")).alias("gate_reasons"),
        F.when(c("observed"), p["event_id"]).alias("previous_event_id"),
        F.when(c("observed"), elapsed).alias("elapsed_ms"),
        F.when(c("observed"), c("input_tokens") - p["input_tokens"]).alias("input_delta"),
        F.when(c("observed"), numbers.delta_bps(p["input_tokens"], c("input_tokens"))).alias("input_delta_bps"),
        F.when(c("observed"), c("cached_tokens") - p["cached_tokens"]).alias("cached_delta"),
        F.when(c("observed"), p["reuse_bps"]).alias("previous_reuse_bps"))


def discontinuity_links(observations: DataFrame, main_events: DataFrame) -> DataFrame:
    """Each drop with the main event it is shown at: the latest one of the same turn at or before the
    turn's first drop. All drops of a turn share the anchor. ``link_reason`` says why there is none.

    Both sides are reduced per turn before they meet, so the join carries one row per turn with a drop.
    """
    drops = materialize(observations.filter(F.col("state") == V.COMPARISON_STATES[5]).select("session_id", "turn_id", "line", "event_id"), "drops")
    groups = (
        drops.filter("turn_id <> ''").groupBy("session_id", "turn_id")
        .agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("_n"), F.count_distinct("line").alias("_lines"))
    )
    owned = main_events.filter("turn_id <> ''").select("session_id", "turn_id", F.col("line").alias("main_line"),
                                                       F.col("event_id").alias("main_event_id"))
    anchors = (
        groups.join(owned, ["session_id", "turn_id"])
        .groupBy("session_id", "turn_id")
        .agg(F.max_by("main_event_id", F.when(F.col("main_line") <= F.col("first_line"), F.col("main_line"))).alias("anchor"))
    )
    resolved = (
        groups.join(anchors.withColumn("_has_main", F.lit(True)), ["session_id", "turn_id"], "left")
        .select("session_id", "turn_id", "anchor", (F.col("_n") > F.col("_lines")).alias("_dup"),
                F.coalesce("_has_main", F.lit(False)).alias("_has_main"))
    )
    linked = drops.join(resolved, ["session_id", "turn_id"], "left")
    reason = (F.when(F.col("turn_id") == "", "unknown_owner").when(F.col("_dup"), "duplicate_protocol_raw_order")
              .when(F.col("anchor").isNotNull(), "mapped")
              .when(F.col("_has_main"), "no_main_anchor_before_discontinuity").otherwise("no_main_event_for_owner"))
    return linked.select("session_id", "turn_id", "line", "event_id", reason.alias("link_reason"),
                         F.when(reason == "mapped", F.col("anchor")).alias("main_event_id"))


def presentation_facts(links: DataFrame) -> DataFrame:
    """Per main event: first linked drop and how many there are."""
    return (
        links.filter("main_event_id is not null").groupBy("session_id", "main_event_id")
        .agg(F.min_by("event_id", "line").alias("first_drop_event_id"), F.count(F.lit(1)).alias("drops"))
    )


def link_asymmetry(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Links present in one direction only: (main_event_id, event_id) pairs of both maps compared."""
    pair = ["session_id", "main_event_id", "event_id"]
    return (
        forward.select(*pair, F.lit(1).alias("_f")).join(backward.select(*pair, F.lit(1).alias("_b")), pair, "full_outer")
        .filter("_f is null or _b is null").select(*pair, F.when(F.col("_f").isNull(), "backward_only").otherwise("forward_only").alias("side"))
    )


def summary(observations: DataFrame, spark: SparkSession) -> DataFrame:
    """Counts per state and per reason over the closed vocabularies, zero where nothing was seen."""
    vocabulary = ([("state", v) for v in V.COMPARISON_STATES] + [("gate", v) for v in V.GATE_REASONS]
                  + [("accounting", v) for v in V.ACCOUNTING_REASONS])
    closed = spark.createDataFrame(vocabulary, "part string, name string")
    facts = F.concat(
        F.filter(F.array(F.when(F.col("state").isNotNull(), F.struct(F.lit("state").alias("part"), F.col("state").alias("name")))),
                 lambda s: s.isNotNull()),
        F.transform("gate_reasons", lambda r: F.struct(F.lit("gate").alias("part"), r.alias("name"))),
        F.transform("accounting_reasons", lambda r: F.struct(F.lit("accounting").alias("part"), r.alias("name"))))
    counted = observations.select(F.explode(facts).alias("f")).groupBy("f.part", "f.name").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(closed).join(counted, ["part", "name"], "left").select("part", "name", F.coalesce("n", F.lit(0)).alias("n"))


def session_summary(observations: DataFrame, links: DataFrame) -> DataFrame:
    mapped = links.groupBy("session_id").agg(F.count_if(F.col("link_reason") == "mapped").alias("linked"))
    return (
        observations.groupBy("session_id").agg(
            F.count(F.lit(1)).alias("tokens"), F.count_if("observed").alias("observations"),
            F.count_if(~F.col("observed")).alias("barriers"),
            F.count_if(F.col("state") == V.COMPARISON_STATES[5]).alias("discontinuities"))
        .join(mapped, "session_id", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    )
