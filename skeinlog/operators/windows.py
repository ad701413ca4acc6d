"""Ordered per-session facts: epochs, runs, forward fills, cut-offs, order keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.operators import ordered
from skeinlog.session import materialize

SESSION = ["session_id"]


def _present(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def turn_epochs(rows: DataFrame, boundary: Column) -> DataFrame:
    """Epoch of every row: it steps at a boundary row, and where a non-empty turn id differs from the last one."""
    before = ordered.scan(rows.withColumn("_b", boundary), SESSION, "line",
                          _turn=ordered.LastValue(_present("turn_id"), inclusive=False))
    moved = _present("turn_id").isNotNull() & F.col("_turn").isNotNull() & (F.col("turn_id") != F.col("_turn"))
    stepped = materialize(before.withColumn("_s", (F.col("_b") | moved).cast("bigint")), "epochs")
    return ordered.scan(stepped, SESSION, "line", epoch=ordered.RunningSum(F.col("_s"))).drop("_b", "_turn", "_s")


def compaction_groups(rows: DataFrame) -> DataFrame:
    """Boundary with the first summary and first file reference before the next boundary.

    ``rows``: line, event_id, part (boundary / summary / reference / other).
    """
    part = F.col("part")
    segments = ordered.scan(rows.filter(part.isin("boundary", "summary", "reference")), SESSION, "line",
                            segment=ordered.RunningSum((part == "boundary").cast("bigint")))

    def first(name: str) -> Column:
        return F.min_by("event_id", F.when(part == name, F.col("line"))).alias(f"{name}_event_id")
    return segments.filter("segment > 0").groupBy(*SESSION, "segment").agg(first("boundary"), first("summary"), first("reference"))


def goal_transitions(snapshots: DataFrame) -> DataFrame:
    """created / updated / '' for each goal snapshot against the one before it with the same identity."""
    facts = F.struct("created_at", "objective", "status", "token_budget")
    seen = ordered.scan(snapshots, ["session_id", "identity"], "line", _p=ordered.Lag(facts))
    p = F.col("_p")
    recreated = p["created_at"].isNotNull() & F.col("created_at").isNotNull() & (p["created_at"] != F.col("created_at"))
    same = (p["objective"].eqNullSafe(F.col("objective")) & p["status"].eqNullSafe(F.col("status"))
            & p["token_budget"].eqNullSafe(F.col("token_budget")))
    change = F.when(p.isNull() | recreated, "created").when(~same, "updated").otherwise("")
    return seen.withColumn("transition", change).drop("_p")


def forward_fill(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Last value seen of each column, and whether all of them have been seen."""
    filled = ordered.scan(rows, SESSION, "line", **{f"current_{c}": ordered.LastValue(F.col(c)) for c in columns})
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(f"current_{c}").isNotNull()
    return filled.withColumn("complete", complete)


def reminder_runs(rows: DataFrame) -> DataFrame:
    """Equal consecutive snapshots merge unless a task transition lies between them.

    ``rows``: line, event_id, fingerprint (NULL on transition rows), is_transition.
    """
    steps = ordered.scan(rows, SESSION, "line", _t=ordered.RunningSum(F.col("is_transition").cast("bigint")))
    shots = materialize(steps.filter("fingerprint is not null"), "reminders")
    before = ordered.scan(shots, SESSION, "line", _p=ordered.Lag(F.struct("fingerprint", "_t")))
    starts = F.col("_p").isNull() | (F.col("_p.fingerprint") != F.col("fingerprint")) | (F.col("_p._t") != F.col("_t"))
    runs = ordered.scan(before.withColumn("_start", F.when(starts, F.col("event_id"))), SESSION, "line",
                        run_id=ordered.LastValue(F.col("_start")))
    return runs.groupBy(*SESSION, "run_id").agg(F.count(F.lit(1)).alias("snapshots"), F.min("line").alias("first_line"),
                                                F.max("line").alias("last_line"), F.min_by("fingerprint", "line").alias("fingerprint"))


def overlapping(calls: DataFrame) -> DataFrame:
    """A call that starts before an earlier one of the session has ended. ``calls``: line, end_line."""
    seen = ordered.scan(calls, SESSION, "line", _end=ordered.RunningMax(F.col("end_line"), inclusive=False))
    return seen.withColumn("overlap", F.coalesce(F.col("_end") >= F.col("line"), F.lit(False))).drop("_end")


def cutoffs(rows: DataFrame, barrier: Column) -> DataFrame:
    """First barrier line of each session, NULL when there is none."""
    return rows.groupBy(*SESSION).agg(F.min(F.when(barrier, F.col("line"))).alias("cutoff"))


def before_cutoff(rows: DataFrame, barrier: Column) -> DataFrame:
    return rows.join(cutoffs(rows, barrier), SESSION).filter("cutoff is null or line < cutoff").drop("cutoff")


def staged_order(rows: DataFrame) -> DataFrame:
    """Running maximum of the raw ordinal, the order in which staged projections are merged."""
    return ordered.scan(rows, SESSION, "line", running_ordinal=ordered.RunningMax(F.col("raw_ordinal")))


def event_order(events: DataFrame, positional: Column) -> DataFrame:
    """Sort key of the family that orders by timestamp: by line alone once one event is untimed or positional."""
    flags = events.groupBy(*SESSION).agg(F.bool_or((F.col("ts_text") == "") | positional).alias("by_line"))
    return events.join(flags, SESSION).withColumn("sort_text", F.when(F.col("by_line"), "").otherwise(F.col("ts_text")))


def latest_title(rows: DataFrame, boundary: Column) -> DataFrame:
    """Last title at or after the seed boundary, else the subagent label."""
    own = F.when(F.col("line") >= boundary, F.col("title"))
    return rows.groupBy(*SESSION).agg(
        F.max_by(own, F.when(own.isNotNull(), F.col("line"))).alias("_t"), F.min("label").alias("_l"),
        F.max_by("provider", F.when(F.col("provider").isNotNull(), F.col("line"))).alias("provider"),
    ).select(*SESSION, F.coalesce("_t", "_l").alias("title"), "provider")


def open_context(rows: DataFrame) -> DataFrame:
    """Open turn and step at every row. ``rows``: line, turn, step, opens (NULL on rows that are no boundary)."""
    mark = F.when(F.col("opens").isNotNull(), F.struct("turn", "step", "opens"))
    seen = ordered.scan(rows, SESSION, "line", _ctx=ordered.LastValue(mark))
    live = F.col("_ctx.opens")
    return seen.withColumns({"open_turn": F.when(live, F.col("_ctx.turn")), "open_step": F.when(live, F.col("_ctx.step"))}).drop("_ctx")


def sequence_gaps(rows: DataFrame) -> DataFrame:
    """Rows that do not continue the sequence of their session; the first one must start at 0."""
    seen = ordered.scan(rows, SESSION, "line", _end=ordered.LastValue(F.col("seq_end"), inclusive=False))
    expected = F.coalesce(F.col("_end") + 1, F.lit(0))
    return seen.filter(F.col("seq0") != expected).select(*SESSION, "line", "seq0", expected.alias("expected"))
