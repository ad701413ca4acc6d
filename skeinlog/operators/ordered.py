"""Ordered passes over a session that stay parallel when one session is very large.

A plain ``Window.partitionBy(session).orderBy(line)`` sends a whole session to one task.  The scans
here cut every session into blocks of consecutive order values, run the window inside a block, reduce
each block to one small row, carry those rows forward across the blocks of the session, and join the
carried value back.  Only the reduced rows are ever ordered per session; the data itself is shuffled
on (session, block), so a session holding a third of the input is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.session import block_rows

BLOCK = "_block"


@dataclass(frozen=True)
class RunningSum:
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class RunningMax:
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class RunningMin:
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class LastValue:
    """Last non-null value at (inclusive) or strictly before the row."""

    value: Column
    inclusive: bool = True
    wrapped: bool = False


@dataclass(frozen=True)
class NextValue:
    """First non-null value strictly after the row, or at it when inclusive."""

    value: Column
    inclusive: bool = False
    wrapped: bool = False


def RowNumber() -> RunningSum:
    return RunningSum(F.lit(1).cast("bigint"))


def Lag(value: Column) -> LastValue:
    return LastValue(F.struct(value.alias("v")), inclusive=False, wrapped=True)


def Lead(value: Column) -> NextValue:
    return NextValue(F.struct(value.alias("v")), wrapped=True)


def scan(df: DataFrame, keys: list[str], order: str, block: Column | None = None, **specs) -> DataFrame:
    """Add one column per spec. ``order`` must be an integer, unique within the keys, but for sums, least and greatest
    values that are read behind all rows of one order value.

    ``block`` may name another block expression; it has to be non-decreasing in ``order``.
    ``Lag``/``Lead`` results are unwrapped, so a null predecessor and no predecessor both read NULL.
    """
    size = block_rows(df.sparkSession)
    block = F.floor(F.col(order) / F.lit(size)) if block is None else block
    original = df.columns
    inputs = {f"_in_{name}": spec.value for name, spec in specs.items()}
    rows = df.withColumns({BLOCK: block, **inputs})

    inner = Window.partitionBy(*keys, BLOCK).orderBy(order)
    outer = Window.partitionBy(*keys).orderBy(BLOCK)
    upto, before = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(Window.unboundedPreceding, -1)
    after = inner.rowsBetween(1, Window.unboundedFollowing)
    onward = inner.rowsBetween(0, Window.unboundedFollowing)
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    later = outer.rowsBetween(1, Window.unboundedFollowing)

    local, partial, carry, final = {}, [], {}, {}
    for name, spec in specs.items():
        src = F.col(f"_in_{name}")
        frame = upto if spec.inclusive else before
        seen = F.when(src.isNotNull(), F.col(order))
        if isinstance(spec, RunningSum):
            local[f"_l_{name}"] = F.sum(src).over(frame)
            partial.append(F.sum(src).alias(f"_p_{name}"))
            carry[f"_c_{name}"] = F.sum(f"_p_{name}").over(earlier)
            final[name] = F.coalesce(F.col(f"_l_{name}"), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        elif isinstance(spec, RunningMax):
            local[f"_l_{name}"] = F.max(src).over(frame)
            partial.append(F.max(src).alias(f"_p_{name}"))
            carry[f"_c_{name}"] = F.max(f"_p_{name}").over(earlier)
            final[name] = F.greatest(f"_l_{name}", f"_c_{name}")
        elif isinstance(spec, RunningMin):
            local[f"_l_{name}"] = F.min(src).over(frame)
            partial.append(F.min(src).alias(f"_p_{name}"))
            carry[f"_c_{name}"] = F.min(f"_p_{name}").over(earlier)
            final[name] = F.least(f"_l_{name}", f"_c_{name}")
        elif isinstance(spec, LastValue):
            local[f"_l_{name}"] = F.last(src, True).over(frame)
            partial.append(F.max_by(src, seen).alias(f"_p_{name}"))
            carry[f"_c_{name}"] = F.last(f"_p_{name}", True).over(earlier)
            final[name] = F.coalesce(f"_l_{name}", f"_c_{name}")
        elif isinstance(spec, NextValue):
            local[f"_l_{name}"] = F.first(src, True).over(onward if spec.inclusive else after)
            partial.append(F.min_by(src, seen).alias(f"_p_{name}"))
            carry[f"_c_{name}"] = F.first(f"_p_{name}", True).over(later)
            final[name] = F.coalesce(f"_l_{name}", f"_c_{name}")
        else:
            raise TypeError(f"unknown scan spec {spec!r}")

    summary = (
        rows.groupBy(*keys, BLOCK).agg(*partial)
        .withColumns(carry)
        .select(*keys, BLOCK, *carry)
    )
    merged = rows.withColumns(local).join(summary, [*keys, BLOCK])
    kept = [c for c in original if c not in specs]
    outputs = [
        (final[name]["v"] if getattr(spec, "wrapped", False) else final[name]).alias(name)
        for name, spec in specs.items()
    ]
    return merged.select(*kept, *outputs)


def place(limited: DataFrame, keys: list[Column]) -> DataFrame:
    """Rank rows of a result that a limit has already bounded."""
    return limited.withColumn("place", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))
