"""Ordered state machines over a session, exact and parallel even when one session is very large.

A session is cut into blocks of consecutive rows, by the number of its rows and not by their order values: one that has
no more rows than a block is one block, however far they lie apart. Every block is folded from an assumed entry state;
a block whose assumed entry differs from the end state of the block before it is folded again. The
rounds stop when all entries agree, which is the sequential result. Most sessions have one block and
need one round, and a machine that forgets its past settles after two. No task ever holds more rows of
a session than one block, and the state itself is what the machine keeps, not the rows it has seen.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skeinlog.session import block_rows, materialize

BLOCK, ENTRY, END, WANT, LATER, BIN = "_block", "_entry", "_end", "_want", "_later", "_bin"

Step = Callable[[dict, dict], dict]


def _dump(state: dict) -> str:
    return json.dumps(state, sort_keys=True, separators=(",", ":"))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[tuple[tuple, dict]]]:
    for batch in batches:
        yield [(tuple(row[k] for k in keys), row) for row in batch.to_pylist()]


class _Machine:
    """Task-side runners of one step function over sorted blocks."""

    def __init__(self, schema: T.StructType, keys: list[str], order: str, step: Step, output: str):
        self.keys, self.order, self.step = keys, order, step
        self.group = [*keys, BLOCK]
        kept = [schema[c] for c in [*keys, order]]
        self.produced = T.StructType(kept + T.StructType.fromDDL(output).fields)
        self.ends = T.StructType([schema[c] for c in keys] + [
            T.StructField(BLOCK, T.LongType()), T.StructField(ENTRY, T.StringType()), T.StructField(END, T.StringType())])

    def _placed(self, rows: DataFrame, entries: DataFrame) -> DataFrame:
        """Rows by block, in order, behind the one row that holds the block's entry state."""
        entry = entries.select(*self.group, ENTRY, F.lit(0).alias(LATER))
        both = rows.withColumn(LATER, F.lit(1)).unionByName(entry, allowMissingColumns=True)
        return both.repartition(*self.group).sortWithinPartitions(*self.group, LATER, self.order)

    def outputs(self, rows: DataFrame, entries: DataFrame) -> DataFrame:
        group, step, names = self.group, self.step, [*self.keys, self.order]
        schema = to_arrow_schema(self.produced)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = None
            for part in _runs(batches, group):
                out = []
                for _, row in part:
                    if not row[LATER]:
                        state = json.loads(row[ENTRY])
                    else:
                        out.append({**{n: row[n] for n in names}, **step(state, row)})
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        return self._placed(rows, entries).mapInArrow(run, self.produced)

    def last_states(self, rows: DataFrame, entries: DataFrame) -> DataFrame:
        group, step, names = self.group, self.step, self.ends.fieldNames()
        schema = to_arrow_schema(self.ends)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, entry, state = None, None, None
            for part in _runs(batches, group):
                out = []
                for key, row in part:
                    if row[LATER]:
                        step(state, row)
                        continue
                    if at is not None:
                        out.append(dict(zip(names, [*at, entry, _dump(state)])))
                    at, entry = key, row[ENTRY]
                    state = json.loads(entry)
                yield pa.RecordBatch.from_pylist(out, schema=schema)
            if at is not None:
                yield pa.RecordBatch.from_pylist([dict(zip(names, [*at, entry, _dump(state)]))], schema=schema)
        return self._placed(rows, entries).mapInArrow(run, self.ends)


def _settle(machine: _Machine, rows: DataFrame, entries: DataFrame, initial: str) -> DataFrame:
    """End states that the sequential run would give the blocks of ``entries``, the first blocks of their sessions."""
    group = machine.group
    ends = materialize(machine.last_states(rows, entries), "fold-ends")
    by = Window.partitionBy(*machine.keys).orderBy(BLOCK)
    while True:
        wanted = ends.withColumn(WANT, F.coalesce(F.lag(END).over(by), F.lit(initial)))
        stale = wanted.filter(F.col(WANT) != F.col(ENTRY)).select(*group, F.col(WANT).alias(ENTRY))
        if stale.isEmpty():
            return ends
        redone = machine.last_states(rows.join(stale.select(*group), group, "left_semi"), stale)
        fresh = ends.join(stale.select(*group), group, "left_anti")
        ends = materialize(fresh.unionByName(redone), "fold-ends")


def _blocked(rows: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their block, and the blocks. A bin of ``size`` order values is never divided, so a block has fewer than twice ``size`` rows."""
    size = block_rows(rows.sparkSession)
    binned = rows.withColumn(BIN, F.floor(F.col(order) / F.lit(size)))
    ahead = Window.partitionBy(*keys).orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col(BIN).isNotNull(), F.col("_n"))).over(ahead), F.lit(0))
    counts = binned.groupBy(*keys, BIN).agg(F.count(F.lit(1)).alias("_n"))
    bins = materialize(counts.select(*keys, BIN, F.when(F.col(BIN).isNotNull(), F.floor(before / F.lit(size))).alias(BLOCK)), "fold-bins")
    moved = materialize(bins.filter(F.col(BLOCK) > 0), "fold-moved")
    block = F.when(F.col(BIN).isNotNull(), F.coalesce(BLOCK, F.lit(0).cast("bigint")))
    return binned.join(moved, [*keys, BIN], "left").withColumn(BLOCK, block).drop(BIN), bins.select(*keys, BLOCK).distinct()


def fold(rows: DataFrame, keys: list[str], order: str, step: Step, initial: dict, output: str) -> DataFrame:
    """Run ``step(state, row) -> output columns`` over each group in order.

    ``output`` is a DDL string of the columns the step returns; the keys and the order column are kept. A
    task reads its blocks sorted, one Arrow batch at a time, and holds one state; the entry state of a block is a row of
    its own ahead of it. Only blocks that others follow need an end state: a session of one block is read once.
    """
    machine, start = _Machine(rows.schema, keys, order, step, output), _dump(initial)
    base, cuts = _blocked(rows, keys, order)
    by = Window.partitionBy(*keys).orderBy(BLOCK)
    blocks = materialize(cuts.withColumn("_last", F.lead(BLOCK).over(by).isNull()), "fold-blocks")
    followed = blocks.filter("not _last").select(*machine.group, F.lit(start).alias(ENTRY))
    inner = materialize(base.join(followed.select(*machine.group), machine.group, "left_semi"), "fold-rows")
    ends = _settle(machine, inner, followed, start).select(*machine.group, END)
    entries = blocks.join(ends, machine.group, "left").withColumn(ENTRY, F.coalesce(F.lag(END).over(by), F.lit(start)))
    return machine.outputs(base, entries)
