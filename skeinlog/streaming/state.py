"""Forward-only state per session: what a batch fold carries from row to row, a stream carries from batch to batch.

The state is a few values per session (or per waiting cell), kept in Spark's state store; it never grows with the rows
seen. Sessions share ``BUCKETS`` entries of the store, since each entry that a batch touches costs a call of Python with
its own data frames, far more than its rows. Rows of a micro-batch are taken by line. A row that comes with a line before those already taken can't be folded in
any more: it is given out as ``late``, with nothing else said about it. Late timestamps are kept and reported, nothing is
dropped and no watermark is used.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinlog.functions import vocabulary as V

KEY, BUCKET = "_key", "_bucket"
#: Entries of the state store; a checkpoint is read with the number it was written with. Rows that Python takes at a time.
BUCKETS, TURN = 512, 10_000


def stateful(rows: DataFrame, keys: list[str], order: str, step: Callable[[dict, dict], dict], initial: dict, output: str) -> DataFrame:
    """A stream of the keys, the order column, ``late`` and what ``step(state, row)`` returns for each row of ``rows``."""
    taken, given = to_arrow_schema(rows.schema), T.StructType.fromDDL(output)
    schema = T.StructType([*(rows.schema[c] for c in [*keys, order]), T.StructField("late", T.BooleanType()), *given.fields])
    sent = pa.schema([pa.field(f.name, pa.string()) if pa.types.is_int64(f.type) else f for f in taken]).append(pa.field(KEY, pa.string()))
    names, nothing, start = schema.fieldNames(), dict.fromkeys(given.fieldNames()), json.dumps(initial)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        before: dict[str, int | None] = {}  # the last row of each key that earlier batches took
        batch = pa.concat_tables([pa.Table.from_pandas(p[sent.names], sent, preserve_index=False) for p in parts]).cast(taken.append(sent.field(KEY)))
        for part in batch.sort_by(order).to_batches(TURN):
            out = []
            for row in part.to_pylist():
                own, at = row.pop(KEY), row[order]
                if own not in held:
                    held[own] = {"state": json.loads(start), "last": None}
                mine = held[own]
                last = before.setdefault(own, mine["last"])
                late = last is not None and at is not None and at <= last
                out.append({**{c: row[c] for c in [*keys, order]}, "late": late, **(nothing if late else step(mine["state"], row))})
                if not late and at is not None:
                    mine["last"] = at
            yield pd.DataFrame(out, columns=names, dtype=object)
        state.update((json.dumps(held),))

    long = [f.name for f in rows.schema if isinstance(f.dataType, T.LongType)]  # as text: pandas makes floats of a column with nulls
    told = rows.withColumns({c: F.col(c).cast("string") for c in long})
    named = told.withColumn(KEY, F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys]))).withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    return named.groupBy(BUCKET).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def cache_step(state: dict, row: dict) -> dict:
    """One accounting row against the state: model, compaction generation, previous observation."""
    if row["model"]:
        state["model"] = row["model"]
    if row["is_compaction"]:
        state["generation"] += 1
    out = {"event_id": row["event_id"], "is_token": row["is_token"], "state": None, "reuse_bps": None, "previous_event_id": None, "elapsed_ms": None}
    if not row["is_token"]:
        return out
    now, cached = row["input_tokens"], row["cached_tokens"]
    if not (row["has_input"] and row["has_cached"]) or now is None or cached is None or cached > now:
        state["previous"] = None
        return out
    now, cached = int(now), int(cached)
    bps = cached * 10_000 // now if now > 0 else None
    ms = None if row["ms"] is None else int(row["ms"])
    prev, name = state["previous"], V.COMPARISON_STATES[0]
    if prev is not None:
        out["previous_event_id"] = prev["event_id"]
        name = V.COMPARISON_STATES[1]
        if ms is not None and prev["ms"] is not None and ms > prev["ms"]:
            out["elapsed_ms"] = ms - prev["ms"]
            if prev["model"] and state["model"] and prev["model"] != state["model"]:
                name = V.COMPARISON_STATES[2]
            elif prev["generation"] != state["generation"]:
                name = V.COMPARISON_STATES[3]
            else:
                gated = (prev["cached"] < V.MIN_PREVIOUS_CACHED or prev["bps"] is None or prev["bps"] < V.MIN_PREVIOUS_REUSE_BPS
                         or now * 4 < prev["input"] * 3 or cached * 2 > prev["cached"] or prev["cached"] - cached < V.MIN_CACHED_DROP)
                name = V.COMPARISON_STATES[4] if gated else V.COMPARISON_STATES[5]
    state["previous"] = {"event_id": row["event_id"], "input": now, "cached": cached, "bps": bps, "ms": ms,
                         "model": state["model"], "generation": state["generation"]}
    out.update(state=name, reuse_bps=bps)
    return out


CACHE_INITIAL = {"model": "", "generation": 0, "previous": None}
CACHE_OUTPUT = "event_id string, is_token boolean, state string, reuse_bps bigint, previous_event_id string, elapsed_ms bigint"


def cache_observations(rows: DataFrame) -> DataFrame:
    """Streaming cache observations; equal to the batch operator on the same rows."""
    return stateful(rows, ["session_id"], "line", cache_step, CACHE_INITIAL, CACHE_OUTPUT)


def scripted_operations(rows: DataFrame) -> DataFrame:
    """Waiting scripted operations over a stream: closed by a boundary row's epoch, not by time."""
    from skeinlog.operators.lifecycle import _cell_step
    return stateful(rows, ["session_id", "cell_id"], "line", _cell_step, {"open": []}, "operation string, outcome string")
