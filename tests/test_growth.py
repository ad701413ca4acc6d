"""Work that has to grow with the rows: sparse order values, long patches, large sorted tables, shared streams, records read once."""

import glob
import random
import time

import pytest
from pyspark.sql import functions as F
from test_folds import INBOX, OWNERSHIP, inbox_rows, looped, ownership_rows

from skeinlog.functions import records as R
from skeinlog.operators import folds, lifecycle
from skeinlog.session import BLOCK_ROWS_CONF
from skeinlog.sources import sinks

GOALS = "session_id string, seq bigint, operation string, goal_id string, revision int, phase string, objective string, max_rounds int, rounds int, created_at bigint, at bigint"


def goal_rows(rng, n=160):
    ops = [("create", "active"), ("edit", "active"), ("pause", "paused"), ("resume", "active"), ("complete", "complete"), ("block", "blocked"), ("clear", "active")]
    out, turn = [], {}
    for i in range(n):
        session = "hot" if i % 3 else f"s{i % 4}"
        goal, revision = turn.get(session, (0, 0))
        op, phase = ("create", "active") if revision == 0 else rng.choice(ops[1:])
        revision += 1
        out.append({"session_id": session, "seq": i, "operation": op, "goal_id": f"g{goal}", "revision": revision, "phase": phase, "objective": "o", "max_rounds": 3, "rounds": 0, "created_at": 1, "at": i})
        turn[session] = (goal + rng.choice([0, 1]), 0) if op in ("complete", "clear") else (goal, revision)
    return out


MACHINES = {
    "goals": (goal_rows, GOALS, "seq", lifecycle._goal_step, lifecycle.GOAL_START, "accepted boolean, reason string, state string"),
    "inbox": (inbox_rows, INBOX, "seq", lifecycle._inbox_step, lifecycle.INBOX_START, "operation string, ids string, enqueued_seq bigint, claimed_seq bigint"),
    "turns": (ownership_rows, OWNERSHIP, "line", lifecycle._ownership_step, lifecycle.TURN_START, "owner string, trailing boolean, conflict string, alias_of string, tier int"),
}


@pytest.mark.parametrize("apart", [1, 1_000])
@pytest.mark.parametrize("block", [6, 200])
@pytest.mark.parametrize("name", MACHINES)
def test_blocks_go_by_rows_and_not_by_order_values(spark, monkeypatch, name, block, apart):
    make, schema, order, step, initial, output = MACHINES[name]
    rows = make(random.Random(7))
    for r in rows:
        r[order] *= apart
    written = []
    keep = folds.materialize
    monkeypatch.setattr(folds, "materialize", lambda df, label: written.append(label) or keep(df, label))
    spark.conf.set(BLOCK_ROWS_CONF, str(block))
    try:
        got = folds.fold(spark.createDataFrame(rows, schema), ["session_id"], order, step, initial, output).collect()
    finally:
        spark.conf.unset(BLOCK_ROWS_CONF)
    names = [c.split()[0] for c in output.split(", ")]
    assert {(r.session_id, r[order]): tuple(r[n] for n in names) for r in got} == looped(rows, ["session_id"], order, step, initial, names)
    if block == 200:
        assert written.count("fold-ends") == 1  # no session has more rows than a block: nothing is folded again


def plain_stats(text):
    lines = [s.removesuffix("\r") for s in text.split("\n")] if text is not None else []
    first = next((i for i, s in enumerate(lines) if s.startswith("@@")), None)
    inside = lambda i: first is not None and i >= first
    return tuple(sum(s.startswith(m) and (inside(i) or not s.startswith(h)) for i, s in enumerate(lines)) for m, h in (("+", "+++"), ("-", "---")))


def test_diff_stats_of_odd_and_of_long_patches(spark):
    rng = random.Random(2)
    pieces = ["+", "-", "+++ b", "--- a", "@@", "@@+x", "@@ -1 +1 @@", " @@", "", "keep", "++", "--", "-@@", " +", "\U0001f600", "+\r", "@@\r", "x\r+y"]
    texts = [None, "", "+", "@@", "@@\n+++", "+++\n@@\n+++\r\n---"] + [rng.choice(["\n", "\r\n"]).join(rng.choices(pieces, k=rng.randrange(1, 12))) for _ in range(400)]
    texts.append("--- a\n+++ b\n@@ -1 +1 @@\n" + "+new\n-old\n keep\n" * 20_000)  # was read once a line
    begin = time.time()
    rows = spark.createDataFrame([*enumerate(texts)], "i int, text string").select("i", R.diff_stats(F.col("text")).alias("s")).collect()
    assert {r.i: (r.s.added, r.s.removed) for r in rows} == {i: plain_stats(t) for i, t in enumerate(texts)}
    assert time.time() - begin < 60


def test_projection_is_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SORTED_BYTES", 100_000)
    rows = spark.range(2_000).selectExpr("'main' as layer", "cast(id % 3 as string) as session_id", "id as line", "repeat('lorem ipsum ', 50) as search_text")
    sinks.write_projection(rows, str(tmp_path / "p"))
    assert len(glob.glob(f"{tmp_path}/p/layer=main/*.parquet")) >= 10
    assert sinks.scan_projection(spark, str(tmp_path / "p"), "main", "1").count() == 667
    sinks.write_projection(rows.limit(0), str(tmp_path / "none"))


def plain_streams(rows, limit):
    found = {}
    for event, stream in rows:
        for pos, (kind, block, text) in enumerate(stream or []):
            found.setdefault((event, block), []).append((pos, kind, text))
    out = []
    for (event, block), parts in found.items():
        ends = [(pos, text) for pos, kind, text in parts if kind == "block-end"]
        done = min(ends, key=lambda e: e[0])[1] if ends else None
        deltas = sorted((pos, text) for pos, kind, text in parts if kind == "delta" and text is not None)
        out.append((event, block, min(p[0] for p in parts), sum(kind == "delta" for _, kind, _ in parts), ("".join(t for _, t in deltas) if done is None else done)[:limit], done is not None))
    return out


def test_streams_are_cut_in_place(spark):
    rng = random.Random(11)
    rows = [(e, [(rng.choice(["delta", "delta", "delta", "block-end", "other", None]), rng.choice(["x", "y", None]), rng.choice(["a", "bc", "", None])) for _ in range(rng.randrange(14))]) for e in range(60)]
    rows = [(e, [(k, b, f"end{e}" if k == "block-end" and t is not None else t) for k, b, t in s]) for e, s in rows]
    shared = [(100, [("delta", "x", "b"), ("delta", "x", "d")]), (100, [("delta", "x", "a"), ("delta", "x", None), ("delta", "y", "z")]), (None, [("delta", "x", "q")]), (None, [("delta", "x", "p")])]
    given = [*rows, *shared, (200, None), (201, [])]
    got = lifecycle.embedded_stream(spark.createDataFrame(given, "event_id int, stream array<struct<kind:string,block:string,text:string>>"), 5)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, plain_streams(given, 5)))
    assert "posexplode" not in got._jdf.queryExecution().toString()


def test_records_are_parsed_once_for_calls_and_others(spark):
    from skeinlog.functions.classify import tool_dimension
    from skeinlog.sources import codex, files
    call = '{"type":"response_item","payload":{"type":"function_call","call_id":"c%d","name":"exec_command","arguments":"{}"}}'
    said = '{"type":"event_msg","payload":{"type":"user_message","message":"hi %d"}}'
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text
    lines = spark.createDataFrame([("s", "f", i, (call if i % 2 else said) % (i // 4)) for i in range(40)], "session_id string, file string, line bigint, text string")
    raw = codex.to_raw(files.parsed(lines.withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))))
    events = codex.to_logical(raw, tool_dimension(spark)).collect()
    assert sorted((r.line, r.kind) for r in events if r.kind == "user_message") == [(i, "user_message") for i in range(0, 40, 2)]
    assert sum(r.kind != "user_message" for r in events) == 10
    assert read.value == 40
