import json
import os
import random

from pyspark.sql import functions as F

from given import ROOT
from skeinlog.functions import numbers
from skeinlog.operators import cache, lifecycle
from skeinlog.plans.cache_queries import accounting_rows
from skeinlog.streaming import ingest, state
from test_folds import OWNERSHIP, looped, ownership_rows


def drained(stream, spark, tmp_path):
    path = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def in_parts(rows, cuts, source):
    for lo, hi in cuts:
        rows.filter((F.col("line") >= lo) & (F.col("line") < hi)).coalesce(1).write.mode("append").parquet(str(source))
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    rows = accounting_rows(spark, ROOT).withColumn("ms", numbers.epoch_ms(F.col("ts_text"))).drop("turn_id", "ts_text")
    stream = in_parts(rows, [(0, 300), (300, 301), (301, 1000)], tmp_path / "in")
    found = drained(state.cache_observations(stream), spark, tmp_path).filter("is_token").collect()
    got = {r.event_id: (r.state, r.reuse_bps, r.previous_event_id, r.elapsed_ms) for r in found}
    batch = cache.observe(accounting_rows(spark, ROOT)).collect()
    assert got == {r.event_id: (r.state, r.reuse_bps, r.previous_event_id, r.elapsed_ms) for r in batch} and not any(r.late for r in found)


def test_any_step_in_parts_equals_one_run_and_late_rows_are_named(spark, tmp_path):
    rows = ownership_rows(random.Random(6), 90)

    def step(held, row):
        made = lifecycle._ownership_step(held, row)
        return {n: made[n] for n in ("owner", "conflict")}
    table = spark.createDataFrame(rows, OWNERSHIP)
    stream = in_parts(table, [(0, 30), (30, 31), (31, 90), (10, 12)], tmp_path / "in")
    found = drained(state.stateful(stream, ["session_id"], "line", step, lifecycle.TURN_START, "owner string, conflict string"), spark, tmp_path).collect()
    assert {(r.session_id, r.line): (r.owner, r.conflict) for r in found if not r.late} == looped(rows, ["session_id"], "line", lifecycle._ownership_step, lifecycle.TURN_START, ["owner", "conflict"])
    assert sum(r.late for r in found) == sum(10 <= r["line"] < 12 for r in rows)


def test_many_keys_share_few_entries_of_the_store(spark, tmp_path, monkeypatch):
    """Each entry costs a call of Python, so their number must not grow with the keys."""
    monkeypatch.setattr(state, "BUCKETS", 4)
    big = 2 ** 60 + 1
    rows = [(f"s{i % 40}" if i % 9 else None, None if i % 7 == 0 else big + i % 2, i, None if i % 5 == 0 else big + i) for i in range(300)]

    def step(held, row):
        held["n"] += 1
        return {"n": held["n"], "seen": row["big"]}
    table = spark.createDataFrame(rows, "session_id string, cell long, line long, big long")
    stream = in_parts(table, [(0, 200), (200, 300)], tmp_path / "in")
    found = drained(state.stateful(stream, ["session_id", "cell"], "line", step, {"n": 0}, "n int, seen long"), spark, tmp_path).collect()
    counts, want = {}, set()
    for session, cell, line, value in rows:
        counts[session, cell] = counts.get((session, cell), 0) + 1
        want.add((session, cell, line, False, counts[session, cell], value))
    assert {tuple(r) for r in found} == want and len(found) == len(rows)
    assert len(counts) > 70 and 0 < spark.read.format("statestore").load(str(tmp_path / "log")).count() <= 4


def numbers_of(taken):
    return sorted(json.loads(r.text)["n"] for r in taken.lines().collect())


def test_growing_and_rewritten_files(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    one, two = root / "one.jsonl", root / "two.jsonl"
    taken = ingest.GrowingFiles(spark, str(root), str(tmp_path / "store"))
    one.write_text('{"n":1}\n{"n":2}\n{"n":')
    assert len(taken.take_in(1)) == 1 and numbers_of(taken) == [1, 2]
    one.write_text('{"n":1}\n{"n":2}\n{"n":3}\n')  # appended to
    two.write_text('{"n":9}\n')
    assert len(taken.take_in(2)) == 2 and numbers_of(taken) == [1, 2, 3, 9]
    assert taken.take_in(3) == [] and numbers_of(taken) == [1, 2, 3, 9]
    one.write_text('{"n":7}\n{"n":2}\n{"n":3}\n' + " " * 9000 + '\n{"n":4}\n'.replace("\n", "", 1))  # changed far above the end
    again = ingest.GrowingFiles(spark, str(root), str(tmp_path / "store"))  # after a restart
    assert len(again.take_in(4)) == 1
    assert sorted(r.text.strip() for r in again.lines().collect()) == ['{"n":2}', '{"n":3}', '{"n":4}', '{"n":7}', '{"n":9}']
    again.take_in(4)  # a step that is run again
    assert again.lines().count() == 5 and again.manifest().count() == 2


def test_a_rewrite_of_equal_size_and_time_shows_by_content(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    path = root / "x.jsonl"
    path.write_text('{"n":1}\n')
    taken = ingest.GrowingFiles(spark, str(root), str(tmp_path / "store"))
    taken.take_in(1)
    stat = os.stat(path)
    path.write_text('{"n":5}\n')
    os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert taken.take_in(2) == [] and len(taken.take_in(3, by_content=True)) == 1 and numbers_of(taken) == [5]


def test_session_sink_adds_within_a_generation_and_replaces_below_it(spark, tmp_path):
    path, put = str(tmp_path / "s"), ingest.session_sink(str(tmp_path / "s"))
    rows = lambda *some: spark.createDataFrame(some, "session_id string, generation int, line int")
    put(rows(("a", 0, 1), ("a", 0, 2), ("b", 0, 1)), 0)
    put(rows(("a", 0, 3)), 1)
    put(rows(("a", 0, 3)), 1)  # the batch comes twice
    see = lambda: sorted((r.session_id, r.line) for r in ingest.current_sessions(spark, path).collect())
    assert see() == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    put(rows(("a", 1, 1)), 2)
    assert see() == [("a", 1), ("b", 1)]
