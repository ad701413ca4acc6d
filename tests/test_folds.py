"""Parallel folds against the same machine run in one loop, and the machines against written-out cases."""

import json
import random

import pytest

from skeinlog.operators import lifecycle
from skeinlog.operators.folds import fold
from skeinlog.session import BLOCK_ROWS_CONF


def looped(rows, keys, order, step, initial, names):
    out = {}
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    for key, mine in groups.items():
        state = json.loads(json.dumps(initial))
        for r in sorted(mine, key=lambda x: x[order]):
            made = step(state, r)
            out[(*key, r[order])] = tuple(made[n] for n in names)
    return out


def ownership_rows(rng, n=160):
    parts = ["started", "completed", "context", "rollback", "user", "other", "other"]
    return [{"session_id": "hot" if i % 3 else f"s{i % 4}", "line": i, "event_id": f"e{i}", "part": rng.choice(parts),
             "turn_id": rng.choice(["", "a", "b"]), "envelope": rng.choice("xy"), "text": rng.choice("pq")} for i in range(n)]


def inbox_rows(rng, n=120):
    rows = []
    for i in range(n):
        kind = rng.choice(["enqueue", "claim", "message"])
        rows.append({"session_id": "hot" if i % 3 else f"s{i % 4}", "seq": i, "part": "message" if kind == "message" else "splice", "target": "next-turn",
                     "start": 0, "removed": 1 if kind == "claim" else 0, "inserted": f"m{i}" if kind == "enqueue" else None, "canceled": False,
                     "message_id": f"m{i - rng.choice([1, 2, 3])}"})
    return rows


OWNERSHIP = "session_id string, line bigint, event_id string, part string, turn_id string, envelope string, text string"
INBOX = "session_id string, seq bigint, part string, target string, start int, removed int, inserted string, canceled boolean, message_id string"


@pytest.mark.parametrize("block", [4, 1000])
@pytest.mark.parametrize("seed", [3, 4])
def test_turn_machine_in_blocks_equals_loop(spark, block, seed):
    rows = ownership_rows(random.Random(seed))
    initial = lifecycle.TURN_START
    spark.conf.set(BLOCK_ROWS_CONF, str(block))
    try:
        got = fold(spark.createDataFrame(rows, OWNERSHIP), ["session_id"], "line", lifecycle._ownership_step, initial,
                   "owner string, trailing boolean, conflict string, alias_of string, tier int").collect()
    finally:
        spark.conf.unset(BLOCK_ROWS_CONF)
    names = ["owner", "trailing", "conflict", "alias_of", "tier"]
    assert {(r.session_id, r.line): tuple(r[n] for n in names) for r in got} == looped(rows, ["session_id"], "line", lifecycle._ownership_step, initial, names)


@pytest.mark.parametrize("block", [4, 1000])
def test_inbox_machine_in_blocks_equals_loop(spark, block):
    rows = inbox_rows(random.Random(5))
    initial = lifecycle.INBOX_START
    spark.conf.set(BLOCK_ROWS_CONF, str(block))
    try:
        got = lifecycle.inbox_replay(spark.createDataFrame(rows, INBOX)).collect()
    finally:
        spark.conf.unset(BLOCK_ROWS_CONF)
    names = ["operation", "ids", "enqueued_seq", "claimed_seq"]
    assert {(r.session_id, r.seq): tuple(r[n] for n in names) for r in got} == looped(rows, ["session_id"], "seq", lifecycle._inbox_step, initial, names)


def test_implicit_turn_gets_its_name_later(spark):
    rows = [("s", 1, "e1", "user", "", "x", "hi"), ("s", 2, "e2", "other", "", "x", ""), ("s", 3, "e3", "context", "t1", "x", ""),
            ("s", 4, "e4", "completed", "t1", "x", ""), ("s", 5, "e5", "other", "", "x", ""), ("s", 6, "e6", "completed", "t9", "x", "")]
    got = {r.line: r for r in lifecycle.turn_ownership(spark.createDataFrame(rows, OWNERSHIP)).collect()}
    assert {got[i].owner for i in (1, 2, 3, 4, 5)} == {"explicit:t1"}
    assert got[1].evidence == "legacy_turn_context" and got[5].trailing
    assert got[6].owner == "" and got[6].conflict == "completion_without_active_turn"


def test_inbox_provenance_and_bad_splice(spark):
    def row(seq, part, **more):
        return {"session_id": "s", "seq": seq, "part": part, "target": "next-turn", "start": 0, "removed": 0, "inserted": None, "canceled": False, "message_id": None, **more}
    rows = [row(1, "splice", inserted="m1"), row(2, "splice", removed=1), row(3, "message", message_id="m1"), row(4, "message", message_id="m1"),
            row(5, "splice", removed=2), row(6, "splice", inserted="m2")]
    got = {r.seq: r for r in lifecycle.inbox_replay(spark.createDataFrame(rows, INBOX)).collect()}
    assert [got[i].operation for i in (1, 2, 3, 4, 5, 6)] == ["enqueue", "claim", "delivered", "", "", ""]
    assert (got[3].enqueued_seq, got[3].claimed_seq) == (1, 2)


def test_task_snapshot_is_news_only_when_it_differs(spark):
    def items(status):
        return json.dumps([{"id": "1", "subject": "do", "status": status}])
    schema = "session_id string, line bigint, part string, task_id string, subject string, status string, items string"
    rows = [("s", 1, "create", "1", "do", "pending", None), ("s", 2, "snapshot", None, None, None, items("pending")), ("s", 3, "snapshot", None, None, None, items("completed")),
            ("s", 4, "snapshot", None, None, None, items("completed")), ("s", 5, "update", "1", "", "deleted", None), ("s", 6, "snapshot", None, None, None, items("completed"))]
    got = {r.line: r.novel for r in lifecycle.task_states(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True}


def plain_tasks(state, row):
    """The task list kept whole, row by row."""
    tasks = state["tasks"]
    if row["part"] == "snapshot":
        try:
            listed = {i.get("id"): (i.get("subject"), i.get("status")) for i in json.loads(row["items"])}
        except (TypeError, ValueError):
            listed = {}
        novel = listed != tasks
        state["tasks"] = listed
        return {"novel": novel, "tasks": len(listed)}
    if row["status"] == "deleted":
        tasks.pop(row["task_id"], None)
    else:
        name = "Task" + (f" #{row['task_id']}" if row["task_id"] is not None else " ")
        subject, status = tasks.get(row["task_id"], (name, ""))
        tasks[row["task_id"]] = (row["subject"] or subject, row["status"] or status)
    return {"novel": False, "tasks": len(tasks)}


@pytest.mark.parametrize("block", [4, 1000])
@pytest.mark.parametrize("shots", [0, 1, 6])
def test_task_lists_equal_a_plain_loop(spark, block, shots):
    rng = random.Random(shots)
    rows = []
    for i in range(240):
        mine = [{"id": t, "subject": rng.choice(["do", "go"]), "status": "pending"} for t in rng.sample("1234", rng.randrange(3))]
        if mine and rng.random() < 0.2:
            mine.append({"id": mine[0]["id"], "status": "completed"})  # the id again, without a subject
        shot = rng.randrange(10) < shots
        rows.append({"session_id": "hot" if i % 3 else f"s{i % 4}", "line": i, "part": "snapshot" if shot else rng.choice(["create", "update"]), "task_id": rng.choice(["1", "2", "3", None]),
                     "subject": rng.choice(["", None, "do", "go"]), "status": rng.choice(["", None, "pending", "deleted"]), "items": rng.choice([json.dumps(mine)] * 4 + ["[]", "no list", None])})
    again = [dict(r, line=r["line"] + 0.5) for r in rows if r["part"] == "snapshot" and rng.random() < 0.5]  # a snapshot twice is no news
    rows = [dict(r, line=i) for i, r in enumerate(sorted(rows + again, key=lambda r: r["line"]))]
    schema = "session_id string, line bigint, part string, task_id string, subject string, status string, items string"
    spark.conf.set(BLOCK_ROWS_CONF, str(block))
    try:
        got = lifecycle.task_states(spark.createDataFrame(rows, schema)).collect()
    finally:
        spark.conf.unset(BLOCK_ROWS_CONF)
    assert {(r.session_id, r.line): (r.novel, r.tasks) for r in got} == looped(rows, ["session_id"], "line", plain_tasks, {"tasks": {}}, ["novel", "tasks"])


def test_waits_on_a_cell(spark):
    schema = "session_id string, cell_id string, line bigint, epoch bigint, part string, operation_id string, call_epoch bigint, call_id string, pending boolean"
    rows = [("s", "1", 1, 0, "exec", "op1", 0, "", True), ("s", "1", 2, 0, "wait", "", 0, "w1", None), ("s", "1", 3, 0, "wait", "", 0, "w2", None),
            ("s", "1", 4, 0, "result", "", 0, "w1", False), ("s", "1", 5, 0, "wait", "", 0, "w3", None), ("s", "2", 6, 0, "exec", "op2", 0, "", True),
            ("s", "2", 7, 1, "wait", "", 1, "w4", None), ("s", "3", 8, 1, "exec", "op3", 1, "", True), ("s", "3", 9, 1, "exec", "op4", 1, "", True), ("s", "3", 10, 1, "wait", "", 1, "w5", None)]
    got = {r.line: (r.operation, r.outcome) for r in lifecycle.scripted_operations(spark.createDataFrame(rows, schema)).collect()}
    assert got[2] == ("op1", "waiting") and got[3] == (None, "concurrent_wait") and got[4] == ("op1", "terminal")
    assert got[5] == (None, "orphan_cell") and got[7] == (None, "orphan_cell") and got[10] == (None, "ambiguous_cell")
