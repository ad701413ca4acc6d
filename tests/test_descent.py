import random

import pytest
from pyspark.sql import functions as F

from skeinlog.operators import dispatches, graph, lifecycle


def climbed(up, ancestor, point, twice):
    seen = set()
    while point is not None and point not in seen:
        if point == ancestor:
            return ancestor in up and ancestor not in twice  # an ancestor is one known record
        if point in twice or point not in up:
            return False
        seen.add(point)
        point = up[point]
    return False


@pytest.mark.parametrize("seed", range(3))
def test_conflicts_reach_all_below(spark, seed):
    rng = random.Random(seed)
    edges = [(n, rng.randrange(n)) for n in range(1, 150)] + [(n, rng.randrange(150)) for n in rng.sample(range(1, 150), 20)] + [(500, 501), (501, 500), (0, None)]
    bad = {n for n in range(150) if rng.random() < 0.03} | {7, 900}
    want, more = set(bad), True
    while more:
        more = {n for n, p in edges if p in want} - want
        want |= more
    found = graph.propagate_conflicts(spark.createDataFrame(edges, "node long, parent long"), spark.createDataFrame([(b,) for b in bad], "node long"))
    assert sorted(r.node for r in found.collect()) == sorted(want)


def test_conflicts_down_a_long_chain(spark, monkeypatch):
    rounds = []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: rounds.append(label) or keep(df, label))
    edges = spark.range(1, 10_000).selectExpr("id as node", "id - 1 as parent")
    assert graph.propagate_conflicts(edges, spark.createDataFrame([(10,)], "node long")).count() == 9_990
    assert len(rounds) <= 16


@pytest.mark.parametrize("seed", range(2))
def test_descendants_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = [("s", str(n), None if n == 0 else str(rng.randrange(max(0, n - 3), n))) for n in range(90)]
    rows += [("s", "12", "11"), ("s", "c1", "c2"), ("s", "c2", "c1"), ("s", "lost", "none"), ("s", "under", "lost"), ("t", "5", None)]
    up, twice = {u: p for s, u, p in rows if s == "s"}, {"12"}
    up["12"] = min(p for s, u, p in rows if u == "12")
    pairs = [("s", str(rng.randrange(90)), str(rng.randrange(90))) for _ in range(400)] + [("s", "lost", "under"), ("s", "under", "lost"), ("s", "none", "lost"), ("t", "5", "5"), ("t", "5", "6"), ("s", "c1", "5")]
    found = graph.descendants(spark.createDataFrame(rows, "session_id string, uuid string, parent_uuid string"), spark.createDataFrame(pairs, "session_id string, ancestor string, point string"))
    want = {(s, a, p) for s, a, p in pairs if (s == "s" and climbed(up, a, p, twice)) or (s, a, p) == ("t", "5", "5")}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 40


def test_a_dispatch_chain_of_ten_thousand(spark, monkeypatch):
    rounds = []
    keep = dispatches.materialize
    monkeypatch.setattr(dispatches, "materialize", lambda df, label: rounds.append(label) or keep(df, label))
    nodes = spark.range(1, 10_001).selectExpr("'s' as session_id", "concat('d', id) as node_id", "'r' as root_id", "if(id = 1, 'r', concat('d', id - 1)) as parent_id", "'Read' as name", "id as seq", "'' as reason")
    calls = spark.createDataFrame([("s", "r", "bash", 0), ("s", "r", "RUN_CODE", 1)], "session_id string, call_id string, name string, seq long")
    got = {r.node_id: r for r in dispatches.depths(nodes, calls).collect()}
    assert all(got[f"d{i}"].chain == i for i in (1, 2, 255, 256, 257, 9_999, 10_000)) and len(rounds) <= 16
    assert got["d256"].depth == 256 and got["d256"].reason == "" and got["d257"].depth is None
    assert got["d257"].reason == "dispatch ancestry exceeds the supported depth for d257"


def test_dispatch_identities(spark):
    rows = [("a", 1, "start", "r", "r", "{}"), ("a", 5, "end", "r", "r", "{}"), ("b", 3, "end", "r", "a", None), ("c", 4, "start", "r", "a", "1"), ("c", 6, "end", "r", "a", "2"),
            ("d", 9, "start", "r", "b", None), ("d", 8, "end", "r", "b", None), ("e", 2, "start", "r", "b", None), ("f", 10, "start", "q", "q", None), ("g", 11, "start", "r", "c", None), ("", 12, "end", "r", "r", None), ("h", 13, "start", "r", "h", None)]
    table = spark.createDataFrame([("s", s, p, n, r, u, "Read", a) for n, s, p, r, u, a in rows], "session_id string, seq long, part string, node_id string, root_id string, parent_id string, name string, arguments string")
    calls = spark.createDataFrame([("s", "r", "run_code", 0)], "session_id string, call_id string, name string, seq long")
    got = {r.node_id: (r.depth, r.reason) for r in dispatches.depths(dispatches.identities(table), calls).collect()}
    assert got == {
        "a": (1, ""), "b": (2, ""), "c": (None, "ambiguous dispatch identity c"), "d": (None, "settlement precedes start for d"), "e": (None, "parent b is not an earlier dispatch in root r"),
        "f": (None, "root q is not an outer run_code call"), "g": (None, "parent c is not an earlier dispatch in root r"), None: (None, "missing durable dispatch identity"), "h": (None, "cyclic dispatch ancestry at h")}
    assert dispatches.depths(dispatches.identities(table.limit(0)), calls).count() == 0


def test_dispatches_are_sorted_in_parts_of_a_block(spark, tiny_blocks, monkeypatch):
    """No task gets a share that grows with the table; flat, nested and broken ones keep their places."""
    held, keep = {}, dispatches.materialize
    monkeypatch.setattr(dispatches, "materialize", lambda df, label: held.setdefault(label, keep(df, label)) if label == "dispatch-identities" else keep(df, label))
    rows = [("s", 2 * i, "start", f"d{i}", "r", "r" if i < 20 or i % 10 == 0 else f"d{i - 1}", "Read", None) for i in range(60)] + [("s", 99, "end", "d7", "r", "r", "Read", None), ("s", 200, "start", None, "r", "r", "Read", None)]
    table = spark.createDataFrame(rows, "session_id string, seq long, part string, node_id string, root_id string, parent_id string, name string, arguments string")
    calls = spark.createDataFrame([("s", "r", "run_code", 0)], "session_id string, call_id string, name string, seq long")
    got = {r.node_id: (r.chain, r.reason) for r in dispatches.depths(dispatches.identities(table), calls).collect()}
    assert got == {f"d{i}": (1 if i < 20 else i % 10 + 1, "") for i in range(60)} | {None: (None, "missing durable dispatch identity")}
    shares = held["dispatch-identities"].groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in shares) == 61 and max(r["count"] for r in shares) <= 20


def test_goals_by_descent(spark):
    """One goal a condition; the last column of each row group says what the goal must become."""
    records, rows, want = [], [], {}

    def goal(name, status, hooks, errors, *parts):
        for uuid, up, part, more in parts:
            records.append(("s", f"{name}{uuid}", up and f"{name}{up}"))
            if part:
                rows.append(("s", name, len(records), f"{name}{uuid}", up and f"{name}{up}", part, more.get("valid", True), more.get("errors", 0), more.get("tool", "t"), "complete" if part == "terminal" else None))
        want[name] = (status, hooks, errors)
    start = ("0", None, "initial", {})
    goal("open", "active", 1, 0, start, ("1", "0", None, {}), ("2", "1", "hook", {}))
    goal("done", "complete", 2, 1, start, ("e", "0", "error", {}), ("1", "e", "hook", {"errors": 1}), ("2", "1", "terminal", {}), ("3", "2", "hook", {}))
    goal("late", "complete", 0, 0, start, ("1", "0", "terminal", {}), ("2", "1", None, {}), ("3", "2", "hook", {}))
    goal("aside", "active", 0, 0, start, ("x", None, None, {}), ("1", "x", "hook", {"valid": False}))
    goal("astray", "fallback", 0, 0, start, ("x", None, None, {}), ("1", "x", "terminal", {}))
    goal("twice", "fallback", 0, 0, start, ("1", "0", "initial", {}))
    goal("odd", "fallback", 0, 0, start, ("1", "0", "invalid", {}))
    goal("broken", "fallback", 0, 0, start, ("1", "0", "hook", {"valid": False}))
    goal("stray", "fallback", 0, 0, start, ("e", "0", "error", {}), ("1", "0", "hook", {}))
    goal("uncounted", "fallback", 0, 0, start, ("e", "0", "error", {}), ("1", "e", "hook", {}))
    goal("lacking", "fallback", 0, 0, start, ("1", "0", "hook", {"errors": 1}))
    goal("other", "fallback", 0, 0, start, ("e", "0", "error", {"tool": "u"}), ("1", "e", "hook", {"errors": 1}))
    goal("many", "fallback", 0, 0, start, ("e", "0", "error", {}), ("1", "e", "hook", {"errors": 2}))
    goal("copied", "active", 0, 0, start, ("1", "0", None, {}), ("1", "0", None, {}), ("2", "1", "hook", {"valid": False}))
    types = "session_id string, condition string, line long, uuid string, parent_uuid string, part string, valid boolean, errors int, tool_use_id string, state string"
    table = spark.createDataFrame(rows, types)
    found = lifecycle.goals_by_descent(table, spark.createDataFrame(records, "session_id string, uuid string, parent_uuid string"))
    assert {r.condition: (r.status, r.hooks, r.hook_errors) for r in found.collect()} == want
    assert lifecycle.goals_by_descent(table.limit(0), spark.createDataFrame([], "session_id string, uuid string, parent_uuid string")).count() == 0
