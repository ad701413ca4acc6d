import random

import pytest
from pyspark.sql import functions as F

from skeinlog.operators import graph, ordered, prefixes


@pytest.fixture(params=["1000", "9"])
def blocks(spark, request):
    spark.conf.set("spark.skeinlog.block.rows", request.param)
    yield
    spark.conf.unset("spark.skeinlog.block.rows")


def sequences(seed=5):
    rng = random.Random(seed)
    rows = [("hot", p, rng.randrange(50), rng.choice([None, "x", "y", "z"])) for p in range(0, 400, 2)]  # every other position is empty
    rows += [(f"s{i}", p, rng.randrange(50), rng.choice([None, "x"])) for i in range(8) for p in range(rng.randrange(1, 12))]
    cuts = [("hot", rng.randrange(-2, 420)) for _ in range(300)] + [(f"s{i}", rng.randrange(14)) for i in range(9)] + [("hot", None)]
    return rows, cuts


def frames(spark, rows, cuts):
    return spark.createDataFrame(rows, "k string, pos long, v long, t string"), spark.createDataFrame(cuts, "k string, cut long")


def specs():
    return dict(n=ordered.RowNumber(), total=ordered.RunningSum(F.col("v")), low=ordered.RunningMin(F.col("v")), high=ordered.RunningMax(F.col("v")), last=ordered.LastValue(F.col("t")))


@pytest.mark.parametrize("side", ["before", "since"])
def test_facts_equal_a_plain_loop(spark, blocks, side):
    rows, cuts = sequences()
    got = getattr(prefixes, side)(*frames(spark, rows, cuts), ["k"], **specs()).collect()
    known = {r[0] for r in rows}
    want = []
    for k, cut in {c for c in cuts if c[1] is not None and c[0] in known}:
        held = sorted(r for r in rows if r[0] == k and (r[1] < cut if side == "before" else r[1] >= cut))
        if side == "since":
            held.reverse()
        texts, values = [r[3] for r in held if r[3] is not None], [r[2] for r in held]
        want.append((k, cut, len(held), sum(values), min(values, default=None), max(values, default=None), texts[-1] if texts else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_last_rows_before_each_cut(spark, blocks):
    rows, cuts = sequences(6)
    got = prefixes.last_before(*frames(spark, rows, cuts), ["k"], 5).select("k", "cut", "place", "pos", "v").collect()
    want = [(k, cut, i, r[1], r[2]) for k, cut in {c for c in cuts if c[1] is not None}
            for i, r in enumerate(sorted((r for r in rows if r[0] == k and r[1] < cut), key=lambda r: r[1])[-5:], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_parent_of_many_forks(spark, blocks):
    rng = random.Random(8)
    events = [("p", i, rng.choice(["main", "main", "protocol"]), rng.choice(["", f"2024-01-01T00:{i // 60:02}:{i % 60:02}Z"]), f"e{i}", rng.random() < 0.5) for i in range(150)]
    forks = [(f"c{i}", "p", rng.randrange(1, 160)) for i in range(400)]
    e = spark.createDataFrame(events, "session_id string, pos long, layer string, ts_text string, event_id string, has_text boolean")
    f = spark.createDataFrame(forks, "session_id string, parent_id string, matched long")
    summary, shown = {}, []
    for child, _, matched in forks:
        head = events[:matched]
        main = [r for r in head if r[2] != "protocol"]
        spoken = [r[4] for r in main if r[5]]
        summary[child] = (len(main), len(head) - len(main), min(12, len(main)), max(0, len(main) - 12), head[0][3], head[-1][3], spoken[-1] if spoken else head[-1][4])
        shown += [(child, i, r[4]) for i, r in enumerate(main[-12:], 1)]
    got = graph.inherited_summary(e, f).collect()
    assert {r.session_id: tuple(r)[2:] for r in got} == summary and len(got) == len(forks)
    assert sorted(map(tuple, graph.inherited_previews(e, f).select("session_id", "place", "event_id").collect())) == sorted(shown)


def test_forks_end_where_the_parent_goes_on_later(spark, blocks):
    at, late, early = "2024-01-02", "2024-01-03", "2024-01-01"
    parents = [("p", 0, early, "a"), ("p", 1, early, "b"), ("p", 2, late, "c"), ("p", 3, late, "a"), ("u", 0, early, "a"), ("u", 1, "", "b")]
    prefix = [("later", "p", 2), ("shape", "p", 1), ("same", "p", 1), ("whole", "p", 4), ("untimed", "u", 1), ("none", "p", 0)]
    heads = [(c, 0, at, "meta") for c, _, _ in prefix] + [("shape", 2, early, "z"), ("same", 2, early, "b"), ("untimed", 2, late, "z")]
    rows = "session_id string, pos long, ts_text string, shape string"
    got = graph.confirmed_forks(spark.createDataFrame(prefix, "session_id string, parent_id string, matched long"),
                                spark.createDataFrame(heads, rows), spark.createDataFrame(parents, rows)).collect()
    assert sorted((r.session_id, r.matched, r.forked_at) for r in got) == [("later", 2, at), ("shape", 1, at), ("whole", 4, at)]


def test_empty_tables(spark):
    rows, cuts = frames(spark, [], [])
    assert prefixes.before(rows, cuts, ["k"], **specs()).count() == prefixes.last_before(rows, cuts, ["k"], 3).count() == 0
