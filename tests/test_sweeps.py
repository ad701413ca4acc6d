import random

import pytest

from skeinlog.operators import pairing, sweeps


def seeded(n, seed=1):
    return random.Random(seed), range(n)


@pytest.mark.parametrize("block", ["1000", "7"])
def test_sole_owner_with_text_owners(spark, block):
    rng, many = seeded(120)
    ranges = [(rng.randrange(2), lo := rng.randrange(200), lo + rng.randrange(12), f"s{rng.randrange(9)}") for _ in many]
    points = [(f, line, i) for i, (f, line) in enumerate([(rng.randrange(2), rng.randrange(220)) for _ in range(150)] * 2)]
    spark.conf.set("spark.skeinlog.block.rows", block)
    try:
        got = sweeps.sole_owner(spark.createDataFrame(points, "file long, line long, id long"), spark.createDataFrame(ranges, "file long, start long, end long, owner string"), ["file"]).collect()
    finally:
        spark.conf.unset("spark.skeinlog.block.rows")
    def plain(f, line):
        held = [r[3] for r in ranges if r[0] == f and r[1] <= line <= r[2]]
        return len(held), held[0] if len(held) == 1 else None
    assert sorted((r.file, r.line, r.id, r.open, r.owner) for r in got) == sorted(((f, line, i, *plain(f, line)) for f, line, i in points), key=lambda r: r[:3])


@pytest.mark.parametrize("block", ["1000", "5"])
def test_sole_container_of_events_with_several_lines(spark, block):
    rng, many = seeded(80, 2)
    spans = [("a" if rng.random() < 0.5 else "b", lo := rng.randrange(100), lo + rng.choice([0, 3, 9, 60]), f"p{i}") for i in many]
    events = [(rng.choice("ab"), f"e{i}", lo := rng.randrange(120), lo + rng.choice([0, 0, 2, 20])) for i in range(300)]
    spark.conf.set("spark.skeinlog.block.rows", block)
    try:
        got = sweeps.sole_container(spark.createDataFrame(events, "file string, event_id string, min_line long, max_line long"), spark.createDataFrame(spans, "file string, start long, end long, span_id string"), ["file"]).collect()
    finally:
        spark.conf.unset("spark.skeinlog.block.rows")
    want = {}
    for f, e, lo, hi in events:
        held = [s[3] for s in spans if s[0] == f and s[1] <= lo and s[2] >= hi]
        if len(held) == 1:
            want[e] = held[0]
    assert {(r.event_id, r.span_id) for r in got} == set(want.items()) and len(got) == len(want) and want


@pytest.mark.parametrize("widest", [0, 1, 6, 40])
def test_extremes_equal_a_plain_loop(spark, widest):
    rng, _ = seeded(0, widest)
    marks = [(rng.randrange(2), rng.randrange(-60, 60), rng.randrange(30), f"v{rng.randrange(40):02}") for _ in range(150)]
    asks = [(rng.randrange(2), i, lo := rng.randrange(-70, 70), lo + rng.randrange(-1, widest + 1), rng.randrange(-1, 31)) for i in range(200)]
    got = sweeps.extremes(spark.createDataFrame(marks, "k long, at long, by long, value string"), spark.createDataFrame(asks, "k long, ask_id long, low long, high long, upto long"), ["k"], widest)
    want = set()
    for k, i, lo, hi, upto in asks:
        some = [m[3] for m in marks if m[0] == k and lo <= m[1] <= hi and m[2] <= upto]
        if some:
            want.add((i, min(some), max(some)))
    assert {tuple(r) for r in got.collect()} == want and want


@pytest.mark.parametrize("width", [0, 1, 7, 40])
def test_extremes_near_equal_a_plain_loop(spark, width):
    rng, _ = seeded(0, width)
    marks = [(rng.randrange(2), rng.randrange(-60, 60), f"v{rng.randrange(90):02}") for _ in range(60)]
    asks = [(rng.randrange(2), i, rng.randrange(-70, 70)) for i in range(200)]
    got = sweeps.extremes_near(spark.createDataFrame(marks, "k long, at long, value string"), spark.createDataFrame(asks, "k long, ask_id long, low long"), ["k"], width)
    held = {i: [m[2] for m in marks if m[0] == k and low <= m[1] <= low + width] for k, i, low in asks}
    assert {tuple(r) for r in got.collect()} == {(i, min(some), max(some)) for i, some in held.items() if some}


def plain_parents(reviews, markers):
    out = {}
    for project, review, s, u in reviews:
        u = s if u is None else u
        fit = {p for q, p, e, x in markers if q == project and e is not None and (abs(e - s) <= 5000 or (x is not None and e <= s + 5000 and x >= s - 30_000 and abs(x - u) <= 120_000))}
        if len(fit) == 1:
            out[review] = fit.pop()
    return out


def test_review_parents_equal_a_plain_loop(spark):
    rng, _ = seeded(0, 5)
    markers = [(rng.choice("pq"), f"s{i % 25}", e := rng.randrange(10**6), rng.choice([None, e + rng.randrange(200_000)])) for i in range(60)]
    markers += [("p", "none", None, 500_000), ("p", "odd", 700_000, 600_000)]
    reviews = [(rng.choice("pq"), f"r{i}", s := rng.randrange(10**6), rng.choice([None, s + rng.randrange(300_000), s - 10_000])) for i in range(150)]
    got = pairing.review_parents(spark.createDataFrame(reviews, "project string, review_id string, started_ms long, updated_ms long"),
                                 spark.createDataFrame(markers, "project string, parent_id string, entered_ms long, exited_ms long"), ["project"])
    want = plain_parents(reviews, markers)
    assert {r.review_id: r.parent_id for r in got.collect()} == want and len(want) > 10


def test_reviews_of_one_minute_make_no_pairs(spark):
    n = 20_000
    reviews = spark.range(n).selectExpr("'p' AS project", "concat('r', id) AS review_id", "1000000 + id % 60000 AS started_ms", "1030000 + id % 60000 AS updated_ms")
    markers = spark.range(n).selectExpr("'p' AS project", "concat('s', id % 3) AS parent_id", "1000000 + id % 60000 AS entered_ms", "1030000 + id % 60000 AS exited_ms")
    assert pairing.review_parents(reviews, markers).count() == 0
    plan = pairing.review_parents(reviews, markers)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert pairing.review_parents(reviews, markers.withColumn("parent_id", pairing.F.lit("one"))).filter("parent_id = 'one'").count() == n
