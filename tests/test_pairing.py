"""Ambiguity cases: 0, 1 and 2 candidates on each side."""

import itertools

from pyspark.sql import functions as F

from skeinlog.operators import graph, pairing, setops


def test_every_count_of_calls_and_results(spark):
    rows, line = [], 0
    for calls, results in itertools.product(range(3), repeat=2):
        for kind in ["call"] * calls + ["result"] * results:
            line += 1
            rows.append(("s", line, f"e{line}", f"c{calls}{results}", kind == "call", kind == "result"))
    rows += [("s", 90, "e90", "late", False, True), ("s", 91, "e91", "late", True, False), ("s", 92, "e92", None, True, False)]
    df = spark.createDataFrame(rows, "session_id string, line bigint, event_id string, call_id string, is_call boolean, is_result boolean")
    issues = {r.call_id: r.issue for r in pairing.call_pairs(df).collect()}
    assert issues == {"c01": "missing_call", "c02": "missing_call", "c10": "missing_output", "c11": "", "c12": "ambiguous_call_id",
                      "c20": "ambiguous_call_id", "c21": "ambiguous_call_id", "c22": "ambiguous_call_id", "late": "output_before_call"}
    whole = pairing.calls_and_results(df)
    pairs = whole.filter("call_event_id is not null and result_event_id is not null").count()
    assert pairs == 1 and whole.count() == len(rows) - 1


def test_unique_join_drops_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (3, "w")], "k int, r string")
    assert [tuple(r) for r in pairing.unique_join(left, right, ["k"]).collect()] == [(1, "a", "x")]


def test_a_key_with_a_third_of_the_rows(spark):
    rows = spark.range(3000).select(
        F.lit("s").alias("session_id"), F.col("id").alias("line"), F.concat(F.lit("e"), "id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.floor(F.col("id") / 3).cast("string"))).alias("call_id"),
        (F.col("id") % 3 == 1).alias("is_call"), (F.col("id") % 3 == 2).alias("is_result"))
    assert pairing.matched_pairs(rows).count() == 1000


def test_range_owner_brute_force(spark):
    import random
    rng = random.Random(7)
    ranges = [("f", owner, lo, lo + rng.randint(0, 6)) for owner, lo in enumerate(rng.sample(range(60), 15), 1)]
    points = [("f", p) for p in range(70)]
    got = {r.line: (r.open, r.owner) for r in pairing.range_owner(
        spark.createDataFrame(points, "file string, line bigint"), spark.createDataFrame(ranges, "file string, owner bigint, start bigint, end bigint")).collect()}
    for _, p in points:
        over = [o for _, o, lo, hi in ranges if lo <= p <= hi]
        assert got[p] == (len(over), over[0] if len(over) == 1 else None)


def test_review_marker_fits_one_parent_only(spark):
    reviews = spark.createDataFrame([("r1", 1_000_000, 1_060_000), ("r2", 5_000_000, 5_010_000), ("r3", 9_000_000, 9_050_000)], "review_id string, started_ms bigint, updated_ms bigint")
    markers = spark.createDataFrame([("p1", 1_004_000, None), ("p1", 5_001_000, None), ("p2", 4_999_000, 5_100_000), ("p3", 8_000_000, 9_100_000)], "parent_id string, entered_ms bigint, exited_ms bigint")
    assert {r.review_id: r.parent_id for r in pairing.review_parents(reviews, markers).collect()} == {"r1": "p1", "r3": "p3"}


def test_cycles_and_chains(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 6), (6, 4), (7, 6), (8, 99), (9, 9)], "node bigint, parent bigint")
    got = {r.node: (r.root, r.depth, r.endless) for r in graph.chains(edges).collect()}
    assert got[3] == (1, 2, False) and got[8] == (8, 0, False) and got[7][2] and got[9][2]
    assert {r.node for r in graph.cycle_members(edges).collect()} == {4, 5, 6, 9}
    assert {r.node: r.parent for r in graph.without_cycles(edges).collect()}[7] == 6


def test_duplicate_files(spark):
    rows = [("a", "f1", "x", False), ("a", "f1", "a", True), ("b", "f1", "b", True), ("b", "f2", "y", False), ("c", "f3", "c", True)]
    got = {r.identity: (r.kept, r.conflict) for r in setops.resolve_duplicates(spark.createDataFrame(rows, "identity string, fingerprint string, file string, canonical boolean")).collect()}
    assert got == {"a": ("a", False), "b": (None, True), "c": ("c", False)}


def test_nearest_span_brute_force(spark, tiny_blocks):
    import random
    rng = random.Random(9)
    spans = [("s", rng.choice("ab"), f"p{i}", lo, lo + rng.randint(0, 12)) for i, lo in enumerate(rng.sample(range(120), 30))]
    points = [("s", rng.choice("ab"), line) for line in rng.sample(range(140), 50)]
    best = {}
    for _, sig, line in points:
        fits = [((0 if line <= hi else 1), -lo, name) for _, g, name, lo, hi in spans if g == sig and lo <= line <= hi + 1]
        if fits:
            distance, _, name = min(fits)
            best.setdefault(name, []).append((distance, line))
    got = pairing.nearest_span(spark.createDataFrame(points, "session_id string, signature string, line bigint"),
                               spark.createDataFrame(spans, "session_id string, signature string, span_id string, start bigint, end bigint"), 10)
    assert {r.span_id: r.line for r in got.collect()} == {name: min(c)[1] for name, c in best.items()}


def test_containment_brute_force(spark, tiny_blocks):
    import random
    rng = random.Random(10)
    spans = [("s", "f", f"p{i}", lo, lo + rng.randint(0, 15)) for i, lo in enumerate(rng.sample(range(120), 25))]
    events = [("s", "f", f"e{i}", lo, lo + rng.choice([0, 0, 3])) for i, lo in enumerate(rng.sample(range(140), 60))]
    got = pairing.containing_span(spark.createDataFrame(events, "session_id string, file string, event_id string, min_line bigint, max_line bigint"),
                                  spark.createDataFrame(spans, "session_id string, file string, span_id string, start bigint, end bigint"))
    expected = {}
    for _, _, event, lo, hi in events:
        over = [n for _, _, n, a, b in spans if a <= lo and hi <= b]
        if len(over) == 1:
            expected[event] = over[0]
    assert {r.event_id: r.span_id for r in got.collect()} == expected
