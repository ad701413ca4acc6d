import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skeinlog.llm import components, ngram_join


def plain_set(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", ngram_join.lowered(text) or "")
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def plain_components(rows, percent=85):
    sets = [(i, plain_set(t)) for i, t in rows]
    low = {i: i for i, _ in rows if i is not None}
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if None not in (a, b) and x and y and 100 * len(x & y) >= percent * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return sorted(((i or -1, len(s), low.get(i, -1)) for i, s in sets))


def near_copies(n, pick, words=60, share=0.03):
    base, out = [f"w{pick.randint(0, 10**6)}" for _ in range(words)], []
    for _ in range(n):
        out.append(" ".join(w if pick.random() > share else f"x{pick.randint(0, 99)}" for w in base))
    return out


def texts(seed):
    pick = random.Random(seed)
    out = [t for size in (2, 3, 5, 40, 70) for t in near_copies(size, pick, pick.randint(20, 90), pick.choice([0.01, 0.03]))]
    out += [" ".join(f"v{pick.randint(0, 40)}" for _ in range(pick.randint(0, 40))) for _ in range(60)]
    out += ["a b", "A B", "a b c", "", "  \n", None, "one two three four", "one two three four five", "É a b c", "é a b c"] + [out[3]] * 4
    pick.shuffle(out)
    return out


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


@pytest.mark.parametrize("seed,group,block", [(1, 32, 400_000), (2, 4, 300), (3, 4, 400_000)])
def test_components_equal_brute_force(spark, monkeypatch, seed, group, block):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts(seed))]
    rows += [(1, rows[0][1]), (2, rows[5][1]), (2, rows[9][1]), (None, rows[4][1])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n string")
    assert rows_of(ngram_join.joined(docs)) == plain_components(rows)


def test_bounds_at_the_threshold():
    for a in range(1, 60):
        for b in range(a, 60):
            least = int(ngram_join.needed(a, b, 85))
            assert all((100 * k >= 85 * (a + b - k)) == (k >= least) for k in range(a + 1))
            if least <= a:  # a shared n-gram must lie in both prefixes
                assert least + ngram_join.prefix_length(a, 85) > a and least + ngram_join.prefix_length(b, 85) > b


def test_shared_counts():
    pick = np.random.default_rng(3)
    some = [np.unique(pick.integers(0, 300, pick.integers(0, 90)).astype(np.uint64)) for _ in range(12)]
    assert (ngram_join.shared_counts(some[:5], some[5:]) == [[len(np.intersect1d(a, b)) for b in some[5:]] for a in some[:5]]).all()


def test_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.joined(docs).count() == 0
    long = " ".join(f"w{i}" for i in range(120_000))
    docs = spark.createDataFrame([(7, long), (3, long + " end"), (9, "else")], docs.schema)
    assert rows_of(ngram_join.joined(docs)) == [(3, 119_998, 3), (7, 119_997, 3), (9, 1, 9)]


def test_components_of_paths_and_stars(spark):
    pick, edges = random.Random(1), []
    ids = pick.sample(range(10**6), 400)
    edges += [(a, b) for a, b in zip(ids[:150], ids[1:150])] + [(ids[200], x) for x in ids[201:390]] + [(5, 5), (None, 4)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {x: min(ids[:150]) for x in ids[:150]} | {x: min(ids[200:390]) for x in ids[200:390]}


def test_blocks_are_bounded_in_rows(spark):
    """Short sets fill a block in rows long before they fill it in n-grams; every two of them still meet in one task."""
    crowded = spark.range(9000).selectExpr("1L as gram", "id as rid", "7L as n")
    tasks = ngram_join._dealt(crowded).groupBy("low", "high").count().collect()
    blocks = 1 + max(r.high for r in tasks)
    assert max(r["count"] for r in tasks) <= 2 * 2048 and len(tasks) == blocks * (blocks + 1) // 2


def test_crowded_short_texts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROWS", 25)
    pick = random.Random(8)
    rows = [(i + 1, t) for i, t in enumerate(near_copies(330, pick, words=30, share=0.02))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ngram_join.joined(docs)) == plain_components(rows)


def test_block_larger_than_a_strip():
    pick = random.Random(9)
    texts = near_copies(700, pick, words=30, share=0.02)
    table = pa.table({"low": [0] * 700, "high": [0] * 700, "first": [True] * 700, "doc_id": list(range(1, 701)), "text": texts})
    found = ngram_join._block_links(4, 85)(table)
    low = {u: v for u, v in zip(found["u"].to_pylist(), found["v"].to_pylist(), strict=True)}
    assert [low.get(i, i) for i in range(1, 701)] == [c for _, _, c in plain_components(list(enumerate(texts, 1)))]


def test_words_built_to_share_a_hash_stay_apart(spark):
    one, other = "ab", "ba"
    for _ in range(10):  # Thue-Morse words: equal under any polynomial hash modulo 2^64
        one, other = one + other, other + one
    docs = spark.createDataFrame([(1, f"w1 w2 w3 {one}"), (2, f"w1 w2 w3 {other}"), (3, f"w1 w2 w3 {one}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.joined(docs).collect()} == {1: 1, 2: 2, 3: 1}
