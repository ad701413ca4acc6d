import re
from collections import Counter

import pytest

from skeinlog.llm import mixing


def plain_targets(sizes):
    """Reshare the excess by weight until no target is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += share * weight[s]
        left = sum(max(0.0, target[s] - 3 * sizes[s]) for s in open_)
        full = {s for s in open_ if target[s] >= 3 * sizes[s]}
        for s in full:
            target[s] = 3.0 * sizes[s]
        open_ -= full
    return target


def check(docs, rows):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, most = Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += count(text)
        most[source] = max(most[source], count(text))
    target = plain_targets(sizes)
    got = mixing.digests(docs).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, count(t)) for i, t, _ in rows)
    taken, seen = Counter(), Counter()
    by_size = {(sizes[s], round(target[s], 6)): s for s in sizes}
    for r in got:
        s = by_size[r.source_size, round(r.target, 6)]
        taken[s] += r.taken
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        seen[s] += 1
    for s in sizes:
        assert abs(taken[s] - target[s]) <= most[s] + 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.digests(docs).collect()))


@pytest.mark.parametrize("fan", [2, 5, 64])
def test_targets_and_taken_words(spark, monkeypatch, fan):
    monkeypatch.setattr(mixing, "FAN", fan)
    rows = [(i, "w " * (1 + i * 7 % 23), "big" if i % 3 else f"s{i % 11}") for i in range(300)]
    rows += [(7, None, "s1"), (7, "", "s1"), (None, "a b c", None), (900, "x " * 50, "zz"), (900, "x " * 50, "zz")]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows)


@pytest.mark.parametrize("seed", range(4))
def test_large_documents_leave_their_rest_to_small_ones(spark, seed):
    """One document of 3,000 words and 59 of 20 words, and a source of which little is wanted."""
    rows = [(1000 * seed + i, "w " * (20 if i else 3000), "b") for i in range(60)]
    rows += [(1000 * seed + 100 + i, "w " * (5 if i else 900), "c") for i in range(400)] + [(1000 * seed + 600 + i, "w " * (1 + i % 40), None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.digests(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert len(got) == len(rows) and len(target) == 3
    for s, words in target.items():
        assert abs(taken[s] - words) <= max(20, words / mixing.FAN), (s, taken[s], words)


def test_salted_join_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(80)], "doc_id long, text string, source string")
    one = sorted(map(repr, mixing.digests(docs).collect()))
    monkeypatch.setattr(mixing, "SMALL_SOURCES", 0)
    assert one == sorted(map(repr, mixing.digests(docs).collect()))


def test_mixture_repeats_whole_rows(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}", {"a": i}, i) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string,int>, size int")
    taken = {r.doc_id: r.taken // r.size for r in mixing.digests(docs).collect()}
    assert Counter(r.doc_id for r in mixing.mixture(docs).collect()) == {i: n for i, n in taken.items() if n}
    assert mixing.mixture(docs).schema.names == docs.schema.names


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.digests(docs).count() == 0 and mixing.mixture(docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], docs.schema)
    assert {(r.doc_id, r.target, r.taken) for r in mixing.digests(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
