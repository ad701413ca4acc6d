import numpy as np
import pytest

from skeinlog.llm import vector_dedup as vd


def plain(rows, limit=0.95):
    size = 6
    good = [(i, np.array(x, float)) for i, x in rows if i is not None and x is not None and len(x) == size and None not in x and np.isfinite(x).all() and np.any(x)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= limit
    np.fill_diagonal(near, False)
    low = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(near)):
            m = min(low[good[a][0]], low[good[b][0]])
            for k in (a, b):
                changed |= low[good[k][0]] != m
                low[good[k][0]] = m
    links = {i: int(n) for (i, _), n in zip(good, near.sum(axis=1))}
    return sorted((i, links.get(i, 0), low[i], low[i] == i) for i, _ in rows if i is not None)


def cloud(seed, n):
    pick = np.random.default_rng(seed)
    centers = pick.normal(size=(12, 6))
    rows = centers[pick.integers(0, 12, n)] + pick.normal(size=(n, 6)) * pick.choice([0.05, 0.3, 1.0], (n, 1))
    return [(int(i), [float(v) for v in np.float32(r)]) for i, r in zip(pick.permutation(n * 3)[:n], rows)]


@pytest.mark.parametrize("seed,lists,block", [(1, 1024, 1024), (2, 40, 16), (3, 7, 50)])
def test_links_equal_brute_force(spark, monkeypatch, seed, lists, block):
    monkeypatch.setattr(vd, "LISTS", lists)
    monkeypatch.setattr(vd, "PER_LIST", 12)
    monkeypatch.setattr(vd, "BLOCK", block)
    monkeypatch.setattr(vd, "SAMPLE", 150)
    rows = cloud(seed, 400)
    rows += [(5000 + k, rows[7][1]) for k in range(60)] + [(6000, None), (6001, [0.0] * 6), (6002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (6003, [float("nan")] * 6), (6004, [1.0, 2.0]), (6005, [float("inf")] + [1.0] * 5)]
    table = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, rid int")
    got = sorted(tuple(r) for r in vd.joined(table).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == plain(rows)


def test_probes_and_tables_lose_nothing():
    pick = np.random.default_rng(4)
    x = pick.normal(size=(900, 16)) + 2 * pick.normal(size=(30, 16))[pick.integers(0, 30, 900)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vd.fit(x[:200], 25)
    own, may = vd.probes(index, x, 0.9)
    codes, error = vd.coded(index, x - index["coarse"][own])
    near = x @ x.T >= 0.9
    assert may[np.nonzero(near)[0], own[np.nonzero(near)[1]]].all() and may.mean() < 0.9
    for c in np.unique(own):
        some = own == c
        maybe = vd.likely(index, index["coarse"][c], x, codes[some], error[some], 0.9)
        assert maybe[near[:, some]].all()
        assert (vd.exact(x, x[some], maybe, 0.9) == near[:, some]).all()


def test_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vd.joined(empty).count() == 0
    none = spark.createDataFrame([(1, None), (None, [1.0])], empty.schema)
    assert sorted(map(repr, (tuple(r) for r in vd.joined(none).collect()))) == ["(1, 0, 1, True)", "(None, 0, None, False)"]
    twice = spark.createDataFrame([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [2.0, 0.0]), (9, [0.0, 1.0])], empty.schema)
    assert sorted(tuple(r) for r in vd.joined(twice).collect()) == [(1, 2, 1, True), (3, 2, 1, False), (3, 2, 1, False), (9, 0, 9, True)]


def test_recall_on_vectors_of_many_dimensions(spark):
    """The given vectors, each with a copy that noise has moved to a cosine of about 0.95 to 0.99."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pick, rows = np.random.default_rng(6), [(r.vec_id, np.array(r.embedding, float)) for r in given.collect()]
    for i, x in rows[:]:
        noise = pick.normal(size=len(x))
        rows.append((10_000 + i, x + noise * np.linalg.norm(x) / np.linalg.norm(noise) * pick.uniform(0.1, 0.33)))
    rows = [(i, [float(v) for v in np.float32(x)]) for i, x in rows]
    x = np.array([x for _, x in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in vd.joined(spark.createDataFrame(rows, given.select("vec_id", "embedding").schema)).collect()}
    assert all(got[i] <= n for (i, _), n in zip(rows, near))
    assert near.sum() > 3000 and sum(got.values()) >= 0.999 * near.sum()


def test_every_length_has_its_links(spark, monkeypatch):
    """Two lengths of many vectors, one of two that the sample misses, and vectors whose squares overflow or vanish."""
    monkeypatch.setattr(vd, "PER_LIST", 12)
    pick = np.random.default_rng(11)
    few = [(9000, [1.0, 2.0, 3.0]), (9001, [1.0, 2.0, 3.1]), (9002, [1e300, 0.0, 0.0]), (9003, [1.0, 0.0, 0.01]), (9004, [1e-300, 0.0, 0.0])]
    wide = pick.normal(size=(10, 9))[pick.integers(0, 10, 150)] + 0.1 * pick.normal(size=(150, 9))
    wide = [(4000 + k, [float(v) for v in x]) for k, x in enumerate(wide)]
    rows = [*cloud(9, 250), *wide, *few]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {}
    for size in (3, 6, 9):
        x = np.array([np.array(x) / np.abs(x).max() for _, x in rows if len(x) == size])
        ids = [i for i, x in rows if len(x) == size]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want |= dict(zip(ids, ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist(), strict=True))
    assert sum(want[i] for i, _ in few) == 8 and sum(want[i] for i, _ in wide) > 1000
    for sample in (vd.SAMPLE, 60):
        monkeypatch.setattr(vd, "SAMPLE", sample)
        got = vd.joined(table).collect()
        assert {r.vec_id: r.n_links for r in got} == want
        assert {r.vec_id: r.component_id for r in got if r.vec_id >= 9000} == {9000: 9000, 9001: 9000, 9002: 9002, 9003: 9002, 9004: 9002}


@pytest.mark.parametrize("rank,size", [(3, 64), (4, 64), (4, 1024)])
def test_recall_where_vectors_vary_in_few_dimensions(spark, rank, size):
    """Vectors of a low-rank subspace with near copies in it: all links, by brute force."""
    pick = np.random.default_rng(rank + size)
    base = pick.normal(size=(900, rank))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = pick.normal(size=base.shape)
    x = np.concatenate([base, base + noise / np.linalg.norm(noise, axis=1, keepdims=True) * pick.uniform(0.05, 0.3, (900, 1))])
    x = x @ np.linalg.qr(pick.normal(size=(size, rank)))[0].T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    sure, may = (cosine >= 0.95 + 1e-9).sum(axis=1) - 1, (cosine >= 0.95 - 1e-9).sum(axis=1) - 1
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vd.joined(table).select("vec_id", "n_links").collect()}
    assert all(sure[i] <= got[i] <= may[i] for i in range(len(x))) and sure.sum() > 10_000


def test_spreads_follow_the_data():
    pick = np.random.default_rng(8)
    thin = pick.normal(size=(600, 3)) @ np.linalg.qr(pick.normal(size=(64, 3)))[0].T
    wide = pick.normal(size=(30, 64))[pick.integers(0, 30, 600)] + 0.2 * pick.normal(size=(600, 64))
    for x, low, high in ((thin, 0.2, 1.0), (wide, 1 / 64, 0.1)):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        spread = vd.fit(x, 12)["spread"]
        apart = ~np.eye(len(spread), dtype=bool)
        assert (spread == spread.T).all() and spread.min() >= np.float32(1 / 64) and low <= np.median(spread[apart]) <= high


def test_rows_of_lists_do_not_grow_with_the_square(spark, monkeypatch):
    """Four times the vectors: each looks into about twice the lists, not four times as many less a few."""
    pick, made = np.random.default_rng(3), []
    monkeypatch.setattr(vd, "_compared", lambda placed, *rest: made.append(placed.count()) or spark.createDataFrame([], "u bigint, v bigint, n bigint"))
    x = pick.normal(size=(6400, 6))
    for n in (1600, 6400):
        vd.joined(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:n])], "vec_id long, embedding array<double>"))
    assert made[0] > 2 * 1600 and made[1] < 6.6 * made[0]
