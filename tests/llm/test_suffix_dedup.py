import random
from hashlib import sha256

import numpy as np
import pytest

from skeinlog.llm import suffix_dedup as sd


def plain(rows, length=50):
    first, out = {}, []
    for i, t in rows:
        raw, key = (t or "").encode(), float("inf") if i is None else i
        for k in range(len(raw) - length + 1):
            s = raw[k:k + length]
            first[s] = min(key, first.get(s, key))
    for i, t in rows:
        raw, key = (t or "").encode(), float("inf") if i is None else i
        gone = [False] * len(raw)
        for k in range(len(raw) - length + 1):
            if first[raw[k:k + length]] < key:
                gone[k:k + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((-1 if i is None else i, len(raw), sum(gone), runs, sha256(left).hexdigest()))
    return sorted(out)


def corpus(seed):
    pick = random.Random(seed)
    passages = ["".join(pick.choice("abé z") for _ in range(pick.randint(30, 130))) for _ in range(6)] + ["ab" * 60]
    texts = []
    for _ in range(90):
        parts = [pick.choice(passages) if pick.random() < 0.5 else "".join(pick.choice("abcdefgh ") for _ in range(pick.randint(0, 120))) for _ in range(pick.randint(0, 6))]
        texts.append("".join(p[pick.randint(0, 9):] for p in parts))
    texts += [texts[5]] * 5 + [texts[8] + "tail", "", None, "x" * 49, "x" * 50, "x" * 200, "x" * 51]
    ids = pick.sample(range(500), len(texts))
    ids[3] = ids[4]
    ids[7] = ids[11] = None
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed,block,bucket", [(1, 4 << 20, 2 << 20), (2, 1500, 700), (3, 400, 100)])
def test_equals_brute_force(spark, monkeypatch, seed, block, bucket):
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "BUCKET", bucket)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, block int").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.deduplicated(docs).collect())
    assert got == plain(rows)


def test_cover_takes_every_pair_of_phases():
    for period in (5, 7, 13, 21):
        cover = sd.difference_cover(period)
        assert all(any((i + d) % period in cover and (j + d) % period in cover for d in range(period)) for i in range(period) for j in range(period))
    assert len(sd.difference_cover(21)) == 5


def test_number_coding():
    pick = np.random.default_rng(2)
    for top in (1, 200, 2**20, 2**44, 2**63):
        x = pick.integers(0, top, 500, dtype=np.uint64, endpoint=True)
        assert (sd.unplaned(sd.planes(x)) == x).all()
    assert len(sd.unplaned(sd.planes(np.zeros(0, np.uint64)))) == 0


def test_empty_table_and_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.deduplicated(docs).count() == 0
    pick = random.Random(1)
    long = "".join(pick.choice("abcdefgh ") for _ in range(400_000))
    docs = spark.createDataFrame([(4, long), (2, long[1000:300_000])], docs.schema)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept) for r in sd.deduplicated(docs, texts=True).collect()}
    assert got == {2: (0, 0, long[1000:300_000].encode()), 4: (299_000, 1, (long[:1000] + long[300_000:]).encode())}


@pytest.mark.parametrize("bits", [0, 3, 30, 64])
def test_order_of_hashes_that_share_high_bits(bits):
    """Hashes equal in all bits that a place leaves room for are still in order, equal ones by place."""
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 5000):
        hashes = rng.integers(0, 1 << bits, n, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        near = np.concatenate([hashes, hashes[::-1] ^ np.uint64(bits == 64), hashes])
        assert sd.rising(near).tolist() == np.argsort(near, kind="stable").tolist()


def test_positions_equal_a_loop_over_texts():
    sizes = np.array([0, 49, 50, 51, 200, 30, 71, 500], np.int64)
    block = sd.Block(bytes(int(sizes.sum())), np.arange(8, dtype=np.int64).tobytes(), sizes.tobytes(), [4])
    for length, cover, period in ((50, None, 1), (30, [0, 1, 4, 14, 16], 21)):
        want = [(int(block.start[i]) + p, i) for i in range(8) if i != 4 for p in range(int(sizes[i]) - length + 1) if not cover or p % period in cover]
        at, of = block.positions(length, cover, period)
        assert list(zip(at.tolist(), of.tolist())) == want
