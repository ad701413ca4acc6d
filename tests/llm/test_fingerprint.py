from hashlib import sha256

import numpy as np
import pytest

from skeinlog.llm import fingerprint as fp
from skeinlog.llm import words


def shingle_set(text):
    w = words_plain(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def words_plain(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_borders_and_equal_hashes():
    texts = ["a b  c d\te", "", None, "c a b", "x" * 100, "é b"]
    hashes, at = words.word_runs(texts)
    plain = [words_plain(t) for t in texts]
    assert [int(n) for n in np.diff(at)] == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len({(w, int(h)) for w, h in zip(flat, hashes)}) == len(set(flat)) == len(set(map(int, hashes)))


def test_long_arrays_are_cut_at_white_space():
    data = np.frombuffer(b"abc de " * 50 + b"z" * 300 + b" q", np.uint8)
    one, many = words.words_of(data), words.words_of(data, 16)
    assert all((a == b).all() for a, b in zip(one, many))


def test_sketch_estimates():
    text = " ".join(f"w{i * 7919 % 5003}" for i in range(4000))
    other = fp.edited(text, " ".join(f"v{i}" for i in range(4000)))
    a, b = fp.sketches([text, other])
    true = len(shingle_set(text) & shingle_set(other)) / len(shingle_set(text) | shingle_set(other))
    assert abs(fp.resemblance(a, b) - true) < 0.15
    assert abs(fp.distinct(a) / len(shingle_set(text)) - 1) < 0.3
    half = text[:text.index("w", len(text) // 2)]
    h = fp.sketches([half])[0]
    assert fp.containment(h, a) > 0.85
    assert (fp.merged(h, fp.sketches([text[len(half):]])[0]) != fp.sketches([text])[0]).sum() <= 10
    assert (fp.from_text(fp.to_text(a)) == a).all()


def test_small_sets_are_exact():
    a, b, none = fp.sketches(["a b c d e f g", "a b c d e f h", " \n"])
    assert fp.resemblance(a, b) == pytest.approx(2 / 4) and fp.distinct(a) == 3 and fp.containment(a, b) == pytest.approx(2 / 3)
    assert fp.resemblance(none, none) == 1.0 and fp.resemblance(a, none) == 0.0


@pytest.mark.parametrize("parts", ["1", "7"])
def test_ring_of_documents(spark, parts):
    rows = [(i * 37 % 101, f"text {i} " * (i % 9), i) for i in range(60)] + [(5, None, 0), (5, "again " * 8, 0), (None, "no id at all here", 0), (2**60, "far away " * 30, 0)]
    ordered = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(ordered):
        changed = fp.edited(t, ordered[(k + 1) % len(ordered)][1])
        want.append((i, len(t), sha256(changed.encode()).hexdigest()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fp.digests(spark.createDataFrame(rows, "doc_id long, text string, block int")).collect()
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
        for r in got:
            assert r.near_edited == fp.resemblance(fp.from_text(r.fingerprint), fp.from_text(r.edited_fingerprint))
        one = spark.createDataFrame([(1, "only one text of some words")], "doc_id long, text string")
        assert [r.near_next for r in fp.digests(one).collect()] == [1.0]
        assert fp.digests(one.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
