import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from skeinlog.llm import language, mixing, secret_scan
from skeinlog.llm.shared import documents

ROOT = "/root/testdata/sf0.01"


def shingles(text, size=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def kept_by_brute_force(rows):
    sets = [(i, shingles(t)) for i, t in sorted(rows)]
    low = {i: i for i, _ in sets}
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 0.8 * max(len(x), len(y)) <= min(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y) and low[i] != low[j]:
                a, b = max(low[i], low[j]), min(low[i], low[j])
                low = {n: b if m == a else m for n, m in low.items()}
    return {i for i, m in low.items() if i == m}


def test_stages_one_by_one(spark):
    docs, columns = documents(spark, ROOT), documents(spark, ROOT).columns
    rows = {}
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        new = cp.written(stage(spark, docs, ROOT), "test-stage")
        rows[name] = new.collect()
        if name != "bpe":
            assert new.columns == columns
        if name == "language_id":
            score = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(docs.select("doc_id", "text"), language.learned(docs)).collect()}
            assert {r.doc_id for r in rows[name]} == {i for i, (p, s) in score.items() if p != "und" and s >= cp.LANGUAGE_SHARE}
            assert len(rows[name]) > 0.98 * len(before)
        elif name == "ngram_join":
            assert {r.doc_id for r in rows[name]} == kept_by_brute_force([(i, r.text) for i, r in before.items()]) and len(rows[name]) < len(before)
        elif name == "secret_scan":
            assert all(r.text == secret_scan.redact(before[r.doc_id].text) and r.n_chars == len(r.text) for r in rows[name]) and len(rows[name]) == len(before)
            assert sum(r.text != before[r.doc_id].text for r in rows[name]) > 0
        elif name == "mixing":
            taken = {r.doc_id: r.taken // r.size for r in mixing.digests(docs).collect() if r.taken}
            assert Counter(r.doc_id for r in rows[name]) == taken
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert len(rows[name]) == docs.count()
            assert all(r.token_ids == library.encode(before[r.doc_id].text, add_special_tokens=False).ids for r in rows[name])
        docs = new
    assert sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, ROOT).collect()) == sorted((r.doc_id, r.n_tokens) for r in rows["bpe"])


def test_odd_rows_pass_all_stages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = "the king and the house of water " * 4
    rows = [(1, words, "en", "a", 5), (1, words, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (4, "12 34", "en", None, 5), (None, words + "x", None, "a", 1), (5, "password: abcdefgh12 " + words, None, None, 1)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in cp.STAGES[:-1]:
            docs = cp.written(stage(spark, docs, ""), "test-stage")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = cp.STAGES[-1][1](spark, docs, "").collect()
        assert {r.doc_id for r in got} <= {1, 5, None}
