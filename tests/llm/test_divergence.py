import re
from collections import Counter, defaultdict

from skeinlog.llm import divergence as dv

ROOT = "/root/testdata/sf0.001"


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_audit(rows):
    """(lang, source, text) -> all rows of the audit, each pair over all kept terms."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        groups[lang].add(source)
        count[lang, source].update(plain_terms(text))
        docs[lang].update(set(plain_terms(text)))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        share = {s: {} for s in [*sources, None]}
        for s in [*sources, None]:
            some = {t: sum(count[lang, x][t] for x in sources) if s is None else count[lang, s][t] for t in kept}
            share[s] = {t: 1 + 10**9 * (n + 1) // (sum(some.values()) + len(kept)) for t, n in some.items()}
        apart = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = sorted((-sum(apart(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            high = sorted((-apart(share[s][t], share[None][t]), t.encode(), t) for t in kept if count[lang, s][t] and share[s][t] > share[None][t])
            for part, some in (("pair", pairs), ("term", high[:200])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(some)]
    return sorted(out)


def test_terms():
    text = "Élan vital's THE_end 12th\x00a b ÀÉ x-y z"
    assert [t.decode() for t in dv.terms(text)] == plain_terms(text)
    assert dv.terms("") == dv.terms("12 .,;\n") == []


def test_given_table(spark, against_sql):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    got = dv.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    mine, theirs = against_sql(got, dv.SQL, ROOT)
    assert mine == theirs
    order = [got.columns.index(c) for c in sorted(got.columns)]
    want = plain_audit([(r.lang, r.source, r.text) for r in docs.collect()])
    assert mine == sorted((tuple(r[i] for i in order) for r in want), key=repr)
    assert {r[2] for r in mine} == {"pair", "term"} and len(mine) > 1000


def test_odd_rows(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n string, held long"
    copies = [(7, "The same TEXT again and again", "en", s, "x", 1) for s in ("a", "a", "a", "b", None)]
    rows = [*copies, (1, None, None, None, None, 1), (1, "", "en", "empty", "x", 1), (2, "no kept term here at all", "xx", "one", "x", 1), (3, None, "xx", "two", "x", 1),
            (4, "the " * 50_000 + "tail", "en", "long", "x", 1), (5, "the the same", "en", "é", "x", 1), (6, "Z z ß \x00 z", "en", "z", "x", 1), (None, "the", "en", "ä", "x", 1)]
    for held in (1 << 19, 2):
        monkeypatch.setattr(dv, "HELD", held)
        for some in (rows, rows[::-1] * 2, []):
            got = sorted(tuple(r) for r in dv.audit(spark.createDataFrame(some, schema)).collect())
            assert got == plain_audit([(r[2], r[3], r[1]) for r in some])
    assert any(r[0] == "xx" and r[2] == "pair" and r[4] == 0 for r in plain_audit([(r[2], r[3], r[1]) for r in rows]))


def test_texts_collapse_by_language(spark):
    docs = spark.createDataFrame([("t", "en", "a"), ("t", "en", "a"), ("t", "en", "b"), ("t", "de", "a"), (None, None, None)], "text string, lang string, source string")
    got = {(r.lang, r.text): sorted((h.source, h.n) for h in r.held) for r in dv.collapsed(docs).collect()}
    assert got == {("en", "t"): [("a", 2), ("b", 1)], ("de", "t"): [("a", 1)], ("", ""): [("", 1)]}


def test_counts_beyond_64_bits_of_product(spark):
    big = spark.createDataFrame([("en", "x", [("a", 10**12), ("b", 5)], 10**12 + 5), ("en", "y", [("b", 7)], 7)], "lang string, term string, held array<struct<source:string,count:bigint>>, total bigint")
    facts = dv.group_facts(spark.createDataFrame([("en", "a"), ("en", "b")], "lang string, source string"), big)
    p = {"a": [1 + 10**9 * (10**12 + 1) // (10**12 + 2), 1 + 10**9 // (10**12 + 2)], "b": [1 + 10**9 * 6 // 14, 1 + 10**9 * 8 // 14]}
    want = {(s, o): sum((x - y) ** 2 // y for x, y in zip(p[s], p[o])) for s, o in (("a", "b"), ("b", "a"))}
    assert {(r.source, r.item): r.value for r in dv.pair_values(big, facts).collect()} == want
