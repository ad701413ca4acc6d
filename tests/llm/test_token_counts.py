import random
import tempfile
from collections import Counter

from skeinlog.llm import token_counts
from skeinlog.llm.queries import op5_token_counts

CHANGE = "op string, seq int, doc_id long, source string, lang string, tokenizer string, n_tokens long"


def rows_of(df):
    return sorted((r.source or "", r.lang or "", r.tokenizer, r.n_docs, r.n_tokens) for r in df.collect())


def test_corpus_query_equals_sql(spark, against_sql):
    root = "/root/testdata/sf0.01"
    got, want = against_sql(op5_token_counts(spark, root), token_counts.CORPUS_SQL, root)
    assert got == want and len(got) > 50


def test_random_batches_equal_a_plain_ledger(spark):
    pick, ledger = random.Random(4), {}
    store = token_counts.Rollup(spark, tempfile.mkdtemp())
    batches = []
    for number in range(1, 5):
        changes, own = [], {}
        for seq in range(12):
            op, doc, tok = pick.choice(["insert", "revise", "delete"]), pick.choice([1, 2, 3, 4, None]), pick.choice(["a", "b"])
            change = (op, seq, doc, pick.choice(["x", None]), pick.choice(["en", "de"]), tok, pick.choice([0, 5, 9, None]))
            changes.append(change)
            own[doc, tok] = change
        for key, (op, _, _, source, lang, _, n) in own.items():
            ledger.pop(key, None)
            if op != "delete":
                ledger[key] = (source or "", lang, n or 0)
        batches.append(spark.createDataFrame(changes, CHANGE))
        store.commit(number, batches[-1])
        if number % 2 == 0:
            store.commit(number, batches[-1])  # a second delivery
    docs, tokens = Counter(), Counter()
    for (_, tok), (source, lang, n) in ledger.items():
        docs[source, lang, tok] += 1
        tokens[source, lang, tok] += n
    want = sorted((*k, docs[k], tokens[k]) for k in docs)
    store.commit(3, batches[2])
    assert rows_of(store.totals()) == want == rows_of(store.recounted())


def test_a_batch_that_comes_back_empty_takes_back_its_rows(spark):
    store = token_counts.Rollup(spark, tempfile.mkdtemp())
    first = spark.createDataFrame([("insert", 1, 1, "x", "en", "a", 5), ("insert", 1, 2, "x", "en", "a", 7)], CHANGE)
    second = spark.createDataFrame([("delete", 1, 1, None, None, "a", None), ("insert", 1, 3, "y", "de", "a", 2)], CHANGE)
    store.commit(1, first)
    store.commit(2, second)
    assert rows_of(store.totals()) == [("x", "en", "a", 1, 7), ("y", "de", "a", 1, 2)]
    for _ in range(2):
        store.commit(2, second.limit(0))
        assert rows_of(store.totals()) == [("x", "en", "a", 2, 12)] == rows_of(store.recounted())
    store.commit(3, second.limit(0))
    store.commit(2, second)
    assert rows_of(store.totals()) == [("x", "en", "a", 1, 7), ("y", "de", "a", 1, 2)] == rows_of(store.recounted())
    store.commit(1, first.limit(0))
    store.commit(2, second)
    assert rows_of(store.totals()) == [("y", "de", "a", 1, 2)] == rows_of(store.recounted())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "Ab, 12!", None, None, 1), (2, None, "en", "s", 2), (3, "", "en", "s", 3), (None, "x", "en", "s", 4), (4, "w " * 50_000, "en", "s", 5)],
                                 "doc_id long, text string, lang string, source string, batch int")
    got = {(r.doc_id, r.tokenizer): r.n_tokens for r in token_counts.counted(docs).collect()}
    assert got[1, "words-1"] == 2 and got[1, "pieces-1"] == 4 and got[2, "words-1"] == got[3, "pieces-1"] == 0 and got[4, "pieces-1"] == 50_000
    assert ("", "und", "words-1", 1, 2) in rows_of(token_counts.corpus_totals(docs, tempfile.mkdtemp()))
    assert token_counts.corpus_totals(docs.limit(0), tempfile.mkdtemp()).count() == 0
