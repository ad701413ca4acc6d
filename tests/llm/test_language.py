import itertools
import zlib

import numpy as np

from skeinlog.llm import language


def test_best_path_equals_all_paths_tried():
    pick = np.random.default_rng(2)
    sizes = np.array([3, 0, 5, 1, 4])
    scores = pick.normal(size=(sizes.sum(), 3)) * 4
    got, at = language.best_path(scores, sizes, 2.5), 0
    for n in sizes:
        some = scores[at:at + n]
        worth = lambda p: sum(some[i, x] for i, x in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731,B023
        if n:
            assert np.isclose(worth(tuple(got[at:at + n])), max(map(worth, itertools.product(range(3), repeat=int(n)))))
        at += n


def rows_of(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark):
    docs = rows_of(spark)
    got = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got} == {True}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_mixed_text_gets_spans(spark):
    train = spark.createDataFrame([("en", "the house and the garden of the king with water " * 20), ("de", "das haus und der garten des königs mit wasser nicht " * 20), ("el", "το σπίτι και ο κήπος του βασιλιά " * 20)], "lang string, text string")
    model = language.train(train)
    english, german, greek = "The garden of the king and the house", "der garten des königs und das haus", "και το σπίτι"
    text = f"{english}. {german}! {greek}"
    (pred,), (score,), (spans,) = language.labelled(model, [text])
    assert pred == "en" and 0.3 < score < 0.6
    assert [(n, text.lower()[a:b]) for n, a, b in spans] == [("en", english.lower()), ("de", german), ("el", greek)]


def test_rows(spark):
    rows = [(1, "the king", "en", 1), (1, "the king", "en", 2), (2, None, "de", 3), (3, "", "de", 4), (4, "123 !?", None, 5), (7, "\u0301 \u0300", None, 5), (None, "das haus", "de", 6), (5, "wort " * 40_000, None, 7), (6, "der könig " * 9, "de", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred) for r in language.predictions(docs).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (7, "und")} <= got and len(got) == 8
    assert all(x in ("en", "de", "und") for _, x in got)
    assert language.predictions(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.predictions(docs.withColumn("lang", language.F.lit(None).cast("string"))).collect()} == {"und"}
