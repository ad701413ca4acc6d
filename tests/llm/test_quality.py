import zlib

import numpy as np

from skeinlog.llm import quality


def test_flat_walk_equals_a_plain_one():
    pick = np.random.default_rng(1)
    x = pick.normal(size=(600, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 4] > 0)).astype(float)
    model = quality.fit(x, y)

    def plain(row):
        margin = model["start"]
        for tree in model["trees"]:
            node = 0
            while node < 2**quality.DEPTH - 1:
                node = 2 * node + (2 if row[tree["feature"][node]] > tree["bound"][node] else 1)
            margin += tree["value"][node]
        return 1 / (1 + np.exp(-margin))

    got = quality.score(model, x)
    assert np.allclose(got, [plain(r) for r in x]) and ((got > 0.5) == y).mean() > 0.95


def test_statistics():
    names = quality.STATISTICS
    got = quality.statistics(["Ab 1!\nAb 1!", "", None, "x x x x"])
    row = dict(zip(names, got[0], strict=True))
    assert np.isclose(row["upper"], 2 / 11) and np.isclose(row["new_lines"], 0.5) and np.isclose(row["new_words"], 0.5)
    assert not got[1].any() and not got[2].any()
    assert dict(zip(names, got[3], strict=True))["same_again"] == 1


def test_held_out_labels(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    got = quality.predictions(docs, labels).join(labels, "doc_id", "left").collect()
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got} == {True}
    held = [r for r in got if r.held_out and r.quality is not None]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all((r.predicted == 1) == (r.score >= 0.3) for r in got)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "good text here", 1), (1, "good text here", 1), (2, None, 1), (3, "", 1), (None, "x " * 200_000, 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    assert quality.predictions(docs, labels).count() == 5
    assert {r.score for r in quality.predictions(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.predictions(docs.limit(0), labels).count() == 0
