"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text are computed for many texts at once on their bytes. Training bins each statistic by its quantiles in
the training sample and grows trees level by level from histograms of gradients; the trees are flattened into arrays,
and scoring walks all texts down one tree at a time in numpy.

The trees are fitted on the driver on a sample of at most ``SAMPLE`` labelled rows, chosen by a hash of the id, so that
reruns agree; that bound is the only one. Every row is scored, over its whole text.

Defined cases: null text counts as empty; empty texts have all statistics 0 and get the score that these lead to. Null
labels and null ids teach nothing. A document with several labels teaches each of them. Without any label the score is
0.5. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.shared import fold_of, sliced
from skeinlog.llm.words import joined, shingles, words_of

SAMPLE = 16_000
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, SHRINK = 60, 4, 0.2, 64, 2.0, 1.0
CUT = 0.3

_ASCII = np.arange(256)
CLASSES = {
    "upper": (_ASCII >= 65) & (_ASCII <= 90), "lower": (_ASCII >= 97) & (_ASCII <= 122), "digit": (_ASCII >= 48) & (_ASCII <= 57),
    "foreign": _ASCII >= 128, "space": np.isin(_ASCII, [32, 9, 10, 11, 12, 13]), "line": _ASCII == 10,
    "stop": np.isin(_ASCII, [*b".,;:?"]), "shout": _ASCII == 33, "sign": np.isin(_ASCII, [*b"#$%&*@^~|<>{}[]\\/=+_"]),
}
STATISTICS = ["log_bytes", "log_words", "bytes_per_word", *CLASSES, "spread", "new_words", "same_again", "new_triples", "bytes_per_line", "new_lines", "longest_word"]


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    data, origin = joined(texts)
    sizes = np.diff(origin) - 1  # the line feed between two texts belongs to none
    out = np.zeros((len(texts), len(STATISTICS)))
    if not sizes.any():
        return out
    column = {name: out[:, i] for i, name in enumerate(STATISTICS)}
    many = np.maximum(sizes, 1)
    for name, members in CLASSES.items():
        sums = np.concatenate([[0], np.cumsum(members[data])])
        column[name][:] = (sums[origin[:-1] + sizes] - sums[origin[:-1]]) / many
    starts, ends, hashes = words_of(data)
    first = np.searchsorted(starts, origin)
    triples = shingles(hashes, 3)
    line_feeds = np.flatnonzero(data == 10)
    for i in np.flatnonzero(sizes):
        a, b = first[i], first[i + 1]
        low, high = int(origin[i]), int(origin[i] + sizes[i])
        share = np.bincount(data[low:high], minlength=256) / sizes[i]
        share = share[share > 0]
        out[i, 0], out[i, 1] = np.log1p(sizes[i]), np.log1p(b - a)
        column["spread"][i] = -(share * np.log2(share)).sum()
        if b > a:
            some = hashes[a:b]
            column["bytes_per_word"][i] = sizes[i] / (b - a)
            column["longest_word"][i] = (ends[a:b] - starts[a:b]).max()
            column["new_words"][i] = len(np.unique(some)) / (b - a)
            column["same_again"][i] = (some[1:] == some[:-1]).mean() if b - a > 1 else 0
            column["new_triples"][i] = len(np.unique(triples[a:b - 2])) / (b - a - 2) if b - a > 2 else 1
        inner = line_feeds[np.searchsorted(line_feeds, low):np.searchsorted(line_feeds, high)]
        lines = data[low:high].tobytes().split(b"\n") if len(inner) else [b""]
        column["bytes_per_line"][i] = sizes[i] / len(lines)
        column["new_lines"][i] = len({*lines}) / len(lines)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Flattened trees: for each tree, per node the statistic, the bin bound, the left child and the value."""
    if not len(y):
        return {"start": 0.0, "cuts": [], "trees": []}
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)  # bin b: up to cuts[b]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    margin, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_tree(bins, p - y, p * (1 - p), cuts))
        margin += walk(trees[-1], x)
    return {"start": start, "cuts": cuts, "trees": trees}


def _tree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> dict:
    """One tree, grown level by level; a node that doesn't split sends all rows to the left."""
    nodes = 2 ** (DEPTH + 1) - 1
    feature, bound, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
    node = np.zeros(len(g), np.int64)
    for depth in range(DEPTH):
        low, count = 2**depth - 1, 2**depth
        gains = np.zeros(count)
        split = np.full(count, -1)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            key = (node - low) * BINS + bins[:, f]
            sg = np.bincount(key, g, count * BINS).reshape(count, BINS).cumsum(axis=1)
            sh = np.bincount(key, h, count * BINS).reshape(count, BINS).cumsum(axis=1)
            tg, th = sg[:, -1:], sh[:, -1:]
            gain = sg**2 / (sh + SHRINK) + (tg - sg) ** 2 / (th - sh + SHRINK) - tg**2 / (th + SHRINK)
            gain[(sh < LEAST_WEIGHT) | (th - sh < LEAST_WEIGHT)] = 0
            best = gain[:, :len(c)].argmax(axis=1)
            top = gain[np.arange(count), best]
            for k in np.flatnonzero(top > gains + 1e-9):
                gains[k], split[k], feature[low + k], bound[low + k] = top[k], best[k], f, c[best[k]]
        at = node - low
        goes = (split[at] >= 0) & (bins[np.arange(len(g)), feature[node]] > split[at])
        node = 2 * node + 1 + goes
    low = 2**DEPTH - 1
    sums, weights = np.bincount(node - low, g, low + 1), np.bincount(node - low, h, low + 1)
    value[low:] = -RATE * sums / (weights + SHRINK)
    return {"feature": feature, "bound": bound, "value": value}


def walk(tree: dict, x: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(DEPTH):
        node = 2 * node + 1 + (x[rows, tree["feature"][node]] > tree["bound"][node])
    return tree["value"][node]


def score(model: dict, x: np.ndarray) -> np.ndarray:
    margin = np.full(len(x), model["start"])
    for tree in model["trees"]:
        margin += walk(tree, x)
    return 1 / (1 + np.exp(-margin))


def _measured(docs: DataFrame, extra: dict[str, pa.DataType], ddl: str, more) -> DataFrame:
    """Per row: doc_id and the columns that ``more(batch, statistics)`` gives."""
    def run(batches):
        for batch in sliced(batches):
            new = more(batch, statistics(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(new, extra.values(), strict=True))], ["doc_id", *extra])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {ddl}")


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> dict:
    """Trees of a bounded sample of labelled documents."""
    known = labels.select("doc_id", F.col(target).cast("double").alias("_y")).filter(F.col("doc_id").isNotNull() & F.col("_y").isNotNull())
    share = min(1.0, 0.9 * sample / max(known.count(), 1))
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most ``sample`` ids and labels
    found = _measured(rows, {"y": pa.float64(), "x": pa.list_(pa.float64())}, "y double, x array<double>", lambda b, x: (b.column("_y").to_pylist(), x.tolist())).collect()
    found.sort(key=lambda r: (r.doc_id, r.y, r.x))
    return fit(np.array([r.x for r in found]).reshape(len(found), len(STATISTICS)), np.array([r.y for r in found]))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _measured(docs.select("doc_id", "text"), {"score": pa.float64()}, "score double", lambda b, x: (score(shared.value, x).tolist(),))


def predictions(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted; labels of the held-out fold of ids are not learned from."""
    model = train(docs, labels.filter(fold_of(F.col("doc_id"), folds) != held_out))
    return scored(docs, model).select("doc_id", F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
                                      "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
