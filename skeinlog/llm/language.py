"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Training counts, for every language and over all rows it may learn from, three features of each word: the word, its first
three and its last three letters, each hashed into a table of fixed width; nothing is left out, words that share a cell
share a count. A word's score for a language is the sum of the three log shares, normalised over the candidates. The
candidates are the languages in which at least ``SCRIPT_SHARE`` of the letters belong to the word's script; without any,
all languages. The best path through the words, with ``SWITCH`` off for every change of language, gives spans. The text's
language is the one with most letters in its spans, and the score is its share of all letters.

Defined cases: null text and text without a letter are ``und`` with score 0, as is every text when nothing was learned.
Ties go to the language that comes first by name. Null ids are neither learned from nor held out. Repeated rows count as
often as they occur. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.shared import fold_of, sliced
from skeinlog.llm.words import BASE, INVERSE, PACKED, mixed, packed, powers, summed

#: Fixed ranges of the scripts told apart; letters of all others form one more.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x2FA1F),
]
NAMES = list(dict.fromkeys(name for name, _, _ in SCRIPTS)) + ["other"]
SCRIPT_SHARE = 0.005
SWITCH = 6.0
#: Cells of the three tables together, languages included: what the model takes on the driver and on each worker.
CELLS = 1 << 21
#: Most label values; a column with more holds no languages.
LANGUAGES = 1000
FEATURES = 3
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For every code point 0 if it is no letter, else 1 + its script. Marks join the letters they stand among."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in "LM":
            table[c] = len(NAMES)
    for name, low, high in SCRIPTS:
        part = table[low:high + 1]
        part[part > 0] = 1 + NAMES.index(name)
    return table


def words_of(texts: list[str | None], table: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """The words of all texts: text number, start and end in it, letters, script and the cells of the three features."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    origin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    kinds = table[points]
    inside = np.concatenate([[False], kinds > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * powers(len(points), BASE), dtype=np.uint64)])
    undo = powers(len(points) + 1, INVERSE)
    cell = lambda a, b, k: k * width + (mixed((sums[b] - sums[a]) * undo[a] + np.uint64(k)) % np.uint64(width)).astype(np.int64)
    text = np.searchsorted(origin, start, "right") - 1
    return {
        "text": text, "start": start - origin[text], "end": end - origin[text], "letters": end - start,
        "script": kinds[start].astype(np.int64) - 1,
        "cells": np.stack([cell(start, end, 0), cell(start, np.minimum(start + 3, end), 1), cell(np.maximum(end - 3, start), end, 2)], axis=1),
    }


def train(docs: DataFrame, languages: list[str] | None = None) -> dict:
    """The model of ``docs`` (text, lang); rows without a language or a text teach nothing. One pass over the texts."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    if languages is None:
        languages = sorted(r.lang for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"lang holds more than {LANGUAGES} values")
    if not languages:
        return {"languages": [], "state": {}}
    n, scripts = len(languages), len(NAMES)
    width = CELLS // (FEATURES * n)
    cells, at = FEATURES * width * n, {x: i for i, x in enumerate(languages)}

    def count(batches):
        from pyspark import TaskContext
        table, sums = letter_table(), np.zeros(cells + scripts * n, np.int64)
        for batch in sliced(batches):
            words = words_of(batch.column("text").to_pylist(), table, width)
            lang = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64)[words["text"]]
            for k in range(FEATURES):
                np.add.at(sums, words["cells"][:, k] * n + lang, 1)
            np.add.at(sums, cells + words["script"] * n + lang, words["letters"])
        yield from packed(sums, TaskContext.get().partitionId())

    sums = summed(rows.mapInArrow(count, PACKED), cells + scripts * n)
    counts = sums[:cells].reshape(FEATURES, width, n).astype(np.float64)
    shares = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * width))
    letters = sums[cells:].reshape(scripts, n)
    uses = letters > SCRIPT_SHARE * np.maximum(letters.sum(axis=0, keepdims=True), 1)
    uses[~uses.any(axis=1)] = True
    return {"languages": languages, "width": width, "shares": shares.reshape(-1, n).astype(np.float32), "uses": uses, "state": {}}


def word_scores(model: dict, words: dict[str, np.ndarray]) -> np.ndarray:
    """Log probability of each candidate language for each word; others are far below."""
    scores = model["shares"][words["cells"]].sum(axis=1)
    scores[~model["uses"][words["script"]]] -= 1e4
    scores -= scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def best_path(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word, for all texts side by side: step t takes the t-th word of every text that has one."""
    label = np.zeros(len(scores), np.int64)
    if not len(scores):
        return label
    order = np.argsort(-sizes, kind="stable")
    origin, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 2), "right")  # texts with more than t words; at last none
    came = np.zeros(scores.shape, np.int16)  # the language of the word before, if this word is of the column's language
    best, own = scores[origin[:active[0]]], np.arange(scores.shape[1])
    ends = np.zeros(active[0], np.int64)
    for t in range(len(active) - 1):
        if t:
            at = origin[:active[t]] + t
            top = best.argmax(axis=1)[:, None]
            jump = np.take_along_axis(best, top, 1) - switch
            moves = jump > best
            came[at] = np.where(moves, top, own)
            best = np.where(moves, jump, best) + scores[at]
        ends[active[t + 1]:active[t]] = best[active[t + 1]:].argmax(axis=1)
        best = best[:active[t + 1]]
    now = ends.copy()
    for t in range(len(active) - 2, -1, -1):
        further = active[t + 1]  # these have a word after this one
        now[:further] = came[origin[:further] + t + 1, now[:further]]
        label[origin[:active[t]] + t] = now[:active[t]]
    return label


def labelled(model: dict, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[str, int, int]]]]:
    """Language, score and spans (language, start, end) of each text; spans count code points of the lower-case text."""
    names, out = model["languages"], ([UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts])
    if not names:
        return out
    table = model["state"].get("letters")
    if table is None:
        table = model["state"]["letters"] = letter_table()
    words = words_of(texts, table, model["width"])
    text, label = words["text"], best_path(word_scores(model, words), np.bincount(words["text"], minlength=len(texts)))
    letters = np.bincount(text * len(names) + label, words["letters"], len(texts) * len(names)).reshape(len(texts), -1)
    total = letters.sum(axis=1)
    total[[not any(map(str.isalpha, t or "")) for t in texts]] = 0  # marks alone are no letters
    for i in np.flatnonzero(total):
        first = letters[i].argmax()
        out[0][i], out[1][i] = names[first], float(letters[i][first] / total[i])
    if len(text):
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (label[1:] != label[:-1])]))
        for a, b in zip(new, np.append(new[1:], len(text)) - 1, strict=True):
            if total[text[a]]:
                out[2][text[a]].append((names[label[a]], int(words["start"][a]), int(words["end"][b])))
    return out


def identified(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred, score and lang_spans; columns of these names are replaced."""
    spark = docs.sparkSession
    shared, kept = spark.sparkContext.broadcast(model), docs.drop("lang_pred", "score", "lang_spans")
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in sliced(batches):
            found, score, spans = labelled(shared.value, batch.column("text").to_pylist())
            spans = [[{"lang": n, "start": a, "end": b} for n, a, b in some] for some in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)],
                                             [*batch.schema.names, "lang_pred", "score", "lang_spans"])

    more = spark.createDataFrame([], "lang_pred string, score double, lang_spans array<struct<lang: string, start: int, end: int>>").schema
    return kept.mapInArrow(run, type(more)([*kept.schema.fields, *more.fields]))


def learned(docs: DataFrame, folds: int = 3, held_out: int = 1) -> dict:
    """The model of all documents but those of the held-out fold of ids."""
    return train(docs.filter(fold_of(F.col("doc_id"), folds) != held_out))


def predictions(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score."""
    found = identified(docs.select("doc_id", "text"), learned(docs, folds, held_out))
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
