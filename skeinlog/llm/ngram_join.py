"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A text's set is that of its distinct word n-grams, as 64-bit hashes, its letters A-Z lowered. Texts of equal sets form a
class, and only one of each class goes on. A count table of hashed n-grams over the whole corpus orders n-grams from rare
to frequent; any order is right, this one keeps frequent n-grams out of the prefixes. Two sets that are as like as asked
share an n-gram of both prefixes, the first ``n - ceil(t * n) + 1`` of each in that order. Prefix n-grams are shuffled with
size and place; sets that meet on one are candidates unless their sizes (length filter), what is left behind the shared
n-gram (positional filter) or the histograms of the sets over parts of the universe (suffix filter) rule it out. Candidates are made
distinct and each is verified once, on the sets themselves.

An n-gram on which more than ``GROUP`` sets meet makes no pairs. Its sets are dealt into blocks of bounded size, every two
blocks are compared in one task as one matrix product, and what leaves the task is a spanning forest of the links found:
no link between components is lost, and rows grow with the sets, not with their pairs.

Defined cases: a text of fewer words than n is one n-gram, its whole sequence; without words, or with a null text, it has
the empty set, which links with nothing. Rows with a null id get their set's size and no component. Rows that share an id
are one node: its links are those of all its texts. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.components import components, forest
from skeinlog.llm.shared import sliced, written
from skeinlog.llm.words import PACKED, packed, shingle_sets, summed

#: Cells of the count table.
CELLS = 1 << 20
#: Sets that meet on one n-gram and still make pairs; beyond, they are compared in blocks.
GROUP = 32
#: N-grams of all sets of a block together, about.
BLOCK = 400_000
#: Sets of a block, about: two blocks make a matrix of so many rows and columns.
ROWS = 2048
#: Rows of that matrix that are tested at a time.
STRIP = 256
#: Buckets of the suffix histogram.
BUCKETS = 64


def sets_of(texts: list[str | None], size: int):
    return shingle_sets([lowered(t) for t in texts], size)


_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str | None) -> str | None:
    return None if text is None else text.lower() if text.isascii() else text.translate(_LOWER)


def cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(44)).astype(np.int64)


def needed(a, b, percent: int):
    """Least number of shared n-grams of sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def ordered(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """From rare to frequent, ties by hash."""
    return grams[np.lexsort((grams, counts[cell(grams)]))]


def _measure(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, size and hash of its set; and the count tables of all tasks, with null ids and hashes."""
    def run(batches):
        from pyspark import TaskContext
        table = np.zeros(CELLS, np.int64)
        for batch in sliced(batches):
            sizes, hashes = [], []
            for grams in sets_of(batch.column("text").to_pylist(), size):
                np.add.at(table, cell(grams), 1)
                sizes.append(len(grams))
                hashes.append(md5(grams.tobytes()).digest() if len(grams) else None)
            nothing = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), nothing, nothing,
                                              pa.nulls(batch.num_rows, pa.binary())], ["doc_id", "n", "same", "chunk", "part", "counts"])
        for part in packed(table, TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *part.columns], ["doc_id", "n", "same", "chunk", "part", "counts"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, n bigint, same binary, {PACKED}")
    return written(rows.withColumn("rid", F.monotonically_increasing_id()), "ngram-sizes")


def _prefixes(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """Per row with n-grams: doc_id, hash and size of its set, its prefix and the histogram of the set."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.uint32))

    def run(batches):
        for batch in sliced(batches):
            ids, out = batch.column("doc_id").to_pylist(), []
            for doc, grams in zip(ids, sets_of(batch.column("text").to_pylist(), size), strict=True):
                if doc is None or not len(grams):
                    continue
                line = ordered(grams, shared.value)
                spread = np.bincount((line & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                out.append((doc, md5(grams.tobytes()).digest(), len(line), line[:prefix_length(len(line), percent)].tobytes(), spread.astype(np.uint32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                                 ["doc_id", "same", "n", "prefix", "spread"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, same binary, n bigint, prefix binary, spread binary")


def _postings(classes: DataFrame) -> DataFrame:
    """A row for each prefix n-gram of each class: gram, class, size, place."""
    def run(batches):
        for batch in batches:
            rids, ns, prefixes = (c.to_pylist() for c in batch.columns)
            lengths = np.array([len(p) // 8 for p in prefixes], np.int64)
            if not lengths.sum():
                continue
            grams = np.frombuffer(b"".join(prefixes), np.int64)
            place = np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            for k in range(0, len(grams), 200_000):
                part = slice(k, k + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(grams[part]), pa.array(np.repeat(np.array(rids, np.int64), lengths)[part]), pa.array(np.repeat(np.array(ns, np.int64), lengths)[part]),
                                                  pa.array(place[part].astype(np.int32))], ["gram", "rid", "n", "place"])

    return classes.select("rid", "n", "prefix").mapInArrow(run, "gram bigint, rid bigint, n bigint, place int")


def _meet(postings: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, gram): a pair of classes that may be alike, or, with null b, a class of an n-gram with too many."""
    def pairs(gram, rid, n, place):
        """All rows of several n-grams, in order. An n-gram of more than GROUP rows gives each of its rows."""
        new = np.concatenate([[True], gram[1:] != gram[:-1]])
        group = np.cumsum(new) - 1
        size = np.bincount(group)[group]
        many = size > GROUP
        a, b, g = [rid[many]], [np.full(many.sum(), -1)], [gram[many]]
        for k in range(1, GROUP):
            i = np.flatnonzero((group[:-k] == group[k:]) & ~many[:-k]) if len(group) > k else np.zeros(0, np.int64)
            if not len(i):
                break
            j = i + k
            ni, nj = n[i], n[j]
            most = np.minimum(place[i], place[j]) + 1 + np.minimum(ni - place[i], nj - place[j]) - 1
            good = (ni * 100 >= percent * nj) & (nj * 100 >= percent * ni) & (most >= needed(ni, nj, percent))
            a.append(np.minimum(rid[i], rid[j])[good])
            b.append(np.maximum(rid[i], rid[j])[good])
            g.append(np.zeros(good.sum(), np.int64))
        a, b, g = np.concatenate(a), np.concatenate(b), np.concatenate(g)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b < 0), pa.array(g)], ["a", "b", "gram"])

    def run(batches):
        held, large = None, None  # rows of the last n-gram seen; whether it is known to have too many
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not batch.num_rows:
                continue
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            gram = rows[0]
            if large is not None:  # the n-gram goes on: its rows pass through as they come
                through = int(np.searchsorted(gram != large, True)) if (gram != large).any() else len(gram)
                if through:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[1][:through]), pa.nulls(through, pa.int64()), pa.array(gram[:through])], ["a", "b", "gram"])
                rows = [c[through:] for c in rows]
                gram, held = rows[0], None
                if not len(gram):
                    continue
                large = None
            cut = int(np.flatnonzero(gram == gram[-1])[0])
            if cut:
                yield from pairs(*(c[:cut] for c in rows))
            held = [c[cut:] for c in rows]
            if len(held[0]) > GROUP:
                large = held[0][0]
                yield from pairs(*held)
                held = None
        if held is not None and len(held[0]):
            yield from pairs(*held)

    parts = postings.repartition("gram").sortWithinPartitions("gram", "n", "rid")
    return parts.mapInArrow(run, "a bigint, b bigint, gram bigint")


def shared_counts(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Number of common n-grams of every set with every other one, by matrix products over those that occur twice."""
    flat = np.concatenate([*sets, *others])
    row = np.repeat(np.arange(len(sets) + len(others)), [len(s) for s in [*sets, *others]])
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    twice = count > 1
    column = np.cumsum(twice) - 1
    keep = twice[at]
    row, at = row[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(sets), len(others)), np.float32)  # exact: a count is far below 2^24
    for low in range(0, int(twice.sum()), 2048):
        a, b = np.searchsorted(at, [low, low + 2048])
        dense = np.zeros((len(sets) + len(others), 2048), np.float32)
        dense[row[a:b], at[a:b] - low] = 1
        out += dense[:len(sets)] @ dense[len(sets):].T
    return out


def _verify_pairs(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) among ``pairs`` (a, b) of classes, whose texts are in ``texts`` (rid, doc_id, text)."""
    firsts = pairs.select("a").distinct().join(texts, F.col("a") == F.col("rid")).select("a", "doc_id", F.lit(0).alias("later"), "text")
    seconds = pairs.join(texts, F.col("b") == F.col("rid")).select("a", "doc_id", F.lit(1).alias("later"), "text")

    def run(batches):
        own = at = owner = None
        for batch in sliced(batches):
            firsts, ids, later = (batch.column(c).to_pylist() for c in ("a", "doc_id", "later"))
            u, v = [], []
            for a, doc, second, grams in zip(firsts, ids, later, sets_of(batch.column("text").to_pylist(), size), strict=True):
                if not second:
                    own, at, owner = grams, a, doc
                elif a == at:
                    both = len(np.intersect1d(own, grams, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(grams) - both):
                        u.append(owner)
                        v.append(doc)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    rows = firsts.unionByName(seconds).repartition("a").sortWithinPartitions("a", "later")
    return rows.mapInArrow(run, "u bigint, v bigint")


def _verify_blocks(crowded: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Spanning forests of the links among the classes of every crowded n-gram; ``crowded`` has (gram, rid, n)."""
    rows = _dealt(crowded).join(texts, "rid").select("gram", "low", "high", "first", "doc_id", "text")
    return rows.groupBy("gram", "low", "high").applyInArrow(_block_links(size, percent), "u bigint, v bigint")


def _dealt(crowded: DataFrame) -> DataFrame:
    """Each class in every pair of blocks that has its own; blocks are bounded in n-grams and in rows."""
    several = F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / ROWS))
    blocks = crowded.groupBy("gram").agg(several.cast("int").alias("blocks"))
    dealt = crowded.join(blocks, "gram").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return dealt.select("gram", "rid", "own", other.alias("other")).select(
        "gram", "rid", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("first"))


def _block_links(size: int, percent: int):
    """Spanning forest of the links of two blocks, or of one with itself."""
    def links(table: pa.Table) -> pa.Table:
        first = np.array(table["first"].to_pylist(), bool)
        ids, grams = np.array(table["doc_id"].to_pylist(), np.int64), list(sets_of(table["text"].to_pylist(), size))
        same = table["low"][0].as_py() == table["high"][0].as_py()
        left = np.flatnonzero(first)
        right = left if same else np.flatnonzero(~first)
        if not len(left) or not len(right):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        counts = shared_counts([grams[i] for i in left], [grams[i] for i in right])
        sizes, edges = np.array([len(g) for g in grams], np.int64), []
        for k in range(0, len(left), STRIP):
            rows, both = left[k:k + STRIP], counts[k:k + STRIP].astype(np.int64)
            i, j = np.nonzero(100 * both >= percent * (sizes[rows][:, None] + sizes[right][None, :] - both))
            edges.append(forest(ids[rows[i]], ids[right[j]]))
        u, v = forest(*(np.concatenate(e) for e in zip(*edges, strict=True)))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
    return links


def joined(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id reachable by links."""
    every = _measure(docs, size)
    members = every.filter("chunk is null").select("rid", "doc_id", "n", "same")
    counts = summed(every.filter("chunk is not null").select("chunk", "part", "counts"), CELLS)
    sets = members.filter("same is not null and doc_id is not null")
    rep = F.min(F.struct("doc_id", "rid"))
    classes = sets.groupBy("same").agg(rep.alias("rep")).select("same", "rep.doc_id", "rep.rid")
    prefixes = _prefixes(docs, counts, size, percent).join(classes, ["doc_id", "same"]).dropDuplicates(["rid"])
    prefixes = written(prefixes.select("rid", "doc_id", "same", "n", "prefix", "spread"), "ngram-prefixes")
    met = written(_meet(_postings(prefixes), percent), "ngram-candidates")

    facts = prefixes.select("rid", "n", "spread")
    a, b = (facts.select(*[F.col(c).alias(f"{c}_{x}") for c in facts.columns]) for x in "ab")
    pairs = met.filter("b is not null").select("a", "b").distinct()
    pairs = pairs.join(a, F.col("a") == F.col("rid_a")).join(b, F.col("b") == F.col("rid_b"))
    pairs = written(pairs.mapInArrow(_suffix_filter(percent), "a bigint, b bigint"), "ngram-pairs")
    crowded = met.filter("b is null").select("gram", F.col("a").alias("rid")).join(facts.select("rid", "n"), "rid")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rid")).unionByName(crowded.select("rid")).distinct()
    wanted = prefixes.select("rid", "doc_id", "same").join(wanted, "rid")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null").join(wanted, "doc_id")
    texts = written(texts.mapInArrow(_right_text(size), "rid bigint, doc_id bigint, text string"), "ngram-texts")
    links = _verify_pairs(pairs, texts, size, percent).unionByName(_verify_blocks(crowded, texts, size, percent))

    own = sets.join(classes.select("same", F.col("doc_id").alias("rep")), "same").select("rid", "doc_id", "rep")
    own = written(own, "ngram-classes")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("doc_id")
    shared = own.join(several, "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    groups = components(links.unionByName(shared))
    known = own.select("rid", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("rid", F.coalesce("component", "rep").alias("found"))
    return members.join(known, "rid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"))


def _suffix_filter(percent: int):
    """Pairs whose histograms leave room for enough common n-grams: these fall into equal parts of the universe."""
    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BUCKETS).astype(np.int64) for c in ("spread_a", "spread_b"))
            good = pa.array(np.minimum(sa, sb).sum(axis=1) >= needed(na, nb, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in "ab"], ["a", "b"])
    return run


def _right_text(size: int):
    """Of rows that share an id, those whose set is the one asked for."""
    def run(batches):
        for batch in sliced(batches):
            good = [md5(g.tobytes()).digest() == want for g, want in zip(sets_of(batch.column("text").to_pylist(), size), batch.column("same").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("rid", "doc_id", "text")], ["rid", "doc_id", "text"])
    return run
