"""Embedding near-dedup by product quantisation.

Unit vectors fall into coarse lists by their nearest centroid; what the centroid leaves over is coded by the nearest of
``CODES`` code words in each of ``PARTS`` subspaces. A vector looks into its own list and into every list whose cell
border is near enough to be crossed by a link. A link is at most the limit's distance long, and only the part of it that
runs from centroid to centroid counts. How large that part is comes from the sample (``spreads``): the mean square of the
directions of residuals, and of links inside a list, along each line between two centroids, taken of the two lists drawn
towards that of all, and never below that of noise alike in all dimensions. A vector looks ``STEADY`` times the root of it
far. Where the vectors of a list, or of the whole, vary in up to 16 dimensions, however many they have, that is the whole
length of a link and none is missed; where they vary in more, it is four standard deviations.
In a list, distances come from tables of the query's residual against all code words; a pair is dropped only if
that distance, less what coding has moved the other vector, is beyond the limit, which drops no link. Pairs that are left
are decided by their exact cosine in double precision.

Only vectors of one length can be compared, so each length has an index and lists of its own. Centroids and code words are
fitted on at most ``SAMPLE`` vectors of all lengths together, chosen by a hash of the id; every vector is indexed. A length
too rare to be in the sample is one list, whose pairs are all decided by their exact cosine.
Equal vectors are compared once, as one class with a count. Lists are cut into blocks of about ``BLOCK``, and every pair
of blocks is one task, which returns a count for each vector and a spanning forest of the links: rows grow with the
vectors, not with their links.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing, and so do those of null
ids, whose component is null. Rows that share an id are one node of the components.
Repeated rows are links of each other, like any equal vectors. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.components import components, forest
from skeinlog.llm.shared import written

SAMPLE = 16_000
LISTS, PARTS, CODES, BLOCK = 1024, 8, 256, 1024
#: Vectors of a list, at least, about.
PER_LIST = 50
#: Lists for each root of the number of vectors, ``LISTS`` at most. A vector is a row in each list that it looks into, and its table
#: there costs as much as some hundreds of look-ups: lists grow with the root, so neither rows nor look-ups outgrow the other.
PER_ROOT = 0.5
#: Queries whose tables are held at a time.
QUERIES = 256
#: How much further than the average link reaches along one direction a vector looks into other lists.
STEADY = 4.0
#: Vectors of all lists that count beside those of one list in its spread.
PRIOR = 8
LIMIT = 0.95


def _valid(docs: DataFrame) -> DataFrame:
    """Rows (rid, vec_id, same, data): the vector's values as doubles and their hash; null for a vector without links."""
    def run(batches):
        for batch in batches:
            same, data = [], []
            for x in batch.column("embedding").to_pylist():
                x = None if x is None or None in x else np.array(x, np.float64)
                good = x is not None and len(x) and np.isfinite(x).all() and x.any()
                same.append(md5(x.tobytes()).digest() if good else None)
                data.append(x.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(same, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "same", "data"])

    return docs.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, same binary, data binary").withColumn("rid", F.monotonically_increasing_id())


def unit(data: list[bytes], size: int) -> np.ndarray:
    x = np.frombuffer(b"".join(data), np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows; an emptied mean stays where it was."""
    out = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = squared(x, out).argmin(axis=1)
        count = np.bincount(near, minlength=len(out))
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], len(out))
            out[:, d] = np.where(count > 0, total / np.maximum(count, 1), out[:, d])
    return out


def directions(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors, without those that are zero but for rounding."""
    size = np.linalg.norm(x, axis=1)
    return x[size > 1e-9] / size[size > 1e-9, None]


def nearest_links(x: np.ndarray, limit: float) -> np.ndarray:
    """For each vector, the difference to its nearest other one if they are a link."""
    out = []
    for k in range(0, len(x), 1024):
        near = x[k:k + 1024] @ x.T
        near[np.arange(len(near)), k + np.arange(len(near))] = -1
        other = near.argmax(axis=1)
        linked = near[np.arange(len(near)), other] >= limit
        out.append(x[k:k + 1024][linked] - x[other[linked]])
    return np.concatenate(out)


def spreads(coarse: np.ndarray, x: np.ndarray, own: np.ndarray, limit: float) -> np.ndarray:
    """Mean square share, on the line between each two centroids, of what vectors of the two lists differ by."""
    apart = np.maximum(squared(coarse, coarse), 1e-18)
    lists = np.split(np.argsort(own, kind="stable"), np.searchsorted(np.sort(own), np.arange(1, len(coarse))))
    out = np.full(apart.shape, 1 / x.shape[1])
    for kind in (lambda rows, center: rows - center, lambda rows, center: nearest_links(rows, limit)):
        found = [directions(kind(x[rows], center)) if len(rows) > 1 else x[:0] for rows, center in zip(lists, coarse, strict=True)]
        every = np.concatenate(found)
        if not len(every):
            continue
        moment = every.T @ every / len(every)
        for a, rows in enumerate(found):
            lines = coarse[a] - coarse
            share = np.einsum("ij,ij->i", lines @ moment, lines)
            share = (PRIOR * share + ((rows @ lines.T) ** 2).sum(axis=0)) / (PRIOR + len(rows))
            out[a] = np.maximum(out[a], share / apart[a])
    return np.minimum(1.0, np.maximum(out, out.T)).astype(np.float32)


def fit(x: np.ndarray, lists: int, limit: float = LIMIT) -> dict:
    """Coarse centroids, their spreads, and for each subspace its columns and code words."""
    coarse = means(x, lists)
    own = squared(x, coarse).argmin(axis=1)
    left = x - coarse[own]
    columns = [c for c in np.array_split(np.arange(x.shape[1]), PARTS) if len(c)]
    return {"coarse": coarse, "spread": spreads(coarse, x, own, limit), "columns": columns, "words": [means(left[:, c], CODES) for c in columns]}


def coded(index: dict, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals, and how far each one is from what its codes stand for."""
    codes = np.stack([squared(left[:, c], w).argmin(axis=1) for c, w in zip(index["columns"], index["words"], strict=True)], axis=1)
    back = np.concatenate([w[codes[:, k]] for k, w in enumerate(index["words"])], axis=1)
    return codes.astype(np.uint8), np.linalg.norm(left[:, np.concatenate(index["columns"])] - back, axis=1)


def reach(limit: float) -> float:
    """Distance of unit vectors at the limit, and a little for rounding."""
    return float(np.sqrt(max(0.0, 2 - 2 * limit))) + 1e-7


def lists_for(n: int) -> int:
    return max(1, min(LISTS, n // PER_LIST, int(PER_ROOT * n**0.5)))


def probes(index: dict, x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest list of each vector, and which lists are near enough to hold a vector within the limit."""
    coarse = index["coarse"]
    far = squared(x, coarse)
    own = far.argmin(axis=1)
    apart = np.sqrt(squared(coarse[own], coarse))
    least = far[np.arange(len(x)), own][:, None]
    return own, far - least <= 2 * apart * reach(limit) * np.minimum(1.0, STEADY * np.sqrt(index["spread"][own])) + 1e-9


def likely(index: dict, center: np.ndarray, queries: np.ndarray, codes: np.ndarray, error: np.ndarray, limit: float) -> np.ndarray:
    """Whether query and coded vector may be within the limit, by table look-ups."""
    left, out = queries - center, np.empty((len(queries), len(codes)), bool)
    most = (reach(limit) + 1e-7 + error[:, None]) ** 2
    for at in range(0, len(left), QUERIES):
        some = left[at:at + QUERIES]
        total = np.repeat((some**2).sum(axis=1)[None, :], len(codes), axis=0)
        for k, (c, words) in enumerate(zip(index["columns"], index["words"], strict=True)):
            # a row of the table for each code word: a look-up copies whole rows
            total += ((words**2).sum(axis=1)[:, None] - 2 * words @ some[:, c].T)[codes[:, k]]
        out[at:at + QUERIES] = (total <= most).T
    return out


def exact(x: np.ndarray, y: np.ndarray, maybe: np.ndarray, limit: float) -> np.ndarray:
    """Of the pairs that may be, those whose cosine reaches the limit."""
    i, j = np.nonzero(maybe)
    if len(i) * 8 > maybe.size:
        return maybe & (x @ y.T >= limit)
    out = np.zeros_like(maybe)
    for k in range(0, len(i), 1 << 15):
        a, b = i[k:k + (1 << 15)], j[k:k + (1 << 15)]
        out[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= limit
    return out


def _placed(classes: DataFrame, indexes: dict[int, dict], limit: float) -> DataFrame:
    """Each class in its own list, with codes, and as a query in every earlier list that it has to look into."""
    shared = classes.sparkSession.sparkContext.broadcast(indexes)

    def lists(index, x):
        if index is None:
            return np.zeros(len(x), np.int64), np.zeros((len(x), 1), bool), np.zeros((len(x), 0), np.uint8), np.zeros(len(x))
        own, may = probes(index, x, limit)
        return own, may & (np.arange(may.shape[1])[None, :] < own[:, None]), *coded(index, x - index["coarse"][own])

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                part = whole.slice(k, 2048)
                sizes = part.column("size").to_numpy()
                for size in np.unique(sizes):
                    batch = part.take(pa.array(np.flatnonzero(sizes == size)))
                    x = unit(batch.column("data").to_pylist(), int(size))
                    own, may, codes, error = lists(shared.value.get(int(size)), x)
                    i, other = np.nonzero(may)
                    row = np.concatenate([np.arange(len(x)), i])
                    took = batch.take(pa.array(row))
                    asks = np.arange(len(row)) >= len(x)
                    yield pa.RecordBatch.from_arrays([
                        took.column("size"), pa.array(np.concatenate([own, other]).astype(np.int32)), pa.array(asks), took.column("vec_id"), took.column("copies"), took.column("data"),
                        pa.array([codes[r].tobytes() for r in row], pa.binary()), pa.array(error[row])], ["size", "list", "asks", "vec_id", "copies", "data", "codes", "error"])

    return classes.select("size", "vec_id", "copies", "data").mapInArrow(run, "size int, list int, asks boolean, vec_id bigint, copies bigint, data binary, codes binary, error double")


def _compared(placed: DataFrame, indexes: dict[int, dict], limit: float) -> DataFrame:
    """Rows (u, v, n): with null v, n links more of vector u; else an edge of the forest."""
    shared = placed.sparkSession.sparkContext.broadcast(indexes)
    counts = placed.groupBy("size", "list").agg(F.ceil(F.sum((~F.col("asks")).cast("int")) / BLOCK).cast("int").alias("own"), F.ceil(F.sum(F.col("asks").cast("int")) / BLOCK).cast("int").alias("others"))
    rows = placed.join(F.broadcast(counts), ["size", "list"])  # a row a list, LISTS at most for each length
    mine = F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.when(F.col("asks"), F.col("others")).otherwise(F.col("own")))).cast("int")
    rows = rows.withColumn("mine", mine)
    task = lambda kind, x, y, left: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"), left.alias("left"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    among = F.transform(upto(F.col("own")), lambda b: task(0, F.least("mine", b), F.greatest("mine", b), F.col("mine") <= b))
    asked = F.when(F.col("others") > 0, F.transform(upto(F.col("others")), lambda b: task(1, b, F.col("mine"), F.lit(False)))).otherwise(F.array().cast("array<struct<kind:int,x:int,y:int,left:boolean>>"))
    asking = F.when(F.col("own") > 0, F.transform(upto(F.col("own")), lambda b: task(1, F.col("mine"), b, F.lit(True)))).otherwise(F.array().cast("array<struct<kind:int,x:int,y:int,left:boolean>>"))
    tasks = F.explode(F.when(F.col("asks"), asking).otherwise(F.concat(among, asked)))
    rows = rows.select("size", "list", tasks.alias("t"), "vec_id", "copies", "data", "codes", "error").select("size", "list", "t.*", "vec_id", "copies", "data", "codes", "error")

    def links(table: pa.Table) -> pa.Table:
        first = np.array(table["left"].to_pylist(), bool)
        ids, copies, error = (table[c].to_numpy() for c in ("vec_id", "copies", "error"))
        size = table["size"][0].as_py()
        x, index = unit(table["data"].to_pylist(), size), shared.value.get(size)
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        same = table["kind"][0].as_py() == 0 and table["x"][0].as_py() == table["y"][0].as_py()
        a = np.flatnonzero(first)
        b = a if same else np.flatnonzero(~first)
        maybe = np.ones((len(a), len(b)), bool) if index is None else likely(index, index["coarse"][table["list"][0].as_py()], x[a], codes[b], error[b], limit)
        found = exact(x[a], x[b], maybe, limit)
        if same:
            found |= found.T  # rounding must not make a link one-sided
            np.fill_diagonal(found, False)
        more_a, more_b = found @ copies[b], found.T @ copies[a]
        if same:
            more_b[:] = 0
        u, v = forest(ids[a[np.nonzero(found)[0]]], ids[b[np.nonzero(found)[1]]])
        count = np.concatenate([more_a, more_b]).astype(np.int64)
        whose = np.concatenate([ids[a], ids[b]])[count > 0]
        count = count[count > 0]
        return pa.table({"u": pa.array(np.concatenate([whose, u]), pa.int64()), "v": pa.array(np.concatenate([whose, v]), pa.int64(), mask=np.arange(len(whose) + len(u)) < len(whose)),
                         "n": pa.array(np.concatenate([count, np.zeros(len(u), np.int64)]), pa.int64())})

    return rows.groupBy("size", "list", "kind", "x", "y").applyInArrow(links, "u bigint, v bigint, n bigint")


def joined(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Per row: vec_id, n_links, component_id (the smallest id reachable) and kept."""
    every = written(_valid(vectors), "vectors")
    members = every.filter("data is not null and vec_id is not null")
    rep = members.groupBy("same").agg(F.min(F.struct("vec_id", "rid")).alias("rep"), F.count("*").alias("copies")).select("same", "rep.*", "copies")
    rep = written(rep, "vector-classes")
    size = F.expr("cast(length(data) div 8 as int)").alias("size")
    classes = written(members.select("rid", "data", size).join(rep, "rid"), "vector-index")
    many = {r["size"]: r["count"] for r in classes.groupBy("size").count().collect()}
    n = sum(many.values())
    some = classes.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < int(min(1.0, 0.9 * SAMPLE / max(n, 1)) * (1 << 30)) + 1).select("vec_id", "data").limit(SAMPLE).collect()
    if not n:
        return every.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    drawn = defaultdict(list)
    for r in sorted(some):
        drawn[len(r.data) // 8].append(bytes(r.data))
    indexes = {size: fit(unit(data, size), lists_for(many[size]), limit) for size, data in drawn.items()}
    found = written(_compared(_placed(classes, indexes, limit), indexes, limit), "vector-links")
    more = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("more")).select(F.col("u").alias("rep"), "more")
    own = written(members.select("rid", "vec_id", "same").join(rep.select("same", F.col("vec_id").alias("rep"), F.col("rid").alias("class"), "copies"), "same"), "vector-members")
    several = own.groupBy("vec_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("vec_id")
    shared = own.join(several, "vec_id").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    groups = components(found.filter("v is not null").select("u", "v").unionByName(shared)).withColumnRenamed("node", "rep")
    facts = own.select("rid", "rep", "copies").join(more, "rep", "left").join(groups, "rep", "left").select(
        "rid", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("found"))
    out = every.select("rid", "vec_id").join(facts, "rid", "left")
    component = F.coalesce("found", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
