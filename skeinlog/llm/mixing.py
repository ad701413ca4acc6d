"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is how often each of its documents should be taken: a whole number of copies, and one
more with the probability that is left. Two documents with such a probability are paired: words move from one to the
other, in a random direction whose odds keep both probabilities right on average, until one of the two is settled at
taken or not taken. The pair's expected words stay what they were, so whatever order documents are paired in, a source
ends with one open document, and its taken words differ from its target by less than that document has.

Mass moves between unlike documents until the small one is settled, so the open one tends to be large. Therefore documents
of more than 1/``FAN`` of their source or target go first; their open one is settled at the side whose rest the others can
still be taken for (by its odds where both are), and the others' rate is what then is left. So a source ends within one of
its small documents of the target, unless its large ones alone are further off than the small ones have words.

Pairs are made along a tree: documents of a source fall into leaves of about ``FAN`` by a hash of the id; each leaf folds
its documents into one open one; the open ones of ``FAN`` leaves form the next level's group. So no group grows with the
source, whatever its share of all rows, and levels grow with the logarithm of the largest source. All draws are hashes of
ids and levels: reruns agree.

Defined cases: null text has size 0, documents of size 0 are taken 0 words and target nothing; a null source is a source
of its own, the last in order. Rows are taken one by one, so a repeated id is as many documents. Null ids are documents,
too. Columns other than doc_id, text and source are carried along untouched, whatever their names. Empty tables mix to
empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.shared import WORD, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
FAN = 64
SEED = 20240229
#: Most sources for which a table of targets is broadcast (about 100 bytes each); beyond, the join is salted.
SMALL_SOURCES = 100_000
SALTS = 64


def ranked_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size, n_docs), one row a source, with each source's ``target``.

    The targets are the level of a basin: each source takes level times its weight, but no more than ``MOST_COPIES``
    times its size. Every round sums up, over all sources, what is capped at the present level, and shares out the rest.
    """
    spark = sizes.sparkSession
    placed = sizes.withColumn("_missing", F.col("source").isNull()).repartitionByRange("_missing", "source")
    placed = placed.sortWithinPartitions("_missing", "source").select("source", "source_size", "n_docs", F.monotonically_increasing_id().alias("_at"))
    placed = written(placed, "mix-sources")  # the order of the ids is kept
    part = F.shiftright("_at", 33)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    starts = spark.createDataFrame(offsets, "_part bigint, _before bigint")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    known = written(placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select("source", "source_size", "n_docs", weight.alias("weight")), "mix-weights")
    cap = F.lit(float(MOST_COPIES)) * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        got = known.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open"),
                        F.count(F.when(full, 1)).alias("capped")).first()
        if not got.total or got.capped == capped or not got.open:
            break
        level, capped = (got.total - (got.held or 0.0)) / got.open, got.capped
    return known.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")).cast("double"))


def _fold(group: Column, level: int) -> Column:
    """Fold an array of documents with open probabilities: ``done`` has the settled ones, ``open`` the one that is left."""
    def step(state: Column, other: Column) -> Column:
        one = state["open"]
        draw = _draw(F.lit(level), one["key"], other["key"], one["order"], other["order"])
        up = F.least((1 - one["p"]) * one["words"], other["p"] * other["words"])  # words that can move to the first ...
        down = F.least(one["p"] * one["words"], (1 - other["p"]) * other["words"])  # ... and from it
        moved = F.when(draw * (up + down) < down, up).otherwise(-down)
        p, q = one["p"] + moved / one["words"], other["p"] - moved / other["words"]
        first = F.least(p, 1 - p) <= F.least(q, 1 - q)  # the nearer to 0 or 1 is settled; the other may still be open
        settled = F.when(first, one.withField("p", F.round(p))).otherwise(other.withField("p", F.round(q)))
        left = F.when(first, other.withField("p", _share(q))).otherwise(one.withField("p", _share(p)))
        return F.struct(F.concat(state["done"], F.array(settled)).alias("done"), left.alias("open"))

    start = F.struct(F.slice(group, 1, 0).alias("done"), F.element_at(group, 1).alias("open"))
    return F.aggregate(F.slice(group, F.lit(2), F.size(group)), start, step)


def _share(p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def _draw(*of: Column) -> Column:
    """An even number of [0, 1) that depends on ``of`` alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *of), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _earlier(a: Column, b: Column) -> Column:
    mine, other = F.struct(a["order"], a["key"], a["words"]), F.struct(b["order"], b["key"], b["words"])
    return F.when(mine < other, -1).when(mine > other, 1).otherwise(0)


def mixed(docs: DataFrame, size: str = "size") -> DataFrame:
    """Rows (row, source_size, target, copies): ``row`` is a row of ``docs`` (doc_id, source, the words of ``size``, ...).

    ``docs`` is read twice; give it a table, or something as cheap to read.
    """
    known = written(docs.groupBy("source").agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("source_size"), F.count("*").alias("n_docs")), "mix-sizes")
    largest, sources = known.agg(F.max("n_docs"), F.count("*")).first()
    some = ranked_targets(known).select(F.col("source").alias("_source"), "source_size", "n_docs", "target")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("_mine"),
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("key"), F.col(size).cast("double").alias("words"))
    rows = _joined(rows.withColumn("order", F.xxhash64(F.lit(SEED), "key", "words")), some, "_mine", sources)
    leaves = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / FAN)).cast("bigint")
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64(F.lit(SEED + 1), "key", "words"), leaves))
    large = F.col("words") * FAN > F.least("source_size", "target")
    rates = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    first, widest = _rated(rows, rates), max(1, -(-int(largest or 0) // FAN))
    done, last = _settled(first.filter(large), "large", widest)

    held = first.groupBy("_source", "target").agg(
        F.sum(F.when(large, F.col("words") * F.col("whole")).otherwise(0.0)).alias("held"), F.sum(F.when(large, 0.0).otherwise(F.col("words"))).alias("small"))
    drawn = done.groupBy("_source").agg(F.sum(F.col("item.words") * F.col("item.p")).alias("drawn"))
    held = _beside(_beside(held, drawn), last)
    rest, words = F.col("target") - F.col("held") - F.coalesce("drawn", F.lit(0.0)), F.coalesce("item.words", F.lit(0.0))
    without, taken = _out_of_reach(rest), _out_of_reach(rest - words)
    even = (_draw(F.lit(-2), F.col("item.key"), F.col("item.order")) < F.col("item.p")).cast("double")
    held = held.withColumn("more", F.when(without < taken, 0.0).when(taken < without, 1.0).otherwise(even))
    rate = F.greatest(F.lit(0.0), F.least(F.lit(float(MOST_COPIES)), (rest - words * F.coalesce("more", F.lit(0.0))) / F.col("small")))
    held = written(held.select("_source", "item", "more", F.when(F.col("small") > 0, rate).otherwise(0.0).alias("rate")), "mix-rest")

    others = _rated(_joined(rows.filter(~large), held.select("_source", "rate"), "_source", sources), F.col("rate"))
    more, end = _settled(others, "small", widest)
    final = F.when(_draw(F.lit(-1), F.col("item.key"), F.col("item.order")) < F.col("item.p"), 1.0).otherwise(0.0)
    every = done.select("item").unionByName(held.filter("item is not null").select(F.col("item").withField("p", F.col("more")).alias("item")))
    every = every.unionByName(more.select("item")).unionByName(end.select(F.col("item").withField("p", final).alias("item")))
    return every.select("item.row", "item.source_size", "item.target", (F.col("item.whole") + F.col("item.p")).cast("int").alias("copies"))


def _joined(rows: DataFrame, some: DataFrame, by: str, sources: int) -> DataFrame:
    """``rows`` with what ``some`` holds for their source (null is one): a broadcast where sources are few, else salted."""
    some = some.withColumnRenamed("_source", "_of")
    same = F.col(by).eqNullSafe(F.col("_of"))
    if sources <= SMALL_SOURCES:
        rows = rows.join(F.broadcast(some), same)
    else:
        some = some.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod("order", F.lit(SALTS)).cast("int")).join(some, same & (F.col("_salt") == F.col("_part"))).drop("_salt", "_part")
    return rows.drop(by).withColumnRenamed("_of", "_source")


def _beside(sums: DataFrame, more: DataFrame) -> DataFrame:
    more = more.withColumnRenamed("_source", "_of")
    return sums.join(more, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")


def _out_of_reach(rest: Column) -> Column:
    """Words of ``rest`` that a source's small documents can't be taken for, or are too many by."""
    off = F.greatest(-rest, rest - MOST_COPIES * F.col("small"), F.lit(0.0))
    return F.when(off > 1e-6, off).otherwise(0.0)


def _rated(rows: DataFrame, rate: Column) -> DataFrame:
    """Whole copies, and the probability ``p`` of one more."""
    near = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    rows = rows.withColumn("whole", F.floor(near).cast("int"))
    return rows.withColumn("p", F.when(F.col("words") > 0, near - F.col("whole")).otherwise(F.lit(0.0)))


def _settled(rows: DataFrame, label: str, widest: int) -> tuple[DataFrame, DataFrame]:
    """Fold rows along the tree: (_source, item) of all that are settled, and of each source's one that is still open."""
    item = F.struct("order", "key", "words", "p", "whole", "source_size", "target", "row").alias("item")
    settled = rows.filter("p = 0").select("_source", item)
    groups, level = rows.filter("p > 0").select("_source", "leaf", item), 0
    while True:
        group = F.array_sort(F.collect_list("item"), _earlier)
        folded = groups.groupBy("_source", "leaf").agg(group.alias("group")).select("_source", "leaf", _fold(F.col("group"), level).alias("to"))
        folded = written(folded, f"mix-{label}{level}")
        settled = settled.unionByName(folded.select("_source", F.explode("to.done").alias("item")))
        groups = folded.select("_source", F.floor(F.col("leaf") / FAN).alias("leaf"), F.col("to.open").alias("item"))
        if widest == 1:
            return settled, groups.select("_source", "item")
        level, widest = level + 1, -(-widest // FAN)


def sized(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, source and the number of words of its text."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, source_size, target and the words taken, repeats counted."""
    every = mixed(written(sized(docs), "mix-sized"))
    return every.select("row.doc_id", "row.size", "source_size", "target", (F.col("copies") * F.col("row.size")).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    extra = "size"
    while extra in docs.columns:
        extra += "_"
    every = mixed(docs.withColumn(extra, size), extra)
    taken = every.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
