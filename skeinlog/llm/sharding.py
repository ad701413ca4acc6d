"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``NODES`` places on a ring of 63-bit numbers, which only its number and theirs decide. A key (the hash of
doc_id) belongs to the first place at or after it; where that place's shard is full, the key goes on clockwise to the next
place whose shard is not. So no shard holds more than its bound, and a shard more or less moves the keys at its places
and what overflows differently, not the rest.

Rows too large to split a load finely (one of ``HEAVY`` parts of an even load or more, so at most shards x HEAVY rows) are
placed one by one, the largest first, each by the rule above with a bound of (1 + ``SLACK``) even loads; where no shard
has room, the one with most room takes it, the first of these clockwise. The others fill what is left up to one level,
SLACK above the lowest at which all fit, so a document larger than an even load takes no room from the rest. They come arc
after arc around the ring: an arc (the keys of one place) goes whole to its first shard with room, and is cut where
that shard is full. Each cut fills a shard, so there are fewer cuts than shards, and a cut is found by sums over the
input's parts and then over the rows of one part: only a cut arc's rows are ever put in order. A key that holds a third
of all rows is one arc, cut as often as its shards fill.

The driver sees the heavy rows and a sum for each arc, which shards, HEAVY and NODES bound. A shard's slots are numbered
by part, then row, so no shard is put in order whole.

Defined cases: null text has size 8 and the crc32 of the empty text. Null ids are one key. Rows of equal id, text and
size are interchangeable; which of them go where an arc is cut depends on their order in the input, which is fixed by the
files and the splits of them. Equal texts get equal crc32. An empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.llm.shared import written
from skeinlog.llm.words import mixed

SHARDS = 24
#: Places of each shard on the ring, what a shard may hold beyond an even load, and parts of a load that make a row heavy.
NODES, SLACK, HEAVY = 128, 0.001, 512
#: What a row costs beside its text.
ROW_BYTES = 8


class Ring:
    """Places in rising order, and the shard that owns each."""

    def __init__(self, shards: int, nodes: int = NODES):
        owner = np.repeat(np.arange(shards, dtype=np.uint64), nodes)
        place = np.tile(np.arange(nodes, dtype=np.uint64), shards)
        at = (mixed(mixed(owner + np.uint64(1)) + place) >> np.uint64(1)).astype(np.int64)
        order = np.lexsort((owner, at))
        self.shards, self.at, self.owner = shards, at[order], owner[order].astype(int).tolist()
        self.ahead: dict[int, list[int]] = {}

    def arc(self, keys: np.ndarray) -> np.ndarray:
        """Index of the first place at or after each key, the first one after the last."""
        return np.searchsorted(self.at, keys, "left") % len(self.at)

    def clockwise(self, arc: int) -> list[int]:
        """All shards in the order in which they are met from the place on."""
        if arc not in self.ahead:
            self.ahead[arc] = list(dict.fromkeys(self.owner[arc:] + self.owner[:arc]))
        return self.ahead[arc]


def place_heavy(ring: Ring, rows: list[tuple[int, int]], bound: float) -> tuple[list[int], list[int]]:
    """Shards of rows (arc, size), placed in the order given, and the load of each shard."""
    load, out = [0] * ring.shards, []
    for arc, size in rows:
        ahead = ring.clockwise(arc)
        to = next((s for s in ahead if load[s] + size <= bound), None)
        if to is None:
            to = max(ahead, key=lambda s: bound - load[s])
        load[to] += size
        out.append(to)
    return out, load


def level(load: list[int], more: float) -> float:
    """The height up to which the shards can be filled with ``more`` in all."""
    low = sorted(load)
    for k in range(1, len(low) + 1):
        height = (sum(low[:k]) + more) / k
        if k == len(low) or height <= low[k]:
            return height
    raise ValueError("a ring needs a shard")


def place_arcs(ring: Ring, sums: dict[int, int], load: list[int]) -> dict[int, list[tuple[int, int]]]:
    """For each arc its (start, shard), rising: from that byte of the arc on, in the order of its rows, the shard takes it."""
    total = sum(sums.values())
    top = level(load, total * (1 + SLACK))
    room = [max(0, int(np.ceil(top)) - x) for x in load]
    out: dict[int, list[tuple[int, int]]] = {}
    for arc in sorted(sums):
        left, at, cuts = sums[arc], 0, []
        for shard in ring.clockwise(arc):
            if room[shard] > 0 and left > 0:
                takes = min(left, room[shard])
                cuts.append((at, shard))
                room[shard] -= takes
                at, left = at + takes, left - takes
        out[arc] = cuts or [(0, ring.owner[arc])]
    return out


def _arc_of(key: Column, ring: Ring) -> Column:
    at = ring.at

    @F.pandas_udf("int")
    def arc(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, keys.to_numpy(), "left") % len(at)).astype("int32")

    return arc(key)


def narrowed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key, and the row's place in the input (part, row): written, so that it stays."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1).alias("key"),
                       F.monotonically_increasing_id().alias("rid"))
    return written(rows.withColumn("part", F.shiftright("rid", 33)), "sharding-rows")


def placed(rows: DataFrame, shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """``rows`` of ``narrowed`` with ``arc`` and ``shard``."""
    spark, ring = rows.sparkSession, Ring(shards, nodes)
    rows = rows.withColumn("arc", _arc_of(F.col("key"), ring))
    total = rows.agg(F.sum("size")).first()[0] or 0
    least = max(1, total // (shards * HEAVY))
    heavy = rows.filter(F.col("size") >= least).select("rid", "arc", "size", "key", "text_crc32").collect()
    heavy.sort(key=lambda r: (-r.size, r.key, r.text_crc32, r.rid))
    homes, load = place_heavy(ring, [(r.arc, r.size) for r in heavy], (1 + SLACK) * total / shards)
    light = rows.filter(F.col("size") < least)
    sums = {r.arc: r.bytes for r in light.groupBy("arc").agg(F.sum("size").alias("bytes")).collect()}
    plan = place_arcs(ring, sums, load)
    whole = [(arc, cuts[0][1]) for arc, cuts in plan.items() if len(cuts) == 1]
    cut = {arc: cuts for arc, cuts in plan.items() if len(cuts) > 1}
    told = spark.createDataFrame([(r.rid, s) for r, s in zip(heavy, homes, strict=True)], "rid bigint, shard int")
    out = [rows.filter(F.col("size") >= least).join(F.broadcast(told), "rid"),
           light.join(F.broadcast(spark.createDataFrame(whole, "arc int, shard int")), "arc")]
    if cut:
        out.append(_cut_arcs(light, cut))
    names = [*rows.columns, "shard"]
    both = out[0].select(names)
    for more in out[1:]:
        both = both.unionByName(more.select(names))
    return both


def _cut_arcs(light: DataFrame, cut: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """Rows of the cut arcs with the shard that takes the byte at which each row starts.

    Sums over (arc, part) say where a part's rows start; a part that lies between two cuts goes whole, and only rows of
    parts that a cut goes through are put in order, which are fewer than shards.
    """
    spark = light.sparkSession
    ours = light.join(F.broadcast(spark.createDataFrame([(a,) for a in cut], "arc int")), "arc")
    sums = ours.groupBy("arc", "part").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0))), "sharding-parts")
    ranges = [(arc, start, cuts[k + 1][0] if k + 1 < len(cuts) else 1 << 62, shard) for arc, cuts in cut.items() for k, (start, shard) in enumerate(cuts)]
    bounds = F.broadcast(spark.createDataFrame(ranges, "arc int, low bigint, high bigint, shard int"))
    within = sums.join(bounds, "arc").filter("start < high and start + bytes > low")
    shared = within.groupBy("arc", "part").agg(F.first("start").alias("start"), F.count("*").alias("n"), F.first("shard").alias("only"))
    rows = ours.join(shared, ["arc", "part"])
    order = Window.partitionBy("arc", "part").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    through = rows.filter("n > 1").withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    through = through.join(bounds, "arc").filter("at >= low and at < high")
    return rows.filter("n = 1").withColumn("shard", F.col("only")).select(*light.columns, "shard").unionByName(through.select(*light.columns, "shard"))


def slotted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard."""
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "part").orderBy("rid")
    return rows.withColumn("own", F.row_number().over(own) - 1).join(counts, ["shard", "part"]).withColumn("slot", F.col("start") + F.col("own")).drop("own", "start")


def sharded(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; the law is that of even sizes."""
    rows = slotted(written(placed(narrowed(docs), shards, nodes), "sharding-placed"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
