"""Points against ranges without pairs: what covers a point is a running fact over range edges, never a join of the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.operators import ordered


def sole_owner(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, line, ...) with ``open``, how many ranges cover the line, and ``owner`` if there is one only.

    ``ranges``: keys, start, end, owner of any type. Of the ranges that have started, the one that ends last covers the
    line if any does; so where one is open, that one is it. Points ride along, so nothing is joined back.
    """
    carried = F.struct(*points.columns).alias("_point")
    none = F.lit(None)
    top = F.struct("end", "owner")
    sides = F.explode(F.array(
        F.struct(F.col("start").alias("line"), F.lit(1).cast("bigint").alias("n"), top.alias("top"), F.lit(0).alias("part")),
        F.struct(F.col("end").alias("line"), F.lit(-1).cast("bigint").alias("n"), none.cast(_kind(ranges, top)).alias("top"), F.lit(2).alias("part")))).alias("s")
    edges = ranges.select(*keys, sides).select(*keys, "s.line", "s.n", "s.top", "s.part", none.cast(_kind(points, carried)).alias("_point"))
    asked = points.select(*keys, "line", F.lit(0).cast("bigint").alias("n"), none.cast(_kind(ranges, top)).alias("top"), F.lit(1).alias("part"), carried)
    rows = edges.unionByName(asked).withColumn("_at", F.col("line") * 3 + F.col("part"))
    swept = ordered.scan(rows, keys, "_at", open=ordered.RunningSum(F.col("n")), last=ordered.RunningMax(F.col("top")))
    return swept.filter("part = 1").select("_point.*", "open", F.when(F.col("open") == 1, F.col("last.owner")).alias("owner"))


def sole_container(events: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """event_id, span_id of the events (keys, event_id, min_line, max_line) that lie inside exactly one span.

    Of the spans that start at or before an event, the one that ends last holds it if any does, and it is the only one if
    the end that comes second is before the event's. Both ends are running facts: the second one is the greatest of what
    each span is beaten by or beats, that is of the lesser of its end and the greatest end before it.
    """
    before = ordered.scan(spans.select(*keys, "start", "end", "span_id"), keys, "start", _ends=ordered.RunningMax(F.col("end"), inclusive=False))
    top = F.struct("end", "span_id")
    kind = _kind(spans, top)
    second = F.when(F.col("_ends").isNotNull(), F.least("end", "_ends"))
    none = F.lit(None)
    opened = before.select(*keys, (F.col("start") * 2).alias("_at"), top.alias("top"), second.alias("second"), none.cast(_kind(events, F.col("event_id"))).alias("event_id"), none.cast("bigint").alias("max_line"))
    asked = events.select(*keys, (F.col("min_line") * 2 + 1).alias("_at"), none.cast(kind).alias("top"), none.cast(_kind(spans, F.col("end"))).alias("second"), "event_id", F.col("max_line").cast("bigint").alias("max_line"))
    swept = ordered.scan(opened.unionByName(asked), keys, "_at", _first=ordered.RunningMax(F.col("top")), _second=ordered.RunningMax(F.col("second")))
    held = (F.col("_first.end") >= F.col("max_line")) & F.coalesce(F.col("_second") < F.col("max_line"), F.lit(True))
    return swept.filter(F.col("max_line").isNotNull() & held).select("event_id", F.col("_first.span_id").alias("span_id"))


def extremes(marks: DataFrame, asks: DataFrame, keys: list[str], widest: int) -> DataFrame:
    """For each ask the least and greatest value of the marks with ``low <= at <= high`` and ``by <= upto``: ask_id, least, greatest.

    ``marks``: keys, at, by, value; ``asks``: keys, ask_id, low, high, upto, with high - low at most ``widest``. Whole
    numbers are cut into cells of 1, 2, 4, ... A mark stands in one cell of each size; a range is the union of at most two
    cells of each size. In a cell the marks are read in the order of ``by``, and an ask takes the extremes so far. Marks and
    asks become rows by the logarithm of the widest range, however many of them lie close to each other.
    """
    levels = range(max(1, int(widest + 1).bit_length()))
    cell = lambda level, number: F.struct(F.lit(level).alias("level"), number.alias("cell"))

    def needed(level: int) -> list[Column]:
        left = -F.shiftright(-F.col("low"), level)
        right = F.shiftright(F.col("high") + 1, level)
        return [F.when((left < right) & (left % 2 != 0), cell(level, left)), F.when((left < right) & (right % 2 != 0), cell(level, right - 1))]

    last = levels[-1]
    ends = F.shiftright(F.col("high") + 1, last)
    whole = F.when(-F.shiftright(-F.col("low"), last) < ends, F.transform(F.sequence(-F.shiftright(-F.col("low"), last), ends - 1), lambda c: cell(last, c)))
    parts = F.array_compact(F.concat(F.array(*[c for level in levels[:-1] for c in needed(level)]), F.coalesce(whole, F.array().cast("array<struct<level:int,cell:bigint>>"))))
    value, ask = _kind(marks, F.col("value")), _kind(asks, F.col("ask_id"))
    marked = marks.select(*keys, F.explode(F.array(*[cell(level, F.shiftright(F.col("at"), level)) for level in levels])).alias("_c"), F.col("by").alias("_by"), F.lit(0).alias("_part"), "value", F.lit(None).cast(ask).alias("ask_id"))
    asked = asks.select(*keys, F.explode(parts).alias("_c"), F.col("upto").alias("_by"), F.lit(1).alias("_part"), F.lit(None).cast(value).alias("value"), "ask_id")
    so_far = Window.partitionBy(*keys, "_c").orderBy("_by", "_part").rowsBetween(Window.unboundedPreceding, 0)
    read = marked.unionByName(asked).withColumns({"_least": F.min("value").over(so_far), "_greatest": F.max("value").over(so_far)})
    return read.filter("_part = 1 and _least is not null").groupBy("ask_id").agg(F.min("_least").alias("least"), F.max("_greatest").alias("greatest"))


def extremes_near(marks: DataFrame, asks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """For each ask the least and greatest value of the marks with ``low <= at <= low + width``: ask_id, least, greatest.

    Numbers are cut into cells as wide as the range, so a range is the end of one cell and the beginning of the next: an ask
    is two rows, a mark is one, and each reads what its cell holds up to it, from the front or from the back.
    """
    cell = lambda at: F.floor(at / F.lit(width + 1))
    low, high = F.col("low"), F.col("low") + width
    sides = F.explode(F.array(F.struct(cell(low).alias("cell"), low.alias("at"), F.lit(True).alias("back")), F.struct(cell(high).alias("cell"), high.alias("at"), F.lit(False).alias("back")))).alias("s")
    asked = asks.select(*keys, "ask_id", sides).select(*keys, F.col("s.cell").alias("_cell"), F.col("s.at").alias("_at"), F.lit(1).alias("_part"), F.col("s.back").alias("_back"), F.lit(None).cast(_kind(marks, F.col("value"))).alias("value"), "ask_id")
    marked = marks.select(*keys, cell(F.col("at")).alias("_cell"), F.col("at").alias("_at"), F.lit(0).alias("_part"), F.lit(False).alias("_back"), "value", F.lit(None).cast(_kind(asks, F.col("ask_id"))).alias("ask_id"))
    own = Window.partitionBy(*keys, "_cell").rowsBetween(Window.unboundedPreceding, 0)
    front, back = own.orderBy("_at", "_part"), own.orderBy(F.col("_at").desc(), "_part")
    read = marked.unionByName(asked).withColumns({
        "_least": F.when(F.col("_back"), F.min("value").over(back)).otherwise(F.min("value").over(front)),
        "_greatest": F.when(F.col("_back"), F.max("value").over(back)).otherwise(F.max("value").over(front))})
    return read.filter("_part = 1 and _least is not null").groupBy("ask_id").agg(F.min("_least").alias("least"), F.max("_greatest").alias("greatest"))


def _kind(df: DataFrame, column: Column):
    return df.select(column.alias("c")).schema["c"].dataType
