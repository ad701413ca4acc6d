"""Facts about the head or the tail of a sequence, for many cuts of it at once.

A sequence that is cut in a thousand places is read once, not a thousand times: the distinct cuts are sorted in among the
rows, running facts pass over both, and each cut keeps what it saw. Whoever asked for a cut reads its facts by an equi
join on (keys, cut). Rows and cuts go through ``ordered.scan``, so a very long sequence is spread over many tasks.

``rows`` have the keys and ``pos``, an integer that is unique within the keys; ``cuts`` have the keys and ``cut``. Cuts may
repeat, lie before the first row or behind the last one; null cuts and cuts of unknown sequences give no row.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.operators import ordered

EDGE = "_edge"


def _marks(cuts: DataFrame, keys: list[str]) -> DataFrame:
    return cuts.filter("cut is not null").select(*keys, F.col("cut").cast("bigint").alias("cut")).distinct()


def _seen(rows: DataFrame, cuts: DataFrame, keys: list[str], row_edge: Column, cut_edge: Column, specs: dict) -> DataFrame:
    marks = _marks(cuts, keys)
    values = {f"_v_{name}": spec.value for name, spec in specs.items()}
    asked = rows.join(marks.select(*keys).distinct(), keys, "left_semi")
    stream = asked.select(*keys, row_edge.alias(EDGE), *[v.alias(n) for n, v in values.items()], F.lit(None).cast("bigint").alias("cut"))
    known = marks.join(rows.select(*keys).distinct(), keys, "left_semi")
    stream = stream.unionByName(known.select(*keys, cut_edge.alias(EDGE), "cut"), allowMissingColumns=True)
    running = {name: replace(spec, value=F.col(f"_v_{name}")) for name, spec in specs.items()}
    return ordered.scan(stream, keys, EDGE, **running).filter("cut is not null").select(*keys, "cut", *specs)


def before(rows: DataFrame, cuts: DataFrame, keys: list[str], **specs) -> DataFrame:
    """For each distinct cut (keys, cut) the running facts over the rows with ``pos < cut``."""
    return _seen(rows, cuts, keys, 2 * F.col("pos") + 1, 2 * F.col("cut"), specs)


def since(rows: DataFrame, cuts: DataFrame, keys: list[str], **specs) -> DataFrame:
    """For each distinct cut (keys, cut) the running facts over the rows with ``pos >= cut``, read from the last one back.

    So ``LastValue`` is the value of the first row at or behind the cut.
    """
    return _seen(rows, cuts, keys, -2 * F.col("pos"), -2 * F.col("cut") + 1, specs)


def last_before(rows: DataFrame, cuts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The last ``most`` rows before each distinct cut: the columns of ``rows``, ``cut``, and ``place`` from 1 up.

    Rows are numbered once; a cut asks for the numbers it wants, ``most`` at the utmost, and both meet on (keys, number).
    """
    held = before(rows, cuts, keys, _held=ordered.RowNumber())
    first = F.greatest(F.lit(1).cast("bigint"), F.col("_held") - (most - 1))
    wanted = held.filter("_held > 0").select(*keys, "cut", first.alias("_first"), F.explode(F.sequence(first, F.col("_held"))).alias("_number"))
    numbered = ordered.scan(rows, keys, "pos", _number=ordered.RowNumber())
    return numbered.join(wanted, [*keys, "_number"]).withColumn("place", F.col("_number") - F.col("_first") + 1).drop("_number", "_first")
