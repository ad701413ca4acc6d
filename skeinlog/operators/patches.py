"""Patch texts as tables of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Lines of a diff that describe the file, not its content.
METADATA = r"^(diff --git |index [0-9a-f]|new file mode |deleted file mode |old mode |new mode |similarity index |rename from |rename to |\\ No newline)"


def patch_lines(patches: DataFrame) -> DataFrame:
    """Lines of every patch with file, hunk and line numbers. ``patches``: event_id, patch.

    Numbers run from the last hunk header with a range, else from 1 at the head of the file. All windows stay
    inside one patch text, which is one value of the input.
    """
    lines = patches.select("event_id", F.posexplode(F.split(F.trim("patch"), "\r?\n")).alias("pos", "text")).filter(~F.col("text").rlike(METADATA))
    name = F.regexp_extract("text", r"^\*\*\* (?:Add|Update|Delete) File: (.+)$", 1)
    lines = lines.withColumn("_file", F.when(name != "", F.struct(F.col("pos").alias("at"), name.alias("name"))))
    text = Window.partitionBy("event_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = lines.withColumn("_f", F.last("_file", True).over(text)).filter("_f is not null and _file is null and not startswith(text, '*** ')")
    old = F.regexp_extract("text", r"@@\s+-(\d+)(?:,\d+)?\s+\+(\d+)(?:,\d+)?\s+@@", 1).try_cast("bigint")
    new = F.regexp_extract("text", r"@@\s+-(\d+)(?:,\d+)?\s+\+(\d+)(?:,\d+)?\s+@@", 2).try_cast("bigint")
    header = F.startswith("text", F.lit("@@"))
    kind = F.when(header, "header").when(F.startswith("text", F.lit("+")), "added").when(F.startswith("text", F.lit("-")), "removed").otherwise("context")
    rows = inside.withColumns({"kind": kind, "_old": F.when(header, old), "_new": F.when(header, new)})
    file = Window.partitionBy("event_id", "_f.at").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seg = rows.withColumns({"_seg": F.sum(F.when(F.col("_old").isNotNull(), 1).otherwise(0)).over(file), "hunk": F.sum(F.when(F.col("kind") == "header", 1).otherwise(0)).over(file),
                            "_o0": F.coalesce(F.last("_old", True).over(file), F.lit(1)), "_n0": F.coalesce(F.last("_new", True).over(file), F.lit(1))})
    run = Window.partitionBy("event_id", "_f.at", "_seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    on_old, on_new = F.col("kind").isin("removed", "context"), F.col("kind").isin("added", "context")
    numbered = seg.withColumns({"_oc": F.sum(F.when(on_old, 1).otherwise(0)).over(run), "_nc": F.sum(F.when(on_new, 1).otherwise(0)).over(run)})
    content = F.when(F.col("text").rlike("^[+\\- ]"), F.expr("substring(text, 2)")).otherwise(F.col("text"))
    return numbered.filter("kind <> 'header'").select(
        "event_id", F.col("_f.name").alias("file"), "hunk", "pos", "kind", F.when(on_old, F.col("_o0") + F.col("_oc") - 1).alias("old_line"),
        F.when(on_new, F.col("_n0") + F.col("_nc") - 1).alias("new_line"), content.alias("content"))


def stats(lines: DataFrame) -> DataFrame:
    return lines.groupBy("event_id", "file").agg(F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"))
