"""Growing transcript files taken in step by step, and a sink that keeps each session's newest generation.

A manifest names the files taken in so far, with size, time and digest. A step lists the folder, without content, and
anti-joins the manifest; files that are new or differ are read again whole, and exactly their rows are replaced. Both
tables have one partition a step, which a repeated step overwrites, and a step looks at earlier steps only: run again
after a failure, it leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlog.sources import files

LINES = "file string, line bigint, text string, step bigint"
MANIFEST = "file string, bytes bigint, mtime timestamp, lines bigint, file_digest string, step bigint"


def _overwrite(rows: DataFrame, path: str, part: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def listing(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """Files below ``root`` with size and time; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select(
        F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))


class GrowingFiles:
    """Lines of the files below ``root``, kept in two tables below ``store``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, store: str, pattern: str = "*.jsonl"):
        self.spark, self.root, self.pattern = spark, root, pattern
        self.lines_path, self.manifest_path = f"{store}/lines", f"{store}/manifest"
        for path, ddl in ((self.lines_path, LINES), (self.manifest_path, MANIFEST)):
            spark.createDataFrame([], ddl).write.mode("append").partitionBy("step").parquet(path)

    def manifest(self, before: int | None = None) -> DataFrame:
        """The newest row of each file."""
        rows = self.spark.read.schema(MANIFEST).parquet(self.manifest_path)
        rows = rows if before is None else rows.filter(F.col("step") < before)
        newest = Window.partitionBy("file").orderBy(F.desc("step"))
        return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")

    def changed(self, step: int, by_content: bool = False) -> DataFrame:
        """Files that the steps before this one don't know as they are. ``by_content`` compares digests of whole files
        too, which reads them all, and so notices a rewrite that kept size and time."""
        now = listing(self.spark, self.root, self.pattern)
        keys = ["file", "bytes", "mtime"]
        if by_content:
            digests = files.file_digests(files.committed(files.read_lines(self.spark, self.root, self.pattern)))
            now, keys = now.join(digests.select("file", "file_digest"), "file", "left").fillna("", ["file_digest"]), [*keys, "file_digest"]
        return files.changed_files(now, self.manifest(step), keys).select("file", "bytes", "mtime")

    def take_in(self, step: int, by_content: bool = False) -> list[str]:
        """Read the changed files and commit their finished lines as step ``step``; steps are taken in rising order.

        The names of the changed files pass the driver, as the names of all files do in any listing.
        """
        found = self.changed(step, by_content).collect()
        names = [r.file for r in found]
        if names:
            lines = files.committed(files.read_files(self.spark, names)).select("file", "line", "text", F.lit(step).cast("bigint").alias("step"))
        else:
            lines = self.spark.createDataFrame([], LINES)
        _overwrite(lines, self.lines_path, "step")
        own = self.spark.read.schema(LINES).parquet(self.lines_path).filter(F.col("step") == step)
        known = self.spark.createDataFrame(found, "file string, bytes bigint, mtime timestamp")
        rows = known.join(files.file_digests(own), "file", "left").select(
            "file", "bytes", "mtime", F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines"), F.coalesce("file_digest", F.lit("")).alias("file_digest"),
            F.lit(step).cast("bigint").alias("step"))
        _overwrite(rows, self.manifest_path, "step")
        return names

    def lines(self) -> DataFrame:
        """Lines of every file as it was when it was last taken in."""
        rows = self.spark.read.schema(LINES).parquet(self.lines_path)
        return rows.join(self.manifest().select("file", "step"), ["file", "step"], "left_semi").drop("step")


def session_sink(path: str):
    """``foreachBatch`` sink of rows that name their session's ``generation``: rows of one generation add up over the
    batches, and a higher one replaces those before. A repeated batch overwrites its own rows only."""
    def write(batch: DataFrame, epoch: int) -> None:
        _overwrite(batch.withColumn("epoch", F.lit(epoch).cast("bigint")), path, "epoch")
    return write


def current_sessions(spark: SparkSession, path: str, key: str = "session_id") -> DataFrame:
    """The rows of each session's highest generation."""
    rows = spark.read.parquet(path).drop("epoch")
    newest = rows.groupBy(key).agg(F.max("generation").alias("generation"))
    return rows.join(newest, [key, "generation"], "left_semi")
