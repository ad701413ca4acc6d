"""Session helpers: table access, shared scratch space, tunables read from the Spark conf."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BLOCK_ROWS_CONF = "spark.skeinlog.block.rows"
BLOCK_ROWS_DEFAULT = 262_144

#: Deals the rows of every table out over so many partitions; unset, as on a cluster, the splits of the files stay.
SCAN_PARTS_CONF = "spark.skeinlog.scan.partitions"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{root}/{name}.parquet")
    parts = spark.conf.get(SCAN_PARTS_CONF, None)
    return rows.repartition(int(parts)) if parts else rows


def block_rows(spark: SparkSession) -> int:
    """Most rows of one ordered group that a single task is asked to sort."""
    return int(spark.conf.get(BLOCK_ROWS_CONF, str(BLOCK_ROWS_DEFAULT)))


_LOCAL_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only in local mode, where one machine is all there is;
    on a cluster the absence is an error, since files on one machine's disk are missing on the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no shared folder; set it to one that all executors can reach")
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="skeinlog-"))
    return _LOCAL_SCRATCH[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a parquet table in the shared folder, so a lost executor costs a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def spread_by(n: int, spark: SparkSession, *keys: str) -> Callable[[DataFrame], DataFrame]:
    """Places rows by ``keys`` so that each of ``n`` of them shares a task with no more others than a block has, about.

    Rows that are sorted or joined behind it take their place as it is, so what a task sorts does not grow with the table.
    Where all fit in one block Spark places them as it likes.
    """
    size = block_rows(spark)
    parts = max(-(-n // size), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return lambda rows: rows.repartition(parts, *keys) if n > size else rows
