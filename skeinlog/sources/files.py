"""Transcript files: discovery, line-numbered reading, torn tails, fingerprints, incremental listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = "file string, line bigint, text string"


def list_artifacts(spark: SparkSession, root: str, pattern: str = "*.jsonl*") -> DataFrame:
    """Files below a root with size and time; a plain file wins over a compressed one of the same name."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        .select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))
    )
    return prefer_plain(listed)


def prefer_plain(listed: DataFrame) -> DataFrame:
    logical = F.regexp_replace("file", r"\.zstd?$", "")
    packed = F.col("file") != logical
    pick = F.min_by(F.struct("file", "bytes", "mtime", packed.alias("compressed")), F.struct(packed, F.col("file")))
    return listed.groupBy(logical.alias("logical_path")).agg(pick.alias("p")).select("logical_path", "p.*")


def read_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """Lines of plain files with their 1-based physical number, by a splittable text scan.

    Records keep their order inside a split, so a line is numbered within its split and the line counts of
    the splits before it are added. Only one row per split is shuffled for that. ``torn`` marks the last line
    of a file that does not end in a newline: the bytes of the file then fall one short of its lines.
    """
    return _numbered(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(root))


def read_files(spark: SparkSession, names: list[str]) -> DataFrame:
    """The same for the named files."""
    return _numbered(spark.read.option("lineSep", "\n").text(names))


def _numbered(text: DataFrame) -> DataFrame:
    scan = (
        text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
                F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    )
    splits = scan.groupBy("file", "_start").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.max("_size").alias("_size"),
        F.sum(F.octet_length("text").cast("bigint") + 1).alias("_bytes"))
    by = Window.partitionBy("file").orderBy("_start")
    whole = Window.partitionBy("file")
    placed = splits.select(
        "file", "_start", "_first", F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.when(F.sum("_bytes").over(whole) > F.col("_size"), F.sum("_n").over(whole)).alias("_torn_line"))
    line = F.col("_id") - F.col("_first") + F.col("_before") + 1
    return scan.join(placed, ["file", "_start"]).select(
        "file", line.alias("line"), F.regexp_replace("text", "\r$", "").alias("text"), F.coalesce(line == F.col("_torn_line"), F.lit(False)).alias("torn"))


def read_transcripts(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """Lines of all transcripts below ``root``, each read once: a plain file, or its compressed one where there is none."""
    packed = list_artifacts(spark, root, pattern + "*").filter("compressed").select("file")
    unpacked = read_compressed(spark, root, pattern + ".zst*", packed).filter("error is null").drop("error")
    return read_lines(spark, root, pattern).unionByName(unpacked)


def read_compressed(spark: SparkSession, root: str, pattern: str = "*.jsonl.zst*", chosen: DataFrame | None = None) -> DataFrame:
    """Lines of Zstandard files, of the ``chosen`` ones if given, and their faults. Rows: file, line, text, torn, error.

    Only whole frames count: a frame that is cut short or broken, and all after it, gives no line but one row with an
    ``error``; the other files go on. A frame format cannot be split, so one task inflates one file, frame by frame.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")
    files = files if chosen is None else files.join(chosen.select(F.col("file").alias("path")), "path", "left_semi")
    schema = pa.schema([("file", pa.string()), ("line", pa.int64()), ("text", pa.string()), ("torn", pa.bool_()), ("error", pa.string())])

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def frames(data: bytes) -> Iterator[tuple[bytes, str]]:
            while data:
                one = zstandard.ZstdDecompressor().decompressobj()
                try:
                    text = one.decompress(data)
                except zstandard.ZstdError as broken:
                    yield b"", str(broken)
                    return
                if not one.eof:
                    yield b"", "incomplete frame"
                    return
                yield text, ""
                data = one.unused_data

        def rows(path: str, lines: list[bytes], first: int, torn: bool = False) -> pa.RecordBatch:
            texts = [x.rstrip(b"\r").decode("utf-8", "replace") for x in lines]
            return pa.RecordBatch.from_pylist([{"file": path, "line": first + i, "text": t, "torn": torn, "error": None} for i, t in enumerate(texts)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                path, rest, number = batch.column("path")[i].as_py(), b"", 1
                for data, fault in frames(batch.column("content")[i].as_py()):
                    if fault:
                        yield pa.RecordBatch.from_pylist([{"file": path, "line": number, "text": None, "torn": None, "error": fault}], schema=schema)
                    *whole, rest = (rest + data).split(b"\n")
                    yield rows(path, whole, number)
                    number += len(whole)
                if rest:
                    yield rows(path, [rest], number, torn=True)
    return files.mapInArrow(inflate, "file string, line bigint, text string, torn boolean, error string")


def read_compressed_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl.zst*") -> DataFrame:
    """Lines of the whole frames of Zstandard files."""
    return read_compressed(spark, root, pattern).filter("error is null").drop("error")


def compressed_errors(spark: SparkSession, root: str, pattern: str = "*.jsonl.zst*") -> DataFrame:
    """Files whose frames end early or don't decode, with the line that would have come next."""
    return read_compressed(spark, root, pattern).filter("error is not null").select("file", "line", F.lit("zstd_frame").alias("code"), F.col("error").alias("message"))


def committed(lines: DataFrame) -> DataFrame:
    """Lines the writer has finished: everything but a torn tail."""
    return lines.filter(~F.col("torn"))


def parsed(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their record; unreadable ones keep a NULL record."""
    return lines.filter(F.trim("text") != "").withColumn("record", F.try_parse_json("text"))


def read_errors(records: DataFrame) -> DataFrame:
    """Lines that are no record, with a reason, for a side table; they never stop the others."""
    bad = F.col("record").isNull() | ~F.startswith(F.schema_of_variant("record"), F.lit("OBJECT"))
    code = F.when(F.col("record").isNull(), "malformed_json").otherwise("not_an_object")
    return records.filter(bad).select("file", "line", code.alias("code"), F.col("text").alias("message"))


def line_digests(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line_digest", F.sha2("text", 256))


def file_digests(lines: DataFrame) -> DataFrame:
    """Fingerprint of a file from its line digests, each bound to its place and added up, so no file is put
    together in one task. Equal files agree; a changed, moved or missing line does not."""
    digest = F.sha2(F.concat(F.col("line").cast("string"), F.lit(":"), F.col("text")), 256)
    parts = [F.sum(F.conv(F.substring(digest, i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(1, 64, 8)]
    joined = F.concat_ws("-", *[F.col(f"p{i}").cast("string") for i in range(1, 64, 8)])
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), *parts).select("file", "lines", F.sha2(joined, 256).alias("file_digest"))


def changed_files(listing: DataFrame, manifest: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Files to read again: those without an equal manifest row."""
    return listing.join(manifest, keys or ["file", "bytes", "mtime", "file_digest"], "left_anti")


def prefix_changes(now: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose already accepted lines differ now. ``seen``: file, line, line_digest of the accepted prefix."""
    current = now.select("file", "line", F.col("line_digest").alias("_now"))
    met = seen.join(current, ["file", "line"], "left")
    return met.groupBy("file").agg(F.count_if(~F.col("line_digest").eqNullSafe(F.col("_now"))).alias("changed")).filter("changed > 0").select("file")


def with_cwd(lines: DataFrame) -> DataFrame:
    """Working folders named by each file; lines are screened as text before any is parsed."""
    screened = lines.filter(F.contains("text", F.lit('"cwd"')))
    record = F.try_parse_json("text")
    cwd = F.coalesce(F.try_variant_get(record, "$.cwd", "string"), F.try_variant_get(record, "$.payload.cwd", "string"))
    return screened.select("file", cwd.alias("cwd")).filter("cwd is not null").distinct()


def packed_members(records: DataFrame) -> DataFrame:
    """Members of packed storage rows: consecutive sequence numbers and running times.

    ``records``: file, line, record. Rows that break the packed shape are reported by ``packed_errors``.
    """
    good = records.filter(packed_valid(F.col("record")))
    body = good.select("file", "line", *_packed_columns(F.col("record")))
    members = F.posexplode("members").alias("pos", "text")
    gone = F.aggregate(F.slice("dt", 1, F.col("pos")), F.lit(0).cast("bigint"), lambda a, d: a + d)
    return body.select("file", "line", "channel", "seq0", "time0", "dt", members).select(
        "file", "line", "channel", (F.col("seq0") + F.col("pos")).alias("seq"), (F.col("time0") + F.when(F.col("pos") > 0, gone).otherwise(0)).alias("time"), "text")


def packed_errors(records: DataFrame) -> DataFrame:
    kind = F.try_variant_get("record", "$.type", "string")
    return records.filter(kind.isin(*PACKED) & ~F.coalesce(packed_valid(F.col("record")), F.lit(False))).select(
        "file", "line", F.lit("malformed_packed_row").alias("code"), F.col("text").alias("message"))


# Packed row types and the channel of their members.
PACKED = ["text-chunks", "reasoning-chunks", "tool-call-chunks"]


def _packed_columns(record: Column) -> list[Column]:
    kind = F.try_variant_get(record, "$.type", "string")
    texts = F.coalesce(F.try_variant_get(record, "$.data.texts", "array<string>"), F.try_variant_get(record, "$.data.args", "array<string>"))
    return [kind.alias("channel"), F.try_variant_get(record, "$.seq0", "bigint").alias("seq0"), F.try_variant_get(record, "$.time0", "bigint").alias("time0"),
            F.try_variant_get(record, "$.data.dt", "array<bigint>").alias("dt"), texts.alias("members")]


def packed_valid(record: Column) -> Column:
    kind, seq0, time0, dt, members = [c for c in _packed_columns(record)]
    return kind.isin(*PACKED) & (seq0 >= 0) & time0.isNotNull() & (F.size(members) > 0) & (F.size(dt) == F.size(members) - 1)
