"""Token counts as delta-maintained rollups.

A store holds signed entries, one partition a batch: +1 and the count for each (document, tokenizer version) that a batch
adds, -1 and the old count for each that it takes back. An insert adds, a delete takes back, a revision does both. Totals
by source, language and tokenizer version are sums of signed entries, so a batch updates them by its own entries alone;
each batch keeps its partial totals beside its entries. A batch is derived from the batches before it and overwrites
exactly its own partition: run again after a failure, or by mistake, it commits the same entries, and totals count it
once. Batches are committed in the order of their numbers. Each batch also writes one row of sign 0 without a tokenizer,
which counts nothing: a batch that comes back without changes replaces what it had committed as well. Entries are written
before totals; a batch that fails between the two is run again.

What a change takes back is read from the store by a join on the changed documents, over earlier batches only.

Defined cases: null text counts 0 tokens; a null source or language is a group of its own; null ids are one document.
Several changes of one document and version in a batch: the one of the highest ``seq`` holds, then the largest count.
Deletes of unknown documents change nothing; an insert of a known document is a revision. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlog.llm.shared import WORD

#: Tokenizer versions of the corpus query: runs of anything but white space, and runs of letters, of digits, or one sign.
VERSIONS = {"words-1": WORD, "pieces-1": r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]"}
ENTRY = "batch bigint, doc_id bigint, source string, lang string, tokenizer string, sign int, n_tokens bigint"
KEYS = ["source", "lang", "tokenizer"]


def counted(docs: DataFrame, versions: dict[str, str | Column] = VERSIONS) -> DataFrame:
    """One row for each document and tokenizer version. A version is a pattern, or a column that holds its counts."""
    count = lambda v: F.coalesce(F.regexp_count("text", F.lit(v)) if isinstance(v, str) else v, F.lit(0)).cast("bigint")
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), count(v).alias("n_tokens")) for name, v in versions.items()])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", F.explode(each).alias("c")).select("doc_id", "source", "lang", "c.*")


class Rollup:
    """A store of signed entries and partial totals below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.entries_path, self.totals_path = spark, f"{path}/entries", f"{path}/totals"
        for at, ddl in ((self.entries_path, ENTRY), (self.totals_path, "batch bigint, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint")):
            spark.createDataFrame([], ddl).write.mode("append").partitionBy("batch").parquet(at)  # makes the folder, adds no row
        self.totals_schema = ddl

    def _read(self, path: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(path)

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Apply ``changes``: op ('insert', 'revise' or 'delete'), seq, doc_id, source, lang, tokenizer, n_tokens."""
        key = [F.col("doc_id"), F.col("tokenizer")]
        latest = Window.partitionBy(*key).orderBy(F.col("seq").desc_nulls_last(), F.col("n_tokens").desc_nulls_last(), "op")
        changes = changes.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n", "seq")
        before = self._read(self.entries_path, ENTRY).filter(F.col("batch") < batch)
        touched = changes.select(F.col("doc_id").alias("_doc"), F.col("tokenizer").alias("_tok"))
        before = before.join(touched, before.doc_id.eqNullSafe(touched["_doc"]) & (before.tokenizer == touched["_tok"]), "left_semi")
        held = before.groupBy("doc_id", *KEYS, "n_tokens").agg(F.sum("sign").cast("int").alias("held")).filter("held > 0")
        back = held.select("doc_id", *KEYS, (-F.col("held")).alias("sign"), "n_tokens")
        new = changes.filter("op <> 'delete'").select("doc_id", *KEYS, F.lit(1).alias("sign"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
        signed = new.unionByName(back).withColumn("batch", F.lit(batch).cast("bigint"))
        self._overwrite(signed.select("doc_id", *KEYS, "sign", "n_tokens", "batch"), self.entries_path, batch)
        own = self._read(self.entries_path, ENTRY).filter((F.col("batch") == batch) & (F.col("sign") != 0))
        part = own.groupBy("batch", *KEYS).agg(F.sum("sign").cast("bigint").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("bigint").alias("n_tokens"))
        self._overwrite(part.select(*KEYS, "n_docs", "n_tokens", "batch"), self.totals_path, batch)

    def _overwrite(self, rows: DataFrame, path: str, batch: int) -> None:
        """Replaces the batch's partition, also by no rows: partitions that get no row at all would stay as they are."""
        fixed = {"batch": F.lit(batch), **{n: F.lit(0) for n in ("sign", "n_docs", "n_tokens")}}
        mark = self.spark.range(1).select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
        rows.unionByName(mark).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    def totals(self) -> DataFrame:
        """Documents and tokens of every group that holds a document, from the batches' partial totals."""
        sums = self._read(self.totals_path, self.totals_schema).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs > 0")

    def recounted(self) -> DataFrame:
        """The same from all entries, as a check of the partial totals."""
        sums = self._read(self.entries_path, ENTRY).groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        return sums.filter("n_docs > 0")


#: What the corpus query's revision cuts off the end of a text.
CLOSING = r"[.!? \n]+\z"


def corpus_totals(docs: DataFrame, path: str) -> DataFrame:
    """Totals of a corpus after its usual life: loaded whole, revised, freed of exact copies.

    Batch 1 inserts every document; batch 2 revises those that end in ``CLOSING``, which goes, and those without a
    language, which become ``und``; batch 3 deletes every id that is the smallest of none of the texts; batch 2 then
    arrives once more, which must change nothing.
    """
    store, change = Rollup(docs.sparkSession, path), lambda op: [F.lit(op).alias("op"), F.lit(1).alias("seq")]
    store.commit(1, counted(docs).select(*change("insert"), "*"))
    shorter = F.regexp_replace("text", CLOSING, "")
    revised = docs.filter(F.col("lang").isNull() | (shorter != F.col("text"))).select("doc_id", "source", F.coalesce("lang", F.lit("und")).alias("lang"), shorter.alias("text"))
    revision = counted(revised).select(*change("revise"), "*")
    store.commit(2, revision)
    hashed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("hash")).filter("hash is not null and doc_id is not null")
    first = hashed.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    copies = hashed.join(first, "doc_id", "left_anti").select("doc_id", F.explode(F.array(*map(F.lit, VERSIONS))).alias("tokenizer"))
    absent = [F.lit(None).cast(kind).alias(name) for name, kind in (("source", "string"), ("lang", "string"), ("n_tokens", "bigint"))]
    store.commit(3, copies.select(*change("delete"), "doc_id", "tokenizer", *absent))
    store.commit(2, revision)
    return store.totals()


_ROW = "SELECT source, lang, '{name}' AS tokenizer, 1 AS n, len(regexp_extract_all(x, '{pattern}')) AS k FROM kept"
CORPUS_SQL = rf"""
WITH kept AS (
    SELECT source, coalesce(lang, 'und') AS lang, coalesce(regexp_replace(text, '{CLOSING}', ''), '') AS x FROM documents
    WHERE text IS NULL OR doc_id IN (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL GROUP BY text)),
counts AS ({" UNION ALL ".join(_ROW.format(name=n, pattern=v) for n, v in VERSIONS.items())})
SELECT source, lang, tokenizer, CAST(sum(n) AS BIGINT) AS n_docs, CAST(sum(k) AS BIGINT) AS n_tokens
FROM counts GROUP BY source, lang, tokenizer
"""
