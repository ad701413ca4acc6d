"""Source divergence audit: how far the word use of each source lies from the other sources of its language.

Equal texts of a language collapse first: each is one text with the number of its rows in every source, is cut into terms
once, and counts as often as it occurs. Tasks add up counts and document frequencies of their texts and pass partial sums
on when they hold ``HELD`` of them. Terms in ``LEAST`` or more documents of a language are kept; only terms that a source
has are stored. With z the scaled share of a term that a source lacks, the divergence of sources s and t over V terms is

    V f(z_s, z_t) + sum over terms of s of [f(p_s, z_t) - f(z_s, z_t)] + sum over terms of t of [f(z_s, p_t) - f(z_s, z_t)]
                  + sum over common terms of [f(p_s, p_t) - f(p_s, z_t) - f(z_s, p_t) + f(z_s, z_t)]

so that no pair looks at a term that neither has. The single sums run over how many terms have each count, the last one
over the sources of each term. What grows with the square of the sources of a language is the result itself.

All arithmetic is on whole numbers: shares are divided as 38-digit decimals, and a share is at most SCALE + 1, so a squared
difference fits 64 bits; sums of a pair are decimals. Overflow is an error, never a wrong number.

Defined cases: null text, language and source are empty strings. A text without terms adds nothing but its group. A group
without kept terms has a row for each other source of its language, by the same rules; a language without kept terms has
zeros. Repeated rows count as often as they occur. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.llm.shared import sliced, written

#: Least documents of a kept term, what is added to each count, the whole that shares are parts of, ranks of terms.
LEAST, ADDED, SCALE, RANKS = 3, 1, 1_000_000_000, 200
#: Partial sums that a task holds before it passes them on.
HELD = 1 << 19

#: Bytes of a text with capitals lowered and everything that is no letter of a term as a blank.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


def collapsed(docs: DataFrame) -> DataFrame:
    """One row for each distinct text of a language: lang, text, held (its rows by source)."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    held = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    held = held.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("held"))
    return rows.groupBy("lang", "digest").agg(F.first("text").alias("text")).join(held, ["lang", "digest"]).select("lang", "text", "held")


def counted(texts: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: how often a source has a term, and in how many of its documents."""
    def run(batches):
        counts: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}
        size = 0

        def out():
            for (lang, source, times), some in counts.items():
                seen = docs[lang, source, times]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(list(some), pa.binary()).cast(pa.string()),
                    pa.array([c * times for c in some.values()], pa.int64()), pa.array([seen[t] * times for t in some], pa.int64())],
                    ["lang", "source", "term", "count", "docs"])

        for batch in sliced(batches):
            for lang, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = terms(text)
                if not found:
                    continue
                distinct = set(found)
                for group in held:
                    key = lang, group["source"], group["n"]
                    some = counts.setdefault(key, Counter())
                    size -= len(some)
                    some.update(found)
                    size += len(some)
                    docs.setdefault(key, Counter()).update(distinct)
                if size > HELD:
                    yield from out()
                    counts, docs, size = {}, {}, 0
        yield from out()

    rows = texts.mapInArrow(run, "lang string, source string, term string, count bigint, docs bigint")
    # one exchange by term serves this sum and the next one; the tasks have added up what they could
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, whole: str) -> str:
    """1 + floor(SCALE (count + ADDED) / whole), as an SQL expression."""
    return f"(1 + (cast({SCALE} as decimal(10,0)) * cast({count} + {ADDED} as decimal(20,0))) div cast({whole} as decimal(20,0)))"


def apart(p: str, q: str) -> str:
    """floor((p - q)^2 / q), as an SQL expression."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def kept(counts: DataFrame) -> DataFrame:
    """lang, term, held (count by source), total: the terms in enough documents of their language."""
    some = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("held"))
    return some.filter(F.col("docs") >= LEAST).select("lang", "term", "held", "total")


def group_facts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """For every occurring (lang, source): kept terms of the language, both wholes, the share of a term it lacks."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = vocabulary.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.count").alias("own"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("words"))
    facts = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["own", "terms", "words"])
    facts = facts.select("lang", "source", "terms", F.expr("own + terms").alias("whole"), F.expr("words + terms").alias("lang_whole"))
    return facts.withColumn("lacking", F.when(F.col("terms") > 0, F.expr(share("0", "whole"))))


def pair_values(vocabulary: DataFrame, facts: DataFrame) -> DataFrame:
    """lang, source, item (another source), value."""
    a = facts.select("lang", "source", "terms", F.col("whole").alias("a_whole"), F.col("lacking").alias("za"))
    b = facts.select("lang", F.col("source").alias("other"), F.col("whole").alias("b_whole"), F.col("lacking").alias("zb"))
    pairs = a.join(b, "lang").filter("source <> other")
    total = lambda n, value: F.sum(F.expr(f"cast({n} as decimal(19,0)) * cast({value} as decimal(19,0))"))
    none = apart("za", "zb")

    def both(rows: DataFrame, n: str, there: str, back: str) -> DataFrame:
        sums = rows.groupBy("lang", "source", "other").agg(total(n, there).alias("there"), total(n, back).alias("back"))
        ways = F.array(F.struct("source", F.col("other").alias("item"), F.col("there").alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
        return sums.select("lang", F.explode(ways).alias("w")).select("lang", "w.source", "w.item", F.col("w.value").cast("decimal(38,0)").alias("value"))

    base = pairs.select("lang", "source", F.col("other").alias("item"), F.expr(f"cast(case when terms > 0 then cast(terms as decimal(19,0)) * cast({none} as decimal(19,0)) else 0 end as decimal(38,0))").alias("value"))
    alone = vocabulary.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source"), F.col("h.count").alias("n")).agg(F.count("*").alias("m"))
    alone = alone.join(pairs, ["lang", "source"]).withColumn("pa", F.expr(share("n", "a_whole")))
    alone = both(alone, "m", f"{apart('pa', 'zb')} - {none}", f"{apart('zb', 'pa')} - {apart('zb', 'za')}")
    met = vocabulary.select("lang", "held", F.explode("held").alias("x")).select("lang", "x", F.explode("held").alias("y")).filter("x.source < y.source")
    met = met.groupBy("lang", F.col("x.source").alias("source"), F.col("y.source").alias("other"), F.col("x.count").alias("n"), F.col("y.count").alias("k")).agg(F.count("*").alias("m"))
    met = met.join(a, ["lang", "source"]).join(b, ["lang", "other"]).withColumn("pa", F.expr(share("n", "a_whole"))).withColumn("pb", F.expr(share("k", "b_whole")))
    met = both(met, "m", f"{apart('pa', 'pb')} - {apart('pa', 'zb')} - {apart('za', 'pb')} + {none}",
               f"{apart('pb', 'pa')} - {apart('pb', 'za')} - {apart('zb', 'pa')} + {apart('zb', 'za')}")
    return base.unionByName(alone).unionByName(met).groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value"))


def term_values(vocabulary: DataFrame, facts: DataFrame) -> DataFrame:
    """lang, source, item (a term that the source has more of than its language), value."""
    rows = vocabulary.select("lang", "term", "total", F.explode("held").alias("h")).select("lang", "term", "total", "h.source", "h.count")
    rows = rows.join(facts, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), F.expr(share("count", "whole")).alias("p"), F.expr(share("total", "lang_whole")).alias("q"))
    return rows.filter("p > q").select("lang", "source", "item", F.expr(apart("p", "q")).alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank: divergence from each other source, and the terms that stand out."""
    vocabulary = written(kept(counted(collapsed(docs))), "divergence-terms")
    facts = written(group_facts(docs, vocabulary), "divergence-groups")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(vocabulary, facts).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best))
    high = term_values(vocabulary, facts).withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= RANKS)
    return pairs.unionByName(high).select("lang", "source", "part", "item", "value", "rank")


_SHARE = "1 + ({scale}::HUGEINT * ({n} + {added})) // {whole}"

#: The same audit, each pair over all kept terms.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), v AS (
  SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST}
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN v USING (lang, term) GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), whole AS (
  SELECT lang, source, sum(n)::HUGEINT + count(*) AS w FROM dense GROUP BY ALL
), p AS (
  SELECT lang, source, term, n, {_SHARE.format(scale=SCALE, n="n", added=ADDED, whole="w")} AS p FROM dense JOIN whole USING (lang, source)
), q AS (
  SELECT lang, term, {_SHARE.format(scale=SCALE, n="n", added=ADDED, whole="w")} AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN (SELECT lang, sum(n)::HUGEINT + count(DISTINCT term) AS w FROM c GROUP BY ALL) USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM ranked
) WHERE part = 'pair' OR rank <= {RANKS}
"""
