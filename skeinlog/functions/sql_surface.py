"""The row functions under SQL names, for users who write SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from skeinlog.functions.text import SPACE_CLASS

_TRIMMED = f"regexp_replace(q, r'^{SPACE_CLASS}+|{SPACE_CLASS}+$', '')"
_LITERAL = rf"regexp_replace({_TRIMMED}, r'([.*+?^${{}}()|\[\]\\])', r'\\$1')"
_ANY_SPACE = SPACE_CLASS.replace("\\", "\\\\")  # as a replacement text
_PHRASE = rf"concat(CASE WHEN q RLIKE r'^[\x00-\x7F]*$' THEN '(?i)' ELSE '(?iu)' END, regexp_replace({_LITERAL}, r'{SPACE_CLASS}+', r'{_ANY_SPACE}+'))"
_COLLAPSED = f"trim(regexp_replace(body, r'{SPACE_CLASS}+', ' '))"

# name -> (parameters, result type, body). Bodies are native expressions, so a call costs what the expression costs; they
# say the same as ``text.phrase_pattern``, ``text.phrase_count`` and ``text.truncate``.
SQL_FUNCTIONS = {
    "transcript_phrase": ("q STRING", "STRING", _PHRASE),
    "transcript_match_count": ("body STRING, q STRING", "INT", f"regexp_count(body, {_PHRASE})"),
    "transcript_preview": ("body STRING, size INT", "STRING", f"CASE WHEN length({_COLLAPSED}) <= size THEN {_COLLAPSED} ELSE concat(left({_COLLAPSED}, greatest(size - 3, 0)), '...') END"),
    "transcript_reuse_bps": ("input BIGINT, cached BIGINT", "BIGINT", "CASE WHEN input > 0 THEN CAST((CAST(cached AS DECIMAL(20,0)) * 10000 - (CAST(cached AS DECIMAL(20,0)) * 10000) % input) / input AS BIGINT) END"),
}


def register(spark: SparkSession) -> None:
    for name, (params, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    spark.udtf.register("transcript_packed_members", _packed_members())


def _packed_members():
    @udtf(returnType="pos int, seq bigint, time bigint, text string")
    class PackedMembers:
        """Members of one packed storage row."""

        def eval(self, seq0: int, time0: int, gaps: list[int], texts: list[str]) -> Iterator[tuple]:
            at = time0
            for pos, text in enumerate(texts or []):
                at += gaps[pos - 1] if pos else 0
                yield pos, seq0 + pos, at, text
    return PackedMembers


def registered(spark: SparkSession) -> list[str]:
    return [r.function for r in spark.sql("SHOW USER FUNCTIONS LIKE 'transcript*'").collect()]


