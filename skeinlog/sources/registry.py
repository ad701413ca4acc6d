"""Source contract: what a transcript family supplies, and the registry of known families."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.operators import claims
from skeinlog.sources import claude, codex, deepseek, files

# Columns every family's raw rows share.
RAW_COLUMNS = ["session_id", "raw_id", "file", "line", "payload_type", "role", "ts_text", "preview"]


@dataclass(frozen=True)
class SourceSpec:
    """A family: where its files are, how parsed lines become raw rows, and optional hooks of the query layer."""

    kind: str
    pattern: str
    to_raw: Callable[[DataFrame], DataFrame]
    counter_family: str
    to_logical: Callable[[DataFrame], DataFrame] | None = None
    row_facts: Callable[[DataFrame], DataFrame] | None = None
    row_filter: Callable[[dict], Column] | None = None
    facets: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


_KNOWN: dict[str, SourceSpec] = {}


def register(spec: SourceSpec) -> SourceSpec:
    if not spec.kind or spec.kind in _KNOWN:
        raise ValueError(f"source kind {spec.kind!r} is empty or already registered")
    _KNOWN[spec.kind] = spec
    return spec


def get(kind: str) -> SourceSpec:
    if kind not in _KNOWN:
        raise KeyError(f"unknown source kind {kind!r}")
    return _KNOWN[kind]


def kinds() -> list[str]:
    return sorted(_KNOWN)


def all_raw(parsed_by_kind: dict[str, DataFrame]) -> DataFrame:
    """Raw rows of several families in their common columns."""
    parts = []
    for kind, parsed in parsed_by_kind.items():
        spec = get(kind)
        raw = spec.to_raw(parsed)
        raw = spec.row_facts(raw) if spec.row_facts else raw
        parts.append(raw.select(F.lit(kind).alias("source_kind"), *RAW_COLUMNS))
    return reduce(DataFrame.unionByName, parts)


def logical_events(kind: str, parsed: DataFrame) -> DataFrame:
    """Events of a family whose rows claim them: session_id, event_id, line, kind, units, layer."""
    spec = get(kind)
    if spec.to_logical is None:
        raise ValueError(f"source kind {kind!r} builds no events by claims")
    return claims.events(spec.to_logical(parsed))


def lines(spark: SparkSession, spec: SourceSpec, root: str) -> DataFrame:
    """Lines of all files of a family below ``root``."""
    return files.read_transcripts(spark, root, spec.pattern.removesuffix("*"))


def select_rows(spec: SourceSpec, rows: DataFrame, params: dict) -> DataFrame:
    """Rows with the family's own facts, filtered by what its hook makes of the query's parameters."""
    rows = spec.row_facts(rows) if spec.row_facts else rows
    return rows.filter(spec.row_filter(params)) if spec.row_filter else rows


def facet(spec: SourceSpec, name: str, rows: DataFrame) -> DataFrame:
    """One of the family's own facets; an unknown name is an error."""
    if name not in spec.facets:
        raise KeyError(f"source kind {spec.kind!r} has no facet {name!r}")
    return spec.facets[name](select_rows(spec, rows, {}))


def of_kind(rows: DataFrame, *kinds_: str) -> DataFrame:
    """Rows of known families only; naming an unknown family is an error, not an empty result."""
    for kind in kinds_:
        get(kind)
    return rows.filter(F.col("source_kind").isin(*kinds_))


register(SourceSpec("codex", "*.jsonl", codex.to_raw, "codex"))
register(SourceSpec("claude", "*.jsonl", claude.to_raw, "claude", claude.to_logical))
register(SourceSpec("deepseek", "session.jsonl*", deepseek.to_raw, "deepseek", deepseek.to_logical))
