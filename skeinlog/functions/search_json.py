"""Walks over nested JSON text that have no native column form. All run on Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys and block types whose content is never search text.
OPAQUE_KEYS = [
    "signature", "thought_signature", "thoughtSignature", "encrypted_content", "encryptedContent", "blob", "base64",
    "bytes", "image_url", "audio_url", "images",
]
OPAQUE_TYPES = [
    "image", "input_image", "output_image", "audio", "input_audio", "output_audio", "encrypted_content", "base64",
    "redacted_thinking", "encrypted_reasoning", "document", "video",
]
DATA_URL_MARKER = "[data URL omitted]"

# A payload may be wrapped over lines; a wrapped part is long enough not to be taken for a word.
DATA_URL_PATTERN = r"""(?i)data:[^,\s"'<>`]*;base64,(?:[A-Za-z0-9+/]|\s(?=[A-Za-z0-9+/=]{16}))+={0,2}"""
_DATA_URL = re.compile(DATA_URL_PATTERN)


def _leaves(value, out: list[str]) -> None:
    if isinstance(value, str):
        text = _DATA_URL.sub(DATA_URL_MARKER, value)
        if text:
            out.append(text)
    elif isinstance(value, bool):
        out.append("true" if value else "false")
    elif isinstance(value, (int, float)):
        out.append(repr(value) if not isinstance(value, float) or not value.is_integer() else str(int(value)))
    elif isinstance(value, list):
        for item in value:
            _leaves(item, out)
    elif isinstance(value, dict) and value.get("type") not in OPAQUE_TYPES:
        for key, item in value.items():
            if key not in OPAQUE_KEYS:
                _leaves(item, out)


def _pruned(value):
    """The value without opaque parts; texts redacted. Keys that collide after redaction get a number."""
    if isinstance(value, str):
        return _DATA_URL.sub(DATA_URL_MARKER, value)
    if isinstance(value, list):
        return [_pruned(v) for v in value]
    if isinstance(value, dict):
        if value.get("type") in OPAQUE_TYPES:
            return None
        out: dict = {}
        for key, item in value.items():
            if key in OPAQUE_KEYS:
                continue
            base = name = _DATA_URL.sub(DATA_URL_MARKER, key)
            n = 0
            while name in out:
                n += 1
                name = f"{base} ({n})"
            out[name] = _pruned(item)
        return out
    return value


def _without_nulls(value):
    if isinstance(value, dict):
        return {k: _without_nulls(v) for k, v in value.items() if v is not None}
    return [_without_nulls(v) for v in value] if isinstance(value, list) else value


def _mapped(convert: Callable[[object, str], str | None]):
    """Batch function applying ``convert(parsed value, source)``; text that is no JSON is handed over as a string."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(source):
            if source is None:
                return None
            try:
                return convert(json.loads(source), source)
            except ValueError:
                return convert(source, source)
        for batch in batches:
            yield batch.map(one)
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")


def _search_text(value, _source):
    out: list[str] = []
    _leaves(value, out)
    return "\n".join(out).strip()


def _projection(value, source):
    pruned = _pruned(value)
    return source if pruned == value else json.dumps(pruned, ensure_ascii=False, separators=(",", ":")) if isinstance(pruned, (dict, list)) else pruned


def _canonical(value, source):
    if not isinstance(value, dict):
        return source
    kept = {k: v for k, v in _without_nulls(value).items() if k != "timestamp"}
    return json.dumps(kept, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def full_search_text(record: Column) -> Column:
    """Text leaves of a JSON value, depth first, one per line."""
    return _mapped(_search_text)(record)


def search_projection(value: Column) -> Column:
    """JSON text as it is when nothing has to be hidden, else rebuilt. Only suspicious rows leave the JVM."""
    suspicious = value.rlike("|".join(f'"{k}"' for k in OPAQUE_KEYS) + "|" + "|".join(f'"{t}"' for t in OPAQUE_TYPES) + "|(?i)data:")
    return F.when(suspicious, _mapped(_projection)(F.when(suspicious, value))).otherwise(value)


def canonical_record(record: Column) -> Column:
    """Record with sorted keys, without nulls and without its own timestamp."""
    return _mapped(_canonical)(record)


def redact_data_urls(value: Column) -> Column:
    """Embedded base64 payloads replaced by a marker; payloads broken over lines included. Stays in the JVM."""
    return F.regexp_replace(value, DATA_URL_PATTERN, DATA_URL_MARKER)


def has_only_keys(record: Column, keys: list[str], optional: list[str] | None = None) -> Column:
    """The object has every key, and none besides the optional ones."""
    present = F.json_object_keys(record)
    wanted, allowed = F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(k) for k in [*keys, *(optional or [])]])
    return present.isNotNull() & (F.size(F.array_except(wanted, present)) == 0) & (F.size(F.array_except(present, allowed)) == 0)


def residual_keys(record: Column, known: list[str]) -> Column:
    return F.array_except(F.json_object_keys(record), F.array(*[F.lit(k) for k in known]))


# Usage fields in the order in which they are shown, before all others, and the names left out.
USAGE_ORDER = [
    "input_tokens", "cached_input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens",
    "reasoning_output_tokens", "total_tokens",
]
NO_USAGE = re.compile("limit|quota|rate", re.I)


def _usage_leaves(root: str, node: object) -> list[dict]:
    found, waiting = [], [((root,) if root else (), node)]
    while waiting:
        path, here = waiting.pop()
        for name, value in here.items() if isinstance(here, dict) else ():
            if NO_USAGE.search(name):
                continue
            if isinstance(value, dict):
                waiting.append(((*path, name), value))
            elif isinstance(value, (int, float)) and not isinstance(value, bool):
                found.append({"path": ".".join((*path, name)), "field": name, "value": float(value)})
    place = {name: i for i, name in enumerate(USAGE_ORDER)}
    return sorted(found, key=lambda leaf: (place.get(leaf["field"], len(place)), leaf["path"]))


def token_leaves(root: Column, node: Column) -> Column:
    """Array of (path, field, value) of the numbers in a JSON object, each path starting with ``root`` unless that is empty."""
    def run(roots: pd.Series, nodes: pd.Series) -> pd.Series:
        return pd.Series([_usage_leaves(r, json.loads(n)) if n else [] for r, n in zip(roots, nodes, strict=True)], dtype=object)
    run.__annotations__ = {"roots": pd.Series, "nodes": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<path:string,field:string,value:double>>")(root, node)


LOST = "�?"


def _reread(text: str) -> str | None:
    """The text's bytes in the wrong charset read as UTF-8, if that is what they were.

    Well-formed UTF-8 of three bytes a character is the evidence: text of another charset hardly ever has that form by
    chance. Where characters were lost before, as many may stay unreadable now.
    """
    lost = sum(text.count(c) for c in LOST)
    for some in (text, text.translate(dict.fromkeys(map(ord, LOST))) if lost else text):
        try:
            fixed = some.encode("gb18030").decode("utf-8", "replace")
        except UnicodeEncodeError:
            continue
        if fixed != text and fixed.count("�") <= lost and any(c >= "ࠀ" and c != "�" for c in fixed):
            return fixed
    return None


def _repair(text: str | None) -> str | None:
    """The whole text reread, or else each of its words that can be."""
    if not text or text.isascii():
        return text
    return _reread(text) or re.sub(r"[^\x00-\x7f]+(?:[?][^\x00-\x7f]*)*", lambda m: _reread(m[0]) or m[0], text)


def repair_mojibake(value: Column) -> Column:
    """Text decoded with the wrong charset, turned back where its bytes say so; ASCII rows stay in the JVM."""
    def run(values: pd.Series) -> pd.Series:
        return values.map(_repair)
    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    suspicious = value.rlike("[^\\x00-\\x7F]")
    return F.when(suspicious, F.pandas_udf(run, "string")(F.when(suspicious, value))).otherwise(value)
