"""Text column helpers: whitespace, truncation, tags, phrases, snippets, titles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the whitespace set of the source format's text rules (wider than ASCII).
SPACE_CLASS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

PREVIEW_LIMIT = 240
TITLE_LIMIT = 120
DERIVED_TITLE_LIMIT = 160
SNIPPET_BEFORE = 80
SNIPPET_AFTER = 180


def trim(value: Column) -> Column:
    return F.regexp_replace(value, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def collapse(value: Column) -> Column:
    """Every whitespace run becomes one blank, ends trimmed."""
    return F.trim(F.regexp_replace(value, f"{SPACE_CLASS}+", " "))


def truncate(value: Column, limit: int = PREVIEW_LIMIT) -> Column:
    text = collapse(F.coalesce(value, F.lit("")))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, max(0, limit - 3)), F.lit("...")))


def truncate_verbatim(value: Column, limit: int = 4000) -> Column:
    text = F.coalesce(value, F.lit(""))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, max(0, limit - 3)), F.lit("...")))


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.when(trim(v) != "", v) for v in values], F.lit(""))


def unique_non_empty(values: Column) -> Column:
    cleaned = F.transform(values, lambda v: trim(F.coalesce(v, F.lit(""))))
    return F.array_distinct(F.filter(cleaned, lambda v: v != ""))


def joined_unique(values: Column, separator: str, budget: int) -> Column:
    """Distinct non-empty parts joined and cut at the budget; a cut never leaves a bare separator."""
    parts = unique_non_empty(values)

    def add(acc: Column, part: Column) -> Column:
        room = F.lit(budget) - F.length(acc) - F.when(acc != "", len(separator)).otherwise(0)
        piece = F.when(acc != "", F.concat(acc, F.lit(separator), part.substr(F.lit(1), room))).otherwise(
            part.substr(F.lit(1), room))
        return F.when(room > 0, piece).otherwise(acc)

    return F.aggregate(parts, F.lit(""), add)


def xml_tag(value: Column, tag: str, keep_whitespace: bool = False) -> Column:
    body = F.regexp_extract(F.coalesce(value, F.lit("")), f"(?is)<{re.escape(tag)}>(.*?)</{re.escape(tag)}>", 1)
    return trim(body) if keep_whitespace else collapse(body)


def leading_tag_name(value: Column) -> Column:
    return F.regexp_extract(trim(value), r"^<([A-Za-z][\w:-]*)(?:\s|>)", 1)


def strict_tag(value: Column, tag: str) -> Column:
    """Body of a tag that occurs exactly once, else NULL."""
    opens = F.regexp_count(value, F.lit(f"<{re.escape(tag)}>"))
    body = F.regexp_extract(value, f"(?s)<{re.escape(tag)}>(.*?)</{re.escape(tag)}>", 1)
    closed = F.regexp_count(value, F.lit(f"</{re.escape(tag)}>"))
    return F.when((opens == 1) & (closed == 1), trim(body))


def humanize(subtype: Column) -> Column:
    text = collapse(F.regexp_replace(F.coalesce(subtype, F.lit("")), "[_-]+", " "))
    return F.when(text == "", "Protocol event").otherwise(capitalize_words(text))


def capitalize_words(text: Column) -> Column:
    """Upper-case the first letter of each word, leave the other letters alone."""
    words = F.split(text, " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(w.substr(1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


# --- literal phrase search -------------------------------------------------------------------

def _phrase_tokens(query: str | None) -> list[str]:
    return [t for t in re.split(r"[\s\ufeff]+", query or "") if t]


def phrase_pattern(query: str | None) -> str | None:
    """Regular expression of a literal phrase: any whitespace run matches any other, case ignored.

    ASCII letters match ASCII letters only, whatever else folds onto them.
    """
    tokens = _phrase_tokens(query)
    if not tokens:
        return None
    escaped = [re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", t) for t in tokens]
    return ("(?i)" if all(t.isascii() for t in tokens) else "(?iu)") + f"{SPACE_CLASS}+".join(escaped)


def matches_phrase(value: Column, query: str | None) -> Column:
    """The phrase occurs. A plain search for its longest word comes first: it is much cheaper than the
    expression and rules most texts out."""
    pattern = phrase_pattern(query)
    if pattern is None:
        return F.lit(True)
    body = F.coalesce(value, F.lit(""))
    word = max(_phrase_tokens(query), key=len)
    found = body.rlike(pattern)
    return F.contains(F.lower(body), F.lit(word.lower())) & found if word.isascii() else found


def phrase_count(value: Column, query: str | None) -> Column:
    pattern = phrase_pattern(query)
    if pattern is None:
        return F.lit(0).cast("bigint")
    return F.regexp_count(F.coalesce(value, F.lit("")), F.lit(pattern)).cast("bigint")


def snippet(value: Column, query: str | None) -> Column:
    pattern = phrase_pattern(query)
    if pattern is None:
        return F.lit("")
    text = F.coalesce(value, F.lit(""))
    at = F.regexp_instr(text, F.lit(pattern)) - 1
    size = F.length(text)
    start = F.greatest(F.lit(0), at - SNIPPET_BEFORE)
    end = F.least(size, at + SNIPPET_AFTER)
    body = collapse(text.substr(start + 1, end - start))
    return F.when(at < 0, "").otherwise(F.concat(
        F.when(start > 0, "...").otherwise(""), body, F.when(end < size, "...").otherwise("")))


def event_hit(preview: Column, search_text: Column, query: str | None) -> Column:
    if phrase_pattern(query) is None:
        return F.lit(False)
    return matches_phrase(preview, query) | matches_phrase(search_text, query)


def event_match_count(preview: Column, search_text: Column, query: str | None) -> Column:
    return F.greatest(phrase_count(preview, query), phrase_count(search_text, query))


def event_snippet(preview: Column, search_text: Column, query: str | None) -> Column:
    head = snippet(preview, query)
    return F.when(head != "", head).otherwise(snippet(search_text, query))


# --- session titles ---------------------------------------------------------------------------

_SPACES = SPACE_CLASS[1:-1]
# Markdown that is no part of a title (a line's leading quote, heading, bullet and number; links keep
# their text; tags part words, emphasis doesn't), the signs of which a line says nothing, and the wrapper of a plan.
LEADING_MARKS = rf"(?dm)^[{_SPACES}&&[^\n]]*(?:>[^\S\n]*)?(?:#{{1,6}}[^\S\n]*)?(?:[-*+][^\S\n]+)?(?:\d+[.)][^\S\n]+)?"
LINK, TAG, EMPHASIS = r"\[([^\]\n]+)\]\([^)\n]+\)", r"</?[^>\n]+>", r"[*_`~]+"
TELLING_LINE = rf"(?dm)^.*[^-=*_`|:.{_SPACES}].*$"
PLAN = r"(?s)^<proposed_plan>(.*)</proposed_plan>$"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
MOST_CONTROLS, CONTROL_SHARE = 2, 0.05


def title_candidate(text: Column, is_protocol: Column, limit: int = TITLE_LIMIT) -> Column:
    """First line of a user message that says something, without markdown; '' for protocol and broken text.

    The marks go from all lines at once, so that the line to take is one match.
    """
    body = trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"))
    controls = F.length(body) - F.length(F.regexp_replace(body, CONTROL, ""))
    broken = F.contains(body, F.lit("�")) | (controls > F.greatest(F.lit(MOST_CONTROLS), F.floor(F.length(body) * CONTROL_SHARE)))
    plain = F.regexp_replace(F.regexp_replace(body, PLAN, "$1"), LEADING_MARKS, "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, LINK, "$1"), TAG, " "), EMPHASIS, "")
    line = F.regexp_extract(plain, TELLING_LINE, 0)
    return F.when(is_protocol | broken, "").otherwise(truncate(line, limit))
