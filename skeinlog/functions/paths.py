"""Path spelling: search keys, display form, identity keys, membership in a project."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def search_key(path: Column) -> Column:
    return F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))


def display_path(path: Column, root: str = "") -> Column:
    """Project-relative spelling with forward slashes."""
    slashed = F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    plain = F.regexp_replace(slashed, r"^\./", "")
    if not root:
        return plain
    base = root.replace("\\", "/").rstrip("/")
    return (F.when(slashed == base, "")
            .when(F.startswith(slashed, F.lit(base + "/")), slashed.substr(F.lit(len(base) + 2), F.length(slashed)))
            .otherwise(plain))


def identity_key(path: Column, root: str = "") -> Column:
    """Key of a recorded path: '.' and empty segments dropped, '..' kept, case kept unless the root is a Windows one."""
    windows = bool(re.match(r"^[A-Za-z]:[\\/]", root)) or root.startswith("\\\\")

    def spell(value: Column) -> Column:
        text = F.coalesce(value, F.lit(""))
        if windows:
            text = F.replace(text, F.lit("\\"), F.lit("/"))
        prefix = F.regexp_extract(text, r"^(//|/|[A-Za-z]:/)", 1)
        rest = text.substr(F.length(prefix) + 1, F.length(text))
        parts = F.filter(F.split(rest, "/"), lambda s: (s != "") & (s != "."))
        joined = F.concat(prefix, F.array_join(parts, "/"))
        return F.lower(joined) if windows else joined

    key, base = spell(path), spell(F.lit(root))
    absolute = F.startswith(base, F.lit("/")) | base.rlike(r"^[A-Za-z]:/")
    edge = F.when(F.endswith(base, F.lit("/")), base).otherwise(F.concat(base, F.lit("/")))
    return (F.when(~absolute, key).when(key == base, "")
            .when(F.startswith(key, edge), key.substr(F.length(edge) + 1, F.length(key))).otherwise(key))


def inside_root(cwds: Column, root: str) -> Column:
    base = root.rstrip("/")
    return F.exists(cwds, lambda c: (c == base) | F.startswith(c, F.lit(base + "/")))
