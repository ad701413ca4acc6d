"""Where the files of the block family lie: containers, main and derived transcripts, sidecars, manifests, journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import records as R

# The places of files below the root, as path patterns, and what lies there. The named groups of a pattern
# are, in order: container, session, then what ``PARTS`` says.
CONTAINER, SESSION, NAME = "([^/]+)", "([^/]+)", "([^/]+)"
PLACES = [
    ("transcript", rf"^{CONTAINER}/{SESSION}\.jsonl$", []),
    ("subagent", rf"^{CONTAINER}/{SESSION}/subagents/agent-{NAME}\.jsonl$", ["agent_id"]),
    ("marker", rf"^{CONTAINER}/{SESSION}/subagents/agent-{NAME}\.forked-skill\.marker\.json$", ["agent_id"]),
    ("skill", rf"^{CONTAINER}/{SESSION}/subagents/agent-{NAME}\.forked-skill\.json$", ["agent_id"]),
    ("metadata", rf"^{CONTAINER}/{SESSION}/subagents/agent-{NAME}\.meta\.json$", ["agent_id"]),
    ("journal", rf"^{CONTAINER}/{SESSION}/subagents/workflows/{NAME}/journal\.jsonl$", ["run_id"]),
    ("child", rf"^{CONTAINER}/{SESSION}/subagents/workflows/{NAME}/agent-{NAME}\.jsonl$", ["run_id", "agent_id"]),
    ("child_metadata", rf"^{CONTAINER}/{SESSION}/subagents/workflows/{NAME}/agent-{NAME}\.meta\.json$", ["run_id", "agent_id"]),
    ("manifest", rf"^{CONTAINER}/{SESSION}/workflows/{NAME}\.json$", ["run_id"]),
]


def placed(files: DataFrame, root: str) -> DataFrame:
    """``files`` (file, ...) with container, session, role, agent_id and run_id; role is null where nothing is to be read.

    A path that leaves ``root``, or goes up inside it, has no place.
    """
    path = F.regexp_replace("file", r"\\", "/")
    prefix = root.rstrip("/") + "/"
    inner = F.when(F.startswith(path, F.lit(prefix)) & ~path.rlike(r"(^|/)\.\.?(/|$)"), F.substring(path, len(prefix) + 1, 1 << 30))

    def group(pattern: str, at: int) -> Column:
        return F.regexp_extract(inner, pattern, at)

    def first(value) -> Column:
        return F.coalesce(*[F.when(inner.rlike(pattern), value(role, pattern, parts)) for role, pattern, parts in PLACES])
    part = lambda name: first(lambda _, pattern, parts: group(pattern, 3 + parts.index(name)) if name in parts else F.lit(None).cast("string"))
    return files.withColumns({
        "role": first(lambda role, *_: F.lit(role)), "container": first(lambda _, p, __: group(p, 1)), "session": first(lambda _, p, __: group(p, 2)),
        "agent_id": part("agent_id"), "run_id": part("run_id")})


def derived_transcripts(files: DataFrame) -> DataFrame:
    """Subagent transcripts of existing main transcripts, with the sidecars that lie beside them.

    ``files``: as ``placed`` gives it. A skill or marker file makes the transcript one of a forked skill.
    """
    key = ["container", "session", "agent_id"]
    mains = files.filter("role = 'transcript'").select("container", "session", F.col("file").alias("parent_file"))
    beside = files.filter("role in ('metadata', 'skill', 'marker')").groupBy(*key).agg(
        *[F.max(F.when(F.col("role") == r, F.col("file"))).alias(f"{r}_file") for r in ("metadata", "skill", "marker")])
    own = files.filter("role = 'subagent'").select(*key, "file").join(mains, ["container", "session"])
    kind = F.when(F.col("skill_file").isNotNull() | F.col("marker_file").isNotNull(), "forked_skill").otherwise("subagent")
    return own.join(beside, key, "left").withColumn("derived_kind", kind)


def journal_records(lines: DataFrame) -> DataFrame:
    """Records of workflow journals, numbered from 0 within each; a journal with any bad line gives none.

    ``lines``: file, line, text. Blank lines don't count. A record names its type, key and agent; one that has a result is
    of type ``result`` and lists the result's types, any other is of type ``started``.
    """
    v = F.try_parse_json("text")
    name = lambda path: F.when(R.kind_at(v, path) == "STRING", F.nullif(R.get(v, path), F.lit("")))
    result = F.try_variant_get(v, "$.result", "variant")
    types = F.try_variant_get(v, "$.result.types", "array<variant>")
    strings = F.try_variant_get(v, "$.result.types", "array<string>")
    counts = R.kind_at(v, "$.result.counts")
    listed = types.isNotNull() & F.forall(types, lambda t: F.schema_of_variant(t) == "STRING") & strings.isNotNull() & (
        counts.isNull() | (counts == "VOID") | F.startswith(counts, F.lit("OBJECT")))
    rows = lines.filter(F.trim("text") != "").select(
        "file", "line", name("$.type").alias("type"), name("$.key").alias("key"), name("$.agentId").alias("agent_id"), result.isNotNull().alias("_has"), listed.alias("_listed"))
    good = F.coalesce(F.col("key").isNotNull() & F.col("agent_id").isNotNull() & F.when(F.col("_has"), (F.col("type") == "result") & F.col("_listed")).otherwise(F.col("type") == "started"), F.lit(False))
    rows = rows.withColumn("_good", good)
    bad = rows.filter(~F.col("_good")).select("file").distinct()
    kept = rows.join(bad, "file", "left_anti")
    from skeinlog.operators import ordered
    numbered = ordered.scan(kept.select("file", "line", "type", "key", "agent_id"), ["file"], "line", sequence=ordered.RowNumber())
    return numbered.select("file", (F.col("sequence") - 1).alias("sequence"), F.col("type").alias("kind"), "key", "agent_id")
