"""Nested dispatches of scripted operations: one identity each, an outer script call at the root, a depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.session import materialize, spread_by

# The tool whose calls may be roots, and the deepest dispatch that is shown in its place.
SCRIPT_TOOL = "run_code"
DEEPEST = 256


def identities(rows: DataFrame) -> DataFrame:
    """One row per dispatch: session_id, node_id, root_id, parent_id, name, seq, reason.

    ``rows``: session_id, seq, part (start/end), node_id, root_id, parent_id, name, arguments (canonical JSON or null). The
    rows of a dispatch must agree in all facts, with at most one start and one end, the end not before the start; ``reason``
    says which rule is broken, '' if none. ``seq`` is that of the start, else of the end; of a broken dispatch the first
    row's. A row without one of its ids or its name is a dispatch of its own, with null ``node_id``.
    """
    c = F.col
    rows = materialize(rows, "dispatch-facts")  # read twice; its size tells how to place the rows
    placed = spread_by(rows.count(), rows.sparkSession, "session_id", "node_id")
    named = F.lit(True)
    for n in ("node_id", "root_id", "parent_id", "name"):
        named = named & (F.coalesce(c(n), F.lit("")) != "")
    facts = F.struct("root_id", "parent_id", "name", F.coalesce("arguments", F.lit("")).alias("arguments"))
    start, end = c("part") == "start", c("part") == "end"
    groups = placed(rows.filter(named)).groupBy("session_id", "node_id").agg(
        F.min(facts).alias("low"), F.max(facts).alias("high"), F.count_if(start).alias("starts"), F.count_if(end).alias("ends"),
        F.min(F.when(start, c("seq"))).alias("started"), F.min(F.when(end, c("seq"))).alias("ended"))
    reason = (F.when((c("low") != c("high")) | (c("starts") > 1) | (c("ends") > 1), F.concat(F.lit("ambiguous dispatch identity "), "node_id"))
              .when(c("ended") < c("started"), F.concat(F.lit("settlement precedes start for "), "node_id")).otherwise(""))
    seq = F.when(reason == "", F.coalesce("started", "ended")).otherwise(F.least("started", "ended"))
    whole = groups.select("session_id", "node_id", "low.root_id", "low.parent_id", "low.name", seq.alias("seq"), reason.alias("reason"))
    bare = rows.filter(~named).select("session_id", F.lit(None).cast("string").alias("node_id"), "root_id", "parent_id", "name", "seq",
                                      F.lit("missing durable dispatch identity").alias("reason"))
    return materialize(whole.unionByName(bare), "dispatch-identities")


def depths(nodes: DataFrame, calls: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """``nodes`` of ``identities`` with ``chain``, the dispatches from the root down to each, ``depth`` and the final ``reason``.

    ``calls``: session_id, call_id, name, seq; of calls that share an id the last counts. ``chain`` is null where the path
    upwards ends at a broken dispatch. A dispatch deeper than ``deepest``, or below a broken one, has no ``depth``; its chain
    stays as it is. Parents come earlier, so paths end. Pointers double and stop at roots and at broken dispatches: the
    rounds grow with the logarithm of the deepest chain.
    """
    c = F.col
    n, spark = nodes.count(), nodes.sparkSession
    met = lambda rows, other, *on: (rows.transform(spread_by(n, spark, *on)), other.transform(spread_by(n, spark, *on)))
    outer = calls.groupBy("session_id", F.col("call_id").alias("root_id")).agg(F.max_by("name", "seq").alias("_tool"))
    above = nodes.filter("reason = ''").select("session_id", c("node_id").alias("parent_id"), c("root_id").alias("_root"), c("seq").alias("_seq"))
    nested = F.coalesce((c("reason") == "") & (c("parent_id") != c("root_id")), F.lit(False))  # the others need no parent, which thousands may share
    low, high = met(nodes.filter(nested), above, "session_id", "parent_id")
    linked = low.join(high, ["session_id", "parent_id"], "left").unionByName(nodes.filter(~nested), allowMissingColumns=True)
    known = linked.join(outer.hint("shuffle_hash"), ["session_id", "root_id"], "left")
    earlier = F.coalesce((c("_seq") < c("seq")) & (c("_root") == c("root_id")), F.lit(False))
    reason = (F.when(c("reason") != "", c("reason"))
              .when(F.lower(F.coalesce("_tool", F.lit(""))) != SCRIPT_TOOL, F.concat(F.lit("root "), "root_id", F.lit(f" is not an outer {SCRIPT_TOOL} call")))
              .when(c("parent_id") == c("root_id"), "").when(c("parent_id") == c("node_id"), F.concat(F.lit("cyclic dispatch ancestry at "), "node_id"))
              .when(~earlier, F.concat(F.lit("parent "), "parent_id", F.lit(" is not an earlier dispatch in root "), "root_id")).otherwise(""))
    judged = materialize(known.withColumn("reason", reason).select(*nodes.columns), "dispatches")
    keys = ["session_id", "node_id"]
    inner = (c("reason") == "") & (c("parent_id") != c("root_id"))
    state = judged.filter("node_id is not null").select(*keys, F.when(inner, c("parent_id")).alias("up"), F.lit(1).cast("bigint").alias("chain"), (c("reason") != "").alias("void"))
    while not state.filter("up is not null").isEmpty():
        far = state.select("session_id", c("node_id").alias("up"), c("up").alias("_up"), c("chain").alias("_chain"), c("void").alias("_void"))
        low, high = met(state.filter("up is not null"), far, "session_id", "up")
        moved = low.join(high, ["session_id", "up"]).select(*keys, c("_up").alias("up"), (c("chain") + c("_chain")).alias("chain"), c("_void").alias("void"))
        state = materialize(state.filter("up is null").unionByName(moved), "dispatches")
    ends = state.select(*keys, F.when(~c("void"), c("chain")).alias("chain"))
    shown = F.when(c("chain") <= deepest, c("chain"))
    last = F.when((c("reason") == "") & shown.isNull(), F.concat(F.lit("dispatch ancestry exceeds the supported depth for "), "node_id")).otherwise(c("reason"))
    low, high = met(judged, ends, *keys)
    return low.join(high, keys, "left").select(*nodes.drop("reason").columns, "chain", shown.alias("depth"), last.alias("reason"))
