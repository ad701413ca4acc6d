"""Relations between sessions and records: chains, cycles, ancestry, copied prefixes, segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skeinlog.operators import ordered
from skeinlog.operators.prefixes import before, last_before, since
from skeinlog.session import materialize

#: Most rows of a session whose paths are listed within one task, and rows that a task takes at a time, about.
WALKED, WALKED_TOGETHER = 512, 16_384


def chains(edges: DataFrame) -> DataFrame:
    """Root, depth and cycle flag of every node of a parent forest, by pointer doubling.

    ``edges``: node, parent (NULL or unknown parent = root). After r rounds a pointer spans 2^r steps, so
    the rounds grow with the logarithm of the depth. A node whose pointer never ends is on, or leads to, a
    cycle; it is on one when it can be reached from itself.
    """
    known = edges.select(F.col("node").alias("parent"), F.lit(True).alias("_known"))
    state = (
        edges.join(known, "parent", "left")
        .select("node", F.when(F.col("_known"), F.col("parent")).alias("up"))
        .withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("bigint"))
        .withColumn("root", F.coalesce("up", "node"))
    )
    state = materialize(state, "chains")
    bound = state.count()
    span = 1
    while span <= 2 * bound:
        far = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("root").alias("_r"))
        live = state.filter("up is not null")
        if live.isEmpty():
            break
        moved = live.join(far, "up").select("node", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_r").alias("root"))
        state = materialize(state.filter("up is null").unionByName(moved), "chains")
        span *= 2
    return state.select("node", F.when(F.col("up").isNull(), F.col("root")).alias("root"),
                        F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), F.col("up").isNotNull().alias("endless"))


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes that can be reached from themselves.

    Among the nodes with an endless chain, those nobody else in the set points to hang off a cycle; they are
    peeled away by jumping: after enough doubling every pointer lands on a cycle, so the landing points,
    followed once more around, are exactly the members.
    """
    endless = chains(edges).filter("endless").select("node")
    live = materialize(edges.join(endless, "node", "left_semi").select("node", F.col("parent").alias("up")), "cycles")
    total = live.count()
    jump, span = live, 1
    while span < total:
        far = jump.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        jump = materialize(jump.join(far, "up").select("node", F.col("_up").alias("up")), "cycles")
        span *= 2
    # A pointer of at least ``total`` steps has entered a cycle; its landing points cover every member, since
    # a member of the same cycle lands on each position for some start on it.
    return jump.select(F.col("up").alias("node")).distinct()


def without_cycles(edges: DataFrame) -> DataFrame:
    """Edges with the relation of every cycle member cleared."""
    members = cycle_members(edges).withColumn("_c", F.lit(True))
    return edges.join(members, "node", "left").select("node", F.when(F.col("_c").isNull(), F.col("parent")).alias("parent"))


def nearest_ancestor_value(records: DataFrame) -> DataFrame:
    """Value of the nearest ancestor that has one, the row itself included.

    ``records``: session_id, uuid, parent_uuid, value. Pointer doubling: rows with a value are settled, the
    others take over the value or the pointer of the row they point to. A pointer that has gone further than its session
    has rows is on a cycle, or leads to one, and finds no value.
    """
    keys = ["session_id", "uuid"]
    first = records.groupBy(*keys).agg(F.max(F.struct("line", "parent_uuid", "value")).alias("r")).select(*keys, "r.parent_uuid", "r.value")
    state = first.select(*keys, F.when(F.col("value").isNull(), F.col("parent_uuid")).alias("up"), "value")
    state = materialize(state, "ancestors")
    longest, span = state.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0, 1
    while span <= 2 * longest:
        live = state.filter("up is not null")
        if live.isEmpty():
            break
        far = state.select("session_id", F.col("uuid").alias("up"), F.col("up").alias("_up"), F.col("value").alias("_v"))
        moved = live.join(far, ["session_id", "up"], "left").select(*keys, F.when(F.col("_v").isNull(), F.col("_up")).alias("up"), F.col("_v").alias("value"))
        state = materialize(state.filter("up is null").unionByName(moved), "ancestors")
        span *= 2
    return state.select(*keys, "value")


def ancestry(records: DataFrame, points: DataFrame) -> DataFrame:
    """Rows on the path from each fork point to its root; nothing when the path meets a repeated or unknown
    id, or does not end. A point without a session or an id is its own path.

    ``records``: session_id, uuid, parent_uuid. ``points``: session_id, point. Sessions of at most ``WALKED`` rows are walked
    many at a time, each within one task. In longer ones pointers double until they end, and are given up where they meet such an id; the
    paths of points whose pointer ended are then listed by the same pointers, so no row is listed of a path that is void.
    """
    c, keys = F.col, ["session_id", "uuid"]
    named = points.select("session_id", c("point").alias("uuid"), F.lit(None).cast(records.schema["parent_uuid"].dataType).alias("up"), F.lit(0).alias("one"), F.lit(1).alias("asks"))
    rows = records.select(*keys, c("parent_uuid").alias("up"), F.lit(1).alias("one"), F.lit(0).alias("asks"))
    nodes = rows.unionByName(named).filter("session_id is not null and uuid is not null").groupBy(*keys).agg(
        F.min("up").alias("up"), F.sum("one").alias("n"), F.sum("asks").alias("asks"))
    nodes = materialize(nodes.filter("n > 0"), "ancestry")
    sizes = nodes.groupBy("session_id").agg(F.count(F.lit(1)).alias("c"), F.sum("asks").alias("asks"))
    sizes = materialize(sizes.filter("asks > 0").select("session_id", "c"), "ancestry")
    total, longest = sizes.agg(F.sum(F.when(c("c") <= WALKED, c("c"))), F.max("c")).first()
    once = nodes.filter("n = 1").drop("n")
    out = points.filter("session_id is null or point is null").select("session_id", "point", c("point").alias("uuid"), F.lit(0).cast("bigint").alias("steps"))
    if total:
        short = once.join(sizes.filter(c("c") <= WALKED), "session_id", "left_semi")
        out = out.unionByName(_walked(short, -(-total // WALKED_TOGETHER)))
    if (longest or 0) > WALKED:
        out = out.unionByName(_climbed(once.join(sizes.filter(c("c") > WALKED), "session_id", "left_semi"), longest))
    return out


def _walked(nodes: DataFrame, groups: int) -> DataFrame:
    """Paths of points in whole sessions; ``nodes``: session_id, uuid, up, asks (how often it is a point)."""
    of = nodes.schema
    made = StructType([StructField(name, of[k].dataType) for name, k in (("session_id", "session_id"), ("point", "uuid"), ("uuid", "uuid"))] + [StructField("steps", LongType())])

    def walk(table: pa.Table) -> pa.Table:
        n = table.num_rows
        code = lambda x: pc.dictionary_encode(x, null_encoding="encode").combine_chunks().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        session = code(table["session_id"])
        ids = code(pa.chunked_array([*table["uuid"].chunks, *table["up"].chunks]))
        own, up = session * len(ids) + ids[:n], session * len(ids) + ids[n:]
        order = np.argsort(own)
        at = np.minimum(np.searchsorted(own[order], up), n - 1)
        parent = np.where(own[order][at] == up, order[at], n + 1)  # n: past a root, n + 1: an id that is unknown or repeated
        parent = np.concatenate([np.where(table["up"].is_null().to_numpy(), n, parent), [n, n + 1]])
        jump = parent
        for _ in range(int(n).bit_length()):
            jump = jump[jump]
        asks = table["asks"].to_numpy()
        point = np.repeat(np.arange(n), np.where(jump[:n] == n, asks, 0))
        now, found = point, []
        while len(now):
            found.append((point, now))
            point, now = point[parent[now] < n], parent[now][parent[now] < n]
        steps = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
        point, node = (np.concatenate([f[k] for f in found]) if found else point for k in (0, 1))
        return pa.table({"session_id": table["session_id"].take(pa.array(point)), "point": table["uuid"].take(pa.array(point)),
                         "uuid": table["uuid"].take(pa.array(node)), "steps": pa.array(steps, pa.int64())})

    return nodes.withColumn("_g", F.pmod(F.xxhash64("session_id"), F.lit(groups))).groupBy("_g").applyInArrow(walk, made)


def _climbed(nodes: DataFrame, longest: int) -> DataFrame:
    """Paths of points in sessions of any size, of ``longest`` rows at most; ``nodes`` as in ``_walked``."""
    c, keys = F.col, ["session_id", "uuid"]
    nodes = materialize(nodes, "ancestry")
    ended, live, jumps, span = nodes.filter("up is null").select(*keys), nodes.filter("up is not null").select(*keys, "up"), [], 1
    while span <= 2 * longest and not live.isEmpty():
        jumps.append(live)
        far = live.select("session_id", c("uuid").alias("up"), c("up").alias("_up")).unionByName(
            ended.select("session_id", c("uuid").alias("up"), F.lit(None).cast(nodes.schema["up"].dataType).alias("_up")))
        moved = materialize(live.join(far, ["session_id", "up"]).select(*keys, c("_up").alias("up")), "ancestry")
        ended, live = ended.unionByName(moved.filter("up is null").select(*keys)), moved.filter("up is not null")
        span *= 2
    good = nodes.filter("asks > 0").join(ended, keys, "left_semi")
    path = materialize(good.select("session_id", c("uuid").alias("point"), "uuid", F.lit(0).cast("bigint").alias("steps"), F.explode(F.sequence(F.lit(1), c("asks").cast("int"))).alias("_")).drop("_"), "ancestry")
    for r, jump in enumerate(jumps):
        further = path.join(jump, keys).select("session_id", "point", c("up").alias("uuid"), (c("steps") + (1 << r)).alias("steps"))
        path = path.unionByName(materialize(further, "ancestry"))
    return path


def propagate_conflicts(edges: DataFrame, conflicted: DataFrame) -> DataFrame:
    """Nodes that are conflicted or hang below a conflicted one; a node may have several parents.

    A pointer of 2^r steps stops where a conflict lies within them, so the rounds grow with the logarithm of the depth. A
    pointer that has gone further than there are nodes goes round a cycle without a conflict.
    """
    own = conflicted.select("node").distinct()
    clean = edges.filter("parent is not null").select("node", F.col("parent").alias("up")).distinct().join(own, "node", "left_anti")
    ends = own.select("node", F.lit(None).cast(clean.schema["up"].dataType).alias("up"), F.lit(True).alias("bad"))
    state = materialize(clean.select("node", "up", F.lit(False).alias("bad")).unionByName(ends), "conflicts")
    nodes, span = state.count(), 1
    while span <= 2 * nodes:
        live = state.filter("up is not null")
        if live.isEmpty():
            break
        far = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("bad").alias("_bad"))
        moved = live.join(far, "up").select("node", F.col("_up").alias("up"), F.col("_bad").alias("bad")).distinct()
        state = materialize(state.filter("bad").unionByName(moved).distinct(), "conflicts")
        span *= 2
    return state.filter("bad").select("node").distinct()


def descendants(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose point lies on or below their ancestor, on a path without a repeated id.

    ``records``: session_id, uuid, parent_uuid. ``pairs``: session_id, ancestor, point. Depths and jumps of 1, 2, 4, ...
    steps come from one doubling; a pair climbs by the jumps that its difference in depth is the sum of. So a pair stays one
    row, and no path is listed. A row whose parent no record has is a root; points above which there is a cycle are below nothing.
    """
    keys = ["session_id", "uuid"]
    c = F.col
    nodes = records.groupBy(*keys).agg((F.count(F.lit(1)) > 1).alias("void"), F.min("parent_uuid").alias("up"))
    known = nodes.select("session_id", c("uuid").alias("up"), F.lit(True).alias("_known"))
    state = nodes.join(known, ["session_id", "up"], "left").select(
        *keys, F.when(c("_known"), c("up")).alias("up"), F.when(c("_known"), 1).otherwise(0).cast("bigint").alias("depth"), "void", c("void").alias("past"))
    state = materialize(state, "descent")
    bound = state.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # of each round: up is the row 2^r steps above, depth the steps so far, past whether a repeated id is among the rows left behind
    jumps, span = [state.select(*keys, c("up").alias("at"), "past")], 1
    while span <= 2 * bound and not state.filter("up is not null").isEmpty():
        far = state.select("session_id", c("uuid").alias("up"), c("up").alias("_up"), c("depth").alias("_depth"), c("past").alias("_past"))
        state = materialize(state.join(far, ["session_id", "up"], "left").select(
            *keys, c("_up").alias("up"), (c("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), "void", (c("past") | F.coalesce("_past", F.lit(False))).alias("past")), "descent")
        jumps.append(state.select(*keys, c("up").alias("at"), "past"))
        span *= 2
    places = state.filter("up is null").select(*keys, "depth", "void")
    place = lambda name, depth: places.select("session_id", c("uuid").alias(name), c("depth").alias(depth), c("void").alias(f"_{name}"))
    climb = pairs.distinct().join(place("point", "_p"), ["session_id", "point"]).join(place("ancestor", "_a"), ["session_id", "ancestor"])
    climb = climb.filter("_p >= _a and not _ancestor").select("session_id", "ancestor", "point", c("point").alias("uuid"), (c("_p") - c("_a")).alias("left"), c("_point").alias("bad"))
    for r, jump in enumerate(jumps[:-1]):
        takes = F.shiftrightunsigned("left", r).bitwiseAND(F.lit(1)) == 1
        moved = climb.filter(takes).join(jump, keys).select("session_id", "ancestor", "point", c("at").alias("uuid"), "left", (c("bad") | c("past")).alias("bad"))
        climb = materialize(climb.filter(~takes).unionByName(moved), "climb")
    return climb.filter("uuid = ancestor and not bad").select("session_id", "ancestor", "point")


def copied_prefix(children: DataFrame, parents: DataFrame, relation: DataFrame) -> DataFrame:
    """Length of the parent prefix at the head of each child, one metadata row ahead of it.

    ``children``/``parents``: session_id, pos, digest. ``relation``: session_id, parent_id. Rows meet on
    (parent, position); each child then keeps its first differing position, so nothing is collected.
    """
    sizes = children.groupBy("session_id").agg((F.max("pos")).alias("child_rows"))
    rows = children.join(relation, "session_id").filter("pos > 0").select(
        "session_id", "parent_id", (F.col("pos") - 1).alias("pos"), F.col("digest").alias("child_digest"))
    p = parents.select(F.col("session_id").alias("parent_id"), "pos", F.col("digest").alias("parent_digest"))
    met = rows.join(p, ["parent_id", "pos"], "left")
    differs = ~F.col("child_digest").eqNullSafe(F.col("parent_digest"))
    first = met.groupBy("session_id", "parent_id").agg(F.min(F.when(differs, F.col("pos"))).alias("_stop"))
    return first.join(sizes, "session_id").select("session_id", "parent_id", F.coalesce("_stop", "child_rows").alias("matched"))


def confirmed_forks(prefixes: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """Copied prefixes that may end where they do.

    The parent tail is all later than the fork, or the record after the prefix has another shape on both
    sides. ``children``/``parents`` also carry ts_text and shape. A parent's rows are read once for all its forks.
    """
    head = children.filter("pos = 0").select("session_id", F.col("ts_text").alias("forked_at"))
    cand = materialize(prefixes.filter("matched > 0").join(head, "session_id"), "fork-candidates")
    rows = parents.select(F.col("session_id").alias("parent_id"), "pos", "ts_text", "shape")
    facts = since(
        rows, cand.select("parent_id", F.col("matched").alias("cut")), ["parent_id"], tail=ordered.RowNumber(), untimed=ordered.RunningMax((F.col("ts_text") == "").cast("int")),
        tail_from=ordered.RunningMin(F.col("ts_text")), next=ordered.LastValue(F.struct("pos", "shape")))
    facts = facts.select("parent_id", F.col("cut").alias("matched"), "tail", (F.col("untimed") == 1).alias("untimed"), "tail_from",
                         F.when(F.col("next.pos") == F.col("cut"), F.col("next.shape")).alias("parent_shape"))
    edge = children.select("session_id", "pos", F.col("shape").alias("child_shape")).join(
        cand.select("session_id", (F.col("matched") + 1).alias("pos")), ["session_id", "pos"]).select("session_id", "child_shape")
    joined = cand.join(facts, ["parent_id", "matched"], "left").join(edge, "session_id", "left")
    whole = F.coalesce("tail", F.lit(0)) == 0
    timed = (F.col("forked_at") != "") & ~F.col("untimed")
    ends = timed & ((F.col("tail_from") > F.col("forked_at"))
                    | (F.col("parent_shape").isNotNull() & F.col("child_shape").isNotNull() & (F.col("parent_shape") != F.col("child_shape"))))
    return joined.filter(whole | ends).select("session_id", "parent_id", "matched", "forked_at")


def fork_segment(pos: Column, matched: Column) -> Column:
    return F.when(pos == 0, "fork_metadata").when(pos <= matched, "inherited_context").otherwise("continuation")


def segment_rows(rows: DataFrame, forks: DataFrame) -> DataFrame:
    """Segment of every row of a fork child; rows of other sessions are their own."""
    return rows.join(forks.select("session_id", "matched"), "session_id", "left").withColumn(
        "segment", F.when(F.col("matched").isNotNull(), fork_segment(F.col("pos"), F.col("matched"))).otherwise(""))


def crossing_forks(refs: DataFrame, segmented: DataFrame) -> DataFrame:
    """Fork children with an event whose raw rows lie in more than one segment; such a fork is void."""
    seg = refs.join(segmented.filter("segment <> ''").select("raw_id", "segment", "session_id"), ["session_id", "raw_id"])
    per = seg.groupBy("session_id", "event_id").agg((F.min("segment") != F.max("segment")).alias("cross"))
    return per.filter("cross").select("session_id").distinct()


def inherited_summary(events: DataFrame, forks: DataFrame, previews: int = 12) -> DataFrame:
    """What a fork took over from its parent: counts by layer, time span, number of previews shown.

    ``events`` are the parent's: session_id, pos, layer, ts_text, event_id, has_text. They are read once for all forks of
    a parent; a fork reads the facts of its cut.
    """
    main = F.col("layer") != "protocol"
    one = lambda when: ordered.RunningSum(F.when(when, 1).otherwise(0).cast("bigint"))
    facts = before(
        events.withColumnRenamed("session_id", "parent_id"), forks.select("parent_id", F.col("matched").alias("cut")), ["parent_id"],
        main_events=one(main), protocol_events=one(~main), first=ordered.RunningMin(F.struct("pos", "ts_text")),
        last=ordered.LastValue(F.struct("ts_text", "event_id")), target=ordered.LastValue(F.when(main & F.col("has_text"), F.col("event_id"))))
    n_main = F.col("main_events")
    return forks.join(facts.withColumnRenamed("cut", "matched"), ["parent_id", "matched"]).filter("last is not null").select(
        "session_id", "parent_id", "main_events", "protocol_events",
        F.least(F.lit(previews).cast("bigint"), n_main).alias("preview_events"),
        F.greatest(F.lit(0).cast("bigint"), n_main - previews).alias("omitted_previews"),
        F.col("first.ts_text").alias("started_at"), F.col("last.ts_text").alias("updated_at"),
        F.coalesce("target", "last.event_id").alias("fork_point"))


def inherited_previews(events: DataFrame, forks: DataFrame, previews: int = 12) -> DataFrame:
    """The last main events that each fork took over, oldest first by ``place``; whole rows of ``events``."""
    main = events.withColumnRenamed("session_id", "parent_id").filter("layer <> 'protocol'")
    shown = last_before(main, forks.select("parent_id", F.col("matched").alias("cut")), ["parent_id"], previews)
    return forks.select("session_id", "parent_id", "matched").join(shown.withColumnRenamed("cut", "matched"), ["parent_id", "matched"])


def unique_foreign_parent(records: DataFrame, references: DataFrame) -> DataFrame:
    """Session whose records name exactly one foreign session it shares record ids with.

    ``records``: session_id, uuid. ``references``: session_id, foreign_id (distinct pairs). Only referenced
    pairs are compared, and the comparison is an equi join on (session, uuid).
    """
    pairs = references.select("session_id", "foreign_id").distinct().filter("session_id <> foreign_id")
    own = records.select("session_id", "uuid").distinct()
    theirs = own.select(F.col("session_id").alias("foreign_id"), "uuid")
    shared = own.join(pairs, "session_id").join(theirs, ["foreign_id", "uuid"], "left_semi").select("session_id", "foreign_id").distinct()
    return shared.groupBy("session_id").agg(F.min("foreign_id").alias("parent_id"), F.max("foreign_id").alias("_o")).filter(
        "parent_id = _o").drop("_o")


def copied_by_reference(rows: DataFrame, relation: DataFrame) -> DataFrame:
    """Leading rows that still name the parent session. ``rows``: session_id, pos, reference."""
    met = rows.join(relation, "session_id")
    stop = F.min(F.when(~F.col("reference").eqNullSafe(F.col("parent_id")), F.col("pos")))
    return met.groupBy("session_id", "parent_id").agg(F.coalesce(stop, F.max("pos") + 1).alias("copied")).filter("copied > 0")


def pointer_forks(pointers: DataFrame, sessions: DataFrame) -> DataFrame:
    """Printed id prefix -> the one session of the same container with it, one parent per child.

    Prefixes are at least eight characters, so the first eight are an equality key and the rest is checked.
    """
    head = F.substring("prefix", 1, 8)
    p = pointers.withColumn("_k", head)
    s = sessions.select("container", F.col("session_id").alias("child_id"), F.substring("session_id", 1, 8).alias("_k"))
    met = p.join(s, ["container", "_k"]).filter("child_id <> parent_id and startswith(child_id, prefix)")
    one_child = met.groupBy("parent_id", "prefix").agg(F.min("child_id").alias("child_id"), F.max("child_id").alias("_o")).filter("child_id = _o")
    return one_child.groupBy("child_id").agg(F.min("parent_id").alias("parent_id"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")


def superseded(forks: DataFrame, activity: DataFrame) -> DataFrame:
    """Parents replaced by their only ordinary fork child: it has main events, the parent none after the fork.

    ``forks``: session_id, parent_id, forked_at, derived. ``activity``: session_id, last_ts, all_timed, has_main.
    """
    ordinary = forks.filter("not derived")
    only = ordinary.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("session_id", "forked_at")).alias("c")).filter("n = 1")
    parent = activity.select(F.col("session_id").alias("parent_id"), "last_ts", "all_timed")
    child = activity.filter("has_main").select(F.col("session_id").alias("child_id"))
    return (
        only.select("parent_id", F.col("c.session_id").alias("child_id"), F.col("c.forked_at").alias("superseded_at"))
        .join(parent, "parent_id").filter("superseded_at <> '' and all_timed and last_ts <= superseded_at")
        .join(child, "child_id", "left_semi").select("parent_id", "child_id", "superseded_at")
    )


def history_boundary(rows: DataFrame) -> DataFrame:
    """Sessions whose record ordinals run 0, 1, 2, ... and whose header declares where own history starts.

    ``rows``: session_id, line, ordinal, start_ordinal (header row only), parent_ref (second row names it).
    """
    numbered = ordered.scan(rows, ["session_id"], "line", _n=ordered.RowNumber())
    facts = numbered.groupBy("session_id").agg(
        F.bool_and(F.col("ordinal") == F.col("_n") - 1).alias("contiguous"), F.count(F.lit(1)).alias("n"),
        F.min_by("start_ordinal", "line").alias("start"), F.min_by("parent_id", "line").alias("parent_id"),
        F.max(F.when(F.col("_n") == 2, F.col("meta_of"))).alias("second"))
    return facts.filter("contiguous and start >= 2 and start <= n and second = parent_id").select(
        "session_id", "parent_id", "start", (F.col("start") - 1).alias("inherited"))


def lineage(sessions: DataFrame) -> DataFrame:
    """Owner and fork relation: subagents get an owner, and a fork link when seeded; other children fork only.

    ``sessions``: session_id, parent_id, origin, seed_length.
    """
    known = sessions.select(F.col("session_id").alias("parent_id"), F.lit(True).alias("_known"))
    sub = F.col("origin") == "subagent"
    seeded = F.coalesce("seed_length", F.lit(0)) > 0
    linked = F.col("_known").isNotNull()
    return sessions.join(known, "parent_id", "left").select(
        "session_id", F.when(sub & linked, F.col("parent_id")).alias("owner_id"),
        F.when(linked & (~sub | seeded), F.col("parent_id")).alias("forked_from"),
        F.when(seeded, F.col("seed_length")).alias("boundary"))
