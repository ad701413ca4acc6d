"""Lifecycles rebuilt from records. A malformed group is never dropped: it falls back with a reason."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions.classify import plan_category
from skeinlog.operators import graph, ordered
from skeinlog.operators.folds import fold
from skeinlog.operators.pairing import nearest_span
from skeinlog.session import materialize

PARTIAL_TEXT_LIMIT = 16_000


# --- paired lifecycles -------------------------------------------------------------------------

def approvals(rows: DataFrame) -> DataFrame:
    """One row per approval request. ``rows``: session_id, request_id, line, part (asked/decided), outcome, malformed."""
    def of(part: str) -> Column:
        return F.when(F.col("part") == part, F.col("line"))
    g = rows.filter("request_id is not null").groupBy("session_id", "request_id").agg(
        F.count(of("asked")).alias("asked"), F.count(of("decided")).alias("decided"), F.bool_or("malformed").alias("malformed"),
        F.min(of("asked")).alias("asked_line"), F.min(of("decided")).alias("decided_line"),
        F.min_by("outcome", of("decided")).alias("outcome"))
    valid = ~F.col("malformed") & (F.col("asked") == 1) & (F.col("decided") <= 1) & (
        F.col("decided_line").isNull() | (F.col("decided_line") > F.col("asked_line")))
    status = F.when(~valid, "fallback").when(F.col("decided") == 1, "recorded").otherwise("incomplete")
    severity = F.when(valid & (F.col("outcome") == "unavailable"), "warning").otherwise("normal")
    return g.select("session_id", "request_id", status.alias("status"), severity.alias("severity"), "asked_line",
                    F.when(valid, F.col("decided_line")).alias("decided_line"), F.when(valid, F.col("outcome")).alias("outcome"))


def commands(rows: DataFrame) -> DataFrame:
    """Commands with exactly one run and one later done. ``rows``: session_id, command_id, line, part (run/done), result."""
    def of(part: str) -> Column:
        return F.when(F.col("part") == part, F.col("line"))
    g = rows.filter("command_id is not null").groupBy("session_id", "command_id").agg(
        F.count(of("run")).alias("runs"), F.count(of("done")).alias("dones"), F.min(of("run")).alias("run_line"),
        F.min(of("done")).alias("done_line"), F.min_by("result", of("done")).alias("result"))
    return g.filter("runs = 1 and dones = 1 and done_line > run_line").select(
        "session_id", "command_id", "run_line", "done_line",
        F.when(F.col("result") == "error", "failed").otherwise("success").alias("status"))


def retry_chains(rows: DataFrame) -> DataFrame:
    """Numbered retries of one request. ``rows``: session_id, retry_id, retry, line, part (scheduled/started), policy."""
    keys = ["session_id", "retry_id"]

    def of(part: str) -> Column:
        return F.when(F.col("part") == part, F.col("line"))
    attempts = rows.groupBy(*keys, "retry").agg(
        F.count(of("scheduled")).alias("n_sched"), F.count(of("started")).alias("n_start"), F.min(of("scheduled")).alias("sched"),
        F.min(of("started")).alias("start"), F.min("policy").alias("p_min"), F.max("policy").alias("p_max"))
    attempts = materialize(attempts, "attempts")
    seen = ordered.scan(attempts, keys, "retry", _n=ordered.RowNumber(), _sched=ordered.LastValue(F.col("sched"), inclusive=False))
    c = F.col
    g = seen.groupBy(*keys).agg(
        F.sum("n_sched").alias("schedules"), F.max(F.when(c("n_sched") > 0, c("retry"))).alias("last_retry"),
        F.bool_or((c("n_sched") > 0) & ((c("retry") != c("_n")) | (c("n_sched") > 1) | (c("sched") < c("_sched")))).alias("misnumbered"),
        (F.min("p_min") != F.max("p_max")).alias("mixed"), F.bool_or(c("n_start") > 1).alias("restarted"),
        F.bool_or((c("n_start") > 0) & (c("n_sched") == 0)).alias("stray"), F.bool_or(c("start") < c("sched")).alias("early"),
        F.count_if((c("n_sched") > 0) & (c("n_start") == 0)).alias("unstarted"),
        F.max_by("n_start", c("retry")).alias("last_started"))
    gap = c("unstarted") > F.when(c("last_started") == 0, 1).otherwise(0)
    reason = (F.when(c("schedules") == 0, "no scheduled retry").when(c("misnumbered") | c("mixed"), "inconsistent identity or numbering")
              .when(c("restarted"), "repeated start").when(c("early"), "started before scheduled")
              .when(gap, "gap before a later retry").when(c("stray"), "start without schedule").otherwise(""))
    status = F.when(reason != "", "fallback").when(c("last_started") > 0, "started").otherwise("scheduled")
    return g.select(*keys, "schedules", reason.alias("reason"), status.alias("status"))


def workflow_runs(rows: DataFrame) -> DataFrame:
    """Workflow runs. ``rows``: session_id, run_id, line, part (run-start/agent-start/agent-end/run-end), member, outcome."""
    keys = ["session_id", "run_id"]
    c = F.col

    def at(part: str) -> Column:
        return F.when(c("part") == part, c("line"))
    named = rows.filter("run_id is not null")
    members = named.filter("part in ('agent-start', 'agent-end')").groupBy(*keys, "member").agg(
        F.count(at("agent-start")).alias("s"), F.count(at("agent-end")).alias("e"), F.min(at("agent-start")).alias("sl"),
        F.min(at("agent-end")).alias("el"), F.min_by("outcome", at("agent-end")).alias("outcome"))
    bad = (c("s") != 1) | (c("e") > 1) | (c("el") < c("sl")) | ((c("e") == 1) & ~F.coalesce(c("outcome"), F.lit("")).isin("completed", "failed", "cancelled"))
    by_run = members.groupBy(*keys).agg(
        F.bool_or(bad).alias("bad_member"), F.count_if(c("e") == 0).alias("open"), F.count(F.lit(1)).alias("members"),
        *[F.count_if(c("outcome") == o).alias(o) for o in ("completed", "failed", "cancelled")])
    runs = named.groupBy(*keys).agg(
        F.count(at("run-start")).alias("starts"), F.count(at("run-end")).alias("ends"), F.min("line").alias("lo"), F.max("line").alias("hi"),
        F.min(at("run-start")).alias("start"), F.max(at("run-end")).alias("end"), F.max_by("outcome", at("run-end")).alias("stop"))
    j = runs.join(by_run, keys, "left").na.fill(False, ["bad_member"]).na.fill(0, ["open", "members", "completed", "failed", "cancelled"])
    reason = (F.when((c("starts") != 1) | (c("start") != c("lo")), "no single leading start")
              .when((c("ends") > 1) | ((c("ends") == 1) & (c("end") != c("hi"))), "no single trailing end")
              .when(c("bad_member"), "invalid member")
              .when((c("ends") == 1) & ~F.coalesce(c("stop"), F.lit("")).isin("completed", "cancelled", "error"), "invalid stop reason")
              .when((c("ends") == 1) & (c("open") > 0), "member left open").otherwise(""))
    status = (F.when(reason != "", "fallback").when(c("stop") == "completed", "success").when(c("stop") == "error", "failed")
              .when(c("stop") == "cancelled", "cancelled").otherwise("incomplete"))
    return j.select(*keys, reason.alias("reason"), status.alias("status"), "members", "completed", "failed", "cancelled", "open")


def compactions(rows: DataFrame) -> DataFrame:
    """Compactions by id. ``rows``: session_id, compaction_id, line, part (start/summary/prune/end), outcome, text."""
    c = F.col

    def last(part: str, value: str) -> Column:
        return F.max_by(value, F.when(c("part") == part, c("line")))
    g = rows.groupBy("session_id", "compaction_id").agg(
        F.count_if(c("part") == "start").alias("starts"), F.count_if(c("part") == "end").alias("ends"),
        last("end", "outcome").alias("outcome"), last("summary", "text").alias("summary"), F.count_if(c("part") == "prune").alias("prunes"))
    status = F.when(c("ends") == 0, "incomplete").when(c("outcome") == "error", "failed").otherwise("success")
    return g.select("session_id", "compaction_id", status.alias("status"), F.coalesce("summary", F.lit("")).alias("summary"), "prunes")


def goals_by_condition(rows: DataFrame) -> DataFrame:
    """Goals told by their condition: one initial row, at most one terminal one after it.

    ``rows``: session_id, condition, line, part (initial/terminal/hook), state.
    """
    c = F.col

    def at(part: str) -> Column:
        return F.when(c("part") == part, c("line"))
    g = rows.groupBy("session_id", "condition").agg(
        F.count(at("initial")).alias("initials"), F.count(at("terminal")).alias("terminals"), F.min(at("initial")).alias("first"),
        F.min(at("terminal")).alias("last"), F.min_by("state", at("terminal")).alias("state"), F.count(at("hook")).alias("hooks"))
    valid = (c("initials") == 1) & (c("terminals") <= 1) & (c("last").isNull() | (c("last") > c("first")))
    status = F.when(~valid, "fallback").when(c("terminals") == 0, "active").otherwise(c("state"))
    return g.select("session_id", "condition", status.alias("status"), F.when(valid, c("hooks")).otherwise(F.lit(0)).alias("hooks"))


def goals_by_descent(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Goals with the terminal row, hooks and hook errors that descend from their one initial row.

    ``rows``: session_id, condition, line, uuid, parent_uuid, part (initial/terminal/hook/error/invalid), valid, errors,
    tool_use_id, state. ``records``: session_id, uuid, parent_uuid of all rows. A goal falls back where a goal row is of
    neither shape, where its terminal row is not below and behind the initial one, where a hook in its scope is malformed or
    has not exactly the error row above it that it counts, and where an error row in its scope belongs to no hook.
    """
    c, goal = F.col, ["session_id", "condition"]

    def at(part: str, value: str = "line") -> Column:
        return F.when(c("part") == part, c(value))
    facts = rows.filter(c("part").isin("initial", "terminal", "invalid")).groupBy(*goal).agg(
        F.count(at("initial")).alias("initials"), F.count(at("terminal")).alias("terminals"), F.count(at("invalid")).alias("invalids"),
        F.min(at("initial")).alias("first"), F.min(at("initial", "uuid")).alias("first_uuid"), F.min(at("terminal")).alias("last"), F.min(at("terminal", "uuid")).alias("last_uuid"), F.min(at("terminal", "state")).alias("state"))
    single = (c("initials") == 1) & (c("terminals") <= 1) & (c("invalids") == 0) & (c("last").isNull() | (c("last") > c("first")))
    facts = facts.withColumn("single", single)
    later = rows.filter(c("part").isin("terminal", "hook", "error")).join(facts.filter("single").select(*goal, "first", "first_uuid", "last", "last_uuid"), goal).filter("line > first and parent_uuid is not null")
    later = materialize(later, "goals")
    below = graph.descendants(records, later.select("session_id", c("first_uuid").alias("ancestor"), c("parent_uuid").alias("point")))
    under = later.join(below.select("session_id", c("ancestor").alias("first_uuid"), c("point").alias("parent_uuid")), ["session_id", "first_uuid", "parent_uuid"])
    ahead = c("last").isNull() | (c("line") < c("last"))
    scope = under.filter((c("part") == "terminal") | ahead | F.coalesce((c("part") == "hook") & (c("parent_uuid") == c("last_uuid")), F.lit(False)))
    above = rows.filter("part = 'error'").select("session_id", c("uuid").alias("parent_uuid"), c("line").alias("_line"), c("condition").alias("_condition"), c("tool_use_id").alias("_tool"), c("valid").alias("_valid"))
    nearer = c("_line") < c("line")
    hooks = scope.filter("part = 'hook'").join(above, ["session_id", "parent_uuid"], "left").groupBy(*goal, "line").agg(
        F.first("errors").alias("errors"), F.first("valid").alias("valid"), F.count_if(nearer).alias("found"),
        F.count_if(nearer & c("_valid") & (c("_condition") == c("condition")) & c("_tool").eqNullSafe(c("tool_use_id"))).alias("fits"), F.min(F.when(nearer, c("_line"))).alias("error_line"))
    fine = c("valid") & (((c("errors") == 0) & (c("found") == 0)) | ((c("errors") == 1) & (c("found") == 1) & (c("fits") == 1)))
    told = hooks.groupBy(*goal).agg(F.count("*").alias("hooks"), F.count_if(~fine).alias("bad_hooks"))
    owned = hooks.filter(fine & (c("errors") == 1)).select(*goal, c("error_line").alias("line")).distinct()
    errors = scope.filter("part = 'error'").select(*goal, "line").distinct().join(owned.withColumn("_owned", F.lit(True)), [*goal, "line"], "left").groupBy(*goal).agg(
        F.count("*").alias("hook_errors"), F.count_if(c("_owned").isNull()).alias("stray"))
    ends = scope.filter("part = 'terminal'").groupBy(*goal).agg(F.count("*").alias("ended"))
    zero = lambda n: F.coalesce(n, F.lit(0).cast("bigint"))
    valid = c("single") & (zero("ended") == c("terminals")) & (zero("bad_hooks") == 0) & (zero("stray") == 0)
    status = F.when(~valid, "fallback").when(c("terminals") == 0, "active").otherwise(c("state"))
    return facts.join(told, goal, "left").join(errors, goal, "left").join(ends, goal, "left").filter("initials + terminals + invalids > 0").select(
        *goal, status.alias("status"), F.when(valid, zero("hooks")).otherwise(0).alias("hooks"), F.when(valid, zero("hook_errors")).otherwise(0).alias("hook_errors"))


# --- text of unfinished steps -------------------------------------------------------------------

def partial_messages(chunks: DataFrame, finished: DataFrame, limit: int = PARTIAL_TEXT_LIMIT) -> DataFrame:
    """Streamed text of steps that never got a final message, cut at the limit.

    Only the chunks that begin inside the limit are put together, so the group that is joined is bounded
    however many chunks a step has. ``chunks``: session_id, turn, step, channel, line, text.
    """
    keys = ["session_id", "turn", "step", "channel"]
    open_steps = chunks.join(finished.select("session_id", "turn", "step").distinct(), ["session_id", "turn", "step"], "left_anti")
    offset = ordered.scan(open_steps, keys, "line", _end=ordered.RunningSum(F.length("text").cast("bigint")))
    counted = open_steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"))
    inside = offset.filter((F.length("text") > 0) & (F.col("_end") - F.length("text") < limit))
    joined = inside.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_t"))
    text = F.substring(F.array_join(F.transform("_t", lambda t: t["text"]), ""), 1, limit)
    return counted.join(joined, keys, "left").select(*keys, "chunks", F.coalesce(text, F.lit("")).alias("text"))


def embedded_stream(rows: DataFrame, limit: int = PARTIAL_TEXT_LIMIT) -> DataFrame:
    """Blocks of the attempt stream kept inside an event: a finished block wins over its deltas.

    ``rows``: event_id, stream ARRAY<STRUCT<kind, block, text>>. A stream is one value, so its blocks are cut out of it in
    place and no text is shuffled; only events that several rows share are brought together.
    """
    shared = materialize(rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("event_id").alias("_id")), "shared-events")
    same = F.col("event_id").eqNullSafe(F.col("_id"))
    runs = _stream_runs(rows.join(shared, same, "left_anti")).select(
        "event_id", "block", "first", "done.text", "deltas", F.array_join("said", "").alias("joined"))
    merged = _stream_runs(rows.join(shared, same, "left_semi")).groupBy("event_id", "block").agg(
        F.min("first").alias("first"), F.min_by("done.text", "done.pos").alias("text"), F.sum("deltas").alias("deltas"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("at", "said")))).alias("_d"))
    merged = merged.select("event_id", "block", "first", "text", "deltas", F.array_join(F.transform("_d", lambda d: d["said"]), "").alias("joined"))
    return runs.unionByName(merged).select("event_id", "block", "first", "deltas", F.substring(F.coalesce("text", "joined"), 1, limit).alias("text"),
                                           F.col("text").isNotNull().alias("finished"))


def _stream_runs(rows: DataFrame) -> DataFrame:
    """A row per block of each stream: ``first`` place, first block end, number of deltas, places and texts of those that have one."""
    part = F.transform("stream", lambda p, i: F.struct(p["block"].alias("block"), i.alias("pos"), p["kind"].alias("kind"), p["text"].alias("text")))
    placed = rows.filter(F.size("stream") > 0).select("event_id", F.array_sort(part).alias("_s"))
    heads = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | ~F.get(F.col("_s"), i)["block"].eqNullSafe(F.get(F.col("_s"), i - 1)["block"]))
    cut = placed.withColumn("_at", heads)
    runs = F.transform("_at", lambda a, j: F.slice(F.col("_s"), a + 1, F.coalesce(F.get(F.col("_at"), j + 1), F.size("_s")) - a))
    run = cut.select("event_id", F.explode(runs).alias("_r"))
    said = F.filter("_r", lambda x: x["kind"] == "delta")
    facts = run.select("event_id", F.get("_r", F.lit(0)).alias("_0"), F.get(F.filter("_r", lambda x: x["kind"] == "block-end"), F.lit(0)).alias("done"), said.alias("_d"))
    heard = F.filter("_d", lambda x: x["text"].isNotNull())
    return facts.select("event_id", "_0.block", F.col("_0.pos").alias("first"), "done", F.size("_d").cast("bigint").alias("deltas"),
                        F.transform(heard, lambda x: x["pos"]).alias("at"), F.transform(heard, lambda x: x["text"]).alias("said"))


# --- ordered state machines ---------------------------------------------------------------------

GOAL_START = {"goal": None, "seen": {}}


def goal_revisions(rows: DataFrame) -> DataFrame:
    """Goal changes that are accepted, with the phase they lead to; a rejected change leaves the state alone.

    ``rows``: session_id, seq, operation, goal_id, revision, phase, objective, max_rounds, rounds, created_at, at.
    """
    return fold(rows, ["session_id"], "seq", _goal_step, GOAL_START, "accepted boolean, reason string, state string")


def _goal_step(state: dict, row: dict) -> dict:
    current, op, reason = state["goal"], row["operation"], ""
    named = json.dumps(row["goal_id"])
    follows = current is not None and row["goal_id"] == current["id"] and row["revision"] == current["revision"] + 1
    if op == "create":
        fresh = (row["revision"] == 1 and row["phase"] == "active" and row["rounds"] == 0
                 and (current is None or current["phase"] == "complete") and named not in state["seen"])
        reason = "" if fresh else "not a fresh goal"
    elif not follows:
        reason = "does not advance the current revision"
    elif row["at"] < current["at"]:
        reason = "goes back in time"
    elif op != "clear":
        same = row["objective"] == current["objective"] and row["max_rounds"] == current["max_rounds"]
        kept = row["created_at"] == current["created_at"] and row["rounds"] == current["rounds"]
        phase, target = current["phase"], row["phase"]
        allowed = {
            "edit": target == phase,
            "pause": same and phase == "active" and target == "paused",
            "resume": same and phase in ("active", "paused", "blocked") and target == "active" and current["rounds"] < row["max_rounds"],
            "complete": same and phase != "complete" and target == "complete",
            "block": same and phase == "active" and target == "blocked",
        }.get(op, False)
        reason = "" if kept and allowed else "invalid transition" if kept else "counters not preserved"
    if not reason:
        if op == "create":
            state["seen"][named] = True
        state["goal"] = None if op == "clear" else {
            "id": row["goal_id"], "revision": row["revision"], "phase": row["phase"], "objective": row["objective"],
            "max_rounds": row["max_rounds"], "rounds": row["rounds"], "created_at": row["created_at"], "at": row["at"]}
    phase = state["goal"]["phase"] if state["goal"] else ""
    return {"accepted": not reason, "reason": reason, "state": phase}


INBOX_START = {"queues": {"next-turn": [], "next-step": []}, "claimed": {}}
TURN_START = {"turn": "new", "is": "", "spoken": None}


def inbox_replay(rows: DataFrame) -> DataFrame:
    """Replay of two message queues. ``rows``: session_id, seq, part (splice/message), target, start, removed,
    inserted (comma list of ids), canceled, message_id."""
    return fold(rows, ["session_id"], "seq", _inbox_step, INBOX_START,
                "operation string, ids string, enqueued_seq bigint, claimed_seq bigint")


def _splice(queues: dict, row: dict) -> tuple[list, list, str] | None:
    """The queue after a splice, what it took out, and the operation it was; None if the queues don't allow it."""
    queue, at, gone = queues.get(row["target"]), row["start"], row["removed"] or 0
    new = [name for name in (row["inserted"] or "").split(",") if name]
    if queue is None or at is None or not 0 <= at <= at + gone <= len(queue):
        return None
    if row["canceled"]:
        kind = "generic" if gone else None
    elif not gone:
        kind = "enqueue" if new else None
    else:  # taking the head of one queue, or all of the other, claims it
        claims = gone == (1 if row["target"] == "next-turn" else len(queue)) and at == 0 and not new
        kind = "claim" if claims else "generic"
    after = [*queue[:at], *([name, row["seq"] if kind == "enqueue" else None] for name in new), *queue[at + gone:]]
    held = [name for target, waiting in queues.items() for name, _ in (after if target == row["target"] else waiting)]
    return None if kind is None or len({*held}) < len(held) else (after, queue[at:at + gone], kind)


def _inbox_step(state: dict, row: dict) -> dict:
    """A splice changes its queue; a message delivers the one claim that waits for it; a bad splice ends the replay."""
    found = {"operation": "", "ids": "", "enqueued_seq": None, "claimed_seq": None}
    if state["queues"] is None:
        return found
    if row["part"] == "message":
        ready = [claim for claim in state["claimed"].get(row["message_id"], ()) if claim[1] < row["seq"]]
        if len(ready) == 1:
            del state["claimed"][row["message_id"]]
            found |= {"operation": "delivered", "ids": row["message_id"], "enqueued_seq": ready[0][0], "claimed_seq": ready[0][1]}
        return found
    change = _splice(state["queues"], row)
    if change is None:
        state |= {"queues": None, "claimed": {}}
        return found
    state["queues"][row["target"]], taken, found["operation"] = change
    if found["operation"] == "claim":
        known = [(name, seq) for name, seq in taken if seq is not None]
        for name, seq in known:
            state["claimed"].setdefault(name, []).append([seq, row["seq"]])
        found["ids"] = ",".join(name for name, _ in known)
    elif found["operation"] == "enqueue":
        found["ids"] = ",".join(name for name in row["inserted"].split(",") if name)
    return found


def turn_ownership(rows: DataFrame) -> DataFrame:
    """Owning turn of every raw row, its evidence, and why a row has none.

    ``rows``: session_id, line, event_id, part (started/completed/context/rollback/user/other), turn_id,
    envelope, text. A turn opened by a user message is implicit until a later row names it; the name then
    also covers the rows before, through an alias that is joined back.
    """
    steps = fold(rows, ["session_id"], "line", _ownership_step, TURN_START,
                 "owner string, trailing boolean, conflict string, alias_of string, tier int")
    alias = steps.filter("alias_of is not null").select("session_id", F.col("alias_of").alias("owner"), F.col("owner").alias("named"))
    named = steps.join(alias, ["session_id", "owner"], "left").withColumn("owner", F.coalesce("named", "owner")).drop("named")
    tiers = named.filter("owner <> ''").groupBy("session_id", "owner").agg(F.max("tier").alias("best"))
    return named.join(tiers, ["session_id", "owner"], "left").select(
        "session_id", "line", "owner", "trailing", "conflict",
        F.element_at(F.array(*[F.lit(t) for t in EVIDENCE]), F.col("best")).alias("evidence"))


# Evidence of turn ownership from weakest to strongest.
EVIDENCE = ["implicit_user_turn", "canonical_raw_turn_id", "legacy_turn_context", "explicit_lifecycle"]


# What a row does to the session's turn. The turn is new (none yet), open, ended or lost; an open or ended one is the
# row's own, another one, or the row names none (untold); an open one may have no name yet (unnamed). The first rule whose
# states hold the present one applies: (states, action, strength of the evidence or the reason of a loss).
ANY = "new lost unnamed open-own open-other open-untold ended-own ended-other ended-untold"
TURN_RULES = {
    "rollback": [(ANY, "lose", "rollback_boundary")],
    "started": [(ANY, "open", 4)],
    "context": [("unnamed", "name", 3), ("open-own", "stay", 3), ("open-other", "lose", "conflicting_turn_context"), ("ended-own", "trail", 0), (ANY, "open", 3)],
    "completed": [("open-other", "lose", "conflicting_turn_completion"), ("unnamed open-own open-untold", "end", 0), ("ended-own ended-untold", "trail", 0),
                  (ANY, "lose", "completion_without_active_turn")],
    "user": [("open-own open-other open-untold", "stay", 0), (ANY, "begin", 1)],
    "mirrored": [("unnamed open-own open-other open-untold", "stay", 0), (ANY, "begin", 1)],
    "named": [("lost", "refuse", 0), (ANY, "claim", 2)],
    "bare": [("unnamed open-untold", "stay", 0), ("ended-untold", "trail", 0), (ANY, "refuse", 0)],
}


def _turn_state(state: dict, own: str) -> str:
    kind, turn = state["turn"], state["is"]
    if kind in ("new", "lost"):
        return kind
    if kind == "open" and turn.startswith("implicit:"):
        return "unnamed"
    return f"{kind}-{'untold' if not own else 'own' if turn == own else 'other'}"


def _ownership_step(state: dict, row: dict) -> dict:
    name, text, part = (row["turn_id"] or "").strip(), (row["text"] or "").strip(), row["part"]
    own = f"explicit:{name}" if name else ""
    if part == "user":
        before = state["spoken"]
        part = "mirrored" if before and before[0] != row["envelope"] and before[1] == text else "user"
    elif part not in ("rollback", "completed") and not (part in ("started", "context") and name):
        part = "named" if name else "bare"
    state["spoken"] = [row["envelope"], text] if row["part"] == "user" else None
    now, turn = _turn_state(state, own), state["is"]
    action, value = next((a, v) for states, a, v in TURN_RULES[part] if now in states.split(" "))
    out = {"owner": "", "trailing": False, "conflict": "", "alias_of": None, "tier": 0 if action == "lose" else value}
    if action == "lose":
        out["conflict"] = value
        state |= {"turn": "lost", "is": value}
    elif action == "refuse":
        out["conflict"] = turn if now == "lost" else ""
    else:
        out["owner"] = {"open": own, "name": own, "claim": own, "begin": f"implicit:{row['event_id']}", "end": own or turn}.get(action, turn)
        out["trailing"] = action == "trail"
        if action in ("name", "end") and out["owner"] != turn:
            out["alias_of"] = turn
        if action in ("open", "name", "begin"):
            state |= {"turn": "open", "is": out["owner"]}
        elif action == "end":
            state |= {"turn": "ended", "is": out["owner"]}
    return out


TASK_ITEMS = "array<struct<id:string,subject:string,status:string>>"


def task_states(rows: DataFrame) -> DataFrame:
    """Task list snapshots that differ from the list built so far by the task calls, and the tasks held after each row.

    ``rows``: session_id, line, part (create/update/snapshot), task_id, subject, status, items (JSON of the snapshot).

    A snapshot is the whole list from then on, so the list before the next one is this one and the calls between them: an
    epoch. In an epoch a task is what its own calls made of it, and two lists differ if any of their tasks does; no list is
    ever held. Of several items of one id the last counts; items that can't be read are an empty list.
    """
    shot = F.col("part") == "snapshot"
    known = ordered.scan(rows, ["session_id"], "line", _epoch=ordered.RunningSum(F.when(shot, 1).otherwise(0).cast("bigint")))
    known = known.withColumn("_items", F.map_from_entries(_last_of_each(F.from_json("items", TASK_ITEMS))))
    row = ["session_id", "_epoch", "line"]
    called = known.filter(~shot | shot.isNull()).select(
        *row, _task_key(F.col("task_id")).alias("_key"), (~F.col("status").eqNullSafe(F.lit("deleted"))).alias("_alive"),
        *[F.when(F.col("status").eqNullSafe(F.lit("deleted")), F.struct(_task_default(c).alias("v")))
          .when(F.col(c) != "", F.struct(F.col(c).alias("v"))).alias(f"_{c}") for c in ("subject", "status")],
        _task_default("subject").alias("_unnamed"))
    listed = known.filter(shot).select(*row, F.explode("_items").alias("_key", "i")).select(
        *row, "_key", F.lit(True).alias("_alive"), F.struct(F.col("i.subject").alias("v")).alias("_subject"), F.struct(F.col("i.status").alias("v")).alias("_status"),
        F.lit(None).cast("string").alias("_unnamed"))
    task = ["session_id", "_epoch", "_key"]
    steps = ordered.scan(called.unionByName(listed), task, "line", _was=ordered.Lag(F.col("_alive")),
                         _subject=ordered.LastValue(F.col("_subject")), _status=ordered.LastValue(F.col("_status")))
    held = F.struct(F.when(F.col("_subject").isNull(), F.col("_unnamed")).otherwise(F.col("_subject.v")).alias("subject"),
                    F.when(F.col("_status").isNull(), F.lit("")).otherwise(F.col("_status.v")).alias("status"))
    ends = steps.groupBy(*task).agg(F.max_by(F.struct(F.col("_alive").alias("alive"), held.alias("held")), "line").alias("end")).filter("end.alive")
    both = ends.select("session_id", (F.col("_epoch") + 1).alias("_epoch"), "_key", F.col("end.held").alias("held")).unionByName(
        listed.select(*task, F.struct(F.col("_subject.v").alias("subject"), F.col("_status.v").alias("status")).alias("held")))
    differs = both.groupBy(*task).agg(((F.count(F.lit(1)) != 2) | (F.min("held") != F.max("held"))).alias("differs"))
    news = differs.groupBy("session_id", "_epoch").agg(F.bool_or("differs").alias("_news"))

    grown = steps.groupBy(*row).agg(F.sum(F.col("_alive").cast("int") - F.coalesce(F.col("_was"), F.lit(False)).cast("int")).alias("_grown"))
    counted = known.select(*row, shot.alias("_shot")).join(grown, row, "left")
    counted = ordered.scan(counted, ["session_id", "_epoch"], "line", tasks=ordered.RunningSum(F.coalesce("_grown", F.lit(0))))
    return counted.join(news, ["session_id", "_epoch"], "left").select(
        "session_id", "line", (F.coalesce("_shot", F.lit(False)) & F.coalesce("_news", F.lit(False))).alias("novel"), F.col("tasks").cast("int").alias("tasks"))


def _task_key(task_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("#"), task_id), F.lit(""))  # a null id is a task, too


def _task_default(column: str) -> Column:
    return F.concat(F.lit("Task "), _task_key(F.col("task_id"))) if column == "subject" else F.lit("")


def _last_of_each(items: Column) -> Column:
    """(key, item) entries of a list, the last item of each id only."""
    items = F.coalesce(items, F.from_json(F.lit("[]"), TASK_ITEMS))
    ids = F.transform(items, lambda i: _task_key(i["id"]))
    return F.transform(F.array_distinct(ids), lambda k: F.struct(k, F.element_at(items, (F.size(items) + 1 - F.array_position(F.reverse(ids), k)).cast("int"))))


def scripted_operations(rows: DataFrame) -> DataFrame:
    """Scripted operations waiting in a cell and the waits on them.

    Every cell of a session is a machine of its own. ``rows``: session_id, cell_id, line, epoch, part (exec =
    the pending output of an exec call; wait = a wait call; result = the output of an accepted wait call),
    operation_id, call_epoch, call_id, pending.
    """
    return fold(rows, ["session_id", "cell_id"], "line", _cell_step, {"open": []}, "operation string, outcome string")


def _cell_step(state: dict, row: dict) -> dict:
    epoch = row["epoch"]
    open_now = [o for o in state["open"] if o[1] == epoch]
    out = {"operation": None, "outcome": ""}
    if row["part"] == "exec":
        if row["call_epoch"] == epoch:
            open_now.append([row["operation_id"], epoch, ""])
            out.update(operation=row["operation_id"], outcome="pending")
        else:
            out.update(operation=row["operation_id"], outcome="unobserved_terminal")
    elif row["part"] == "wait":
        if len(open_now) != 1:
            out["outcome"] = "orphan_cell" if not open_now else "ambiguous_cell"
        elif open_now[0][2]:
            out["outcome"] = "concurrent_wait"
        else:
            open_now[0][2] = row["call_id"]
            out.update(operation=open_now[0][0], outcome="waiting")
    else:
        mine = [o for o in open_now if o[2] == row["call_id"]]
        if mine:
            mine[0][2] = ""
            out.update(operation=mine[0][0], outcome="pending" if row["pending"] else "terminal")
            if not row["pending"]:
                open_now.remove(mine[0])
    state["open"] = open_now
    return out


def terminal_continuations(calls: DataFrame) -> DataFrame:
    """Writes that reach the process of the current exec call.

    ``calls``: session_id, line, end_line, tool (exec/write), process_id (of the exec receipt, or the one
    written to), ends (the write reports an exit, or does not reach the process), event_id.
    An exec call opens a generation and drops older candidates. It is a candidate once its output has named a
    process and no earlier exec was still running. A write counts when it was issued after that output, no
    other write of the process overlaps it, and nothing ended the process before its own output.
    """
    gens = ordered.scan(
        calls, ["session_id"], "line",
        generation=ordered.RunningSum((F.col("tool") == "exec").cast("bigint")),
        _busy=ordered.RunningMax(F.when(F.col("tool") == "exec", F.col("end_line")), inclusive=False),
        _next_exec=ordered.NextValue(F.when(F.col("tool") == "exec", F.col("line"))))
    gens = materialize(gens, "generations")
    creators = gens.filter("tool = 'exec' and process_id is not null and coalesce(_busy < line, true)").filter(
        "_next_exec is null or end_line < _next_exec").select(
        "session_id", "generation", "process_id", F.col("end_line").alias("ready"), F.col("event_id").alias("origin"))
    keys = ["session_id", "generation", "process_id"]
    writes = gens.filter("tool = 'write' and process_id is not null and end_line is not null").select(*keys, "line", "end_line", "ends", "reached", "event_id", "_next_exec")
    near = ordered.scan(writes, ["session_id", "process_id"], "line",
                        _before=ordered.RunningMax(F.col("end_line"), inclusive=False), _after=ordered.NextValue(F.col("line")))
    apart = ~F.coalesce(F.col("_before") >= F.col("line"), F.lit(False)) & ~F.coalesce(F.col("_after") <= F.col("end_line"), F.lit(False))
    met = near.withColumn("_apart", apart).join(creators, keys).filter("line > ready").filter("_next_exec is null or end_line < _next_exec")
    first_end = met.groupBy(*keys).agg(F.min(F.when(F.col("ends"), F.col("end_line"))).alias("_stop"))
    return met.join(first_end, keys).filter("_apart and reached and (_stop is null or end_line <= _stop)").select(
        "session_id", F.col("event_id").alias("write_event_id"), F.col("origin").alias("origin_event_id"), "process_id")


def declared_requests(source: Column) -> Column:
    """Tools a script declares by top-level awaited calls with literal arguments; anything else declares none."""
    names = F.regexp_extract_all(source, F.lit(r"await\s+tools\.(\w+)\(\s*\{"), F.lit(1))
    calls = F.regexp_count(source, F.lit(r"tools\.\w+"))
    dynamic = source.rlike(r"\b(if|for|while|switch|function|try|Promise)\b|=>|\$\{|\.\.\.")
    return F.when(dynamic | (calls != F.size(names)), F.array().cast("array<string>")).otherwise(F.array_distinct(names))


def fallback_rows(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """Records no event has taken become protocol events of their own, so every record shows exactly once."""
    return rows.join(owned.select("raw_id").distinct(), "raw_id", "left_anti").select(
        "session_id", "raw_id", F.lit("protocol").alias("layer"), F.coalesce(F.nullif("payload_type", F.lit("")), "record_type").alias("subtype"))


def async_outcomes(launched: DataFrame) -> DataFrame:
    """Outcome of a background launch from its last notification."""
    status = F.col("terminal_status")
    return launched.withColumn("outcome", F.when(status.isNull(), "in_progress").when(status.isin("failed", "error"), "failed")
                               .when(status.isin("declined", "cancelled", "canceled", "stopped"), "cancelled").otherwise("success"))


def plan_rows(events: DataFrame) -> DataFrame:
    """Plan artefacts and plan updates of the main layer."""
    category = plan_category(F.col("kind"), F.col("subtype"), F.col("tool_name"))
    return events.filter("layer = 'main'").withColumn("plan_category", category).filter("plan_category <> ''")


def operation_facts(operations: DataFrame, nested: DataFrame) -> DataFrame:
    """Operations with the number of events they enclose and the first of them."""
    per = nested.groupBy("span_id").agg(F.count(F.lit(1)).alias("nested"), F.min_by("event_id", "min_line").alias("first_nested"))
    return operations.join(per, "span_id", "left").select(F.col("span_id").alias("operation_id"), F.coalesce("nested", F.lit(0)).alias("nested"), "first_nested")


def goal_events(snapshots: DataFrame, calls: DataFrame, width: int = 1000) -> DataFrame:
    """Goal snapshots that change something, each with the tool call it came from when one is close enough."""
    changed = snapshots.filter("transition <> ''")
    found = nearest_span(changed.select("session_id", "signature", "line"), calls, width).withColumnRenamed("span_id", "tool_event_id")
    return changed.join(found, ["session_id", "line"], "left").select("session_id", "event_id", "transition", "tool_event_id")
