"""Queries over ordered per-session facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.operators import ordered, windows
from skeinlog.plans import bind
from skeinlog.plans.registry import query

BOUNDARY_SQL = "(kind = 'error' AND k % 10 = 0)"
EPOCH_SQL = f"""eb AS (SELECT *, last_value(nullif(turn_id, '') IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt FROM ev),
ep AS (SELECT *, CAST(sum(CASE WHEN {BOUNDARY_SQL} OR (turn_id <> '' AND lt IS NOT NULL AND turn_id <> lt) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM eb)"""


def is_boundary():
    return (F.col("kind") == "error") & (F.col("k") % 10 == 0)


def slim(spark, root, *more):
    return bind.events(spark, root).select("session_id", "line", "event_id", "kind", "k", "turn_id", *more)


@query("win_02_turn_epochs", bind.with_events(f"WITH {EPOCH_SQL} SELECT session_id, event_id, epoch FROM ep"))
def _(spark, root):
    return windows.turn_epochs(slim(spark, root), is_boundary()).select("session_id", "event_id", "epoch")


@query("agg_23_key_count_guards", bind.with_events(f"""
WITH {EPOCH_SQL} SELECT session_id, epoch, k % 6 AS item, count(*) AS n, count(*) = 1 AS is_unique FROM ep GROUP BY 1, 2, 3"""))
def _(spark, root):
    rows = windows.turn_epochs(slim(spark, root), is_boundary())
    return rows.groupBy("session_id", "epoch", (F.col("k") % 6).alias("item")).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == 1).alias("is_unique"))


@query("win_12_compaction_groups", bind.with_events("""
WITH p AS (SELECT *, CASE WHEN kind = 'compaction' THEN 'boundary' WHEN kind = 'user_message' THEN 'summary' WHEN kind = 'patch' THEN 'reference' ELSE 'other' END AS part FROM ev),
s AS (SELECT *, sum(CASE WHEN part = 'boundary' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS seg FROM p)
SELECT session_id, CAST(seg AS BIGINT) AS segment, arg_min(event_id, line) FILTER (WHERE part = 'boundary') AS boundary_event_id,
  arg_min(event_id, line) FILTER (WHERE part = 'summary') AS summary_event_id, arg_min(event_id, line) FILTER (WHERE part = 'reference') AS reference_event_id
FROM s WHERE seg > 0 GROUP BY 1, 2"""))
def _(spark, root):
    part = (F.when(F.col("kind") == "compaction", "boundary").when(F.col("kind") == "user_message", "summary")
            .when(F.col("kind") == "patch", "reference").otherwise("other"))
    return windows.compaction_groups(slim(spark, root).withColumn("part", part))


GOAL_SQL = """gs AS (SELECT session_id, line, event_id, k % 2 AS identity, floor(line / 4000) AS created_at, 'o' || (k % 3) AS objective,
  CASE WHEN k % 4 = 0 THEN 'complete' ELSE 'active' END AS status, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 2 END AS token_budget FROM ev WHERE kind = 'user_message')"""


@query("win_13_goal_transitions", bind.with_events(f"""
WITH {GOAL_SQL}, l AS (SELECT *, lag({{'c': created_at, 'o': objective, 's': status, 'b': token_budget}}) OVER (PARTITION BY session_id, identity ORDER BY line) AS p FROM gs)
SELECT session_id, event_id, CASE WHEN p IS NULL OR p.c <> created_at THEN 'created'
  WHEN p.o <> objective OR p.s <> status OR p.b IS DISTINCT FROM token_budget THEN 'updated' ELSE '' END AS transition FROM l"""))
def _(spark, root):
    k = F.col("k")
    rows = slim(spark, root).filter("kind = 'user_message'").select(
        "session_id", "line", "event_id", (k % 2).alias("identity"), F.floor(F.col("line") / 4000).alias("created_at"),
        F.concat(F.lit("o"), (k % 3).cast("string")).alias("objective"), F.when(k % 4 == 0, "complete").otherwise("active").alias("status"),
        F.when(k % 5 != 0, k % 2).alias("token_budget"))
    return windows.goal_transitions(rows).select("session_id", "event_id", "transition")


@query("win_14_permission_state", bind.with_events("""
WITH p AS (SELECT session_id, line, event_id, CASE WHEN k % 10 = 1 THEN 'preset' || (k % 4) END AS preset, CASE WHEN k % 10 = 2 THEN 'mode' || (k % 3) END AS sandbox_mode,
  CASE WHEN k % 10 = 3 THEN 'policy' || (k % 2) END AS approval_policy FROM ev WHERE k % 20 <> 11),
f AS (SELECT *, last_value(preset IGNORE NULLS) OVER w AS current_preset, last_value(sandbox_mode IGNORE NULLS) OVER w AS current_sandbox_mode,
  last_value(approval_policy IGNORE NULLS) OVER w AS current_approval_policy FROM p WINDOW w AS (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING))
SELECT session_id, event_id, current_preset, current_sandbox_mode, current_approval_policy,
  current_preset IS NOT NULL AND current_sandbox_mode IS NOT NULL AND current_approval_policy IS NOT NULL AS complete FROM f"""))
def _(spark, root):
    k = F.col("k")

    def named(prefix, n):
        return F.concat(F.lit(prefix), (k % n).cast("string"))
    rows = slim(spark, root).filter("k % 20 <> 11").withColumns({
        "preset": F.when(k % 10 == 1, named("preset", 4)), "sandbox_mode": F.when(k % 10 == 2, named("mode", 3)),
        "approval_policy": F.when(k % 10 == 3, named("policy", 2))})
    return windows.forward_fill(rows, ["preset", "sandbox_mode", "approval_policy"]).select(
        "session_id", "event_id", "current_preset", "current_sandbox_mode", "current_approval_policy", "complete")


@query("win_15_reminder_runs", bind.with_events("""
WITH r AS (SELECT session_id, line, event_id, CASE WHEN role = 'assistant' THEN 'f' || CAST(k // 50 AS VARCHAR) END AS fp, kind = 'patch' AS tr FROM ev WHERE role = 'assistant' OR kind = 'patch'),
t AS (SELECT *, sum(CASE WHEN tr THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS t FROM r),
s AS (SELECT * FROM t WHERE fp IS NOT NULL),
l AS (SELECT *, lag(fp) OVER w AS pf, lag(t) OVER w AS pt FROM s WINDOW w AS (PARTITION BY session_id ORDER BY line)),
g AS (SELECT *, sum(CASE WHEN pf IS NULL OR pf <> fp OR pt <> t THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT session_id, arg_min(event_id, line) AS run_id, count(*) AS snapshots, min(line) AS first_line, max(line) AS last_line, min(fp) AS fingerprint FROM g GROUP BY session_id, run"""))
def _(spark, root):
    rows = slim(spark, root, "role").filter("role = 'assistant' or kind = 'patch'").select(
        "session_id", "line", "event_id",
        F.when(F.col("role") == "assistant", F.concat(F.lit("f"), F.floor(F.col("k") / 50).cast("string"))).alias("fingerprint"),
        (F.col("kind") == "patch").alias("is_transition"))
    return windows.reminder_runs(rows)


@query("win_16_review_markers", bind.with_events("""
WITH r AS (SELECT session_id, line, CASE WHEN role = 'user' THEN 'entered' ELSE 'exited' END AS phase, line * 10 AS ms FROM ev WHERE role <> ''),
l AS (SELECT *, lag(phase) OVER (PARTITION BY session_id ORDER BY line) AS p FROM r),
g AS (SELECT *, CAST(sum(CASE WHEN phase = 'entered' OR p IS DISTINCT FROM 'entered' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS marker FROM l)
SELECT session_id, marker, max(ms) FILTER (WHERE phase = 'entered') AS entered_ms, max(ms) FILTER (WHERE phase = 'exited') AS exited_ms FROM g GROUP BY 1, 2"""))
def _(spark, root):
    from skeinlog.operators import pairing
    rows = slim(spark, root, "role").filter("role <> ''").select(
        "session_id", "line", F.when(F.col("role") == "user", "entered").otherwise("exited").alias("phase"), (F.col("line") * 10).alias("ms"))
    return pairing.review_markers(rows)


@query("win_17_exec_overlap", bind.with_events("""
WITH c AS (SELECT session_id, line, event_id, line + k * 20 AS end_line FROM ev WHERE tool_name <> '')
SELECT session_id, event_id, coalesce(max(end_line) OVER (PARTITION BY session_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= line, false) AS overlap FROM c"""))
def _(spark, root):
    rows = slim(spark, root, "tool_name").filter("tool_name <> ''").withColumn("end_line", F.col("line") + F.col("k") * 20)
    return windows.overlapping(rows).select("session_id", "event_id", "overlap")


@query("win_18_observation_cutoff", bind.with_events("""
WITH c AS (SELECT session_id, min(line) FILTER (WHERE kind = 'error' AND k > 60) AS cutoff FROM ev GROUP BY 1)
SELECT e.session_id, e.event_id FROM ev e JOIN c USING (session_id) WHERE cutoff IS NULL OR line < cutoff"""))
def _(spark, root):
    return windows.before_cutoff(slim(spark, root), (F.col("kind") == "error") & (F.col("k") > 60)).select("session_id", "event_id")


@query("win_19_staged_order", bind.with_events("""
SELECT session_id, event_id, max(line - k) OVER (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS running_ordinal FROM ev"""))
def _(spark, root):
    return windows.staged_order(slim(spark, root).withColumn("raw_ordinal", F.col("line") - F.col("k"))).select(
        "session_id", "event_id", "running_ordinal")


@query("win_20_event_order", bind.with_events("""
WITH f AS (SELECT session_id, bool_or(ts_text = '' OR k = 50) AS by_line FROM ev GROUP BY 1)
SELECT e.session_id, e.event_id, CASE WHEN by_line THEN '' ELSE ts_text END AS sort_text, by_line FROM ev e JOIN f USING (session_id)"""))
def _(spark, root):
    return windows.event_order(slim(spark, root, "ts_text"), F.col("k") == 50).select("session_id", "event_id", "sort_text", "by_line")


@query("win_22_latest_title", bind.with_events("""
WITH t AS (SELECT session_id, line, CASE WHEN k % 10 = 4 THEN preview END AS title, CASE WHEN k % 7 = 0 THEN 'p' || (k % 5) END AS provider FROM ev)
SELECT session_id, coalesce(arg_max(title, line) FILTER (WHERE title IS NOT NULL AND line >= 6000), 'agent ' || session_id) AS title,
  arg_max(provider, line) FILTER (WHERE provider IS NOT NULL) AS provider FROM t GROUP BY 1"""))
def _(spark, root):
    k = F.col("k")
    rows = slim(spark, root, "preview").select(
        "session_id", "line", F.when(k % 10 == 4, F.col("preview")).alias("title"),
        F.concat(F.lit("agent "), "session_id").alias("label"), F.when(k % 7 == 0, F.concat(F.lit("p"), (k % 5).cast("string"))).alias("provider"))
    return windows.latest_title(rows, F.lit(6000))


@query("win_24_open_context", bind.with_events("""
WITH b AS (SELECT session_id, line, event_id, CASE WHEN kind = 'error' THEN {'t': k % 10, 's': k % 4, 'o': k % 3 <> 0} END AS c FROM ev),
f AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS x FROM b)
SELECT session_id, event_id, CASE WHEN x.o THEN x.t END AS open_turn, CASE WHEN x.o THEN x.s END AS open_step FROM f"""))
def _(spark, root):
    k = F.col("k")
    rows = slim(spark, root).select("session_id", "line", "event_id", (k % 10).alias("turn"), (k % 4).alias("step"),
                                    F.when(F.col("kind") == "error", k % 3 != 0).alias("opens"))
    return windows.open_context(rows).select("session_id", "event_id", "open_turn", "open_step")


@query("dq_09_sequence_continuity", bind.with_events("""
WITH s AS (SELECT session_id, line, row_number() OVER (PARTITION BY session_id ORDER BY line) - 1 AS n, k FROM ev),
q AS (SELECT session_id, line, n * 3 + CASE WHEN k = 8 THEN 1 ELSE 0 END AS seq0, n * 3 + 2 AS seq_end FROM s),
l AS (SELECT *, coalesce(lag(seq_end) OVER (PARTITION BY session_id ORDER BY line) + 1, 0) AS expected FROM q)
SELECT session_id, line, seq0, expected FROM l WHERE seq0 <> expected"""))
def _(spark, root):
    rows = ordered.scan(slim(spark, root), ["session_id"], "line", n=ordered.RowNumber())
    seq = rows.select("session_id", "line", ((F.col("n") - 1) * 3 + F.when(F.col("k") == 8, 1).otherwise(0)).alias("seq0"), ((F.col("n") - 1) * 3 + 2).alias("seq_end"))
    return windows.sequence_gaps(seq)
