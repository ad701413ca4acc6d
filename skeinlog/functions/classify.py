"""Row-local classification of logical events: layer, lane, plan facet, status, folding state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions import vocabulary as V
from skeinlog.functions.text import trim


def protocol_text_class(text: Column, role: Column) -> Column:
    """Subtype of a message that is protocol text, '' for ordinary text. First matching prefix wins."""
    def chain(pairs: list[tuple[str, str]]) -> Column:
        out = None
        for prefix, name in pairs:
            cond = F.startswith(F.coalesce(text, F.lit("")), F.lit(prefix))
            out = F.when(cond, name) if out is None else out.when(cond, name)
        return out.otherwise("")
    return F.when(role == "developer", chain(V.DEVELOPER_PREFIXES)).otherwise(chain(V.MESSAGE_PREFIXES))


def _lane(kind: Column) -> Column:
    return (F.when(kind.isin(V.INPUT_KINDS), "input").when(kind.isin(V.MODEL_KINDS), "model")
            .when(kind.isin(V.TOOL_KINDS), "tools"))


def trajectory_lane(kind: Column, subtype: Column, role: Column, tool_name: Column) -> Column:
    def field(c: Column) -> Column:
        return F.lower(trim(F.coalesce(c, F.lit(""))))
    r = field(role)
    by_role = (F.when(r.isin("user", "human", "developer"), "input")
               .when(r.isin("tool", "function") | (field(tool_name) != ""), "tools")
               .when(r.isin("assistant", "model", "reasoning"), "model"))
    return F.coalesce(_lane(field(kind)), _lane(field(subtype)), by_role, F.lit("other"))


def reliable_turn_id(turn_id: Column) -> Column:
    text = trim(F.coalesce(turn_id, F.lit("")))
    bad = (text == "") | F.lower(text).isin(V.UNRELIABLE_TURN_IDS) | text.rlike(r"(?i)^\[.*(?:omitted|redacted).*\]$")
    return F.when(~bad, text)


def plan_category(kind: Column, subtype: Column, tool_name: Column) -> Column:
    no_tool = tool_name == ""
    return (F.when((kind == "proposed_plan") & (subtype == "proposed_plan") & no_tool, "artifact")
            .when((kind == "other_tool_call") & (subtype == "update_plan") & (tool_name == "update_plan"), "update")
            .when((kind == "other_tool_call") & (subtype == tool_name)
                  & tool_name.isin("TaskCreate", "TaskUpdate"), "update")
            .when((kind == "plan_update") & subtype.isin("plan_update", "plan_delta") & no_tool, "update")
            .otherwise(""))


def is_failure(status: Column, severity: Column) -> Column:
    return F.lower(trim(status)).isin(V.FAILURE_STATUSES) | (F.lower(trim(severity)) == "error")


def has_long_output(preview: Column, search_text: Column) -> Column:
    return (F.length(preview) > 800) | (F.length(search_text) > 1600)


def derived_session_kind(primary_kind: Column, nickname: Column, parent_id: Column) -> Column:
    return (F.when(F.coalesce(primary_kind, F.lit("")) != "", primary_kind)
            .when(F.coalesce(nickname, F.lit("")).rlike(r"(?i)\breview\b"), "review")
            .when(F.coalesce(parent_id, F.lit("")) != "", "subagent").otherwise(""))


def call_status(declined: Column, failed: Column, exit_code: Column, succeeded: Column) -> Column:
    """declined > failed or non-zero exit > success > incomplete."""
    return (F.when(declined, "declined")
            .when(failed | (exit_code.isNotNull() & (exit_code != 0)), "failed")
            .when(succeeded | (exit_code == 0), "success").otherwise("incomplete"))


def call_severity(status: Column) -> Column:
    return F.when(status == "failed", "error").when(status.isin("declined", "incomplete"), "warning").otherwise("normal")


# --- folding ------------------------------------------------------------------------------------

def state_rank(state: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in V.DISPLAY_STATES]), state) - 1


def rank_state(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in V.DISPLAY_STATES]), (rank + 1).cast("int"))


def folding_conditions(hit: Column) -> dict[str, Column]:
    """Condition name -> predicate over the logical event columns."""
    c = F.col
    category = plan_category(c("kind"), c("subtype"), c("tool_name"))
    words = "|".join(V.REVIEW_COMMAND_WORDS)
    return {
        "searchHit": hit,
        "importantEvent": c("kind").isin(V.IMPORTANT_KINDS) | (category != "") | (c("severity") != "normal")
        | (c("status") == "failed"),
        "updatePlanCall": category == "update",
        "userInputRequest": (c("tool_name") == "request_user_input") | (c("subtype") == "request_user_input"),
        "codeModeScriptOperation": (c("kind") == "code_mode_operation") & (F.size("declared_requests") == 0),
        "readableReasoning": (c("kind") == "reasoning") & c("has_readable_reasoning"),
        "failedStatus": c("status") == "failed",
        "errorSeverity": c("severity") == "error",
        "abnormalSeverity": c("severity") != "normal",
        "reviewCommand": (c("kind") == "command") & c("preview").rlike(rf"(?i)\b({words})\b"),
        "touchedFiles": F.size("touched_files") > 0,
    }


def _request_rank(profile: tuple[dict, str, dict], request: str) -> int:
    """Rank a declared request gets from the rules for the ordinary tool of that name."""
    kind_states, fallback, conditions = profile
    kinds = {tool: kind for tool, _, kind in V.SCRIPTED_TOOLS}
    kinds.update({tool: "agent_coordination" for tool, _, _ in V.AGENT_COORDINATION_TOOLS})
    kind = kinds.get(request, "other_tool_call")
    is_plan = kind == "other_tool_call" and request in ("update_plan", "TaskCreate", "TaskUpdate")
    holds = {"importantEvent": kind in V.IMPORTANT_KINDS or is_plan, "updatePlanCall": is_plan,
             "userInputRequest": request == "request_user_input"}
    states = [state for name, state in conditions.items() if holds.get(name)]
    if kind in kind_states:
        states.append(kind_states[kind])
    elif kind in ("agent_coordination", "read") and "other_tool_call" in kind_states:
        states.append(kind_states["other_tool_call"])
    return max(map(V.DISPLAY_STATES.index, states or [fallback]))


def _scripted_rank(profile: tuple[dict, str, dict]) -> Column:
    """Rank contributed by the requests a scripted operation declares."""
    known = [tool for tool, *_ in V.SCRIPTED_TOOLS + V.AGENT_COORDINATION_TOOLS] + ["TaskCreate", "TaskUpdate"]
    ranks = F.create_map(*[F.lit(x) for tool in known for x in (tool, _request_rank(profile, tool))])
    default = F.lit(_request_rank(profile, ""))
    declared = F.array_max(F.transform("declared_requests", lambda r: F.coalesce(F.try_element_at(ranks, r), default)))
    silent = F.lit(None).cast("int") if "codeModeScriptOperation" in profile[2] else default
    return F.when(F.size("declared_requests") > 0, declared).otherwise(silent)


def display_state(profile: tuple[dict, str, dict], hit: Column) -> Column:
    """Most visible of the kind state and the matching conditions; the fallback when nothing matches.

    A scripted operation has no kind state of its own: the requests it declares decide.
    """
    kind_states, fallback, condition_states = profile
    rank = {s: i for i, s in enumerate(V.DISPLAY_STATES)}
    by_kind = F.lit(None).cast("int")
    for kind, state in kind_states.items():
        by_kind = F.when(F.col("kind") == kind, rank[state]).otherwise(by_kind)
    if "other_tool_call" in kind_states:
        inherits = F.col("kind").isin([k for k in ("agent_coordination", "read") if k not in kind_states])
        by_kind = F.when(inherits, rank[kind_states["other_tool_call"]]).otherwise(by_kind)
    by_kind = F.when(F.col("kind") == "code_mode_operation", _scripted_rank(profile)).otherwise(by_kind)
    predicates = folding_conditions(hit)
    parts = [by_kind] + [F.when(predicates[name], rank[state]) for name, state in condition_states.items()]
    best = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return rank_state(F.coalesce(best, F.lit(rank[fallback])))


def merged_profile(*rule_sets: tuple[dict, str, dict]) -> tuple[dict, str, dict]:
    """User rule sets combined: later kind states win, a condition named twice keeps the more visible state."""
    kinds, conditions, fallback = {}, {}, "summary"
    for kind_states, fb, condition_states in rule_sets:
        kinds.update({k: s for k, s in kind_states.items() if s in V.DISPLAY_STATES})
        fallback = fb if fb in V.DISPLAY_STATES else "summary"
        for name, state in condition_states.items():
            if state not in V.DISPLAY_STATES[1:]:
                continue
            held = conditions.get(name, state)
            conditions[name] = max(held, state, key=V.DISPLAY_STATES.index)
    return kinds, fallback, conditions


# --- static dimensions ----------------------------------------------------------------------------

def lifecycle_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.LIFECYCLE_TYPES, "wire_type string, family string, phase string, rank int, standalone boolean")


def tool_dimension(spark: SparkSession) -> DataFrame:
    rows = [(tool, "", title, kind) for tool, title, kind in V.SCRIPTED_TOOLS]
    rows += [(tool, action, title, "agent_coordination") for tool, action, title in V.AGENT_COORDINATION_TOOLS]
    return spark.createDataFrame(rows, "tool_name string, action string, title string, ordinary_kind string")


def kind_group_dimension(spark: SparkSession) -> DataFrame:
    rows = [(kind, group, priority, i) for group, priority, kinds in V.KIND_GROUPS for i, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, "kind string, kind_group string, group_priority int, kind_priority int")


def with_tool_kind(calls: DataFrame, spark: SparkSession) -> DataFrame:
    """Kind of a call by its family's registered tool names, else by its name pattern. ``calls`` has tool_name, and
    family where it isn't codex; the other families' names are taken in any case."""
    own = tool_dimension(spark).filter("tool_name <> 'web_search'").select(F.lit("codex").alias("_family"), F.col("tool_name").alias("_tool"), F.col("ordinary_kind").alias("_kind"))
    others = spark.createDataFrame([("codex", "web_search", "web_search"), *V.FAMILY_TOOLS], "_family string, _tool string, _kind string")
    dim = own.unionByName(others).dropDuplicates(["_family", "_tool"])
    family = F.col("family") if "family" in calls.columns else F.lit("codex")
    name = F.when(family == "codex", F.col("tool_name")).otherwise(F.lower("tool_name"))
    pattern = F.when(name.rlike("^(mcp__|mcp:)") & (family != "deepseek"), "mcp_call").otherwise("other_tool_call")
    met = calls.join(F.broadcast(dim), (family == F.col("_family")) & (name == F.col("_tool")), "left")  # some fifty rows
    return met.withColumn("tool_kind", F.coalesce("_kind", pattern)).drop("_family", "_tool", "_kind")


def with_overrides(events: DataFrame, overrides: DataFrame, profile: tuple[dict, str, dict]) -> DataFrame:
    """Display state with per-event overrides; an override naming an unknown state is ignored."""
    valid = overrides.filter(F.col("override").isin(V.DISPLAY_STATES)).select("session_id", "event_id", "override")
    return (
        events.withColumn("_rule", display_state(profile, F.lit(False)))
        .join(valid, ["session_id", "event_id"], "left")
        .withColumn("state", F.coalesce("override", "_rule")).drop("override", "_rule")
    )
