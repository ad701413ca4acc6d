"""Facts read out of transcript records. Records are VARIANT columns; every read tolerates a wrong type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlog.functions import numbers, text
from skeinlog.functions.search_json import has_only_keys, token_leaves


def get(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, path, kind)


def kind_at(record: Column, path: str) -> Column:
    """Type name of the value at a path, NULL when there is none."""
    return F.schema_of_variant(F.try_variant_get(record, path, "variant"))


def text_at(record: Column, *paths: str) -> Column:
    """First path that holds a string, '' when none does."""
    return F.coalesce(*[F.when(kind_at(record, p) == "STRING", get(record, p)) for p in paths], F.lit(""))


def json_at(record: Column, path: str) -> Column:
    """Value at a path as JSON text."""
    return F.to_json(F.try_variant_get(record, path, "variant"))


def content_text(record: Column, path: str) -> Column:
    """Texts of a content array, one per line."""
    parts = F.transform(get(record, path, "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    return text.trim(F.coalesce(F.array_join(parts, "\n"), F.lit("")))


# Token fields of an accounting node.
TOKEN_FIELDS = ["input_tokens", "cached_input_tokens", "output_tokens", "total_tokens"]


def token_accounting(record: Column) -> Column:
    """First node that owns a token field: the last request, the totals, the payload. Presence is kept apart from value."""
    def node(path: str, name: str) -> Column:
        def held(field: str) -> Column:
            return kind_at(record, f"{path}.{field}").isNotNull()
        owns = held(TOKEN_FIELDS[0])
        for field in TOKEN_FIELDS[1:]:
            owns = owns | held(field)

        def number(field: str) -> Column:
            exact = kind_at(record, f"{path}.{field}").isin("BIGINT", "INT", "SMALLINT", "TINYINT")
            return numbers.safe_count(F.when(exact, get(record, f"{path}.{field}", "bigint")))
        return F.when(owns, F.struct(
            F.lit(name).alias("source"), held("input_tokens").alias("has_input"), held("cached_input_tokens").alias("has_cached"),
            number("input_tokens").alias("input_tokens"), number("cached_input_tokens").alias("cached_tokens"),
            number("output_tokens").alias("output_tokens"), number("total_tokens").alias("total_tokens")))
    missing = F.struct(F.lit("missing").alias("source"), F.lit(False).alias("has_input"), F.lit(False).alias("has_cached"),
                       *[F.lit(None).cast("bigint").alias(n) for n in ("input_tokens", "cached_tokens", "output_tokens", "total_tokens")])
    return F.coalesce(node("$.payload.info.last_token_usage", "last_token_usage"), node("$.payload.info", "info"), node("$.payload", "payload"), missing)


def token_entries(record: Column) -> Column:
    """Numeric leaves of the usage node, at any depth; limits and rates are left out, known fields come first.

    The node is ``info``, or the payload where it has none. Only records that have it are walked in Python.
    """
    info = F.try_variant_get(record, "$.payload.info", "string")
    held = F.substring(kind_at(record, "$.payload.info"), 1, 6) == "OBJECT"
    return token_leaves(F.when(held, "info").otherwise(""), F.when(held, info).otherwise(F.try_variant_get(record, "$.payload", "string")))


def usage_limits(record: Column) -> Column:
    """Limits with their remaining share, window and reset time."""
    limits = F.map_entries(get(record, "$.payload.rate_limits", "map<string,variant>"))

    def item(e: Column) -> Column:
        used = F.try_variant_get(e["value"], "$.used_percent", "double")
        minutes = F.try_variant_get(e["value"], "$.window_minutes", "bigint")
        reset = F.try_variant_get(e["value"], "$.resets_at", "bigint")
        ms = F.when(reset < 10_000_000_000, reset * 1000).otherwise(reset)
        window = F.when(minutes == 300, "5h").when(minutes == 10080, "weekly").otherwise("")
        return F.struct(e["key"].alias("key"), window.alias("window"), numbers.percent_text(100 - used).alias("remaining"),
                        F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("resets_at"))
    return F.filter(F.transform(limits, item), lambda x: (x["remaining"] != "") & x["resets_at"].isNotNull())


def limit_reached(record: Column) -> Column:
    return text_at(record, "$.payload.rate_limits.rate_limit_reached_type", "$.payload.rate_limit_reached_type")


def review_phase(record: Column, owner: Column) -> Column:
    """entered / exited from either envelope; rows naming another thread do not count."""
    payload = text_at(record, "$.payload.type")
    item = text_at(record, "$.payload.item.type")
    thread = text_at(record, "$.payload.thread_id")
    phase = (F.when(payload == "entered_review_mode", "entered").when(payload == "exited_review_mode", "exited")
             .when((payload == "item_completed") & (item == "EnteredReviewMode"), "entered")
             .when((payload == "item_completed") & (item == "ExitedReviewMode"), "exited"))
    return F.when((text_at(record, "$.type") == "event_msg") & ((thread == "") | (thread == owner)), phase)


# Typed item -> lifecycle stem and tool name.
TYPED_ITEMS = {"CommandExecution": ("exec_command", "shell_command"), "FileChange": ("patch_apply", "apply_patch"),
               "McpToolCall": ("mcp_tool_call", ""), "DynamicToolCall": ("dynamic_tool_call", "")}


# Paths a typed item is read from.
TYPED_PATHS = {
    "payload_type": "$.payload.type", "thread_id": "$.payload.thread_id", "item_type": "$.payload.item.type", "item_status": "$.payload.item.status",
    "item_id": "$.payload.item.id", "item_server": "$.payload.item.server", "item_tool": "$.payload.item.tool", "item_namespace": "$.payload.item.namespace",
}


def typed_item(read: dict[str, Column], owner: Column) -> Column:
    """A completed typed item in the shape of the older lifecycle rows: payload type, call id, tool name.

    ``read`` holds the texts at ``TYPED_PATHS``.
    """
    kind = read["item_type"]
    phase = F.when(read["item_status"].isin("completed", "failed", "declined", "interrupted"), "_end").otherwise("_update")
    stem = F.create_map(*[F.lit(x) for k, (s, _) in TYPED_ITEMS.items() for x in (k, s)])[kind]
    name = (F.when(kind == "McpToolCall", F.concat(F.lit("mcp__"), read["item_server"], F.lit("__"), read["item_tool"]))
            .when(kind == "DynamicToolCall", F.concat_ws(".", F.nullif(read["item_namespace"], F.lit("")), read["item_tool"]))
            .when(kind == "CommandExecution", "shell_command").when(kind == "FileChange", "apply_patch"))
    own = (read["payload_type"] == "item_completed") & ((read["thread_id"] == "") | (read["thread_id"] == owner)) & (read["item_id"] != "")
    return F.when(own & stem.isNotNull(), F.struct(F.concat(stem, phase).alias("payload_type"), read["item_id"].alias("call_id"), name.alias("tool_name")))


def typed_reads(record: Column) -> dict[str, Column]:
    return {name: text_at(record, path) for name, path in TYPED_PATHS.items()}


def attachment_summary(record: Column, path: str = "$.payload.content") -> Column:
    """Attachments of a message: how many are inline, by file, or invalid, and one identity for all of them."""
    parts = F.filter(get(record, path, "array<variant>"), lambda p: F.try_variant_get(p, "$.type", "string") == "input_image")

    def url(p: Column) -> Column:
        return F.try_variant_get(p, "$.image_url", "string")

    def file(p: Column) -> Column:
        return F.try_variant_get(p, "$.file_id", "string")
    ids = F.transform(parts, lambda p: F.coalesce(url(p), file(p), F.lit("")))
    framed = F.array_join(F.transform(ids, lambda i: F.concat(F.length(i).cast("string"), F.lit(":"), i)), "")
    return F.struct(
        F.coalesce(F.size(parts), F.lit(0)).alias("total"), F.size(F.filter(parts, lambda p: url(p).isNotNull() & file(p).isNull())).alias("inline"),
        F.size(F.filter(parts, lambda p: file(p).isNotNull() & url(p).isNull())).alias("files"),
        F.size(F.filter(parts, lambda p: url(p).isNull() == file(p).isNull())).alias("invalid"), F.sha2(framed, 256).alias("identity"))


def external_input(record: Column) -> Column:
    """Name of a tool output that answers no call: there is no call id, a name, and only known output parts."""
    out = "$.payload.output"
    parts = get(record, out, "array<variant>")

    def known(p: Column) -> Column:
        return F.coalesce(F.try_variant_get(p, "$.type", "string").isin("input_text", "input_image", "input_audio", "encrypted_content"), F.lit(False))
    shape = (kind_at(record, out) == "STRING") | F.coalesce(F.forall(parts, known), F.lit(False))
    name = text_at(record, "$.payload.name")
    no_call = get(record, "$.payload.call_id").isNull() & kind_at(record, "$.payload.callId").isNull()
    return F.when((text_at(record, "$.payload.type") == "function_call_output") & no_call & (text.trim(name) != "") & shape, F.substring(name, 1, 1000))


def async_message(record: Column, limit: int = 16_000) -> Column:
    """Text of an asynchronous agent message from either envelope."""
    legacy = (text_at(record, "$.payload.type") == "agent_message") & (text_at(record, "$.payload.delivery") == "async")
    item = ((text_at(record, "$.payload.type") == "item_completed") & (text_at(record, "$.payload.item.type") == "AgentMessage")
            & (text_at(record, "$.payload.item.delivery") == "async"))
    parts = F.filter(get(record, "$.payload.item.content", "array<variant>"), lambda p: F.try_variant_get(p, "$.type", "string") == "Text")
    body = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
    return F.when(legacy, F.substring(text_at(record, "$.payload.message"), 1, limit)).when(item, F.substring(body, 1, limit))


def history_facts(record: Column) -> Column:
    """Settings and realtime history as a map of texts; transient realtime rows have none."""
    s = "$.payload.thread_settings"
    fields = ["model", "model_provider_id", "service_tier", "reasoning_effort", "reasoning_summary", "approvals_reviewer"]
    settings = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[get(record, f"{s}.{f}") for f in fields]))
    settings = F.map_filter(settings, lambda _, v: v.isNotNull() & (F.length(v) <= 1000))
    payload, kind = text_at(record, "$.payload.type"), text_at(record, "$.type")
    realtime = F.create_map(F.lit("item_id"), text_at(record, "$.payload.id"), F.lit("realtime_session_id"), text_at(record, "$.payload.realtime_session_id"))
    effort = F.create_map(F.lit("effort"), text_at(record, "$.payload.reasoning.effort"))
    return (F.when((payload == "thread_settings_applied") & (text_at(record, f"{s}.model") != ""), settings)
            .when((kind == "realtime_item") & (text_at(record, "$.payload.id") != "") & (text_at(record, "$.payload.realtime_session_id") != ""), realtime)
            .when((payload == "configuration_update") & (text_at(record, "$.payload.reasoning.effort") != ""), effort))


# --- commands ------------------------------------------------------------------------------------

_NATIVE = (r"^(?:Chunk ID: [A-Za-z0-9_-]{1,128}\n)?Wall time: ((?:0|[1-9]\d*)\.\d{4}) seconds\n"
           r"Process (running with session ID|exited with code) (-?(?:0|[1-9]\d*))\n(?:Original token count: (?:0|[1-9]\d*)\n)?Output:\n")
_PLAIN = r"^Exit code:\s*(-?\d+)\r?\nWall time:\s*([^\n]+)\r?\nOutput:\r?\n"


def command_output(value: Column) -> Column:
    """Exit code, process id, wall time and body of formatted command output. Only the head is evidence."""
    native, plain = value.rlike(_NATIVE), value.rlike(_PLAIN)
    number = F.regexp_extract(value, _NATIVE, 3).try_cast("int") if hasattr(value, "try_cast") else F.regexp_extract(value, _NATIVE, 3).cast("int")
    running = F.regexp_extract(value, _NATIVE, 2) == "running with session ID"
    head = F.when(native, F.length(F.regexp_extract(value, _NATIVE, 0))).otherwise(F.length(F.regexp_extract(value, _PLAIN, 0)))
    return F.when(native | plain, F.struct(
        F.when(native & ~running, number).when(plain, F.regexp_extract(value, _PLAIN, 1).try_cast("int")).alias("exit_code"),
        F.when(native & running, number).alias("process_id"),
        F.when(native, F.concat(F.regexp_extract(value, _NATIVE, 1), F.lit(" seconds"))).otherwise(F.regexp_extract(value, _PLAIN, 2)).alias("wall_time"),
        value.substr(head + 1, F.length(value)).alias("body")))


# What tells a command's language, in the order in which it decides: the program that runs, words of the
# command, or the session's shell when it runs one of the listed programs. No language means the program's own name.
EXTERNAL_PROGRAMS = "adb|bun|cargo|docker|gh|git|go|kubectl|node|npm|npx|pip|pip3|pnpm|pytest|python|python3|rg|uv|yarn"
COMMAND_RULES = [
    ("program", "powershell|pwsh", "powershell"),
    ("program", "cmd", "batch"),
    ("words", r"\bcmd(?:\.exe)?\s+/c\b", "batch"),
    ("program", "bash|sh|zsh|fish", None),
    ("words", r"\b(?:powershell|pwsh)(?:\.exe)?\b", "powershell"),
    ("words", " -command ", "powershell"),
    ("words", r"\b(?:get-content|set-content|select-object|where-object|start-process|invoke-webrequest|remove-item|copy-item|move-item)\b", "powershell"),
    ("shell", "powershell|pwsh", "powershell"),
]
FIRST_WORD = r"""^&?\s*(?:"([^"]+)|'([^']+)|([^\s|;&(){}]+))"""


def _program(path: Column) -> Column:
    """Name of a program without folders and suffix."""
    return F.regexp_extract(F.lower(F.coalesce(path, F.lit(""))), r"([^/\\]*?)(?:\.exe)?$", 1)


def command_language(command: Column, session_shell: Column) -> Column:
    """Language of the first rule that holds, else ``shell``."""
    words = F.trim(F.coalesce(command, F.lit("")))
    first = F.concat(*[F.regexp_extract(words, FIRST_WORD, i) for i in (1, 2, 3)])
    program, low = _program(F.regexp_replace(first, "[\"']", "")), F.lower(F.coalesce(command, F.lit("")))
    holds = {
        "program": lambda p: program.rlike(f"^(?:{p})$"),
        "words": lambda p: low.rlike(p),
        "shell": lambda p: _program(session_shell).rlike(f"^(?:{p})$") & program.rlike(f"^(?:{EXTERNAL_PROGRAMS})$"),
    }
    return F.coalesce(*[F.when(holds[where](pattern), program if name is None else F.lit(name)) for where, pattern, name in COMMAND_RULES], F.lit("shell"))


def background_request(arguments: Column) -> Column:
    """poll or input, and the process written to."""
    v = F.try_parse_json(arguments)
    chars, pid = kind_at(v, "$.chars"), get(v, "$.session_id", "int")
    fits = (F.substring(kind_at(v, "$"), 1, 6) == "OBJECT") & (chars.isNull() | (chars == "STRING"))
    return F.when(fits, F.struct(F.when(F.coalesce(get(v, "$.chars"), F.lit("")) == "", "poll").otherwise("input").alias("action"), pid.alias("process_id")))


def command_search_text(parts: Column) -> Column:
    """Parts joined in order, a part that the text already holds left out."""
    return F.aggregate(parts, F.lit(""), lambda acc, p: F.when((p == "") | F.contains(acc, p), acc).when(acc == "", p).otherwise(F.concat(acc, F.lit("\n"), p)))


# --- patches -------------------------------------------------------------------------------------

PATCH_HEADER = r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$"


def patch_files(value: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(PATCH_HEADER), F.lit(1)))


def status_files(value: Column) -> Column:
    """Files named by short version-control status lines."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"(?m)^[AMDR?]+\s+(.+)$"), F.lit(1)), F.trim))


def diff_stats(value: Column) -> Column:
    """Added and removed lines of a unified diff; file header lines before the first hunk do not count.

    The text is cut before its first hunk and each side is searched once, so the work grows with the length of the text.
    """
    sides = F.split(F.coalesce(value, F.lit("")), r"(?:\A|\n)@@", 2)
    head, hunks = F.get(sides, F.lit(0)), F.coalesce(F.get(sides, F.lit(1)), F.lit(""))

    def count(mark: str) -> Column:  # behind the cut the first line is the rest of a hunk header
        return (F.regexp_count(head, F.lit(rf"(?:\A|\n){mark}(?!{mark}{mark})")) + F.regexp_count(hunks, F.lit(rf"\n{mark}"))).cast("bigint")
    return F.struct(count(r"\+").alias("added"), count("-").alias("removed"))


def patch_success(status: Column, success: Column, exit_code: Column, outputs: list[Column]) -> Column:
    """Explicit status, then the flag, then the exit code, then phrases of the output; NULL when nothing tells."""
    state = F.lower(F.coalesce(status, F.lit("")))
    joined = [F.coalesce(o, F.lit("")) for o in outputs]

    def said(pattern: str) -> Column:
        cond = F.lit(False)
        for o in joined:
            cond = cond | F.trim(o).rlike(pattern)
        return cond
    return (F.when(state.isin("failed", "declined"), False).when(state == "success", True).when(state == "incomplete", F.lit(None))
            .when(success.isNotNull(), success).when(exit_code.isNotNull(), exit_code == 0)
            .when(said("(?i)apply_patch verification failed|failed to find expected lines|invalid patch|error:"), False)
            .when(said(r"(?i)success\. updated the following files|^done\b|patch applied"), True))


def edit_evidence(result: Column) -> Column:
    """Files of a recorded edit, all or nothing: one malformed file or hunk voids the evidence."""
    files = get(result, "$.bashEditDiff.files", "array<struct<path:string,hunks:array<struct<lines:array<string>>>>>")
    good = F.forall(files, lambda f: (F.coalesce(f["path"], F.lit("")) != "") & (F.size(f["hunks"]) > 0)
                    & F.forall(f["hunks"], lambda h: F.size(h["lines"]) > 0))
    return F.when((F.size(files) > 0) & F.coalesce(good, F.lit(False)), F.transform(files, lambda f: f["path"]))


# --- messages and notifications --------------------------------------------------------------------

NOTIFICATION_TAGS = ["task-id", "tool-use-id", "output-file", "status", "summary", "result", "recovery", "usage"]
NOTIFICATION_STATES = ["completed", "success", "failed", "error", "declined", "cancelled", "canceled", "stopped"]


def task_notification(value: Column) -> Column:
    """A task notification in its strict form, NULL when any tag is repeated, unclosed or malformed."""
    body = text.trim(value)
    framed = (F.startswith(body, F.lit("<task-notification>")) & F.endswith(body, F.lit("</task-notification>"))
              & (F.regexp_count(body, F.lit("<task-notification>")) == 1) & (F.regexp_count(body, F.lit("</task-notification>")) == 1))
    for tag in NOTIFICATION_TAGS:
        opens, closes = F.regexp_count(body, F.lit(f"<{tag}>")), F.regexp_count(body, F.lit(f"</{tag}>"))
        framed = framed & (opens == closes) & (opens <= 1)

    def tag_text(tag: str) -> Column:
        return text.trim(F.regexp_extract(body, f"(?s)<{tag}>(.*?)</{tag}>", 1))
    ident = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,255}$"
    status, summary = F.lower(tag_text("status")), tag_text("summary")
    valid = framed & tag_text("task-id").rlike(ident) & tag_text("tool-use-id").rlike(ident) & status.isin(NOTIFICATION_STATES) & F.length(summary).between(1, 4000)
    code = F.regexp_extract(summary, r"(?i)\(exit code (-?\d+)\)\s*$", 1).try_cast("bigint")
    usage = F.regexp_extract(tag_text("usage"), "<total_tokens>(\\d+)</total_tokens>", 1).try_cast("bigint")
    return F.when(valid, F.struct(
        tag_text("task-id").alias("task_id"), tag_text("tool-use-id").alias("call_id"), status.alias("status"), summary.alias("summary"),
        F.substring(tag_text("result"), 1, 16_000).alias("result"), code.alias("exit_code"), usage.alias("total_tokens")))


def is_command_envelope(value: Column) -> Column:
    """A message that is nothing but local command or slash command tags."""
    body = text.trim(F.coalesce(value, F.lit("")))
    local = body.rlike(r"(?s)^<local-command-([a-z][a-z-]*)>.*</local-command-\1>$")
    one = r"\s*<(command-name|command-message|command-args)>[^<>]*</\1>\s*"
    tags = F.regexp_extract_all(body, F.lit(one), F.lit(1))
    slash = (F.regexp_replace(body, one, "") == "") & (F.size(tags) == F.size(F.array_distinct(tags))) & F.regexp_extract(
        body, r"<command-name>\s*(/[A-Za-z0-9][A-Za-z0-9._:-]*)\s*</command-name>", 1).rlike("^/")
    return local | slash


def is_human(record_type: Column, is_meta: Column, is_summary: Column, origin: Column, has_result: Column, body: Column) -> Column:
    """A message a person wrote: no meta row, summary, notification, tool result or command envelope."""
    return ((record_type == "user") & ~F.coalesce(is_meta, F.lit(False)) & ~F.coalesce(is_summary, F.lit(False))
            & (F.coalesce(origin, F.lit("")) != "task-notification") & ~has_result & ~is_command_envelope(body) & (text.trim(body) != ""))


def permission_change(event_type: Column, data: Column) -> Column:
    """(field, value) of a permission change, NULL when its payload has any other key."""
    def read(kind: str, key: str) -> Column:
        value = F.get_json_object(data, f"$.{key}")
        return F.when((event_type == kind) & has_only_keys(data, [key]) & (F.coalesce(value, F.lit("")) != ""),
                      F.struct(F.lit(key).alias("field"), value.alias("value")))
    return F.coalesce(read("permission/preset", "preset"), read("sandbox/mode", "mode"), read("approval/policy", "policy"))


TODO_STATES = ["pending", "in_progress", "completed"]


def todo_snapshot(data: Column) -> Column:
    """Items of a todo list, NULL unless every item has content, an allowed status and content of its own."""
    items = F.from_json(F.get_json_object(data, "$.todos"), "array<struct<content:string,status:string>>")
    good = F.forall(items, lambda t: (F.coalesce(text.trim(t["content"]), F.lit("")) != "") & F.coalesce(t["status"].isin(TODO_STATES), F.lit(False)))
    distinct = F.size(F.array_distinct(F.transform(items, lambda t: t["content"]))) == F.size(items)
    return F.when(has_only_keys(data, ["todos"]) & F.coalesce(good, F.lit(False)) & distinct, items)


def retry_facts(data: Column) -> Column:
    """Facts of a scheduled retry, NULL when a required one is missing or out of range."""
    f = F.from_json(data, "retryId string, turn bigint, step bigint, provider string, mode string, policyKey string, retry bigint, maxRetries bigint, delayMs bigint")
    mode_ok = (f["mode"] == "always") | ((f["mode"] == "normal") & f["maxRetries"].isNotNull() & (f["retry"] <= f["maxRetries"]))
    valid = (f["retryId"] != "") & (f["retry"] >= 1) & (f["delayMs"] >= 0) & (f["provider"] != "") & f["turn"].isNotNull() & f["step"].isNotNull() & mode_ok
    return F.when(F.coalesce(valid, F.lit(False)), f)


def approval_asked(data: Column) -> Column:
    f = F.from_json(data, "requestId string, toolName string, callId string, reason string")
    return F.when(has_only_keys(data, ["requestId", "toolName"], ["callId", "reason"]) & (f["requestId"] != "") & (f["toolName"] != ""), f)


def command_run(data: Column) -> Column:
    f = F.from_json(data, "commandId string, name string, args string, source struct<kind:string>")
    return F.when(has_only_keys(data, ["commandId", "name", "source"], ["args"]) & (f["source"]["kind"] == "user") & f["name"].rlike("^[a-z][a-z0-9_-]*$"), f)


def subagent_descriptor(data: Column, versions: tuple[int, ...] = (1, 2)) -> Column:
    f = F.from_json(data, "version int, id string, label string, preset string")
    return F.when(f["version"].isin(*versions) & (F.coalesce(f["id"], F.lit("")) != ""), f)


def analyzer_id(kind: str, *parts: Column) -> Column:
    """Composite session id; each part is percent-encoded so that the separator stays unambiguous."""
    encoded = [F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")) for p in parts]
    return F.concat_ws(":", F.lit(kind), *encoded)


def goal_status(value: Column) -> Column:
    """Status in snake case; three spellings are folded into their usual form."""
    words = F.regexp_replace(F.regexp_replace(text.trim(F.coalesce(value, F.lit(""))), "([a-z0-9])([A-Z])", "$1_$2"), r"[\s-]+", "_")
    low = F.lower(words)
    return (F.when(low == "budgetlimited", "budget_limited").when(low == "usagelimited", "usage_limited").when(low == "completed", "complete").otherwise(low))


# --- embedded images ---------------------------------------------------------------------------

def image_refs(value: Column) -> Column:
    """Embedded images: type by their first bytes, size of the payload."""
    urls = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"data:image/[a-z0-9.+-]+;base64,([A-Za-z0-9+/]+={0,2})"), F.lit(1))

    def describe(payload: Column) -> Column:
        head = F.substring(payload, 1, 8)
        mime = (F.when(F.startswith(head, F.lit("iVBORw0K")), "image/png").when(F.startswith(head, F.lit("/9j/")), "image/jpeg")
                .when(F.startswith(head, F.lit("R0lGOD")), "image/gif").when(F.startswith(head, F.lit("UklGR")), "image/webp").otherwise("application/octet-stream"))
        padding = F.length(payload) - F.length(F.rtrim(payload, F.lit("=")))
        return F.struct(mime.alias("mime"), (F.floor(F.length(payload) * 3 / 4) - padding).alias("bytes"), F.sha2(payload, 256).alias("identity"))
    return F.transform(urls, describe)
