"""Canonical event tables derived from the given tables.

The given tables hold no transcripts, so fixed column expressions give each one a role. Every
expression below is plain SQL that both Spark and the checking engine read the same way; the check
SQL of a query starts from the same binding and then restates the operator on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.session import table

# name -> expression over (event_id, user_id, event_type, value, k, ts_iso, ts_iso_back)
_EVENT_COLUMNS: dict[str, str] = {
    "session_id": "CAST(user_id AS STRING)",
    "line": "event_id",
    "event_id": "concat('e', CAST(event_id AS STRING))",
    "k": "k",
    "ts_text": "CASE WHEN k = 77 THEN '' WHEN k % 23 = 0 THEN ts_iso_back ELSE ts_iso END",
    "turn_id": "CASE WHEN k % 9 = 0 THEN '' ELSE concat('t', CAST(CAST(floor(event_id / 2500) AS BIGINT) AS STRING)) END",
    "layer": "CASE WHEN event_type = 'purchase' THEN 'protocol' ELSE 'main' END",
    "kind": """CASE event_type WHEN 'purchase' THEN 'token_count' WHEN 'error' THEN 'error'
        WHEN 'signup' THEN 'user_message'
        WHEN 'view' THEN (CASE WHEN k % 25 = 0 THEN 'compaction' WHEN k % 8 = 3 THEN 'reasoning'
                               WHEN k % 31 = 7 THEN 'proposed_plan' ELSE 'assistant_message' END)
        ELSE (CASE k % 6 WHEN 0 THEN 'command' WHEN 1 THEN 'command' WHEN 2 THEN 'patch' WHEN 3 THEN 'mcp_call'
                         WHEN 4 THEN 'other_tool_call' ELSE 'web_search' END) END""",
    "subtype": """CASE event_type WHEN 'purchase' THEN (CASE WHEN k % 10 = 9 THEN '' ELSE 'token_count' END)
        WHEN 'view' THEN (CASE WHEN k % 25 = 0 THEN 'context_compacted' WHEN k % 8 = 3 THEN 'reasoning'
                               WHEN k % 31 = 7 THEN 'proposed_plan' ELSE 'assistant_message' END)
        WHEN 'click' THEN (CASE WHEN k % 6 = 4 THEN (CASE WHEN k % 4 = 0 THEN 'update_plan' ELSE 'request_user_input' END)
                                ELSE '' END)
        ELSE '' END""",
    "role": "CASE event_type WHEN 'signup' THEN 'user' WHEN 'view' THEN 'assistant' ELSE '' END",
    "tool_name": """CASE WHEN event_type <> 'click' THEN ''
        ELSE (CASE k % 6 WHEN 0 THEN 'exec_command' WHEN 1 THEN 'shell_command' WHEN 2 THEN 'apply_patch'
                         WHEN 3 THEN concat('mcp__srv__T', CAST(k % 4 AS STRING))
                         WHEN 4 THEN (CASE WHEN k % 4 = 0 THEN 'update_plan' ELSE 'request_user_input' END)
                         ELSE 'web_search' END) END""",
    "status": """CASE WHEN event_type = 'error' THEN 'failed'
        WHEN event_type = 'click' THEN (CASE WHEN k % 7 = 0 THEN 'failed' WHEN k % 13 = 0 THEN 'declined' ELSE 'success' END)
        ELSE '' END""",
    "severity": "CASE WHEN event_type = 'error' THEN 'error' WHEN k % 11 = 0 THEN 'warning' ELSE 'normal' END",
    "file_a": """CASE WHEN event_type <> 'click' THEN ''
        WHEN k % 6 = 2 THEN concat('src/f', CAST(k % 17 AS STRING), '.py')
        WHEN k % 6 = 0 THEN concat('lib\\\\F', CAST(k % 13 AS STRING), '.TS') ELSE '' END""",
    "file_b": """CASE WHEN event_type = 'click' AND k % 6 = 2 AND k % 4 = 0
        THEN concat('./src/g', CAST(k % 5 AS STRING), '.py') ELSE '' END""",
    "duration_ms": "CAST(floor(value * 1000) AS BIGINT)",
    "exit_code": "CASE WHEN event_type = 'click' AND k % 6 IN (0, 1) THEN (CASE WHEN k % 7 = 0 THEN k % 3 + 1 ELSE 0 END) END",
    "model": "CASE WHEN k % 12 = 0 THEN concat('m', CAST(k % 3 + CAST(floor(event_id / 4000) AS BIGINT) AS STRING)) ELSE '' END",
    "input_tokens": "CASE WHEN event_type = 'purchase' AND k <> 33 THEN CAST(floor(value * 1000) AS BIGINT) END",
    "cached_tokens": """CASE WHEN event_type = 'purchase' AND k <> 34
        THEN CAST(floor(floor(value * 1000) * (CASE WHEN k > 55 THEN 90 ELSE k END) / 100) AS BIGINT)
             + (CASE WHEN k = 35 THEN 900000 ELSE 0 END) END""",
    "preview": """concat(event_type, ' alpha', CAST(k % 10 AS STRING), '  Beta ', CAST(event_id AS STRING),
        CASE WHEN k % 4 = 1 THEN ' alpha1 beta' ELSE '' END)""",
    "search_text": """concat('run ', event_type, ' k=', CAST(k AS STRING), ' Alpha', CAST(k % 10 AS STRING), chr(10), 'beta tail alpha',
        CAST(k % 10 AS STRING), ' ', repeat('lorem ipsum ', CAST(k AS INT)), 'needle', CAST(k % 5 AS STRING), repeat(' dolor', CAST(k AS INT)))""",
}


def _event_select(dialect: str) -> str:
    columns = []
    for name, expr in _EVENT_COLUMNS.items():
        if dialect == "duckdb":
            expr = expr.replace("'lib\\\\F'", "'lib\\F'").replace("AS STRING", "AS VARCHAR")
        columns.append(f"{expr} AS {name}")
    return ",\n  ".join(columns)


EVENTS_SQL = f"""ev AS (SELECT
  {_event_select('duckdb')}
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts_iso,
        strftime(ts - INTERVAL 2 DAY, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts_iso_back
      FROM events))"""

CONVERSATIONS_SQL = """cv AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS line,
  concat('c', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS event_id,
  CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'developer_message' END AS kind,
  role, text FROM conversations)"""


def with_events(body: str) -> str:
    return f"WITH {EVENTS_SQL}{_glue(body)}"


def with_conversations(body: str) -> str:
    return f"WITH {CONVERSATIONS_SQL}{_glue(body)}"


def with_both(body: str) -> str:
    return f"WITH {EVENTS_SQL},\n{CONVERSATIONS_SQL}{_glue(body)}"


def _glue(body: str) -> str:
    body = body.strip()
    return f",\n{body[5:].lstrip()}" if body.upper().startswith("WITH ") else f"\n{body}"


def events(spark: SparkSession, root: str) -> DataFrame:
    return bound_events(table(spark, root, "events"))


def bound_events(raw: DataFrame) -> DataFrame:
    """Logical events of the events table, batch or stream. Row-local, so filters and pruning reach the scan."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    base = raw.withColumns({
        "k": F.get_json_object("props", "$.k").cast("bigint"),
        "ts_iso": F.date_format("ts", iso),
        "ts_iso_back": F.date_format(F.expr("ts - INTERVAL 2 DAYS"), iso),
    })
    return (
        base.selectExpr(*[f"{expr} AS {name}" for name, expr in _EVENT_COLUMNS.items()])
        .withColumn("touched_files", F.filter(F.array("file_a", "file_b"), lambda f: f != ""))
    )


def conversations(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("line"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("event_id"),
        F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "assistant_message")
        .otherwise("developer_message").alias("kind"),
        "role",
        "text",
    )
