import json
from collections import Counter

import duckdb

from given import ROOT
from skeinlog.plans import load_catalogue
from skeinlog.plans.record_queries import codex_lines


def plain_walk(value):
    if isinstance(value, dict):
        return [leaf for item in value.values() for leaf in plain_walk(item)]
    if isinstance(value, list):
        return [leaf for item in value for leaf in plain_walk(item)]
    if value is None or value == "":
        return []
    return [f"{value:g}" if isinstance(value, float) else str(value)]


def plain_text(line):
    try:
        payload = json.loads(line)["payload"]
    except ValueError:
        return None
    if payload["type"] == "user_message":
        return payload["message"]
    if payload["type"] == "message":
        return "\n".join(block["text"] for block in payload["content"])
    return "\n".join(plain_walk(payload))


def test_every_readable_line_is_walked(spark):
    lines = {f"{r.session_id}:raw:{r.line}": (json.loads(r.text)["payload"]["type"], plain_text(r.text))
             for r in codex_lines(spark, ROOT).collect() if plain_text(r.text) is not None}
    query = load_catalogue()["prj_24_full_search_text"]
    rows = [tuple(r) for r in query.build(spark, ROOT).select("raw_id", "search_text").collect()]
    assert sorted(rows) == sorted((raw_id, text) for raw_id, (_, text) in lines.items())
    walked = Counter(lines[raw_id][0] for raw_id, _ in rows)
    assert walked["token_count"] and walked["exec_command_end"] and walked["item_completed"]

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{ROOT}/events.parquet'")
    assert sorted(rows) == sorted(con.execute(query.sql).fetchall())
