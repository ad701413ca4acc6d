import random

from skeinlog.operators import claims
from skeinlog.sources import claude, deepseek, files, registry

UNITS = "session_id string, line long, block int, kind string"
CLAIMS = "session_id string, line long, block int, event_id string, kind string, priority int, lead boolean"


def plain(units, stated):
    """Each unit's winner by a loop; events that lose their lead do not happen."""
    won = {}
    for s, line, block, event, kind, priority, lead in stated:
        best = (priority, event, lead, kind)
        won[s, line, block] = min(won.get((s, line, block), best), best)
    happens = {(s, w[1]) for (s, _, _), w in won.items() if w[2]}
    out = []
    for s, line, block, kind in units:
        w = won.get((s, line, block))
        held = w is not None and (s, w[1]) in happens
        out.append((s, line, block, w[1] if held else f"event:{line}:{block}", w[3] if held else kind, "own" if not held else "lead" if w[2] else "member"))
    return sorted(out)


def test_every_unit_is_in_one_event(spark):
    rng = random.Random(11)
    units = [(s, line, block, rng.choice(["protocol", "user_message"])) for s in "ab" for line in range(40) for block in range(-1, 2)]
    stated = []
    for i in range(60):
        s, lead = rng.choice("ab"), rng.randrange(40)
        wants = {(lead, 0)} | {(rng.randrange(40), rng.randrange(-1, 2)) for _ in range(rng.randrange(4))}
        priority = rng.randrange(3)
        stated += [(s, line, block, f"x{i:02}", f"kind{i % 3}", priority, (line, block) == (lead, 0)) for line, block in wants]
    got = claims.resolved(spark.createDataFrame(units, UNITS), spark.createDataFrame(stated, CLAIMS))
    rows = sorted((r.session_id, r.line, r.block, r.event_id, r.kind, r.part) for r in got.collect())
    assert rows == plain(units, stated) and {r[5] for r in rows} == {"own", "lead", "member"}
    made = claims.events(got).collect()
    assert sum(r.units for r in made) == len(units) and len(made) == len({(r[0], r[3]) for r in rows})
    assert all((r.layer == "protocol") == (r.kind == "protocol") for r in made)


def test_lost_lead_gives_the_other_rows_back(spark):
    units = [("s", n, -1, "protocol") for n in range(1, 5)]
    stated = [("s", 1, -1, "first", "a", 1, True), ("s", 2, -1, "first", "a", 1, False), ("s", 2, -1, "second", "b", 2, True), ("s", 3, -1, "second", "b", 2, False)]
    got = claims.resolved(spark.createDataFrame(units, UNITS), spark.createDataFrame(stated, CLAIMS)).orderBy("line").collect()
    assert [(r.event_id, r.kind, r.part) for r in got] == [("first", "a", "lead"), ("first", "a", "member"), ("event:3:-1", "protocol", "own"), ("event:4:-1", "protocol", "own")]
    alone = claims.resolved(spark.createDataFrame(units, UNITS), spark.createDataFrame([], CLAIMS))
    assert {r.part for r in alone.collect()} == {"own"} and claims.resolved(spark.createDataFrame([], UNITS), spark.createDataFrame(stated, CLAIMS)).count() == 0


def lines(spark, *texts):
    rows = [("s", "f.jsonl", n, t) for n, t in enumerate(texts, 1)]
    return files.parsed(spark.createDataFrame(rows, "session_id string, file string, line long, text string"))


def test_block_family_shapes(spark):
    got = claude.to_logical(lines(
        spark, '{"type":"user","message":{"content":"plain words"}}', '{"type":"assistant","message":{"content":[{"type":"text","text":" \\n"}]}}',
        '{"type":"assistant","message":{"content":[{"type":"tool_use","id":"a","name":"Bash"},{"type":"tool_use","id":"b","name":"Bash"},{"type":"tool_use","id":"b","name":"Bash"},{"type":"image"}]}}',
        '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"a"},{"type":"tool_result","tool_use_id":"b"},{"type":"text","text":"beside"}]}}',
        '{"type":"user","origin":{"kind":"task-notification"},"message":{"content":"told"}}', '{"type":"assistant","message":{}}', "{", '{"type":"progress"}'))
    assert [(r.line, r.block, r.event_id, r.kind) for r in got.orderBy("line", "block").collect()] == [
        (1, 0, "event:1:0", "user_message"), (3, 0, "event:3:0", "tool_call"), (3, 1, "event:3:1", "protocol"), (3, 2, "event:3:2", "protocol"), (3, 3, "event:3:3", "protocol"),
        (4, 0, "event:3:0", "tool_call"), (4, 1, "event:4:1", "protocol"), (4, 2, "event:4:2", "protocol"), (5, -1, "event:5:-1", "protocol"), (6, -1, "event:6:-1", "protocol"),
        (7, -1, "event:7:-1", "protocol"), (8, -1, "event:8:-1", "protocol")]


def test_log_family_steps_and_versions(spark):
    def record(kind, data="{}", **more):
        extra = "".join(f',"{k}":{v}' for k, v in more.items())
        return f'{{"type":"{kind}","data":{data}{extra}}}'
    body = [record("assistant/chunk", '{"turn":1,"step":1}'), record("assistant/chunk", '{"turn":1,"step":1}'), record("assistant/message", '{"turn":1,"step":1}'),
            record("assistant/chunk", '{"turn":1,"step":2}'), record("assistant/chunk", '{"turn":1,"step":2}'), record("tool/result", '{"callId":"x"}'), record("tool/call", '{"callId":"x"}')]
    got = deepseek.to_logical(lines(spark, '{"type":"session","version":4,"id":"s"}', *body)).orderBy("line").collect()
    assert [(r.line, r.event_id, r.kind) for r in got] == [
        (1, "event:1:-1", "protocol"), (2, "event:4:-1", "assistant_message"), (3, "event:4:-1", "assistant_message"), (4, "event:4:-1", "assistant_message"),
        (5, "event:5:-1", "partial_message"), (6, "event:5:-1", "partial_message"), (7, "event:7:-1", "tool_call"), (8, "event:8:-1", "tool_call")]
    assert deepseek.to_logical(lines(spark, '{"type":"session","version":9,"id":"s"}', *body)).count() == 0
    made = registry.logical_events("deepseek", lines(spark, '{"type":"session","version":4,"id":"s"}', *body))
    assert {(r.line, r.kind, r.units) for r in made.collect()} == {(1, "protocol", 1), (2, "assistant_message", 3), (5, "partial_message", 2), (7, "tool_call", 1), (8, "tool_call", 1)}
