import json

import pytest
from pyspark.sql import functions as F

from skeinlog.sources import claude, codex, deepseek, files, registry, sinks
from skeinlog.functions import classify


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)


def test_line_numbers_blank_lines_and_torn_tail(spark, tmp_path):
    write(tmp_path / "a" / "one.jsonl", '{"n":1}\n\n{"n":3}\r\n{"n":')
    write(tmp_path / "b" / "two.jsonl", '{"n":1}\n')
    lines = files.read_lines(spark, str(tmp_path))
    got = {(r.file.rsplit("/", 1)[1], r.line): (r.text, r.torn) for r in lines.collect()}
    assert got == {("one.jsonl", 1): ('{"n":1}', False), ("one.jsonl", 2): ("", False), ("one.jsonl", 3): ('{"n":3}', False),
                   ("one.jsonl", 4): ('{"n":', True), ("two.jsonl", 1): ('{"n":1}', False)}
    assert files.committed(lines).count() == 4
    assert files.parsed(files.committed(lines)).count() == 3


def test_lines_of_a_file_cut_into_many_splits(spark, tmp_path):
    body = "".join(json.dumps({"n": i, "pad": "x" * (i % 50)}) + "\n" for i in range(1, 2001))
    write(tmp_path / "big.jsonl", body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = files.read_lines(spark, str(tmp_path)).select("line", F.get_json_object("text", "$.n").cast("bigint").alias("n"), "torn").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 2000 and all(r.line == r.n and not r.torn for r in rows)


def test_compressed_lines_and_plain_wins(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    write(tmp_path / "s.jsonl.zst", zstandard.compress(b'{"n":1}\n{"n":2}') + zstandard.compress(b'\n{"n":3}\n'))
    write(tmp_path / "t.jsonl", "{}\n")
    write(tmp_path / "t.jsonl.zst", zstandard.compress(b"{}\n"))
    listed = {r.logical_path.rsplit("/", 1)[1]: r.compressed for r in files.list_artifacts(spark, str(tmp_path)).collect()}
    assert listed == {"s.jsonl": True, "t.jsonl": False}
    got = files.read_compressed_lines(spark, str(tmp_path), "s.jsonl.zst").orderBy("line").collect()
    assert [(r.line, r.text, r.torn) for r in got] == [(1, '{"n":1}', False), (2, '{"n":2}', False), (3, '{"n":3}', False)]


def test_rollout_rows_and_events(spark):
    records = [
        {"timestamp": "2026-01-01T00:00:00Z", "type": "event_msg", "payload": {"type": "user_message", "message": "hello"}},
        {"timestamp": "2026-01-01T00:00:01Z", "type": "response_item", "payload": {"type": "function_call", "call_id": "c1", "name": "exec_command", "arguments": "{}"}},
        {"timestamp": "bad", "type": "event_msg", "payload": {"type": "exec_command_end", "call_id": "c1", "exit_code": 2, "duration": {"secs": 1, "nanos": 5000000}}},
        {"type": "event_msg", "payload": {"type": "something_new"}},
    ]
    lines = spark.createDataFrame([("s", "f", i, json.dumps(r)) for i, r in enumerate(records, 1)] + [("s", "f", 9, "{oops")], "session_id string, file string, line bigint, text string")
    parsed = files.parsed(lines)
    raw = codex.to_raw(parsed)
    by_line = {r.line: r for r in raw.collect()}
    assert sorted(by_line) == [1, 2, 3, 4]
    assert by_line[1].message_text == "hello" and by_line[1].ts_text == "2026-01-01T00:00:00.000Z"
    assert by_line[3].exit_code == 2 and by_line[3].duration_ms == 1005 and by_line[3].ts_text == ""
    events = {r.line: r for r in codex.to_logical(raw, classify.tool_dimension(spark)).collect()}
    assert (events[1].kind, events[2].kind, events[2].status, events[2].severity) == ("user_message", "command", "failed", "error")
    assert events[4].layer == "protocol" and 3 not in events
    assert [r.code for r in files.read_errors(parsed).collect()] == ["malformed_json"]


def test_malformed_block_line_stays_visible(spark):
    good = {"type": "assistant", "uuid": "u", "message": {"id": "m", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"a": 1}}]}}
    plain = {"type": "user", "message": {"role": "user", "content": "plain words"}}
    lines = spark.createDataFrame([("s", "f", 1, json.dumps(good)), ("s", "f", 2, "{broken"), ("s", "f", 3, json.dumps(plain))], "session_id string, file string, line bigint, text string")
    rows = {r.line: r for r in claude.to_raw(files.parsed(lines)).collect()}
    assert rows[2].record_type == "malformed" and rows[2].preview == "{broken"
    assert rows[1].tool_calls[0].id == "t" and rows[1].tool_calls[0].block == 1 and rows[3].message_text == "plain words"


def test_packed_rows(spark):
    good = {"type": "text-chunks", "seq0": 5, "time0": 100, "data": {"turn": 1, "step": 1, "index": 0, "dt": [3, 4], "texts": ["a", "b", "c"]}}
    bad = {**good, "data": {**good["data"], "dt": [3]}}
    lines = spark.createDataFrame([("f", 1, json.dumps(good)), ("f", 2, json.dumps(bad))], "file string, line bigint, text string")
    parsed = files.parsed(lines)
    assert [(r.seq, r.time, r.text) for r in files.packed_members(parsed).orderBy("seq").collect()] == [(5, 100, "a"), (6, 103, "b"), (7, 107, "c")]
    assert [r.line for r in files.packed_errors(parsed).collect()] == [2]


def test_header_versions(spark):
    heads = [{"type": "session", "version": v, "id": f"s{v}", "createdAt": 1, "cwd": "/w"} for v in (0, 4, 9)]
    lines = spark.createDataFrame([(f"f{i}", 1, json.dumps(h)) for i, h in enumerate(heads)], "file string, line bigint, text string")
    head = deepseek.headers(files.parsed(lines))
    assert {r.session_id: r.supported for r in head.collect()} == {"s0": True, "s4": True, "s9": False}
    assert [r.code for r in deepseek.unsupported(head).collect()] == ["unsupported_version"]


def test_digests_notice_order_and_change(spark):
    lines = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "y"), ("c", 2, "x"), ("d", 1, "x")]
    got = {r.file: r.file_digest for r in files.file_digests(spark.createDataFrame(lines, "file string, line bigint, text string")).collect()}
    assert got["a"] == got["b"] and len({got[f] for f in "acd"}) == 3


def test_projection_scan_prunes(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 7).cast("string").alias("session_id"), F.col("id").alias("line"), F.when(F.col("id") % 2 == 0, "main").otherwise("protocol").alias("layer"), F.lit("t").alias("search_text"))
    sinks.write_projection(rows, str(tmp_path / "p"))
    scan = sinks.scan_projection(spark, str(tmp_path / "p"), "main", "3", ["line"])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "EqualTo(session_id,3)" in plan and "search_text" not in plan.split("ReadSchema")[1]
    assert scan.count() == sum(1 for i in range(500) if i % 2 == 0 and i % 7 == 3)


def test_registry_refuses_unknown_and_repeated_kinds(spark):
    with pytest.raises(KeyError):
        registry.get("nope")
    with pytest.raises(ValueError):
        registry.register(registry.get("codex"))


def test_only_whole_frames_of_compressed_files_count(spark, tmp_path):
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "good.jsonl.zst").write_bytes(pack(b'{"n":1}\n{"n"') + pack(b':2}\r\n{"n":3}\n{"n":'))
    whole = pack(b"".join(b'{"n":%d}\n' % i for i in range(5000)))
    (tmp_path / "cut.jsonl.zst").write_bytes(pack(b'{"n":7}\n') + whole[:len(whole) // 2])
    (tmp_path / "broken.jsonl.zst").write_bytes(pack(b'{"n":8}\n') + b"not a frame")
    got = {(r.file.rpartition("/")[2], r.line): (r.text, r.torn) for r in files.read_compressed_lines(spark, str(tmp_path)).collect()}
    assert got == {("good.jsonl.zst", 1): ('{"n":1}', False), ("good.jsonl.zst", 2): ('{"n":2}', False), ("good.jsonl.zst", 3): ('{"n":3}', False),
                   ("good.jsonl.zst", 4): ('{"n":', True), ("cut.jsonl.zst", 1): ('{"n":7}', False), ("broken.jsonl.zst", 1): ('{"n":8}', False)}
    assert sorted((r.file.rpartition("/")[2], r.line) for r in files.compressed_errors(spark, str(tmp_path)).collect()) == [("broken.jsonl.zst", 2), ("cut.jsonl.zst", 2)]


def test_a_transcript_with_both_copies_is_read_once(spark, tmp_path):
    import zstandard

    (tmp_path / "a.jsonl").write_text('{"n":1}\n')
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress(b'{"n":100}\n'))
    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.compress(b'{"n":2}\n'))
    got = sorted((r.file.rpartition("/")[2], r.line, r.text) for r in files.read_transcripts(spark, str(tmp_path)).collect())
    assert got == [("a.jsonl", 1, '{"n":1}'), ("b.jsonl.zst", 1, '{"n":2}')]
