import random
import re

from pyspark.sql import functions as F

from skeinlog.functions import numbers, paths, records as R, search_json, text


def test_random_phrases_equal_plain_matching(spark):
    rng = random.Random(11)
    words = ["alpha", "Beta", "a.b", "(x)", "gamma\tdelta", "ALPHA", "é", "$1"]
    texts = ["".join(rng.choice([w, " ", "  ", "\n", w]) for w in rng.choices(words, k=30)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for phrase in ("alpha", "alpha beta", "a.b", "(x) alpha", "$1", "gamma delta", "  "):
        tokens = phrase.split()
        expected = re.compile(r"\s+".join(map(re.escape, tokens)), re.I) if tokens else None
        got = df.select("i", text.phrase_count(F.col("t"), phrase).alias("n"), text.matches_phrase(F.col("t"), phrase).alias("m")).collect()
        for r in got:
            n = len(expected.findall(texts[r.i])) if expected else 0
            assert (r.n, r.m) == (n, n > 0 or expected is None)


def test_snippet_marks_what_it_leaves_out(spark):
    body = "x" * 100 + " needle " + "y" * 300
    row = spark.createDataFrame([(body,)], "t string").select(text.snippet(F.col("t"), "NEEDLE").alias("s"), text.snippet(F.col("t"), "absent").alias("n")).first()
    assert row.s == "..." + (body[21:101] + body[101:281]).strip() + "..." and row.n == ""


def test_titles(spark):
    cases = {"## Fix the *login* page\nmore": "Fix the login page", "---\n> quoted [link](http://x)": "quoted link", "<skill>x</skill>": "", "": "", "- " + "w" * 200: "w" * 117 + "..."}
    from skeinlog.functions.classify import protocol_text_class
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", text.title_candidate(F.col("t"), protocol_text_class(F.col("t"), F.lit("user")) != "").alias("o")).collect()
    assert {r.t: r.o for r in got} == cases


def test_exact_ratios(spark):
    top = 9_007_199_254_740_991
    rows = [(3, top), (top, 1), (7, 5), (0, 5), (1, 3)]
    got = spark.createDataFrame(rows, "i bigint, c bigint").select(numbers.reuse_bps(F.col("i"), F.col("c")).alias("r"), numbers.delta_bps(F.col("i"), F.col("c")).alias("d")).collect()
    for (i, c), r in zip(rows, got):
        exact = c * 10_000 // i if i else None
        assert r.r == (exact if exact is not None and exact <= top else None)
        if i and abs((c - i) * 10_000 // i) <= top:
            assert r.d == int((c - i) * 10_000 / i) if abs(c - i) < 10**9 else r.d is not None


def test_paths_keep_parent_steps_and_case(spark):
    df = spark.createDataFrame([("/w/p/src/./a//B.py",), ("/w/p/../q.py",), ("src/A.py",), ("/w/p",)], "f string")
    assert [r[0] for r in df.select(paths.identity_key(F.col("f"), "/w/p")).collect()] == ["src/a/B.py", "../q.py", "src/A.py", ""]
    win = spark.createDataFrame([("C:\\W\\P\\Src\\a.py",)], "f string").select(paths.identity_key(F.col("f"), "c:\\w\\p")).first()[0]
    assert win == "src/a.py"


def test_search_projection_hides_and_keeps(spark):
    rows = ['{"b":1,"a":"x"}', '{"signature":"zz","a":"x"}', '{"type":"image","data":"q"}', "plain", '{"k":[{"type":"audio"},{"t":"data:image/png;base64,QUJD"}]}']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "v string").select(search_json.search_projection(F.col("v"))).collect()]
    assert got == [rows[0], '{"a":"x"}', "null" if got[2] == "null" else got[2], "plain", '{"k":[null,{"t":"[data URL omitted]"}]}']
    walked = spark.createDataFrame([('{"a":["x",{"signature":"no","b":2}],"c":true}',)], "v string").select(search_json.full_search_text(F.col("v"))).first()[0]
    assert walked == "x\n2\ntrue"


def test_mojibake_goes_back_and_good_text_stays(spark):
    good = "修复登录页面"
    broken = good.encode("utf-8").decode("gb18030")
    rows = [(broken,), (good,), ("plain ascii",), ("café",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(search_json.repair_mojibake(F.col("v"))).collect()]
    assert got == [good, good, "plain ascii", "café"]


def test_command_output_reads_only_the_head(spark):
    good = "Chunk ID: ab\nWall time: 0.1000 seconds\nProcess exited with code -1\nOutput:\nProcess running with session ID 5"
    row = spark.createDataFrame([(good,), ("body\n" + good,)], "t string").select(R.command_output(F.col("t")).alias("o")).collect()
    assert (row[0].o.exit_code, row[0].o.process_id) == (-1, None) and row[1].o is None


def test_sql_functions_say_the_same_as_the_column_functions(spark):
    from skeinlog.functions import sql_surface
    sql_surface.register(spark)
    for q in ["a.b  (c)", " x$1\\y ", "É z", "[a]{2}"]:
        assert spark.createDataFrame([(q,)], "q string").selectExpr("transcript_phrase(q) p").first().p == text.phrase_pattern(q)
    bodies = ["A.B (C) and a.b (c)", "x$1\\Y", "é z É Z", "", "[A]{2}"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    for q in ["a.b  (c)", "É z"]:
        got = df.select(F.expr(f"transcript_match_count(body, '{q}')").alias("a"), text.phrase_count(F.col("body"), q).alias("b")).collect()
        assert all(r.a == r.b for r in got)
