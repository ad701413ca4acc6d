import random
import re
import zlib
from hashlib import sha256
from itertools import groupby

import pytest

from skeinlog.llm import conversations as cv

ROOT = "/root/testdata/sf0.01"
GOOD = re.compile(r"(s?(ua)+)?")


def plain_edits(rows):
    """The cheapest edits by trying all: whole (cost, letters, turns) for each place in the pattern, nothing dropped."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    now = {"": (0, "", ())}

    def with_inserted(states):
        for _ in range(3):
            for place, (cost, letters, turns) in list(states.items()):
                for to in step[place].replace("s", ""):
                    new = (cost + 2, letters + "I", (*turns, (names[to], "")))
                    states[to] = min(states.get(to, new), new)
        return states

    for role, text, fault in rows:
        after = {}
        for place, (cost, letters, turns) in with_inserted(now).items():
            ways = [(cost + 3, letters + "D", turns, place)]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if role[:1] and role[:1] in step[place]:
                    ways.append((cost + cut, letters + "K", (*turns, (role, text)), role[:1]))
                for to in step[place].replace("s", ""):
                    ways.append((cost + 2 + cut, letters + "R", (*turns, (names[to], text)), to))
            for *new, to in ways:
                after[to] = min(after.get(to, tuple(new)), tuple(new))
        now = after
    ends = with_inserted(now)
    return min(ends[p] for p in ("", "a") if p in ends)


def with_faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def plain_report(rows):
    """(turn, role, text) in order -> the columns of a report."""
    faulty = with_faults([r[1:] for r in rows])
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, after = plain_edits(faulty)
    count = lambda f: sum(x == f for _, _, x in faulty)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    text = "\n".join(f"{r}:{t}" for r, t in after)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
            illegal, cost, audit, sha256(text.encode()).hexdigest())


def plain_damage(rows):
    """Damaged rows by conversation, every conversation named."""
    out = {c: [] for c, _, _, _ in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], __import__("hashlib").md5(r[2].encode()).hexdigest())
    return {c: sorted(some, key=order) for c, some in out.items()}


def repaired_alone(rows):
    edits, most = [], 0
    repair = cv.Repair(lambda letter, turn: edits.append((letter, turn)))
    for role, text, fault in rows:
        repair.feed(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        most = max(most, repair.unresolved())
    return repair.finish(), "".join(e for e, _ in edits), tuple(t for _, t in edits if t is not None), most


@pytest.mark.parametrize("seed", range(6))
def test_same_edits_as_without_pruning(seed):
    rng = random.Random(seed)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool", "", " "][:rng.choice([2, 3, 6])]), f"t{i}", rng.choice(["", "", "truncated", "blank", "duplicate"][:rng.choice([1, 3, 5])]))
                for i in range(rng.randrange(0, 14))]
        *got, _ = repaired_alone(rows)
        assert tuple(got) == plain_edits(rows)
        assert GOOD.fullmatch("".join(r[:1] for r, _ in got[2]))


def test_least_letters_of_all_lists_of_edits():
    """Against every list of up to three edits a row, not only the best one for each place."""
    def all_lists(rows):
        best, todo = None, [(0, "", "", 0)]
        while todo:
            cost, letters, roles, at = todo.pop()
            if best and cost > best[0]:
                continue
            if at == len(rows) and GOOD.fullmatch(roles) and (best is None or (cost, letters) < best):
                best = (cost, letters)
            if letters[-2:] != "II":
                todo += [(cost + 2, letters + "I", roles + r, at) for r in "ua"]
            if at < len(rows):
                role, _, fault = rows[at]
                todo.append((cost + 3, letters + "D", roles, at + 1))
                if fault not in ("blank", "duplicate"):
                    todo.append((cost + (fault == "truncated"), letters + "K", roles + (role[:1] or "?"), at + 1))
                    todo += [(cost + 2 + (fault == "truncated"), letters + "R", roles + r, at + 1) for r in "ua"]
        return best

    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "x"]), f"t{i}", rng.choice(["", "", "truncated", "blank"])) for i in range(rng.randrange(0, 4))]
        assert repaired_alone(rows)[:2] == all_lists(rows)


def test_memory_stays_bounded():
    rng = random.Random(2)
    for roles in (["user", "assistant"], ["system", "user", "assistant", "tool"]):
        rows = [(rng.choice(roles), f"t{i}", rng.choice(["", "", "", "truncated", "blank"])) for i in range(20_000)]
        cost, letters, turns, most = repaired_alone(rows)
        assert (cost, letters, turns) == plain_edits(rows[:20_000]) and most < 400
    assert repaired_alone([("tool", "", "blank")] * 5000 + [("user", "x", "")])[3] < 20
    tied = [("user", f"t{i}", "") for i in range(301)]  # nothing is settled before the end
    assert repaired_alone(tied)[:3] == plain_edits(tied)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table_equals_plain_loop(spark):
    table = spark.read.parquet(f"{ROOT}/conversations.parquet")
    want = {c: plain_report(rows) for c, rows in plain_damage([tuple(r) for r in table.collect()]).items()}
    got = cv.digests(table)
    assert got.columns == ["conv_id", *cv.NAMES]
    assert rows_of(got) == sorted(((c, *r) for c, r in want.items()), key=repr)
    assert sum(r[5] for r in want.values()) and sum(r[2] for r in want.values()) and sum(r[0] for r in want.values())


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, cost string, mark long"
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, 40, 41]), rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice([None, "user", "assistant", "system", ""]), rng.choice([None, "", " \n", "Yes.", "Yes", "no!", "é" * 50_000]), "x", 1)
            for _ in range(150)]
    for some in (rows, rows * 2, []):
        want = {c: plain_report(r) for c, r in plain_damage([r[:4] for r in some]).items()}
        assert rows_of(cv.digests(spark.createDataFrame(some, schema))) == sorted(((c, *r) for c, r in want.items()), key=repr)
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    only = cv.digests(spark.createDataFrame([(gone, 0, "user", "all of it", "x", 1)], schema)).collect()
    assert [tuple(r) for r in only] == [(gone, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]


def test_turns_after_repair(spark):
    table = spark.read.parquet(f"{ROOT}/conversations.parquet")
    got = sorted(tuple(r) for r in cv.repaired(table).collect())
    for conv, some in groupby(got, key=lambda r: r[0]):
        some = list(some)
        assert [r[1] for r in some] == list(range(len(some))) and GOOD.fullmatch("".join(r[2][0] for r in some))
    assert {r[4] for r in got} <= set("KRI")
    short = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", None)], "conv_id long, turn long, role string, text string")
    assert [tuple(r)[2:] for r in cv.repaired(short).orderBy("position").collect()] in ([("user", "", "I"), ("assistant", "Hi.", "K")], [])
