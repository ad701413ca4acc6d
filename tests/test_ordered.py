import random
import re

import pytest
from pyspark.sql import functions as F

from skeinlog.operators import ordered
from skeinlog.session import BLOCK_ROWS_CONF


def reference(rows):
    """Plain loops over each session in line order."""
    out = {}
    for session in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == session)
        for i, (_, line, v) in enumerate(mine):
            before, after = [x[2] for x in mine[:i]], [x[2] for x in mine[i + 1:]]
            known = [x for x in before if x is not None]
            out[session, line] = (
                i + 1, sum(x or 0 for x in [*before, v]), sum(known), max([x for x in [*known, v] if x is not None], default=None),
                known[-1] if known else None, before[-1] if before else None, after[0] if after else None,
                next((x for x in after if x is not None), None), min(known, default=None))
    return out


@pytest.mark.parametrize("block", [1, 3, 50, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_scan_equals_loops(spark, block, seed):
    rng = random.Random(seed)
    # One session holds most of the rows; another has a single one.
    rows = [(0, line, rng.choice([None, *range(9)])) for line in rng.sample(range(400), 90)]
    rows += [(s, line, rng.choice([None, 3, 7])) for s in (1, 2, 3) for line in rng.sample(range(60), 9)] + [(4, 17, None)]
    spark.conf.set(BLOCK_ROWS_CONF, str(block))
    try:
        v = F.col("v")
        got = ordered.scan(
            spark.createDataFrame(rows, "s int, line bigint, v int"), ["s"], "line",
            n=ordered.RowNumber(), total=ordered.RunningSum(v), earlier=ordered.RunningSum(v, inclusive=False), top=ordered.RunningMax(v),
            last=ordered.LastValue(v, inclusive=False), lag=ordered.Lag(v), lead=ordered.Lead(v), next=ordered.NextValue(v), low=ordered.RunningMin(v, inclusive=False),
        ).collect()
    finally:
        spark.conf.unset(BLOCK_ROWS_CONF)
    expected = reference(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.total, r.earlier, r.top, r.last, r.lag, r.lead, r.next, r.low) == expected[r.s, r.line]


def test_one_session_is_spread_over_blocks(spark, tiny_blocks):
    """The rows themselves are placed by session and block; only reduced rows are placed by session alone."""
    rows = spark.range(200).select(F.concat(F.lit("hot"), (F.col("id") % 1).cast("string")).alias("session_id"), F.col("id").alias("line"))
    plan = ordered.scan(rows, ["session_id"], "line", n=ordered.RowNumber())._jdf.queryExecution().executedPlan().toString()
    placed = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert sum("_block" in p for p in placed) >= 2 and sum("_block" not in p for p in placed) == 1
