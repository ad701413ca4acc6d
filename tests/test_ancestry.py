import random

import pytest

from skeinlog.operators import graph


def plain(records, points):
    """Paths by a plain loop; a point without session or id is its own path."""
    ups, out = {}, []
    for s, u, up in records:
        ups.setdefault((s, u), []).append(up)
    for s, p in points:
        path, now = [], p
        while now is not None and len(ups.get((s, now), [])) == 1 and len(path) <= len(records):
            path.append(now)
            now = ups[s, now][0]
        if s is None or p is None:
            out.append((s, p, p, 0))
        elif now is None:
            out += [(s, p, u, k) for k, u in enumerate(path)]
    return sorted(out, key=repr)


def tables(seed, sessions, rows):
    pick, records = random.Random(seed), []
    for s in range(sessions):
        for k in range(pick.randint(1, rows)):
            records.append((f"s{s}", f"{k}", None if k == 0 or pick.random() < 0.05 else f"{max(0, k - pick.randint(1, 3))}"))
    records += [("s0", "loop1", "loop2"), ("s0", "loop2", "loop1"), ("s0", "under", "loop1"), ("s1", "lost", "nowhere"), (None, "1", None), ("s1", None, None), ("s1", "self", "self")]
    records += pick.sample(records, len(records) // 40)
    points = [(s, u) for s, u, _ in records if pick.random() < 0.3] + [("s0", "under"), ("s0", "loop1"), ("s1", "lost"), ("s1", "self"), (None, "1"), ("s1", None), ("s2", "absent"), ("none", "1")]
    return records, points + points[:5]


@pytest.mark.parametrize("walked,together", [(512, 16_384), (0, 1), (20, 50)])
def test_paths_equal_a_plain_loop(spark, monkeypatch, walked, together):
    monkeypatch.setattr(graph, "WALKED", walked)
    monkeypatch.setattr(graph, "WALKED_TOGETHER", together)
    records, points = tables(5, 9, 40)
    got = graph.ancestry(spark.createDataFrame(records, "session_id string, uuid string, parent_uuid string"), spark.createDataFrame(points, "session_id string, point string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(records, points)


def test_void_paths_are_not_listed(spark, monkeypatch):
    """A long session whose second row is repeated: every path is void, and no more rows are written than pointers need."""
    written, materialize = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: (written.append(materialize(df, label)), written[-1])[1])
    records = [("s", f"{k}", f"{k - 1}" if k else None) for k in range(1500)] + [("s", "1", "0")]
    points = [("s", f"{k}") for k in range(0, 1500, 2)]
    got = graph.ancestry(spark.createDataFrame(records, "session_id string, uuid string, parent_uuid string"), spark.createDataFrame(points, "session_id string, point string"))
    assert [tuple(r) for r in got.collect()] == [("s", "0", "0", 0)]
    assert sum(t.count() for t in written) < 20 * len(records)
