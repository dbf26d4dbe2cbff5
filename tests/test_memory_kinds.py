"""Episodes equal but for their ids are compared once for all tasks that ask the same."""

from quernstone.streaming import memory as M


def test_many_equal_episodes(spark):
    """3,000 tasks and 3,000 episodes of one kind: 9 million pairs, four of which are each task's candidates."""
    frame = lambda lo: spark.range(lo, lo + 3000).selectExpr("id", "'r' AS repo", "'mod.f' AS symbol", "'fix the thing' AS text", "true AS resolved")
    got = M.recall(frame(0), frame(1), 3)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.task, []).append((r["rank"], r.episode, r.score))
    want = lambda t: [(n + 1, e, 1.1) for n, e in enumerate([e for e in (1, 2, 3, 4) if e != t][:3])]
    assert len(rows) == 3000 and all(sorted(v) == want(t) for t, v in rows.items())
