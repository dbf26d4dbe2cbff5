"""Recall of past episodes, and what each mode lets a batch see."""

import random

import pytest

from quernstone.streaming import memory as M


def brute(tasks, episodes, k=3, resolved_only=True):
    import re

    words = lambda t: set(re.findall(r"[a-zA-Z_][a-zA-Z0-9_]*", (t or "").lower()))
    out = set()
    for i, repo, sym, text, _ in tasks:
        found = []
        for j, r, s, t, ok in episodes:
            if i == j or (resolved_only and not ok):
                continue
            a, b, x, y = (sym or "").lower(), (s or "").lower(), words(text), words(t)
            exact = 0.3 * (repo == r) + 0.4 * bool(a and b and (a in b or b in a)) + (0.3 * (len(x & y) / len(x | y)) if x | y else 0) + 0.1 * bool(ok)
            if exact > 0.1:
                found.append((-round(exact, 3), j))
        out |= {(i, j, -s, n + 1) for n, (s, j) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("resolved_only", [True, False])
def test_recall_against_brute_force(spark, resolved_only):
    rng = random.Random(4)
    sym = lambda: rng.choice([None, "", "a", "Ab", "x.ab", "foo.Bar", "bar", "é.foo", "o.B"])
    text = lambda: rng.choice([None, "", "The cat", "cat dog_1", "9 + 9", "the THE dog_1 bird"])
    row = lambda i: (i, rng.choice(["r1", "r2", "r3"]), sym(), text(), rng.random() < 0.6)
    episodes, tasks = [row(i) for i in range(60)], [row(50 + i) for i in range(30)]
    frame = lambda rows: spark.createDataFrame(rows, M.EPISODE)
    got = {(r.task, r.episode, r.score, r["rank"]) for r in M.recall(frame(tasks), frame(episodes), 3, resolved_only).collect()}
    assert got == brute(tasks, episodes, 3, resolved_only)


def test_modes(spark, tmp_path):
    past = [(1, "r", "f", "old", True)]
    batches = [[(10, "r", "f", "new", True)], [(11, "r", "f", "new", True)], [(12, "r", "f", "new", True)]]
    want = {"FROZEN": {10: {1}, 11: {1}, 12: {1}}, "ONLINE": {10: {1}, 11: {1, 10}, 12: {1, 10, 11}}, "DISABLED": {}}
    for mode in M.MODES:
        folder, source, path = (str(tmp_path / mode / x) for x in ("episodes", "in", "out"))
        memory = M.Memory(spark, folder, mode)
        assert memory.fingerprint() == "empty"
        memory.record(spark.createDataFrame(past, M.EPISODE), "past")
        memory = M.Memory(spark, folder, mode)
        before = memory.fingerprint()
        assert (before == "empty") == (mode == "DISABLED")
        for rows in batches:
            spark.createDataFrame(rows, M.EPISODE).coalesce(1).write.mode("append").json(source)
            M.answer(spark.readStream.schema(M.EPISODE).json(source), memory, path)
        got = {}
        for r in spark.read.schema("task long, episode long, score double, rank long").parquet(f"{path}/rows").collect():
            got.setdefault(r.task, set()).add(r.episode)
        assert got == want[mode]
        assert memory.fingerprint() == before  # what the run recorded is not part of the pinned snapshot
        assert M.Memory(spark, folder, "ONLINE").episodes().count() == 4
    with pytest.raises(ValueError):
        M.Memory(spark, folder, "OTHER")
