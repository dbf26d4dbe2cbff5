"""Frames, candidates and results against plain versions that go pair by pair."""

import random

from quernstone.operators import candidates as C
from quernstone.operators import frames as P


def test_told_apart_equals_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4)
    rng = random.Random(5)
    groups = {g: [set(rng.sample("abcdef", rng.randrange(7))) | ({"z"} if g % 2 else set()) for _ in range(rng.randrange(1, 14))] for g in range(40)}
    groups[40] = [{"a", "b"}] * 13
    groups[41] = [{"a"}] + [{"a", "b"}] * 12
    want = {}
    for g, sets in groups.items():
        for i, a in enumerate(sets):
            for j in range(i + 1, len(sets)):
                for x, y, o in ((a, sets[j], j), (sets[j], a, i)):
                    if x - y:
                        want[g, i if o == j else j] = (o, len(x - y), ", ".join(sorted(x - y)[:3]))
    rows = [(g, i, i, len(s), t) for g, s in groups.items() for i, x in enumerate(s) for t in x for _ in range(2)]
    df = spark.createDataFrame(rows, "g long, candidate long, nth long, n long, test string")
    assert {(r.g, r.candidate): (r.other, r.n_unique, r.tests) for r in C.told_apart(df, "g").collect()} == want
    assert C.told_apart(df.limit(0), "g").count() == 0


def test_told_apart_is_dealt_by_its_rows(spark, monkeypatch):
    """Tasks follow the number of rows, and no key is as large as a group: 400 candidates with 12 tests in all."""
    monkeypatch.setattr(C, "BLOCK", 16)
    monkeypatch.setattr(C, "APART_ROWS", 100)
    rows = [(1, i, i, 400, f"t{j}") for i in range(400) for j in range(12) if (i * 7 + j) % 3]
    df = spark.createDataFrame(rows, "g long, candidate long, nth long, n long, test string")
    out = C.told_apart(df, "g")
    assert out.rdd.getNumPartitions() == 32
    sizes = [n for n in out.rdd.glom().map(len).collect() if n]
    assert sum(sizes) == 400 and max(sizes) < 60


def test_within_holds_spans_of_any_length(spark):
    rng = random.Random(6)
    spans = [(rng.randrange(2), n, lo, lo + rng.choice((-1, 0, 3, 15, 16, 255, 4000, 70_000, 3_000_000))) for n, lo in enumerate(rng.randrange(-50, 5000) for _ in range(200))]
    places = [(rng.randrange(2), rng.choice((rng.randrange(-60, 6000), rng.randrange(100_000)))) for _ in range(200)] + [(0, None), (None, 5)]
    out = P.within(spark.createDataFrame(places, "f long, at long"), spark.createDataFrame(spans, "f long, s long, lo long, hi long"), ["f"], "at")
    assert sorted((r.f, r.at, r.s) for r in out.collect()) == sorted((f, a, s) for f, a in places for g, s, lo, hi in spans if f == g and a is not None and lo <= a <= hi)


def test_the_last_covered_frame_counts(spark):
    frames = [(1, 0, "src/test_a.py", 5), (1, 1, "src/a.py", 10), (1, 2, "src/a.py", 40), (1, 3, "vendor/x/a.py", 12), (3, 0, "b.py", 1)]
    cands = [(1, "p", "src/A.py", 1, 20), (1, "q", "src\\a.py", 30, 50), (1, "r", "other.py", 1, 99), (1, "s", "", 1, 99), (2, "p", "a.py", 1, 9)]
    out = P.covered(spark.createDataFrame(frames, "k long, nth int, path string, line long"), spark.createDataFrame(cands, "k long, candidate string, file string, lo long, hi long"), "k")
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "p", 4, 12, 4, 60.0), (1, "q", 3, 40, 4, 82.5), (1, "r", None, None, 4, 0.0), (1, "s", None, None, 4, 0.0), (2, "p", None, None, 0, 0.0)]


def test_methods_come_before_classes(spark):
    spans = [("f", "A", "class", 0, 1, 50), ("f", "late", "method", 2, 10, 20), ("f", "early", "method", 1, 5, 30), ("f", "x", "assignment", 3, 40, 40)]
    places = [("f", 12), ("f", 40), ("f", 60), ("g", 1), (None, 1), ("f", 12)]
    out = P.enclosing(spark.createDataFrame(places, "file string, line long"), spark.createDataFrame(spans, "file string, symbol string, kind string, nth long, lo long, hi long"), "file", "line")
    assert sorted((str(r.file), r.line, str(r.symbol)) for r in out.collect()) == [("None", 1, "None"), ("f", 12, "early"), ("f", 12, "early"), ("f", 40, "A"), ("f", 60, "None"), ("g", 1, "None")]


def test_integrity(spark):
    names = "k int, patch string, output string, resolved boolean, f2p_ok array<string>, f2p_bad array<string>, p2p_bad array<string>, base_ok array<string>"
    rows = [
        (0, "+def test_a(x):\n+  def test_b():", "FAILED t.py::test_a - x\nt.py::test_b PASSED\ntest_bb ERROR", True, ["t.py::test_c"], [], [], ["test_c"]),
        (1, "def test_a():", "t.py::test_a ERROR", True, ["q"], ["t.py::test_a"], ["r"], ["other"]),
        (2, None, None, True, None, None, None, None),
        (3, "def test_a():", "FAILED test_ab", None, ["q"], ["z"], [], []),
    ]
    out = {r.k: r for r in C.integrity(spark.createDataFrame(rows, names)).collect()}
    assert (out[0].unrepresented, out[0].non_discriminating, out[0].inconsistent) == (["test_a"], ["t.py::test_c"], True)
    assert (out[1].unrepresented, out[1].resolved_with_f2p_failures, out[1].resolved_with_p2p_failures, out[1].idle_passes) == ([], True, True, False)
    assert out[2].resolved_without_f2p and out[2].inconsistent and not out[3].inconsistent
