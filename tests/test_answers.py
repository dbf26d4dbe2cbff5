"""Sections, JSON bodies, edit blocks, logs and verdicts on small written cases."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import answers as A
from quernstone.operators import verdicts as V


def each(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *columns).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r)[1:] for r in rows]


def test_json_body(spark):
    texts = [None, "", "none", "{", '{"a": 1}', 'x ```json\n{"a": {"b": 2}}\n``` y', '```\n{broken}\n``` then {"a": 3}', '<think>{"a": 9}</think>ok {"a": 4}', '<think> open {"a": 5}']
    got = each(spark, texts, A.json_body(F.col("t")).alias("j"))
    assert got == [None, None, None, None, '{"a": 1}', '{"a": {"b": 2}}', None, '{"a": 4}', '{"a": 5}']


def test_sections(spark):
    text = "intro\n=== CAUSE ===\n a\nb \n=== evidence ===\n- one\n\n2) two\n=== DEFECT CONFIDENCE ===\n85% ambiguous\n"
    got = each(spark, [text, "", None], A.section(F.col("t"), "CAUSE", ("EVIDENCE",)), A.numbered(A.section(F.col("t"), "EVIDENCE", ("DEFECT CONFIDENCE",))), A.confidence(A.section(F.col("t"), "DEFECT CONFIDENCE")), A.report_class(F.col("t")))
    assert got == [("a\nb", ["one", "two"], 0.85, "ambiguous"), ("", [], 0.95, "confirmed_code_defect"), ("", [], 0.95, "confirmed_code_defect")]
    assert each(spark, ["0.4", "1", "1.5", "100", "250"], A.confidence(F.col("t"))) == [0.4, 1.0, 0.015, 1.0, 0.95]


def test_edits(spark):
    block = "<<<<<<< SEARCH\n{}\n=======\n{}\n>>>>>>> REPLACE\n"
    text = "no heading\n" + block.format("x", "y") + "### a.py\n" + block.format("1\n2", "3") + "### `b/c.py` :: f\n" + block.format("p", "") + block.format("q", "r")
    got = each(spark, [text, "", None, "### a.py\nnothing"], A.edits(F.col("t")))
    assert [[tuple(e) for e in g] for g in got] == [[("a.py", "1\n2", "3"), ("b/c.py", "p", ""), ("b/c.py", "q", "r")], [], [], []]


def test_logs(spark):
    log = "FAILED t.py::a - boom\n  ERROR t.py::b\nPASSED t.py::c\n>  assert f(1) == 2\nE   AssertionError: assert 1 == 2\n"
    got = each(spark, [log, None], A.failed_tests(F.col("t")), A.passed_tests(F.col("t")), A.assertion_failure(F.col("t")))
    assert got[0][:2] == (["t.py::a", "t.py::b"], ["t.py::c"]) and tuple(got[0][2]) == ("t.py::a", "assert f(1) == 2", "AssertionError", "1", "2")
    assert got[1][:2] == ([], []) and tuple(got[1][2]) == ("",) * 5
    block = "x\n_____ test_a[1] _____\nbody\nE boom\n_____ test_b _____\nother\n=== short ===\n"
    assert each(spark, [block], A.failure_block(F.col("t"), F.lit("test_a[1]"))) == ["body\nE boom"]
    assert each(spark, [block], A.failure_block(F.col("t"), F.lit("test_b"))) == ["other"]


def test_small_patterns(spark):
    assert each(spark, ["function: f\nline: 3\n class : C", None], A.located_symbols(F.col("t"))) == [["f", "C"], []]
    assert each(spark, ["run `pytest tests/a.py -k x` now", "`python -m pytest t`", "`ls`"], A.reproduction_command(F.col("t"))) == ["pytest tests/a.py -k x", "python -m pytest t", ""]
    assert tuple(each(spark, ["--- a\n+++ b\n+x\n-y\n-z\n k"], A.diff_counts(F.col("t")))[0]) == (1, 2)
    assert each(spark, ["abcdef", "abc", None], A.within_budget(F.col("t"), 4)) == ["abcd…", "abc", None]


@pytest.mark.parametrize(
    ("name", "kind", "text", "want"),
    [("fit", "method", "call x.fit(1)", 30), ("fit", "method", "use `fit` here", 25), ("fit", "method", "fit (x)", 25), ("Session", "class", "the Session class", 25), ("Session", "class", "a session", 0), ("get", "method", "get it", 0),
     ("Adapter", "class", "an ADAPTER", 20), ("resolve", "method", "resolve it", 15), ("fold", "method", "fold it", 8), ("fold", "method", "manifold", 0), ("a.b", "method", "axb", 0), ("", "method", "x", 0), ("f", "method", None, 0)],
)
def test_symbol_points(spark, name, kind, text, want):
    assert each(spark, [text], V.symbol_points(F.lit(name), F.lit(kind), F.col("t"))) == [want]


def test_contract_gate(spark):
    cols = "case string, o long, forb boolean, c double, s double, up boolean, spec boolean"
    rows = [
        ("up", 1, False, 0.2, 0.0, True, False), ("up", 2, False, 0.9, 5.0, False, False), ("best", 1, True, 0.9, 9.0, True, False), ("best", 2, False, 0.3, 1.0, False, False), ("best", 3, False, 0.3, 1.0, False, False),
        ("synth", 1, True, 0.9, 1.0, True, True), ("revived", 4, True, 0.1, 1.0, False, False), ("revived", 5, True, 0.1, 2.0, False, False), ("nulls", 1, None, None, None, None, None),
    ]
    h = spark.createDataFrame(rows, cols)
    g = V.contract_gate(h, "case", "o", F.col("forb"), F.coalesce("c", F.lit(0.0)), F.col("s"), F.col("up"), F.col("spec"))
    got = {r["case"]: (r.survivors, r.why, r.chosen, r.confidence) for r in g.collect()}
    assert got == {"up": (2, "UPSTREAM", 1, 0.2), "best": (2, "BEST", 2, 0.3), "synth": (0, "SYNTHESISED", None, 0.95), "revived": (0, "REVIVED", 4, 0.1), "nulls": (1, "BEST", 1, 0.0)}


def test_first_nearby(spark):
    df = spark.createDataFrame([(i, i % 2 if i < 40 else 7) for i in range(41)], "k long, g int")
    got = {r.k: r.others for r in V.first_nearby(df, "k", ["g"], 3).collect()}
    assert got[0] == [2, 4, 6] and got[2] == [0, 4, 6] and got[38] == [0, 2, 4] and got[40] == [] and len(got) == 41
