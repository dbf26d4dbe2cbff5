"""What an issue's text and a report say, on written cases."""

import os

from pyspark.sql import functions as F

from quernstone.functions import answers as A
from quernstone.functions import text as T
from quernstone.plans import registry
from quernstone.sources import code

ISSUE = """
    In lib 2.3.0, when calling session.send() with headers containing None values,
    KeyError: 'Accept-Encoding' is raised instead of omitting the header.
    Expected: headers with None values should not be sent.
    It ought to omit them quietly. The header is supposed to be left out.
    Actual behavior: raises KeyError when merging environment settings
    - Test test_headers_on_session_with_None_are_not_sent fails.
    - Test test_headers_on_session_with_None_are_not_sent fails.
    Look at .\\lib\\sessions.py, `Session.merge()` and `merge_all()`; see `KeyError`.
"""


def extracted(spark, tmp_path, name):
    spark.createDataFrame([(1, ISSUE), (2, None), (3, "class process")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return {r.doc_id: r for r in registry.queries()[name](spark, str(tmp_path)).collect()}


def test_behavior_extract(spark, tmp_path):
    r = extracted(spark, tmp_path, "behavior_extract")
    assert (r[1].exceptions, r[1].files, r[1].tests) == ("KeyError", "lib/sessions.py", "test_headers_on_session_with_None_are_not_sent")
    assert r[1].symbols.split(",") == ["Session.merge", "merge_all", "session.send"] and r[1].affected_api.split(",") == ["Session.merge", "session.send"]
    assert (r[1].n_symptoms, r[1].first_symptom) == (2, "KeyError: 'Accept-Encoding' is raised instead of omitting the header.")
    assert (r[1].state_words, r[1].input_conditions, r[1].output_conditions) == ("session,header,environ", "none", "exceptions")
    assert r[2].files == r[2].symbols == r[2].first_symptom == "" and r[2].n_symptoms == 0


def test_behavior_phrases(spark, tmp_path):
    r = extracted(spark, tmp_path, "behavior_phrases")
    assert r[1].expected == "not be sent; omit them quietly"
    assert r[1].current == "of omitting the header; behavior: raises KeyError when merging environment settings; raises KeyError when merging environment settings"
    assert r[1].trigger.split("; ")[0] == "calling session"
    assert (r[2].expected, r[2].current) == ("", "") and r[3].expected == "class process"


def test_stems(spark):
    words = ["class", "process", "classes", "running", "parties", "tests", "pass", "uses"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(T.stem(F.col("w"))).collect()] == ["class", "process", "class", "runn", "party", "test", "pass", "uses"]


def test_site_bullets(spark):
    text = "======\n- 3d/model.py\n* 2) b.py\n\n-- c.py::f\n==="
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r[0] for r in df.select(A.listed(F.col("t"))).collect()] == [["3d/model.py", "2) b.py", "c.py::f"], []]
    assert [r[0] for r in df.select(A.numbered(F.col("t"))).collect()][0][1:4] == ["d/model.py", "b.py", "c.py::f"]


def test_malformed_bytes_do_not_end_the_scan(spark, tmp_path):
    os.makedirs(tmp_path / "pkg" / "build")
    (tmp_path / "pkg" / "good.py").write_text("def f():\n    return 1\n")
    (tmp_path / "pkg" / "bad.py").write_bytes(b"# caf\xe9\nx = 1\n")
    (tmp_path / "pkg" / "build" / "made.py").write_text("y = 2\n")
    rows = {os.path.basename(r.path): r.code for r in code.source_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"good.py", "bad.py"} and rows["bad.py"] == "# caf�\nx = 1\n"


def test_search_candidates(spark):
    rows = [("a/b.py", "FUNCTION"), ("tests/t.py", "FUNCTION"), ("a/b.py", "FILE"), ("vendor/x.py", "CLASS"), ("a/c.py", "CLASS"), ("a/latest.py", "METHOD")]
    df = spark.createDataFrame(rows, "path string, kind string")
    assert sorted(r.path for r in code.candidates(df).collect()) == ["a/b.py", "a/c.py", "a/latest.py"]
    assert [tuple(r) for r in code.candidates(df, "a/b.py").collect()] == [("a/b.py", "FUNCTION")]
