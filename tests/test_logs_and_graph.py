"""Logs, causes, interface terms, gates, graph reads, evidence and records on written cases."""

import json

from pyspark.sql import functions as F

from quernstone.functions import logs as L
from quernstone.operators import evidence, graph, rules, spans, verdicts
from quernstone.sources import code, records


def one(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_causes(spark):
    fields = "error string, infra boolean, valid boolean, patch string, perr string, applied boolean, resolved boolean, f2p int, f2pt int, p2p int, p2pt int, output string, changed array<string>, likely array<string>, tfile string, tsym string"
    base = {"error": "", "infra": False, "valid": True, "patch": "diff", "perr": "", "applied": True, "resolved": False, "f2p": 0, "f2pt": 1, "p2p": 10, "p2pt": 10, "output": "", "changed": [], "likely": [], "tfile": None, "tsym": None}
    cases = [
        ({"output": "NameError: name 'ChunkedEncodingError' is not defined\n  File 'requests/models.py', line 748", "changed": ["requests/models.py"], "tsym": "iter_content"}, "PATCH_SEMANTICS"),
        ({"output": "AssertionError\n  File 'app.py', line 120, in register_blueprint", "changed": ["app.py"], "tsym": "register_blueprint", "tfile": "app.py"}, "PATCH_SEMANTICS"),
        ({"output": "Target mismatch in tests/test_core.py\n  unrelated code never called", "changed": ["unrelated.py"], "tsym": "target_func", "tfile": "target.py"}, "WRONG_HYPOTHESIS"),
        ({"changed": ["other/mod.py"], "likely": ["src/core.py", "", "src/util.py"]}, "WRONG_LOCALIZATION"), ({"changed": ["x/src/core.py"], "likely": ["src/core.py"]}, "WRONG_HYPOTHESIS"),
        ({"output": "IndentationError: unexpected indent"}, "PATCH_SYNTAX"), ({"error": "Timeout"}, "TIMEOUT"), ({"infra": True}, "INFRA_FAILURE"), ({"error": "x", "applied": False}, "INFRA_FAILURE"), ({"applied": False}, "PATCH_SYNTAX"),
        ({"patch": " \n", "perr": "schema"}, "REPAIR_SCHEMA_FAILURE"), ({"valid": False, "perr": "Validation"}, "REPAIR_VALIDATION_FAILURE"), ({"valid": False, "perr": "line expansion"}, "REPAIR_OVEREXPANSION"), ({"valid": False}, "PATCH_SYNTAX"),
        ({"resolved": True, "f2p": 1}, "RESOLVED"), ({"f2p": 1, "p2p": 9}, "REGRESSION"), ({"f2p": 1, "f2pt": 2}, "PATCH_SEMANTICS"), ({"f2pt": 0}, "TEST_FAILURE"),
    ]
    rows = [tuple((base | c)[f.split()[0]] for f in fields.split(", ")) for c, _ in cases]
    c = F.col
    cause = rules.failure_cause(c("error"), c("infra"), c("valid"), c("patch"), c("perr"), c("applied"), c("resolved"), c("f2p"), c("f2pt"), c("p2p"), c("p2pt"), c("output"), c("changed"), c("likely"), c("tfile"), c("tsym"))
    got = [r[0] for r in spark.createDataFrame(rows, fields).coalesce(1).select(cause).collect()]
    assert got == [want for _, want in cases]


def test_inspected_and_details(spark):
    log = "x FAILED a - b\nTraceback (most recent call last):\n  File\nE   ValueError: no\nmid\nTraceback (most recent call last):\n" + "  f\n" * 30 + "\nrest\n  ERROR c"
    got = one(spark, [log, None], L.inspected(F.col("t")))
    assert got[0].failing == ["x FAILED a - b", "ERROR c"] and got[0].traceback.split("\n")[:3] == ["Traceback (most recent call last):", "  File", "E   ValueError: no"] and len(got[0].traceback.split("\n")) == 30
    assert got[1].failing == [] and got[1].traceback == ""
    log = "__ X.test_q ___\nlib/a.py:4: in f\nE   TypeError: bad: worse\nE   - 1\n___ test_z ___\nE   OSError: z\n"
    got = one(spark, [log, "nothing of it", "\nE   assert 3", None, "FAIL: test_q\nValueError: plain"], L.details(F.col("t"), F.lit("m.py::test_q")))
    assert tuple(got[0]) == ("TypeError", "bad: worse", "- 1", "lib/a.py:4") and tuple(got[1]) == ("",) * 4
    assert tuple(got[2])[:2] == ("AssertionError", "assert 3") and tuple(got[3]) == ("",) * 4 and tuple(got[4])[:2] == ("ValueError", "plain")


def test_commits_and_blame(spark):
    log = "COMMIT|h1|Ann|2024-01-02|17|fix: bug in a|b\na.py\nnotes\nd\\c.py\n\nCOMMIT|bad\nx.py\nCOMMIT|h2|Bo|2024-01-01|soon|Add"
    got = one(spark, [log, ""], L.commits(F.col("t")))
    assert [(c.hash, c.author, c.ts, c.message, c.is_fix, c.files) for c in got[0]] == [("h1", "Ann", 17.0, "fix: bug in a", True, ["a.py", "d/c.py"]), ("h2", "Bo", 0.0, "Add", False, [])] and got[1] == []
    assert [tuple(x) for x in one(spark, ["h|a|d|m | n\nbroken|x\n"], L.file_log(F.col("t")))[0]] == [("h", "a", "d", "m | n")]
    blame = "0123456789ab 1 1 2\nauthor Ann\nsummary one\nfilename f.py\n\tx = 1\n0123456789ab 2 2\n\ty = 2\nffffffffffff 3 3 1\nauthor Bo\nsummary two\n\t"
    df = spark.createDataFrame([(1, blame)], "k int, log string")
    assert [(r.hash, r.author, r.summary, r.content) for r in L.blamed(df, "k", "log").orderBy("at").collect()] == [("0123456789ab", "Ann", "one", "x = 1"), ("0123456789ab", "Ann", "one", "y = 2"), ("ffffffffffff", "Bo", "two", "")]


def test_contract_terms(spark):
    problem = "Please add a text=True parameter to from_file, rather than mode strings: app.config.from_file('x', load=tomllib.load, text=False). Catch socket.error and handle ProtocolError, wrap in ConnectionError."
    got = one(spark, [problem, None], L.contract_terms(F.col("t"), F.lit("`text=False`"), F.lit("from_file"), F.lit(True)))
    assert got[0].forbidden == ["mode"] and "text" in got[0].parameters and "load" in got[0].parameters
    assert got[0].handled == ["socket.error", "ProtocolError"] and got[0].expected == ["ConnectionError"] and got[1].parameters == ["text"]


def test_static_gate(spark):
    old = "def f(a):\n    return 1\n\ndef g():\n    pass\n"
    news = [old.replace("1", "2"), old, old + "```", "def (", old.replace("def g():\n    pass\n", ""), old.replace("(a)", "()").replace("1", "3"), old + "y = 1\n" * 151, None]
    df = spark.createDataFrame([(i, old, n) for i, n in enumerate(news)], "i int, x string, y string").withColumn("f", code.revision("x", "y"))
    got = [r[1] for r in df.select("i", verdicts.static_gate(F.col("x"), F.col("y"), F.col("f"), F.array(F.lit("f")), F.array(F.lit("a"))).alias("e")).orderBy("i").collect()]
    assert got == [[], ["UNCHANGED"], ["LEAK", "SYNTAX"], ["SYNTAX"], ["REMOVED"], ["SIGNATURE"], ["EXPANSION"], ["REMOVED"]]


def test_graph_reads(spark):
    n = spark.createDataFrame([("b", "Base", "CLASS", "m.py"), ("h", "Http", "CLASS", "m.py"), ("s", "send", "METHOD", "m.py"), ("e", "_execute", "METHOD", "m.py"), ("e2", "_execute", "FUNCTION", "k.py"), ("t", "test_send", "FUNCTION", "tests/t.py")], "id string, name string, kind string, path string")
    e = spark.createDataFrame([("h", "symbol:Base", "INHERITS"), ("s", "symbol:_execute", "CALLS"), ("t", "s", "CALLS"), ("t", "symbol:unknown", "CALLS"), ("module:m.py", "symbol:os", "IMPORTS"), ("module:k.py", "module:m.py", "IMPORTS"), ("e", "s", "READS"), ("s", "symbol:_execute", "CALLS")], "src string, dst string, kind string")
    full = graph.concrete(e, n)
    assert {(r.src, r.dst, r.kind) for r in full.collect()} == {("h", "b", "INHERITS"), ("s", "e", "CALLS"), ("s", "e2", "CALLS"), ("t", "s", "CALLS"), ("t", "symbol:unknown", "CALLS"), ("module:m.py", "symbol:os", "IMPORTS"), ("module:k.py", "module:m.py", "IMPORTS"), ("e", "s", "READS")}
    pairs = lambda df: {tuple(r) for r in df.collect()}
    assert pairs(graph.related(full, n, ("CALLS",), into=False).where("node = 's'")) == {("s", "e"), ("s", "e2")}
    assert pairs(graph.related(full, n).where("node = 's'")) == {("s", "e"), ("s", "e2"), ("s", "t")}
    assert pairs(graph.tests_of(full, n)) == {("s", "t")}
    assert pairs(graph.ancestry(e, n)) == {("h", "base", "Base")} and pairs(graph.ancestry(full, n)) == {("h", "base", "b"), ("b", "subclass", "Http")}
    assert pairs(graph.imports_of(full)) == {("module:m.py", "imported", "os"), ("symbol:os", "importer", "m.py"), ("module:k.py", "imported", "m.py"), ("module:m.py", "importer", "k.py")}
    p = spark.createDataFrame([("s", "s"), ("s", "e"), ("s", "t"), ("s", "h")], "primary string, failing string")
    assert {r.failing: r.relation for r in graph.site_relation(p, full).collect()} == {"s": "SAME_SITE", "e": "CALLED_BY_PRIMARY", "t": "CALLER_OF_PRIMARY", "h": "CROSS_MODULE"}


def test_evidence(spark):
    s = spark.createDataFrame([("f", 1, 5, 9), ("f", 2, 9, 12), ("f", 3, 13, 14), ("f", 4, 1, 4), ("g", 1, 0, 0)], "file string, i int, lo int, hi int")
    assert {r.file: ([x.i for x in r.kept], r.n) for r in spans.kept_first(s, "file", ["i"]).collect()} == {"f": ([1, 3, 4], 4), "g": ([1], 1)}
    sites = spark.createDataFrame([(1, "a\\b.py", "C.m"), (2, "", "C.m"), (3, "z.py", "q.m"), (4, "", "none")], "i int, path string, symbol string")
    profiles = spark.createDataFrame([("b.py:C.m", "base", 1), ("m", "clean", 2), ("m", "later", 3)], "key string, v string, seq int")
    got = evidence.looked_up(sites, profiles, evidence.site_keys(F.col("path"), F.col("symbol")), "key", "v", "seq")
    assert {r.i: (r.v, r.tier) for r in got.collect()} == {1: ("base", 2), 2: ("later", 6), 3: ("later", 6), 4: (None, None)}
    log = spark.createDataFrame([("c", 1, "see"), ("c", 2, "reject"), ("c", 3, "accept"), ("c", 4, "see"), ("d", 1, "see")], "k string, seq int, kind string")
    assert {r.k: (r.status, r.n_observed, r.n_late) for r in evidence.decided(log, "k", "seq", "kind", ("accept", "reject"), "see").collect()} == {"c": ("reject", 1, 2), "d": ("PENDING", 1, 0)}


def test_localizer(spark):
    files = spark.createDataFrame([(1, "a.py", 0, 2, True), (1, "b.py", 1, 2, False)], "k int, file string, nth int, n int, mentioned boolean")
    hits = spark.createDataFrame([(1, "a.py", "f", "related", True, True, True), (1, "a.py", "f", "edit", True, False, False), (1, "c.py", "g", "edit", False, True, True)], "k int, file string, symbol string, source string, neighbour boolean, issue boolean, test boolean")
    got = [(r.file, r.symbol, r.score) for r in evidence.localized(files, hits, "k").orderBy("rank").collect()]
    assert got == [("a.py", "f", 1.95), ("a.py", "", 0.6), ("b.py", "", 0.25), ("c.py", "g", 0.2)]


def test_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("b.json", '{"id": "y", "n": 2}'), ("a.json", '{"id": "x", "n": 1, "more": [1]}'), ("broken.json", "{"), ("skip.txt", "{}")):
        (tmp_path / "in" / name).write_text(body)
    rows = records.files(spark, str(tmp_path / "in"), "id string, n long").where("id IS NOT NULL").orderBy("id").collect()
    assert [(r.id, r.n, len(r.fingerprint)) for r in rows] == [("x", 1, 16), ("y", 2, 16)]
    (tmp_path / "g.json").write_text(json.dumps({"name": "r", "nodes": [{"id": "a"}, {"id": "b"}]}, indent=1))
    assert [r.id for r in records.nested(spark, str(tmp_path / "g.json"), "nodes array<struct<id:string>>", "nodes").collect()] == ["a", "b"]
    out = str(tmp_path / "ledger")
    df = spark.createDataFrame([(1, "p"), (2, "q")], "key int, event string")
    for _ in range(2):
        records.append(df, out)
    assert records.lines(spark, out, "key int, event string", F.col("event") == "q").count() == 2
    assert [tuple(r) for r in records.first_by(spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "k string, i int, v string"), "k", "i").collect()] == [("k", 1, "a")]
    assert records.predictions(spark.createDataFrame([("i", "p", 'a/b:"c"')], "i string, p string, m string"), "i", "p", "m").first().model_name_or_path == "a_b__c_"
