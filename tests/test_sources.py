import datetime as dt

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import graph, rules, search, spans, temporal
from quernstone.sources import code
from quernstone.streaming import intake

CLIENT = '''import os
from net import http

class Base:
    """Base."""
    def send(self, x):
        return self._run(x)

class Client(Base):
    @cached
    def _run(self, x, *, y=1):
        if x:
            for i in x:
                self.n = i
        try:
            return helper(x)
        except (KeyError, ValueError):
            raise RuntimeError(x)

def helper(x):
    return x
'''
TESTS = '''def test_client(client):
    c = Client()
    assert c._run(1) == 1
'''


def files(spark):
    return spark.createDataFrame([("a/client.py", CLIENT), ("tests/test_client.py", TESTS), ("bad.py", "def ("), ("none.py", None)], "path string, code string")


def test_parse(spark):
    f = files(spark)
    nodes = {(r.id, r.kind) for r in code.parsed(f, code.ParseNodes).collect()}
    assert {("a/client.py:Base", "CLASS"), ("a/client.py:Client._run", "METHOD"), ("a/client.py:helper", "FUNCTION"), ("tests/test_client.py:test_client", "TEST")} <= nodes
    edges = {(r.src, r.dst, r.kind) for r in code.parsed(f, code.ParseEdges).collect()}
    run = "a/client.py:Client._run"
    assert {("a/client.py", "net.http", "IMPORTS"), ("a/client.py:Client", "symbol:Base", "INHERITS"), (run, "symbol:helper", "CALLS"), (run, "symbol:RuntimeError", "RAISES"), (run, "symbol:KeyError", "CATCHES"), (run, "symbol:cached", "DECORATES"), ("tests/test_client.py:test_client", "symbol:Client", "TESTS")} <= edges
    tests = code.parsed(f, code.ParseTests).collect()
    assert [(t.name, t.assertions[0].line, t.fixtures) for t in tests] == [("test_client", 3, ["client"])]
    blocks = {(r.block, r.parent, r.kind) for r in code.parsed(f, code.ParseBlocks).where("function like '%_run'").collect()}
    assert {(0, None, "ENTRY"), (1, 0, "IF"), (2, 1, "LOOP"), (3, 0, "TRY")} <= blocks
    writes = [r.variable for r in code.parsed(f, code.ParseState).where("action = 'WRITE'").collect()]
    assert "self.n" in writes
    assert [r.path for r in code.parse_errors(f).collect()] == ["bad.py"]
    code.register(spark)
    f.createOrReplaceTempView("files")
    assert spark.sql("SELECT count(*) FROM files, LATERAL parse_nodes(path, code)").first()[0] == len(nodes)


def test_source_files(spark, tmp_path):
    for p in ("a/x.py", "venv/y.py", "b/test_z.py", "c/w.txt", "d.egg-info/q.py"):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text("x = 1")
    got = {(r.path.rsplit("/", 1)[-1], r.code) for r in code.source_files(spark, str(tmp_path)).collect()}
    assert got == {("x.py", "x = 1"), ("test_z.py", "x = 1")}


def test_traceback_frames(spark):
    log = 'File "/x/site-packages/p.py", line 3, in f\nFile "a/b.py", line 12, in run\n'
    df = spark.createDataFrame([(log,)], "log string").select(F.transform(code.traceback_frames(F.col("log")), lambda x: x["file"]).alias("f"))
    assert df.first().f == ["a/b.py"]


def test_hand_worked_formulas(spark):
    one = spark.range(1)
    assert one.select(temporal.churn(F.lit(1), F.lit(1))).first()[0] == 0.15
    kind, score = graph.radius(F.lit(5), F.lit(1), F.lit(2), F.lit(120))
    assert tuple(one.select(kind, score).first()) == ("SHARED", 6.0)
    assert one.select(rules.coverage(F.lit(1), F.lit(3))).first()[0] == 33.3
    assert one.select(rules.coverage(F.lit(1), F.lit(0))).first()[0] == 0.0
    words = spark.createDataFrame([("ties",), ("running",), ("parties",), ("boxes",), ("runs",), ("lasted",)], "w string")
    assert [r[0] for r in words.select(T.stem(F.col("w"))).collect()] == ["ties", "runn", "party", "box", "runs", "last"]
    pairs = spark.createDataFrame([("a/b.py", "b.py", True), ("a/b.py", "c/b.py", False), ("x/a/b.py", "a/b.py", True), ("a/bb.py", "b.py", False)], "a string, b string, w boolean")
    assert all(r.m == r.w for r in pairs.select(T.paths_match(F.col("a"), F.col("b")).alias("m"), "w").collect())
    assert one.select(T.grams(F.lit("ab"))).first()[0] == ["^ab", "ab$"] and one.select(T.grams(F.lit(""))).first()[0] == ["^$"]
    text = spark.createDataFrame([("a.b+c here", "b+c", True), ("ab", "a", False), ("x a.b", "a.b", True)], "t string, s string, w boolean")
    assert all(r.m == r.w for r in text.select(T.mentions(F.col("t"), F.col("s")).alias("m"), "w").collect())


def test_empty_texts_score_nothing(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha gamma"), (2, None)], "item_id long, text string")
    rows = search.searched(q, docs, "item_id", "doc_id", 5, "lexical").collect()
    assert [(r.item_id, r.doc_id) for r in rows] == [(1, 1)] and 0 < rows[0].lexical <= 1
    assert search.searched(q.limit(0), docs, "item_id", "doc_id", 5).count() == 0 == search.searched(q, docs.limit(0), "item_id", "doc_id", 5).count()


def test_search_in_several_passes_and_slices(spark, sf, monkeypatch):
    docs, q = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    for by in ("lexical", "dense", "score"):
        rows = lambda: sorted(map(repr, search.searched(q, docs.repartition(3), "item_id", "doc_id", 4, by).collect()))  # noqa: B023, E731
        want = rows()
        with monkeypatch.context() as m:
            m.setattr(search, "MOST_WORDS", 300)
            assert rows() == want
    few = search.Weights([(1, ["ab", "abc"])], {}, 3, 2.0)
    assert len(few.words) == 2 and [tuple(x) for x in zip(*search.gram_codes(few.words))] == [(94 | 97 << 7 | 98 << 14, 0), (97 | 98 << 7 | 36 << 14, 0), (94 | 97 << 7 | 98 << 14, 1), (97 | 98 << 7 | 99 << 14, 1), (98 | 99 << 7 | 36 << 14, 1)]


def test_innermost_span(spark):
    s = spark.createDataFrame([("f", "outer", 1, 100), ("f", "inner", 40, 50), ("g", "outer", 1, 9)], "file string, symbol string, lo long, hi long")
    p = spark.createDataFrame([("f", 45), ("f", 60), ("f", 101), ("g", 9)], "file string, line long")
    assert {(r.file, r.line, r.symbol) for r in spans.innermost(p, s, "file", "line").collect()} == {("f", 45, "inner"), ("f", 60, "outer"), ("g", 9, "outer")}
    assert [tuple(r) for r in spans.uncovered(p, s, "file", "line").collect()] == [("f", 101)]


def test_deliveries_over_several_batches(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    batches = [[(1, "a", day, 5.0), (2, "a", day, 5.0), (3, "b", day, 0.0)], [(4, "a", day + dt.timedelta(hours=1), 5.0), (5, "b", day + dt.timedelta(hours=2), 5.0), (6, None, day, 5.0), (7, None, day, 5.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, k string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    schema = spark.read.parquet(str(tmp_path / "events.parquet")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events.parquet"))
    out = intake.drained(intake.first_deliveries(stream, F.col("k"), F.col("value") > 1), "append").collect()
    assert sorted(str(r.k) for r in out) == ["None", "None", "a", "b"] and 5 in {r.event_id for r in out}
