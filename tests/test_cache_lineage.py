import random

from pyspark.sql import functions as F

from quernstone.operators import graph
from quernstone.sources import cache, code, records


def test_only_changed_files_are_parsed(spark, tmp_path):
    folder = str(tmp_path / "cache")
    text = {f"p{i}.py": f"def f{i}():\n    g{i}()\n" for i in range(30)} | {"empty.py": "", "bad.py": "def ("}
    frame = lambda t: spark.createDataFrame(list(t.items()), "path string, code string")

    def check(t, want):
        rows, n = cache.refreshed(frame(t), folder, buckets=8)
        assert n == want
        fresh = code.parsed(frame(t), code.ParseEdges)
        assert sorted(map(repr, rows.select(*sorted(rows.columns)).collect())) == sorted(map(repr, fresh.select(*sorted(fresh.columns)).collect()))

    check(text, 32)
    check(text, 0)
    text |= {"p3.py": "def f3():\n    h()\n", "new.py": "import os\n"}
    del text["p7.py"]
    check(text, 2)
    check(text, 0)
    back = {k: v for k, v in text.items() if k in ("p1.py", "p2.py")}
    check(back, 0)
    check(text, len(text) - 2)


def test_failed_run_leaves_the_old_state(spark, tmp_path):
    folder = str(tmp_path / "cache")
    files = spark.createDataFrame([("a.py", "def a(): b()"), ("c.py", "def c(): d()")], "path string, code string")
    before = cache.refreshed(files, folder)[0].count()
    failing = files.withColumn("code", F.when(F.col("path") == "a.py", F.raise_error(F.lit("no"))).otherwise(F.col("code")))
    try:
        cache.refreshed(failing, folder)
        raise AssertionError("must fail")
    except Exception as e:
        assert "must fail" not in str(e)
    assert spark.read.parquet(folder).where("path IS NOT NULL").selectExpr("inline(rows)").count() == before
    assert cache.refreshed(files, folder)[1] == 0


def test_lineage(spark):
    rng = random.Random(1)
    up = {i: (rng.randrange(i) if i and rng.random() < 0.95 else None) for i in range(200)}
    up |= {200 + i: 199 + i for i in range(1, 150)} | {200: None}  # a chain
    up |= {900: 901, 901: 902, 902: 900, 903: 902, 904: 904, 905: 904, 950: 12345}  # cycles, what leads into them, and a parent that is not there
    got = {r.node: (r.root, r.depth) for r in graph.lineage(spark.createDataFrame(list(up.items()), "n long, p long"), "n", "p").collect()}
    for n in up:
        at, depth, seen = n, 0, set()
        while at is not None and at in up and at not in seen and up[at] is not None:
            seen.add(at)
            at, depth = up[at], depth + 1
        want = (at, depth) if at in up and up[at] is None else (None, None)
        assert got[n] == want, n
    assert graph.lineage(spark.createDataFrame([], "n long, p long"), "n", "p").count() == 0


def test_reports_of_one_run(spark, tmp_path):
    put = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text))
    put("run_evaluation/r1/a/report.json", '{"i1": {"resolved": true}, "i2": {"tests_status": {}}, "i3": {"note": 1}, "i4": 5}')
    put("run_evaluation/r1/b/report.json", '{"i1": {"resolved": false}, "i3": {"resolved": false}}')
    put("evaluation/r1/c.json", '{"instance_id": "i5", "result": {"resolved": true}}')
    put("evaluation/r1/bad.json", "{")
    put("evaluation/r1/list.json", "[1]")
    put("run_evaluation/r2/report.json", '{"i9": {"resolved": true}}')
    got = {r.instance: r.resolved for r in records.run_reports(spark, str(tmp_path), "r1").collect()}
    assert got == {"i1": True, "i2": None, "i3": False, "i5": True}
    files = records.run_reports(spark, str(tmp_path), "r2").inputFiles()
    assert [f.rsplit("/", 2)[1] for f in files] == ["r2"]  # no file of another run is opened
    assert records.run_reports(spark, str(tmp_path), "none").count() == 0


def test_published_versions(spark, tmp_path):
    folder = str(tmp_path / "report")
    report = spark.sql("SELECT id, CASE WHEN id = 3 THEN NULL ELSE 'PENDING' END AS status, struct(id AS a, array(id, 1) AS b) AS more FROM range(5)")
    assert records.publish(report, folder) == 0 and records.publish(report, folder) == 0
    ledger = spark.createDataFrame([(1, "FINAL"), (2, None), (7, "FINAL")], "id long, status string")
    new = records.renewed(records.latest(spark, folder, report.schema), ledger, "id", ["status"])
    assert records.publish(new, folder) == 1 and records.publish(records.renewed(new, ledger, "id", ["status"]), folder) == 1
    rows = {r.id: (r.status, r.more.b) for r in records.latest(spark, folder, report.schema).collect()}
    assert rows == {i: ("FINAL" if i == 1 else None if i == 3 else "PENDING", [i, 1]) for i in range(5)}
    try:
        records.publish(new.withColumn("status", F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("status"))), folder)
        raise AssertionError("must fail")
    except Exception as e:
        assert "must fail" not in str(e)
    assert records.versions(spark, folder) == [0, 1] and records.latest(spark, folder, report.schema).where("status = 'FINAL'").count() == 1
