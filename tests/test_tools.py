"""The tools by name, over the parsed sources of a small code base."""

import pytest
from test_sources import CLIENT, TESTS

from quernstone.operators import graph, tools
from quernstone.sources import code
from quernstone.sources.tables import written


@pytest.fixture(scope="module")
def sql(spark):
    files = spark.createDataFrame([("a/client.py", CLIENT), ("tests/test_client.py", TESTS)], "path string, code string")
    nodes = written(code.parsed(files, code.ParseNodes))
    edges = written(graph.concrete(code.parsed(files, code.ParseEdges).select("src", "dst", "kind"), nodes))
    commits = spark.createDataFrame([("a/client.py", f"c{i}", "2024-01-01", "me", f"s{i}", i) for i in range(9)], tools.TABLES["commits"])
    names = tools.register(spark, files=files, nodes=nodes, edges=edges, tests=written(code.parsed(files, code.ParseTests)), commits=commits)
    assert len(names) == 16
    return lambda q, *c: [tuple(r) for r in spark.sql(q).collect()]


def test_search(sql):
    assert sql("SELECT file, line_number, snippet FROM search_code('^def +h')") == [("a/client.py", 20, "def helper(x):")]
    assert sql("SELECT line_number FROM search_exact('(KeyError, ')") == [(17,)]
    assert sql("SELECT * FROM search_exact('')") == sql("SELECT * FROM search_code('')") == []
    assert sql("SELECT symbol, type, line_start FROM find_symbol('Client')") == [("Client", "class", 9)]
    assert [r[0] for r in sql("SELECT symbol FROM find_symbol('client')")] == ["test_client"]
    assert sql("SELECT file, line_number FROM find_references('helper')") == [("a/client.py", 16), ("a/client.py", 20)]
    assert sql("SELECT * FROM find_references('help')") == sql("SELECT * FROM find_references('h(')") == []


def test_reads(sql):
    assert sorted(sql("SELECT * FROM read_file('a/client.py', 20, 21)")) == [(20, "def helper(x):"), (21, "    return x")]
    assert len(sql("SELECT * FROM read_test('test_client')")) == 3
    assert sorted(sql("SELECT commit FROM inspect_git_history('a/client.py')")) == [(f"c{i}",) for i in (4, 5, 6, 7, 8)]


def test_graph(sql):
    assert sql("SELECT kind, line_start, signature FROM inspect_symbol('helper')") == [("FUNCTION", 20, "(x)")]
    assert sql("SELECT name FROM inspect_callers('helper')") == [("_run",)]
    assert sql("SELECT name FROM inspect_callees('a/client.py:Client._run')") == [("helper",)]
    assert sql("SELECT name FROM inspect_hierarchy('Base')") == [("Client",)] and sql("SELECT name FROM inspect_hierarchy('Client')") == [("Base",)]
    assert ("helper",) in sql("SELECT name FROM inspect_references('_run')")
    assert sql("SELECT test FROM inspect_tests('_run')") == [("test_client",)]
    got = sql("SELECT n.name, c.name FROM tool_nodes n, LATERAL inspect_callers(n.id) c")
    assert ("helper", "_run") in got and ("_run", "send") in got


def test_flow_and_failures(sql):
    assert ("IF", 12) in sql("SELECT kind, start_line FROM inspect_control_flow('a/client.py', '_run')")
    assert ("self.n", 14) in sql("SELECT variable, line FROM inspect_state_flow('a/client.py', 'Client._run') WHERE action = 'WRITE'")
    log = 'File "/x/a/client.py", line 17, in _run\\n  helper\\nFile "/x/a/client.py", line 21, in helper\\n'
    assert sorted(sql(f"SELECT depth, line, symbol FROM inspect_failure('{log}')")) == [(1, 17, "a/client.py:Client._run"), (2, 21, "a/client.py:helper")]
