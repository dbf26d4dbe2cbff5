"""Raw logs and texts of many shapes, written by Spark from the tables and read back: causes of failures, tracebacks, probes, commits, blame, interface terms.

The tables hold no logs, so the SQL reads the columns alone: what comes out must be what went in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import logs as L
from quernstone.operators import rules as Q
from quernstone.operators import verdicts as V
from quernstone.plans.outcome_queries import OUTCOME, outcomes
from quernstone.plans.registry import query
from quernstone.sources import code as C
from quernstone.sources.tables import dealt, dealt_by_rows, table

#: Lines of orders whose blame one task reads; each is two to three lines of text.
BLAMED_ROWS = 250_000


def _s(*parts):
    """Text from columns and strings."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _case(shape, cases: dict, otherwise):
    out = None
    for k, v in cases.items():
        v = F.lit(v) if isinstance(v, str | bool) else v
        out = F.when(shape == k, v) if out is None else out.when(shape == k, v)
    return out.otherwise(otherwise)


@query("failure_causes", f"""
WITH {OUTCOME} SELECT o_orderkey, CASE WHEN s IN (0, 3) THEN 'TIMEOUT' WHEN s IN (1, 2) THEN 'INFRA_FAILURE' WHEN s = 4 THEN 'REPAIR_SCHEMA_FAILURE' WHEN s = 5 THEN 'REPAIR_VALIDATION_FAILURE' WHEN s = 6 THEN 'REPAIR_OVEREXPANSION' WHEN s IN (7, 8) THEN 'PATCH_SYNTAX'
  WHEN f2p = f2p_total AND p2p = p2p_total THEN 'RESOLVED' WHEN f2p_total > 0 AND f2p = f2p_total THEN 'REGRESSION' WHEN f2p_total > 0 AND f2p > 0 THEN 'PATCH_SEMANTICS'
  WHEN f2p_total > 0 THEN CASE WHEN s = 9 THEN 'PATCH_SYNTAX' WHEN s IN (10, 12, 13) THEN 'PATCH_SEMANTICS' WHEN s = 11 THEN 'WRONG_LOCALIZATION' ELSE 'WRONG_HYPOTHESIS' END ELSE 'TEST_FAILURE' END AS cause FROM (SELECT *, o_orderkey % 16 AS s FROM fc)""")
def failure_causes(spark, d):
    """Orders as runs with errors, patches and outputs of sixteen shapes."""
    c, o = F.col, outcomes(spark, d)
    s, key = c("o_orderkey") % 16, c("o_custkey")
    files = lambda *x: F.array(*[F.lit(y) if isinstance(y, str) else y for y in x])
    mod, none = _s("src/mod_", key, ".py"), F.array().cast("array<string>")
    cause = Q.failure_cause(
        _case(s, {0: "Timeout after 300 s", 1: "daemon gone", 2: "could not apply", 3: "test TIMEOUT"}, F.lit(None).cast("string")), s.isin(0, 1), ~s.isin(4, 6, 7), _case(s, {5: " \n"}, F.lit("diff")),
        _case(s, {4: "Schema mismatch", 5: "Validation failed", 6: "over-expansion of lines"}, F.lit("")), ~s.isin(2, 8), (c("f2p") == c("f2p_total")) & (c("p2p") == c("p2p_total")), c("f2p"), c("f2p_total"), c("p2p"), c("p2p_total"),
        _case(s, {9: "E  IndentationError: x", 10: "cannot import name y", 12: _s('File "/r/src/mod_', key, '.py"'), 13: _s("in fn_", key)}, F.lit("nothing")),
        F.when(s == 11, files("a/x.py")).when(s == 12, files(mod)).when(s == 15, files("a.py")).otherwise(none), F.when(s == 11, files("b/y.py", "")).when(s == 12, files(mod)).when(s == 14, files("b.py")).when(s == 15, files("", "dir/a.py")).otherwise(none),
        _case(s, {14: "c.py"}, F.lit("")), _case(s, {13: _s("fn_", key)}, F.lit(None).cast("string")),
    )
    return o.select("o_orderkey", cause.alias("cause"))


@query("failure_inspection", """
WITH g AS (SELECT l_orderkey k, l_orderkey % 3 s, l_orderkey % 40 f, count(*) FILTER (l_returnflag <> 'N') AS n_failing FROM lineitem GROUP BY ALL)
SELECT k AS orderkey, n_failing, CASE s WHEN 1 THEN 0 WHEN 0 THEN 4 ELSE least(30, CASE WHEN f >= 19 THEN f + 2 ELSE f + 3 END) END::BIGINT AS n_lines,
  CASE s WHEN 1 THEN '' WHEN 0 THEN 'E   ValueError: ' || k ELSE CASE WHEN f >= 29 THEN '  frame' WHEN f >= 19 THEN '' ELSE 'tail ' || k END END AS last_line FROM g""")
def failure_inspection(spark, d):
    """An order's lines as a log with a traceback that ends at its error, none, or one of up to 40 frames without an error line."""
    c = F.col
    line = F.when(c("l_returnflag") == "A", _s("ERROR t::", c("l_linenumber"))).when(c("l_returnflag") == "R", _s("  FAILED t::", c("l_linenumber"))).otherwise(_s("PASSED t::", c("l_linenumber")))
    g = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("orderkey")).agg(F.array_sort(F.collect_list(F.struct(c("l_linenumber").alias("n"), c("l_partkey").alias("p"), c("l_suppkey").alias("s"), line.alias("x")))).alias("xs"))
    k = c("orderkey")
    trace = F.when(k % 3 == 0, _s("Traceback (most recent call last):\n  File \"a.py\", line 1, in f\n    x\nE   ValueError: ", k, "\nafter"))
    trace = trace.when(k % 3 == 2, F.concat(F.lit("Traceback (most recent call last):\n"), F.repeat(F.lit("  frame\n"), (k % 40).cast("int")), _s("\ntail ", k))).otherwise("")
    g = g.select("orderkey", F.concat(F.array_join(F.transform("xs", lambda x: x["x"]), "\n"), F.lit("\n"), trace).alias("log"))
    g = g.select("orderkey", L.inspected(c("log")).alias("i"))
    lines = F.when(c("i.traceback") == "", F.array().cast("array<string>")).otherwise(F.split("i.traceback", "\n"))
    return g.select("orderkey", F.size("i.failing").cast("long").alias("n_failing"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")).alias("last_line"))


@query("failure_details", """
SELECT o_orderkey, CASE s WHEN 0 THEN 'ValueError' WHEN 1 THEN 'AssertionError' WHEN 2 THEN 'KeyError' WHEN 3 THEN 'Error' ELSE '' END AS error_type,
  CASE s WHEN 0 THEN 'bad ' || o_custkey WHEN 1 THEN 'assert 1 == ' || o_custkey WHEN 2 THEN 'k' || o_custkey WHEN 3 THEN 'boom went: ' || o_custkey ELSE '' END AS error_message,
  CASE s WHEN 1 THEN '- 1' || chr(10) || '+ ' || o_custkey ELSE '' END AS diff, CASE s WHEN 0 THEN 'src/m_' || o_custkey || '.py:7' WHEN 1 THEN 'tests/test_a.py:3' WHEN 2 THEN 'lib/z.py:9' ELSE '' END AS locus FROM (SELECT *, o_orderkey % 6 AS s FROM orders)""")
def failure_details(spark, d):
    """Orders as logs: titled blocks, a diff, an error without E lines, text only after the name, another test's block, none."""
    c = F.col
    s, k = c("o_orderkey") % 6, c("o_custkey")
    other = "____ T.test_b ____\nE   TypeError: other\nz/q.py:1: in g\n"
    log = F.when(s == 0, _s("head\n", other, "_____ T.test_a _____\ntests/test_a.py:3: in test\nsrc/m_", k, ".py:7: in f\n/opt/x.py:1: in g\n  E   ValueError: bad ", k, "\n_____ T.test_c _____\nE   OSError: no\n"))
    log = log.when(s == 1, _s("___ test_a ___\ntests/test_a.py:3: in t\nE   assert 1 == ", k, "\nE   - 1\nE   + ", k, "\n=== short test summary info ===\nFAILED x\n"))
    log = log.when(s == 2, _s("FAILED tests/x.py::test_a\nlib/z.py:9: KeyError: k", k, "\n==== FAILURES ====\n", other))
    log = log.when(s == 3, _s("so test_a went wrong\nE boom went: ", k, "\n")).when(s == 4, F.lit("all passed"))
    out = dealt(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", L.details(log.otherwise(F.lit(None).cast("string")), F.lit("tests/x.py::test_a")).alias("i"))
    return out.select("o_orderkey", F.inline(F.array("i")))


@query("sentinel_log", """
WITH e AS (SELECT user_id, event_id // 500 AS b, event_id, event_type, CASE WHEN event_type = 'error' THEN 'ERR:' || event_id ELSE event_id::VARCHAR END AS v FROM events WHERE event_id % 5 > 0)
SELECT user_id || '/' || b AS run, event_type AS probe, observed, hits, 'out __PF_PROBE__:' || event_type || ':' || first AS first_raw, CASE WHEN event_type = 'error' THEN lo::VARCHAR END AS exception
FROM (SELECT user_id, b, event_type, arg_max(v, event_id) observed, count(*) AS hits, arg_min(v, event_id) AS first, min(event_id) lo FROM e GROUP BY user_id, b, event_type)""")
def sentinel_log(spark, d):
    """A user's events as lines of runs, some without a probe's mark."""
    c = F.col
    value = F.when(c("event_type") == "error", _s("ERR:", c("event_id"))).otherwise(c("event_id").cast("string"))
    line = F.when(c("event_id") % 5 == 0, _s("noise ", c("event_id"))).otherwise(_s("  out __PF_PROBE__:", c("event_type"), ":", value, " "))
    runs = table(spark, d, "events").groupBy(_s(c("user_id"), "/", F.expr("event_id div 500")).alias("run")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("x")))).alias("xs"))
    return L.sentinels(runs.select("run", F.array_join(F.transform("xs", lambda x: x["x"]), "\n").alias("log")), "run", "log")


@query("commit_log", """
SELECT o_custkey, 'h' || o_orderkey AS hash, 'author ' || o_custkey AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey END::DOUBLE AS ts, CASE WHEN o_orderkey % 3 = 0 THEN 'Fixes ' || o_orderpriority ELSE 'add ' || o_orderpriority END AS message,
  o_orderkey % 3 = 0 AS is_fix, CASE WHEN o_orderkey % 2 = 0 THEN 'src/m' || o_orderkey || '.py,b.py' ELSE '' END AS files FROM orders WHERE o_orderkey % 11 > 0""")
def commit_log(spark, d):
    """A customer's orders as a log of commits: subjects with and without a fix, bad times, paths with backslashes, other files, broken headers."""
    c = F.col
    key = c("o_orderkey")
    subject = F.when(key % 3 == 0, _s("Fixes ", c("o_orderpriority"))).otherwise(_s("add ", c("o_orderpriority")))
    head = F.when(key % 11 == 0, F.lit("COMMIT|broken|x")).otherwise(_s("COMMIT|h", key, "|author ", c("o_custkey"), "|", F.date_format("o_orderdate", "yyyy-MM-dd"), "|", F.when(key % 4 == 0, F.lit("soon")).otherwise(key.cast("string")), "|", subject, "|more"))
    block = _s(head, "\n", F.when(key % 2 == 0, _s("src\\m", key, ".py\n  b.py\nREADME.md\n\n")).otherwise(F.lit("notes.txt\r\n")))
    logs = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("x")))), lambda x: x["x"]), "\n").alias("log"))
    x = logs.select("o_custkey", F.explode(L.commits(c("log"))).alias("x"))
    return x.select("o_custkey", "x.hash", "x.author", "x.date", "x.ts", "x.message", "x.is_fix", F.array_join("x.files", ",").alias("files"))


@query("file_history", """
SELECT o_custkey, 'h' || o_orderkey AS hash, 'a' AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority || ' | ' || o_orderstatus AS message FROM orders WHERE o_orderkey % 6 > 0""")
def file_history(spark, d):
    """A customer as a file, its orders as lines of its log; the subject holds a bar, broken lines are none."""
    c = F.col
    line = F.when(c("o_orderkey") % 6 == 0, _s("h", c("o_orderkey"), "|only")).otherwise(_s("h", c("o_orderkey"), "|a|", F.date_format("o_orderdate", "yyyy-MM-dd"), "|", c("o_orderpriority"), " | ", c("o_orderstatus")))
    logs = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(line), "\n").alias("log"))
    return logs.select("o_custkey", F.explode(L.file_log(c("log"))).alias("x")).select("o_custkey", "x.*")


@query("blame_lines", """
WITH l AS (SELECT l_orderkey k, l_linenumber n, l_partkey p, l_suppkey s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) r FROM lineitem)
SELECT k AS orderkey, r AS nth, 'hash' || lpad((last_value(CASE WHEN r % 3 = 1 THEN p END IGNORE NULLS) OVER w)::VARCHAR, 8, '0') AS hash, 'Ann ' || last_value(CASE WHEN r % 3 = 1 THEN s END IGNORE NULLS) OVER w AS author, 'summary of ' || last_value(CASE WHEN r % 3 = 1 THEN n END IGNORE NULLS) OVER w AS summary, 'code ' || n AS content
FROM l WINDOW w AS (PARTITION BY k ORDER BY r)""")
def blame_lines(spark, d):
    """An order as a file: every third line has a header of its own, the lines below it have none."""
    c = F.col
    xs = F.array_sort(F.collect_list(F.struct(c("l_linenumber").alias("n"), c("l_partkey").alias("p"), c("l_suppkey").alias("s"), c("l_quantity").alias("q"))))
    head = lambda x: _s("hash", F.lpad(x["p"].cast("string"), 8, "0"), " 1 2 3\nauthor Ann ", x["s"], "\nauthor-mail <a@b>\nsummary summary of ", x["n"], "\nfilename f.py\n")
    text = F.transform(xs, lambda x, i: F.concat(F.when(i % 3 == 0, head(x)).otherwise(F.lit("")), _s("\tcode ", x["n"])))
    lines = table(spark, d, "lineitem")
    lines = dealt_by_rows(lines.withColumnRenamed("l_orderkey", "orderkey"), lines.count(), "orderkey", each=BLAMED_ROWS)
    logs = lines.groupBy("orderkey").agg(F.array_join(text, "\n").alias("log"))
    out = L.blamed(logs, "orderkey", "log")
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("orderkey").orderBy("at")).cast("long")
    return out.select("orderkey", nth.alias("nth"), "hash", "author", "summary", "content")


@query("contract_terms", """
WITH o AS (SELECT *, o_orderkey % 5 AS s FROM orders)
SELECT o_orderkey, CASE s WHEN 0 THEN 'mode' WHEN 3 THEN 'flagged' ELSE '' END AS forbidden, CASE s WHEN 0 THEN 'text' WHEN 1 THEN 'encoding' WHEN 2 THEN 'p_' || o_custkey ELSE '' END AS parameters,
  CASE s WHEN 1 THEN 'socket.error_' || o_custkey || 'Error' WHEN 4 THEN 'KeyError' ELSE '' END AS handled, CASE s WHEN 1 THEN 'LibError' WHEN 4 THEN 'ValueError,OSError' ELSE '' END AS expected FROM o""")
def contract_terms(spark, d):
    """Orders as issues with hints: an assigned and a rejected parameter, one of prose backed by the hints, one backed by the target, none where the signature is not at issue, exceptions alone."""
    c = F.col
    s, k = c("o_orderkey") % 5, c("o_custkey")
    problem = F.when(s == 0, F.lit("Please add a parameter rather than mode strings.")).when(s == 1, _s("Accept a keyword argument: the encoding argument. Catch socket.error_", k, "Error and wrap in LibError."))
    problem = problem.when(s == 2, _s("load should support a flag: parameter p_", k, " and the name parameter")).when(s == 3, F.lit("avoid flagged; use `x=1`")).otherwise("handle KeyError, then raise ValueError or throw OSError; raise ValueError")
    hints = F.when(s == 0, F.lit("maybe `text=False` or self=None, mode='r'")).when(s == 1, F.lit("encoding it is, `encoding=None`")).otherwise(F.lit(None).cast("string"))
    target = F.when(s == 2, "load").otherwise("")
    text = F.concat_ws("\n", problem, F.coalesce(hints, F.lit("")))
    kind, _ = Q.contract_category(text, F.coalesce(hints, F.lit("")))
    out = table(spark, d, "orders").select("o_orderkey", L.contract_terms(problem, hints, target, kind.isin("API_SIGNATURE", "MIXED")).alias("i"))
    return out.select("o_orderkey", *[F.array_join(f"i.{x}", ",").alias(x) for x in ("forbidden", "parameters", "handled", "expected")])


@query("static_gate", """
SELECT o_orderkey, CASE s WHEN 1 THEN 'LEAK,SYNTAX' WHEN 2 THEN 'SYNTAX' WHEN 3 THEN 'UNCHANGED' WHEN 4 THEN 'EXPANSION' WHEN 5 THEN 'REMOVED' WHEN 6 THEN 'SIGNATURE' WHEN 7 THEN 'LEAK,EXPANSION,REMOVED' ELSE '' END AS errors,
  CASE s WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 151 WHEN 5 THEN 0 WHEN 7 THEN 151 ELSE 1 END::BIGINT AS added FROM (SELECT *, o_orderkey % 9 AS s FROM orders)""")
def static_gate(spark, d):
    """Orders as revisions of a small source: good, a diff mark, broken, unchanged, too long, a function gone, a parameter missing, all at once, a good new symbol."""
    c = F.col
    s = c("o_orderkey") % 9
    before = _s("def a(x, text=1):\n    return ", c("o_custkey"), "\n\ndef b():\n    pass\n")
    more = lambda n: F.repeat(F.lit("z = 1\n"), F.lit(n))
    after = _case(s, {
        0: _s("def a(x, text=1):\n    return -", c("o_custkey"), "\n\ndef b():\n    pass\n"), 1: F.concat(before, F.lit("@@ -1 @@\nx = 1\n")), 2: F.concat(before, F.lit("def (:\n")), 3: before, 4: F.concat(before, more(151)),
        5: _s("def a(x, text=1):\n    return ", c("o_custkey"), "\n"), 6: _s("def a(x):\n    return ", c("o_custkey"), "\n\ndef b():\n    pass\n"), 7: _s("def a(x, text=1):\n    return ", c("o_custkey"), "\n\ns = '```'\n", more(150)),
    }, F.concat(before, F.lit("c = b\n")))
    o = dealt(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", before.alias("x"), after.alias("y")).withColumn("f", C.revision("x", "y"))
    errors = V.static_gate(c("x"), c("y"), c("f"), F.array(F.lit("a")), F.array(F.lit("text")))
    return o.select("o_orderkey", F.array_join(errors, ",").alias("errors"), c("f.added").alias("added"))
