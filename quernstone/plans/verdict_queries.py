"""Answers, logs and verdicts over events, orders, lineitem, part, customer, documents and conversations.

The tables hold no answers or logs; where a query parses some, Spark writes them from the columns first, and the SQL
reads the columns alone: what comes out must be what went in.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import answers as A
from quernstone.functions import text as T
from quernstone.operators import verdicts as V
from quernstone.plans.outcome_queries import OUTCOME, outcomes
from quernstone.plans.registry import query
from quernstone.sources.tables import table


@query("json_answers", """
SELECT event_id, event_type, CASE WHEN event_id % 9 IN (0, 1, 2, 5, 7) THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) WHEN event_id % 9 = 6 THEN 7 END AS k FROM events""")
def json_answers(spark, d):
    """Answers of nine shapes: a fenced object, one behind thoughts, a bare one, a broken one, none, a fence after other braces, a nested one, thoughts without an end, two objects."""
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    props, shape = F.col("props"), F.col("event_id") % 9
    s = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    shapes = [
        s("Here {it} is:\n```json\n", props, "\n```\nDone."), s('<think>maybe {"k": 0}</think>The answer is ', props, "."), props, s("{", props), F.lit("none"),
        s("Use {x} or {y}.\n```\n", props, "\n```\nand {z}"), s('So {"a": ', props, ', "k": 7} it is'), s("<think>this never ends ", props), s(props, " and ", props),
    ]
    answer = F.when(shape == 0, shapes[0])
    for i, x in enumerate(shapes[1:], 1):
        answer = answer.when(shape == i, x)
    return e.select("event_id", "event_type", F.get_json_object(A.json_body(answer), "$.k").try_cast("long").alias("k"))


@query("report_sections", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN '' ELSE o_orderpriority END AS cause, CASE WHEN o_orderkey % 7 IN (3, 5) THEN '' ELSE 'keep ' || o_orderstatus END AS invariant,
  CASE WHEN o_orderkey % 7 IN (4, 6) THEN 0.95 ELSE (o_custkey % 101)::DOUBLE / CASE WHEN o_custkey % 101 > 1 THEN 100 ELSE 1 END END AS confidence,
  CASE WHEN o_orderkey % 7 = 6 THEN 'confirmed_code_defect' ELSE CASE o_orderstatus WHEN 'O' THEN 'ambiguous' WHEN 'P' THEN 'test_only_issue' ELSE 'confirmed_code_defect' END END AS class,
  CASE WHEN o_orderkey % 7 = 6 THEN '' WHEN o_orderkey % 7 = 2 THEN '3d/model_' || o_orderkey || '.py,2) customer_' || o_custkey ELSE 'order/' || o_orderkey || '.py,customer_' || o_custkey END AS sites,
  CASE WHEN o_orderkey % 7 IN (2, 3, 5) THEN 'seen ' || o_custkey || ',0 of 3' ELSE '' END AS evidence FROM orders""")
def report_sections(spark, d):
    """Reports with headed sections, written from orders in seven shapes and read back: usual, lower case, numbered sites below
    a rule, no cause, no number, Windows lines without an invariant, no sections but a cause and an invariant."""
    o, c = table(spark, d, "orders"), F.col
    s = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    shape, key, who = c("o_orderkey") % 7, c("o_orderkey").cast("string"), c("o_custkey").cast("string")
    label = F.when(c("o_orderstatus") == "O", "Ambiguous").when(c("o_orderstatus") == "P", "TEST_ONLY_ISSUE").otherwise("none")
    about = F.when(shape == 4, F.lit("I am sure")).otherwise(s("about ", (c("o_custkey") % 101).cast("string"), " %"))
    cause = s("=== CAUSE ===\n", c("o_orderpriority"), "\n\n")
    invariant = s("=== Invariant ===\n  keep ", c("o_orderstatus"), "\n")
    evidence = s("=== EVIDENCE ===\n1. seen ", who, "\n\n * - 2) 0 of 3\n")
    sure = s("=== DEFECT CONFIDENCE ===\n", about, ", ", label, "\n")
    sites = s("=== AFFECTED SITES ===\n- order/", key, ".py\n\n* customer_", who, "\n")
    odd = s("=== AFFECTED SITES ===\n======\n- 3d/model_", key, ".py\n-* 2) customer_", who, "\n===\n")
    report = (
        F.when(shape == 1, s("=== cause ===\n", c("o_orderpriority"), "\n=== invariant === keep ", c("o_orderstatus"), "\n=== defect confidence ===\n", about, " ", F.lower(label), "\n=== affected sites ===\norder/", key, ".py\ncustomer_", who))
        .when(shape == 2, s(cause, invariant, evidence, sure, odd)).when(shape == 3, s(evidence, sure, sites))
        .when(shape == 5, F.regexp_replace(s("Done.\n", cause, evidence, sure, sites), "\n", "\r\n")).when(shape == 6, s("99 %, ambiguous\n", cause, invariant))
        .otherwise(s("Thinking.\n", cause, invariant, sure, sites))
    )
    o = o.select("o_orderkey", report.alias("r"))
    sure = A.section(c("r"), "DEFECT CONFIDENCE", ("REPAIR STRATEGY", "REPAIR JUSTIFICATION", "AFFECTED SITES"))
    return o.select(
        "o_orderkey", A.section(c("r"), "CAUSE", ("EXPECTED BEHAVIOR", "INVARIANT", "EVIDENCE")).alias("cause"), A.section(c("r"), "INVARIANT", ("EVIDENCE", "DEFECT CONFIDENCE", "REPAIR STRATEGY")).alias("invariant"),
        A.confidence(sure).alias("confidence"), A.report_class(sure).alias("class"), F.concat_ws(",", A.listed(A.section(c("r"), "AFFECTED SITES"))).alias("sites"),
        F.concat_ws(",", A.numbered(A.section(c("r"), "EVIDENCE", ("DEFECT CONFIDENCE", "REPAIR STRATEGY", "REPAIR JUSTIFICATION")))).alias("evidence"),
    )


@query("test_log_outcomes", """
WITH l AS (SELECT l_orderkey k, l_linenumber n, l_partkey p, l_quantity::BIGINT q, l_returnflag f, 't/' || l_orderkey || '.py::p' || l_partkey || '_' || l_linenumber || '_' || l_suppkey || '_' || l_quantity::BIGINT id FROM lineitem),
b AS (SELECT k, min((n, id, q)) x FROM l WHERE f <> 'N' GROUP BY k)
SELECT l.k AS orderkey, count(*) FILTER (f = 'N') AS n_passed, count(*) FILTER (f <> 'N') AS n_failed, coalesce(any_value(x[2]), '') AS first_failed,
  CASE WHEN any_value(x[2]) IS NOT NULL THEN any_value(x[3])::VARCHAR ELSE '' END AS actual, CASE WHEN any_value(x[2]) IS NOT NULL THEN '0' ELSE '' END AS expected FROM l LEFT JOIN b ON b.k = l.k GROUP BY l.k""")
def test_log_outcomes(spark, d):
    """An order's lines as the outcome lines of its log (an order has a handful), parsed back into ids and counts."""
    c, s = F.col, lambda x: F.col(x).cast("string")
    quantity = c("l_quantity").cast("long").cast("string")
    test = F.concat(F.lit("t/"), s("l_orderkey"), F.lit(".py::p"), s("l_partkey"), F.lit("_"), s("l_linenumber"), F.lit("_"), s("l_suppkey"), F.lit("_"), quantity)
    bad = F.concat(F.when(c("l_returnflag") == "A", "ERROR ").otherwise("FAILED "), test, F.lit(" - AssertionError"))
    line = F.when(c("l_returnflag") == "N", F.concat(F.lit("PASSED "), test)).otherwise(F.concat(bad, F.lit("\nE   AssertionError: assert "), quantity, F.lit(" == 0")))
    logs = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("orderkey")).agg(F.array_sort(F.collect_list(F.struct(c("l_linenumber").alias("n"), test.alias("t"), line.alias("l")))).alias("x"))
    logs = logs.select("orderkey", F.concat_ws("\n", F.transform("x", lambda e: e["l"])).alias("log"))
    first = A.assertion_failure(c("log"))
    return logs.select("orderkey", F.size(A.passed_tests(c("log"))).cast("long").alias("n_passed"), F.size(A.failed_tests(c("log"))).cast("long").alias("n_failed"), first["test_id"].alias("first_failed"), first["actual"].alias("actual"), first["expected"].alias("expected"))


@query("edit_blocks", """
SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN 'b/c.py' ELSE 'src/' || conv_id || '.py' END AS file, CASE turn % 4 WHEN 0 THEN 2 WHEN 2 THEN 3 ELSE 1 END::BIGINT AS n_edits, CASE turn % 4 WHEN 3 THEN md5('') ELSE md5(coalesce(text, '')) END AS search, CASE turn % 4 WHEN 3 THEN 'new' ELSE role END AS replace FROM conversations""")
def edit_blocks(spark, d):
    """Turns as edits in four shapes: there and back, one block, blocks of two files with one that never ends, a block before any heading and one with nothing to search."""
    c = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    block = lambda a, b: F.concat(F.lit("\n<<<<<<< SEARCH\n"), a, F.lit("\n=======\n"), b, F.lit("\n>>>>>>> REPLACE\n"))
    lit, shape = F.lit, F.col("turn") % 4
    head = F.concat(lit("I change this.\n### `src/"), F.col("conv_id").cast("string"), lit(".py` :: f"))
    one = F.concat(head, block("text", "role"))
    answer = (
        F.when(shape == 0, F.concat(one, block("role", "text"))).when(shape == 2, F.concat(one, lit("\nand\n### d.py\n"), block(lit("x"), lit("")), block(lit("y"), lit("z\nz")), lit("\n<<<<<<< SEARCH\nopen\n=======\n")))
        .when(shape == 3, F.concat(block("text", "role"), lit("### b/c.py"), block(lit(""), lit("new")), lit("### e.py\nnothing"))).otherwise(one)
    )
    e = c.select("conv_id", "turn", A.edits(answer).alias("e"))
    one = F.col("e")[0]
    return e.select("conv_id", "turn", one["file"].alias("file"), F.size("e").cast("long").alias("n_edits"), F.md5(one["search"].cast("binary")).alias("search"), one["replace"].alias("replace"))


@query("revision_profile", r"""
WITH t AS (SELECT conv_id, turn, role, text, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '([a-zA-Z_][a-zA-Z0-9_]*)', 1)) w, string_split(coalesce(text, ''), chr(10)) l FROM conversations),
p AS (SELECT *, lag(w) OVER o pw, lag(l) OVER o pl FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, role, len(l)::BIGINT AS added, len(pl)::BIGINT AS deleted, len(list_filter(pw, lambda x: NOT list_contains(w, x) AND x <> role))::BIGINT AS n_removed, list_min(list_filter(pw, lambda x: NOT list_contains(w, x) AND x <> role)) AS first_removed
FROM p WHERE pw IS NOT NULL""")
def revision_profile(spark, d):
    """Each turn as a revision of the one before it: diff lines, and the symbols that went without being a target."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").withColumns({"before": F.lag(F.coalesce("text", F.lit(""))).over(w)}).where("before IS NOT NULL")
    lines = lambda x, sign: F.concat_ws("\n", F.transform(F.split(F.coalesce(F.col(x), F.lit("")), "\n"), lambda y: F.concat(F.lit(sign + " "), y)))
    counts = A.diff_counts(F.concat(F.lit("--- a\n+++ b\n"), lines("before", "-"), F.lit("\n"), lines("text", "+")))
    gone = A.removed(T.token_set(F.col("before")), T.token_set(F.col("text")), F.array("role"))
    c = c.select("conv_id", "turn", "role", counts.alias("n"), gone.alias("gone"))
    return c.select("conv_id", "turn", "role", "n.added", "n.deleted", F.size("gone").cast("long").alias("n_removed"), F.array_min("gone").alias("first_removed"))


@query("symbol_points", r"""
WITH p AS (SELECT p_partkey, p_brand, p_type, string_split(p_name, ' ') w, p_size FROM part)
SELECT p_partkey, w[1] AS name, CASE WHEN length(w[1]) = 0 THEN 0 WHEN p_size % 4 = 0 THEN 30 WHEN p_size % 4 = 1 THEN 25 WHEN p_size % 4 = 2 THEN CASE WHEN p_size > 25 THEN 20 WHEN length(w[1]) >= 6 THEN 15 ELSE 8 END ELSE 0 END::DOUBLE AS points FROM p""")
def symbol_points(spark, d):
    """The first word of a part's name as a symbol; its size says how the issue names it: dotted call, backticks, prose, or only inside another word."""
    p = table(spark, d, "part").withColumn("name", F.split("p_name", " ")[0])
    way = F.col("p_size") % 4
    issue = (
        F.when(way == 0, F.concat(F.lit("then obj."), "name", F.lit("(x) fails")))
        .when(way == 1, F.concat(F.lit("see `x."), "name", F.lit("` here")))
        .when(way == 2, F.concat(F.lit("the "), F.upper("name"), F.lit(" is wrong"))).otherwise(F.concat(F.lit("pre"), "name", F.lit("post is wrong")))
    )
    kind = F.when(F.col("p_size") > 25, "class").otherwise("method")
    return p.select("p_partkey", "name", V.symbol_points(F.col("name"), kind, issue).alias("points"))


USED = "u AS (SELECT l_partkey, count(DISTINCT l_suppkey) callers, count(*) FILTER (l_returnflag = 'R') bad, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F' AND l_discount > 0.08) left_over FROM lineitem GROUP BY l_partkey)"


@query("counterfactual_verdict", f"""
WITH {USED}, f AS (SELECT p_partkey, coalesce(bad, 0) > 5 e, p_size > 20 x, coalesce(callers, 0) <= 20 s, coalesce(left_over, 0) n FROM part LEFT JOIN u ON l_partkey = p_partkey)
SELECT p_partkey, CASE WHEN (e OR x) AND s AND n = 0 THEN CASE WHEN e AND x THEN 'HIGHLY_PLAUSIBLE' ELSE 'PLAUSIBLE' END WHEN (e OR x) AND s AND n <= 1 THEN 'PLAUSIBLE' WHEN NOT s THEN 'INSUFFICIENT_SCOPE' ELSE 'WEAK' END AS verdict, n AS unexplained FROM f""")
def counterfactual_verdict(spark, d):
    c = F.col
    u = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.countDistinct("l_suppkey").alias("callers"), F.count_if(c("l_returnflag") == "R").alias("bad"), F.count_if((c("l_returnflag") == "A") & (c("l_linestatus") == "F") & (c("l_discount") > 0.08)).alias("n"),
    )
    p = table(spark, d, "part").join(u, c("p_partkey") == c("l_partkey"), "left").na.fill(0, ["callers", "bad", "n"])
    return p.select("p_partkey", V.counterfactual(c("bad") > 5, c("p_size") > 20, c("callers") <= 20, c("n")).alias("verdict"), c("n").alias("unexplained"))


@query("target_coherence", """
WITH a AS (SELECT l_orderkey k, arg_max((l_partkey, l_suppkey), (l_extendedprice, l_linenumber, l_partkey, l_suppkey)) x FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey), e AS (SELECT DISTINCT l_partkey p, l_suppkey s FROM lineitem)
SELECT l.l_orderkey AS orderkey, l.l_linenumber AS linenumber, l.l_partkey AS partkey, l.l_suppkey AS suppkey, CASE WHEN a.k IS NULL THEN 'UNDECLARED' WHEN l.l_partkey = x[1] AND l.l_suppkey = x[2] THEN 'EXACT' WHEN e.p IS NOT NULL THEN 'STRUCTURAL' WHEN l.l_suppkey = x[2] AND l.l_discount > 0.05 THEN 'RATIONALE' ELSE 'INCOHERENT' END AS reason, count(*) AS n
FROM lineitem l LEFT JOIN a ON a.k = l.l_orderkey LEFT JOIN e ON e.p = l.l_partkey AND e.s = x[2] GROUP BY ALL""")
def target_coherence(spark, d):
    """Lines as targets; an order's dearest turned line is its declared site. A target is coherent if it is the site, if
    the site's supplier also delivers its part, or if it has the site's supplier and a discount speaks for it."""
    c = F.col
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_returnflag", "l_extendedprice")
    site = lines.where("l_returnflag <> 'N'").groupBy(c("l_orderkey").alias("_k")).agg(F.max(F.struct("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey")).alias("x"))
    edges = lines.select(c("l_partkey").alias("_p"), c("l_suppkey").alias("_s")).distinct()
    t = lines.join(site, c("l_orderkey") == c("_k"), "left").join(edges, (c("l_partkey") == c("_p")) & (c("x.l_suppkey") == c("_s")), "left")
    same = c("l_suppkey") == c("x.l_suppkey")
    reason = V.coherence(c("_k").isNotNull(), same & (c("l_partkey") == c("x.l_partkey")), c("_p").isNotNull(), same, c("l_discount") > 0.05)
    return t.groupBy(c("l_orderkey").alias("orderkey"), c("l_linenumber").alias("linenumber"), c("l_partkey").alias("partkey"), c("l_suppkey").alias("suppkey"), reason.alias("reason")).agg(F.count("*").alias("n"))


@query("contract_gate", """
WITH h AS (SELECT o_custkey k, o_orderkey o, o_orderstatus = 'P' OR o_totalprice > 300000 forb, (o_orderkey % 90) / 100.0::DOUBLE c0, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 0 END exc, o_orderkey % 3 req, o_orderkey % 7 s, o_orderpriority = '2-HIGH' up, o_orderkey % 5 = 0 spec FROM orders),
g AS (SELECT *, round(CASE WHEN forb THEN least(1.0::DOUBLE, least(c0, 0.1::DOUBLE) + 0.1::DOUBLE * exc) ELSE least(1.0::DOUBLE, least(1.0::DOUBLE, c0 + 0.1::DOUBLE * exc) + 0.05::DOUBLE * req) END, 4) c FROM h),
r AS (SELECT k, count(*) FILTER (NOT forb) survivors, min(CASE WHEN up AND NOT forb THEN o END) u, arg_max(o, (s, c, -o)) FILTER (NOT forb) b, min(o) f, bool_or(spec) spec FROM g GROUP BY k),
w AS (SELECT k, survivors, CASE WHEN u IS NOT NULL THEN 'UPSTREAM' WHEN b IS NOT NULL THEN 'BEST' WHEN spec THEN 'SYNTHESISED' ELSE 'REVIVED' END AS why, CASE WHEN u IS NOT NULL THEN u WHEN b IS NOT NULL THEN b WHEN spec THEN NULL ELSE f END AS chosen FROM r)
SELECT w.k AS o_custkey, survivors, why, chosen, CASE WHEN why = 'SYNTHESISED' THEN 0.95 ELSE c END::DOUBLE AS confidence FROM w LEFT JOIN g ON g.o = chosen""")
def contract_gate(spark, d):
    """A customer's orders as competing hypotheses."""
    c = F.col
    conf = V.gated_confidence(c("o_orderkey") % 90 / 100.0, c("forb"), F.when(c("o_orderpriority") == "1-URGENT", 2).otherwise(0), c("o_orderkey") % 3)
    o = table(spark, d, "orders").withColumn("forb", (c("o_orderstatus") == "P") | (c("o_totalprice") > 300000)).withColumn("c", conf)
    return V.contract_gate(o, "o_custkey", "o_orderkey", c("forb"), c("c"), c("o_orderkey") % 7, c("o_orderpriority") == "2-HIGH", c("o_orderkey") % 5 == 0)


@query("check_tiers", f"""
WITH {OUTCOME} SELECT CASE WHEN st = 'P' OR tp < 1500 THEN 'STATIC' WHEN f2p > 0 OR (f2p = f2p_total AND p2p = p2p_total) THEN 'REGRESSION_P2P' ELSE 'TARGETED_F2P' END AS tier, failure_class, count(*) AS n, sum(f2p)::BIGINT AS f2p FROM fc GROUP BY ALL""")
def check_tiers(spark, d):
    c = F.col
    o = outcomes(spark, d)
    tier = V.tier(c("o_orderstatus") != "P", c("o_totalprice") >= 1500, c("f2p"), (c("f2p") == c("f2p_total")) & (c("p2p") == c("p2p_total")))
    return o.groupBy(tier.alias("tier"), "failure_class").agg(F.count("*").alias("n"), F.sum("f2p").alias("f2p"))


WORDS = "[" + ", ".join(f"'{w}'" for w in V.PROBED) + "]"


@query("probe_plans", f"""
WITH p AS (SELECT conv_id, turn, role, coalesce(text, '') t, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn, role, text) b FROM conversations),
w AS (SELECT conv_id, turn, role, list_filter({WORDS}, lambda x: contains(lower(b || chr(10) || t), x))[1] v, b FROM p)
SELECT conv_id, turn, role, CASE WHEN b IS NULL THEN '' WHEN v IS NULL THEN 'P_ENTRY' ELSE 'P_ENTRY,P_' || upper(v) END AS probes FROM w""")
def probe_plans(spark, d):
    """Two turns in a row as rival hypotheses."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, d, "conversations")
    text = F.coalesce("text", F.lit(""))
    c = c.withColumn("_before", F.lag(text).over(w))
    return c.select("conv_id", "turn", "role", F.concat_ws(",", V.probe_plan(F.col("_before"), text)).alias("probes"))


@query("nearby_symbols", """
WITH t AS (SELECT p_brand, p_size, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) <= 11),
o AS (SELECT p.p_partkey, t.p_partkey o, row_number() OVER (PARTITION BY p.p_partkey ORDER BY t.p_partkey) r FROM part p JOIN t ON t.p_brand = p.p_brand AND t.p_size = p.p_size AND t.p_partkey <> p.p_partkey)
SELECT part.p_partkey, p_brand, p_size, coalesce(string_agg(o::VARCHAR, ',' ORDER BY o), '') AS others FROM part LEFT JOIN o ON o.p_partkey = part.p_partkey AND r <= 10 GROUP BY ALL""")
def nearby_symbols(spark, d):
    """Parts as definitions, brand and size as their file: the first ten others of the file."""
    p = V.first_nearby(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey", ["p_brand", "p_size"])
    return p.select("p_partkey", "p_brand", "p_size", F.concat_ws(",", F.transform("others", lambda x: x.cast("string"))).alias("others"))


@query("context_package", """
WITH u AS (SELECT l_partkey, count(DISTINCT l_suppkey) callers, count(*) FILTER (l_returnflag = 'R') tests, arg_max(l_suppkey, (l_quantity, l_orderkey, l_linenumber, l_suppkey)) main_caller, max(o_orderdate) last_change, count(DISTINCT l_orderkey) changes FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey),
t AS (SELECT p_brand, p_size, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) <= 4),
o AS (SELECT p.p_partkey, t.p_partkey o, row_number() OVER (PARTITION BY p.p_partkey ORDER BY t.p_partkey) r FROM part p JOIN t ON t.p_brand = p.p_brand AND t.p_size = p.p_size AND t.p_partkey <> p.p_partkey)
SELECT part.p_partkey, p_name, coalesce(callers, 0) AS n_callers, main_caller, coalesce(tests, 0) AS n_tests, coalesce(changes, 0) AS n_changes, last_change, coalesce(string_agg(o::VARCHAR, ',' ORDER BY o), '') AS related
FROM part LEFT JOIN u ON l_partkey = part.p_partkey LEFT JOIN o ON o.p_partkey = part.p_partkey AND r <= 3 GROUP BY ALL""")
def context_package(spark, d):
    """All that is known of a part as a symbol, in one row: callers, tests, history and what stands near it."""
    c = F.col
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    u = lines.join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey")).groupBy("l_partkey").agg(
        F.countDistinct("l_suppkey").alias("n_callers"), F.max_by("l_suppkey", F.struct("l_quantity", "l_orderkey", "l_linenumber", "l_suppkey")).alias("main_caller"),
        F.count_if(c("l_returnflag") == "R").alias("n_tests"), F.countDistinct("l_orderkey").alias("n_changes"), F.max("o_orderdate").alias("last_change"),
    )
    p = table(spark, d, "part")
    near = V.first_nearby(p.select("p_partkey", "p_brand", "p_size"), "p_partkey", ["p_brand", "p_size"], 3).select("p_partkey", F.concat_ws(",", F.transform("others", lambda x: x.cast("string"))).alias("related"))
    out = p.select("p_partkey", "p_name").join(u, c("p_partkey") == c("l_partkey"), "left").join(near, "p_partkey", "left").na.fill(0, ["n_callers", "n_tests", "n_changes"])
    return out.select("p_partkey", "p_name", "n_callers", "main_caller", "n_tests", "n_changes", "last_change", F.coalesce("related", F.lit("")).alias("related"))
