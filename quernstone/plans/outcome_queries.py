"""Outcomes, telemetry, rules, ledgers and intake over events, labels, orders, lineitem and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import text as T
from quernstone.operators import ledger as L
from quernstone.operators import rules as Q
from quernstone.operators.temporal import numbered
from quernstone.plans.registry import query
from quernstone.sources.tables import table


@query("telemetry_breakdown", """
SELECT user_id, round(sum(CASE WHEN contains(event_type, 'purchase') THEN value ELSE 0 END), 2) AS llm_ms, round(sum(CASE WHEN contains(event_type, 'error') THEN value ELSE 0 END), 2) AS test_ms,
  round(sum(CASE WHEN contains(event_type, 'click') THEN value ELSE 0 END), 2) AS tool_ms, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens, count(*) AS n_events FROM events GROUP BY user_id""")
def telemetry_breakdown(spark, d):
    part = lambda kind: F.round(F.sum(F.when(F.col("event_type").contains(kind), F.col("value")).otherwise(0.0)), 2)
    tokens = F.sum(F.get_json_object("props", "$.k").try_cast("long"))
    return table(spark, d, "events").groupBy("user_id").agg(part("purchase").alias("llm_ms"), part("error").alias("test_ms"), part("click").alias("tool_ms"), tokens.alias("tokens"), F.count("*").alias("n_events"))


@query("usage_walk", """
WITH u AS (SELECT event_type, unnest(regexp_extract_all(props, '"[a-z_]+":\\s*(-?[0-9]+)', 1))::BIGINT AS n FROM events)
SELECT event_type, count(*) AS n_usages, sum(n)::BIGINT AS total, max(n) AS most, round(sum(n) * 0.000002::DOUBLE, 6) AS cost FROM u GROUP BY event_type""")
def usage_walk(spark, d):
    """Every number in the JSON of an event, at any depth."""
    n = table(spark, d, "events").select("event_type", F.explode(F.regexp_extract_all("props", F.lit(r'"[a-z_]+":\s*(-?[0-9]+)'), F.lit(1))).alias("n")).withColumn("n", F.col("n").cast("long"))
    return n.groupBy("event_type").agg(F.count("*").alias("n_usages"), F.sum("n").alias("total"), F.max("n").alias("most"), F.round(F.sum("n") * 0.000002, 6).alias("cost"))


@query("cohort_summary", """
SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS resolved, count(*) FILTER (toxic = 0) AS valid, round(count(*) FILTER (quality = 1) / count(*), 4) AS rate, round(avg(n_chars), 2) AS mean_chars, sum(n_chars)::BIGINT AS total_chars
FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def cohort_summary(spark, d):
    r = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return r.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("resolved"), F.count_if(F.col("toxic") == 0).alias("valid"),
        F.round(F.count_if(F.col("quality") == 1) / F.count("*"), 4).alias("rate"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.sum("n_chars").alias("total_chars"),
    )


@query("failure_histogram", """
SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'RESOLVED' WHEN toxic = 1 AND quality = 0 THEN 'REGRESSION' WHEN toxic = 1 THEN 'PATCH_SEMANTICS' ELSE 'WRONG_HYPOTHESIS' END AS failure_class, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def failure_histogram(spark, d):
    r = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    kind = Q.first_true([((F.col("quality") == 1) & (F.col("toxic") == 0), "RESOLVED"), ((F.col("toxic") == 1) & (F.col("quality") == 0), "REGRESSION"), (F.col("toxic") == 1, "PATCH_SEMANTICS")], "WRONG_HYPOTHESIS")
    return r.groupBy(kind.alias("failure_class"), "lang").agg(F.count("*").alias("n"))


@query("regression_clusters", """
WITH e AS (SELECT coalesce(json_extract_string(props, '$.k'), '-') k, event_id, user_id FROM events WHERE event_type = 'error'), g AS (SELECT k, count(*) AS n, count(DISTINCT user_id) AS n_users, min(event_id) AS first_event FROM e GROUP BY k)
SELECT 'error@' || k AS cluster_key, n, n_users, first_event, row_number() OVER (ORDER BY first_event) AS cluster_id FROM g""")
def regression_clusters(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").withColumn("cluster_key", F.concat(F.lit("error@"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("-"))))
    g = e.groupBy("cluster_key").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.min("event_id").alias("first_event"))
    return numbered(g, [], [F.asc("first_event")], "cluster_id")


OUTCOME = """o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus st, o_orderpriority pr, o_totalprice tp, count(l_orderkey) total, count(*) FILTER (l_returnflag = 'A') f2p, count(*) FILTER (l_returnflag IN ('A','R')) f2p_total, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') p2p, count(*) FILTER (l_returnflag = 'N') p2p_total
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
fc AS (SELECT *, CASE WHEN pr = '5-LOW' AND tp > 400000 THEN 'TIMEOUT' WHEN tp < 1500 THEN 'INFRA_FAILURE' WHEN st = 'P' THEN 'PATCH_SYNTAX' WHEN f2p = f2p_total AND p2p = p2p_total THEN 'RESOLVED' WHEN f2p_total > 0 AND f2p = f2p_total AND p2p < p2p_total THEN 'REGRESSION'
  WHEN f2p_total > 0 AND f2p > 0 AND f2p < f2p_total THEN 'PATCH_SEMANTICS' WHEN f2p_total > 0 AND f2p = 0 THEN 'WRONG_HYPOTHESIS' ELSE 'TEST_FAILURE' END failure_class FROM o)"""


def outcomes(spark, d):
    """Orders as attempts and their lines as tests: A passed and R failed of those that should turn, N those that should stay."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "A").alias("f2p"), F.count_if(F.col("l_returnflag").isin("A", "R")).alias("f2p_total"),
        F.count_if((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).alias("p2p"), F.count_if(F.col("l_returnflag") == "N").alias("p2p_total"),
    )
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    c = F.col
    kind = Q.failure_class(
        c("o_totalprice") < 1500, (c("o_orderpriority") == "5-LOW") & (c("o_totalprice") > 400000), c("o_orderstatus") != "P", F.lit(True),
        (c("f2p") == c("f2p_total")) & (c("p2p") == c("p2p_total")), c("f2p"), c("f2p_total"), c("p2p"), c("p2p_total"), F.lit(""),
    )
    return o.withColumn("failure_class", kind)


@query("failure_classify", f"""WITH {OUTCOME} SELECT o_orderkey, failure_class, CASE WHEN f2p = f2p_total AND p2p = p2p_total THEN 'RESOLVED' WHEN f2p < f2p_total AND p2p = p2p_total THEN 'SEMANTIC_MISUNDERSTANDING' WHEN f2p = f2p_total AND p2p_total - p2p > 3 THEN 'BLAST_RADIUS'
  WHEN f2p = f2p_total THEN 'REGRESSION' ELSE 'INCOMPLETE_SPECIFICATION' END AS category, CASE WHEN total > 0 THEN round(100.0::DOUBLE * (f2p + p2p) / total, 1) ELSE 0 END AS coverage FROM fc""")
def failure_classify(spark, d):
    o = outcomes(spark, d)
    return o.select("o_orderkey", "failure_class", Q.failure_category(F.col("f2p_total") - F.col("f2p"), F.col("p2p_total") - F.col("p2p")).alias("category"), Q.coverage(F.col("f2p") + F.col("p2p"), F.col("total")).alias("coverage"))


@query("replan_decision", f"""
WITH {OUTCOME}, a AS (SELECT *, row_number() OVER w attempt, lag(failure_class) OVER w prev, lag(f2p) OVER w prev_f2p, count(*) OVER (PARTITION BY o_custkey) n FROM fc WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
r AS (SELECT *, coalesce(failure_class = prev AND f2p = 0 AND prev_f2p = 0, false) rep, attempt < n others FROM a)
SELECT o_orderkey, attempt, rep AS repeated, CASE WHEN attempt >= 8 THEN 'ABORT' WHEN rep AND others THEN 'SWITCH_HYPOTHESIS' WHEN rep AND failure_class = 'PATCH_SYNTAX' THEN 'FALLBACK_SYNTAX' WHEN rep THEN 'ABORT' WHEN failure_class = 'PATCH_SYNTAX' THEN 'FALLBACK_SYNTAX'
  WHEN p2p_total - p2p > 0 OR failure_class = 'REGRESSION' THEN 'CONSTRAIN_MUTATION' WHEN failure_class = 'WRONG_HYPOTHESIS' AND others THEN 'SWITCH_HYPOTHESIS' ELSE 'REFINE_SEMANTICS' END AS action,
  CASE WHEN failure_class = 'RESOLVED' THEN 'DONE' WHEN f2p_total > 0 AND 2 * f2p >= f2p_total AND p2p_total = p2p THEN 'REFINE_NEAR_MISS' ELSE 'REFINE' END AS phase FROM r""")
def replan_decision(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = outcomes(spark, d).withColumns({"attempt": F.row_number().over(w).cast("long"), "prev": F.lag("failure_class").over(w), "prev_f2p": F.lag("f2p").over(w), "n": F.count("*").over(Window.partitionBy("o_custkey"))})
    o = o.withColumn("repeated", F.coalesce((F.col("failure_class") == F.col("prev")) & (F.col("f2p") == 0) & (F.col("prev_f2p") == 0), F.lit(False)))
    broken = F.col("p2p_total") - F.col("p2p")
    return o.select("o_orderkey", "attempt", "repeated", Q.next_action(F.col("failure_class"), F.col("attempt"), 8, F.col("repeated"), F.col("attempt") < F.col("n"), broken).alias("action"), Q.next_phase(F.col("failure_class") == "RESOLVED", F.col("f2p"), F.col("f2p_total"), broken).alias("phase"))


@query("candidate_rank", f"""
WITH {OUTCOME}, s AS (SELECT *, round(CASE WHEN failure_class = 'RESOLVED' THEN 1000.0::DOUBLE ELSE 0 END + CASE WHEN f2p > 0 AND p2p_total = p2p THEN 20.0::DOUBLE ELSE 0 END - CASE WHEN st = 'P' THEN 100.0::DOUBLE ELSE 0 END + 50 * f2p - 500 * (p2p_total - p2p) - 2 * total - 0.01::DOUBLE * f2p_total + 10 * 0.5::DOUBLE, 2) score FROM fc)
SELECT o_custkey, o_orderkey, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, failure_class = 'RESOLVED' DESC, p2p_total - p2p, f2p DESC, o_orderdate DESC, o_orderkey) AS rank FROM s)""")
def candidate_rank(spark, d):
    o = outcomes(spark, d)
    broken, final = F.col("p2p_total") - F.col("p2p"), F.col("failure_class") == "RESOLVED"
    o = o.withColumn("score", Q.candidate_score(final, F.col("f2p"), broken, F.col("total"), F.col("f2p_total"), F.col("o_orderstatus") == "P", F.lit(0.5)))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("score"), final.desc(), broken.asc(), F.desc("f2p"), F.desc("o_orderdate"), "o_orderkey")
    return o.select("o_custkey", "o_orderkey", "score", F.row_number().over(w).cast("long").alias("rank"))


@query("best_accepted", f"""
WITH {OUTCOME} SELECT o_custkey, o_orderkey, f2p, p2p_total - p2p AS regressions FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p2p_total > p2p, 100 * f2p + p2p DESC, f2p DESC, o_orderdate DESC, o_orderkey) r FROM fc WHERE st <> 'P') WHERE r = 1""")
def best_accepted(spark, d):
    """One aggregate for each customer: the least of the negated order keys."""
    o = outcomes(spark, d).where("o_orderstatus <> 'P'").withColumn("regressions", F.col("p2p_total") - F.col("p2p"))
    order = F.struct((F.col("regressions") > 0).alias("x"), (-(100 * F.col("f2p") + F.col("p2p"))).alias("s"), (-F.col("f2p")).alias("f"), (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), "o_orderkey", "regressions")
    return o.groupBy("o_custkey").agg(F.min(order).alias("m")).select("o_custkey", "m.o_orderkey", (-F.col("m.f")).alias("f2p"), "m.regressions")


@query("evidence_support", """
WITH e AS (SELECT source, lang, quality, toxic, CASE WHEN n_chars > 2000 THEN 0.95 WHEN n_chars > 500 THEN 0.9 ELSE 0.85 END::DOUBLE conf FROM documents JOIN labels USING (doc_id))
SELECT source AS hypothesis, round(sum(CASE WHEN quality = 1 THEN conf ELSE 0 END) - 1.5::DOUBLE * sum(CASE WHEN quality = 0 THEN conf ELSE 0 END), 3) AS support,
  round(coalesce(avg(CASE WHEN quality = 1 THEN conf END), 0) + least(0.6::DOUBLE, 0.2::DOUBLE * count(*) FILTER (toxic = 1)) + count(DISTINCT lang) / 4, 4) AS rank_score FROM e GROUP BY source""")
def evidence_support(spark, d):
    conf = F.when(F.col("n_chars") > 2000, 0.95).when(F.col("n_chars") > 500, 0.9).otherwise(0.85)
    e = table(spark, d, "documents").select("doc_id", "source", "lang", conf.alias("conf")).join(table(spark, d, "labels"), "doc_id")
    total = lambda q: F.sum(F.when(F.col("quality") == q, F.col("conf")).otherwise(0.0))
    mean = F.coalesce(F.avg(F.when(F.col("quality") == 1, F.col("conf"))), F.lit(0.0))
    return e.groupBy(F.col("source").alias("hypothesis")).agg(
        F.round(total(1) - 1.5 * total(0), 3).alias("support"),
        F.round(mean + F.least(F.lit(0.6), 0.2 * F.count_if(F.col("toxic") == 1)) + F.countDistinct("lang") / 4, 4).alias("rank_score"),
    )


@query("hypothesis_rank", """
WITH h AS (SELECT c_custkey, c_mktsegment, c_nationkey, count(o_orderkey) n, count(*) FILTER (o_orderstatus = 'F') unexplained, count(*) FILTER (o_orderpriority = '1-URGENT') urgent, count(*) FILTER (o_orderstatus = 'P') forbidden, CASE WHEN c_custkey % 50 = 0 THEN 0.5::DOUBLE ELSE floor(c_acctbal) / 10000 END conf FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT *, CASE WHEN n = 0 THEN least(75.0::DOUBLE, 100 * conf) ELSE 100 * conf END - CASE WHEN n >= 2 AND urgent = 0 THEN 40.0::DOUBLE ELSE 0 END - least(35.0::DOUBLE, 15.0::DOUBLE * unexplained) - 25.0::DOUBLE * (n // 20) + 20.0::DOUBLE * CASE WHEN n <= 5 THEN 1 ELSE 0 END
  + CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0 THEN 15.0::DOUBLE ELSE 0 END + CASE WHEN urgent > 1 THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 15.0::DOUBLE ELSE 0 END - 30.0::DOUBLE * forbidden x FROM h),
r AS (SELECT *, round(x, 2) AS score, x < 20 OR (forbidden >= 2 AND forbidden > CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) AS eliminated FROM s)
SELECT c_custkey, c_mktsegment, score, eliminated, row_number() OVER (PARTITION BY c_mktsegment ORDER BY eliminated, score DESC, c_custkey) AS rank FROM r""")
def hypothesis_rank(spark, d):
    """Customers as hypotheses, their orders as frames, symptoms, tests and forbidden events; every fiftieth has a confidence that is no number."""
    c = F.col
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(c("o_orderstatus") == "F").alias("unexplained"), F.count_if(c("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(c("o_orderstatus") == "P").alias("forbidden"))
    h = table(spark, d, "customer").join(o, c("c_custkey") == c("o_custkey"), "left").na.fill(0, ["n", "unexplained", "urgent", "forbidden"])
    conf = F.when(c("c_custkey") % 50 == 0, float("nan")).otherwise(F.floor("c_acctbal") / 10000)
    score, out = Q.hypothesis_score(
        conf, c("n") > 0, c("n"), c("urgent") > 0, c("unexplained"), F.expr("n div 20"), F.when(c("n") <= 5, 1).otherwise(0), (c("c_mktsegment") == "BUILDING") & (c("c_nationkey") % 2 == 0), c("urgent") > 1, c("forbidden"), c("c_custkey") % 3 == 0)
    h = h.select("c_custkey", "c_mktsegment", score.alias("score"), out.alias("eliminated"))
    return numbered(h, ["c_mktsegment"], [F.asc("eliminated"), F.desc("score"), F.asc("c_custkey")])


@query("site_rank", """
WITH u AS (SELECT l_partkey, count(DISTINCT l_suppkey) callers, count(*) FILTER (l_returnflag = 'R') tests, max(l_linenumber) depth FROM lineitem GROUP BY l_partkey),
s AS (SELECT p_partkey, p_brand, 100.0::DOUBLE + CASE WHEN tests > 0 THEN 50.0::DOUBLE ELSE 0 END + CASE WHEN contains(p_name, 'green') THEN 20.0::DOUBLE ELSE 0 END + CASE WHEN depth >= 5 THEN 30.0::DOUBLE ELSE 0 END + least(30.0::DOUBLE, 10.0::DOUBLE * tests)
  - CASE WHEN callers > 3 THEN least(40.0::DOUBLE, 4.0::DOUBLE * callers) ELSE 0 END + CASE WHEN p_size <= 30 THEN 30.0::DOUBLE ELSE 0 END - CASE WHEN p_size > 45 THEN 20.0::DOUBLE ELSE 0 END - CASE WHEN p_type LIKE '%TIN%' THEN 100.0::DOUBLE ELSE 0 END score FROM part LEFT JOIN u ON l_partkey = p_partkey)
SELECT p_brand, p_partkey, coalesce(score, 100) AS score, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(score, 100) DESC, p_partkey) AS rank FROM s""")
def site_rank(spark, d):
    u = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("callers"), F.count_if(F.col("l_returnflag") == "R").alias("tests"), F.max("l_linenumber").alias("depth"))
    p = table(spark, d, "part").join(u, F.col("p_partkey") == F.col("l_partkey"), "left")
    c = F.col
    score = 100 + Q.points(
        (c("tests") > 0, 50.0), (c("p_name").contains("green"), 20.0), (c("depth") >= 5, 30.0), (F.lit(True), F.least(F.lit(30.0), 10.0 * c("tests"))),
        (c("callers") > 3, -F.least(F.lit(40.0), 4.0 * c("callers"))), (c("p_size") <= 30, 30.0), (c("p_size") > 45, -20.0), (c("p_type").contains("TIN"), -100.0),
    )
    p = p.select("p_brand", "p_partkey", F.when(c("l_partkey").isNull(), 100.0).otherwise(score).alias("score"))
    return numbered(p, ["p_brand"], [F.desc("score"), F.asc("p_partkey")])


@query("best_evidence_link", """
WITH o AS (SELECT l_partkey, arg_max(l_suppkey, (l_extendedprice, l_orderkey, l_linenumber, l_suppkey)) best, max(l_extendedprice) relevance FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
SELECT p_partkey, coalesce(best, -1) AS best_supplier, coalesce(round(relevance / 200000, 4), 0.3)::DOUBLE AS relevance FROM part LEFT JOIN o ON l_partkey = p_partkey""")
def best_evidence_link(spark, d):
    pool = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.max(F.struct("l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey")).alias("m"))
    p = table(spark, d, "part").join(pool, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select("p_partkey", F.coalesce("m.l_suppkey", F.lit(-1)).cast("long").alias("best_supplier"), F.coalesce(F.round(F.col("m.l_extendedprice") / 200000, 4), F.lit(0.3)).alias("relevance"))


@query("ledger_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS n_events FROM events GROUP BY user_id")
def ledger_latest(spark, d):
    return L.latest(table(spark, d, "events"), "user_id", ["event_id"], ["event_type", "value"])


@query("lineage_check", """
SELECT c.conv_id, c.turn, c.role, (p.turn IS NOT NULL OR c.turn = f.lo) AS has_parent FROM conversations c JOIN (SELECT conv_id, min(turn) lo FROM conversations GROUP BY conv_id) f USING (conv_id) LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def lineage_check(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("lo"))
    parent = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("p")).distinct()
    return c.join(first, "conv_id").join(parent, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", (F.col("p").isNotNull() | (F.col("turn") == F.col("lo"))).alias("has_parent"))


@query("repeat_guard", """
WITH w AS (SELECT user_id, event_type, event_id, lag(event_type, 1) OVER o p1, lag(event_type, 2) OVER o p2, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) nth FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) FILTER (p1 = event_type AND p2 = event_type) AS guards, count(*) FILTER (nth > 1) AS seen, count(DISTINCT event_type) AS kinds FROM w GROUP BY user_id""")
def repeat_guard(spark, d):
    r = L.repeats(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")
    return r.groupBy("user_id").agg(F.count_if("guard").alias("guards"), F.count_if("seen").alias("seen"), F.countDistinct("event_type").alias("kinds"))


@query("probe_fold", """
SELECT user_id, event_type, arg_max(value, event_id) AS latest, count(*) AS hits, arg_min(props, event_id) AS first_raw, count(*) FILTER (value > 100) AS large FROM events GROUP BY ALL""")
def probe_fold(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("latest"), F.count("*").alias("hits"), F.min_by("props", "event_id").alias("first_raw"), F.count_if(F.col("value") > 100).alias("large"))


@query("overwritten_vars", "SELECT conv_id, role, count(*) AS n, count(DISTINCT text) AS n_values FROM conversations GROUP BY ALL HAVING count(*) > 1")
def overwritten_vars(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_values")).where("n > 1")


@query("integrity_check", """
WITH dec AS (SELECT DISTINCT l_partkey p FROM lineitem WHERE l_returnflag IN ('A', 'N')), obs AS (SELECT DISTINCT l_partkey p FROM lineitem WHERE l_returnflag = 'R')
SELECT p AS partkey, CASE WHEN dec.p IS NULL THEN 'UNDECLARED' WHEN obs.p IS NULL THEN 'UNOBSERVED' ELSE 'BOTH' END AS state FROM dec FULL JOIN obs USING (p)""")
def integrity_check(spark, d):
    """One aggregate gives both sets and their differences."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("partkey")).agg(F.max(F.col("l_returnflag").isin("A", "N")).alias("declared"), F.max(F.col("l_returnflag") == "R").alias("observed"))
    return g.select("partkey", Q.first_true([(~F.col("declared"), "UNDECLARED"), (~F.col("observed"), "UNOBSERVED")], "BOTH").alias("state"))


@query("declared_by_containment", """
WITH w AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 4)) word FROM benchmark), p AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z_]+')) AS name FROM documents),
n AS (SELECT DISTINCT item_id, name FROM w JOIN p ON contains(name, word)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY name) r FROM n)
SELECT item_id, count(*) AS n_names, string_agg(CASE WHEN r <= 5 THEN name END, ',' ORDER BY name) AS first_names FROM r GROUP BY item_id""")
def declared_by_containment(spark, d):
    """Issue words of over four letters inside names, the documents' words. Both sides are cut to their distinct strings first; a word's first five letters among a name's substrings of five make it an equi-join, held against the whole word."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z_]+)"), F.lit(1))
    w = table(spark, d, "benchmark").select("item_id", F.explode(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), lambda x: F.length(x) > 4)).alias("word")).distinct()
    p = table(spark, d, "documents").select(F.explode(F.array_distinct(words)).alias("name")).distinct().where(F.length("name") > 4)
    keyed = p.select("name", F.explode(T.parts(F.col("name"), 5, 5)).alias("key"))
    held = keyed.join(w.withColumn("key", F.substring("word", 1, 5)), "key").where(F.col("name").contains(F.col("word"))).select("item_id", "name").distinct()
    first = held.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("name"))).where("r <= 5").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("first_names"))
    return held.groupBy("item_id").agg(F.count("*").alias("n_names")).join(first, "item_id")


@query("requirement_coverage", """
WITH k AS (SELECT doc_id, source, lower(coalesce(text, '')) AS t, list_filter([lang, CASE WHEN doc_id % 3 > 0 THEN 'the' END, CASE WHEN doc_id % 3 > 1 THEN 'Token' END], lambda x: x IS NOT NULL AND doc_id % 5 > 0) AS words FROM documents)
SELECT source, count(*) FILTER (len(words) = 0 OR len(list_filter(words, lambda w: contains(t, lower(w)))) > 0) AS covered, count(*) FILTER (len(words) = 0) AS without FROM k GROUP BY source""")
def requirement_coverage(spark, d):
    """A document's keywords as a requirement: it is covered where the text holds one of them, and where there are none."""
    k = table(spark, d, "documents").withColumn("words", F.array_compact(F.array("lang", F.when(F.col("doc_id") % 3 > 0, "the"), F.when(F.col("doc_id") % 3 > 1, "Token"))))
    k = k.withColumn("words", F.filter("words", lambda x: F.col("doc_id") % 5 > 0))
    return k.groupBy("source").agg(F.count_if(T.covers(F.col("text"), F.col("words"))).alias("covered"), F.count_if(F.size("words") == 0).alias("without"))


@query("idempotent_ingest", """
WITH v AS (SELECT *, user_id || ':' || json_extract_string(props, '$.k') key FROM events WHERE event_type IN ('signup', 'purchase', 'click') AND value > 1)
SELECT user_id, event_type, count(*) AS accepted, min(event_id) AS first_event FROM (SELECT * FROM v WHERE key IS NULL UNION ALL SELECT * FROM (SELECT * FROM v WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id) = 1)) GROUP BY ALL""")
def idempotent_ingest(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")
    key = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.get_json_object("props", "$.k"))
    ok = F.col("event_type").isin("signup", "purchase", "click") & (F.col("value") > 1)
    return L.first_delivery(e, key, ok, ["event_id"]).groupBy("user_id", "event_type").agg(F.count("*").alias("accepted"), F.min("event_id").alias("first_event"))


@query("work_item_validate", """
SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'system') THEN 'role' WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(text) < 20 THEN 'short' ELSE '' END AS error, CASE WHEN contains(lower(coalesce(text, '')), lower(role)) THEN coalesce(text, '') ELSE role || chr(10) || coalesce(text, '') END AS statement FROM conversations""")
def work_item_validate(spark, d):
    text = F.coalesce("text", F.lit(""))
    error = Q.first_true([(~F.col("role").isin("user", "system"), "role"), (F.trim(text) == "", "empty"), (F.length(text) < 20, "short")], "")
    return table(spark, d, "conversations").select("conv_id", "turn", error.alias("error"), F.when(F.lower(text).contains(F.lower("role")), text).otherwise(F.concat("role", F.lit("\n"), text)).alias("statement"))


@query("carry_forward", """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::BIGINT AS n FROM documents),
c AS (SELECT doc_id, n, last_value(CASE WHEN length(line) > 60 THEN md5(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) carried, sum(CASE WHEN length(line) > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) session FROM l)
SELECT doc_id, count(*) AS n_lines, count(carried) AS n_carried, count(DISTINCT carried) AS n_headers, max(session)::BIGINT AS sessions FROM c GROUP BY doc_id""")
def carry_forward(spark, d):
    """Long lines as headers: each line carries the last header above it, and a running number of headers."""
    lines = T.lines(table(spark, d, "documents"), ["doc_id"])
    head = F.length("line") > 60
    c = L.sessions(L.carried(lines, "doc_id", "line_no", F.when(head, F.md5(F.col("line").cast("binary")))), "doc_id", "line_no", head)
    return c.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("carried").alias("n_carried"), F.countDistinct("carried").alias("n_headers"), F.max("session").alias("sessions"))


@query("tool_patterns", """
WITH p AS (SELECT *, contains(coalesce(text, ''), '.') a, regexp_matches(coalesce(text, ''), '^[A-Z]') b FROM conversations)
SELECT role, CASE WHEN a AND b THEN 'VALID_PATCH' WHEN a THEN 'WRONG_PATCH_FORMAT' WHEN b THEN 'VALID_TOOL_CALL' ELSE 'PROSE_NO_TOOL' END AS kind, count(*) AS n, count(DISTINCT conv_id) AS n_convs FROM p GROUP BY ALL""")
def tool_patterns(spark, d):
    text = F.coalesce("text", F.lit(""))
    a, b = text.contains("."), text.rlike("^[A-Z]")
    kind = Q.first_true([(a & b, "VALID_PATCH"), (a, "WRONG_PATCH_FORMAT"), (b, "VALID_TOOL_CALL")], "PROSE_NO_TOOL")
    return table(spark, d, "conversations").select("role", kind.alias("kind"), "conv_id").groupBy("role", "kind").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_convs"))


@query("confidence_fold", """
WITH RECURSIVE s AS (SELECT user_id, event_type t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) n FROM events),
r(user_id, n, c) AS (SELECT DISTINCT user_id, 0::BIGINT, 0.5::DOUBLE FROM events UNION ALL SELECT r.user_id, s.n, round(CASE s.t WHEN 'purchase' THEN least(1.0, r.c + 0.2) WHEN 'error' THEN greatest(0.0, r.c - 0.25) WHEN 'signup' THEN least(1.0, r.c + 0.15) ELSE greatest(0.05, r.c - 0.1) END, 4)::DOUBLE FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)
SELECT user_id, arg_max(c, n) AS confidence, max(n) AS n_updates FROM r GROUP BY user_id""")
def confidence_fold(spark, d):
    return L.folded(table(spark, d, "events"), "user_id", "event_id", "event_type", {"purchase": (20, None, 100), "error": (-25, 0, None), "signup": (15, None, 100)}, (-10, 5, None), 50)
