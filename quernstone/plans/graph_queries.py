"""Graph, history and interval queries over the star schema, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators import graph as G
from quernstone.operators import spans as S
from quernstone.operators import temporal as H
from quernstone.plans.registry import query
from quernstone.sources.tables import table

PAIRS = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"


def neighbours_sql(of: str, other: str) -> str:
    return f"""SELECT {of}, count(*) AS n, string_agg(CASE WHEN r <= 10 THEN {other}::VARCHAR END, ',' ORDER BY {other}) AS first
FROM (SELECT *, row_number() OVER (PARTITION BY {of} ORDER BY {other}) r FROM {PAIRS}) GROUP BY {of}"""


@query("graph_callers", neighbours_sql("l_partkey", "l_suppkey"))
def graph_callers(spark, d):
    return G.neighbours(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("graph_callees", neighbours_sql("l_suppkey", "l_partkey"))
def graph_callees(spark, d):
    return G.neighbours(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("edge_dedup_inverse", """
WITH e AS (SELECT l_suppkey src, l_partkey dst, CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'R' THEN 'TESTS' ELSE 'READS' END kind, arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity)) attr FROM lineitem GROUP BY ALL)
SELECT * FROM e UNION ALL SELECT dst, src, CASE kind WHEN 'CALLS' THEN 'CALLED_BY' ELSE 'TESTED_BY' END, attr FROM e WHERE kind IN ('CALLS', 'TESTS')""")
def edge_dedup_inverse(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "CALLS").when(F.col("l_returnflag") == "R", "TESTS").otherwise("READS")
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), kind.alias("kind"), F.col("l_quantity").alias("attr"), "l_orderkey", "l_linenumber")
    e = G.last_wins(e, ["src", "dst", "kind"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("attr")], "attr")
    return G.with_inverse(e, {"CALLS": "CALLED_BY", "TESTS": "TESTED_BY"})


@query("related_symbols", """
WITH p AS (SELECT p_partkey, p_brand, p_type FROM part), g AS (SELECT p_brand, p_type, count(*) n, min(p_partkey) lo FROM p GROUP BY ALL), s AS (SELECT l_partkey, count(DISTINCT l_suppkey) n FROM lineitem GROUP BY ALL)
SELECT p_partkey, g.n - 1 AS siblings, g.lo AS first_sibling, coalesce(s.n, 0) AS callers FROM p JOIN g USING (p_brand, p_type) LEFT JOIN s ON l_partkey = p_partkey""")
def related_symbols(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    group = p.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_sibling"))
    callers = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("callers"))
    out = p.join(group, ["p_brand", "p_type"]).join(callers, "p_partkey", "left")
    return out.select("p_partkey", (F.col("n") - 1).alias("siblings"), "first_sibling", F.coalesce("callers", F.lit(0)).alias("callers"))


@query("two_hop_reach", """
SELECT l_suppkey AS node, count(DISTINCT l_orderkey) AS direct, count(DISTINCT o_custkey) AS transitive FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY l_suppkey""")
def two_hop_reach(spark, d):
    first = table(spark, d, "orders").select(F.col("o_custkey").alias("caller"), F.col("o_orderkey").alias("mid"))
    second = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("mid"), F.col("l_suppkey").alias("node"))
    return G.two_hop(first, second)


@query("blast_radius", """
WITH c AS (SELECT l_partkey, count(DISTINCT l_suppkey) callers, count(DISTINCT s_nationkey) modules, count(DISTINCT CASE WHEN s_nationkey <> p_size % 25 THEN s_suppkey END) cross_callers, max(p_size) span
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY l_partkey)
SELECT l_partkey AS p_partkey, callers, modules, cross_callers,
 CASE WHEN cross_callers > 3 OR callers > 12 OR modules > 4 THEN 'GLOBAL' WHEN callers > 3 OR (callers > 1 AND cross_callers >= 1) THEN 'SHARED' WHEN callers <= 2 AND cross_callers = 0 THEN 'LOCAL' ELSE 'UNKNOWN' END AS radius,
 round(least(10, CASE WHEN cross_callers > 3 OR callers > 12 OR modules > 4 THEN 7 + least(3, 0.5::DOUBLE * cross_callers) WHEN callers > 3 OR (callers > 1 AND cross_callers >= 1) THEN 4 + least(2.5::DOUBLE, 0.3::DOUBLE * callers) WHEN callers <= 2 AND cross_callers = 0 THEN 1 + least(2, 0.5::DOUBLE * callers) ELSE 3 END + CASE WHEN 5 * span > 100 THEN 0.5::DOUBLE ELSE 0 END), 1)::DOUBLE AS score FROM c""")
def blast_radius(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    calls = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(supplier, "l_suppkey").join(part, "l_partkey")
    c = calls.groupBy("l_partkey").agg(F.count("*").alias("callers"), F.countDistinct("s_nationkey").alias("modules"), F.count_if(F.col("s_nationkey") != F.col("p_size") % 25).alias("cross_callers"), F.max("p_size").alias("span"))
    kind, score = G.radius(F.col("callers"), F.col("cross_callers"), F.col("modules"), 5 * F.col("span"))
    return c.select(F.col("l_partkey").alias("p_partkey"), "callers", "modules", "cross_callers", kind.alias("radius"), score.alias("score"))


@query("causal_paths", f"""
WITH s AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) r FROM {PAIRS}), o AS (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) r FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem))
SELECT s.l_partkey AS p_partkey, s.l_suppkey || ' -> ' || s.l_partkey || ' -> ' || o.l_orderkey AS path FROM s JOIN o USING (l_partkey) WHERE s.r <= 3 AND o.r <= 3""")
def causal_paths(spark, d):
    lines = table(spark, d, "lineitem")
    near = lambda c: lines.select("l_partkey", c).distinct().withColumn("r", F.row_number().over(Window.partitionBy("l_partkey").orderBy(c))).where("r <= 3").drop("r")
    both = near("l_suppkey").join(near("l_orderkey"), "l_partkey")
    return both.select(F.col("l_partkey").alias("p_partkey"), F.concat_ws(" -> ", "l_suppkey", "l_partkey", "l_orderkey").alias("path"))


@query("resolve_symbols", r"""
WITH n AS (SELECT p_brand || ':' || p_type || '.' || p_partkey id, p_name AS name FROM part), s AS (SELECT id symbol FROM n UNION SELECT name FROM n UNION SELECT l_partkey::VARCHAR FROM lineitem),
f AS (SELECT symbol, id, 1 tier FROM s JOIN n ON id = symbol UNION ALL SELECT symbol, id, 2 FROM s JOIN n ON name = symbol UNION ALL SELECT symbol, id, 3 FROM s JOIN n ON regexp_extract(id, '([^:.]+)$', 1) = symbol)
SELECT symbol, min(tier)::BIGINT AS tier, min(CASE WHEN tier = t THEN id END) AS id FROM (SELECT *, min(tier) OVER (PARTITION BY symbol) t FROM f) GROUP BY symbol""")
def resolve_symbols(spark, d):
    nodes = table(spark, d, "part").select(F.concat("p_brand", F.lit(":"), "p_type", F.lit("."), "p_partkey").alias("id"), F.col("p_name").alias("name"))
    symbols = nodes.select(F.col("id").alias("symbol")).union(nodes.select("name")).union(table(spark, d, "lineitem").select(F.col("l_partkey").cast("string")))
    return G.resolved(symbols, nodes)


@query("cochange_topk", """
WITH i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), n AS (SELECT a.l_partkey, b.l_partkey partner, count(*) together FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY together DESC, partner) AS rank FROM n) WHERE rank <= 5""")
def cochange_topk(spark, d):
    return H.cochange(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("recent_n_per_group", "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) WHERE nth <= 15")
def recent_n_per_group(spark, d):
    return H.recent(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "nth")


@query("churn_profile", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) r FROM orders)
SELECT o_custkey, count(*) AS commits, count(*) FILTER (o_orderstatus = 'F') AS fixes, round(least(1, count(*) / 20 + count(*) FILTER (o_orderstatus = 'F') / 5 * 0.5::DOUBLE), 3) AS churn, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date,
  coalesce(string_agg(CASE WHEN o_orderstatus = 'F' AND r <= 5 THEN o_orderkey::VARCHAR END, ',' ORDER BY r), '') AS last_fixes FROM r GROUP BY o_custkey""")
def churn_profile(spark, d):
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.desc("o_orderdate"), "o_orderkey")
    o = table(spark, d, "orders").withColumn("r", F.row_number().over(w))
    fix = F.col("o_orderstatus") == "F"
    last = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(fix & (F.col("r") <= 5), F.struct("r", "o_orderkey")))), lambda x: x["o_orderkey"].cast("string")), ",")
    p = o.groupBy("o_custkey").agg(F.count("*").alias("commits"), F.count_if(fix).alias("fixes"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_date"), last.alias("last_fixes"))
    return p.withColumn("churn", H.churn(F.col("commits"), F.col("fixes")))


SPANS = "(SELECT p_brand, p_name || '#' || p_partkey symbol, p_size lo, p_size + p_partkey % 7 hi FROM part)"
PLACES = "(SELECT DISTINCT p_brand, l_quantity::BIGINT AS line FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _spans(spark, d):
    return table(spark, d, "part").select("p_brand", F.concat("p_name", F.lit("#"), "p_partkey").alias("symbol"), F.col("p_size").cast("long").alias("lo"), (F.col("p_size") + F.col("p_partkey") % 7).cast("long").alias("hi"))


def _places(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("line")).join(part, "l_partkey").select("p_brand", "line").distinct()


@query("enclosing_span", f"SELECT p.p_brand, line, arg_min(symbol, (hi - lo, symbol)) AS symbol, min(hi - lo)::BIGINT AS length FROM {PLACES} p JOIN {SPANS} s ON p.p_brand = s.p_brand AND line BETWEEN lo AND hi GROUP BY ALL")
def enclosing_span(spark, d):
    return S.innermost(_places(spark, d), _spans(spark, d), "p_brand", "line")


@query("uncovered_places", f"SELECT p_brand, line FROM {PLACES} p WHERE NOT EXISTS (SELECT 1 FROM {SPANS} s WHERE s.p_brand = p.p_brand AND line BETWEEN lo AND hi)")
def uncovered_places(spark, d):
    return S.uncovered(_places(spark, d), _spans(spark, d), "p_brand", "line")


@query("span_conflicts", """
WITH s AS (SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) lo, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT hi FROM lineitem),
n AS (SELECT *, lead(hi) OVER w next_hi, lead(l_linenumber) OVER w next_id FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY lo DESC, l_linenumber DESC, hi DESC))
SELECT l_orderkey, l_linenumber, lo, hi, next_id, next_hi FROM n WHERE next_hi >= lo""")
def span_conflicts(spark, d):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", day.alias("lo"), (day + F.col("l_quantity").cast("long")).alias("hi"))
    return S.conflicts(s, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "lo", "hi", "next_id", "next_hi")


@query("diversified_topk", """
SELECT doc_id, source, n_chars, nth FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM documents) WHERE nth <= 3 ORDER BY n_chars DESC, doc_id LIMIT 7""")
def diversified_topk(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return H.recent(docs, "source", [F.desc("n_chars"), F.asc("doc_id")], 3).orderBy(F.desc("n_chars"), "doc_id").limit(7)


@query("list_rank_score", """
WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) n, p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand) rel FROM part)
SELECT p_brand, p_partkey, round((n - pos) / n, 4) AS rank_score, round(1 / (1 + 0.1::DOUBLE * pos), 4) AS neighbour_score, round(rel, 4) AS relative FROM r""")
def list_rank_score(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    group = p.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("top"))
    r = H.numbered(p, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")]).withColumn("pos", F.col("rank") - 1).join(group, "p_brand")
    return r.select("p_brand", "p_partkey", F.round((F.col("n") - F.col("pos")) / F.col("n"), 4).alias("rank_score"), F.round(1 / (1 + 0.1 * F.col("pos")), 4).alias("neighbour_score"), F.round(F.col("p_retailprice") / F.col("top"), 4).alias("relative"))
