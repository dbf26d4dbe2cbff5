"""Places and their evidence, decisions that stay, and records written as JSON and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators import evidence as E
from quernstone.operators import spans as S
from quernstone.operators import verdicts as V
from quernstone.plans.registry import query
from quernstone.sources import records as R
from quernstone.sources.tables import new_folder, table


@query("overlap_free", """
WITH RECURSIVE s AS (SELECT l_orderkey k, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) lo, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT hi, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_quantity) r FROM lineitem),
g(k, r, kept) AS (SELECT DISTINCT k, 0::BIGINT, []::STRUCT(lo BIGINT, hi BIGINT)[] FROM s UNION ALL SELECT g.k, s.r, CASE WHEN len(list_filter(kept, lambda x: greatest(x.lo, s.lo) <= least(x.hi, s.hi))) = 0 THEN list_append(kept, {'lo': s.lo, 'hi': s.hi}) ELSE kept END FROM g JOIN s ON s.k = g.k AND s.r = g.r + 1)
SELECT k AS l_orderkey, max(r) AS n, len(arg_max(kept, r))::BIGINT AS n_kept, list_sum(list_transform(arg_max(kept, r), lambda x: x.hi - x.lo))::BIGINT AS days FROM g GROUP BY k""")
def overlap_free(spark, d):
    """An order's delivery spans, first come first kept."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", day.alias("lo"), (day + F.col("l_quantity").cast("long")).alias("hi"))
    k = S.kept_first(s, "l_orderkey", ["l_linenumber"])
    return k.select("l_orderkey", "n", F.size("kept").cast("long").alias("n_kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"]).alias("days"))


@query("profile_lookup", """
WITH s AS (SELECT p_partkey, p_partkey % 7 t, 'src/b' || p_size || '.py' path, 'b' || p_size || '.py' base, 'C' || p_partkey % 9 || '.m' || p_partkey % 11 sym, 'm' || p_partkey % 11 clean FROM part),
k AS (SELECT s_suppkey v, CASE s_suppkey % 6 WHEN 0 THEN 'src/b' || s_suppkey % 50 || '.py:C' || s_suppkey % 9 || '.m' || s_suppkey % 11 WHEN 1 THEN 'b' || s_suppkey % 50 || '.py:C' || s_suppkey % 9 || '.m' || s_suppkey % 11
  WHEN 2 THEN 'src/b' || s_suppkey % 50 || '.py:m' || s_suppkey % 11 WHEN 3 THEN 'b' || s_suppkey % 50 || '.py:m' || s_suppkey % 11 WHEN 4 THEN 'C' || s_suppkey % 9 || '.m' || s_suppkey % 11 ELSE 'm' || s_suppkey % 8 END key FROM supplier),
l AS (SELECT key, max(v) v FROM k GROUP BY key), c AS (SELECT p_partkey, unnest([CASE WHEN t > 0 THEN path || ':' || sym END, CASE WHEN t > 0 THEN base || ':' || sym END, CASE WHEN t > 0 THEN path || ':' || clean END, CASE WHEN t > 0 THEN base || ':' || clean END, sym, clean]) key, unnest([1, 2, 3, 4, 5, 6]) n FROM s),
m AS (SELECT p_partkey, min(n)::BIGINT tier, arg_min(v, n) v FROM c JOIN l USING (key) GROUP BY p_partkey)
SELECT p_partkey, v AS profile, tier FROM s LEFT JOIN m USING (p_partkey)""")
def profile_lookup(spark, d):
    """Parts as sites of a file and a method, suppliers as profiles under keys of six precisions."""
    c = F.col
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    p, s = c("p_partkey"), c("s_suppkey")
    sites = table(spark, d, "part").select("p_partkey", F.when(p % 7 > 0, text("src\\b", c("p_size"), ".py")).otherwise("").alias("path"), text("C", p % 9, ".m", p % 11).alias("symbol"))
    file, sym, clean = text("b", s % 50, ".py"), text("C", s % 9, ".m", s % 11), text("m", s % 11)
    key = F.when(s % 6 == 0, text("src/", file, ":", sym)).when(s % 6 == 1, text(file, ":", sym)).when(s % 6 == 2, text("src/", file, ":", clean)).when(s % 6 == 3, text(file, ":", clean)).when(s % 6 == 4, sym).otherwise(text("m", s % 8))
    profiles = table(spark, d, "supplier").select(key.alias("key"), s.alias("profile"), s.alias("seq"))
    return E.looked_up(sites, profiles, E.site_keys(c("path"), c("symbol")), "key", "profile", "seq").select("p_partkey", "profile", "tier")


@query("divergence_point", """
WITH l AS (SELECT user_id, avg(event_id) m FROM events GROUP BY user_id), e AS (SELECT events.*, CASE WHEN user_id % 4 > 0 THEN m END lim FROM events JOIN l USING (user_id)),
f AS (SELECT user_id, min(event_id) FILTER (event_id <= lim AND event_type = 'error') b, min(event_id) FILTER (event_id <= lim) n, min(event_id) x FROM e GROUP BY user_id)
SELECT user_id, coalesce(b, n, x) AS at, n IS NOT NULL AS within FROM f""")
def divergence_point(spark, d):
    """A user's events as a trace: errors are its branches, the mean id its assertion line, which every fourth user lacks."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    e = e.join(e.groupBy("user_id").agg(F.avg("event_id").alias("m")), "user_id").withColumn("lim", F.when(F.col("user_id") % 4 > 0, F.col("m")))
    return E.divergence(e, "user_id", "event_id", F.col("event_type") == "error", F.col("lim"))


@query("frame_depth", """
WITH f AS (SELECT l_orderkey k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) i, l_quantity q FROM lineitem)
SELECT k AS orderkey, count(*) AS n_frames, max(i) FILTER (q BETWEEN 10 AND 30) AS depth, CASE WHEN max(i) FILTER (q BETWEEN 10 AND 30) IS NULL THEN 0 ELSE 30 + round(max(i) FILTER (q BETWEEN 10 AND 30) / count(*) * 30, 1) END::DOUBLE AS points FROM f GROUP BY k""")
def frame_depth(spark, d):
    """An order's lines as frames; those of ten to thirty pieces lie in the candidate's span. The innermost such frame counts, by its share of the depth."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    f = table(spark, d, "lineitem").withColumn("i", F.row_number().over(w).cast("long"))
    g = f.groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.count("*").alias("n_frames"), F.max(F.when(F.col("l_quantity").between(10, 30), F.col("i"))).alias("depth"))
    return g.withColumn("points", F.when(F.col("depth").isNull(), 0.0).otherwise(30 + F.round(F.col("depth") / F.col("n_frames") * 30, 1)))


@query("file_score", """
WITH w AS (SELECT p_partkey, p_brand, p_size, string_split(p_name, ' ')[1] w FROM part), t AS (SELECT p_brand, w, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) r FROM w),
i AS (SELECT p_brand, max(CASE WHEN r = 1 THEN w END) w1, max(CASE WHEN r = 2 THEN w END) w2, max(CASE WHEN r = 3 THEN w END) w3 FROM t GROUP BY p_brand),
s AS (SELECT p_brand, CASE WHEN w = w1 THEN 30 WHEN w = w2 THEN 25 WHEN w = w3 THEN CASE WHEN p_size > 25 THEN 20 WHEN length(w) >= 6 THEN 15 ELSE 8 END ELSE 0 END pts FROM w JOIN i USING (p_brand))
SELECT p_brand, (sum(pts) + 15.0 * least(3, 1 + any_value(length(p_brand)) % 5))::DOUBLE AS score FROM s GROUP BY p_brand""")
def file_score(spark, d):
    """A brand as a file with its parts as symbols, and an issue that names three of them and the file a few times."""
    c = F.col
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.split("p_name", " ")[0].alias("w"))
    first = p.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("r <= 3")
    word = lambda n: F.max(F.when(c("r") == n, c("w")))
    times = (1 + F.length("p_brand") % 5).cast("int")
    stem = F.concat(F.lit("stem"), F.regexp_replace("p_brand", "[^0-9]", ""))
    issue = F.concat(F.lit("then zz."), c("w1"), F.lit("(1) fails, see `a."), c("w2"), F.lit("` and "), F.upper("w3"), F.lit(" "), F.repeat(F.concat(stem, F.lit(" ")), times))
    issues = first.groupBy("p_brand").agg(word(1).alias("w1"), word(2).alias("w2"), word(3).alias("w3")).select("p_brand", issue.alias("issue"))
    pts = V.symbol_points(c("w"), F.when(c("p_size") > 25, "class").otherwise("method"), c("issue"))
    count = F.size(F.filter(F.regexp_extract_all("issue", F.lit("([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1)), lambda x: x == stem))
    s = p.join(issues, "p_brand").withColumns({"pts": pts, "named": F.least(F.lit(3), count)})
    return s.groupBy("p_brand").agg((F.sum("pts") + 15.0 * F.max("named")).alias("score"))


@query("ledger_decisions", """
WITH d AS (SELECT user_id, min(event_id) a FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT user_id, coalesce(max(CASE WHEN event_id = a THEN event_type END), 'PENDING') AS status, count(*) FILTER (event_type = 'view' AND (a IS NULL OR event_id < a)) AS n_observed, count(*) FILTER (event_id > a) AS n_late FROM events LEFT JOIN d USING (user_id) GROUP BY user_id""")
def ledger_decisions(spark, d):
    """Purchases accept and errors reject a user's candidate, once; views observe it while it is open."""
    return E.decided(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", ("purchase", "error"), "view")


@query("evidence_store", """
WITH e AS (SELECT l_suppkey f, l_partkey % 50 s, l_returnflag t, l_linestatus x, l_orderkey o, l_linenumber n FROM lineitem)
SELECT f AS suppkey, count(*) AS n, count(DISTINCT (s, t)) AS n_distinct, count(DISTINCT (s, x)) AS n_stored, min(o) AS first_order FROM e GROUP BY f""")
def evidence_store(spark, d):
    """A supplier's lines as evidence: kept once by (symbol, explanation), counted by (symbol, type)."""
    e = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("s"), "l_returnflag", "l_linestatus", "l_orderkey")
    return e.groupBy(F.col("l_suppkey").alias("suppkey")).agg(F.count("*").alias("n"), F.countDistinct("s", "l_returnflag").alias("n_distinct"), F.countDistinct("s", "l_linestatus").alias("n_stored"), F.min("l_orderkey").alias("first_order"))


@query("localized_places", """
WITH f AS (SELECT o_custkey c, o_orderkey file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 nth, count(*) OVER (PARTITION BY o_custkey) n, o_orderpriority = '1-URGENT' m FROM orders),
h AS (SELECT c, file, p_name || '#' || p_partkey sym, l_returnflag = 'R' rel, p_size > 25 nb, contains(p_type, 'TIN') iss, p_size % 7 = 0 tst, 0.5::DOUBLE * ((n - nth) / n) half FROM lineitem JOIN f ON file = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('A', 'R')),
a AS (SELECT c, file, '' sym, 0.5::DOUBLE * ((n - nth) / n) + CASE WHEN m THEN 0.1::DOUBLE ELSE 0 END s, false nb FROM f UNION ALL SELECT c, file, sym, half + CASE WHEN rel THEN 0.3::DOUBLE + CASE WHEN iss THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN tst THEN 0.15::DOUBLE ELSE 0 END ELSE 0.2::DOUBLE END, nb FROM h),
g AS (SELECT c, file, sym, round((sum(round(s * 1000000::DOUBLE)::BIGINT) + CASE WHEN bool_or(nb) THEN 200000 ELSE 0 END)::DOUBLE / 1000000::DOUBLE, 3) score FROM a GROUP BY c, file, sym), p AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY c, file ORDER BY score DESC, sym = '', sym) <= 3)
SELECT c AS o_custkey, file, sym AS symbol, score, row_number() OVER (PARTITION BY c ORDER BY score DESC, sym = '', file, sym) AS rank FROM p QUALIFY rank <= 7""")
def localized_places(spark, d):
    """A customer's orders as ranked files, their turned lines as places in them."""
    c = F.col
    w = Window.partitionBy("o_custkey")
    f = table(spark, d, "orders").select("o_custkey", c("o_orderkey").alias("file"), (F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1).alias("nth"), F.count("*").over(w).alias("n"), (c("o_orderpriority") == "1-URGENT").alias("mentioned"))
    part = table(spark, d, "part").select(c("p_partkey").alias("l_partkey"), F.concat("p_name", F.lit("#"), "p_partkey").alias("symbol"), (c("p_size") > 25).alias("neighbour"), c("p_type").contains("TIN").alias("issue"), (c("p_size") % 7 == 0).alias("test"))
    h = table(spark, d, "lineitem").where("l_returnflag IN ('A', 'R')").select(c("l_orderkey").alias("file"), "l_partkey", F.when(c("l_returnflag") == "R", "related").otherwise("edit").alias("source")).join(part, "l_partkey").join(f.select("o_custkey", "file"), "file")
    return E.localized(f, h.drop("l_partkey"), "o_custkey")


@query("work_to_do", """
SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 12 = 0 GROUP BY o_custkey""")
def work_to_do(spark, d):
    """Every third order has a result in a ledger of JSON lines; of those every fourth has changed since. What is left is the rest."""
    path = new_folder(spark)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", F.col("o_orderstatus").alias("state"))
    done = orders.where("key % 3 = 0").withColumn("state", F.when(F.col("key") % 12 == 0, "old").otherwise(F.col("state")))
    fp = R.fingerprint("key", "state")
    R.append(done.where("key % 2 = 0").select("key", fp.alias("fingerprint"), F.lit("done").alias("event")), path)
    R.append(done.where("key % 2 = 1").select("key", fp.alias("fingerprint"), F.lit("done").alias("event")), path)
    found = R.lines(spark, path, "event string, fingerprint string, key long", F.col("event") == "done")
    left = R.to_do(orders.withColumn("fingerprint", fp), found, "key", "fingerprint")
    return left.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))
