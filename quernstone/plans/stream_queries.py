"""Streams over the events table, run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import digests
from quernstone.plans.registry import query
from quernstone.sources.tables import dealt, new_folder, table
from quernstone.streaming import deliveries, intake, memory


@query("stream_window_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    out = intake.drained(intake.window_counts(intake.event_stream(spark, d), "event_type"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("stream_ledger_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, count(*) AS n_events FROM events GROUP BY user_id")
def stream_ledger_latest(spark, d):
    return intake.drained(intake.latest_state(intake.event_stream(spark, d), "user_id", "event_id", ["event_type"]), "complete")


@query("stream_ledger_status", """
SELECT user_id, coalesce(arg_min(event_type, event_id) FILTER (event_type IN ('purchase', 'error')), 'PENDING') AS status, min(event_id) FILTER (event_type IN ('purchase', 'error')) AS decided_at, count(*) AS n_events FROM events GROUP BY user_id""")
def stream_ledger_status(spark, d):
    """Purchases accept and errors reject, once: a decided candidate stays decided."""
    return intake.drained(intake.decided_state(intake.event_stream(spark, d), "user_id", "event_id", "event_type", ("purchase", "error")), "complete")


@query("stream_first_deliveries", """
SELECT user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d') AS delivery, count(DISTINCT user_id) AS n FROM events WHERE value > 1 GROUP BY ALL""")
def stream_first_deliveries(spark, d):
    """One accepted delivery for each user, type and day."""
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd"))
    s = intake.first_deliveries(intake.event_stream(spark, d), key, F.col("value") > 1, ttl=None)
    return intake.drained(s.select(key.alias("delivery"), F.lit(1).cast("long").alias("n")), "append")


UID = "CAST(user_id AS VARCHAR)"
EID = "CAST(event_id AS VARCHAR)"
#: The deliveries of both SQLs: an event's row as headers and a body; malformed, empty, foreign and repeated ones are among them.
DELIVERIES = f"""
d AS (SELECT event_id, epoch_us(ts) AS us, CASE WHEN event_id % 13 = 5 THEN 'ping' WHEN event_id % 13 = 6 THEN '' WHEN event_id % 13 = 8 THEN 'push' WHEN event_id % 13 IN (9, 10, 11) THEN 'issue_comment' ELSE 'issues' END AS event,
  CASE WHEN event_id % 13 = 7 THEN '' ELSE user_id || ':' || event_id % 3 END AS id,
  CASE event_id % 13 WHEN 0 THEN '{{"action": "opened", "issue": {{"title": "x"' WHEN 1 THEN '["opened"]' WHEN 2 THEN '{{"action": "opened", "repository": {{"name": "r' || {UID} || '"}}, "issue": {{"title": "t"}}}}'
    ELSE '{{"action": "' || CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'created' WHEN 'signup' THEN 'labeled' WHEN 'purchase' THEN 'closed' ELSE 'edited' END || '", "repository": {{"full_name": "' || CASE WHEN event_id % 13 = 3 THEN '../' ELSE 'o/' END || 'r' || {UID}
      || '", "default_branch": "dev"}}, "issue": {{"number": ' || {EID} || ', "title": "' || CASE WHEN event_id % 13 = 4 THEN ' ' ELSE 'T ' || event_type END || '", "body": ' || CASE WHEN event_id % 13 = 4 THEN 'null' ELSE '"see `pytest t_' || {UID} || '.py` or \\"é\\""' END
      || ', "labels": [{{"name": "bug"}}, "plain", {{"name": "' || event_type || '"}}, {{}}]}}, "comment": {{"body": "please ' || CASE WHEN event_id % 2 = 0 THEN '/Fix' ELSE 'look' END || ' it", "user": {{"login": "c"}}}}, "sender": {{"login": "s"}}, "more": ' || props || '}}' END AS body FROM events)"""


@query("stream_deliveries", f"""
WITH RECURSIVE {DELIVERIES},
j AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END v FROM d),
p AS (SELECT *, coalesce(v ->> '$.action', '') action, coalesce(nullif(v ->> '$.repository.full_name', ''), v ->> '$.repository.name', '') repo, coalesce(v ->> '$.issue.title', '') title, coalesce(v ->> '$.issue.body', '') text, coalesce(v ->> '$.comment.body', '') comment,
  coalesce(len(list_filter(CASE WHEN json_type(v) = 'OBJECT' THEN (v -> '$.issue.labels')::JSON[] ELSE [] END, lambda x: json_type(x) = 'OBJECT')), 0) n_labels FROM j),
s AS (SELECT *, CASE WHEN event = 'issue_comment' THEN text || chr(10) || chr(10) || 'Additional comment instruction:' || chr(10) || comment ELSE text END statement FROM p),
o AS (SELECT *, event = '' OR event = 'ping' OR id = '' early, CASE WHEN event = '' THEN 'no event' WHEN event = 'ping' THEN 'ping' WHEN id = '' THEN 'no delivery id' WHEN v IS NULL OR json_type(v) <> 'OBJECT' THEN 'malformed body' WHEN event = 'push' THEN 'event ignored'
  WHEN event = 'issues' AND action NOT IN ('opened', 'reopened', 'labeled', 'edited') THEN 'action ignored' WHEN event = 'issue_comment' AND action <> 'created' THEN 'comment ignored' WHEN event = 'issue_comment' AND NOT contains(lower(comment), '/fix') THEN 'no command'
  WHEN trim(repo) = '' THEN 'no repository' WHEN trim(title) = '' AND trim(statement) = '' THEN 'no title or statement' WHEN contains(repo, '..') THEN 'repository leaves its folder' ELSE 'accepted' END reason FROM s),
a(id, us, event_id) AS (SELECT id, min(us), arg_min(event_id, (us, event_id)) FROM o WHERE NOT early AND reason = 'accepted' GROUP BY id
  UNION ALL SELECT a.id, min(o.us), arg_min(o.event_id, (o.us, o.event_id)) FROM a JOIN o ON o.id = a.id AND NOT o.early AND o.reason = 'accepted' AND o.us - a.us > 43200000000 GROUP BY a.id, a.us),
r AS (SELECT o.*, EXISTS (SELECT 1 FROM a WHERE a.id = o.id AND NOT o.early AND (o.us, o.event_id) > (a.us, a.event_id) AND o.us - a.us <= 43200000000) again FROM o),
f AS (SELECT *, CASE WHEN again THEN 'duplicate' ELSE reason END said FROM r)
SELECT said AS reason, CASE WHEN said IN ('no event', 'no delivery id', 'malformed body') THEN 400 WHEN said IN ('no repository', 'no title or statement', 'repository leaves its folder') THEN 422 ELSE 200 END::INTEGER AS status,
  count(*) AS n, min(event_id) AS first_event, count(DISTINCT id) FILTER (said = 'accepted') AS ids, coalesce(sum(length(statement)) FILTER (said = 'accepted'), 0)::BIGINT AS statement_chars, coalesce(sum(n_labels) FILTER (said = 'accepted'), 0)::BIGINT AS labels,
  count(*) FILTER (said = 'accepted' AND event = 'issues' AND contains(text, 'pytest')) AS commands FROM f GROUP BY said""")
def stream_deliveries(spark, d):
    """Events as signed deliveries of a hub, an id remembered for half a day of their own clock; each outcome's sink is read back."""
    c = F.col
    n = c("event_id") % 13
    t = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    event = F.when(n == 5, "ping").when(n == 6, "").when(n == 8, "push").when(n.isin(9, 10, 11), "issue_comment").otherwise("issues")
    action = F.when(c("event_type") == "view", "opened").when(c("event_type") == "click", "created").when(c("event_type") == "signup", "labeled").when(c("event_type") == "purchase", "closed").otherwise("edited")
    text = F.when(n == 4, "null").otherwise(t('"see `pytest t_', c("user_id"), '.py` or \\"é\\""'))
    full = t('{"action": "', action, '", "repository": {"full_name": "', F.when(n == 3, "../").otherwise("o/"), "r", c("user_id"), '", "default_branch": "dev"}, "issue": {"number": ', c("event_id"), ', "title": "', F.when(n == 4, " ").otherwise(t("T ", c("event_type"))),
             '", "body": ', text, ', "labels": [{"name": "bug"}, "plain", {"name": "', c("event_type"), '"}, {}]}, "comment": {"body": "please ', F.when(c("event_id") % 2 == 0, "/Fix").otherwise("look"), ' it", "user": {"login": "c"}}, "sender": {"login": "s"}, "more": ', c("props"), "}")
    body = F.when(n == 0, '{"action": "opened", "issue": {"title": "x"').when(n == 1, '["opened"]').when(n == 2, t('{"action": "opened", "repository": {"name": "r', c("user_id"), '"}, "issue": {"title": "t"}}')).otherwise(full)
    delivery = F.when(n == 7, "").otherwise(t(c("user_id"), ":", c("event_id") % 3))
    secret = b"of the stream"
    # the checks are long for each row, and a file is read by one task
    s = dealt(intake.event_stream(spark, d), "event_id").withColumn("body", body)
    headers = F.create_map(F.lit("X-Hub-Event"), event, F.lit("x-hub-Delivery"), delivery, F.lit("X-HUB-SIGNATURE-256"), F.concat(F.lit("sha256="), digests.hmac_sha256(c("body"), secret)))
    decided = deliveries.hub(s.withColumn("headers", headers), secret)
    path = new_folder(spark)
    deliveries.settle(deliveries.once_each(decided, "ts", "event_id", 43_200), path)
    out = deliveries.settled(spark, path).withColumn("ok", c("sink") == "accepted")
    item = c("verdict.item")
    return out.groupBy("verdict.reason", "verdict.status").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_event"), F.countDistinct(F.when(c("ok"), item["event_id"])).alias("ids"), F.coalesce(F.sum(F.when(c("ok"), F.length(item["statement"]))), F.lit(0)).cast("long").alias("statement_chars"),
        F.coalesce(F.sum(F.when(c("ok"), F.size(item["labels"]))), F.lit(0)).cast("long").alias("labels"), F.count_if(c("ok") & (item["reproduction"] != "")).alias("commands"),
    )


RECALL = """s AS (SELECT s_suppkey AS id, 'Brand#' || s_suppkey % 25 AS repo, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE split_part(s_name, '#', 1) || '.r' || s_suppkey % 9 END AS symbol, 'A small ' || CASE s_suppkey % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'bolt widget' ELSE 'GEAR' END AS text, s_suppkey % 3 AS batch FROM supplier),
p AS (SELECT p_partkey + 1000000 AS id, p_brand AS repo, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'r' || p_partkey % 40 END AS symbol, p_name AS text, p_size % 2 = 0 AS resolved, -1 AS batch FROM part),
e AS (SELECT * FROM p WHERE resolved UNION ALL SELECT id, repo, symbol, text, true, batch FROM s),
w AS (SELECT s.id task, e.id episode, s.repo = e.repo same, lower(s.symbol) a, lower(e.symbol) b, list_distinct(regexp_extract_all(lower(s.text), '[a-zA-Z_][a-zA-Z0-9_]*')) x, list_distinct(regexp_extract_all(lower(coalesce(e.text, '')), '[a-zA-Z_][a-zA-Z0-9_]*')) y, e.batch FROM s JOIN e ON {where} AND s.id <> e.id),
v AS (SELECT task, episode, batch, CASE WHEN same THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) THEN 0.4::DOUBLE ELSE 0 END + 0.3::DOUBLE * (len(list_intersect(x, y))::DOUBLE / len(list_distinct(x || y))) + 0.1::DOUBLE AS exact FROM w),
r AS (SELECT task, episode, batch, round(exact, 3) AS score FROM v WHERE exact > 0.1 QUALIFY row_number() OVER (PARTITION BY task ORDER BY round(exact, 3) DESC, episode) <= 3)"""


@query("stream_memory_modes", f"""
WITH {RECALL.format(where='e.batch < s.batch')}, f AS (SELECT * FROM (SELECT task, episode, batch, round(exact, 3) AS score FROM v WHERE exact > 0.1 AND batch < 0) QUALIFY row_number() OVER (PARTITION BY task ORDER BY score DESC, episode) <= 3)
SELECT 'ONLINE' AS mode, count(*) AS n, count(*) FILTER (batch >= 0) AS recorded, sum(episode)::BIGINT AS episodes, round(sum(score), 3) AS score FROM r UNION ALL SELECT 'FROZEN', count(*), 0, sum(episode)::BIGINT, round(sum(score), 3) FROM f UNION ALL SELECT 'DISABLED', 0, 0, NULL, NULL""")
def stream_memory_modes(spark, d):
    """Suppliers as tasks in three batches, parts as past episodes: each mode recalls what it may see."""
    c = F.col
    n = c("s_suppkey") % 3
    what = F.when(n == 0, "ring").when(n == 1, "bolt widget").otherwise("GEAR")
    symbol = F.when(c("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.split("s_name", "#")[0], F.lit(".r"), c("s_suppkey") % 9))
    tasks = table(spark, d, "supplier").select(c("s_suppkey").alias("id"), F.concat(F.lit("Brand#"), c("s_suppkey") % 25).alias("repo"), symbol.alias("symbol"), F.concat(F.lit("A small "), what).alias("text"), F.lit(True).alias("resolved"), n.alias("n"))
    past = table(spark, d, "part").select((c("p_partkey") + 1_000_000).alias("id"), c("p_brand").alias("repo"), F.when(c("p_partkey") % 5 > 0, F.concat(F.lit("r"), c("p_partkey") % 40)).alias("symbol"), c("p_name").alias("text"), (c("p_size") % 2 == 0).alias("resolved"))
    source = new_folder(spark)
    for b in range(3):  # in this order, a file each
        tasks.where(c("n") == b).drop("n").coalesce(1).write.mode("append").json(source)
    out = None
    for mode in ("ONLINE", "FROZEN", "DISABLED"):
        folder, path = new_folder(spark), new_folder(spark)
        memory.Memory(spark, folder).record(past, "past")
        stream = spark.readStream.schema(memory.EPISODE).option("maxFilesPerTrigger", 1).json(source)
        memory.answer(stream, memory.Memory(spark, folder, mode), path)
        rows = spark.read.schema("task long, episode long, score double, rank long").parquet(f"{path}/rows")
        one = rows.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.count_if(c("episode") < 1_000_000).alias("recorded"), F.sum("episode").alias("episodes"), F.round(F.sum("score"), 3).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out
