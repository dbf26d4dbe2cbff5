"""Text, retrieval and search queries over documents, benchmark, conversations, part and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import retrieval as R
from quernstone.operators import rules
from quernstone.operators import search as X
from quernstone.operators.overlaps import overlapping
from quernstone.operators.temporal import churn
from quernstone.plans.registry import query
from quernstone.sources.tables import table

TOKS = "list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[a-zA-Z_][a-zA-Z0-9_]*'), lambda x: lower(x)), lambda x: length(x) > 2)"
SET = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-zA-Z_][a-zA-Z0-9_]*'))"
LINES = "(SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::BIGINT AS line_no FROM documents)"


@query("tokenize_counts", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKS.format('text')}) AS term FROM documents) GROUP BY ALL")
def tokenize_counts(spark, d):
    return R.term_counts(table(spark, d, "documents"), "doc_id")


@query("idf_terms", f"""
WITH t AS (SELECT doc_id, unnest(list_distinct({TOKS.format('text')})) term FROM documents),
q AS (SELECT DISTINCT unnest({TOKS.format('text')}) term FROM benchmark), n AS (SELECT count(*) n FROM documents)
SELECT term, count(*) AS df, round(greatest(0.1, ln(((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5) + 1)), 4) AS idf FROM t SEMI JOIN q USING (term) GROUP BY term""")
def idf_terms(spark, d):
    docs = table(spark, d, "documents")
    terms = table(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    out = R.idf(R.term_counts(docs, "doc_id"), docs.agg(F.count("*").alias("n_docs")), terms)
    return out.withColumn("idf", F.round("idf", 4))


BM25 = f"""
c AS (SELECT doc_id, {TOKS.format('text')} toks FROM documents), st AS (SELECT count(*) n, avg(len(toks)) avgdl FROM c),
p AS (SELECT doc_id, dl, term, count(*) tf FROM (SELECT doc_id, len(toks) dl, unnest(toks) term FROM c) GROUP BY ALL),
q AS (SELECT item_id, unnest(list_distinct({TOKS.format('text')})) term FROM benchmark),
f AS (SELECT term, count(*) df FROM p GROUP BY term),
w AS (SELECT item_id, term, greatest(0.1::DOUBLE, ln((n - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE) + 1)) idf FROM q LEFT JOIN f USING (term), st),
b AS (SELECT item_id, sum(idf * 2.5::DOUBLE) most FROM w GROUP BY item_id),
s AS (SELECT item_id, doc_id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(1, avgdl)))) x FROM w JOIN p USING (term), st GROUP BY ALL),
bm AS (SELECT item_id, doc_id, round(least(1, greatest(0, x / most)), 4) AS score FROM s JOIN b USING (item_id))"""


@query("bm25_topk", f"WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm) SELECT * FROM r WHERE rank <= 10")
def bm25_topk(spark, d):
    hits = X.searched(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", 10, "lexical")
    return hits.select("item_id", "doc_id", F.col("lexical").alias("score"), "rank")


GRAMS = "unnest(list_transform(range(1, greatest(length(t), 1) + 1), lambda i: substr('^' || t || '$', i, 3)))"
COSINE = f"""
gq AS (SELECT g, count(*) qn FROM (SELECT {GRAMS} g FROM (SELECT unnest({TOKS.format('text')}) t FROM (SELECT arg_min(text, item_id) AS text FROM benchmark))) GROUP BY g),
gd AS (SELECT doc_id, g, count(*) n FROM (SELECT doc_id, {GRAMS} g FROM (SELECT doc_id, unnest({TOKS.format('text')}) t FROM documents)) GROUP BY ALL),
cs AS (SELECT doc_id, round(least(1, sum(n * qn) / (sqrt(sum(n * n)) * sqrt((SELECT sum(qn * qn) FROM gq)))), 4) AS score FROM gd LEFT JOIN gq USING (g) GROUP BY doc_id HAVING sum(n * qn) > 0)"""


def first_item(spark, d):
    """The benchmark item with the least id: the one query text."""
    return table(spark, d, "benchmark").agg(F.min("item_id").alias("item_id"), F.min_by("text", "item_id").alias("text"))


@query("trigram_cosine_topk", f"WITH {COSINE} SELECT doc_id, score FROM cs ORDER BY score DESC, doc_id LIMIT 10")
def trigram_cosine_topk(spark, d):
    return _cosine(first_item(spark, d), table(spark, d, "documents")).orderBy(F.desc("score"), "doc_id").select("doc_id", "score")


def _cosine(items, docs):
    """The first ten documents of each item by the cosine of gram counts."""
    return X.searched(items, docs, "item_id", "doc_id", 10, "dense").select("item_id", "doc_id", F.col("dense").alias("score"), "rank")


def with_static(docs, labels):
    """doc_id, text and the channels that a document has by its source: languages, churn and labels."""
    per_source = docs.select("doc_id", "source", "lang").join(labels.select("doc_id", "quality"), "doc_id", "left").groupBy(F.col("source").alias("s")).agg(
        F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 0).alias("fixes"), F.countDistinct("lang").alias("langs"))
    return docs.join(per_source, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "text", F.least(F.lit(1.0), F.col("langs") / 10).alias("graph"), churn(F.col("n"), F.col("fixes")).alias("temporal"), F.least(F.lit(1.0), F.col("labelled") / 5).alias("test"))


def _fusion(spark, d, items):
    """The first ten documents of each item by the fused channels."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    return X.searched(items, with_static(docs, table(spark, d, "labels")), "item_id", "doc_id", 10)


@query("hybrid_fusion_topk", f"""
WITH {BM25}, {COSINE}, i AS (SELECT min(item_id) item_id, {TOKS.format('arg_min(text, item_id)')} qt FROM benchmark),
src AS (SELECT source, count(*) n, count(l.doc_id) labelled, count(*) FILTER (quality = 0) fixes, count(DISTINCT lang) langs FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source),
ch AS (SELECT d.doc_id, coalesce(bm.score, 0) lexical, coalesce(cs.score, 0) dense, least(1, langs / 10) graph, CASE WHEN list_contains(c.toks, qt[1]) THEN 1.0::DOUBLE ELSE 0 END traceback,
  round(least(1, n / 20 + fixes / 5 * 0.5::DOUBLE), 3) temporal, least(1, labelled / 5) test, CASE WHEN list_contains(c.toks, qt[2]) THEN 1 ELSE 0 END mention
  FROM documents d JOIN c USING (doc_id) JOIN src ON d.source IS NOT DISTINCT FROM src.source CROSS JOIN i LEFT JOIN bm ON bm.doc_id = d.doc_id AND bm.item_id = i.item_id LEFT JOIN cs ON cs.doc_id = d.doc_id)
SELECT doc_id, lexical, dense, graph, traceback, temporal, test, round(0.0 + 0.25*lexical + 0.15*dense + 0.2*graph + 0.2*traceback + 0.1*temporal + 0.1*test + 0.1*mention, 4)::DOUBLE AS score
FROM ch ORDER BY score DESC, doc_id LIMIT 10""")
def hybrid_fusion_topk(spark, d):
    return _fusion(spark, d, first_item(spark, d)).orderBy(F.desc("score"), "doc_id").drop("item_id", "rank")


COSINES = f"""
iq AS (SELECT item_id, g, count(*) qn FROM (SELECT item_id, {GRAMS} g FROM (SELECT item_id, unnest({TOKS.format('text')}) t FROM benchmark)) GROUP BY ALL), iqq AS (SELECT item_id, sum(qn * qn) qq FROM iq GROUP BY item_id),
id AS (SELECT doc_id, g, count(*) n FROM (SELECT doc_id, {GRAMS} g FROM (SELECT doc_id, unnest({TOKS.format('text')}) t FROM documents)) GROUP BY ALL), idd AS (SELECT doc_id, sum(n * n) nn FROM id GROUP BY doc_id),
ics AS (SELECT item_id, doc_id, round(least(1, dot / (sqrt(nn) * sqrt(qq))), 4) AS score FROM (SELECT item_id, doc_id, sum(n * qn) dot FROM id JOIN iq USING (g) GROUP BY ALL) JOIN iqq USING (item_id) JOIN idd USING (doc_id))"""


@query("trigram_cosine_each", f"WITH {COSINES}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ics) SELECT * FROM r WHERE rank <= 10")
def trigram_cosine_each(spark, d):
    """The first ten documents of every benchmark item."""
    return _cosine(table(spark, d, "benchmark"), table(spark, d, "documents"))


@query("hybrid_fusion_each", f"""
WITH {BM25}, {COSINES}, i AS (SELECT item_id, {TOKS.format('text')} qt FROM benchmark),
src AS (SELECT source, count(*) n, count(l.doc_id) labelled, count(*) FILTER (quality = 0) fixes, count(DISTINCT lang) langs FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source),
ch AS (SELECT i.item_id, d.doc_id, coalesce(bm.score, 0) lexical, coalesce(ics.score, 0) dense, least(1, langs / 10) graph, CASE WHEN list_contains(c.toks, qt[1]) THEN 1.0::DOUBLE ELSE 0 END traceback,
  round(least(1, n / 20 + fixes / 5 * 0.5::DOUBLE), 3) temporal, least(1, labelled / 5) test, CASE WHEN list_contains(c.toks, qt[2]) THEN 1 ELSE 0 END mention
  FROM documents d JOIN c USING (doc_id) JOIN src ON d.source IS NOT DISTINCT FROM src.source CROSS JOIN i LEFT JOIN bm ON bm.doc_id = d.doc_id AND bm.item_id = i.item_id LEFT JOIN ics ON ics.doc_id = d.doc_id AND ics.item_id = i.item_id),
r AS (SELECT item_id, doc_id, round(0.0 + 0.25*lexical + 0.15*dense + 0.2*graph + 0.2*traceback + 0.1*temporal + 0.1*test + 0.1*mention, 4)::DOUBLE AS score FROM ch)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""")
def hybrid_fusion_each(spark, d):
    """The first ten documents of every benchmark item by the fused channels."""
    return _fusion(spark, d, table(spark, d, "benchmark").select("item_id", "text")).select("item_id", "doc_id", "score", "rank")


@query("jaccard_exemplars", f"""
WITH e AS (SELECT doc_id, source, {SET.format('text')} s, regexp_extract(lower(coalesce(text, '')), '[a-z_][a-z0-9_]*') f, quality FROM documents LEFT JOIN labels USING (doc_id)), cur AS (SELECT doc_id cid, source csource, s cs, f cf FROM e WHERE doc_id = (SELECT min(doc_id) FROM documents)),
j AS (SELECT doc_id, source IS NOT DISTINCT FROM csource same, list_contains(s, cf) held, len(list_intersect(s, cs)) n, len(s) + len(cs) m, quality FROM e, cur WHERE doc_id <> cid)
SELECT doc_id, round(CASE WHEN same THEN 0.3 ELSE 0 END + CASE WHEN held THEN 0.4 ELSE 0 END + CASE WHEN m > n THEN 0.3 * n / (m - n) ELSE 0 END + CASE WHEN quality = 1 THEN 0.1 ELSE 0 END, 3)::DOUBLE AS similarity
FROM j WHERE CASE WHEN same THEN 0.3 ELSE 0 END + CASE WHEN held THEN 0.4 ELSE 0 END + CASE WHEN m > n THEN 0.3 * n / (m - n) ELSE 0 END + CASE WHEN quality = 1 THEN 0.1 ELSE 0 END > 0.1
ORDER BY similarity DESC, doc_id LIMIT 3""")
def jaccard_exemplars(spark, d):
    e = table(spark, d, "documents").select("doc_id", "source", T.token_set(F.col("text")).alias("s"))
    current = e.agg(F.min("doc_id").alias("cid"), F.min_by("source", "doc_id").alias("csource"), F.min_by("s", "doc_id").alias("cs"))
    e = e.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").crossJoin(F.broadcast(current)).where("doc_id <> cid")
    held = F.array_contains("s", F.get("cs", F.lit(0)))
    total = rules.points((F.col("source").eqNullSafe(F.col("csource")), 0.3), (held, 0.4), (F.col("quality") == 1, 0.1)) + 0.3 * T.jaccard(F.col("s"), F.col("cs"))
    return e.withColumn("x", total).where("x > 0.1").select("doc_id", F.round("x", 3).alias("similarity")).orderBy(F.desc("similarity"), "doc_id").limit(3)


LIKENESS = "CASE WHEN same THEN 0.3 ELSE 0 END + CASE WHEN held THEN 0.4 ELSE 0 END + CASE WHEN m > n THEN 0.3 * n / (m - n) ELSE 0 END + CASE WHEN quality = 1 THEN 0.1 ELSE 0 END"


@query("jaccard_exemplars_each", f"""
WITH e AS (SELECT doc_id, source, {SET.format('text')} s, regexp_extract(lower(coalesce(text, '')), '[a-z_][a-z0-9_]*') f, quality FROM documents LEFT JOIN labels USING (doc_id)), cur AS (SELECT doc_id cid, source csource, s cs, f cf FROM e WHERE doc_id % 100 = 0),
j AS (SELECT cid, doc_id, source IS NOT DISTINCT FROM csource same, list_contains(s, cf) held, len(list_intersect(s, cs)) n, len(s) + len(cs) m, quality FROM e, cur WHERE doc_id <> cid),
x AS (SELECT cid, doc_id, round({LIKENESS}, 3)::DOUBLE AS similarity FROM j WHERE {LIKENESS} > 0.1)
SELECT cid AS current, doc_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY similarity DESC, doc_id) AS rank FROM x) WHERE rank <= 3""")
def jaccard_exemplars_each(spark, d):
    """The three documents most like each document whose id is divisible by 100."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    good = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return X.exemplars(docs.join(good, "doc_id", "left"), docs.where("doc_id % 100 = 0"), 3)


@query("symbol_search_each", """
WITH q AS (SELECT p_partkey k, p_name AS name, lower(string_split(p_name, ' ')[1]) w FROM part WHERE p_partkey % 100 = 0),
h AS (SELECT k, p_partkey, p_name, p_brand, (CASE WHEN p_name = q.name THEN 0 ELSE 1 END)::BIGINT AS tier FROM q JOIN part ON contains(lower(p_name), w))
SELECT k AS query, p_partkey, p_name, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, p_brand, p_partkey, p_name) AS rank FROM h) WHERE rank <= 10""")
def symbol_search_each(spark, d):
    """The first ten parts for each part whose key is divisible by 100, by the first word of its name: exact names first.

    Words are searched once each: a name's parts of up to three letters meet the distinct words' first three, and the whole words decide. A query then needs the first parts of its word
    and those of its very name, ten of each at most."""
    c = F.col
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    q = part.where("p_partkey % 100 = 0").select(c("p_partkey").alias("query"), c("p_name").alias("name"), F.lower(F.get(F.split("p_name", " "), F.lit(0))).alias("w"))
    low = F.lower("p_name")
    words = q.where("w <> ''").select("w").distinct()
    order = [F.asc("p_brand"), F.asc("p_partkey"), F.asc("p_name")]
    keyed = part.select("*", F.explode(T.parts(low, 1, 3)).alias("key"))
    hits = keyed.join(words.withColumn("key", F.substring("w", 1, 3)), "key").where(low.contains(c("w"))).drop("key")
    first = R.top(hits, ["w"], order, 20, "_r").drop("_r")
    exact = R.top(part.join(q.select(c("name").alias("p_name")).distinct(), "p_name", "left_semi"), ["p_name"], order, 10, "_r").drop("_r")
    both = q.join(first, "w").select("query", "name", "p_partkey", "p_name", "p_brand").unionByName(q.join(exact, q["name"] == exact["p_name"]).select("query", "name", "p_partkey", "p_name", "p_brand")).distinct()
    both = both.withColumn("tier", F.when(c("p_name") == c("name"), 0).otherwise(1).cast("long"))
    return R.top(both, ["query"], [F.asc("tier"), *order], 10).select("query", "p_partkey", "p_name", "tier", "rank")


@query("overlap_dedup", f"""
WITH s AS (SELECT doc_id, source, list_distinct({TOKS.format('text')}) s FROM documents), t AS (SELECT doc_id, source, len(s) n, unnest(s) t FROM s),
p AS (SELECT a.doc_id first, b.doc_id later, count(*) c, least(a.n, b.n) m FROM t a JOIN t b ON a.source = b.source AND a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT later AS doc_id, count(*) AS n_earlier, min(first) AS first_earlier FROM p WHERE 100 * c > 75 * m GROUP BY later""")
def overlap_dedup(spark, d):
    return overlapping(table(spark, d, "documents"), "doc_id", "source")


@query("code_search_lines", f"SELECT doc_id, line_no, substr(line, 1, 200) AS snippet FROM {LINES} WHERE regexp_matches(line, '(?i)token|secret|password') ORDER BY doc_id, line_no LIMIT 15")
def code_search_lines(spark, d):
    hits = T.lines(table(spark, d, "documents"), ["doc_id"]).where(F.col("line").rlike("(?i)token|secret|password"))
    return hits.orderBy("doc_id", "line_no").limit(15).select("doc_id", "line_no", F.substring("line", 1, 200).alias("snippet"))


@query("literal_search_lines", f"SELECT doc_id, count(*) AS n_lines, min(line_no) AS first_line FROM {LINES} WHERE contains(line, 'token = ') GROUP BY doc_id")
def literal_search_lines(spark, d):
    hits = T.lines(table(spark, d, "documents"), ["doc_id"]).where(F.col("line").contains("token = "))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


@query("find_references", f"SELECT doc_id, count(*) AS n_lines FROM {LINES} WHERE regexp_matches(line, '\\bthe\\b') GROUP BY doc_id")
def find_references(spark, d):
    hits = T.lines(table(spark, d, "documents"), ["doc_id"]).where(T.mentions(F.col("line"), F.lit("the")))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("symbol_search_rank", """
WITH q AS (SELECT p_name name FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part))
SELECT p_partkey, p_name, p_brand, (CASE WHEN p_name = q.name THEN 0 ELSE 1 END)::BIGINT AS tier FROM part, q WHERE contains(lower(p_name), lower(string_split(q.name, ' ')[1])) ORDER BY tier, p_brand, p_partkey, p_name LIMIT 10""")
def symbol_search_rank(spark, d):
    part = table(spark, d, "part")
    q = part.agg(F.min_by("p_name", "p_partkey").alias("name"))
    hits = part.crossJoin(F.broadcast(q)).where(F.lower("p_name").contains(F.lower(F.get(F.split("name", " "), F.lit(0)))))
    return hits.select("p_partkey", "p_name", "p_brand", F.when(F.col("p_name") == F.col("name"), 0).otherwise(1).cast("long").alias("tier")).orderBy("tier", "p_brand", "p_partkey", "p_name").limit(10)


@query("source_window", f"""
WITH l AS {LINES}, h AS (SELECT doc_id, min(line_no) hit FROM l WHERE contains(line, 'token') GROUP BY doc_id)
SELECT doc_id, hit, line_no, length(line)::BIGINT AS n_chars FROM l JOIN h USING (doc_id) WHERE line_no BETWEEN hit - 30 AND hit + 30""")
def source_window(spark, d):
    lines = T.lines(table(spark, d, "documents"), ["doc_id"])
    hit = lines.where(F.col("line").contains("token")).groupBy("doc_id").agg(F.min("line_no").alias("hit"))
    out = lines.join(hit, "doc_id").where(F.col("line_no").between(F.col("hit") - 30, F.col("hit") + 30))
    return out.select("doc_id", "hit", "line_no", F.length("line").cast("long").alias("n_chars"))


@query("inverted_index", f"""
WITH p AS (SELECT DISTINCT conv_id, unnest({TOKS.format('text')}) term FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY conv_id) r FROM p)
SELECT term, count(*) AS n_convs, string_agg(CASE WHEN r <= 5 THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS first_convs FROM r GROUP BY term""")
def inverted_index(spark, d):
    p = table(spark, d, "conversations").select("conv_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    from quernstone.operators.graph import neighbours

    return neighbours(p, "term", "conv_id", 5).select("term", F.col("n").alias("n_convs"), F.col("first").alias("first_convs"))


STEM = "CASE WHEN length(t) <= 4 THEN t WHEN t LIKE '%ing' THEN t[:-4] WHEN t LIKE '%ed' THEN t[:-3] WHEN t LIKE '%ies' THEN t[:-4] || 'y' WHEN t LIKE '%es' THEN t[:-3] WHEN t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END"


@query("stemmed_terms", f"SELECT stem, count(*) AS n, count(DISTINCT conv_id) AS n_convs FROM (SELECT conv_id, {STEM} AS stem FROM (SELECT conv_id, unnest({TOKS.format('text')}) t FROM conversations)) GROUP BY stem")
def stemmed_terms(spark, d):
    t = table(spark, d, "conversations").select("conv_id", F.explode(T.tokens(F.col("text"))).alias("t"))
    return t.select("conv_id", T.stem(F.col("t")).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_convs"))


#: What an issue's text names.
EXCEPTION = r"\b([A-Z][a-zA-Z0-9]*(?:Error|Exception|Warning|Interrupt|Exit))\b"
FILE = r"([a-zA-Z0-9_\-\./\\]+\.py)\b"
TEST = r"\b(test_[a-zA-Z0-9_]+|[a-zA-Z0-9_]+_test)\b"
CALL = r"`?([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)`?|`([A-Za-z_][A-Za-z0-9_]*)\(\)`"
TICK = r"`([A-Za-z0-9_\.\(\)]+)`"
#: Words of an issue that tell of state.
STATE_WORDS = ("redirect", "cookie", "session", "header", "state", "cache", "mutate", "overwrite", "reset", "clear", "persist", "copy", "environ", "stream", "chunk")


#: Words of calls that make an interface, and phrases of what is expected, what is seen and what sets it off.
API_WORDS = ("get", "post", "set", "send", "load", "parse", "init", "format", "validate", "prepare")
EXPECTED = (r"(?i)(?:expected|should|ought to|supposed to|needs to|must)\s+([^.\n]+)", r"(?i)(?:expected behavior:?\s*)([^\n]+)")
CURRENT = (r"(?i)(?:instead|currently|actual|fails with|raises|returns|got)\s+([^.\n]+)", r"(?i)(?:actual behavior:?\s*)([^\n]+)")
TRIGGER = (r"(?i)(?:when|if|upon|calling|invoking)\s+([^.\n]+)",)
NAME = r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$"
SORTED = "list_sort(list_distinct({0}))"
STRIPPED = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c]'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')"


@query("behavior_extract", rf"""
WITH t AS (SELECT doc_id, text, lower(text) low, {STRIPPED} lines, {SORTED.format(f"regexp_extract_all(text, '{EXCEPTION}', 1)")} exc, regexp_extract_all(text, '{CALL}', 1) c1, regexp_extract_all(text, '{CALL}', 2) c2,
  list_transform(regexp_extract_all(text, '{TICK}', 1), lambda x: trim(x, '()')) tick FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
s AS (SELECT *, list_concat(list_filter(list_transform(list_zip(c1, c2), lambda x: CASE WHEN x[1] <> '' THEN x[1] ELSE x[2] END), lambda x: NOT ends_with(x, '.py') AND length(x) > 2),
  list_filter(tick, lambda x: regexp_matches(x, '{NAME}') AND NOT list_contains(exc, x) AND NOT ends_with(x, '.py') AND length(x) > 2)) sy,
  list_filter(list_transform(list_filter(lines, lambda l: regexp_matches(l, '^([-*]|[1-5]\.)|assert |Error:|Traceback')), lambda l: trim(ltrim(l, '-*0123456789. '))), lambda l: length(l) > 5) sp FROM t),
y AS (SELECT *, {SORTED.format("sy")} symbols FROM s), z AS (SELECT *, list_filter(symbols, lambda x: contains(x, '.') OR {" OR ".join(f"contains(lower(x), '{w}')" for w in API_WORDS)}) api FROM y)
SELECT doc_id, array_to_string(exc, ',') AS exceptions, array_to_string({SORTED.format(f"list_transform(regexp_extract_all(text, '{FILE}', 1), lambda x: trim(replace(x, chr(92), '/'), './'))")}, ',') AS files,
  array_to_string({SORTED.format(f"regexp_extract_all(text, '{TEST}', 1)")}, ',') AS tests, array_to_string(symbols, ',') AS symbols, array_to_string(CASE WHEN len(api) > 0 THEN api ELSE symbols[:5] END, ',') AS affected_api,
  array_to_string(list_filter([{', '.join(f"'{w}'" for w in STATE_WORDS)}], lambda w: contains(low, w)), ',') AS state_words, least(10, len(list_distinct(sp)))::BIGINT AS n_symptoms, coalesce(sp[1], '') AS first_symptom,
  concat_ws(',', CASE WHEN contains(low, 'none') THEN 'none' END, CASE WHEN contains(low, 'empty') THEN 'empty' END, CASE WHEN contains(low, 'url') OR contains(low, 'scheme') THEN 'url' END, CASE WHEN contains(low, 'dict') OR contains(low, 'mapping') THEN 'dict' END) AS input_conditions,
  concat_ws(',', CASE WHEN contains(text, '200') OR contains(low, 'status') THEN 'status' END, CASE WHEN len(exc) > 0 THEN 'exceptions' END) AS output_conditions FROM z""")
def behavior_extract(spark, d):
    """What an issue's text names: exceptions, files, tests, symbols, the interface that they touch, state, symptoms and conditions."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    every = lambda p, g=1: F.regexp_extract_all("text", F.lit(p), F.lit(g))
    sorted_set = lambda c: F.array_sort(F.array_distinct(c))
    fit = lambda x: ~x.endswith(".py") & (F.length(x) > 2)
    low = F.lower("text")
    calls = F.filter(F.zip_with(every(CALL, 1), every(CALL, 2), lambda a, b: F.when(a != "", a).otherwise(b)), fit)
    ticks = F.transform(every(TICK), lambda x: F.trim(x, F.lit("()")))
    docs = docs.select("*", sorted_set(every(EXCEPTION)).alias("exc"), calls.alias("calls"), ticks.alias("ticks"))
    docs = docs.withColumn("symbols", sorted_set(F.concat("calls", F.filter("ticks", lambda x: x.rlike(NAME) & ~F.array_contains("exc", x) & fit(x)))))
    api = F.filter("symbols", lambda x: x.contains(".") | T.any_contains(F.lower(x), API_WORDS))
    files = F.transform(every(FILE), lambda x: F.trim(F.translate(x, "\\", "/"), F.lit("./")))
    symptoms = F.filter(T.split_lines(F.col("text")), lambda x: x.rlike(r"^([-*]|[1-5]\.)|assert |Error:|Traceback"))
    symptoms = F.array_distinct(F.filter(F.transform(symptoms, lambda x: F.trim(F.ltrim(x, F.lit("-*0123456789. ")))), lambda x: F.length(x) > 5))
    has = lambda *words: T.any_contains(low, words)
    return docs.select(
        "doc_id", F.array_join("exc", ",").alias("exceptions"), F.array_join(sorted_set(files), ",").alias("files"), F.array_join(sorted_set(every(TEST)), ",").alias("tests"), F.array_join("symbols", ",").alias("symbols"),
        F.array_join(F.when(F.size(api) > 0, api).otherwise(F.slice("symbols", 1, 5)), ",").alias("affected_api"), F.concat_ws(",", *[F.when(low.contains(w), w) for w in STATE_WORDS]).alias("state_words"),
        F.least(F.lit(10), F.size(symptoms)).cast("long").alias("n_symptoms"), F.coalesce(F.get(symptoms, F.lit(0)), F.lit("")).alias("first_symptom"),
        F.concat_ws(",", F.when(has("none"), "none"), F.when(has("empty"), "empty"), F.when(has("url", "scheme"), "url"), F.when(has("dict", "mapping"), "dict")).alias("input_conditions"),
        F.concat_ws(",", F.when(F.col("text").contains("200") | has("status"), "status"), F.when(F.size("exc") > 0, "exceptions")).alias("output_conditions"),
    )


def _phrases_sql(patterns: tuple[str, ...]) -> str:
    each = ", ".join("trim(regexp_extract(l, '" + p + "', 1))" for p in patterns)
    return f"list_filter(flatten(list_transform(lines, lambda l: [{each}])), lambda x: length(x) > 8)"


def _first_sql(column: str, most: int) -> str:
    return f"array_to_string(list_filter({column}, lambda x, i: list_position({column}, x) = i)[:{most}], '; ')"


@query("behavior_phrases", f"""
WITH l AS (SELECT doc_id, {STRIPPED} lines FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), p AS (SELECT doc_id, lines, {_phrases_sql(EXPECTED)} e, {_phrases_sql(CURRENT)} c, {_phrases_sql(TRIGGER)} t FROM l)
SELECT doc_id, CASE WHEN len(e) > 0 THEN {_first_sql('e', 3)} ELSE coalesce(lines[1], '') END AS expected, {_first_sql('c', 3)} AS current, {_first_sql('t', 2)} AS trigger FROM p""")
def behavior_phrases(spark, d):
    """What is expected, what is seen instead and what sets it off; a text that expects nothing in words expects its first line."""
    docs = table(spark, d, "documents").select("doc_id", T.split_lines(F.col("text")).alias("lines"))
    lines = F.col("lines")
    expected = T.phrases(lines, EXPECTED, 3)
    first = F.coalesce(F.get("lines", F.lit(0)), F.lit(""))
    return docs.select("doc_id", F.when(expected != "", expected).otherwise(first).alias("expected"), T.phrases(lines, CURRENT, 3).alias("current"), T.phrases(lines, TRIGGER, 2).alias("trigger"))


@query("contract_category", f"""
WITH n AS (SELECT conv_id, turn, role, {' + '.join(f"regexp_matches(coalesce(text, ''), '{p}')::INT" for p in rules.SIGNATURE_PATTERNS)} n, regexp_matches(coalesce(text, ''), '`[a-zA-Z_]\\w*=[^`]+`') k FROM conversations)
SELECT conv_id, turn, role, CASE WHEN n >= 2 OR (n >= 1 AND k) THEN 'API_SIGNATURE' WHEN n = 1 OR k THEN 'MIXED' ELSE 'ALGORITHMIC_BEHAVIORAL' END AS category,
  (CASE WHEN n >= 2 OR (n >= 1 AND k) THEN 0.95 WHEN n = 1 OR k THEN 0.75 ELSE 0.2 END)::DOUBLE AS confidence FROM n""")
def contract_category(spark, d):
    text = F.coalesce("text", F.lit(""))
    kind, confidence = rules.contract_category(text, text)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", kind.alias("category"), confidence.alias("confidence"))


@query("url_path_parse", r"""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/[^/]*$', '') AS module, regexp_extract(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '([^/]*)$', 1) AS base,
  regexp_replace(regexp_extract(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '([^/]*)$', 1), '\.[^.]*$', '') AS stem, contains(url, '?') AS has_query FROM pages""")
def url_path_parse(spark, d):
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    base = F.regexp_extract(path, "([^/]*)$", 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_replace(path, "/[^/]*$", "").alias("module"), base.alias("base"), F.regexp_replace(base, r"\.[^.]*$", "").alias("stem"), F.col("url").contains("?").alias("has_query"))


@query("manifest_fingerprint", """
WITH l0 AS (SELECT source, doc_id // 4096 AS b, doc_id, doc_id::VARCHAR || ':' || sha256(coalesce(text, '')) AS h FROM documents),
l1 AS (SELECT source, b // 4096 AS c, b, count(*) AS n, b::VARCHAR || '=' || sha256(string_agg(h, '|' ORDER BY doc_id, h)) AS h FROM l0 GROUP BY source, b),
l2 AS (SELECT source, c, sum(n) AS n, c::VARCHAR || '=' || sha256(string_agg(h, '|' ORDER BY b)) AS h FROM l1 GROUP BY source, c)
SELECT source, sum(n)::BIGINT AS n, substr(sha256(string_agg(h, '|' ORDER BY c)), 1, 16) AS fingerprint FROM l2 GROUP BY source""")
def manifest_fingerprint(spark, d):
    """A digest of each source's documents, by a tree: of ranges of 4,096 ids, of 4,096 such ranges, and of those. No list is longer, whatever the number of documents."""
    docs = table(spark, d, "documents").select("source", F.expr("doc_id div 4096").alias("b"), F.col("doc_id").alias("o"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("h"), F.lit(1).cast("long").alias("n"))

    def digest(df, *keys):
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "|")
        return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sha2(parts.cast("binary"), 256).alias("s"))

    named = lambda df, key, *keys: df.select("source", *keys, F.col(key).alias("o"), F.concat(F.col(key).cast("string"), F.lit("="), "s").alias("h"), "n")
    one = named(digest(docs, "source", "b").withColumn("c", F.expr("b div 4096")), "b", "c")
    two = named(digest(one, "source", "c"), "c")
    return digest(two, "source").select("source", "n", F.substring("s", 1, 16).alias("fingerprint"))
