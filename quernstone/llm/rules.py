"""Quality rules: thresholds per language and source from mergeable quantile sketches.

The sketch is a histogram over integer buckets of bounded relative width (1/256), as in DDSketch
and HDR histograms. Sketches merge by adding counts, so Spark's partial aggregation builds them on
the map side, a language's sketch is the sum of its sources' sketches, and reruns agree.

A group's quartiles are read off its own sketch with PRIOR documents' worth of its language's and of
all documents' mixed in: a small group leans on its language, a large one on itself, and no size is
a switch. A fence lies FENCE spreads beyond a quartile. The spread is the distance of the quartiles,
or, where that is smaller, the grain of the measure: what one occurrence makes in a document of the
group's lower quartile of size. So where most documents have none of something, the fence is a few
occurrences in a short document of that very group.

Defined cases: a null text has no words; rows without words fail the base rules and add nothing
to the sketches; null lang or source is a group of its own; repeated rows count as often as they
occur and share a verdict; an empty table gives an empty result; the caller's columns are kept in
one struct while the rules run, so that no name of theirs can clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.sources.tables import table, written

SPACE = r"[\x20\x09-\x0D]+"
#: metric -> (its sides, the size that it is a share of, what one occurrence is worth): a repeated 3-word window is two windows, six words
METRICS = {"symbols": ("hi", "n_words", 10_000), "dup_lines": ("hi", "n_lines", 10_000), "repeats": ("hi", "n_words", 60_000), "word_len": ("both", "n_words", 1000)}
SIZES = ("n_words", "n_lines")
FENCE, PRIOR = 3, 25
#: Mixed counts are in units of 1/UNIT documents.
UNIT = 1000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered() -> Column:
    """Words that lie in a 3-word window found at least twice."""
    return F.expr(
        """CASE WHEN size(_tri) = size(array_distinct(_tri)) THEN 0L ELSE
        aggregate(
          transform(array(sort_array(transform(_tri, (g, i) -> struct(g AS g, i AS i)))), s ->
            transform(array(sort_array(transform(
              filter(s, (x, j) -> get(s, j - 1).g <=> x.g OR get(s, j + 1).g <=> x.g), x -> x.i))), p ->
                aggregate(p, struct(0L AS n, -3 AS last),
                  (a, q) -> struct(a.n + least(3, q - a.last) AS n, q AS last), a -> a.n))[0]),
          0L, (a, n) -> a + n) END"""
    )


def measured(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """_row (the caller's columns), _k0.. (keys), the five counts, n_lines and the scaled metrics."""
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        *[F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.col(text), F.lit("")).alias("_t"),
    )
    df = df.withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0))
    # the windows as "a b c": words hold no space, so the text of a window names it
    df = df.withColumn("_tri", F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (x, i) -> concat_ws(' ', x, _w[i + 1], _w[i + 2]))"))
    df = df.select(
        "_row", *[f"_k{i}" for i in range(len(keys))],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered().alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
    )
    return df.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "_m_symbols": F.expr("CASE WHEN n_words > 0 THEN 10000 * n_symbols div n_words END"),
        "_m_dup_lines": F.expr("CASE WHEN _n_lines > 0 THEN 10000 * n_dup_lines div _n_lines END"),
        "_m_repeats": F.expr("CASE WHEN n_words > 0 THEN 10000 * n_repeat_words div n_words END"),
        "_m_word_len": F.expr("CASE WHEN n_words > 0 THEN 1000 * word_chars div n_words END"),
        "_m_n_words": F.expr("CASE WHEN n_words > 0 THEN n_words END"),
        "_m_n_lines": F.expr("CASE WHEN n_words > 0 THEN _n_lines END"),
    })


def _bucket(v: Column) -> tuple[Column, Column]:
    """The lower end and the width of the value's bucket: exact below 512, then 256 buckets for each power of two."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - 9)
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift), F.call_function("shiftleft", F.lit(1).cast("long"), shift)


def sketches(feats: DataFrame, keys: int = 2) -> DataFrame:
    """One row for each group, metric and filled bucket: its lower end, width and count."""
    ks = [f"_k{i}" for i in range(keys)]
    long = feats.select(*ks, F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"_m_{m}").alias("v")) for m in (*METRICS, *SIZES)])).alias("x"))
    low, width = _bucket(F.col("x.v"))
    return long.where("x.v IS NOT NULL").select(*ks, F.col("x.m").alias("m"), low.alias("b"), width.alias("wide")).groupBy(*ks, "m", "b", "wide").agg(F.count("*").alias("n"))


def _mixed(sk: DataFrame) -> DataFrame:
    """The groups' sketches with the worth of PRIOR documents of their language's sketch and of all documents' added, as ``w``."""
    share = lambda n, all_: F.expr(f"{PRIOR * UNIT} * {n} div {all_}")
    groups = sk.select("_k0", "_k1", "m").distinct()

    def prior(by: list[str]) -> DataFrame:
        p = sk.groupBy(*by, "m", "b", "wide").agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy(*by, "m")))
        p = p.select(*[F.col(k).alias(f"p{k}") for k in by], F.col("m").alias("pm"), "b", "wide", share("n", "all").alias("w")).where("w > 0")
        same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"p{k}")), by, F.col("m") == F.col("pm"))
        return groups.join(p, same).select("_k0", "_k1", "m", "b", "wide", "w")

    own = sk.select("_k0", "_k1", "m", "b", "wide", (UNIT * F.col("n")).alias("w"))
    return own.unionByName(prior(["_k0"])).unionByName(prior([])).groupBy("_k0", "_k1", "m", "b", "wide").agg(F.sum("w").alias("w"))


def thresholds(feats: DataFrame) -> DataFrame:
    """Fences of each language and source."""
    w = Window.partitionBy("_k0", "_k1", "m")
    sk = _mixed(written(sketches(feats)))  # small: buckets of groups
    sk = sk.withColumns({"total": F.sum("w").over(w), "cum": F.sum("w").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))})
    # the bucket that holds the quantile, its weight spread evenly over its width
    at = lambda p: F.min(F.when(100 * F.col("cum") >= p * F.col("total"), F.struct("b", (F.col("b") + (p * F.col("total") - 100 * (F.col("cum") - F.col("w"))).cast("double") * F.col("wide") / (100 * F.col("w"))).alias("q")))).getField("q")
    q = sk.groupBy("_k0", "_k1", "m").agg(at(25).alias("q25"), at(75).alias("q75"))
    of = lambda m, c: F.max(F.when(F.col("m") == m, F.col(c)))
    q = q.groupBy("_k0", "_k1").agg(*[of(m, c).alias(f"{m}_{c}") for m in METRICS for c in ("q25", "q75")], *[of(m, "q25").alias(m) for m in SIZES])
    fences = []
    for m, (sides, size, worth) in METRICS.items():
        reach = FENCE * F.greatest(F.col(f"{m}_q75") - F.col(f"{m}_q25"), F.lit(float(worth)) / F.col(size))
        fences.append(F.floor(F.col(f"{m}_q75") + reach).alias(f"hi_{m}"))
        if sides == "both":
            fences.append(F.ceil(F.col(f"{m}_q25") - reach).alias(f"lo_{m}"))
    return q.select("_k0", "_k1", *fences)


def judged(feats: DataFrame, fences: DataFrame) -> DataFrame:
    """feats with the fences of their group and ``kept``. The fences hold a row for each language and source; AQE sees their real size and picks the join."""
    f = fences.select(F.col("_k0").alias("_f0"), F.col("_k1").alias("_f1"), *[c for c in fences.columns if c[0] != "_"])
    df = feats.join(f, F.col("_k0").eqNullSafe(F.col("_f0")) & F.col("_k1").eqNullSafe(F.col("_f1")), "left")
    over = reduce(lambda a, b: a | b, [F.col(f"_m_{m}") > F.col(f"hi_{m}") for m in METRICS], F.col("_m_word_len") < F.col("lo_word_len"))
    # one case, not two conditions: a filter on the first would move below the join and into the lambdas, which would then split the text for every word
    return df.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~F.coalesce(over, F.lit(False))))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with docs' own columns. The texts are measured once; rows and measures go to one table, so there is no join by id and repeated ids stay apart."""
    feats = written(measured(docs))
    return judged(feats, written(thresholds(feats))).where("kept").select("_row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its counts, fences and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    feats = measured(docs)
    feats = written(feats.withColumn("_row", F.struct("_row.doc_id")))  # the one pass over the texts
    return judged(feats, thresholds(feats)).select(
        "_row.doc_id", *FEATURES, "base_failed", "kept", "hi_symbols", "hi_dup_lines", "hi_repeats", "hi_word_len", "lo_word_len"
    )


def oracle() -> dict[str, str]:
    sql = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
wd AS (SELECT doc_id, unnest(w) x, generate_subscripts(w, 1) i FROM d),
tri AS (SELECT doc_id, i, x, lead(x, 1) OVER p x2, lead(x, 2) OVER p x3 FROM wd WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
cnt AS (SELECT *, count(*) OVER (PARTITION BY doc_id, x, x2, x3) c FROM tri WHERE x3 IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT j) n FROM (SELECT doc_id, unnest([i, i+1, i+2]) j FROM cnt WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) n, count(*) - count(DISTINCT l) dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT d.doc_id, lang, source, len(w)::BIGINT n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols, coalesce(ln.dup, 0)::BIGINT n_dup_lines, coalesce(cov.n, 0)::BIGINT n_repeat_words, coalesce(ln.n, 0)::BIGINT n_lines
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100*n_repeat_words > 50*n_words AS base_failed, CASE WHEN n_words > 0 THEN 10000*n_symbols // n_words END m1, CASE WHEN n_lines > 0 THEN 10000*n_dup_lines // n_lines END m2,
  CASE WHEN n_words > 0 THEN 10000*n_repeat_words // n_words END m3, CASE WHEN n_words > 0 THEN 1000*word_chars // n_words END m4 FROM f),
vals AS (SELECT lang, source, m, v FROM (SELECT lang, source, unnest([{", ".join(f"'{m}'" for m in (*METRICS, *SIZES))}]) m, unnest([m1,m2,m3,m4,n_words,CASE WHEN n_words > 0 THEN n_lines END]) v FROM g WHERE n_words > 0) WHERE v IS NOT NULL),
sk AS (SELECT lang, source, m, (v >> s) << s b, (1::BIGINT << s) wide, count(*) n FROM (SELECT *, greatest(0, length(bin(v)) - 9)::INT s FROM vals) GROUP BY ALL),
gr AS (SELECT DISTINCT lang, source, m FROM sk),
p1 AS (SELECT *, {PRIOR * UNIT} * n // sum(n) OVER (PARTITION BY lang, m) w FROM (SELECT lang, m, b, wide, sum(n) n FROM sk GROUP BY ALL)),
p2 AS (SELECT *, {PRIOR * UNIT} * n // sum(n) OVER (PARTITION BY m) w FROM (SELECT m, b, wide, sum(n) n FROM sk GROUP BY ALL)),
mx AS (SELECT lang, source, m, b, wide, sum(w)::BIGINT w FROM (SELECT lang, source, m, b, wide, {UNIT} * n w FROM sk
  UNION ALL SELECT gr.lang, source, gr.m, b, wide, w FROM gr JOIN p1 ON gr.lang IS NOT DISTINCT FROM p1.lang AND gr.m = p1.m WHERE w > 0
  UNION ALL SELECT lang, source, gr.m, b, wide, w FROM gr JOIN p2 ON gr.m = p2.m WHERE w > 0) GROUP BY ALL),
cu AS (SELECT *, (sum(w) OVER (PARTITION BY lang, source, m))::BIGINT total, (sum(w) OVER (PARTITION BY lang, source, m ORDER BY b))::BIGINT cum FROM mx),
qu AS (SELECT lang, source, m, {", ".join(f"arg_min(b + (({p} * total - 100 * (cum - w))::DOUBLE * wide / (100 * w)), b) FILTER (100 * cum >= {p} * total) q{p}" for p in (25, 75))} FROM cu GROUP BY ALL),
wi AS (SELECT lang, source, {", ".join(f"max(CASE WHEN m = '{m}' THEN q{p} END) {m}_q{p}" for m in (*METRICS, *SIZES) for p in (25, 75))} FROM qu GROUP BY lang, source),
fe AS (SELECT lang, source, {", ".join(f"floor({m}_q75 + {FENCE} * greatest({m}_q75 - {m}_q25, {worth}::DOUBLE / {size}_q25))::BIGINT hi_{m}" for m, (_, size, worth) in METRICS.items())},
  ceil(word_len_q25 - {FENCE} * greatest(word_len_q75 - word_len_q25, {METRICS["word_len"][2]}::DOUBLE / n_words_q25))::BIGINT lo_word_len FROM wi)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(m4 < lo_word_len OR m1 > hi_symbols OR m2 > hi_dup_lines OR m3 > hi_repeats OR m4 > hi_word_len, false) AS kept,
  hi_symbols, hi_dup_lines, hi_repeats, hi_word_len, lo_word_len
FROM g LEFT JOIN fe ON g.lang IS NOT DISTINCT FROM fe.lang AND g.source IS NOT DISTINCT FROM fe.source"""
    return {"op1_quality_rules": sql}
