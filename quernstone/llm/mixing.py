"""Mixing sources to target weights by hash thresholds.

Tokens are summed by source and hash bucket (4,096 buckets a level). The cumulated sums show in
which bucket a source's budget ends; only that bucket's rows are split again, three levels deep
(36 bits). A row is taken if its hash lies under its source's threshold: no row is sorted, the
thresholds nest, so a larger budget keeps what a smaller one took, and reruns agree.

The hash is that of a row's id and of its text, so a source of few ids, or of none, is split as finely
as one of many.

Defined cases: a null text has size 0 and hashes as an empty one; a null source is the last source; a
null id hashes as the empty string; rows with equal id and text go the same way, rows with equal ids
and different texts each their own; a source without words gets target 0; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.sources.tables import table, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BITS, LEVELS = 12, 3
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def hash36(doc_id: Column, text: Column) -> Column:
    """The first 36 bits of the md5 of the id, a colon and the text's md5."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    row = F.concat(known(doc_id), F.lit(":"), F.md5(known(text).cast("binary")))
    return F.conv(F.substring(F.md5(row.cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """_source, source_size and target. sizes: _source, _size.

    Shares by weight, a source's stopping at ``most`` times its size and the excess shared again,
    is water-filling: in the order of cap/weight, the first source whose cap holds the level that
    is left sets the level of all that follow. One row for each source is all that a window sees."""
    by = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    rise = Window.orderBy(F.col("cap") / F.col("w"), F.col("_source").asc_nulls_last())
    before, after = rise.rowsBetween(Window.unboundedPreceding, -1), rise.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumns({"total": F.sum("source_size").over(everything), "used": F.coalesce(F.sum("cap").over(before), F.lit(0)), "left_w": F.sum("w").over(after)})
    by = by.withColumn("level", (share * F.col("total") - F.col("used")) / F.col("left_w"))
    by = by.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("l")))).over(everything)["l"])
    return by.select("_source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def cutoffs(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """goal with _whole (times that every row is taken) and _below (rows with a hash under it are taken once more). sizes: _source, _h, _size."""
    g = goal.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    g = g.withColumns({"_budget": F.col("target") - F.col("_whole") * F.col("source_size"), "_prefix": F.lit(0).cast("long")})
    inside = sizes
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        hist = inside.groupBy("_source", F.shiftright("_h", shift).alias("_b")).agg(F.sum("_size").alias("n"))
        w = Window.partitionBy("_source").orderBy("_b")
        hist = hist.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        edge = hist.join(g.select(F.col("_source").alias("_s"), "_budget"), F.col("_source").eqNullSafe(F.col("_s")))
        edge = edge.where(F.col("upto") > F.col("_budget")).groupBy("_s").agg(F.min(F.struct("_b", "upto", "n")).alias("e"))
        g = g.join(edge, F.col("_source").eqNullSafe(F.col("_s")), "left").withColumn("_budget", F.coalesce(F.col("_budget") - (F.col("e.upto") - F.col("e.n")), F.lit(0.0)))
        last = F.when((level == LEVELS) & (2 * F.col("_budget") > F.col("e.n")), 1).otherwise(0)
        g = g.withColumn("_prefix", F.coalesce(F.col("e._b") + last, F.lit(0)))
        g = written(g.drop("_s", "e"))
        if level < LEVELS:
            edges = g.select(F.col("_source").alias("_s"), F.col("_prefix").alias("_p"))
            inside = sizes.join(edges, F.col("_source").eqNullSafe(F.col("_s")) & (F.shiftright("_h", shift) == F.col("_p")), "left_semi")
    return g.select("_source", "source_size", "target", "_whole", F.col("_prefix").alias("_below"))


def mixed(docs: DataFrame, sizes: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs' columns in _row, with _size, source_size, target and taken. sizes: the written (_source, _h, _size) of docs, where the caller has it."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source).cast("string").alias("_source"), hash36(F.col(doc_id), F.col(text)).alias("_h"), n_words(F.col(text)).alias("_size"))
    if sizes is None:
        sizes = written(df.select("_source", "_h", "_size"))
    return taken(df, sizes)


def taken(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """df (with _source, _h, _size) joined with its source's threshold; a row for each source, whose size AQE sees."""
    cut = cutoffs(sizes, written(targets(sizes)))
    cut = cut.withColumnRenamed("_source", "_s")
    df = df.join(cut, F.col("_source").eqNullSafe(F.col("_s")), "left")
    return df.withColumn("_times", F.col("_whole") + F.when(F.col("_h") < F.col("_below"), 1).otherwise(0)).withColumn("taken", F.col("_times") * F.col("_size"))


def mix(docs: DataFrame) -> DataFrame:
    """docs' rows as often as the mix takes them, with docs' own columns."""
    times = F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))
    return mixed(docs).where("_times > 0").select("_row", times.alias("_i")).select("_row.*")


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes."""
    docs = table(spark, sf_dir, "documents")
    sizes = written(docs.select("doc_id", F.col("source").cast("string").alias("_source"), hash36(F.col("doc_id"), F.col("text")).alias("_h"), n_words(F.col("text")).alias("_size")))
    return taken(sizes, sizes).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def oracle() -> dict[str, str]:
    return {"op3_source_mix": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 9))::BIGINT h FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] w, 2*source_size cap, sum(source_size) OVER ()::DOUBLE total FROM s),
r AS (SELECT *, (1.5::DOUBLE*total - coalesce(sum(cap) OVER (ORDER BY cap/w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(w) OVER (ORDER BY cap/w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) lv FROM w),
l AS (SELECT arg_min(lv, cap/w) level FROM r WHERE lv*w <= cap),
g AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM l)*w, cap::DOUBLE)) target FROM w),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target/source_size)::BIGINT ELSE 0 END whole, target - CASE WHEN source_size > 0 THEN floor(target/source_size)::BIGINT ELSE 0 END*source_size budget FROM g),
c AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) upto FROM (SELECT source, h, sum(size) n FROM d GROUP BY source, h)),
e AS (SELECT c.source, arg_min(CASE WHEN 2*(budget - (upto - n)) > n THEN h + 1 ELSE h END, h) below FROM c JOIN k ON c.source IS NOT DISTINCT FROM k.source WHERE upto > budget GROUP BY c.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN h < below THEN 1 ELSE 0 END))::BIGINT taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source"""}
