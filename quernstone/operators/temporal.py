"""Change histories: co-change, recency, churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.sources.tables import dealt_by_rows, written


def cochange(items: DataFrame, commit: str, item: str, k: int = 5) -> DataFrame:
    """item, partner, commits that hold both, and the partner's rank among the first k. The pairs of a commit grow with the square of its items, as the counts asked for do; commits hold few.

    A pair is made once for both its items, and pairs are dealt by their number before they are counted: counted where the join makes them,
    a task's counts would be as many as its pairs."""
    i = items.select(commit, item).where(F.col(commit).isNotNull() & F.col(item).isNotNull())
    i = dealt_by_rows(i, items.count(), commit).distinct()
    rows = i.groupBy(commit).agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    pairs = i.join(i.withColumnRenamed(item, "partner"), commit).where(F.col(item) < F.col("partner")).select(item, "partner")
    n = dealt_by_rows(pairs, rows, item, "partner").groupBy(item, "partner").agg(F.count("*").alias("together"))
    ways = F.array(F.struct(F.col(item), "partner"), F.struct(F.col("partner").alias(item), F.col(item).alias("partner")))
    n = n.select(F.explode(ways).alias("p"), "together").select(f"p.{item}", "p.partner", "together")
    w = Window.partitionBy(item).orderBy(F.desc("together"), "partner")
    return n.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def recent(df: DataFrame, by: str, order: list[Column], n: int = 15) -> DataFrame:
    """The first n rows of each group; Spark limits each group before the shuffle."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("nth") <= n)


def churn(commits: Column, fixes: Column) -> Column:
    return F.round(F.least(F.lit(1.0), commits / 20 + fixes / 5 * 0.5), 3)


def numbered(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """df with each row's place in its group, for few groups of any size.

    Rows are dealt into ranges of (by, order), counted in each, and the counts of the ranges before are added: no task holds
    a whole group. The order must tell rows apart."""
    keys = [F.col(b).asc() for b in by]
    ranges = written(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    n = ranges.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], F.col("_part").alias("_p"), "_before")
    same = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_g{i}"))
    out = ranges.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    return out.join(n, same).select(*df.columns, (F.col("_before") + F.col("_nth")).alias(rank))
