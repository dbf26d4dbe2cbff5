"""Contiguous shards of near equal bytes from global prefix sums.

The rows are dealt into ranges of the order (doc_id, text_crc32, size). A range's total bytes and
rows are summed, the totals of the ranges before it are added to the running sums within it, and
the global byte offset of each row, cut at equal targets, names its shard. The result depends on
the order alone, not on where Spark draws its ranges.

Defined cases: a null text has no bytes and the checksum of the empty text; null ids come first;
rows equal in id, text and size are interchangeable and get neighbouring slots; an empty table
gives an empty result; shards stay empty where there are fewer rows than shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.sources.tables import table, written

SHARDS, ROW_BYTES = 24, 8


def sharded(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs. The texts are read once and never shuffled."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    rows = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("bytes").over(all_of).alias("_total"),
    )
    rows = rows.withColumns({"_upto": F.sum("size").over(running), "_nth": F.row_number().over(within)})
    rows = rows.join(starts, F.col("_part") == F.col("_p"))
    middle = 2 * (F.col("_bytes_before") + F.col("_upto")) - F.col("size")
    rows = rows.select(*order, F.expr(f"{shards}").alias("_s"), middle.alias("_mid"), "_total", (F.col("_rows_before") + F.col("_nth") - 1).alias("_rank"))
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.expr("cast((_mid * _s) div (2 * _total) as int)")))
    rows = written(rows.select(*order, "shard", "_rank"))
    first = rows.groupBy("shard").agg(F.min("_rank").alias("_first")).withColumnRenamed("shard", "_sh")
    return rows.join(first, F.col("shard") == F.col("_sh")).select(*order, "shard", (F.col("_rank") - F.col("_first")).alias("slot"))


def op7_byte_shards(spark, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards, contiguous by doc_id and near equal in bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharded(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
