"""Structured Streaming: idempotent intake, windows over event time, ledger state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.tables import new_folder


def event_stream(spark: SparkSession, folder: str, name: str = "events", ts: str = "ts", files_per_trigger: int = 1) -> DataFrame:
    """The files of one table, a single file or a folder of part files, as a stream. The watermark needs an instant, so a zoneless time is read as UTC's."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        s = reader.parquet(path)
    else:  # a stream's path is a folder
        s = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return s.withColumn(ts, F.col(ts).cast("timestamp"))


def first_deliveries(stream: DataFrame, key: Column, valid: Column, ts: str = "ts", ttl: str | None = "24 hours") -> DataFrame:
    """Valid deliveries, once for each key within the time to live, or ever where it is None: then no delivery is too late, and every key stays in the state. Rejected ones leave no state, so they may come again; without a key none is a repeat."""
    s = stream.where(valid).withColumn("_key", F.coalesce(key, F.expr("uuid()")))
    if ttl is None:
        return s.dropDuplicates(["_key"]).drop("_key")
    return s.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def window_counts(stream: DataFrame, by: str, ts: str = "ts", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling counts and sums by event time; later events than the watermark allows are dropped."""
    w = F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def latest_state(stream: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Running last state for each key: an aggregate whose state is one row a key."""
    return stream.groupBy(key).agg(F.max(F.struct(order, *values)).alias("s"), F.count("*").alias("n_events")).select(key, f"s.{order}", *[f"s.{v}" for v in values], "n_events")


def decided_state(stream: DataFrame, key: str, order: str, kind: str, decisions: tuple[str, ...]) -> DataFrame:
    """Running status of each key: its first decision by order stays, whatever comes later and in whatever order the files
    come; PENDING without one. The state is one row a key."""
    first = F.min(F.when(F.col(kind).isin(*decisions), F.struct(F.col(order).alias("at"), F.col(kind).alias("kind"))))
    s = stream.groupBy(key).agg(first.alias("d"), F.count("*").alias("n_events"))
    return s.select(key, F.coalesce("d.kind", F.lit("PENDING")).alias("status"), F.col("d.at").alias("decided_at"), "n_events")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what there is and returns its last result, from tables in the shared folder."""
    spark = stream.sparkSession
    path = new_folder(spark)
    if mode == "append":
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").start(f"{path}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")  # the complete result, so a repeated batch overwrites itself

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
