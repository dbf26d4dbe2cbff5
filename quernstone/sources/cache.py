"""A table of parsed sources that is kept between runs: only files whose fingerprint has changed are parsed again.

The rows of a file lie in one record with its path and fingerprint; records lie in buckets of paths, which are partitions. A run
compares paths and fingerprints alone, parses what is new or changed, and rewrites the buckets that a new, changed or removed file touches, by dynamic
partition overwrite; other buckets are not read or written. A run that fails leaves the old buckets. Two writers at once are not provided for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.sources import code
from quernstone.sources.tables import dealt, forget, written

BUCKETS = 64


def _exists(files: DataFrame, folder: str) -> bool:
    path = files.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(files.sparkSession._jsc.hadoopConfiguration()).exists(path)


def _records(files: DataFrame, what) -> DataFrame:
    """path, fingerprint, bucket and rows of each file; a file that gives no rows has an empty array, so that it is not parsed again."""
    files = dealt(files, "path")
    rows = code.parsed(files.select("path", "code"), what)
    one = rows.groupBy("path").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "path"])).alias("rows"))
    return files.join(one, "path", "left").select("path", "fingerprint", "bucket", F.coalesce("rows", F.array().cast(one.schema["rows"].dataType)).alias("rows"))


def refreshed(files: DataFrame, folder: str, what=code.ParseEdges, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """The parsed rows of files (path, code), with their path, from the cache in folder, brought up to date; and the number of files that were parsed."""
    files = files.withColumns({"fingerprint": F.sha2(F.coalesce("code", F.lit("")).cast("binary"), 256), "bucket": F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")})
    now = files.select("path", "fingerprint", "bucket")
    spark = files.sparkSession
    if not _exists(files, folder):
        _records(files, what).repartition("bucket").write.partitionBy("bucket").parquet(folder)  # a file for each bucket
        n = spark.read.parquet(folder).count()
    else:
        old = spark.read.parquet(folder)
        known = old.select("path", "fingerprint", "bucket")
        changed = written(now.join(known.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti"))
        gone = written(known.join(now.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti"))
        n = changed.count()
        touched = [r.bucket for r in changed.select("bucket").union(gone.select("bucket")).distinct().collect()]  # at most ``buckets``
        if touched:
            kept = old.where(F.col("bucket").isin(touched)).join(now.select("path", "fingerprint"), ["path", "fingerprint"], "left_semi")
            fresh = _records(files.join(changed.select("path"), "path", "left_semi"), what)
            none = spark.createDataFrame([(b,) for b in touched], "bucket int").select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("fingerprint"), "bucket", F.lit(None).cast(fresh.schema["rows"].dataType).alias("rows"))
            columns = ["path", "fingerprint", "bucket", "rows"]
            both = written(kept.select(*columns).unionByName(fresh).unionByName(none))  # a bucket that has lost all its files is written, too
            both.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
            forget(both)
        for done in (changed, gone):
            forget(done)
    return spark.read.parquet(folder).where("path IS NOT NULL").select("path", F.inline("rows")), n
