"""A cache of parsed sources has one file for each bucket, however many tasks parsed."""

from pathlib import Path

from pyspark.sql import functions as F

from quernstone.sources import cache


def test_one_file_a_bucket(spark, tmp_path):
    files = spark.range(40).select(F.concat("id", F.lit(".py")).alias("path"), F.lit("def f():\n    g()\n").alias("code"))
    rows, n = cache.refreshed(files.repartition(8), str(tmp_path / "c"), buckets=4)
    assert n == 40 and rows.where("kind = 'CALLS'").count() == 40
    assert {len(list(b.glob("*.parquet"))) for b in Path(tmp_path / "c").glob("bucket=*")} == {1}
