"""The block of a failure is searched for once, however many fields are read from it."""

from pyspark.sql import functions as F

from quernstone.functions import logs


def test_block_is_searched_once(spark):
    df = spark.range(1).select(logs.details(F.concat(F.lit("_____ t _____\nE   ValueError: "), F.col("id").cast("string")), F.lit("a::t")).alias("i"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("_{2,}") <= 8  # one pattern
    assert df.select("i.*").first()[:2] == ("ValueError", "0")
