"""The first span that holds a place, without a row for each span that does."""

import random

from pyspark.sql import functions as F

from quernstone.operators import frames


def test_least_span(spark):
    rng = random.Random(1)
    s = [(rng.choice("ab"), lo := rng.randint(-40, 300), lo + rng.choice([-1, 0, 1, 7, 60, 250]), i) for i in range(120)]
    p = [(rng.choice("abc"), rng.randint(-50, 400)) for _ in range(150)]
    want = {(f, x): min(n for g, lo, hi, n in s if g == f and lo <= x <= hi) for f, x in p if any(g == f and lo <= x <= hi for g, lo, hi, n in s)}
    got = frames.first_holding(spark.createDataFrame(p, "f string, x long"), spark.createDataFrame(s, "f string, lo long, hi long, n long"), ["f"], "x", F.col("n"))
    assert {(r.f, r.x): r.least for r in got.collect()} == want


def test_rows_grow_with_spans_not_with_pairs(spark):
    """3,000 places in 3,000 spans each: the join gives a few rows a place."""
    p, s = spark.range(3000).select(F.lit("f").alias("f"), F.col("id").alias("x")), spark.range(3000).select(F.lit("f").alias("f"), (-F.col("id")).alias("lo"), (F.col("id") + 3000).alias("hi"), F.col("id").alias("n"))
    out = frames.first_holding(p, s, ["f"], "x", F.col("n"))
    assert out.agg(F.count("*"), F.max("least")).first() == (3000, 0)
    from pyspark.sql import Observation

    seen = Observation()
    frames.held(p, s, ["f"], "x", F.col("n")).observe(seen, F.count("*").alias("k")).write.format("noop").mode("overwrite").save()
    assert seen.get["k"] < 3000 * 2 * frames.LEVELS
