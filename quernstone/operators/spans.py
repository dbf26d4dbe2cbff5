"""Interval joins between places and the spans that hold them, by bins and an exact test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BIN = 16


def holding(places: DataFrame, spans: DataFrame, file: str, at: str) -> DataFrame:
    """Places with each span (symbol, lo, hi) of their file that holds them. A span goes to every bin that it touches."""
    p = places.withColumn("bin", F.floor(F.col(at) / BIN))
    s = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor(F.col("hi") / BIN))))
    return p.join(s, [file, "bin"]).where(F.col(at).between(F.col("lo"), F.col("hi"))).drop("bin")


def innermost(places: DataFrame, spans: DataFrame, file: str, at: str) -> DataFrame:
    """Each place with its shortest span; ties to the least symbol."""
    return holding(places, spans, file, at).groupBy(file, at).agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("len"), "symbol")).alias("m")).select(file, at, "m.symbol", F.col("m.len").alias("length"))


def uncovered(places: DataFrame, spans: DataFrame, file: str, at: str) -> DataFrame:
    """Places that no span holds."""
    return places.join(holding(places, spans, file, at).select(file, at).distinct(), [file, at], "left_anti")


def conflicts(spans: DataFrame, file: str, ident: str) -> DataFrame:
    """Spans, by falling start, whose successor reaches into them."""
    w = Window.partitionBy(file).orderBy(F.desc("lo"), F.desc(ident), F.desc("hi"))
    return spans.withColumns({"next_hi": F.lead("hi").over(w), "next_id": F.lead(ident).over(w)}).where(F.col("next_hi") >= F.col("lo"))


def kept_first(spans: DataFrame, file: str, order: list[str]) -> DataFrame:
    """Each file's spans (lo, hi) in order, without those that reach into one kept before, as an array ``kept``, and the number of all. A file's spans are one row: files hold few."""
    s = spans.groupBy(file).agg(F.array_sort(F.collect_list(F.struct(*order, "lo", "hi"))).alias("xs"))
    none = F.array().cast(s.schema["xs"].dataType)
    over = lambda a, x: F.greatest(a["lo"], x["lo"]) <= F.least(a["hi"], x["hi"])
    keep = F.aggregate("xs", none, lambda kept, x: F.when(F.exists(kept, lambda a: over(a, x)), kept).otherwise(F.array_append(kept, x)))
    return s.select(file, keep.alias("kept"), F.size("xs").cast("long").alias("n"))
