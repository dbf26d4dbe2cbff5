"""Lexical and gram retrieval, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import text as T

K1, B = 1.5, 0.75
#: The channels' weights.
WEIGHTS = {"lexical": 0.25, "dense": 0.15, "graph": 0.20, "traceback": 0.20, "temporal": 0.10, "test": 0.10}


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, n_docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, df and idf; of the given terms alone, if any. n_docs is one row."""
    if terms is not None:
        counts = counts.join(terms, "term", "left_semi")
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = F.col("n_docs")
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", F.greatest(F.lit(0.1), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("idf"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= k)
