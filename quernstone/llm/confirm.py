"""Confirmation of candidate pairs on full sets, whatever the number of pairs that one document has."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import textbytes
from quernstone.sources.tables import forget, written

#: Pairs that one copy of a document's set serves, on either side of the join.
PER_COPY = 256


def _copies(pairs: DataFrame, side: str, per_copy: int) -> DataFrame:
    """Documents with more pairs on that side than one copy serves, and how many copies they take."""
    many = pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > per_copy)
    return written(many.select(side, F.ceil(F.col("n") / per_copy).cast("int").alias(f"{side}_copies")))


def _dealt(rows: DataFrame, value: str, hot: DataFrame, side: str, name: str) -> DataFrame:
    """Every document's value once, and those of such documents as often as they take copies."""
    one = rows.select(F.col("doc_id").alias(side), F.col(value).alias(name))
    more = one.join(hot, side).select(side, name, F.explode(F.sequence(F.lit(1), F.col(f"{side}_copies") - 1)).alias(f"{side}_salt"))
    return one.withColumn(f"{side}_salt", F.lit(0)).unionByName(more)


def _met(pairs: DataFrame, rows: DataFrame, value: str, hot: dict[str, DataFrame]) -> DataFrame:
    """The pairs with the values x and y of their documents."""
    salted = pairs
    for side, other in (("a", "b"), ("b", "a")):
        salt = F.when(F.col(f"{side}_copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col(f"{side}_copies"))).cast("int")
        salted = salted.join(hot[side], side, "left").withColumn(f"{side}_salt", salt).drop(f"{side}_copies")
    left = _dealt(rows, value, hot["a"], "a", "x").hint("merge").join(salted, ["a", "a_salt"])
    return left.join(_dealt(rows, value, hot["b"], "b", "y").hint("merge"), ["b", "b_salt"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, per_copy: int | None = None) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity.

    A document with many pairs, on the left or on the right, is dealt to as many keys as they fill ``per_copy`` times,
    each with a copy of its set; so no key of either join has more pairs than that, give or take the hash's luck."""
    hot = {side: _copies(pairs, side, per_copy or PER_COPY) for side in ("a", "b")}
    both = _met(pairs, sets, "shingles", hot)
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    total = F.size("x") + F.size("y") - F.col("common")
    out = written(both.where((total > 0) & (100 * F.col("common") >= percent * total)).select("a", "b").distinct())
    for done in hot.values():
        forget(done)
    return out


def _reach(width: int, percent: int, most_bytes: int):
    """a and b of the rows (a, b, x, y) whose texts' full shingle sets reach the similarity."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for s, e, data, offsets in textbytes.slices(batch.column(2), most_bytes=most_bytes):
                x, at = textbytes.shingle_sets(data, offsets, width)
                for i, j, more, ends in textbytes.slices(batch.column(3).slice(s, e - s), most_bytes=most_bytes):
                    y, to = textbytes.shingle_sets(more, ends, width)
                    for k in range(i, j):
                        one, two = x[at[k] : at[k + 1]], y[to[k - i] : to[k - i + 1]]
                        common = len(np.intersect1d(one, two, assume_unique=True))
                        total = len(one) + len(two) - common
                        keep[s + k] = total > 0 and 100 * common >= percent * total
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def confirmed_texts(pairs: DataFrame, texts: DataFrame, width: int, percent: int, most_bytes: int, per_copy: int | None = None) -> DataFrame:
    """As ``confirmed``, from doc_id and text: the sets are made where the pair meets. A text shuffles in less than half the
    bytes of its set of 64-bit hashes, which do not compress, for one more pass of hashing over the texts in pairs."""
    hot = {side: _copies(pairs, side, per_copy or PER_COPY) for side in ("a", "b")}
    both = _met(pairs, texts, "text", hot).select("a", "b", "x", "y")
    out = written(both.mapInArrow(_reach(width, percent, most_bytes), "a long, b long").distinct())
    for done in hot.values():
        forget(done)
    return out
