"""Event logs: latest state, repeats, folds and idempotent intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(log: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Each key's last state: one aggregate, no sort."""
    last = F.max(F.struct(*order, *values)).alias("s")
    return log.groupBy(key).agg(last, F.count("*").alias("n_events")).select(key, *[F.col(f"s.{c}").alias(c) for c in (*order, *values)], "n_events")


def repeats(log: DataFrame, key: str, order: list[str], call: str) -> DataFrame:
    """Calls that equal the two calls before them, per key; and calls seen at all before."""
    w = Window.partitionBy(key).orderBy(*order)
    log = log.withColumns({"p1": F.lag(call, 1).over(w), "p2": F.lag(call, 2).over(w), "nth": F.row_number().over(Window.partitionBy(key, call).orderBy(*order))})
    return log.withColumns({"guard": F.coalesce((F.col("p1") == F.col(call)) & (F.col("p2") == F.col(call)), F.lit(False)), "seen": F.col("nth") > 1})


def first_delivery(deliveries: DataFrame, key: Column, valid: Column, order: list[str]) -> DataFrame:
    """Valid deliveries once by key; a rejected one does not count as seen, and one without a key is never a repeat."""
    d = deliveries.where(valid).withColumn("_key", key)
    keyed = d.where("_key IS NOT NULL").groupBy("_key").agg(F.min(F.struct(*order, *[c for c in d.columns if c not in (*order, "_key")])).alias("s")).select("s.*")
    return keyed.unionByName(d.where("_key IS NULL").drop("_key"))


def carried(lines: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """The last value seen so far, for each line: a blame header holds for the lines below it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def sessions(lines: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """A session number for each line: the starts up to it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("session", F.sum(F.when(starts, 1).otherwise(0)).over(w))


CHUNK = 4096


def folded(log: DataFrame, key: str, order: str, kind: str, steps: dict[str, tuple], other: tuple, start: int) -> DataFrame:
    """A confidence in hundredths, moved by each event in order and clamped by it, as ``confidence`` in [0, 1].

    An update is c -> min(hi, max(lo, c + d)), and such updates compose to one of the same form. So
    chunks of CHUNK ids fold on their own, in parallel, then CHUNK chunks, and a key folds what is left: a
    hot key is no single task's burden, and no list is longer than CHUNK, up to CHUNK cubed ids."""
    far = 10**12
    one = lambda i, f: F.expr(f"CASE x.k {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v[i] if v[i] is not None else f}' for k, v in steps.items())} ELSE {other[i] if other[i] is not None else f} END")
    log = log.select(key, F.struct(F.col(order).alias("o"), F.col(kind).alias("k")).alias("x"), F.floor(F.col(order) / CHUNK).alias("chunk"))
    log = log.select(key, "chunk", F.struct("x.o", one(0, 0).cast("long").alias("d"), one(1, -far).cast("long").alias("lo"), one(2, far).cast("long").alias("hi")).alias("u"))

    def fold(xs):
        zero = F.struct(F.lit(0).cast("long").alias("d"), F.lit(-far).cast("long").alias("lo"), F.lit(far).cast("long").alias("hi"))
        clamp = lambda v, u: F.least(u["hi"], F.greatest(u["lo"], v + u["d"]))
        return F.aggregate(xs, zero, lambda a, u: F.struct((a["d"] + u["d"]).alias("d"), clamp(a["lo"], u).alias("lo"), clamp(a["hi"], u).alias("hi")))

    chunks = log.groupBy(key, "chunk").agg(F.array_sort(F.collect_list("u")).alias("us"))
    chunks = chunks.select(key, "chunk", F.size("us").cast("long").alias("n"), fold(F.col("us")).alias("f"))
    for level in (F.floor(F.col("chunk") / CHUNK), None):
        keys = [key] if level is None else [key, level.alias("above")]
        up = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", "f"))).alias("fs"), F.sum("n").alias("n"))
        chunks = up.select(key, *([] if level is None else [F.col("above").alias("chunk")]), "n", fold(F.transform("fs", lambda x: x["f"])).alias("f"))
    whole = chunks.withColumnRenamed("n", "n_updates")
    return whole.select(key, (F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.lit(start) + F.col("f.d"))) / 100).alias("confidence"), "n_updates")
