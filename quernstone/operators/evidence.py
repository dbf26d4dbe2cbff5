"""Evidence about places: weighted unions, lookups by falling precision, earliest of a kind, and decisions that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The weights of a place's evidence.
LOCALIZER = {"file": 1.0, "related": 0.3, "edit": 0.2, "neighbour": 0.2, "issue": 0.1, "test": 0.15}


def looked_up(sites: DataFrame, profiles: DataFrame, keys: list[Column], key: str, value: str, order: str) -> DataFrame:
    """sites with the profile value of the first of their keys that has one, null without; of profiles with one key the last by order counts. One join, whatever the number of keys."""
    last = profiles.groupBy(F.col(key).alias("_key")).agg(F.max_by(value, order).alias(value))
    rows = sites.withColumn("_site", F.monotonically_increasing_id())
    tries = rows.select("_site", F.posexplode(F.array(*keys)).alias("_nth", "_key")).join(last, "_key")
    best = tries.groupBy("_site").agg(F.min(F.struct("_nth", value)).alias("_best"))
    return rows.join(best, "_site", "left").select(*sites.columns, F.col(f"_best.{value}").alias(value), (F.col("_best._nth") + 1).cast("long").alias("tier"))


def site_keys(path: Column, symbol: Column) -> list[Column]:
    """A site's keys from the most to the least precise: whole path or file name with the symbol, then with its last part, then the symbols alone."""
    path = F.translate(path, "\\", "/")
    base, clean = F.substring_index(path, "/", -1), F.substring_index(symbol, ".", -1)
    both = lambda p, s: F.when(p != "", F.concat_ws(":", p, s))
    return [both(path, symbol), both(base, symbol), both(path, clean), both(base, clean), symbol, clean]


def divergence(events: DataFrame, case: str, order: str, branch: Column, limit: Column) -> DataFrame:
    """Each case's first branch up to its limit, else its first event up to it, else its first event. One aggregate."""
    near = F.coalesce(F.col(order) <= limit, F.lit(False))
    first = F.min(F.when(near, F.struct((~branch).alias("plain"), F.col(order).alias("at"))))
    return events.groupBy(case).agg(F.coalesce(first["at"], F.min(order)).alias("at"), first.isNotNull().alias("within"))


def decided(log: DataFrame, key: str, order: str, kind: str, decisions: tuple[str, ...], observed: str) -> DataFrame:
    """Each key's status: its first decision stays, whatever comes later; PENDING without one. n_observed: observations before it; n_late: events after it."""
    first = log.groupBy(F.col(key).alias("_k")).agg(F.min(F.when(F.col(kind).isin(*decisions), F.struct(F.col(order).alias("at"), F.col(kind).alias("kind")))).alias("_d"))
    rows = log.join(first, F.col(key).eqNullSafe(F.col("_k")))
    open_ = F.col("_d").isNull() | (F.col(order) < F.col("_d.at"))
    return rows.groupBy(key).agg(
        F.coalesce(F.max("_d.kind"), F.lit("PENDING")).alias("status"), F.count_if(open_ & (F.col(kind) == observed)).alias("n_observed"), F.count_if(F.col(order) > F.col("_d.at")).alias("n_late"))


def localized(files: DataFrame, hits: DataFrame, case: str, per_file: int = 3, most: int = 7) -> DataFrame:
    """The best places of each case: case, file, symbol, score, rank.

    files: case, file, nth (from 0), n, mentioned. hits: case, file, symbol, source (related or edit), neighbour, issue and
    test (booleans). A file has half its rank's weight, and each hit inherits it; a place counts as a neighbour once. At
    most per_file places of a file and ``most`` of a case."""
    w, half = LOCALIZER, LOCALIZER["file"] * (F.col("n") - F.col("nth")) / F.greatest(F.lit(1), F.col("n")) * 0.5
    f = files.select(case, "file", "nth", half.alias("half"), "mentioned")
    own = f.select(case, "file", F.lit("").alias("symbol"), (F.col("half") + F.when(F.col("mentioned"), w["issue"]).otherwise(0.0)).alias("score"), F.lit(False).alias("neighbour"))
    h = hits.join(f.select(case, "file", "half"), [case, "file"], "left")
    related = F.col("source") == "related"
    add = F.coalesce("half", F.lit(0.0)) + F.when(related, w["related"]).otherwise(w["edit"]) + F.when(related & F.col("issue"), w["issue"]).otherwise(0.0) + F.when(related & F.col("test"), w["test"]).otherwise(0.0)
    all_ = own.unionByName(h.select(case, "file", "symbol", add.alias("score"), "neighbour"))
    millionths = F.round(F.col("score") * 1e6).cast("long")  # sums of whole numbers do not depend on their order
    score = F.round((F.sum(millionths) + F.when(F.max("neighbour"), int(w["neighbour"] * 1e6)).otherwise(0)) / 1e6, 3)
    places = all_.groupBy(case, "file", "symbol").agg(score.alias("score"))
    order = [F.desc("score"), (F.col("symbol") == "").cast("int"), F.asc("file"), F.asc("symbol")]
    places = places.withColumn("_nth", F.row_number().over(Window.partitionBy(case, "file").orderBy(*order))).where(F.col("_nth") <= per_file)
    return places.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("_nth")


def rows_state(df: DataFrame) -> tuple:
    """What tells one set of rows from another, whatever their order: their number and two sums of hashes."""
    h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])))
    return tuple(df.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first())
