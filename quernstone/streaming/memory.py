"""Past episodes as a memory that tasks of a stream recall from, and that grows with what they record.

Episodes lie as JSON lines in a folder for each batch that recorded them. What a task may see is a matter of the mode: FROZEN pins the folders that were
there when the memory was opened; ONLINE lists them anew for each batch, so it sees what earlier batches have recorded; DISABLED sees none. All modes record.
A batch that is run again overwrites its own folder, and never sees it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import text as T
from quernstone.operators.evidence import rows_state
from quernstone.sources.tables import WRITTEN, forget_since, written

EPISODE = "id long, repo string, symbol string, text string, resolved boolean"
MODES = ("FROZEN", "ONLINE", "DISABLED")
#: What a shared repository, a symbol within the other's, all words in common and a solved episode are worth, and the least score that counts.
REPO, SYMBOL, WORDS, SOLVED, LEAST = 0.3, 0.4, 0.3, 0.1, 0.1


def _tokens(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0)))


def recall(tasks: DataFrame, episodes: DataFrame, k: int = 3, resolved_only: bool = True) -> DataFrame:
    """task, episode, score and rank of each task's k best episodes, other than one of its own id. tasks and episodes: id, repo, symbol, text; episodes say whether they are resolved.

    Tasks that ask the same and episodes that are equal but for their ids are compared once: of equal episodes the first k and one by id can be among a
    task's best, since ties go to the smaller id and one may be the task's own. Candidates are those that can score: episodes that share a word; that hold
    the symbol or lie in it, found by a part of up to three letters and then compared; and of the task's repository the first k and one of those that are
    resolved or not, since those that share nothing else are equal."""
    e = episodes.where("resolved") if resolved_only else episodes
    low = lambda df: df.withColumns({"s": F.lower(F.coalesce("symbol", F.lit(""))), "w": F.array_sort(_tokens("text"))})
    # a kind: what is equal but for the id
    t_kind, e_kind = F.struct("repo", "s", "w"), F.struct("repo", "s", "w", "resolved")
    asked = written(low(tasks).select(F.col("id").alias("task"), t_kind.alias("t")))
    w = Window.partitionBy("e").orderBy("episode")
    known = written(low(e).select(F.col("id").alias("episode"), e_kind.alias("e")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r"))
    t = asked.select("t").distinct().select("t", F.col("t.repo").alias("t_repo"), F.col("t.s").alias("t_s"), F.col("t.w").alias("t_w"))
    e = known.groupBy("e").agg(F.min("episode").alias("least")).select("e", "least", F.col("e.repo").alias("e_repo"), F.col("e.s").alias("e_s"), F.col("e.w").alias("e_w"))
    words = t.select("t", F.explode("t_w").alias("x")).join(e.select("e", F.explode("e_w").alias("x")), "x").select("t", "e")
    # k and one kinds by their least id hold the first k and one episodes of a repository
    ranked = e.withColumn("r", F.row_number().over(Window.partitionBy("e_repo", "e.resolved").orderBy("least"))).where(F.col("r") <= k + 1)
    repo = t.join(ranked, F.col("t_repo") == F.col("e_repo")).select("t", "e")
    head = lambda s: F.substring(s, 1, 3)
    named_t, named_e = t.where("t_s <> ''").select("t", "t_s"), e.where("e_s <> ''").select("e", "e_s")
    inside = named_t.withColumn("g", head("t_s")).join(named_e.withColumn("g", F.explode(T.parts(F.col("e_s"), 1, 3))), "g").where(F.col("e_s").contains(F.col("t_s")))
    around = named_t.withColumn("g", F.explode(T.parts(F.col("t_s"), 1, 3))).join(named_e.withColumn("g", head("e_s")), "g").where(F.col("t_s").contains(F.col("e_s")))
    met = words.unionByName(repo).unionByName(inside.select("t", "e")).unionByName(around.select("t", "e")).distinct()
    f = F.col
    common = F.size(F.array_intersect("t.w", "e.w"))
    union = F.size("t.w") + F.size("e.w") - common
    within = (f("t.s") != "") & (f("e.s") != "") & (f("e.s").contains(f("t.s")) | f("t.s").contains(f("e.s")))
    score = F.when(f("t.repo") == f("e.repo"), REPO).otherwise(0.0) + F.when(within, SYMBOL).otherwise(0.0) + F.when(union > 0, WORDS * (common / union)).otherwise(0.0) + F.when(f("e.resolved"), SOLVED).otherwise(0.0)
    best = met.withColumn("exact", score).where(f("exact") > LEAST).withColumn("score", F.round("exact", 3))
    # of a kind of tasks, k and one kinds of episodes hold its k and one best episodes
    least = known.groupBy(f("e").alias("_e")).agg(F.min("episode").alias("least"), F.array_sort(F.collect_list("episode")).alias("ids"))  # k and one ids
    best = best.join(least, f("e").eqNullSafe(f("_e"))).withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "least"))).where(f("r") <= k + 1)
    best = best.select("t", "score", F.explode("ids").alias("episode")).withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "episode"))).where(f("r") <= k + 1).select(f("t").alias("_t"), "score", "episode")
    out = asked.join(best, f("t").eqNullSafe(f("_t"))).where("task <> episode")
    w = Window.partitionBy("task").orderBy(F.desc("score"), "episode")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(f("rank") <= k).select("task", "episode", "score", "rank")


class Memory:
    """Episodes below folder, seen as the mode says. Opening it pins the snapshot."""

    def __init__(self, spark: SparkSession, folder: str, mode: str = "FROZEN"):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        self.spark, self.folder, self.mode = spark, folder, mode
        self.pinned = self._batches()

    def _batches(self) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/*/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(s.getPath().getParent().getName() for s in found or [])

    def episodes(self, but: str | None = None) -> DataFrame:
        """What a task may see now, without the batch ``but``."""
        names = [] if self.mode == "DISABLED" else [n for n in (self.pinned if self.mode == "FROZEN" else self._batches()) if n != but]
        return self.spark.read.schema(EPISODE).json([f"{self.folder}/{n}" for n in names]) if names else self.spark.createDataFrame([], EPISODE)

    def fingerprint(self) -> str:
        """Tells one snapshot from another, whatever the order of its episodes; ``empty`` without any."""
        df = self.spark.read.schema(EPISODE).json([f"{self.folder}/{n}" for n in self.pinned]) if self.mode != "DISABLED" and self.pinned else None
        state = rows_state(df) if df is not None else (0,)
        return f"{state[0]:x}-{state[1]:x}-{state[2]:x}" if state[0] else "empty"

    def record(self, episodes: DataFrame, name: str) -> None:
        fields = [f.strip().split(" ")[0] for f in EPISODE.split(",")]
        episodes.select(*fields).write.mode("overwrite").json(f"{self.folder}/{name}")


def answer(stream: DataFrame, memory: Memory, path: str, k: int = 3) -> None:
    """Answers the tasks of a stream (id, repo, symbol, text, resolved) batch by batch, one file each, below path, and records each batch as episodes."""

    def put(batch: DataFrame, number: int) -> None:
        mark = len(WRITTEN)
        tasks = written(batch)
        recall(tasks, memory.episodes(but=f"batch-{number}"), k).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        memory.record(tasks, f"batch-{number}")
        forget_since(batch.sparkSession, mark)

    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
