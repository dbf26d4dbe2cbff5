"""Exact inner-product search by ball-tree branch and bound.

The vectors are dealt into shards of about SHARD_ROWS rows by falling norm. A task reads one shard,
builds its ball tree once, and streams the queries that were sent to it past the tree: a node's bound
for a query is q.c + |q| r, the child with the larger bounds comes first, and a query leaves the walk
where the bound lies under its kth score. The kth score is shared in rounds: first every query
searches one shard alone, dealt by a hash; then, with its kth score as the bar, the shards with the
largest norms; then, with the new bar, the rest. A query is copied to those shards only whose ball
about the origin, |q| times the shard's largest norm, reaches the bar.

Shards are numbered by falling norm, and neighbours share a bound where there are more than MOST_BALLS of
them. So the table of the largest norms, which reaches each task as one row, holds at most 16 * MOST_BALLS
bytes at any size; a query then goes to some more shards than it must, and loses none.

Defined cases: vectors that are null or hold a null, NaN or infinite component, and rows with a null
id, take no part; every other row is a candidate of every query but itself, rows with equal ids too,
and each row with an id divisible by ``every`` is a query with results of its own; vectors meet only
vectors of their own length; scores are exact, and one beyond 64 bits counts as the largest or least
long; equal scores go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.sources.tables import forget, table, written

SHARD_ROWS, LEAF = 8192, 128
MOST_BALLS = 65_536
NONE = np.iinfo(np.int64).min


def taking_part(vectors: DataFrame, factor: int, vec_id: str, vector: str) -> DataFrame:
    """vec_id, v, dim and a bound of the norm of the floors of the components times factor."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(x), F.lit(True))))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("vec_id", "v", F.size("v").alias("dim"), (factor * F.sqrt(square) * (1 + 1e-9) + F.sqrt(F.size("v"))).alias("norm"))


def scaled(x: np.ndarray, factor: int) -> np.ndarray:
    """Floors of x times factor: doubles, which hold them exactly, or Python integers where the product is too large for one."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(factor))
    if np.isfinite(y).all():
        return y
    return np.array([[math.floor(v * factor) if abs(v) < 2**53 else int(v) * factor for v in row] for row in x.tolist()], object)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b, as longs; NONE is left free."""
    high = max((abs(int(v)) for m in (a, b) if m.size for v in (m.max(), m.min())), default=0)
    if high**2 * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if high**2 * a.shape[1] < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    big = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    out = big(a) @ big(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.minimum(np.maximum(out, int(NONE) + 1), 2**63 - 1).astype(np.int64)


class BallTree:
    """Balls over halves of the points, down to LEAF points. row: numbers that tell rows apart."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.row, self.ids, self.x = row, ids, x
        self.plain = x.dtype != object and (not x.size or float(np.abs(x).max()) < 1e100)  # squares stay finite
        self.root = self._node(np.arange(len(ids)))

    def _node(self, at: np.ndarray):
        stack, root = [(at, None, 0)], None
        while stack:
            at, parent, slot = stack.pop()
            node = {"c": None, "r": math.inf, "at": None, "kids": None}
            if parent is None:
                root = node
            else:
                parent[slot] = node
            if not self.plain:
                node["at"] = at
                continue
            f = self.x[at]
            centre = f.mean(axis=0)
            far = np.sqrt(((f - centre) ** 2).sum(axis=1))
            node["c"], node["r"] = centre, float(far.max())
            if len(at) <= LEAF or not node["r"]:
                node["at"] = at
                continue
            side = f @ (f[far.argmax()] - centre)
            order = np.argsort(side, kind="stable")
            node["kids"] = [None, None]
            half = len(at) // 2
            stack += [(at[order[:half]], node["kids"], 0), (at[order[half:]], node["kids"], 1)]
        return root


def search(tree: BallTree, qrow: np.ndarray, q: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores and ids of each query; NONE where there are fewer, or none that reaches the bar."""
    score, ids = np.full((len(q), k), NONE), np.zeros((len(q), k), np.int64)
    plain = tree.plain and q.dtype != object and (not q.size or float(np.abs(q).max()) < 1e100)
    f = q.astype(np.float64) if plain else None
    norm = np.sqrt((f * f).sum(axis=1)) if plain else None

    def bound(node, live):
        if not plain:
            return np.full(len(live), math.inf)
        size = np.sqrt((node["c"] ** 2).sum()) + node["r"]
        return f[live] @ node["c"] + norm[live] * (node["r"] + 1e-9 * size) + 1

    stack = [(tree.root, np.arange(len(q)))]
    while stack:
        node, live = stack.pop()
        live = live[bound(node, live) >= np.maximum(bar[live], score[live, k - 1]).astype(np.float64)]
        if not len(live):
            continue
        if node["at"] is None:
            kids = sorted(node["kids"], key=lambda c: bound(c, live).mean())
            stack += [(c, live) for c in kids]  # the larger bounds are popped first
            continue
        for at in np.array_split(node["at"], -(-len(node["at"]) // 1024)):
            s = scores(q[live], tree.x[at])
            s[qrow[live][:, None] == tree.row[at][None, :]] = NONE
            alls = np.concatenate([score[live], s], axis=1)
            alli = np.concatenate([ids[live], np.broadcast_to(tree.ids[at], s.shape)], axis=1)
            order = np.argsort(alli, axis=1, kind="stable")
            alls, alli = np.take_along_axis(alls, order, 1), np.take_along_axis(alli, order, 1)
            order = np.argsort(~alls, axis=1, kind="stable")[:, :k]  # ~s = -s - 1 does not overflow
            score[live], ids[live] = np.take_along_axis(alls, order, 1), np.take_along_axis(alli, order, 1)
    score[score < bar[:, None]] = NONE
    return score, ids


def _searched(k: int, factor: int):
    """A task's function over rows sorted by (shard, kind): a shard's vectors, then its queries."""

    def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
        return scaled(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim), factor)

    def grown(held: list[pa.RecordBatch]) -> dict[int, BallTree]:
        t = pa.Table.from_batches(held)
        out = {}
        for dim in set(t.column("dim").to_pylist()):
            part = t.filter(pc.equal(t.column("dim"), dim)).combine_chunks().to_batches()[0]
            out[dim] = BallTree(part.column("row").to_numpy(), part.column("vec_id").to_numpy(), matrix(part, dim))
        return out

    def run(batches):
        shard, held, trees = None, [], None
        for batch in batches:
            mark = batch.column("shard").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1], [True]])) if batch.num_rows else []
            for s, e in zip(edges[:-1], edges[1:]):
                part = batch.slice(s, e - s)
                if mark[s] // 2 != shard:
                    shard, held, trees = mark[s] // 2, [], None
                if mark[s] % 2 == 0:
                    held.append(part)
                    continue
                if trees is None:
                    trees, held = grown(held) if held else {}, []
                for dim in set(part.column("dim").to_pylist()) & set(trees):
                    some = part.filter(pc.equal(part.column("dim"), dim))
                    for a in range(0, some.num_rows, 4096):
                        qs = some.slice(a, 4096)
                        row, ids = qs.column("row").to_numpy(), qs.column("vec_id").to_numpy()
                        score, near = search(trees[dim], row, matrix(qs, dim), qs.column("bar").to_numpy(), k)
                        found = score != NONE
                        at = np.nonzero(found)[0]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row[at], ids[at], near[found], score[found])], names=["row", "query_id", "vec_id", "score"])

    return run


def sent(queries: DataFrame, balls: DataFrame, a: int, b: int, wide: int, shards: int) -> DataFrame:
    """queries (norm, bar, home) once for each shard, but home, of the groups a to b that reach the bar. A group is ``wide`` shards.

    The one row of balls meets the queries here, after the shuffle that brought their bars, and is gone before the next."""
    reach = F.filter(F.slice("balls", a + 1, b - a), lambda x: -x["lo"] * F.col("norm") * (1 + 1e-9) + 1 >= F.col("bar"))
    some = queries.crossJoin(F.broadcast(balls)).withColumn("_x", F.explode(reach)).drop("balls")
    within = F.sequence(F.col("_x.group") * wide, F.least(F.col("_x.group") * wide + (wide - 1), F.lit(shards - 1)))
    return some.withColumn("shard", F.explode(within.cast("array<int>"))).where(F.col("shard") != F.col("home")).drop("_x")


def top_k(vectors: DataFrame, every: int, k: int, factor: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best partners of each row whose id is divisible by ``every``."""
    rows = written(taking_part(vectors, factor, vec_id, vector).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    base = written(rows.repartitionByRange(shards, F.desc("norm"), F.xxhash64("row")).withColumn("shard", F.spark_partition_id()))
    wide = -(-shards // MOST_BALLS)
    groups = -(-shards // wide)
    largest = base.groupBy(F.floor(F.col("shard") / wide).alias("group")).agg(F.max("norm").alias("hi"))
    balls = written(largest.agg(F.array_sort(F.collect_list(F.struct((-F.col("hi")).alias("lo"), "group"))).alias("balls")))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("home", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    open_bar = F.lit(int(NONE) + 1).cast("long")
    columns = ["shard", "kind", "dim", "row", "vec_id", "bar", "v"]
    vectors_of = base.select("shard", F.lit(0).alias("kind"), "dim", "row", "vec_id", open_bar.alias("bar"), "v")

    def searched(qs: DataFrame) -> DataFrame:
        both = vectors_of.unionByName(qs.withColumn("kind", F.lit(1)).select(*columns))
        dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
        return written(dealt.mapInArrow(_searched(k, factor), "row long, query_id long, vec_id long, score long"))

    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = searched(queries.withColumns({"shard": F.col("home"), "bar": open_bar}))
    if shards > 1:
        first = math.ceil(math.sqrt(groups))
        for a, b in ((0, first), (first, groups)):
            bars = found.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select("row", F.col("s").alias("bar"))
            more = searched(sent(queries.join(bars, "row", "left").withColumn("bar", F.coalesce("bar", open_bar)), balls, a, b, wide, shards))
            found = written(ranked(found.unionByName(more)).drop("rank"))
    for done in (rows, base):
        forget(done)
    return ranked(found).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 best partners by integer inner product of every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), 50, 5)


def oracle() -> dict[str, str]:
    return {"op9_exact_top_k": """
WITH v AS (SELECT row_number() OVER () n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.n, q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.n <> c.n),
r AS (SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5"""}
