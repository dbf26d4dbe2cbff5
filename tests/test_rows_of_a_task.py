"""Tasks take as many rows as fit them, however well the rows compress."""

from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from quernstone.operators import temporal as H
from quernstone.sources import tables


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_cochange_deals_pairs_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    rows = [(c, i) for c in range(80) for i in range(c % 7)] * 2 + [(None, 1), (None, 2), (1, None)]
    df = spark.createDataFrame(rows, "c long, i long").repartition(1)
    n = Counter(p for c in range(80) for p in permutations(range(c % 7), 2))
    want = {(i, p, n[i, p], r) for i in range(7) for r, p in enumerate(sorted((p for x, p in n if x == i), key=lambda p: (-n[i, p], p))[:5], 1)}
    out = H.cochange(df, "c", "i")
    assert set(map(tuple, out.select("i", "partner", "together", "rank").collect())) == want
    pairs = sum(n.values()) // 2
    plan = exchanges(out)
    assert pairs > 50 * 4 and f"{-(-pairs // 50)}), REPARTITION_BY_NUM" in plan
    assert H.cochange(df.where(F.lit(False)), "c", "i").count() == 0


def test_blame_is_dealt_by_its_lines(spark, monkeypatch):
    from quernstone.plans import gate_queries

    monkeypatch.setattr(gate_queries, "BLAMED_ROWS", 100)
    lines = tables.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert f"{-(-lines // 100)}), REPARTITION_BY_NUM" in exchanges(gate_queries.blame_lines(spark, "/root/testdata/sf0.001"))
