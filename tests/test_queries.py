"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from quernstone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return con


def norm(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    same = lambda v: None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, float) else v
    return sorted(repr(tuple(same(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(want.fetchall(), columns)


def test_all_have_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_partitions_do_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("bm25_topk", "cochange_topk", "overlap_dedup", "confidence_fold"):
            out = []
            for n in ("3", "11"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                out.append(sorted(map(repr, registry.queries()[name](spark, SF).collect())))
            assert out[0] == out[1], name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
