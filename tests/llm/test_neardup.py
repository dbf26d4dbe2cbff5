import random

import pytest
from brute import near

from quernstone.llm import neardup
from quernstone.sources.tables import table


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert result(neardup.op2_near_duplicates(spark, sf)) == near(rows)


@pytest.mark.parametrize("small", [64, 3])
def test_chains_and_large_groups(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 15)
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(80)]
    rows = []
    for i in range(150):  # copies that drift: many pairs of the group lie under the threshold
        words = base[:]
        for _ in range(i % 4):
            words[rng.randrange(80)] = f"x{i}"
        if i % 10 == 0:
            base[rng.randrange(80)] = f"b{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, 4)
    assert result(got) == near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B\n"), (6, "a b c d e"), (6, "a b c d e"), (7, "a b c d e"), (None, "a b"), (8, "x" * 100_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bucket int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, 4).collect())
    assert got == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True), (6, 2, 6, True), (7, 2, 6, False), (8, 1, 8, True)]
    kept = neardup.drop_near_duplicates(df, 4)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_ids_with_two_texts_link_their_groups(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (2, "q r s t"), (3, "q r s t")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df, 4).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_sketch_fills_every_bin():
    import numpy as np

    for n in (1, 2, 7, 300):
        sk = neardup.sketch(np.arange(n, dtype=np.uint64), np.array([0, n]))
        assert (sk != neardup.EMPTY).all()


@pytest.mark.parametrize("small", [64, 1])
def test_other_text_of_an_id_is_not_in_its_buckets(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    rng = random.Random(7)
    rows, want = [], {}
    for i in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        rows += [(i, " ".join(words)), (i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(80)))]
        other = words[:]
        for at in (20, 40, 60) if i else (40,):  # some 0.7 alike, but the first 0.9
            other[at] = "x"
        rows.append((100 + i, " ".join(other)))
        want |= {i: i, 100 + i: 100 + i if i else i}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 4).collect()} == want


def test_no_text_is_lost_with_another_of_its_id(spark):
    words = lambda k, n=40: [f"{k}{i}" for i in range(n)]
    a, b, c = " ".join(words("a")), " ".join(words("b")), " ".join(words("c"))
    rows = [(1, a), (2, a + " z"), (2, b), (2, b), (3, b + " z"), (4, c), (4, c), (5, c + " z"), (None, a), (6, None), (6, "")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, _row string")
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(repr(tuple(r)[:2]) for r in kept.collect()) == sorted(map(repr, [(1, a), (2, b), (4, c), (None, a), (6, None), (6, "")]))


def test_pivots_of_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PER_COPY", 3)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: rng.randrange(60)], f"x{i}", *base[rng.randrange(60) :]])) for i in range(30)]
    rows += [(100 + i, " ".join(base + [f"y{i}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(neardup.near_duplicates(df, 4)) == near(rows)


@pytest.mark.parametrize("parts", [1, 5])
def test_which_of_equal_rows_stays(spark, parts):
    """Rows of one id and text that differ in other columns: the least stays, in whatever order they lie."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, s, m) for s, m in (("s2", None), (None, {"k": 1}), ("s1", {"k": 2}), ("s1", {"k": 1}))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([*order, (2, "a b", "x", None)], "doc_id long, text string, source string, more map<string, int>").repartition(parts, "source")
        kept = sorted((r.doc_id, r.source, r.more) for r in neardup.drop_near_duplicates(df).collect())
        assert kept == [(1, "s1", {"k": 1}), (2, "x", None)]
