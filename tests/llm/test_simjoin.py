import random
import time

import numpy as np
import pytest
from brute import near
from pyspark.sql import functions as F

from quernstone.llm import confirm, neardup, simjoin
from quernstone.sources import tables
from quernstone.sources.tables import table


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = result(simjoin.op13_jaccard_join(spark, sf))
    assert got == near(rows, 3, 90)
    assert any(c != d for d, (_, c) in got.items())


@pytest.mark.parametrize("block, per_copy, bits", [(1000, 256, 18), (7, 3, 4)])
def test_drifting_copies_and_template_texts(spark, monkeypatch, block, per_copy, bits):
    """Large groups whose pairs lie on both sides of the limit; few buckets, so that the order of shingles is nearly their hashes'."""
    monkeypatch.setattr(simjoin, "BLOCK", block)
    monkeypatch.setattr(simjoin, "SHORT", block // 5)
    monkeypatch.setattr(confirm, "PER_COPY", per_copy)
    monkeypatch.setattr(simjoin, "BITS", bits)
    monkeypatch.setattr(simjoin, "BUCKETS", 1 << bits)
    rng = random.Random(3)
    base = [f"w{rng.randrange(9999)}" for _ in range(90)]
    rows = []
    for i in range(120):
        words = base[:]
        for _ in range(i % 5):
            words[rng.randrange(90)] = f"x{rng.randrange(4)}"  # from a small pool: no shingle is one document's alone
        if i % 12 == 0:
            base[rng.randrange(90)] = f"b{i}"
        rows.append((i, " ".join(words)))
    rows += [(500 + i, " ".join(rng.choice(["a", "b"]) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(simjoin.jaccard_groups(df, 3, 90)) == near(rows, 3, 90)
    assert result(simjoin.jaccard_groups(df)) == near(rows, 5, 80)


@pytest.mark.parametrize("bits", [18, 5])
def test_partners_of_other_sizes(spark, monkeypatch, bits):
    """A text within a longer one: the prefixes end at different shingles, so what is dead for one prefix may be shared beyond the other."""
    monkeypatch.setattr(simjoin, "BITS", bits)
    monkeypatch.setattr(simjoin, "BUCKETS", 1 << bits)
    rng = random.Random(11)
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(30, 90))]
        rows.append((3 * i, " ".join(words)))
        rows.append((3 * i + 1, " ".join(words[rng.randrange(3) : len(words) - rng.randrange(8)])))
        rows.append((3 * i + 2, " ".join([f"u{i}", *words[: len(words) - rng.randrange(6)], f"v{i}"])))
    if bits == 5:
        monkeypatch.setattr(simjoin, "MOST_IDS", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near(rows, 3, 90)
    assert result(simjoin.jaccard_groups(df, 3, 90)) == want
    assert len({c for _, c in want.values()}) < 300


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B\n"), (6, "a b c d e"), (6, "a b c d e"), (7, "a b c d e"), (None, "a b"), (8, "x" * 100_000), (9, "q r s t"), (9, "a b"), (10, "q r s t")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, token int, print int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in simjoin.jaccard_groups(df, 3, 90).collect())
    # 9 has two texts and links the groups of both
    assert got == [(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 3, 6), (6, 3, 6), (7, 3, 6), (8, 1, 8), (9, 1, 4), (9, 2, 4), (10, 2, 4)]
    assert simjoin.jaccard_groups(df.limit(0)).count() == 0


def test_matches_follow_the_cost():
    edges = np.array([0, 100, 200])
    rare = np.zeros(200)
    rare[100:] = 50  # the second set's prefix would propose 50 partners a shingle
    matches, size = simjoin.chosen(rare, edges, 90)
    assert matches[0] == 1 and matches[1] > 1
    assert (size == 10 + matches).all()


def test_confirmation_deals_hot_documents_of_either_side(spark):
    sets = spark.createDataFrame([(i, list(range(20)) + [100 + i] * (i > 0)) for i in range(60)], "doc_id long, shingles array<long>")
    for hot in (0, 59):
        pairs = spark.createDataFrame([(min(hot, i), max(hot, i)) for i in range(60) if i != hot], "a long, b long")
        got = {tuple(r) for r in confirm.confirmed(pairs, sets, 90, per_copy=4).collect()}
        want = {tuple(r) for r in pairs.collect()}
        assert got == want


def test_signatures_never_differ_more_than_the_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**62, n).astype(np.uint64)) for n in (0, 1, 50, 3000)]
    sets += [np.concatenate([s[5:], rng.integers(0, 2**62, 3).astype(np.uint64)]) for s in sets[2:]]
    edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sign = simjoin.signatures(np.concatenate(sets), edges)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert int(np.bitwise_count(sign[i] ^ sign[j]).sum()) <= len(np.setxor1d(a, b))


def test_texts_confirm_what_their_sets_do(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[: rng.randrange(50, 61)] + [f"v{rng.randrange(9)}"] * rng.randrange(3)).upper() for _ in range(40)] + ["", None, "a b", "A  B\n", "é ü"]
    docs = spark.createDataFrame([*enumerate(texts), (0, "a b")], "doc_id long, text string")  # 0 has two texts
    pairs = spark.createDataFrame([(a, b) for a in range(45) for b in range(a + 1, 45)], "a long, b long")
    sets = docs.mapInArrow(neardup._sets(3), "doc_id long, shingles array<long>")
    want = {tuple(r) for r in confirm.confirmed(pairs, sets, 90).collect()}
    for most_bytes in (50, 10_000):
        assert {tuple(r) for r in confirm.confirmed_texts(pairs, docs, 3, 90, most_bytes, per_copy=4).collect()} == want
    assert (42, 43) in want and (0, 42) in want and (40, 41) not in want and 45 < len(want) < 800


def test_no_sets_are_shuffled(spark):
    """Confirmation ships texts: a set of 64-bit hashes is larger and does not compress."""
    rows = [(i, " ".join(f"w{j}" for j in range(i // 2 * 1000, i // 2 * 1000 + 300)) + f" x{i}") for i in range(40)]
    seen, wrote = [], simjoin.written
    with pytest.MonkeyPatch.context() as m:
        m.setattr(simjoin, "written", lambda df: seen.append(df.columns) or wrote(df))
        assert len({c for _, c in result(simjoin.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)).values()}) == 20
    assert ["doc_id", "text"] in seen and not any("shingles" in c for c in seen)


def test_written_tables_leave_no_shuffles(spark):
    files = lambda: {str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}
    before = files()
    out = tables.written(spark.range(200_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.max("id").alias("m")))
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 1000
    assert spark.conf.get(tables.CLEANUP, "false") == "false"
