import random
import zlib

from brute import counts, kept, mix

from quernstone.llm import mixing, rules, sharding
from quernstone.sources.tables import table, written

ROWS = [(1, None, "en", "s", 1), (2, "", "en", None, 1), (3, " \n\t", None, None, 1), (4, "a b c " * 30, "en", "s", 1), (4, "a b c " * 30, "en", "s", 1), (None, "x y", None, "s", 1), (5, "é# \x0b| $" * 40, "de", "s", 1), (6, "word " * 30_000, "en", "t", 1), (7, "one\n\nTwo\none", "en", "", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, taken int"


def many(n=400):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdeé#") for _ in range(rng.randrange(1, 9)))
    rows = list(ROWS)
    for i in range(n):
        lines = ["".join(word() + " " for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 9))]
        if i % 5 == 0:
            lines += lines[:3] * 3
        rows.append((100 + i, "\n".join(lines), rng.choice(["en", "de", None]), rng.choice(["s", "s", "s", "t", None, "é"]), i))
    return rows


def test_rules_against_brute_force(spark):
    rows = many()
    df = written(spark.createDataFrame(rows, SCHEMA))
    good = kept([(r[2], r[3], r[1]) for r in rows], rules.METRICS, rules.FENCE, rules.PRIOR, rules.UNIT)
    feats = rules.measured(df)
    out = rules.judged(feats, rules.thresholds(feats)).select("_row.doc_id", "_row.taken", *rules.FEATURES, "kept").collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(repr((r[0], r[4], *counts(r[1])[:5], g)) for r, g in zip(rows, good))
    same = rules.keep_good(df)
    assert same.columns == df.columns
    assert sorted(map(repr, map(tuple, same.collect()))) == sorted(repr(r) for r, g in zip(rows, good) if g)
    assert rules.keep_good(df.limit(0)).count() == 0


def test_fences_come_from_the_groups(spark):
    df = table(spark, "/root/testdata/sf0.1", "documents")
    fences = rules.thresholds(written(rules.measured(df.select("doc_id", "text", "lang", "source")).drop("_row"))).collect()
    assert len(fences) == 80
    for c in ("hi_symbols", "hi_dup_lines", "hi_repeats", "hi_word_len", "lo_word_len"):
        assert len({r[c] for r in fences}) > 8, (c, {r[c] for r in fences})


def test_mix_against_brute_force(spark):
    rows = many()
    df = spark.createDataFrame(rows, SCHEMA)
    want, target = mix([(r[0], r[3], counts(r[1])[0], r[1]) for r in rows])
    out = mixing.mixed(df).select("_row.doc_id", "_row.text", "_size", "target", "_source", "taken").collect()
    assert sorted(repr((r.doc_id, r.text, r.taken)) for r in out) == sorted(repr((r[0], r[1], w)) for r, w in zip(rows, want))
    assert all(abs(r.target - target[r._source]) < 1e-6 and r.taken <= 2 * r._size for r in out)
    twice = mixing.mix(df)
    assert twice.columns == df.columns
    sizes = {repr(r): counts(r[1])[0] for r in rows}
    assert sum(sizes[repr(tuple(r))] for r in twice.collect()) == sum(want)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df.where("doc_id < 3")).count() >= 0


def test_a_source_of_one_id_meets_its_target(spark):
    rows = [(None if i % 2 else 7, f"text {i} " * 20, "en", "abc"[i % 3], i) for i in range(3000)]
    out = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).groupBy("_source", "target").sum("taken").collect()
    assert len(out) == 3 and all(abs(r["sum(taken)"] - r.target) <= 40 for r in out)


def check_shards(rows, docs):
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in rows) == sorted(repr((d, size(t), zlib.crc32((t or "").encode()))) for d, t in docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id or -(10**9) for r in order] == sorted(r.doc_id or -(10**9) for r in rows)
    # the plain version: bytes before a row's middle, in the order of id, checksum and size, cut at equal targets
    plain = sorted((d is not None, d or 0, zlib.crc32((t or "").encode()), size(t)) for d, t in docs)
    total, at, want = sum(p[3] for p in plain), 0, []
    for known, d, crc, n in plain:
        want.append((d if known else None, crc, n, min(23, (2 * at + n) * 24 // (2 * total))))
        at += n
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text_crc32, r.size, r.shard)) for r in rows)
    return [sum(r.size for r in by.get(s, [])) for s in range(24)]


def test_shards(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    out = sharding.op7_byte_shards(spark, sf)
    sizes = check_shards(out.collect(), docs)
    largest = max(len(t.encode()) + 8 for _, t in docs)
    assert max(sizes) - min(sizes) <= 2 * largest
    assert {r.law for r in out.select("law").collect()} == {"bytes"}
    df = spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("taken", "shard")
    check_shards(sharding.sharded(df).collect(), [(r[0], r[1]) for r in ROWS])
    assert sharding.sharded(df.limit(0)).count() == 0
