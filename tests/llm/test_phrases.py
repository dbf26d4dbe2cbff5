import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quernstone.llm import phrases

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {g: c for g, c in f.items() if c >= least}
    inside = {}
    for (lang, g), c in f.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                inside[lang, g[i : i + m]] = max(inside.get((lang, g[i : i + m]), 0), c)
    out = []
    for (lang, g), a in f.items():
        if len(g) > 1 and inside.get((lang, g), 0) < a:
            score, _, l, r = min(((1000 * a * n[lang]) // (f[lang, g[:c]] * f[lang, g[c:]]), c, f[lang, g[:c]], f[lang, g[c:]]) for c in range(1, len(g)))
            out.append((lang, " ".join(g), a, l, r, n[lang], score))
    ranked = set()
    for lang in n:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked |= {(lang, i + 1, *x[1:]) for i, x in enumerate(mine[:first])}
    return ranked


def result(df):
    got = [(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed=1):
    rng = random.Random(seed)
    words = ["The", "of", "a", "é", "x-1", "New", "york", "City", "中", "b", "'s"]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", " , "]) for _ in range(rng.randrange(120)))
        rows.append((rng.choice(["en", "fr", None]), text + "new york city " * rng.randrange(4)))
    return rows + [("en", None), (None, ""), ("de", "a"), ("en", "x" * 80_000 + " a b"), ("fr", "a " * 5000)]


@pytest.mark.parametrize("first", [2000, 7])
def test_against_brute_force(spark, first):
    rows = made()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, g int, n int")
    assert result(phrases.collocations(df, 4, first)) == brute(rows, 4, first)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df.where("lang = 'de'")).count() == 0


@pytest.mark.parametrize("change", ["join", "reseed", "spill", "bits"])
def test_other_paths_give_the_same(spark, monkeypatch, change):
    if change == "join":  # more frequent words than the array may hold
        monkeypatch.setattr(phrases, "MOST_WORDS", 0)
    elif change == "reseed":  # keys of four bits collide, those of the third seed do not
        monkeypatch.setattr(phrases, "key_bits", lambda seed: 4 if seed < 2 else 64)
    elif change == "spill":
        monkeypatch.setattr(phrases, "HELD", 10)
        monkeypatch.setattr(phrases, "PER_QUOTIENT", 1)
    else:  # a bitmap in which most pairs share their bits
        monkeypatch.setattr(phrases, "PAIR_BITS", 3)
    rows = made(7)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert result(phrases.collocations(df, 3)) == brute(rows, 3, 2000)


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = set(con.execute(phrases.oracle()["op11_phrase_collocations"]).fetchall())
    got = result(phrases.op11_phrase_collocations(spark, sf))
    assert got and got == want


@pytest.mark.parametrize("bits", [16, 21, 24, 33, 64])
def test_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    for k in (2, 3, 5):
        cells = [rng.integers(0, 2**bits, 400, np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**63, 400).astype(np.uint64) for _ in range(k)]
        limbs, counts = phrases.summed(phrases.limbs_of(phrases.permuted([np.concatenate([c, c[:100]]) for c in cells], bits), bits), np.arange(1, 501))
        batch = phrases.packed(limbs, counts, k, bits, 8)
        back = {}
        for row in batch.to_pylist():
            more, n = phrases.unpacked([(row["quotient"], row["rest"], row["counts"], row["large"])], k, bits, 8)
            ids = phrases.restored(phrases.cells_of(more, k, bits), bits)
            back |= dict(zip(zip(*(x.tolist() for x in ids)), n.tolist()))
        want = Counter()
        for i in range(500):
            want[tuple(int(c[i % 400]) for c in cells)] += i + 1
        assert back == dict(want)
