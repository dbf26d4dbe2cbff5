import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quernstone.llm import spelling
from quernstone.sources.tables import table

LOWER = {i: i + 32 for i in range(65, 91)}


def vocabulary(rows):
    out = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def brute(words, factor=5):
    """By deletions: a replacement leaves the same word with a gap at the same place."""
    at = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            at[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in at.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            if (x := w[:i] + w[i + 1 :]) in words:
                near[w].add(x)
                near[x].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def result(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_whole_table_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = result(spelling.op12_spelling_variants(spark, sf))
    assert len(got) == len(set(got)) and set(got) == brute(vocabulary(rows))
    assert any(r[1] for r in got)


@pytest.mark.parametrize("block", [2048, 4])
def test_blocks_and_chains(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(2)
    words = {}
    for _ in range(400):
        w = "".join(rng.choice("abcé中") for _ in range(rng.randrange(1, 7)))
        words[w] = 5 ** rng.randrange(6)
    got = result(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert len(got) == len(words) and set(got) == brute(words)
    assert max(sum(1 for _ in iter_chain(w, {r[0]: r[1] for r in got})) for w in words) >= 3


def iter_chain(w, form):
    while w:
        yield w
        w = form[w]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "Straße " * 5), (3, "y" * 50_000 + " "), (3, ("y" * 49_999 + " ") * 7), (4, "12 ab-cd_ef ABCDEF ÀÉÎÕÜÿ " * 6)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, word string")
    assert {(r.word, r.n) for r in spelling.vocabulary(df).collect()} == set(vocabulary(rows).items())
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0
    words = spark.createDataFrame([("colour", 50), ("colour", 50), ("color", 20), (None, 3), ("colr", None), ("colors", 1)], "word string, n long")
    assert set(result(spelling.variants(words))) == {("colour", None, "colour", 100, 1, None), ("color", "colour", "colour", 20, 2, 100), ("colors", "color", "colour", 1, 1, 20)}
    long = spark.createDataFrame([("q" * 60_000, 1), ("q" * 60_001, 9), ("q" * 30_000 + "p" + "q" * 29_999, 2)], "word string, n long")
    assert {(r.n, r.n_near, r.form_n) for r in spelling.variants(long).collect()} == {(1, 2, 9), (9, 1, None), (2, 1, None)}
