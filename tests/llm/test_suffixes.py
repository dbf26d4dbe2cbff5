import hashlib
import random

import numpy as np
import pytest

from quernstone.llm import runs, suffixes
from quernstone.sources.tables import table

W = 50


def brute(rows):
    least = {}
    for d, t in rows:
        if d is not None:
            b = (t or "").encode()
            for i in range(len(b) - W + 1):
                s = b[i : i + W]
                least[s] = min(least.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - W + 1):
                if least[b[i : i + W]] < d:
                    gone[i : i + W] = b"\1" * W
        spans = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def digest(spark, rows, **more):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int")
    df = suffixes.joined(df).select("_row.doc_id", "_text", "spans")
    out = df.mapInArrow(suffixes._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return sorted([tuple(r) for r in out.collect()], key=repr)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = sorted([tuple(r) for r in suffixes.op10_suffix_dedup(spark, sf).collect()], key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("hot", [2, 2000])
def test_hot_passages_small_slices_and_periods(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 700)
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    rng = random.Random(hot)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for i in range(120):
        t = " ".join(word() for _ in range(rng.randrange(60)))
        if i % 3 == 0:
            t = t[: rng.randrange(40)] + passage[rng.randrange(30) :] + t
        if i % 17 == 0:
            t += "x" * rng.randrange(200) + "ab" * rng.randrange(90)
        rows.append((rng.randrange(10**6) if i % 11 else 10**9 - i, t))
    rows += [rows[3], rows[40], (5, rows[9][1])]
    assert digest(spark, rows) == brute(rows)


def test_edge_cases(spark):
    long = "".join(chr(97 + (i * i) % 26) for i in range(300))
    rows = [(1, None), (2, ""), (3, "short"), (None, long), (None, long), (7, long), (7, long), (8, long), (9, long[:49]), (10, long[:50]), (4, "é" * 60), (5, "xé" + "é" * 60)]
    assert digest(spark, rows) == brute(rows)
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    clean = suffixes.without_repeats(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    assert {r.doc_id: r.text for r in clean.collect()}[8] == ""
    assert suffixes.without_repeats(df.limit(0)).count() == 0


def test_queue_on_disk_gives_keys_in_order(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 40)
    rng = np.random.default_rng(1)
    for span in (3, 10**6):
        q = runs.RunQueue(suffixes.STRING, limit=3000)
        a = np.zeros(1000, suffixes.STRING)
        a["key"], a["at"] = rng.integers(0, span, 1000), np.arange(1000)
        for i in range(0, 1000, 90):
            q.push(a[i : i + 90])
        got = list(q.blocks())
        assert len(got) > 1 and sorted(np.concatenate(got)["at"].tolist()) == list(range(1000))
        assert (np.diff(np.concatenate(got)["key"].astype(np.int64)) >= 0).all()
        assert all(x["key"][-1] < y["key"][0] for x, y in zip(got, got[1:]))
