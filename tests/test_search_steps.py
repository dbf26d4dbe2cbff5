"""The searches' steps hold no more cells than they are given, and their size does not matter for the results."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quernstone.operators import search


def tables():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [rng.choices(words[: rng.choice([5, 60])], k=rng.randrange(30)) for _ in range(120)]
    items = [(i, rng.choices(words + ["other"], k=rng.randrange(12))) for i in range(25)]
    docs = pa.record_batch({"doc_id": pa.array(range(120), pa.int64()), "toks": pa.array(texts, pa.list_(pa.string()))})
    sets = pa.record_batch({"doc_id": docs["doc_id"], "source": pa.array([rng.choice(["a", "b", None]) for _ in texts]), "s": pa.array([list(dict.fromkeys(t)) for t in texts], pa.list_(pa.string())), "good": pa.array([i % 3 == 0 for i in range(120)])})
    return items, docs, sets


@pytest.mark.parametrize("cells, tokens, dense", [(1, 1, 0), (60, 40, 3), (10**6, 10**6, 1000)])
def test_any_step(monkeypatch, cells, tokens, dense):
    items, docs, sets = tables()

    def answers():
        weights = search.Weights(items, {"w1": 9, "w2": 80}, 120, 12.0)
        found = [pa.Table.from_batches(search._best(weights, 4, by)([docs])).to_pylist() for by in ("lexical", "dense", "score")]
        alike = search.Exemplars([(r["doc_id"], r["source"], r["s"]) for r in sets.to_pylist()[::7]])
        return found, pa.Table.from_batches(search._alike(alike, 3)([sets])).to_pylist()

    want = answers()
    for k, v in (("CELLS", cells), ("TOKENS", tokens), ("DENSE", dense)):
        monkeypatch.setattr(search, k, v)
    assert answers() == want


def test_places_at_once(monkeypatch):
    """Words that all items hold lead to documents times words times items places; a step takes them some documents at a time."""
    monkeypatch.setattr(search, "CELLS", 1000)
    begin, item = np.arange(0, 51 * 40, 40), np.tile(np.arange(40), 50)  # 50 words, each in 40 items
    doc, key = np.repeat(np.arange(100), 50), np.tile(np.arange(50), 100)
    most = []
    out = search._summed(begin, item, doc, key, 100, 40, lambda which, at: most.append(len(which)) or np.ones(len(which)))
    assert (out == 50).all() and max(most) <= 50 * 40
