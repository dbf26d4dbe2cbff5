"""A place is copied for the grids that spans lie on, and for no others."""

import random

import pytest

from quernstone.operators import frames


@pytest.mark.parametrize("lengths, copies", [([3, 15], 1), ([3, 200, 5000], 3), ([-1], 0), ([0, 16, 70_000, 10**10], 4)])
def test_within(spark, lengths, copies):
    rng = random.Random(2)
    p = [(rng.choice("ab"), rng.randrange(-50, 9000)) for _ in range(60)]
    s = [(rng.choice("abc"), i, lo, lo + rng.choice(lengths)) for i in range(40) for lo in [rng.randrange(-60, 9000)]]
    places, spans = spark.createDataFrame(p, "k string, at long"), spark.createDataFrame(s, "k string, id long, lo long, hi long")
    out = frames.within(places, spans, ["k"], "at")
    assert sorted((r.k, r.at, r.id) for r in out.collect()) == sorted((k, at, i) for k, at in p for c, i, lo, hi in s if k == c and lo <= at <= hi)
    assert frames.grids(spans) == sorted({min(n for n, w in enumerate([*frames.WIDTHS[:-1], 10**30]) if x < w) for x in lengths if x >= 0}) and len(frames.grids(spans)) == copies
