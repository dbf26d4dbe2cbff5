"""Streams over a table of several files that come out of order."""

import pytest

from quernstone.plans import registry
from quernstone.sources.tables import table


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("parts"))
    events = table(spark, sf, "events")
    cuts = events.selectExpr("percentile_approx(cast(ts AS timestamp), array(0.33, 0.66)) AS c").first().c
    ts = events.ts.cast("timestamp")
    for rows in (ts > cuts[1], ts <= cuts[0], (ts > cuts[0]) & (ts <= cuts[1])):
        events.where(rows).coalesce(1).write.mode("append").parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["stream_first_deliveries", "stream_window_counts", "stream_ledger_latest", "stream_ledger_status"])
def test_part_files_out_of_order(spark, sf, parts, name):
    rows = lambda d: sorted(map(repr, registry.queries()[name](spark, d).collect()))
    assert rows(parts) == rows(sf) != []
