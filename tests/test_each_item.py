"""The searches of every benchmark item."""

import pytest

from quernstone.plans import registry
from quernstone.sources.tables import table


@pytest.mark.parametrize("each, one", [("trigram_cosine_each", "trigram_cosine_topk"), ("hybrid_fusion_each", "hybrid_fusion_topk")])
def test_every_item_is_answered(spark, sf, each, one):
    rows = registry.queries()[each](spark, sf).collect()
    items = {r.item_id for r in table(spark, sf, "benchmark").collect()}
    assert len(items) > 1 and {r.item_id for r in rows} == items
    first = sorted((r["rank"], r.doc_id, r.score) for r in rows if r.item_id == min(items))
    assert [x[1:] for x in first] == [(r.doc_id, r.score) for r in registry.queries()[one](spark, sf).collect()]
