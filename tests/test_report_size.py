"""Entries of a large report do not carry the whole report along."""

import json

from quernstone.sources import records


def test_entry_has_its_own_names_alone(spark, tmp_path):
    folder = tmp_path / "evaluation" / "r1"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text("\n " + json.dumps({f"i{n}": {"resolved": n % 2 == 0} for n in range(3000)}))
    (folder / "b.json").write_text(json.dumps({"instance_id": "x", "result": {"resolved": True}}))
    (folder / "c.json").write_text('{"y": {"resolved": true}, "y": {"resolved": false}}')
    got = records.run_reports(spark, str(tmp_path), "r1")
    rows = {r.instance: (r.resolved, len(r.entry.metadata)) for r in got.collect()}
    assert len(rows) == 3001 and rows["i7"][0] is False and rows["x"][0] is True
    assert max(n for _, n in rows.values()) < 100
