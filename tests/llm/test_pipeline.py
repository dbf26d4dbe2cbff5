from brute import counts, kept, mix, near
from test_packing import check
from test_suffixes import W

import corpus_pipeline
from quernstone.llm import rules
from quernstone.sources.tables import written


def passages(rows):
    """Texts without the 50-byte strings of smaller documents, whole characters only."""
    least = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - W + 1):
            least[b[i : i + W]] = min(least.get(b[i : i + W], d), d)
    out = {}
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - W + 1):
            if least[b[i : i + W]] < d:
                gone[i : i + W] = b"\1" * W
        at, text = 0, []
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                text.append(c)
            at += n
        out[d] = "".join(text)
    return out


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source")) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    good = kept([(r[2], r[3], r[1]) for r in rows], rules.METRICS, rules.FENCE, rules.PRIOR, rules.UNIT)
    rows = [r for r, g in zip(rows, good) if g]
    docs = written(stages["quality_rules"](spark, docs, sf))
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == {r[0] for r in rows}
    group = near([r[:2] for r in rows], 5)
    rows = [r for r in rows if group[r[0]][1] == r[0]]
    docs = written(stages["near_dedup"](spark, docs, sf))
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == {r[0] for r in rows}
    text = passages([r[:2] for r in rows])
    docs = written(stages["suffix_dedup"](spark, docs, sf))
    assert docs.columns == columns and {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {d: (t, len(t)) for d, t in text.items()}
    taken, _ = mix([(r[0], r[3], counts(text[r[0]])[0], text[r[0]]) for r in rows])
    docs = written(stages["source_mix"](spark, docs, sf))
    assert docs.columns == columns
    out = [(r.doc_id, r.text) for r in docs.collect()]
    words = lambda t: counts(t)[0]
    for r, n in zip(rows, taken):
        assert sum(words(t) for d, t in out if d == r[0]) == n
    check(stages["best_fit_packing"](spark, docs, sf).collect(), out)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_on_odd_rows(spark):
    good = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(8))
    other = good.replace("w", "v")
    rows = [(1, good, "en", "s"), (1, good, "en", "t"), (2, good, "en", "s"), (2, good, "en", "s"), (None, other, None, None), (None, other, None, None), (3, None, "en", "s"), (4, "", None, "s"), (5, "é " + " ".join(f"z{j}" for j in range(40_000)), "de", "s")]
    names = ["_i", "_t", "_row", "_h", "_size", "row", "shard", "target", "taken", "kept", "n_words", "piece", "_source", "component_id", "text_crc32"]
    rows = [(*r[:2], len(r[1] or ""), *r[2:], *[f"{c}{k}" for c in names]) for k, r in enumerate(rows)]
    schema = "doc_id long, text string, n_chars long, lang string, source string, " + ", ".join(f"`{c}` string" for c in names)
    for n in (0, len(rows)):
        docs = written(spark.createDataFrame(rows[:n], schema))
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, docs, ""))
            if name != "best_fit_packing":
                assert out.columns == docs.columns, name
                docs = out
            if name == "quality_rules":
                assert out.count() == min(n, 7)  # without words: rejected
            if name == "near_dedup":
                assert sorted(repr(r.doc_id) for r in out.collect()) == (["1", "5", "None", "None"] if n else [])
                assert not n or [r._row for r in out.collect() if r.doc_id == 1] == ["_row0"]
        assert (out.count() > 0) == (n > 0)
