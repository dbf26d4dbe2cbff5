import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

from quernstone.llm import crf
from quernstone.sources.tables import table


def test_chain_against_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        u, stay = rng.normal(size=n), 0.7
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(a * b for a, b in zip(u, y)) + stay * sum(a == b for a, b in zip(y, y[1:])))
            total += p
            good += p * np.array(y)
        assert np.allclose(crf.sigmoid(crf.chain(u, np.zeros(n, int), stay)[2]), good / total)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in crf.op5_quality_classifier(spark, sf).collect()}
    docs = table(spark, sf, "documents").count()
    assert len(out) == docs
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in out.items())
    truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    held = [(out[d].score, out[d].predicted, q) for d, q in truth.items() if d in out and out[d].held_out and q is not None]
    right = sum(p == q for _, p, q in held) / len(held)
    pairs = [(a > b) + 0.5 * (a == b) for a, _, q in held for b, _, r in held if q == 1 and r == 0]
    assert right >= 0.93 and sum(pairs) / len(pairs) >= 0.95


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "\n\n"), (4, "one"), (None, "two words"), (5, "x" * 50_000), (6, "a\n" * 3000), (6, "a\n" * 3000)]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in texts], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, None), (None, 0), (99, 1), (6, 0)], "doc_id long, quality int")
    model = crf.trained(docs, labels)
    out = crf.scored(docs, model).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out)
    assert crf.scored(docs.limit(0), model).count() == 0
    nothing = crf.trained(docs, labels.limit(0))
    assert {r.score for r in crf.scored(docs, nothing).collect()} == {0.5}


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_features(text):
    """Features and bytes of each line with a word, by definition."""
    data = text.encode()
    rows, words, keys = [], [], []
    for line in data.split(b"\n"):
        w = WORD.findall(line)
        if w:
            body = line[line.index(w[0]) : line.rindex(w[-1]) + len(w[-1])]
            rows.append((w, body))
            words += w
            keys.append(body)
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    out, at = [], 0
    for w, body in rows:
        n, size = len(w), len(body)
        count = lambda chars: sum(b in chars for b in body)
        letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in body)
        own = {
            "bias": 1.0, "length": math.log1p(size) / 6, "words": math.log1p(n) / 4, "word_length": min(sum(map(len, w)) / n, 20) / 10 - 0.5, "symbols": min(count(b"#*$%&|<>@\\^~{}[]=+_") / n, 3),
            "upper": sum(65 <= b <= 90 for b in body) / max(letters, 1), "digits": sum(48 <= b <= 57 for b in body) / size, "shouts": min(count(b"!?") / n, 3), "stops": min(count(b".,;:!?") / n, 3),
            "ends": float(body[-1] in b".,;:!?"), "capital": float(65 <= body[0] <= 90), "repeated": sum(tri[tuple(words[i : i + 3])] > 1 for i in range(at, at + n) if i + 3 <= len(words)) / n,
            "same_word": sum(i > 0 and words[i] == words[i - 1] for i in range(at, at + n)) / n, "same_line": float(keys.count(body) > 1),
        }
        out.append(own)
        at += n
    table = []
    for i, own in enumerate(out):
        row = [own[c] for c in crf.OWN]
        for c in crf.NEIGHBOURS:
            row += [out[i - 1][c] if i else 0.0, out[i + 1][c] if i + 1 < len(out) else 0.0]
        table.append([*row, float(i == 0), float(i + 1 == len(out))])
    return table, [len(b) for _, b in rows]


def plain_score(model, text):
    x, size = plain_features(text or "")
    if not x:
        return model["empty"]
    u, stay = [sum(a * b for a, b in zip(r, model["w"])) for r in x], model["stay"]
    # log weights of the two states, forward and backward
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    go = lambda b, g: (add(b + stay, g), add(b, g + stay))
    f, b = [(0.0, 0.0)], [(0.0, 0.0)]
    for i in range(1, len(u)):
        f.append(go(f[-1][0], f[-1][1] + u[i - 1]))
        b.append(go(b[-1][0], b[-1][1] + u[len(u) - i]))
    b.reverse()
    odds = [f[i][1] + u[i] + b[i][1] - f[i][0] - b[i][0] for i in range(len(u))]
    p = sum(s / (1 + math.exp(-o)) for s, o in zip(size, odds)) / sum(size)
    p = min(max(p, 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(model["scale"] * math.log(p / (1 - p)) + model["shift"])))


def test_scores_against_a_plain_version(spark, sf):
    docs = table(spark, sf, "documents")
    model = crf.trained(docs, table(spark, sf, "labels"))
    odd = ["", None, " \n\n ", "a", "A b!\nA b!\n\nc d? e\tf", "É é 12 #$ x\n" * 9 + "end.", "same same same\nsame same", "x " * 500 + "\n" + "y\n" * 700]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6 + i, t) for i, t in enumerate(odd)]
    got = {r.doc_id: r.score for r in crf.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for d, t in rows:
        assert abs(got[d] - plain_score(model, t)) < 1e-9, (d, (t or "")[:80])


def test_a_million_lines(spark):
    model = {"w": np.linspace(-1, 1, crf.N_FEATURES), "stay": 0.8, "scale": 1.0, "shift": 0.1, "empty": 0.5}
    text = "one two\nThree!\n" * 500_000
    data = np.frombuffer(text.encode(), np.uint8)
    assert abs(crf.score(model, data, np.array([0, len(data)]))[0] - plain_score(model, "one two\nThree!\n" * 300)) < 1e-2
