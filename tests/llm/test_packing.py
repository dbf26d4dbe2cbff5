import random
import zlib
from collections import defaultdict

import numpy as np

from quernstone.llm import packing
from quernstone.sources.tables import table


def expected(docs, length=1024):
    """(doc_id, piece) -> (start, length, crc) by the tokenizers library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        cut = (len(ids) - 1) % length + 1
        bounds = [0, *range(cut, len(ids) + 1, length)]
        out += [(d, i, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for i, (s, e) in enumerate(zip(bounds, bounds[1:]))]
    return sorted(out, key=repr)


def check(rows, docs, length=1024):
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=repr) == expected(docs, length)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= length
    return len(seqs)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    n = check(packing.op8_best_fit_packing(spark, sf).collect(), docs)
    total = sum(x[3] for x in expected(docs))
    assert n <= total / 1024 * 1.02 + 2


def test_rounds_lose_nothing(spark, sf):
    docs = table(spark, sf, "documents")
    pieces = packing.written(packing.tokenised(docs))
    rows = packing.packed(pieces, rows_per_part=9).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "hi <|endoftext|> you"), (None, "null id"), (4, "same"), (4, "same"), (2**60 + 1, "x " * 3000), (5, " \n\t")]
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, length int")
    check(packing.pack(df).collect(), docs)
    assert packing.pack(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    blank, line = " " * 1_100_000, "\n" * 1_100_000
    docs = [(1, blank), (2, line), (3, f"a{blank}b <|endoftext|>{blank}<|endoftext|>x{blank}{line}y\t{line}"), (4, "word" * 2_500_000), (5, f"é{blank[:-1]}\u3000z"), (6, "\x1c" * 1_100_000), (7, "after")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check(packing.pack(df).collect(), docs)


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit(np.array([6, 5, 4, 3]), 10) == [[0, 2], [1, 3]]
    rng = random.Random(1)
    sizes = sorted((rng.randrange(1, 100) for _ in range(500)), reverse=True)
    bins = packing.best_fit(np.array(sizes), 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= sum(sizes) / 100 * 1.05 + 1
