import math
import random
from fractions import Fraction

from quernstone.llm import tokens, topk
from quernstone.sources.tables import table


def brute(rows, every, k):
    """Every row is a candidate of every query row but itself; scores beyond 64 bits count as the largest or least long."""
    part = []
    for i, v in rows:
        if i is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v):
            part.append((i, [math.floor(Fraction(x) * 256) for x in v]))
    out = []
    for n, (q, e) in enumerate(part):
        if q % every == 0:
            s = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(e, f)))), c) for m, (c, f) in enumerate(part) if m != n and len(f) == len(e))[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_many_shards_agree_with_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 90)
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert got(topk.op9_exact_top_k(spark, sf)) == brute(rows, 50, 5)


def test_shards_that_share_a_bound(spark, sf, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 30)
    monkeypatch.setattr(topk, "MOST_BALLS", 5)
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert got(topk.op9_exact_top_k(spark, sf)) == brute(rows, 50, 5)


def test_balls_are_not_shuffled_with_the_queries(spark):
    queries = spark.range(9).selectExpr("id AS row", "1.0D AS norm", "0 AS home")
    bars = spark.range(9).selectExpr("id AS row", "0L AS bar")
    balls = spark.range(1).selectExpr("array(struct(-1.0D AS lo, 0L AS group), struct(-1.0D AS lo, 1L AS group)) AS balls")
    joined = queries.hint("merge").join(bars, "row", "left")
    out = topk.sent(joined, balls, 0, 2, 2, 3).repartition(3, "shard")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Exchange") < plan.index("NestedLoopJoin") < plan.index("SortMergeJoin")
    assert sorted(tuple(r) for r in out.select("row", "shard").collect()) == [(i, s) for i in range(9) for s in (1, 2)]


def test_vectors_that_take_no_part_and_ties(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 2.0, 3.0]), (302, [math.nan] * 4), (303, [math.inf] * 4), (None, [1.0] * 4), (50, [0.0] * 4), (7, rows[7][1]), (350, []), (400, [9.0, 9.0]), (401, [1e6, -1e6])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, shard string")
    assert got(topk.top_k(df, 50, 5)) == brute(rows, 50, 5)
    assert topk.top_k(df.limit(0), 50, 5).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark, monkeypatch):
    rows = [(50, [1.0]), (50, [2.0]), (1, [3.0]), (1, [3.0]), (100, [-1.0]), (100, [-1.0])] + [(50, [0.5])] * 20
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = brute(rows, 50, 5)
    assert len(want) == 5 * 24 and got(topk.top_k(df, 50, 5)) == want
    monkeypatch.setattr(topk, "SHARD_ROWS", 4)
    assert got(topk.top_k(df, 50, 5)) == want


def test_large_components_score_exactly(spark, monkeypatch):
    rng = random.Random(9)
    sizes = (3.0, 1e9, 4e18, 1e150, 1.7e308)
    rows = [(i, [rng.choice((-1, 1)) * rng.random() * sizes[i % 5 if i % 3 else i % 2] for _ in range(4)]) for i in range(200)]
    rows += [(300, [1e9, 1e9, 0.0, 0.0]), (301, [1e9, -1e9, 3.0, 1.0]), (302, [1e9, -1e9, 1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (8192, 30):
        monkeypatch.setattr(topk, "SHARD_ROWS", shard)
        assert got(topk.top_k(df, 50, 5)) == brute(rows, 50, 5)


def test_counts_are_those_of_the_unigram_model(spark, sf):
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    pieces = tokens.vocabulary(tokens.default_vocabulary())
    tok = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tok.normalizer = normalizers.Sequence([normalizers.Replace(Regex(r"[\x20\x09-\x0D]+"), " "), normalizers.Replace(Regex(r"^ | $"), "")])
    tok.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    odd = ["", None, "  ", "a▁b ▁▁c", "一\U0001f600 x́", "<s> <0x41> <unk>", "zzzzqqqq" * 500, "a\x00b\xa0c"]
    rows = docs + [(10**6 + i, t) for i, t in enumerate(odd)] + docs[:2]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_words int")
    have = sorted((r.doc_id, r.n_tokens) for r in tokens.token_counts(df).collect())
    assert have == sorted((d, len(tok.encode(t, add_special_tokens=False).ids) if t and t.strip() else 0) for d, t in rows)
    assert tokens.token_counts(df.limit(0)).count() == 0
