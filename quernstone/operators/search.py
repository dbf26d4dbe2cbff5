"""Searches of a set of queries over all documents in one pass, without moving texts or pairs.

The queries' weights go to every task, behind a check of their size: more queries than MOST_WORDS words
are answered in several passes. A task's documents are tokenised in the JVM; the task scores each
against all queries with numpy and keeps the best few of each query; only those are shuffled.

Scores are rounded half up to four places, as everywhere, and ties go to the smaller id. A null text has no
words; a null id is an id like any other, before all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.retrieval import B, K1, WEIGHTS, top
from quernstone.sources.tables import written

#: Words of queries that tasks are given in one pass.
MOST_WORDS = 500_000
#: Cells and tokens of one step of a task: its memory is some hundred bytes for each.
CELLS, TOKENS = 500_000, 150_000
#: Words of the most current documents that are compared as a matrix.
DENSE = 512
STATIC = ("graph", "temporal", "test")
NO_ID = np.iinfo(np.int64).min


def rounded(x: np.ndarray) -> np.ndarray:
    """Half up, four places, of values not below 0."""
    y = x * 10_000
    low = np.floor(y)
    return (low + (y - low >= 0.5)) / 10_000


def _grouped(key: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The values by key, and where each key's begin."""
    order = np.argsort(key, kind="stable")
    return value[order], np.searchsorted(key[order], np.arange(n + 1))


def _spread(begin: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key all places of its values: which key, and which place."""
    n = begin[key + 1] - begin[key]
    which = np.repeat(np.arange(len(key)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begin[key][which]


def steps(cost: np.ndarray, most: int):
    """Slices of at most ``most`` cost, or of one."""
    total = np.concatenate([[0], np.cumsum(cost)])
    a = 0
    while a < len(cost):
        e = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, e
        a = e


def _summed(begin: np.ndarray, item: np.ndarray, doc: np.ndarray, key: np.ndarray, n: int, m: int, value=None) -> np.ndarray:
    """Sums over each document's keys of what they give each item, as a matrix. doc is in order. Documents are taken some at a time, so that no more than
    CELLS places, or those of one document, are held at once."""
    out = np.zeros((n, m))
    for a, e in steps(np.bincount(doc, begin[key + 1] - begin[key], n), CELLS):
        low, high = np.searchsorted(doc, [a, e])
        which, at = _spread(begin, key[low:high])
        which += low
        out[a:e] = np.bincount((doc[which] - a) * m + item[at], None if value is None else value(which, at), (e - a) * m).reshape(e - a, m)
    return out


def gram_codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 3-grams of ^word$, and each gram's word. Words are ASCII and have a letter at least."""
    ends = np.frombuffer(words.buffers()[1], np.int32 if pa.types.is_string(words.type) else np.int64)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(words) else np.zeros(0, np.uint8)
    size = np.diff(ends)
    at = np.cumsum(size + 2) - size - 2
    padded = np.full(int((size + 2).sum()), ord("$"), np.int64)
    padded[at] = ord("^")
    owner = np.repeat(np.arange(len(size)), size)
    place = at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    padded[place + 1] = data
    return padded[place] | padded[place + 1] << 7 | padded[place + 2] << 14, owner


class Weights:
    """What a task needs of the queries: words with their idf, grams with their counts."""

    def __init__(self, items: list[tuple[int, list[str]]], df: dict[str, int], n_docs: int, avgdl: float):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.avgdl = max(1.0, avgdl)
        words = sorted({w for _, ws in items for w in ws})
        number = {w: i for i, w in enumerate(words)}
        self.words = pa.array(words, pa.string())
        pairs = [(number[w], k) for k, (_, ws) in enumerate(items) for w in dict.fromkeys(ws)]
        word, item = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        n = np.array([df.get(w, 0) for w in words], float)
        idf = np.maximum(0.1, np.log((n_docs - n + 0.5) / (n + 0.5) + 1))
        self.most = np.bincount(item, idf[word] * (K1 + 1), len(items)) if len(item) else np.zeros(len(items))
        self.item, self.begin = _grouped(word, item, len(words))
        self.idf = idf
        firsts = [np.array([number[ws[j]] if len(ws) > j else -1 for _, ws in items], np.int64) for j in (0, 1)]
        self.asked = np.unique(np.concatenate([f[f >= 0] for f in firsts]))  # words whose presence counts
        self.first = [np.where(f >= 0, np.searchsorted(self.asked, f), -1) for f in firsts]
        codes, owner = gram_codes(pa.array([w for _, ws in items for w in ws], pa.string()))
        of = np.repeat(np.arange(len(items)), [len(ws) for _, ws in items])[owner] if len(owner) else owner
        key, count = np.unique(codes * len(items) + of, return_counts=True) if len(codes) else (codes, codes)
        gram, gitem = key // max(1, len(items)), key % max(1, len(items))
        self.norm = np.sqrt(np.bincount(gitem, (count * count).astype(float), len(items)))
        grams = np.unique(gram)
        self.place = np.full(1 << 21, -1, np.int64)
        self.place[grams] = np.arange(len(grams))
        both, self.gram_begin = _grouped(self.place[gram], np.stack([gitem, count], 1) if len(gram) else np.zeros((0, 2), np.int64), len(grams))
        self.gram_item, self.gram_count = both[:, 0], both[:, 1].astype(float)

    def channels(self, words: pa.Array, ends: np.ndarray) -> dict[str, np.ndarray]:
        """The channels of the documents whose words lie between the ends, as a matrix of documents by items, and whether a pair shares a word or a gram."""
        n, m = len(ends) - 1, len(self.ids)
        size = np.diff(ends)
        doc = np.repeat(np.arange(n), size)
        code = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = code >= 0
        t = max(1, len(self.words))
        key, tf = np.unique(doc[known] * t + code[known], return_counts=True)
        d, w = key // t, key % t
        part = self.idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[d] / self.avgdl))
        shared = _summed(self.begin, self.item, d, w, n, m) > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            lexical = _summed(self.begin, self.item, d, w, n, m, lambda which, at: part[which]) / self.most
        held = np.zeros((n, len(self.asked) + 1), bool)
        is_asked = np.isin(w, self.asked)
        held[d[is_asked], np.searchsorted(self.asked, w[is_asked])] = True
        one = lambda j: held[:, self.first[j]] & (self.first[j] >= 0)
        codes, owner = gram_codes(words)
        key, count = np.unique(doc[owner] << 21 | codes, return_counts=True)
        d, g = key >> 21, self.place[key & (1 << 21) - 1]
        square = np.bincount(d, (count * count).astype(float), n)
        d, g, count = d[g >= 0], g[g >= 0], count[g >= 0]
        dot = _summed(self.gram_begin, self.gram_item, d, g, n, m, lambda which, at: count[which] * self.gram_count[at])
        with np.errstate(invalid="ignore", divide="ignore"):
            dense = dot / (np.sqrt(square)[:, None] * self.norm)
        return {
            "lexical": rounded(np.clip(np.nan_to_num(lexical), 0, 1)), "dense": rounded(np.minimum(1, np.nan_to_num(dense))), "traceback": one(0).astype(float), "mention": one(1).astype(float),
            "shares_word": shared, "shares_gram": dot > 0,
        }


def _best(weights: Weights, k: int, by: str):
    """A task's function: its k best documents of each item by one channel, or by the fused score."""

    def run(batches):
        m = len(weights.ids)
        if not m:
            return
        names = ("lexical", "dense", *STATIC, "traceback", "score")
        kept = {c: np.zeros(0) for c in names} | {"item": np.zeros(0, np.int64), "doc": np.zeros(0, np.int64)}
        bar = np.full(m, -np.inf)
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)
            lists = batch.column("toks")
            ends = lists.offsets.to_numpy().astype(np.int64)
            static = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in STATIC if c in batch.schema.names}
            a = 0
            while a < batch.num_rows:
                e = max(a + 1, int(np.searchsorted(ends, ends[a] + TOKENS, "right")) - 1)
                e = min(e, batch.num_rows, a + max(1, CELLS // m))
                ch = weights.channels(lists.values.slice(ends[a], ends[e] - ends[a]), ends[a : e + 1] - ends[a])
                ch |= {c: np.broadcast_to(static[c][a:e, None] if c in static else np.zeros((1, 1)), (e - a, m)) for c in STATIC}
                total = 0.0
                for c, w in WEIGHTS.items():
                    total = total + w * ch[c]
                ch["score"] = rounded(total + 0.1 * ch["mention"])
                value = ch[by]
                fit = {"lexical": ch["shares_word"], "dense": ch["shares_gram"]}.get(by, np.ones(value.shape, bool))
                value = np.where(fit, value, -np.inf)
                least = np.partition(value, len(value) - k, axis=0)[len(value) - k] if len(value) > k else np.full(m, -np.inf)
                d, i = np.nonzero(fit & (value >= np.maximum(least, bar)))
                now = {c: np.concatenate([kept[c], ch[c][d, i]]) for c in names}
                now |= {"item": np.concatenate([kept["item"], i]), "doc": np.concatenate([kept["doc"], ids[a:e][d]])}
                order = np.lexsort((now["doc"], -now[by], now["item"]))
                sorted_item = now["item"][order]
                nth = np.arange(len(order)) - np.searchsorted(sorted_item, sorted_item)
                order = order[nth < k]
                kept = {c: v[order] for c, v in now.items()}
                last = np.searchsorted(kept["item"], np.arange(m), "right")
                full = last - np.searchsorted(kept["item"], np.arange(m)) == k
                bar[full] = kept[by][last[full] - 1]
                a = e
        docs = pa.array(kept["doc"], pa.int64(), mask=kept["doc"] == NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(weights.ids[kept["item"]]), docs, *[pa.array(kept[c]) for c in names]], names=["query_id", "doc_id", *names])

    return run


def weights_of(q: DataFrame, docs: DataFrame) -> Weights:
    """The weights of the queries q, (q, ws), by the word counts of docs, (toks). They are at most MOST_WORDS words, or one query."""
    n_docs, avgdl = docs.agg(F.count("*"), F.coalesce(F.avg(F.size("toks")), F.lit(0.0))).first()
    terms = q.select(F.explode("ws").alias("term")).distinct()
    df = docs.select(F.explode(F.array_distinct("toks")).alias("term")).join(terms, "term", "left_semi").groupBy("term").count()
    return Weights(sorted((r.q, r.ws) for r in q.collect()), {r.term: r["count"] for r in df.collect()}, n_docs, avgdl)


def searched(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, k: int, by: str = "score") -> DataFrame:
    """query_id, doc_id, the channels, score and rank of each query's k best documents by ``by``: lexical (pairs that share
    a word), dense (pairs that share a gram) or score (all pairs). docs: doc_id, text and the channels of STATIC, 0 where they are missing."""
    q = queries.select(F.col(query_id).cast("long").alias("q"), T.tokens(F.col("text")).alias("ws")).where("q IS NOT NULL")
    passes = max(1, -(-(q.agg(F.sum(F.size("ws"))).first()[0] or 0) // MOST_WORDS))
    # tokenised once, read by the counts and by the scores
    rows = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), T.tokens(F.col("text")).alias("toks"), *[c for c in STATIC if c in docs.columns]))
    schema = "query_id long, doc_id long, lexical double, dense double, graph double, temporal double, test double, traceback double, score double"
    found = None
    for i in range(passes):
        weights = weights_of(q.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == i), rows)
        part = rows.mapInArrow(_best(weights, k, by), schema)
        found = part if found is None else found.unionByName(part)
    return top(found, ["query_id"], [F.desc(by), F.asc("doc_id")], k).withColumnsRenamed({"query_id": query_id, "doc_id": doc_id})


class Exemplars:
    """What a task needs of the current documents: their token sets, first tokens and sources."""

    def __init__(self, rows: list[tuple[int, str | None, list[str]]]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        words = sorted({w for r in rows for w in r[2]})
        number = {w: i for i, w in enumerate(words)}
        self.words = pa.array(words, pa.string())
        pairs = [(number[w], k) for k, r in enumerate(rows) for w in r[2]]
        word, item = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.item, self.begin = _grouped(word, item, len(words))
        self.size = np.array([len(r[2]) for r in rows], np.int64)
        first = np.array([number[r[2][0]] if r[2] else -1 for r in rows], np.int64)
        self.asked = np.unique(first[first >= 0])  # words whose presence counts
        self.first = np.where(first >= 0, np.searchsorted(self.asked, first), -1)
        n = np.diff(self.begin)
        dense = np.argsort(-n, kind="stable")[:DENSE]
        self.column = np.full(len(words) + 1, -1, np.int64)
        self.column[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), len(rows)), np.float32)
        which, at = _spread(self.begin, dense)
        self.dense[which, self.item[at]] = 1
        self.sources = sorted({r[1] for r in rows if r[1] is not None})
        place = {s: i for i, s in enumerate(self.sources)} | {None: -1}
        self.source = np.array([place[r[1]] for r in rows], np.int64)


def _alike(current: Exemplars, k: int):
    """A task's function: its k documents most like each current one."""

    def run(batches):
        m = len(current.ids)
        if not m:
            return
        kept = np.zeros((0, 3))  # item, likeness, document
        ids_kept = np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            lists = batch.column("s")
            ends = lists.offsets.to_numpy().astype(np.int64)
            where = pc.fill_null(pc.index_in(batch.column("source"), value_set=pa.array(current.sources, pa.string())), len(current.sources)).to_numpy(zero_copy_only=False).astype(np.int64)
            where[np.array(pc.is_null(batch.column("source")))] = -1
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            # one look-up of each batch's words; all counts are whole and far below 2 ** 24
            found = pc.fill_null(pc.index_in(lists.values, value_set=current.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            step = max(1, CELLS // max(m, DENSE))
            for a in range(0, batch.num_rows, step):
                e = min(a + step, batch.num_rows)
                n, size = e - a, np.diff(ends[a : e + 1])
                doc = np.repeat(np.arange(n), size)
                code = found[ends[a] : ends[e]]
                d, w = doc[code >= 0], code[code >= 0]
                held = np.zeros((n, len(current.asked) + 1), bool)
                is_asked = np.isin(w, current.asked)
                held[d[is_asked], np.searchsorted(current.asked, w[is_asked])] = True
                column = current.column[w]
                dense = np.zeros((n, len(current.dense)), np.float32)
                dense[d[column >= 0], column[column >= 0]] = 1
                common = dense @ current.dense + _summed(current.begin, current.item, d[column < 0], w[column < 0], n, m)
                union = size[:, None] + current.size - common
                x = 0.3 * (where[a:e, None] == current.source) + 0.4 * (held[:, current.first] & (current.first >= 0)) + 0.3 * common / np.maximum(union, 1) + 0.1 * good[a:e, None]
                x = np.where((x > 0.1) & (ids[a:e, None] != current.ids), x, -np.inf)
                y = x * 1000
                low = np.floor(y, where=np.isfinite(y), out=np.full(y.shape, -np.inf))
                x = (low + np.where(np.isfinite(y), (y - np.where(np.isfinite(low), low, 0)) >= 0.5, False)) / 1000
                least = np.partition(x, n - k, axis=0)[n - k] if n > k else np.full(m, -np.inf)
                r, i = np.nonzero(np.isfinite(x) & (x >= least))
                kept = np.concatenate([kept, np.stack([i, x[r, i], np.zeros(len(i))], 1)])
                ids_kept = np.concatenate([ids_kept, ids[a:e][r]])
                order = np.lexsort((ids_kept, -kept[:, 1], kept[:, 0]))
                nth = np.arange(len(order)) - np.searchsorted(kept[order, 0], kept[order, 0])
                kept, ids_kept = kept[order[nth < k]], ids_kept[order[nth < k]]
        yield pa.RecordBatch.from_arrays([pa.array(current.ids[kept[:, 0].astype(np.int64)]), pa.array(ids_kept), pa.array(kept[:, 1])], names=["current", "doc_id", "similarity"])

    return run


def exemplars(docs: DataFrame, current: DataFrame, k: int) -> DataFrame:
    """current, doc_id, similarity and rank of the k documents most like each current one: the same source 0.3, its first token 0.4, 0.3 times Jaccard, 0.1 if good; over 0.1 alone. docs and current: doc_id, source, text and, docs alone, good."""
    q = current.select(F.col("doc_id").cast("long").alias("q"), "source", T.token_set(F.col("text")).alias("s")).where("q IS NOT NULL")
    passes = max(1, -(-(q.agg(F.sum(F.size("s"))).first()[0] or 0) // MOST_WORDS))
    # tokenised once, read by every pass
    rows = written(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "source", T.token_set(F.col("text")).alias("s"), F.coalesce("good", F.lit(False)).alias("good")))
    found = None
    for i in range(passes):
        some = Exemplars([(r.q, r.source, r.s) for r in q.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == i).collect()])  # at most MOST_WORDS tokens
        part = rows.mapInArrow(_alike(some, k), "current long, doc_id long, similarity double")
        found = part if found is None else found.unionByName(part)
    return top(found, ["current"], [F.desc("similarity"), F.asc("doc_id")], k)
