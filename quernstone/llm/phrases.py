"""Collocations: phrases of two to five words that occur together more often than their parts suggest.

Counting is level by level: words; then pairs of frequent words; then longer phrases of frequent pairs. What a phrase is
made of occurs at least as often as the phrase, so nothing frequent is lost.

Each task counts its phrases in counting quotient filters, one for each number of words. A word's id takes a cell of b bits, a phrase
k cells; an invertible permutation of the cells (each in turn gains a hash of the one before it, in two rounds) spreads them evenly. The first bits
of the result are the quotient, all others are kept as remainder, so a counter names its phrase exactly: the permutation
is undone in the end. Entries are sorted; those of a quotient travel together as packed remainders and one-byte counters
(larger counts aside), and filters are merged quotient by quotient. One task's filter has one entry for a phrase however
often it occurs, so no phrase is a hot key.

Ids: a word of a language has a 64-bit key, a seeded hash that is checked against the whole vocabulary; if any two words
share a key of a frequent word, the next seed is taken. Up to MOST_WORDS frequent words, their keys go to all tasks as one sorted array of at most
8 * MOST_WORDS bytes, and a word's id is its place there. Beyond that, ids are the keys themselves and come to the texts by a join.
Frequent pairs go to the tasks as a bitmap of at most 2 ** PAIR_BITS bits; a bit that two pairs share costs entries, not correctness.

Scores are exact: decimals of 38 digits hold products of counts up to 10 ** 16.

Defined cases: a null text is empty; a null lang is ``und``; repeated rows count each; an empty table gives an empty result; texts are
read whole, whatever their length; columns of the input other than lang and text do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm import textbytes
from quernstone.sources.tables import forget, table, written

MOST_WORDS = 1 << 23
PAIR_BITS = 27
#: Entries of a task's filter before it is sent on.
HELD = 1_000_000
#: Occurrences of phrases that one quotient may have on average.
PER_QUOTIENT = 4_000_000
LONGEST = 5
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = BREAKS.copy()
GAPS[[0x20, 0x09]] = True
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD, BREAK = "[^\\x20\\x09]+", "[.,;:!?\\x0A-\\x0D]"


def key_bits(seed: int) -> int:
    """Bits of a word's key under a seed."""
    return 64


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salts: np.ndarray, seed: int, bits: int) -> np.ndarray:
    """A key for each word; salts holds its language's hash."""
    sums = textbytes.prefix_hash(textbytes.mix(textbytes.byte_codes() + np.uint64(seed))[data])
    _, down = textbytes.powers(len(data))
    h = textbytes.mix(textbytes.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)) ^ salts)
    return h >> np.uint64(64 - bits)


def lang_salts(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in langs], np.uint64)


# ---- the filter


def _shift(cells: list[np.ndarray], i: int, turn: int, bits: int) -> np.ndarray:
    return textbytes.mix(cells[i - 1] + np.uint64((2 * turn + 1) * textbytes.ROOT + i & 2**64 - 1)) >> np.uint64(64 - bits)


def permuted(cells: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The cells, spread evenly; restored() undoes it."""
    cells, mask = list(cells), np.uint64(2**bits - 1)
    for turn in range(2):
        for i in range(len(cells)):
            cells[i] = cells[i] + _shift(cells, i, turn, bits) & mask
    return cells


def restored(cells: list[np.ndarray], bits: int) -> list[np.ndarray]:
    cells, mask = list(cells), np.uint64(2**bits - 1)
    for turn in (1, 0):
        for i in reversed(range(len(cells))):
            cells[i] = cells[i] - _shift(cells, i, turn, bits) & mask
    return cells


def limbs_of(cells: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Cells side by side in 64-bit numbers, from the top."""
    per, out = 64 // bits, []
    for i in range(0, len(cells), per):
        limb = np.zeros(len(cells[0]), np.uint64)
        for j, c in enumerate(cells[i : i + per]):
            limb |= c << np.uint64(64 - bits * (j + 1))
        out.append(limb)
    return out


def cells_of(limbs: list[np.ndarray], k: int, bits: int) -> list[np.ndarray]:
    per, mask = 64 // bits, np.uint64(2**bits - 1)
    return [limbs[i // per] >> np.uint64(64 - bits * (i % per + 1)) & mask for i in range(k)]


def summed(limbs: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct entries with their counts."""
    if not len(counts):
        return limbs, counts
    order = np.lexsort(limbs[::-1])
    limbs = [x[order] for x in limbs]
    new = np.ones(len(counts), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in limbs], axis=0)
    first = np.flatnonzero(new)
    return [x[first] for x in limbs], np.add.reduceat(counts[order], first)


def _columns(k: int, bits: int, quotient: int) -> list[int]:
    """The bytes of big-endian limbs that a remainder keeps."""
    per = 64 // bits
    kept = [8 * (i // per) + b for i in range(0, k, per) for b in range(-(-min(per, k - i) * bits // 8))]
    return kept[quotient // 8 :]


def packed(limbs: list[np.ndarray], counts: np.ndarray, k: int, bits: int, quotient: int) -> pa.RecordBatch:
    """A row for each quotient: its remainders and counters."""
    top = (limbs[0] >> np.uint64(64 - quotient)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1], [True]]))
    raw = np.stack(limbs, axis=1).astype(">u8").view(np.uint8).reshape(len(counts), -1)[:, _columns(k, bits, quotient)]
    small = np.minimum(counts, 255).astype(np.uint8)
    rows = [(int(top[s]), raw[s:e].tobytes(), small[s:e].tobytes(), counts[s:e][small[s:e] == 255].tolist()) for s, e in zip(edges[:-1], edges[1:])]
    q, rest, n, large = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([k] * len(q), pa.int32()), pa.array(q, pa.int32()), pa.array(rest, pa.binary()), pa.array(n, pa.binary()), pa.array(large, pa.list_(pa.int64()))], names=["k", "quotient", "rest", "counts", "large"])


def unpacked(rows: list[tuple], k: int, bits: int, quotient: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Limbs and counts of the rows (rest, counts, large) of one quotient, whose value is the first row's last entry."""
    counts = np.concatenate([np.frombuffer(n, np.uint8).astype(np.int64) for _, _, n, _ in rows])
    counts[counts == 255] = np.concatenate([np.asarray(large, np.int64) for *_, large in rows])
    kept = _columns(k, bits, quotient)
    raw = np.zeros((len(counts), 8 * -(-k // (64 // bits))), np.uint8)
    raw[:, kept] = np.frombuffer(b"".join(rest for _, rest, _, _ in rows), np.uint8).reshape(len(counts), len(kept))
    raw[:, : quotient // 8] = np.frombuffer(rows[0][0].to_bytes(quotient // 8, "big"), np.uint8)
    limbs = raw.view(">u8").astype(np.uint64)
    return [limbs[:, i].copy() for i in range(limbs.shape[1])], counts


# ---- texts to ids


def _tokens(batch: pa.RecordBatch):
    """(data, starts, ends, salts, text of each word, word begins a piece) of slices of the texts; A-Z are lower-cased."""
    langs = batch.column(0).dictionary_encode()
    salts = lang_salts(langs.dictionary.to_pylist())[langs.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)
    for a, b, data, offsets in textbytes.slices(batch.column(1)):
        data = textbytes.LOWER[data]
        starts, ends, of = textbytes.words(data, offsets, GAPS)
        if len(starts):
            breaks = np.cumsum(BREAKS[data])
            fresh = np.ones(len(starts), bool)
            fresh[1:] = (of[1:] != of[:-1]) | (breaks[starts[1:] - 1] != breaks[ends[:-1] - 1])
            yield data, starts, ends, salts[a:b][of], of + a, fresh


def _word_counts(batches):
    """lang, word and n of each slice."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, code = langs.dictionary, langs.indices.to_numpy()
        for data, starts, ends, _, of, _ in _tokens(batch):
            ends_of = np.concatenate([[0], np.cumsum(ends - starts)])
            at = np.repeat(starts - ends_of[:-1], ends - starts) + np.arange(ends_of[-1])
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_of.astype(np.int64)), pa.py_buffer(data[at])]).dictionary_encode()
            pair, n = np.unique(words.indices.to_numpy().astype(np.int64) * len(names) + code[of], return_counts=True)
            word = words.dictionary.take(pa.array(pair // len(names))).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(pair % len(names))), word, pa.array(n)], names=["lang", "word", "n"])


def _keyed(seed: int, bits: int):
    """lang, word, n and key of words."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            salts = lang_salts(langs.dictionary.to_pylist())[langs.indices.to_numpy()] if batch.num_rows else np.zeros(0, np.uint64)
            for a, b, data, offsets in textbytes.slices(batch.column(1)):
                key = word_keys(data, offsets[:-1], offsets[1:], salts[a:b], seed, bits)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(key.view(np.int64))], names=["lang", "word", "n", "key"])

    return run


def frequent_words(words: DataFrame, least: int) -> tuple[DataFrame, int, int]:
    """lang, word, n and key of the frequent ones of words, with the seed and the bits of their keys: the first seed under which no other word has such a key."""
    seed = 0
    while True:
        bits = key_bits(seed)
        keyed = words.mapInArrow(_keyed(seed, bits), "lang string, word string, n long, key long")
        shared = keyed.groupBy("key").agg(F.count("*").alias("k"), F.max("n").alias("n")).where((F.col("k") > 1) & (F.col("n") >= least))
        if shared.isEmpty():
            return written(keyed.where(F.col("n") >= least)), seed, bits
        seed += 1


def _ids_by_array(known: np.ndarray, seed: int, bits: int):
    """A task's reader: texts of a batch as ids (places in known), whether each word is known, and whether it begins a piece."""

    def read(batch):
        for data, starts, ends, salts, _, fresh in _tokens(batch):
            key = word_keys(data, starts, ends, salts, seed, bits)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            yield at.astype(np.uint64), known[at] == key, fresh

    return read


def _ids_by_join(batch):
    """A task's reader of rows that hold their texts' keys: null is an unknown word or the end of a piece."""
    for keys in batch.column(0):
        values = keys.values
        if values is not None and len(values):
            yield values.fill_null(0).to_numpy().view(np.uint64), values.is_valid().to_numpy(zero_copy_only=False), np.zeros(len(values), bool)


def _texts_as_keys(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """keys of each piece of each text, in order; the join replaces the array of known keys where that would be too large."""
    pieces = docs.select("lang", F.explode(F.split(F.translate("text", UPPER, LOWER), BREAK)).alias("piece"))
    rows = written(pieces.select(F.monotonically_increasing_id().alias("row"), "lang", F.regexp_extract_all("piece", F.lit(WORD), F.lit(0)).alias("ws")))
    words = rows.select("row", "lang", F.posexplode("ws").alias("pos", "word"))
    keyed = words.join(frequent.select("lang", "word", "key"), ["lang", "word"], "left")
    ordered = keyed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("ks"))
    return ordered.select(F.transform("ks", lambda x: x["key"]).alias("keys"))


def pair_bits(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each pair of ids."""
    return (textbytes.mix(textbytes.mix(a + np.uint64(1)) + b * np.uint64(textbytes.ROOT)) >> np.uint64(64 - bits)).astype(np.int64)


def _filters(read, bits: int, quotient: int, sizes: tuple[int, ...], pairs: tuple[np.ndarray, int] | None):
    """A task's function: its filters of phrases of the given sizes; of frequent pairs alone, if a bitmap is given."""

    def run(batches):
        held: dict[int, list] = {k: [] for k in sizes}

        def full(k, at_end=False):
            limbs = [np.concatenate(x) for x in zip(*(x for x, _ in held[k]))]
            limbs, counts = summed(limbs, np.concatenate([n for _, n in held[k]]))
            if at_end or len(counts) > HELD // 2:
                held[k] = []
                return packed(limbs, counts, k, bits, quotient) if len(counts) else None
            held[k] = [(limbs, counts)]

        for batch in batches:
            for ids, known, fresh in read(batch):
                met = known[:-1] & known[1:] & ~fresh[1:]
                if pairs is not None and len(met):
                    bit = pair_bits(ids[:-1], ids[1:], pairs[1])
                    met &= (pairs[0][bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                runs = met
                for k in range(2, LONGEST + 1):
                    if k > 2:
                        runs = runs[:-1] & met[k - 2 :]
                    at = np.flatnonzero(runs)
                    if k in held and len(at):
                        limbs = limbs_of(permuted([ids[at + i] for i in range(k)], bits), bits)
                        held[k].append(summed(limbs, np.ones(len(at), np.int64)))
                        if sum(len(n) for _, n in held[k]) > HELD and (out := full(k)) is not None:
                            yield out
        for k in sizes:
            if held[k] and (out := full(k, True)) is not None:
                yield out

    return run


def _merged(bits: int, quotient: int, least: int, known: np.ndarray | None, pair_size: int):
    """g (keys), f and bit of the frequent phrases; rows come sorted by (k, quotient)."""

    def of(key, rows):
        k = int(key[0])
        limbs, counts = summed(*unpacked([(int(key[1]), *r) for r in rows], k, bits, quotient))
        often = counts >= least
        ids = restored(cells_of([x[often] for x in limbs], k, bits), bits)
        bit = pair_bits(ids[0], ids[1], pair_size)
        flat = np.stack([known[x.astype(np.int64)] if known is not None else x for x in ids], axis=1).view(np.int64).reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k, dtype=np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([lists, pa.array(counts[often]), pa.array(bit)], names=["g", "f", "bit"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            ks, qs = batch.column("k").to_numpy(), batch.column("quotient").to_numpy()
            for i in range(batch.num_rows):
                if (now := (ks[i], qs[i])) != key:
                    if rows:
                        yield of(key, rows)
                    key, rows = now, []
                rows.append((batch.column("rest")[i].as_py(), batch.column("counts")[i].as_py(), batch.column("large")[i].as_py()))
        if rows:
            yield of(key, rows)

    return run


def _bitmap(pairs: DataFrame, bits: int) -> np.ndarray:
    """The bits of all pairs, 2 ** bits at most 2 ** PAIR_BITS, from partial bitmaps of 32,768 bits that Spark merges."""
    out = np.zeros(1 << bits >> 3, np.uint8)
    part = pairs.groupBy(F.expr("bit div 32768").alias("at")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("map"))
    for at, bitmap in part.toLocalIterator():
        some = np.frombuffer(bytes(bitmap), np.uint8)
        start = at * 4096
        out[start : start + 4096] = some[: len(out) - start]
    return out


def phrase_counts(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals (lang, n), frequent words (lang, word, n, key) and frequent phrases (g, f) of one to five words, g being their words' keys, of docs (lang, text)."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = written(docs.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent, seed, bits = frequent_words(words, least)
    size = frequent.count()
    singles = frequent.select(F.array("key").alias("g"), F.col("n").alias("f"))
    if not size:
        return totals, frequent, singles
    n = totals.agg(F.sum("n")).first()[0]
    quotient = 8 * min(3, max(1, math.ceil(math.log2(max(1, n / PER_QUOTIENT)) / 8)))
    if size <= MOST_WORDS:
        known = np.sort(frequent.select("key").toArrow().column("key").to_numpy().view(np.uint64))
        width, read, source = max(quotient, int(size - 1).bit_length()), _ids_by_array(known, seed, bits), docs
    else:
        known, width, read, source = None, 64, _ids_by_join, written(_texts_as_keys(docs, frequent))

    def counted(sizes, pairs, pair_size):
        rows = source.mapInArrow(_filters(read, width, quotient, sizes, pairs), "k int, quotient int, rest binary, counts binary, large array<long>")
        rows = rows.repartition("k", "quotient").sortWithinPartitions("k", "quotient")
        return written(rows.mapInArrow(_merged(width, quotient, least, known, pair_size), "g array<long>, f long, bit long"))

    two = counted((2,), None, PAIR_BITS)
    more = counted((3, 4, 5), (_bitmap(two, PAIR_BITS), PAIR_BITS), PAIR_BITS)
    grams = singles.unionByName(two.drop("bit")).unionByName(more.drop("bit"))
    return totals, frequent, grams


def collocations(docs: DataFrame, least: int = 100, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases; docs has lang and text."""
    totals, frequent, grams = phrase_counts(docs, least)
    k = F.size("g")
    langs = frequent.select("lang", F.col("key").alias("head"))
    long = grams.where("size(g) > 1").select("g", F.col("f").alias("a"))
    # phrases inside longer ones that occur as often
    spans = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("m")) for m in range(2, LONGEST) for s in range(1, LONGEST - m + 2)])
    inner = long.select("g", "a", F.explode(F.filter(spans, lambda x: (x["m"] < k) & (x["s"] + x["m"] <= k + 1))).alias("x"))
    inside = inner.groupBy(F.slice("g", F.col("x.s"), F.col("x.m")).alias("g")).agg(F.max("a").alias("b"))
    kept = long.join(inside, "g", "left").where("b IS NULL OR 100 * b < 100 * a").select("g", "a")
    # the cut of lowest score
    cuts = kept.withColumn("head", F.get("g", F.lit(0))).join(langs, "head").join(totals, "lang")
    cuts = cuts.select("lang", "n", "g", "a", F.explode(F.sequence(F.lit(1), k - 1)).alias("cut"))
    cuts = cuts.select("*", F.slice("g", F.lit(1), F.col("cut")).alias("gl"), F.slice("g", F.col("cut") + 1, k - F.col("cut")).alias("gr"))
    for side in "lr":
        cuts = cuts.join(grams.select(F.col("g").alias(f"g{side}"), F.col("f").alias(side)), f"g{side}")
    exact = {c: f"CAST({c} AS DECIMAL(16, 0))" for c in "anlr"}
    cuts = cuts.withColumn("score", F.expr(f"({exact['a']} * {exact['n']} * 1000BD) div ({exact['l']} * {exact['r']})"))
    best = cuts.groupBy("lang", "g").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("b")).select("lang", "g", "b.*")
    best = written(best.drop("cut"))
    spelt = best.select("g", F.posexplode("g").alias("at", "key")).join(frequent.select("key", "word"), "key")
    spelt = spelt.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("ws"))
    out = best.join(spelt.select("g", F.array_join(F.transform("ws", lambda x: x["word"]), " ").alias("phrase")), "g")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(64))], ["lang"]):  # first within parts, so that no task ranks all of a language
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of documents."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def oracle() -> dict[str, str]:
    return {"op11_phrase_collocations": f"""
WITH t AS (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAK}')) piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '{WORD}') ws FROM t),
total AS (SELECT lang, sum(len(ws))::BIGINT n FROM w GROUP BY lang),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) i FROM w),
o AS (SELECT lang, ws[i:i + k - 1] g FROM s, (SELECT unnest([1, 2, 3, 4, 5]) k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, g, count(*) f FROM o GROUP BY lang, g HAVING count(*) >= 100),
inside AS (SELECT lang, g[i:i + m - 1] g, max(f) b FROM (SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) i FROM f, (SELECT unnest([2, 3, 4]) m) WHERE m < len(g)) GROUP BY ALL),
kept AS (SELECT lang, g, f a FROM f LEFT JOIN inside USING (lang, g) WHERE len(g) > 1 AND (b IS NULL OR 100 * b < 100 * f)),
cut AS (SELECT lang, g, a, unnest(range(1, len(g))) c FROM kept),
scored AS (SELECT cut.lang, cut.g, a, c, x.f l, y.f r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT score
           FROM cut JOIN total ON total.lang = cut.lang JOIN f x ON x.lang = cut.lang AND x.g = cut.g[:c] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[c + 1:]),
best AS (SELECT *, array_to_string(g, ' ') phrase FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""}
