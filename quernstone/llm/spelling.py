"""Spelling variants: words at an edit distance of one, by blocked Gram matrices of letter counts.

An edit changes few letter counts: one more of a letter (an insertion), or one more of one letter and one less of another
(a replacement). So the squared distance of two words' letter-count vectors is 1 between neighbouring lengths and 2 within
a length; for whole blocks of words it comes from one matrix product, |a|^2 + |b|^2 - 2ab. Pairs at that distance are
verified letter by letter.

Blocks: a word's cell holds the counts of its letters in GROUPS groups (code point mod GROUPS), whose sum is its length.
An edit leads to the same cell or to one of 2 * GROUPS + GROUPS * (GROUPS - 1) adjacent ones, of the same or an adjacent
length; each pair of adjacent cells is looked at from one side. Cells of more than BLOCK words, or of words of many letters,
are dealt into blocks, and pairs of blocks are the tasks; so no task holds more than two blocks. A block gives for each of its words
the number of near words and the best of them, not the pairs.

Defined cases: null words and words with a null count go; rows of one word are added up; an empty table gives an empty
result; words may be of any length and any letters; ties of the largest count go to the word that is first in code-point order.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.sources.tables import forget, table, written

GROUPS = 4
BLOCK = 2048
#: Letters of the words of one block.
BLOCK_LETTERS = 4_000_000
CELL = [f"g{i}" for i in range(GROUPS)]
KEYS = [*CELL, "step", "i", "j"]
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def steps() -> list[tuple[int, ...]]:
    """Changes of a cell by one edit, each from the side of the word that is not longer."""
    unit = np.eye(GROUPS, dtype=int)
    moved = [unit[a] - unit[b] for a, b in itertools.combinations(range(GROUPS), 2)]
    return [tuple(map(int, s)) for s in (unit[0] * 0, *unit, *moved)]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words end to end, and where each word begins."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in words])])


def _celled(batches):
    for batch in batches:
        flat, ends = codes(batch.column(0).to_pylist())
        owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        counts = np.bincount(owner * GROUPS + flat % GROUPS, minlength=batch.num_rows * GROUPS).reshape(-1, GROUPS)
        cells = [pa.array(counts[:, g].astype(np.int32)) for g in range(GROUPS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], names=["word", "n", *CELL])


def near_pairs(a: list[str], b: list[str], chunk: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs at one edit between words of one length and words of the same length or one more."""
    shorter, longer = len(a[0]), len(b[0])
    flat, _ = codes(a + b)
    letters, column = np.unique(flat, return_inverse=True)
    owner = np.concatenate([np.repeat(np.arange(len(a)), shorter), np.repeat(np.arange(len(a), len(a) + len(b)), longer)])
    counts = np.bincount(owner * len(letters) + column, minlength=(len(a) + len(b)) * len(letters)).reshape(-1, len(letters))
    counts = counts.astype(np.float32 if longer < 2000 else np.float64)  # exact: no sum exceeds 2 * longer ** 2
    x, y = counts[: len(a)], counts[len(a) :]
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2 * (x @ y.T)
    left, right = np.nonzero(square == (1 if longer > shorter else 2))
    p, q = flat[: len(a) * shorter].reshape(len(a), shorter), flat[len(a) * shorter :].reshape(len(b), longer)
    keep = np.zeros(len(left), bool)
    for s in range(0, len(left), step := max(1, chunk // longer)):
        u, v = p[left[s : s + step]], q[right[s : s + step]]
        if longer == shorter:
            keep[s : s + step] = (u != v).sum(axis=1) == 1
        else:  # equal letters from the front and from the back cover the shorter word
            front = np.cumprod(u == v[:, :-1], axis=1, dtype=np.int32).sum(axis=1)
            back = np.cumprod((u == v[:, 1:])[:, ::-1], axis=1, dtype=np.int32).sum(axis=1)
            keep[s : s + step] = front + back >= shorter
    return left[keep], right[keep]


def _best(words: list[str], n: np.ndarray, at: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """For each word that occurs in ``at``: how many others it has, and the one of largest count."""
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], at))
    at, other = at[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    size = np.diff(np.concatenate([first, [len(at)]]))
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in at[first]], pa.string()), pa.array(size), pa.array(n[other[first]]), pa.array([words[i] for i in other[first]], pa.string())], names=["word", "n_near", "near_n", "near"])


def _compared(batches):
    """near words of each pair of blocks; rows come sorted by KEYS and a pair may span batches."""

    def of(part: pa.Table):
        words, n, right = part.column("word").to_pylist(), part.column("n").to_numpy(), part.column("right").to_numpy(zero_copy_only=False)
        i, j, step = (part.column(c)[0].as_py() for c in ("i", "j", "step"))
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        if step == 0 and i == j:
            b = a
        if not len(a) or not len(b):
            return None
        left, other = near_pairs([words[k] for k in a], [words[k] for k in b])
        left, other = a[left], b[other]
        if step == 0 and i == j:  # each pair comes from both sides
            return _best(words, n, left, other) if len(left) else None
        return _best(words, n, np.concatenate([left, other]), np.concatenate([other, left])) if len(left) else None

    held, key = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in KEYS])
        edges = np.flatnonzero(np.concatenate([[True], np.any(keys[:, 1:] != keys[:, :-1], axis=0), [True]])) if batch.num_rows else []
        for s, e in zip(edges[:-1], edges[1:]):
            now = tuple(keys[:, s])
            if held and now != key:
                if (out := of(pa.Table.from_batches(held))) is not None:
                    yield out
                held = []
            key = now
            held.append(batch.slice(s, e - s))
    if held and (out := of(pa.Table.from_batches(held))) is not None:
        yield out


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near and near_n of the words that have near words: how many, and the one of largest count."""
    celled = written(words.select("word", "n").mapInArrow(_celled, "word string, n long, " + ", ".join(f"{g} int" for g in CELL)))
    length = sum((F.col(g) for g in CELL), F.lit(0))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.count("*") * F.first(length) / BLOCK_LETTERS)).cast("int")
    cells = written(celled.groupBy(*CELL).agg(blocks.alias("blocks")))
    own = celled.join(cells, CELL).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).drop("blocks")
    sides = [(k, s, right) for k, s in enumerate(steps()) for right in ((False, True) if any(s) else (False,))]
    literal = F.array(*[F.struct(F.lit(k).alias("step"), F.array(*map(F.lit, s)).alias("by"), F.lit(right).alias("right")) for k, s, right in sides])
    rows = own.select("word", "n", "block", *CELL, F.inline(literal))
    sign = F.when(F.col("right"), -1).otherwise(1)
    rows = rows.withColumns({f"p{i}": F.col(g) + sign * F.get("by", F.lit(i)) for i, g in enumerate(CELL)})
    partner = cells.select(*[F.col(g).alias(f"p{i}") for i, g in enumerate(CELL)], "blocks")
    rows = rows.join(partner, [f"p{i}" for i in range(GROUPS)]).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    within = F.col("step") == 0
    i = F.when(within, F.least("block", "o")).when(F.col("right"), F.col("o")).otherwise(F.col("block"))
    j = F.when(within, F.greatest("block", "o")).when(F.col("right"), F.col("block")).otherwise(F.col("o"))
    right = F.when(within, (F.col("block") > F.col("o"))).otherwise(F.col("right"))
    base = [F.when(F.col("right"), F.col(f"p{k}")).otherwise(F.col(g)).alias(g) for k, g in enumerate(CELL)]
    rows = rows.select(*base, "step", i.alias("i"), j.alias("j"), right.alias("right"), "word", "n")
    dealt = rows.repartition(*KEYS).sortWithinPartitions(*KEYS)
    found = dealt.mapInArrow(_compared, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    out = written(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n")))
    for done in (celled, cells):
        forget(done)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each row (word, form), by pointer jumping: each round doubles the steps taken. A form's count is a multiple of its word's, so chains are as short as the logarithm of the largest count."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        forget(now)
        now = step
        if step.where("moved").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of words (word, n): its form is the near word of largest n, if that is ``factor`` times its own."""
    words = written(words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    near = near_words(words)
    is_form = F.col("near_n") >= factor * F.col("n")
    out = words.join(near, "word", "left").select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n"))
    out = written(out)
    for done in (words, near):
        forget(done)
    out = out.join(roots(out.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, every: int = 199, least_length: int = 6, least_count: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of all letter runs of all texts, A-Z lower-cased. In one run of ``every``, by the checksum of id and run, a letter is left out, so that rare variants of known words are there to be found. A null id counts as empty."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    gap = (h % F.length("run")).cast("int")
    cut: Column = F.concat(F.substr("run", F.lit(1), gap), F.substr("run", gap + 2))
    word = F.when(h % every == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every frequent word of documents with its form and root."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))
