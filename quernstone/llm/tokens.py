"""Token counts under a unigram vocabulary, without the tokens.

An Aho-Corasick automaton lists every piece of the vocabulary that ends at a character, the longest
first. The best path to a position carries its score and its number of pieces, nothing else. Rules
of ties are those of the tokenizers library's unigram model: a path replaces another only with a
larger score, longer last pieces first, and a character that is no piece costs the least score less
10 and counts as its UTF-8 bytes. Pieces hold the word mark at their start alone, so a text's count
is the sum over its words, and a task counts a word once, however often it occurs.

Defined cases: a null or wordless text has 0 tokens; repeated rows are counted each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import textbytes
from quernstone.sources.tables import table

MARK = "▁"
UNKNOWN_COST = 10.0
CACHED_WORDS = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(1)
def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with log probabilities by Zipf's law of their place. The file's own scores are merge ranks, which add up to nothing."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), -math.log(i + 2.7)) for i in range(sp.get_piece_size())]


class Counter:
    """Counts pieces of words; keeps the counts of recent words."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(reversed(pieces)).items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_COST
        self.known: dict[int, int] = {}

    def segment(self, s: str) -> int:
        """Pieces on the best path through s."""
        n = len(s)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        reached = 0

        def close(upto):  # characters that no single piece covers
            nonlocal reached
            while reached < upto:
                if not single[reached]:
                    candidate = score[reached] + self.unknown
                    if not have[reached + 1] or candidate > score[reached + 1]:
                        score[reached + 1], count[reached + 1] = candidate, count[reached] + len(s[reached].encode("utf-8", "surrogatepass"))
                        have[reached + 1] = True
                reached += 1

        single, have = [False] * n, [False] * (n + 1)
        for end, (size, piece_score) in self.automaton.iter(s):
            close(end)  # all paths to positions up to here are final
            start, end = end + 1 - size, end + 1
            if size == 1:
                single[start] = True
            candidate = score[start] + piece_score
            if not have[end] or candidate > score[end]:
                score[end], count[end], have[end] = candidate, count[start] + 1, True
        close(n)
        return count[n]

    def word(self, w: str) -> int:
        return sum(map(self.segment, re.findall(f"{MARK}[^{MARK}]*", MARK + w))) if MARK in w else self.segment(MARK + w)


@lru_cache(1)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def _counted(path: str):
    def run(batches):
        c = counter(path)
        for batch in batches:
            for a, b, data, offsets in textbytes.slices(batch.column(1)):
                starts, ends, doc = textbytes.words(data, offsets)
                h = textbytes.word_hashes(data, starts, ends)
                unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                sizes = np.empty(len(unique), np.int64)
                raw = data.tobytes()
                for i, (key, at) in enumerate(zip(unique.tolist(), first.tolist())):
                    n = c.known.get(key)
                    if n is None:
                        n = c.word(raw[starts[at] : ends[at]].decode("utf-8", "replace"))
                        if len(c.known) >= CACHED_WORDS:
                            c.known.clear()
                        c.known[key] = n
                    sizes[i] = n
                total = np.bincount(doc, weights=sizes[inverse], minlength=b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.bincount(doc, minlength=b - a).astype(np.int64)), pa.array(total)], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of each row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_counted(path or default_vocabulary()), "doc_id long, n_words long, n_tokens long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document with its number of words and tokens."""
    return token_counts(table(spark, sf_dir, "documents"))
