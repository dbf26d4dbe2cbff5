"""Best-fit packing of tokenised documents into sequences, in rounds.

A document's ids (with the end id) that exceed a sequence are cut into full pieces behind a shorter
first piece. Pieces are dealt to partitions, and each partition packs its own by best fit, longest
first. Nearly full sequences are done. What is left over, a partition's emptiest sequences, goes on
as whole items to the next round, where groups of partitions meet in one and are packed again, until
one partition is left. A sequence carries the list of its pieces, at most as many as it has tokens,
so each round moves only the leftovers and no mapping has to be joined.

Best fit leaves at most one sequence that is at most half full in a partition, and two fuller ones
never fit together; so a partition hands on its sequences of at most half a sequence and as many of
its emptiest others as CARRY. The rest can take nothing that the next round would bring in numbers.
A partition therefore hands on a bounded number of items, however the lengths lie.

A text is tokenised whole. White space of a million characters and more is beyond the back-tracking of tiktoken's
patterns; such a text is cut at its long runs of white space, where the pattern cuts it anyway, and the
tokenizers library does the runs.

Defined cases: a null or empty text is the end id alone; a null id is packed like any other; rows
with equal ids are separate documents with pieces of their own; an empty table packs to nothing.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import textbytes
from quernstone.sources.tables import table, written

LENGTH, END_ID = 1024, 2
NEARLY = 8
CARRY = 64
FAN_IN = 8
BIN = "part int, fill int, items array<struct<doc_id:long,piece:int,start:long,length:int,ids_crc32:long>>"
ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])


@lru_cache(1)
def encoder(path: str, pattern: str):
    """The tokenizer of the file at path, with the ids of the tokenizers library's own encode(add_special_tokens=False). tiktoken runs the same merges: a byte-level BPE's ranks are its ids' order."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


#: The characters of the pattern's white space.
LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


@lru_cache(1)
def slow_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(path: str, pattern: str, text: str) -> np.ndarray:
    """The ids of one text."""
    enc = encoder(path, pattern)
    try:
        return enc.encode_to_numpy(text, allowed_special="all")
    except ValueError:  # the pattern's stack is full
        pass
    slow = lambda t: np.array(slow_encoder(path).encode(t, add_special_tokens=False).ids, np.uint32)
    special = tuple(enc.special_tokens_set)
    if any(c.isspace() for c in "".join(special)):
        return slow(text)
    out, at = [], 0
    for run in LONG_RUN.finditer(text):
        # the last character of a run goes with what follows, if that is no special token
        end = run.end() if run.end() == len(text) or text.startswith(special, run.end()) else run.end() - 1
        out += [enc.encode_to_numpy(text[at : run.start()], allowed_special="all"), slow(text[run.start() : end])]
        at = end
    return np.concatenate([*out, enc.encode_to_numpy(text[at:], allowed_special="all")])


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def _pieces(path: str, pattern: str, length: int, end_id: int):
    """A task's function: texts in, one row for each piece out."""

    def run(batches):
        for batch in batches:
            for a, b, _, _ in textbytes.slices(batch.column(1)):
                out = []
                for doc, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()):
                    ids = np.append(token_ids(path, pattern, text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                    first = (len(ids) - 1) % length + 1
                    cuts = [0, *range(first, len(ids) + 1, length)]
                    out += [(doc, i, s, e - s, zlib.crc32(ids[s:e].tobytes())) for i, (s, e) in enumerate(zip(cuts, cuts[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """The pieces of all documents."""
    path, pattern = tokenizer or default_tokenizer()
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_pieces(path, pattern, length, end_id), "doc_id long, piece int, start long, length int, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Item numbers of each bin: items in the given order, each into the fullest bin that it fits. Bins are kept by free space, so an item costs one look-up."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces: list[int] = []  # the free spaces that some bin has, ascending
    for i, size in enumerate(sizes.tolist()):
        k = bisect.bisect_left(spaces, size)
        if k < len(spaces):
            free = spaces[k]
            b = by_free[free].pop()
            if not by_free[free]:
                spaces.pop(k)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := free - size:
            if not by_free[left]:
                bisect.insort(spaces, left)
            by_free[left].append(b)
    return bins


def _emit(bins: list, part: int, capacity: int, last: bool):
    """Arrow batches of (fill, items) bins; part is -1 on those that are done, and the next round's on the emptiest."""
    bins.sort(key=lambda m: m[0])
    on = 0 if last else max(CARRY, sum(2 * m[0] <= capacity for m in bins))
    for i in range(0, len(bins), 2000):
        some = bins[i : i + 2000]
        parts = [part // FAN_IN if i + k < on and m[0] < capacity - NEARLY else -1 for k, m in enumerate(some)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([m[0] for m in some], pa.int32()), pa.array([m[1] for m in some], pa.list_(ITEM))], names=["part", "fill", "items"])


def _local(capacity: int, last: bool):
    """The first round: a task's pieces in, bins out."""

    def run(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        part = min(r.pop("part") for r in rows)
        rows.sort(key=lambda r: (-r["length"], r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["start"], r["ids_crc32"]))
        bins = best_fit(np.array([r["length"] for r in rows]), capacity)
        yield from _emit([(sum(rows[i]["length"] for i in b), [rows[i] for i in b]) for b in bins], part, capacity, last)

    return run


def _again(capacity: int, last: bool):
    """A later round: bins in, merged bins out."""

    def run(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        rows.sort(key=lambda r: (-r["fill"], r["items"][0]["doc_id"] or 0, r["items"][0]["piece"], r["items"][0]["ids_crc32"]))
        bins = best_fit(np.array([r["fill"] for r in rows]), capacity)
        yield from _emit([(sum(rows[i]["fill"] for i in b), [x for i in b for x in rows[i]["items"]]) for b in bins], min(r["part"] for r in rows), capacity, last)

    return run


def packed(pieces: DataFrame, capacity: int = LENGTH, rows_per_part: int = 40_000) -> DataFrame:
    """pieces with sequence_id and offset. pieces: a written table of doc_id, piece, start, length, ids_crc32."""
    full = pieces.where(F.col("length") >= capacity)
    rest = pieces.where(F.col("length") < capacity)
    n = rest.count()
    parts = max(1, -(-n // rows_per_part))
    rest = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id() % 1024), F.lit(parts)).cast("int"))
    done, level = [], written(_dealt(rest, parts).mapInArrow(_local(capacity, parts == 1), BIN))
    while True:
        done.append(level.where("part < 0"))
        if parts == 1:
            break
        parts = -(-parts // FAN_IN)
        level = written(_dealt(level.where("part >= 0"), parts).mapInArrow(_again(capacity, parts == 1), BIN))
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    bins = bins.withColumn("sequence_id", F.monotonically_increasing_id())
    ends = F.expr("transform(items, (x, i) -> struct(x AS x, aggregate(slice(items, 1, i), 0L, (a, y) -> a + y.length) AS at))")
    out = bins.select("sequence_id", F.explode(ends).alias("e")).select("e.x.doc_id", "e.x.piece", "e.x.start", F.col("e.x.length").cast("long").alias("length"), "e.x.ids_crc32", "sequence_id", F.col("e.at").alias("offset"))
    whole = full.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.unionByName(whole)


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """The rows of one part number in one task: the parts are sized by their rows, not by a key of the data."""
    return df.repartitionById(parts, F.col("part")) if hasattr(df, "repartitionById") else df.repartition(parts, "part")


def pack(docs: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """Tokenised and packed documents: a row for each piece."""
    return packed(written(tokenised(docs, length=capacity)), capacity)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1,024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
