"""Repeated passages by sorting sampled suffixes, whose names and common prefixes induce the rest.

A byte is removed if a string of WIDTH bytes covers it that also starts in a document with a smaller
id. All suffixes of a large corpus cannot travel: a suffix tuple is many times its byte. As induced
sorting does with its S* suffixes, only a sample is sorted, and the order of the others follows from
it. A sampled suffix starts where the hash of NAME bytes is the least within the window, a local
minimum like an S* position but with a bounded distance: every string of WIDTH bytes holds one, at
the same place in every copy.

1. Names. Every sampled suffix sends the hash of its first bytes, and 12 bits of what lies before and
   behind. Tasks merge the sorted runs of all slices of text in a disk-backed queue and find the names
   that two documents share with the same bytes on one side at least. A suffix without a partner is in
   its final place, and so are all that it induces; it is dropped here.
2. Suffixes. The others travel with the WIDTH bytes from the sampled position and the bytes before
   it. The queue hands them over by name; within a name they are sorted by what follows, which gives
   common prefixes, and by what precedes, read backwards. The rank among those that share o bytes
   before and WIDTH - o bytes behind induces the order of the suffixes that start o bytes earlier:
   equal ranks are equal strings, and the least document of each wins.
   A name that very many suffixes share is split first: its strings go out by their own 128-bit names.
3. Spans. The strings that lose are joined to their documents, and the bytes under them go.

Only copies that a task cannot settle itself travel: within a slice of text, all but the least
document of equal contexts lose at once.

Defined cases: a null text is empty; a null id takes no part and keeps its bytes; rows with equal ids
are one document, none of which is smaller than another; texts under WIDTH bytes keep all; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from quernstone.llm import textbytes
from quernstone.llm.runs import RunQueue
from quernstone.sources.tables import table, written

WIDTH, NAME = 50, 16
REACH = WIDTH - NAME  # a string holds the starts of REACH + 1 names
HALF = REACH // 2
HOT = 2000  # suffixes of one name in different slices or surroundings, from which its strings travel by their own names
CHUNK, SLICE_BYTES = 1_000_000, 1_500_000
BUCKET_BYTES = 64 * 2**20  # text for each bucket; there are as many as the shuffle has partitions at least
SLICE_ROWS = 2**15  # texts of a slice have numbers of 15 bits
LOW = np.uint64(0xFFFFFFFF)
PLACE = np.uint64(0xFFFFFF)

NAMED = np.dtype([("key", "<u8"), ("slice", "<i8"), ("doc", "<u4"), ("left", "<u2"), ("right", "<u2"), ("many", "?")])
SUFFIX = np.dtype([("key", "<u8"), ("doc_id", "<i8"), ("print", "<i8"), ("at", "<i8"), ("near", "u1"), ("far", "u1"), ("before", "u1", REACH), ("behind", "u1", WIDTH)])
STRING = np.dtype([("key", "<u8"), ("more", "<u8"), ("doc_id", "<i8"), ("print", "<i8"), ("at", "<i8")])


def least_within(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def samples(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Sampled positions ``at`` with the strings ``lo`` to ``hi`` (first bytes) that hold them, their texts and names."""
    parts = []
    for s in range(0, len(data), CHUNK):  # a long text is cut into runs of strings, which overlap
        parts.append(_sampled(data[s : s + CHUNK + WIDTH - 1], offsets, s))
    parts = [p for p in parts if p]
    if not parts:
        return {k: np.zeros(0, np.int64) for k in ("lo", "hi", "at", "doc")} | {"name": np.zeros(0, np.uint64)}
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _sampled(piece: np.ndarray, offsets: np.ndarray, base: int) -> dict | None:
    if len(piece) < WIDTH:
        return None
    sums = textbytes.prefix_hash(textbytes.byte_codes()[piece])
    _, down = textbytes.powers(len(piece))
    n = len(piece) - NAME + 1
    h = textbytes.mix((sums[NAME:] - sums[:-NAME]) * down[:n])
    place = np.arange(n, dtype=np.uint64)
    best = (least_within((h & ~PLACE) | place, REACH + 1) & PLACE).astype(np.int64)  # the first of equal hashes
    doc = np.searchsorted(offsets, np.arange(base, base + len(best)), "right") - 1
    p = np.flatnonzero(np.arange(base, base + len(best)) + WIDTH <= offsets[doc + 1])
    if not len(p):
        return None
    at = best[p]
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    # least hashes crowd together, so the name is a scramble of them
    return {"lo": p[first] + base, "hi": p[last] + base, "at": at[first] + base, "doc": doc[p[first]], "name": textbytes.mix(h[at[first]] ^ np.uint64(textbytes.ROOT))}


def _bucket(name: np.ndarray, bits: int) -> np.ndarray:
    return (name >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(name), np.int64)


def _short(name: np.ndarray, bits: int) -> np.ndarray:
    """32 bits of the name below those of its bucket."""
    return (name >> np.uint64(32 - bits)) & LOW


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def squeeze(body: bytes) -> bytes:
    """Zstandard behind the length; what is shuffled or written between the steps is mostly text."""
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def loosen(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], n, "zstd", asbytes=True) if n else b""


def _rising(keys: np.ndarray) -> np.ndarray:
    """Ascending 32-bit keys as the bytes of their steps, high bytes first: steps are small, so those are mostly zeros."""
    return np.diff(keys, prepend=np.zeros(1, keys.dtype)).astype(">u4").view(np.uint8).reshape(-1, 4).T


def _risen(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view(">u4").ravel(), dtype=np.uint32)


def _three(x: np.ndarray) -> list[np.ndarray]:
    """24-bit numbers as three arrays of bytes."""
    return [(x >> k & 0xFF).astype(np.uint8) for k in (16, 8, 0)]


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    n = len(blob) // sum(np.dtype(t).itemsize for t in types)
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(blob, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _cuts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(keys)))


def _few(batches, rows: int = 1000):
    """The batches in parts of so many rows, which bounds what a task unpacks at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


# --- 1. names


def _send_names(bits: int):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in textbytes.slices(batch.column(2), SLICE_ROWS, SLICE_BYTES):
                s = samples(data, offsets)
                if not len(s["at"]):
                    continue
                sums = textbytes.prefix_hash(textbytes.byte_codes()[data])
                _, down = textbytes.powers(len(data))
                side = lambda x, y: (textbytes.mix((sums[y] - sums[x]) * down[x] + (y - x).astype("<u8")) >> np.uint64(52)).astype(np.int64)
                left = side(np.maximum(s["at"] - HALF, offsets[s["doc"]]), s["at"])
                right = side(s["at"] + NAME, np.minimum(s["at"] + NAME + HALF, offsets[s["doc"] + 1]))
                both = left << 12 | right
                order = np.lexsort((s["doc"], both, s["name"]))
                name, doc, both = s["name"][order], s["doc"][order], both[order]
                start = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (both[1:] != both[:-1])]))
                length = np.diff(np.append(start, len(name)))
                end = start + length - 1
                many = doc[start] != doc[end]
                bucket = _bucket(name[start], bits)
                edges = np.searchsorted(bucket, np.arange(2**bits + 1))
                short = _short(name[start], bits).astype("<u4")
                # the documents of names that several texts of the slice share
                local = np.flatnonzero(np.repeat(many, length))
                keep = np.ones(len(local), bool)
                keep[1:] = (name[local][1:] != name[local][:-1]) | (doc[local][1:] != doc[local][:-1])
                local = local[keep]
                ledges = np.searchsorted(_bucket(name[local], bits), np.arange(2**bits + 1))
                lshort = _short(name[local], bits).astype("<u4")
                rows = []
                for k in np.flatnonzero(np.diff(edges)):
                    i, j = slice(edges[k], edges[k + 1]), slice(ledges[k], ledges[k + 1])
                    rows.append((int(k), number, squeeze(_pack(_rising(short[i]), (doc[start][i] | many[i].astype(np.int64) << 15).astype("<u2"), *_three(both[start][i]))), squeeze(_pack(lshort[j], doc[local][j].astype("<u2"))) if ledges[k + 1] > ledges[k] else b"", None))
                rows.append((int(rows[0][0]), number, b"", b"", squeeze(_pack(ids[a:b].astype("<i8"), prints[a:b].astype("<i8")))))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "slice", "names", "local", "docs"])

    return run


def _merge_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: which names lie in two documents, and which in very many slices. Answers go by slice."""
    queue, passed = RunQueue(NAMED), []
    for batch in batches:
        for r in batch.to_pylist():
            if r["docs"] is not None:
                yield _answer([(r["slice"], b"", b"", r["docs"])])
                continue
            body = loosen(r["names"])
            n = len(body) // 9
            short, doc = _risen(np.frombuffer(body, np.uint8, 4 * n)), np.frombuffer(body, "<u2", n, 4 * n)
            both = np.frombuffer(body, np.uint8, 3 * n, 6 * n).reshape(3, n).astype(np.int64)
            both = both[0] << 16 | both[1] << 8 | both[2]
            records = np.zeros(n, NAMED)
            records["key"], records["slice"], records["doc"], records["many"] = short, r["slice"], doc & 0x7FFF, doc >> 15
            records["left"], records["right"] = both >> 12, both & 0xFFF
            queue.push(records)
            if r["local"]:
                passed.append((r["slice"], r["local"]))
    bucket_answers = []
    for block in queue.blocks():
        # strings of two documents around one name agree in HALF bytes before or behind it
        shared = block["many"].copy()
        for edge in ("left", "right"):
            side = block["key"] << np.uint64(12) | block[edge]
            order = np.argsort(side, kind="stable")
            start, length = _cuts(side[order])
            shared[order] |= np.repeat(length > 1, length)
        out = block[shared]
        start, length = _cuts(out["key"])
        hot = np.repeat(length >= HOT, length)
        order = np.argsort(out["slice"], kind="stable")
        out, hot = out[order], hot[order]
        at, n = _cuts(out["slice"])
        bucket_answers += [(int(out["slice"][i]), _pack(out["key"][i : i + m].astype("<u4"), out["doc"][i : i + m], hot[i : i + m]), b"", None) for i, m in zip(at, n)]
        if len(bucket_answers) > 2000:
            yield _answer(bucket_answers)
            bucket_answers = []
    if bucket_answers:
        yield _answer(bucket_answers)
    for i in range(0, len(passed), 500):
        yield _answer([(s, b"", local, None) for s, local in passed[i : i + 500]])


def _answer(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["slice", "shared", "local", "docs"])


ANSWER = "slice long, shared binary, local binary, docs binary"


def _keyed_merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_merge_names with the bucket put before each name, squeezed again."""
    bucket = np.uint64(key[0].as_py())
    for answer in _merge_names(batches):
        cols = [answer.column(i).to_pylist() for i in range(4)]
        for i, blob in enumerate(cols[1]):
            if blob:
                short, doc, hot = _unpack(blob, "<u4", "<u4", "?")
                cols[1][i] = squeeze(_pack(short.astype("<u8") | bucket << np.uint64(32), doc.astype("<u2"), hot))
        for i, blob in enumerate(cols[2]):
            if blob:
                short, doc = _unpack(loosen(blob), "<u4", "<u2")
                cols[2][i] = squeeze(_pack(short.astype("<u8") | bucket << np.uint64(32), doc))
        yield _answer(list(zip(*cols)))


def _by_document(t: pa.Table) -> pa.Table:
    """The answers of one slice, dealt to its documents: names with the hot bit on top."""
    ids = prints = None
    names, docs, hots, lnames, ldocs = [], [], [], [], []
    for r in t.to_pylist():
        if r["docs"] is not None:
            ids, prints = _unpack(loosen(r["docs"]), "<i8", "<i8")
        if r["shared"]:
            n, d, h = _unpack(loosen(r["shared"]), "<u8", "<u2", "?")
            names.append(n), docs.append(d), hots.append(h)
        if r["local"]:
            n, d = _unpack(loosen(r["local"]), "<u8", "<u2")
            lnames.append(n), ldocs.append(d)
    out: list[tuple] = []
    if names:
        name, doc, hot = np.concatenate(names), np.concatenate(docs), np.concatenate(hots)
        order = np.argsort(name)
        name, doc, hot = name[order], doc[order], hot[order]
        if lnames:
            ln, ld = np.concatenate(lnames), np.concatenate(ldocs)
            i = np.minimum(np.searchsorted(name, ln), len(name) - 1)
            lh = hot[i]
            name, doc, hot = np.concatenate([name, ln]), np.concatenate([doc, ld]), np.concatenate([hot, lh])
        value = name | hot.astype("<u8") << np.uint64(63)
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[fresh], doc[fresh]
        at, n = _cuts(doc)
        out = [(int(ids[doc[i]]), int(prints[doc[i]]), squeeze(value[i : i + m].tobytes())) for i, m in zip(at, n)]
    cols = list(zip(*out)) or [(), (), ()]
    return pa.table([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "print", "shared"])


# --- 2. suffixes


def _spans_row(bucket: int, ids, prints, start, end) -> tuple:
    return (bucket, 0, _pack(np.asarray(ids, "<i8"), np.asarray(prints, "<i8"), np.asarray(start, "<i8"), np.asarray(end, "<i8")))


def _losers(ids: np.ndarray, groups: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True where a group (runs beginning at start) has a smaller id."""
    least = np.minimum.reduceat(ids, start)
    return ids > np.repeat(least, np.diff(np.append(start, len(groups))))


def _merged(doc, lo, hi):
    """Runs of neighbouring strings of one text as one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + WIDTH)
    start = np.flatnonzero(new)
    return (doc[start], lo[start], np.maximum.reduceat(hi, start)) if len(start) else (doc, lo, hi)


def _suffixes_out(r: np.ndarray, bits: int) -> bytes:
    """Suffix tuples of one bucket, by column, with their documents listed once."""
    r = r[np.argsort(_short(r["key"], bits), kind="stable")]
    docs, of = np.unique(r[["doc_id", "print"]], return_inverse=True)
    head = np.array([len(r), len(docs)], "<i8")
    return squeeze(_pack(head, docs["doc_id"].astype("<i8"), docs["print"].astype("<i8"), _rising(_short(r["key"], bits).astype("<u4")), of.astype("<u2"), r["at"].astype("<u4"), r["near"], r["far"], r["before"], r["behind"]))


def _suffixes_in(blob: bytes) -> np.ndarray:
    body = loosen(blob)
    n, m = np.frombuffer(body, "<i8", 2)
    at = 16

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    ids, prints = take("<i8", m), take("<i8", m)
    r = np.zeros(n, SUFFIX)
    r["key"] = _risen(take("u1", 4 * n))
    of = take("<u2", n)
    r["doc_id"], r["print"] = ids[of], prints[of]
    r["at"], r["near"], r["far"] = take("<u4", n), take("u1", n), take("u1", n)
    r["before"], r["behind"] = take("u1", REACH * n).reshape(n, REACH), take("u1", WIDTH * n).reshape(n, WIDTH)
    return r


def _send_suffixes(bits: int):
    def run(batches):
        for batch in _few(batches):
            ids = batch.column(0).to_numpy()
            prints = batch.column(1).to_numpy()
            texts = pa.array((loosen(x.as_py()) for x in batch.column("text")), pa.large_binary())
            for a, b, data, offsets in textbytes.slices(texts, SLICE_ROWS, SLICE_BYTES):
                s = samples(data, offsets)
                blobs = [np.frombuffer(loosen(x.as_py()), "<u8") for x in batch.column("shared").slice(a, b - a)]
                # names of each text, as (text, name) in one sorted array
                owner = np.repeat(np.arange(b - a), [len(x) for x in blobs])
                value = np.concatenate(blobs) if blobs else np.zeros(0, "<u8")
                plain = value & ~(np.uint64(1) << np.uint64(63))
                key = _bucket(s["name"], bits).astype("<u8") << np.uint64(32) | _short(s["name"], bits)
                # a text's names are few: look each up among all of the slice, then keep the pairs
                pair = textbytes.mix(key) + textbytes.mix(s["doc"].astype("<u8"))
                known = textbytes.mix(plain) + textbytes.mix(owner.astype("<u8"))
                order = np.argsort(known)
                i = np.minimum(np.searchsorted(known[order], pair), max(len(known) - 1, 0))
                hit = known[order][i] == pair if len(known) else np.zeros(len(pair), bool)
                hot = (value[order][i] >> np.uint64(63)).astype(bool) & hit if len(known) else hit
                rows = []
                sums = textbytes.prefix_hash(textbytes.byte_codes()[data])
                twin = textbytes.prefix_hash(textbytes.mix(textbytes.byte_codes())[data])
                _, down = textbytes.powers(len(data))
                lost = []
                doc_of, print_of = ids[a:b], prints[a:b]

                def settle(first, last, d, p, q):
                    """Of equal names the documents above the slice's least lose here; the rest travels."""
                    order = np.lexsort((doc_of[d], last, first))
                    first, last, d, p, q = first[order], last[order], d[order], p[order], q[order]
                    start = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])]))
                    out = _losers(doc_of[d], first, start)
                    lost.append((d[out], p[out], q[out]))
                    return order[~out]

                # names within reason travel with their bytes
                at = np.flatnonzero(hit & ~hot)
                if len(at):
                    lo, hi = s["lo"][at], s["hi"][at]
                    e = hi + WIDTH
                    stay = settle((sums[e] - sums[lo]) * down[lo] + (hi - lo).astype("<u8"), (twin[e] - twin[lo]) * down[lo] + (s["at"][at] - lo).astype("<u8"), s["doc"][at], lo, hi)
                    at = at[stay]
                    lo, hi, x, d = s["lo"][at], s["hi"][at], s["at"][at], s["doc"][at]
                    bucket = _bucket(s["name"][at], bits)
                    order = np.argsort(bucket, kind="stable")
                    lo, hi, x, d, at, bucket = lo[order], hi[order], x[order], d[order], at[order], bucket[order]
                    edges = np.searchsorted(bucket, np.arange(2**bits + 1))
                    for k in np.flatnonzero(np.diff(edges)):
                        j = slice(edges[k], edges[k + 1])
                        r = np.zeros(edges[k + 1] - edges[k], SUFFIX)
                        r["key"], r["doc_id"], r["print"], r["at"] = s["name"][at[j]], doc_of[d[j]], print_of[d[j]], x[j] - offsets[d[j]]
                        r["near"], r["far"] = x[j] - hi[j], x[j] - lo[j]
                        i = x[j][:, None] - 1 - np.arange(REACH)
                        r["before"] = np.where(i >= lo[j][:, None], data[np.maximum(i, 0)], 0)
                        i = x[j][:, None] + np.arange(WIDTH)
                        r["behind"] = np.where(i < hi[j][:, None] + WIDTH, data[np.minimum(i, len(data) - 1)], 0)
                        rows.append((int(k), 1, _suffixes_out(r, bits)))
                # strings around hot names travel by their own names
                at = np.flatnonzero(hot)
                if len(at):
                    n = s["hi"][at] - s["lo"][at] + 1
                    p = np.repeat(s["lo"][at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    d = np.repeat(s["doc"][at], n)
                    first = textbytes.mix((sums[p + WIDTH] - sums[p]) * down[p])
                    last = textbytes.mix((twin[p + WIDTH] - twin[p]) * down[p])
                    stay = settle(first, last, d, p, p)
                    first, last, p, d = first[stay], last[stay], p[stay], d[stay]
                    order = np.argsort(first)
                    r = np.zeros(len(order), STRING)
                    r["key"], r["more"], r["doc_id"], r["print"], r["at"] = first[order], last[order], doc_of[d[order]], print_of[d[order]], p[order] - offsets[d[order]]
                    edges = np.searchsorted(_bucket(r["key"], bits), np.arange(2**bits + 1))
                    rows += [(int(k), 2, squeeze(r[edges[k] : edges[k + 1]].tobytes())) for k in np.flatnonzero(np.diff(edges))]
                if any(len(x[0]) for x in lost):
                    d, lo, hi = _merged(*(np.concatenate(x) for x in zip(*lost)))
                    rows.append(_spans_row(int(a + len(rows)) % 2**bits, doc_of[d], print_of[d], lo - offsets[d], hi - offsets[d] + WIDTH))
                for i in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 64]), (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "body"])

    return run


def common_prefix(x: np.ndarray) -> np.ndarray:
    """Bytes that each row of a sorted matrix shares with the row before; 0 for the first."""
    out = np.zeros(len(x), np.int64)
    if len(x) > 1:
        differ = x[1:] != x[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return out


def _order(key: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The order by key, then bytes."""
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
    wide[:, : x.shape[1]] = x
    cols = wide.view(">u8").astype(np.uint64)
    return np.lexsort((*cols.T[::-1], key))


def induced(r: np.ndarray) -> np.ndarray:
    """For each suffix tuple and each distance o = 0..REACH before it: whether the string that starts there also lies in a smaller document. All tuples of a name are given."""
    m = len(r)
    lost = np.zeros((m, REACH + 1), bool)
    fo, bo = _order(r["key"], r["behind"]), _order(r["key"], r["before"])
    turn = lambda k: np.concatenate([[True], k[1:] != k[:-1]])
    flcp = np.where(turn(r["key"][fo]), -1, common_prefix(r["behind"][fo]))
    blcp = np.where(turn(r["key"][bo]), -1, common_prefix(r["before"][bo]))
    ids = r["doc_id"]
    for o in range(REACH + 1):
        at = np.flatnonzero((r["near"] <= o) & (o <= r["far"]))
        if not len(at):
            continue
        ahead, behind = np.empty(m, np.int64), np.empty(m, np.int64)
        ahead[fo] = np.cumsum(flcp < WIDTH - o)
        behind[bo] = np.cumsum(blcp < o)
        rank = behind[at] * (m + 1) + ahead[at]
        order = np.argsort(rank, kind="stable")
        start, _ = _cuts(rank[order])
        lost[at[order], o] = _losers(ids[at[order]], rank, start)
    return lost


SPANS = "doc_id long, print long, span long"


def _span_batch(ids, prints, start, end) -> pa.RecordBatch:
    """A span is one number, its start above its end."""
    span = np.asarray(start, np.int64) << 32 | np.asarray(end, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (ids, prints, span)], names=["doc_id", "print", "span"])


def _merge_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: the byte ranges of its strings that lie in a smaller document too."""
    suffixes, strings = RunQueue(SUFFIX), RunQueue(STRING)
    for batch in batches:
        for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist()):
            if kind == 0:
                yield _span_batch(*_unpack(body, "<i8", "<i8", "<i8", "<i8"))
            elif kind == 1:
                suffixes.push(_suffixes_in(body))
            else:
                strings.push(np.frombuffer(loosen(body), STRING))
    for r in suffixes.blocks():
        lost = induced(r)
        edge = np.diff(np.pad(lost, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, near = np.nonzero(edge == 1)
        _, past = np.nonzero(edge == -1)
        if len(i):
            yield _span_batch(r["doc_id"][i], r["print"][i], r["at"][i] - past + 1, r["at"][i] - near + WIDTH)
    for r in strings.blocks():
        r = r[np.lexsort((r["more"], r["key"]))]
        start = np.flatnonzero(np.concatenate([[True], (r["key"][1:] != r["key"][:-1]) | (r["more"][1:] != r["more"][:-1])]))
        out = r[_losers(r["doc_id"], r, start)]
        out = out[np.lexsort((out["at"], out["print"], out["doc_id"]))]
        if len(out):
            new = np.concatenate([[True], (out["doc_id"][1:] != out["doc_id"][:-1]) | (out["print"][1:] != out["print"][:-1]) | (out["at"][1:] > out["at"][:-1] + WIDTH)])
            s = np.flatnonzero(new)
            yield _span_batch(out["doc_id"][s], out["print"][s], out["at"][s], np.maximum.reduceat(out["at"], s) + WIDTH)


# --- 3. spans


def base_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, print (xxhash64 of the text), the squeezed text and docs' other columns in _row, of rows that have an id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("print"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_row"))
    return squeezed(rows, "text").where("doc_id IS NOT NULL AND print IS NOT NULL")


def repeated_spans(docs: DataFrame, base: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, print and spans (byte ranges to remove, unsorted and overlapping) of each document that has any.

    base meets the names here and the spans later; both joins have the same keys and need all of its columns, so that Spark shuffles the texts once."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("print"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND octet_length(text) >= " + str(WIDTH))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one row
    bits = max(3, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length(), (total // BUCKET_BYTES).bit_length())
    sent = docs.mapInArrow(_send_names(bits), "bucket int, slice long, names binary, local binary, docs binary")
    answers = sent.groupBy("bucket").applyInArrow(_keyed_merge, ANSWER)
    shared = written(answers.groupBy("slice").applyInArrow(_by_document, "doc_id long, print long, shared binary").dropDuplicates(["doc_id", "print", "shared"]))
    again = base.join(shared.hint("merge"), ["doc_id", "print"])
    parts = again.mapInArrow(_send_suffixes(bits), "bucket int, kind int, body binary").groupBy("bucket").applyInArrow(_merge_suffixes, SPANS)
    return parts.groupBy("doc_id", "print").agg(F.collect_list("span").alias("spans"))  # bounded by the text's length


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' other columns in _row, the squeezed text in _text and the spans of their document, or null."""
    base = base_of(docs, doc_id, text)
    spans = repeated_spans(docs, base, doc_id, text).select(F.col("doc_id").alias("_i"), F.col("print").alias("_p"), "spans").hint("merge")
    out = base.join(spans, (F.col("doc_id") == F.col("_i")) & (F.col("print") == F.col("_p")), "left").select("_row", F.col("text").alias("_text"), "spans")
    nobody = docs.where(F.col(doc_id).cast("long").isNull())
    nobody = squeezed(nobody.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_row"), F.col(text).alias("_text")), "_text")
    return out.unionByName(nobody.withColumn("spans", F.lit(None).cast("array<long>")))


def squeezed(docs: DataFrame, text: str) -> DataFrame:
    """docs with the text column as squeezed bytes, for a shuffle."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in _few(batches):
            cols = [*batch.columns]
            cols[at] = pa.array((None if (t := x.as_py()) is None else squeeze(t.encode("utf-8")) for x in cols[at]), pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    schema = StructType([StructField(f.name, BinaryType() if i == at else f.dataType) for i, f in enumerate(docs.schema)])
    return docs.mapInArrow(run, schema)


def union_spans(spans: list[int] | None) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for span in sorted(spans or ()):
        start, end = span >> 32, span & 0xFFFFFFFF
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def cut(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of body."""
    at, parts = 0, []
    for s, e in spans:
        parts.append(body[at:s])
        at = e
    return b"".join([*parts, body[at:]])


def whole_characters(body: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they hold in part."""
    inside = lambda i: i < len(body) and body[i] & 0xC0 == 0x80
    out = []
    for s, e in spans:
        while s < e and inside(s):
            s += 1
        while e > s and inside(e):
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def _digest(batches):
    for batch in _few(batches):
        out = []
        for d, t, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            body = loosen(t.as_py() or bytes(8))
            u = union_spans(spans)
            out.append((d, len(body), sum(e - s for s, e in u), len(u), hashlib.sha256(cut(body, u)).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _clean(batches):
    for batch in _few(batches):
        texts = []
        for t, spans in zip(batch.column(0), batch.column(1).to_pylist()):
            if (t := t.as_py()) is not None:
                body = loosen(t)
                t = cut(body, whole_characters(body, union_spans(spans))).decode("utf-8")
            texts.append(t)
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())], names=[*batch.schema.names[2:], "_clean"])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated passages cut from the texts (whole characters only), in docs' own columns. Every row stays."""
    df = joined(docs, doc_id, text).select("_text", "spans", "_row")
    out = df.mapInArrow(_clean, StructType([df.schema["_row"], StructField("_clean", StringType())]))
    return out.select(*[F.col("_clean").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with what is left of it without the 50-byte strings of smaller documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = joined(docs).select("_row.doc_id", "_text", "spans")
    return df.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
