"""Near-duplicate documents by MinHash over word shingles.

Sketch: fast similarity sketching. In round i every shingle is hashed to one of the bins with a
value that starts with i; a bin keeps its least value, so the first rounds fill most bins. Rounds
T to 2T-1 send every shingle to the one bin of that round, so every coordinate fills, whatever the
size of the set. Two sets agree in a coordinate with a probability that concentrates around their
Jaccard similarity as for independent hashes.

Bands of 6 coordinates, 42 of them, propose pairs: a pair at similarity 0.8 is missed with
probability (1 - 0.8**6)**42, 3 in a million. Documents with equal sets are one class beforehand.
In a bucket, members are first confirmed against two pivots: the member whose buckets are largest,
which in a group of near copies is the one with the fewest changes, and a random one. That joins
large groups with twice as many pairs as members. Where a bucket then still holds several
components, its members are compared across them by their sketches, in blocks; pairs whose sketches
agree in too few coordinates for the similarity (the bound leaves out 3 in a million of the pairs at
0.8) are never made, and the others are confirmed. All links are confirmed on full sets.

Defined cases: a null or wordless text has an empty set, links with nothing and is kept; rows with
equal ids are one document, linked by the sets of any of them; rows with a null id are kept, with
a null component; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import confirm, textbytes
from quernstone.llm.components import components
from quernstone.sources.tables import forget, table, written

BANDS, ROWS = 42, 6
BINS = BANDS * ROWS
EMPTY = np.uint64(2**64 - 1)
SMALL, BLOCK = 64, 1000
SLICE_BYTES = 1_500_000  # of texts that are hashed at once; hashing takes some 60 bytes for each
#: Pairs of one pivot that a copy of its set serves.
PER_COPY = 256


def sketch(x: np.ndarray, edges: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of bin values for each set x[edges[i]:edges[i + 1]]; rows of empty sets stay EMPTY."""
    n = len(edges) - 1
    out = np.full((n, bins), EMPTY, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(edges))
    for i in range(2 * bins):
        if not len(x):
            break
        y = textbytes.mix(x ^ np.uint64((i + 1) * textbytes.ROOT & 2**64 - 1))
        if i < bins:
            b = ((y >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        else:
            b = np.full(len(x), i - bins)
        at = owner * bins + b
        free = flat[at] == EMPTY
        np.minimum.at(flat, at[free], np.uint64(i << 32) | (y[free] & np.uint64(0xFFFFFFFF)))
        open_rows = (out == EMPTY).any(axis=1)
        if not open_rows.all():
            stay = open_rows[owner]
            x, owner = x[stay], owner[stay]
    return out


def band_hashes(sk: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band of each row."""
    s = sk.reshape(len(sk), BANDS, ROWS)
    h = np.zeros((len(sk), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = textbytes.mix(h * np.uint64(textbytes.ROOT) + s[:, :, i])
    return h.view(np.int64)


def _sketched(width: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in textbytes.slices(batch.column(1), most_bytes=SLICE_BYTES):
                x, edges = textbytes.shingle_sets(data, offsets, width)
                size = np.diff(edges)
                prints = [hashlib.md5(x[s:e].tobytes()).digest() if e > s else None for s, e in zip(edges[:-1], edges[1:])]
                sk = sketch(x, edges)
                bands = band_hashes(sk).reshape(-1)
                digest = [row.tobytes() if n else None for row, n in zip(textbytes.mix(sk).astype(np.uint8), size)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32)), pa.array(bands))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(prints, pa.binary()), lists, pa.array(digest, pa.binary())], names=["doc_id", "n_shingles", "print", "bands", "digest"])

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in textbytes.slices(batch.column(1), most_bytes=SLICE_BYTES):
                x, edges = textbytes.shingle_sets(data, offsets, width)
                lists = pa.LargeListArray.from_arrays(pa.array(edges.astype(np.int64)), pa.array(x.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), lists], names=["doc_id", "shingles"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity, however many pairs one document has on either side."""
    return confirm.confirmed(pairs, sets, percent, PER_COPY)


def least_agreement(percent: int) -> int:
    """Coordinates in which two sketches at the similarity agree, less 4.5 standard deviations."""
    p = percent / 100
    return math.ceil(BINS * p - 4.5 * math.sqrt(BINS * p * (1 - p)))


def _crossing(least: int, percent: int, verify: bool):
    """A task's function over rows sorted by (bucket, i, j): pairs of different components whose sketches agree often enough, each in the first bucket that both share. verify: only those that the full sets confirm, and none that an earlier one of the same rows has made needless."""

    def pairs_of(rows: pa.Table):
        ids, comp, blk = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "component", "blk"))
        comp = comp.copy()
        sk = np.frombuffer(b"".join(rows.column("digest").to_pylist()), np.uint8).reshape(-1, BINS)
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        if verify:  # views of one array, no lists
            lists = rows.column("shingles").combine_chunks()
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            sets = [values[s:e] for s, e in zip(ends[:-1], ends[1:])]
        i, j, bucket = (rows.column(c)[0].as_py() for c in ("i", "j", "bucket"))
        band = int(np.flatnonzero(bands[0] == bucket)[0])
        right = np.flatnonzero(blk == j)
        for k in np.flatnonzero(blk == i):
            other = right[(comp[right] != comp[k]) & ((ids[right] > ids[k]) if i == j else True)]
            other = other[(sk[other] == sk[k]).sum(axis=1) >= least]
            other = other[(bands[other] == bands[k]).argmax(axis=1) == band]
            if verify:
                found = []
                for o in other.tolist():
                    if comp[o] != comp[k]:
                        common = len(np.intersect1d(sets[k], sets[o], assume_unique=True))
                        if 100 * common >= percent * (len(sets[k]) + len(sets[o]) - common):
                            found.append(o)
                            comp[comp == comp[o]] = comp[k]
                other = np.array(found, np.int64)
            if len(other):
                yield np.minimum(ids[k], ids[other]), np.maximum(ids[k], ids[other])

    def groups(batches):
        """Tables of one group each; a group may span batches."""
        held: list[pa.Table] = []
        key = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            keys = [t.column(c).to_numpy() for c in ("bucket", "i", "j")]
            edges = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0), [True]]))
            for s, e in zip(edges[:-1], edges[1:]):
                now = tuple(k[s] for k in keys)
                if key is not None and now != key:
                    yield pa.concat_tables(held)
                    held = []
                key = now
                held.append(t.slice(s, e - s))
        if held:
            yield pa.concat_tables(held)

    def run(batches):
        for rows in groups(batches):
            if rows.num_rows > 1 and (found := list(pairs_of(rows))):
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def crossing(members: DataFrame, label: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of bucket members that lie in different components: plausible ones of buckets of at most SMALL members, and confirmed ones of larger buckets, which go out in pairs of blocks of BLOCK rows with their sets."""
    least = least_agreement(percent)
    m = members.select("bucket", "doc_id").join(label.select(F.col("node").alias("doc_id"), "component").hint("merge"), "doc_id", "left")
    m = m.withColumn("component", F.coalesce("component", "doc_id"))
    mixed = m.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    m = m.join(mixed.select("bucket", "n"), "bucket").join(marks.hint("merge"), "doc_id")
    m = written(m.where(F.array_contains("bands", F.col("bucket"))))  # an id may have other texts, which are not in the bucket
    keys = ["bucket", "i", "j"]
    out = []
    for large in (False, True):
        part = m.where(F.col("n") > SMALL if large else F.col("n") <= SMALL)
        part = part.withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int"))
        part = part.withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
        if large:
            part = part.join(sets.hint("merge"), "doc_id")
        part = part.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        part = part.select("bucket", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "doc_id", "component", "digest", "bands", *["shingles"] * large)
        part = part.repartition(*keys).sortWithinPartitions(*keys)
        out.append(written(part.mapInArrow(_crossing(least, percent, large), "a long, b long").distinct()))
    forget(m)
    return out[0], out[1]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = written(docs.mapInArrow(_sketched(width), "doc_id long, n_shingles long, print binary, bands array<long>, digest binary"))
    ided = marks.where("doc_id IS NOT NULL AND print IS NOT NULL")
    # classes of equal sets
    copies = written(ided.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select(F.col("print").alias("p"), "rep"))
    reps = ided.join(copies, F.col("print") == F.col("p"), "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    split_ids = ided.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x <> y").select("doc_id")
    same_id = reps.join(split_ids, "doc_id", "left_semi").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # members of buckets that hold two or more classes
    rows = reps.where("doc_id = rep").select("doc_id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", "n")
    members = written(rows.join(shared.hint("merge"), "bucket").distinct())
    # only texts in such buckets are hashed again, once
    ids = members.select("doc_id").distinct()
    needed = docs.join(ids.hint("merge"), "doc_id", "left_semi")
    digests = reps.where("doc_id = rep").select("doc_id", "digest", "bands")
    if not ided.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows with one id and one text count once
        needed, digests = needed.dropDuplicates(["doc_id", "text"]), digests.distinct()
    sets = written(needed.mapInArrow(_sets(width), "doc_id long, shingles array<long>"))
    mass = members.groupBy("doc_id").agg(F.sum("n").alias("mass"))
    weighed = members.join(mass.hint("merge"), "doc_id")
    pivots = weighed.groupBy("bucket").agg(F.min(F.struct(-F.col("mass"), F.col("doc_id").alias("p"))).alias("s"), F.min(F.struct(F.xxhash64("doc_id"), F.col("doc_id").alias("p"))).alias("r"))
    pairs = members.join(pivots.select("bucket", F.explode(F.array("s.p", "r.p")).alias("p")).hint("merge"), "bucket").where("doc_id <> p")
    pairs = written(pairs.select(F.least("doc_id", "p").alias("a"), F.greatest("doc_id", "p").alias("b")).distinct())
    edges = same_id.unionByName(confirmed(pairs, sets, percent))
    label = components(edges)
    plausible, linked = crossing(members, label, digests, sets, percent)
    more = plausible.join(pairs.hint("merge"), ["a", "b"], "left_anti")
    label = components(edges.unionByName(linked).unionByName(confirmed(written(more), sets, percent)))
    for done in (members, sets, pairs):
        forget(done)
    out = marks.select("doc_id", "n_shingles", "print").join(copies, F.col("print") == F.col("p"), "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that are not the first of their group, with docs' own columns.

    Rows with equal id and text are one document, of which the row stays that is least by its fields as JSON. Rows with one id and different texts are
    documents of their own here, each kept or dropped by its own text, so that none is lost with the other; rows with a
    null id stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).cast("long").alias("_i"), F.col(text).alias("_t"), F.xxhash64(F.col(text)).alias("_h"))
    ided = rows.where("_i IS NOT NULL")
    ids = ided.groupBy("_i").agg(F.count("*").alias("n"), F.min("_h").alias("x"), F.max("_h").alias("y")).where("n > 1")
    ids = written(ids.select("_i", (F.col("x") != F.col("y")).alias("split")))
    repeated = not ids.isEmpty()
    if repeated and not ids.where("split").isEmpty():
        # numbers that rise with id and text: range partitions in order
        numbers = written(ided.select("_i", "_h").distinct().repartitionByRange("_i", "_h").sortWithinPartitions("_i", "_h").withColumn("_n", F.monotonically_increasing_id()))
        rows = rows.join(numbers.hint("merge"), ["_i", "_h"], "left")
    else:
        rows = rows.withColumn("_n", F.col("_i"))
    out = near_duplicates(rows.where("_n IS NOT NULL"), width, percent, "_n", "_t")
    dropped = written(out.where("NOT kept").select(F.col("doc_id").alias("_n")).distinct())
    kept = rows.join(dropped, "_n", "left_anti").select("_row", "_i", "_t")
    if repeated:
        twice = kept.join(ids.select("_i"), "_i", "left_semi")
        # of rows with equal id and text the least as a whole stays, by its fields as JSON, so that reruns agree
        one = twice.groupBy("_i", "_t").agg(F.min_by("_row", F.to_json("_row", {"ignoreNullFields": "false"})).alias("_row"))
        kept = kept.join(ids.select("_i"), "_i", "left_anti").select("_row", "_i", "_t").unionByName(one.select("_row", "_i", "_t"))
    return kept.select("_row.*")


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Every document with the component of near copies (4-word shingles, similarity 0.8) that it lies in."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
