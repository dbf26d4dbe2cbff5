"""Jaccard join of documents over word shingles, by adaptive multi-match prefixes.

All shingles have one order, rarest first. If two sets reach the similarity, the first l shingles that
they share lie among the first |set| - ceil(similarity * |set|) + l of each: its l-prefix. Each document
chooses its own l by the estimated cost of the candidates that its prefix would propose: a longer prefix
reads more postings, and a partner must be met l times before its set is shipped. A pair whose documents
chose l and m must share min(l, m) shingles of the prefixes, as prefixes of one document are nested.

Rarity is the count of a shingle's hash bucket, from BUCKETS counts over all documents, whatever their number.
It decides order and cost alone; results do not depend on it.

What keeps groups from growing into pairs:
- documents with equal sets are one class beforehand;
- a shingle that no other class's prefix holds is dead. Postings that come after so many dead shingles of their document
  that it cannot reach the similarity with any partner there go; so do pairs that cannot;
- the members of a posting list meet two pivots first, the member with the largest lists and a random one.
  Pairs inside a component that this has found are never made; those that cross components are, in blocks, unless
  their signatures (parities of 1,024 groups of shingles) differ in more bits than the sets may in shingles.
All links are confirmed on full sets of 64-bit shingle hashes.

Defined cases: a null or wordless text has an empty set and links with nothing; rows with equal ids are one document,
linked by the sets of any of them; rows with a null id have a null component; repeated rows share theirs; an empty table
gives an empty result. Texts are read whole. Other columns of the input do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm import textbytes
from quernstone.llm.components import components
from quernstone.llm.confirm import confirmed_texts
from quernstone.llm.neardup import SLICE_BYTES
from quernstone.sources.tables import forget, table, written

BITS = 18
BUCKETS = 1 << BITS
#: Largest number of matches that a prefix may ask for.
MOST = 8
#: Members of a posting list in one block.
BLOCK = 1000
#: 64-bit words of a set's signature.
SIGN = 16
#: Documents in pairs up to which a bitmap of their ids picks the texts; beyond, a join does.
MOST_IDS, ID_BITS = 1 << 21, 24
#: Members of a list that counts as short.
SHORT = 16
#: Cost of a posting and of a probe, in shipped shingles of a set.
POSTING, PROBE = 3, 2


def _marked(width: int):
    """doc_id, n_shingles and print of each text; the last row of a task holds the counts of its shingles' buckets."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in textbytes.slices(batch.column(1), most_bytes=SLICE_BYTES):
                x, edges = textbytes.shingle_sets(data, offsets, width)
                counts += np.bincount((x >> np.uint64(64 - BITS)).astype(np.int64), minlength=BUCKETS)
                prints = [hashlib.md5(x[s:e].tobytes()).digest() if e > s else None for s, e in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(edges).astype(np.int64)), pa.array(prints, pa.binary()), pa.nulls(b - a, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts])], names=["doc_id", "n_shingles", "print", "counts"])

    return run


def chosen(rarity: np.ndarray, edges: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of matches and the prefix length that each set takes, from its shingles' estimated numbers of partners in global order."""
    n = np.diff(edges)
    spare = n + -percent * n // 100  # n - ceil(percent * n / 100)
    sums = np.concatenate([[0], np.cumsum(rarity)])
    best, matches = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for m in range(1, MOST + 1):
        size = np.minimum(spare + m, n)
        probes = sums[edges[:-1] + size] - sums[edges[:-1]]
        cost = POSTING * size + PROBE * probes + n * probes / m
        better = (cost < best) & (m <= np.maximum(n - spare, 1))
        best[better], matches[better] = cost[better], m
    return matches, np.minimum(spare + matches, n)


def signatures(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """SIGN words for each set: bit i is the parity of its shingles whose hash ends in i. Two signatures differ in at most as many bits as the sets in shingles."""
    out = np.zeros((len(edges) - 1, SIGN), np.uint64)
    wide = 64 * SIGN
    for a in range(0, len(out), 1000):
        b = min(a + 1000, len(out))
        owner = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1]))
        odd = np.bincount(owner * wide + (x[edges[a] : edges[b]] & np.uint64(wide - 1)).astype(np.int64), minlength=(b - a) * wide) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8).reshape(b - a, wide), axis=1).view(np.uint64)
    return out


def _prefixed(width: int, percent: int, counts: np.ndarray):
    """doc_id, print, n, matches, prefix and signature of each text with words."""
    usual = np.median(counts[counts > 0]) if counts.any() else 0

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in textbytes.slices(batch.column(1), most_bytes=SLICE_BYTES):
                x, edges = textbytes.shingle_sets(data, offsets, width)
                n = np.diff(edges)
                prints = [hashlib.md5(x[s:e].tobytes()).digest() for s, e in zip(edges[:-1], edges[1:])]
                seen = counts[(x >> np.uint64(64 - BITS)).astype(np.int64)]
                order = np.lexsort((x, seen, np.repeat(np.arange(len(n)), n)))
                matches, size = chosen(np.maximum(seen[order].astype(float) - usual, 0), edges, percent)
                ends = np.concatenate([[0], np.cumsum(size)])
                flat = x[order][np.arange(ends[-1]) + np.repeat(edges[:-1] - ends[:-1], size)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                out = pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(prints, pa.binary()), pa.array(n.astype(np.int32)), pa.array(matches.astype(np.int32)), lists, pa.FixedSizeListArray.from_arrays(pa.array(signatures(x, edges).view(np.int64).reshape(-1)), SIGN).cast(pa.list_(pa.int64()))], names=["doc_id", "print", "n", "matches", "prefix", "sign"])
                yield out.filter(pa.array(n > 0))

    return run


def _fits(percent: int, n: Column, m: Column, most: Column) -> Column:
    """Sets of n and m shingles of which at most ``most`` are shared can reach the similarity."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _alike(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures allow the similarity."""
    for side in "ab":
        pairs = pairs.join(signs.select(F.col("doc").alias(side), F.col("n").alias(f"{side}_n"), F.col("sign").alias(f"{side}_sign")).hint("merge"), side)
    return pairs.where(_allowed(percent)).select("a", "b").distinct()


def _allowed(percent: int) -> Column:
    """Signatures differ in no more bits than sets of these sizes and the similarity may in shingles."""
    differ = sum((F.bit_count(F.get("a_sign", F.lit(i)).bitwiseXOR(F.get("b_sign", F.lit(i)))) for i in range(SIGN)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col("a_n") + F.col("b_n"))


def _pivot_pairs(posts: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of list members and pivots that meet often enough."""
    mass = posts.groupBy("doc").agg(F.sum("df").alias("mass"))
    weighed = posts.join(mass.hint("merge"), "doc")
    member = F.struct(F.col("doc").alias("p"), F.col("n").alias("pn"), F.col("matches").alias("pm"), F.col("live").alias("pl"))
    two = weighed.groupBy("token").agg(F.min(F.struct(-F.col("mass"), member.alias("m"))).alias("s"), F.min(F.struct(F.xxhash64("doc"), member.alias("m"))).alias("r"))
    met = posts.join(two.select("token", F.explode(F.array_distinct(F.array("s.m", "r.m"))).alias("q")).hint("merge"), "token").where("doc <> q.p")
    met = met.where(_fits(percent, F.col("n"), F.col("q.pn"), F.least("live", "q.pl")))
    met = met.groupBy("doc", "q.p").agg(F.count("*").alias("shared"), F.min(F.least("matches", "q.pm")).alias("needed")).where("shared >= needed")
    return _alike(met.select(F.least("doc", "p").alias("a"), F.greatest("doc", "p").alias("b")).distinct(), signs, percent)


def _crossing_pairs(posts: DataFrame, signs: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet often enough. Long lists carry the signatures into the join, so that it gives no pair that they exclude; pairs of short lists, of which a posting has few, are held against them afterwards."""
    m = posts.join(label.select(F.col("node").alias("doc"), "component").hint("merge"), "doc", "left")
    m = m.withColumn("component", F.coalesce("component", "doc"))
    mixed = m.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k")).where("lo <> hi")
    m = written(m.join(mixed.select("token", "k"), "token"))
    columns = ["doc", "component", "n", "matches", "live", "pos"]
    # what a pair can share at most: what comes before this shingle in both, and what follows it
    at_most = F.least("a_pos", "b_pos") + F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    fits = (F.col("a_doc") < F.col("b_doc")) & (F.col("a_component") != F.col("b_component")) & _fits(percent, F.col("a_n"), F.col("b_n"), F.least("a_live", "b_live", at_most))
    pair = [F.col("a_doc").alias("a"), F.col("b_doc").alias("b"), F.least("a_matches", "b_matches").alias("needed")]
    side = lambda df, s, more: df.select("token", *more, *[F.col(c).alias(f"{s}_{c}") for c in columns])
    short = m.where(F.col("k") <= SHORT)
    met = side(short, "a", []).hint("merge").join(side(short, "b", []), "token").where(fits).select(*pair)
    long = m.where(F.col("k") > SHORT).join(signs.drop("n").hint("merge"), ["doc", "h"])
    columns = [*columns, "sign"]
    long = long.withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    right = side(long, "b", [F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")])
    met = met.unionByName(side(long, "a", ["block"]).hint("merge").join(right, ["token", "block"]).where(fits & _allowed(percent)).select(*pair))
    met = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("needed").alias("needed")).where("shared >= needed")
    out = written(_alike(met.select("a", "b"), signs, percent))
    forget(m)
    return out


def _bucket_counts(marks: DataFrame) -> np.ndarray:
    """The summed counts of all tasks: BUCKETS numbers."""
    some = marks.where("counts IS NOT NULL").select(F.posexplode("counts").alias("i", "c")).where("c > 0").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[some.column("i").to_numpy()] = some.column("c").to_numpy()
    return counts


def _live_postings(prefixes: DataFrame, percent: int, repeated: bool) -> DataFrame:
    """token, doc, h, pos, n, matches, live and df of the prefix shingles that two or more documents hold in their prefixes.

    live is what the document can share with any other that holds this shingle in its prefix: all its shingles but the dead ones before it. (A partner's
    prefix reaches at least up to this shingle, so it would hold them, too.) Postings at which that is too little for the similarity go."""
    posts = prefixes.select("doc", "h", F.posexplode("prefix").alias("pos", "token"))
    lists = posts.groupBy("token")
    if repeated:  # one id may hold a shingle in two of its sets
        lists = lists.agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("df")).where("lo <> hi")
    else:  # less to shuffle: nearly every shingle is one row of this
        lists = lists.agg(F.count("*").alias("df")).where("df > 1")
    met = posts.join(lists.select("token", "df").hint("merge"), "token")
    before = F.row_number().over(Window.partitionBy("doc", "h").orderBy("pos")) - 1
    met = met.withColumn("dead", F.col("pos") - before).join(prefixes.select("doc", "h", "n", "matches").hint("merge"), ["doc", "h"])
    met = met.withColumn("live", F.col("n") - F.col("dead")).where(100 * F.col("live") >= percent * F.col("n"))
    return written(met.select("token", "doc", "h", "pos", "n", "matches", "live", "df"))


def _id_bits(ids: np.ndarray) -> np.ndarray:
    return (textbytes.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - ID_BITS)).astype(np.int64)


def _bits_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of at most MOST_IDS ids, 2 ** ID_BITS bits."""
    out = np.zeros(1 << ID_BITS, bool)
    out[_id_bits(ids.toArrow().column("doc_id").to_numpy())] = True
    return np.packbits(out)


def _some_texts(passed: np.ndarray):
    """The rows of doc_id and text whose ids are in the bitmap."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = _id_bits(batch.column(0).to_numpy())
                yield batch.filter(pa.array((passed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))

    return run


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    both = written(docs.mapInArrow(_marked(width), "doc_id long, n_shingles long, print binary, counts array<long>"))
    counts = _bucket_counts(both)
    marks = both.where("counts IS NULL").drop("counts")
    ided = marks.where("doc_id IS NOT NULL AND print IS NOT NULL")
    # classes of equal sets
    copies = written(ided.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1").select(F.col("print").alias("p"), "rep"))
    reps = ided.join(copies, F.col("print") == F.col("p"), "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    split_ids = ided.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x <> y").select("doc_id")
    same_id = reps.join(split_ids, "doc_id", "left_semi").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    others = reps.where("doc_id <> rep").select("doc_id", "print")
    prefixes = docs.where("doc_id IS NOT NULL").mapInArrow(_prefixed(width, percent, counts), "doc_id long, print binary, n int, matches int, prefix array<long>, sign array<long>")
    prefixes = prefixes.join(others, ["doc_id", "print"], "left_anti")
    repeated = not ided.groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:  # rows with one id and one set count once
        prefixes = prefixes.dropDuplicates(["doc_id", "print"])
    mark = F.xxhash64("print") if repeated else F.lit(0).cast("long")  # tells the sets of one id apart; a constant takes no room in the shuffles
    prefixes = written(prefixes.select(F.col("doc_id").alias("doc"), mark.alias("h"), "n", "matches", "prefix", "sign"))
    posts, signs = _live_postings(prefixes, percent, repeated), prefixes.select("doc", "h", "n", "sign")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that the full sets confirm; only texts of documents in pairs travel for that."""
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        some = docs.where("doc_id IS NOT NULL")
        if ids.count() <= MOST_IDS:  # some texts more than these pass the bitmap; they meet no pair
            some = some.mapInArrow(_some_texts(_bits_of(ids)), "doc_id long, text string")
        else:
            some = some.join(ids, "doc_id", "left_semi")
        texts = written(some.dropDuplicates(["doc_id", "text"]) if repeated else some)
        out = confirmed_texts(pairs, texts, width, percent, SLICE_BYTES)
        for done in (ids, texts):
            forget(done)
        return out

    pairs = written(_pivot_pairs(posts, signs, percent))
    edges = same_id.unionByName(linked(pairs))
    label = components(edges)
    more = written(_crossing_pairs(posts, signs, label, percent).join(pairs.hint("merge"), ["a", "b"], "left_anti"))
    label = components(edges.unionByName(linked(more)))
    for done in (prefixes, posts, pairs, more):
        forget(done)
    out = marks.join(copies, F.col("print") == F.col("p"), "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def op13_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document with the component of the join (3-word shingles, similarity 0.9) that it lies in."""
    return jaccard_groups(table(spark, sf_dir, "documents"), width=3, percent=90)
