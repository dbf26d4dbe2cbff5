"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad. A line's features describe it and its neighbours; a
transition weight says how much neighbouring lines agree. Forward-backward gives each line's
probability of being good, and their mean, weighted by the lines' bytes, is the document's quality,
calibrated by a logistic curve on the training documents.

Training lines carry their document's label, so the transition weight learns only how far neighbours agree; that all
lines of a document agree in training is a limit of the labels. The model is fitted on the driver on a bounded sample:
the FIT_DOCS labelled documents with the least md5 of their id, whose features come back as numbers
for at most FIT_LINES lines a document (a document with more is left out of the sample). Scores use
whole texts, and nothing but the text.

Defined cases: a null, empty or wordless text has the training documents' share of label 1 as its
score; null labels and labels without a document teach nothing; repeated label rows count once;
without any usable label every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import textbytes
from quernstone.sources.tables import table

FIT_DOCS, FIT_LINES, STEPS = 3000, 400, 150
FOLDS, CUT = 5, 0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>@\\^~{}[]=+_")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SHOUT = np.zeros(256, bool)
SHOUT[[33, 63]] = True
STOP = np.zeros(256, bool)
STOP[list(b".,;:!?")] = True
OWN = ("bias", "length", "words", "word_length", "symbols", "upper", "digits", "shouts", "stops", "ends", "capital", "repeated", "same_word", "same_line")
NEIGHBOURS = ("symbols", "upper", "shouts", "repeated", "word_length", "same_word")
N_FEATURES = len(OWN) + 2 * len(NEIGHBOURS) + 2


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (a row for each line with a word), the lines' bytes and text numbers."""
    starts, ends, doc = textbytes.words(data, offsets)
    if not len(starts):
        return np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0, np.int64)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line_key = breaks[starts] + doc  # breaks never fall from text to text, so a text's end counts as one
    new = np.ones(len(starts), bool)
    new[1:] = (line_key[1:] != line_key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    owner, a, b = doc[first], starts[first], ends[last]
    n_words = (last - first + 1).astype(float)
    size = (b - a).astype(float)

    def share(mask, of):
        total = np.concatenate([[0], np.cumsum(mask[data])])
        return (total[b] - total[a]) / of

    h = textbytes.word_hashes(data, starts, ends)
    k = max(len(h) - 2, 0)
    tri = textbytes.mix(h[:k] * np.uint64(3) + textbytes.mix(h[1 : k + 1]) * np.uint64(5) + textbytes.mix(h[2 : k + 2] + np.uint64(7)))
    tri = textbytes.mix(tri + doc[:k].astype(np.uint64) * np.uint64(textbytes.ROOT)) if k else tri
    _, inverse, count = np.unique(tri, return_inverse=True, return_counts=True)
    repeated = np.zeros(len(h))
    repeated[:k] = (count[inverse] > 1) & (doc[:k] == doc[2 : k + 2])
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    per_line = lambda v: np.add.reduceat(v, first) / n_words
    sums = textbytes.prefix_hash(textbytes.byte_codes()[data])
    _, down = textbytes.powers(len(data))
    text = textbytes.mix((sums[b] - sums[a]) * down[a] + owner.astype(np.uint64) * np.uint64(textbytes.ROOT))
    _, inverse, count = np.unique(text, return_inverse=True, return_counts=True)
    own = {
        "bias": np.ones(len(a)), "length": np.log1p(size) / 6, "words": np.log1p(n_words) / 4, "word_length": np.minimum(np.add.reduceat((ends - starts).astype(float), first) / n_words, 20) / 10 - 0.5,
        "symbols": np.minimum(share(SYMBOLS, n_words), 3), "upper": share(UPPER, np.maximum(share(LETTER, 1), 1)), "digits": share(DIGIT, size), "shouts": np.minimum(share(SHOUT, n_words), 3), "stops": np.minimum(share(STOP, n_words), 3),
        "ends": STOP[data[b - 1]].astype(float), "capital": UPPER[data[a]].astype(float), "repeated": per_line(repeated), "same_word": per_line(same), "same_line": (count[inverse] > 1).astype(float),
    }
    cols = [own[c] for c in OWN]
    joined = owner[1:] == owner[:-1]
    for c in NEIGHBOURS:
        before, after = np.zeros(len(a)), np.zeros(len(a))
        before[1:][joined] = own[c][:-1][joined]
        after[:-1][joined] = own[c][1:][joined]
        cols += [before, after]
    head, tail = np.ones(len(a)), np.ones(len(a))
    head[1:][joined] = 0
    tail[:-1][joined] = 0
    return np.stack([*cols, head, tail], axis=1), size, owner


def _grid(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's place in its text, the texts' first lines by falling length, and the lengths."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(owner)))
    order = np.argsort(-length, kind="stable")
    return first[order], length[order], np.repeat(first, np.diff(np.append(first, len(owner))))


def chain(unary: np.ndarray, owner: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log odds of good at each line, and the log odds of its marginal. States that agree along an edge gain ``stay``."""
    first, length, _ = _grid(owner)
    ahead, behind = np.zeros(len(unary)), np.zeros(len(unary))
    step = lambda m: np.logaddexp(m + stay, 0) - np.logaddexp(m, stay)
    longest = int(length[0]) if len(length) else 0
    second = max(int(length[1]), 1) if len(length) > 1 else min(longest, 1)
    # texts side by side; where the longest alone goes on, plain floats are faster than arrays of one
    for t in range(1, second):
        at = first[: np.searchsorted(-length, -t, "left")] + t
        ahead[at] = step(ahead[at - 1] + unary[at - 1])
    if longest > second:
        a = int(first[0])
        _single(ahead, unary, range(a + second, a + longest), -1, stay)
        _single(behind, unary, range(a + longest - 2, a + second - 2, -1), 1, stay)
    for t in range(min(second, longest) - 2, -1, -1):
        at = first[: np.searchsorted(-length, -(t + 1), "left")] + t
        behind[at] = step(behind[at + 1] + unary[at + 1])
    return ahead, behind, ahead + unary + behind


def _single(out: np.ndarray, unary: np.ndarray, places: range, from_: int, stay: float) -> None:
    """The recursion of one text over its lines at places, each from the line ``from_`` beside it."""
    if not len(places):
        return
    lo = min(places[0], places[-1], places[0] + from_)
    hi = max(places[0], places[-1], places[0] + from_) + 1
    u, x = unary[lo:hi].tolist(), out[lo:hi].tolist()
    for i in places:
        m = x[i + from_ - lo] + u[i + from_ - lo]
        up, down = m + stay, m - stay
        x[i - lo] = (max(up, 0.0) + math.log1p(math.exp(-abs(up)))) - (max(m, stay) + math.log1p(math.exp(-abs(down))))
    out[lo:hi] = x


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def qualities(marginal: np.ndarray, size: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities, as clipped log odds; NaN for texts without lines."""
    total = np.bincount(owner, weights=size, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = np.bincount(owner, weights=size * sigmoid(marginal), minlength=n) / total
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(x: np.ndarray, size: np.ndarray, owner: np.ndarray, label: np.ndarray, steps: int = STEPS) -> dict:
    """Weights by gradient ascent (Adam) on the conditional likelihood, then the calibration. label: of each text; owner: each line's text."""
    n = len(label)
    if not n:
        return {"w": np.zeros(N_FEATURES), "stay": 0.0, "scale": 0.0, "shift": 0.0, "empty": 0.5}
    rate = float(np.clip(label.mean(), 0.01, 0.99))
    y = label[owner].astype(float)
    theta, m, v = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1)
    edge = owner[1:] == owner[:-1]
    share = 1 / np.maximum(np.bincount(owner, minlength=n), 1)[owner] if len(owner) else np.zeros(0)  # a text weighs as one, however many lines it has
    for t in range(1, steps + 1):
        w, stay = theta[:-1], theta[-1]
        u = x @ w
        ahead, behind, marginal = chain(u, owner, stay)
        grad = np.append(x.T @ ((y - sigmoid(marginal)) * share), 0.0) / n
        if edge.any():
            left, right = (ahead + u)[:-1][edge], (u + behind)[1:][edge]
            agree = sigmoid(stay + np.logaddexp(left + right, 0) - np.logaddexp(left, right))
            grad[-1] = ((1 - agree) * share[1:][edge]).sum() / n
        grad -= 1e-4 * theta
        grad[-1] -= 0.02 * stay
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    q = qualities(chain(x @ theta[:-1], owner, theta[-1])[2], size, owner, n)
    has = ~np.isnan(q)
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton steps of a ridge logistic curve
        p = sigmoid(a * q[has] + b)
        r, h = label[has] - p, p * (1 - p) + 1e-6
        g = np.array([(r * q[has]).sum() - a, r.sum()])
        hess = np.array([[(h * q[has] ** 2).sum() + 1, (h * q[has]).sum()], [(h * q[has]).sum(), h.sum() + 1e-6]])
        d = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = a + d[0], b + d[1]
    return {"w": theta[:-1], "stay": float(theta[-1]), "scale": float(a), "shift": float(b), "empty": rate}


def score(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    x, size, owner = lines(data, offsets)
    q = qualities(chain(x @ model["w"], owner, model["stay"])[2], size, owner, len(offsets) - 1)
    return np.where(np.isnan(q), model["empty"], sigmoid(model["scale"] * q + model["shift"]))


def held_out(doc_id):
    """Rows that never teach: one fold in five by the checksum of the id's text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _features(batches):
    for batch in batches:
        for a, b, data, offsets in textbytes.slices(batch.column(2)):
            x, size, owner = lines(data, offsets)
            count = np.bincount(owner, minlength=b - a)
            keep = (count <= FIT_LINES)[owner]
            x, size, owner = x[keep], size[keep], owner[keep]
            edges = np.searchsorted(owner, np.arange(b - a + 1))
            for i in range(b - a):
                if count[i] <= FIT_LINES:
                    s = slice(edges[i], edges[i + 1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a + i, 1), batch.column(1).slice(a + i, 1), pa.array([x[s].astype("<f4").tobytes()]), pa.array([size[s].astype("<f4").tobytes()])], names=["doc_id", "label", "x", "size"])


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_docs: int = FIT_DOCS) -> dict:
    """A model from the labels of at most fit_docs documents, held-out rows excluded."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    sample = known.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(fit_docs)  # fit_docs rows bound what is broadcast and collected
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    rows = chosen.select("doc_id", "label", "text").mapInArrow(_features, "doc_id long, label int, x binary, size binary").collect()
    rows = sorted({r.doc_id: r for r in sorted(rows, key=lambda r: bytes(r.x))}.values(), key=lambda r: r.doc_id)[:fit_docs]
    xs = [np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in xs])
    x = np.concatenate(xs).astype(float) if xs else np.zeros((0, N_FEATURES))
    size = np.concatenate([np.frombuffer(r.size, "<f4") for r in rows]).astype(float) if rows else np.zeros(0)
    return fit(x, size, owner, np.array([r.label for r in rows], float))


def _scored(model: dict):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in textbytes.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score(model, data, offsets))], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_scored(model), "doc_id long, score double")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document with its quality score; labels of the held-out fold are never read by the fit."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
