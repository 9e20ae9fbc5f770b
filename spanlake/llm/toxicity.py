"""Toxicity by subword-bag embeddings under a linear softmax.

A word is a bag of subwords: its byte n-grams (4 to 6 long inside, 3 to 8 long at its ends) and itself, hashed into BUCKETS.
A segment is a run of up to SEGMENT_WORDS words, and its embedding is the average of the vectors of all its subwords; a
linear softmax over two classes scores it. A text's logit is the smooth maximum (log of the mean exponential, at POOL)
of its segments' logits, so that a few words in a long text are not averaged away; segments begin every half of their
length, so no phrase is only seen cut in two. Vectors and softmax are trained jointly in numpy: both start at random, and
Adagrad descends the exact gradient of the softmax loss of whole documents through pooling and averaging, in small batches
from whose bags subwords are left out at random, so a word's evidence lies in all its subwords.
(With two classes, the gradient of each vector is a multiple of the difference of the softmax's columns, so it can be had
from one number a subword.) A misspelling that was never seen still shares most n-grams with its word; n-grams that
training never saw have no vector, so a segment is the average of those it did see.

Training takes at most TRAIN_DOCS labelled rows, half of either class where there are enough (those first by a hash of
doc_id, of texts up to TRAIN_BYTES long); they alone are collected. Scoring takes all texts whole in one narrow pass;
doc_id decides only which labels may be learnt from.

Cases: null and empty texts get the score of no evidence; without labels of both classes every text gets that score;
repeated rows are each scored; a null doc_id is not held out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, _BYTE_VALUES, documents, mix, prefix_hash, range_hash, text_steps, tidy

BUCKETS = 1 << 18
DIM = 8
NGRAMS = (4, 5, 6)
EDGES = (3, 4, 5, 6, 7, 8)
SEGMENT_WORDS = 8
POOL = 4.0
#: In training a subword stays in its bag with this chance, so no single one carries a word.
KEPT = 0.3
TRAIN_DOCS = 3000
TRAIN_BYTES = 6000
THRESHOLD = 0.7


def subwords(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each subword, its word) and the document of each word."""
    buf = LOWER[t.buf]
    w0, w1, wd = t.words(SPACE)
    ph = prefix_hash(_BYTE_VALUES[buf])
    mask = np.uint64(BUCKETS - 1)
    ids, owner = [(range_hash(ph, w0, w1) & mask).astype(np.int32)], [np.arange(len(w0))]
    for n in EDGES:  # n-grams that begin or end a word count beside those inside
        w = np.flatnonzero(w1 - w0 > n)
        for salt, p in ((n, w0[w]), (n + 100, w1[w] - n)):
            ids.append((mix(range_hash(ph, p, p + n) + np.uint64(salt)) & mask).astype(np.int32))
            owner.append(w)
    end = np.zeros(len(buf), np.int64)
    word = np.full(len(buf), -1, np.int64)
    if len(w0):
        length = w1 - w0
        at = np.repeat(w0 - np.cumsum(length) + length, length) + np.arange(length.sum())
        word[at] = np.repeat(np.arange(len(w0)), length)
        end[at] = np.repeat(w1, length)
        for n in NGRAMS:
            p = at[at + n <= end[at]]
            ids.append((range_hash(ph, p, p + n) & mask).astype(np.int32))
            owner.append(word[p])
    return np.concatenate(ids), np.concatenate(owner), wd


def segments(wd: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word + 1, document) of each segment."""
    count = np.bincount(wd, minlength=n_docs)
    first = np.cumsum(count) - count
    half = SEGMENT_WORDS // 2
    per = np.where(count > 0, np.maximum(1, -(-(count - half) // half)), 0)
    doc = np.repeat(np.arange(n_docs), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[doc] + k * half
    return begin, np.minimum(begin + SEGMENT_WORDS, first[doc] + count[doc]), doc


def pooled(z: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The smooth maximum of each document's segments' logits, and each segment's share in it (the gradient). doc ascends; a document without segments has 0."""
    top = np.full(n_docs, -np.inf)
    np.maximum.at(top, doc, z)
    e = np.exp(POOL * (z - top[doc]))
    total = np.bincount(doc, weights=e, minlength=n_docs)
    n = np.bincount(doc, minlength=n_docs)
    some = n > 0
    out = np.zeros(n_docs)
    out[some] = top[some] + np.log(total[some] / n[some]) / POOL
    return out, e / total[doc]


class Bags:
    """The subwords of some documents, sorted by word, and their segments as runs of subwords; with `kept`, each subword is there with that chance."""

    def __init__(self, t, kept: float = 1.0, rng: np.random.Generator | None = None):
        ids, owner, wd = subwords(t)
        if rng is not None:
            stay = rng.random(len(ids)) < kept
            ids, owner = ids[stay], owner[stay]
        order = np.argsort(owner, kind="stable")
        self.ids, self.n = ids[order], len(t.begin)
        edge = np.searchsorted(owner[order], np.arange(len(wd) + 1))
        begin, end, self.doc = segments(wd, self.n)
        self.begin, self.end = edge[begin], edge[end]

    def means(self, value: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """The average of a number over each segment's subwords (those known, if that is given)."""
        s = np.append(0, np.cumsum(value[self.ids], dtype=np.float64))
        n = self.end - self.begin
        if known is not None:
            c = np.append(0, np.cumsum(known[self.ids]))
            n = c[self.end] - c[self.begin]
        return (s[self.end] - s[self.begin]) / np.maximum(1, n)


class Model:
    """value: each bucket's share of the logit (its vector times the difference of the softmax's columns); bias; scale and shift: calibration; known: the buckets seen in training (all if not given); none: the logit of a text without words (the median of texts labelled 0)."""

    def __init__(self, value: np.ndarray | None, scale: float, shift: float, known: np.ndarray | None = None, bias: float = 0.0, none: float = 0.0):
        self.scale, self.shift, self.bias, self.none = scale, shift, bias, none
        self.known = np.ones(BUCKETS, bool) if known is None else known
        self.value = None if value is None else np.where(self.known, value, 0).astype(np.float32)

    def logits(self, t) -> np.ndarray:
        n = len(t.begin)
        if self.value is None:
            return np.zeros(n)
        b = Bags(t)
        z = pooled(b.means(self.value, self.known) + self.bias, b.doc, n)[0]
        return np.where(np.bincount(b.doc, minlength=n) > 0, z, self.none)

    def scores(self, column) -> np.ndarray:
        out = [self.logits(t) for _, t in text_steps(column)]
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -50, 50)))


def gradients(b: Bags, y: np.ndarray, weight: np.ndarray, vector: np.ndarray, softmax: np.ndarray, bias: np.ndarray):
    """(loss, its gradients by vector (of the buckets in b, and which they are), softmax and bias) of the documents in b: the softmax loss of each at its pooled logit, weighted."""
    used, at = np.unique(b.ids, return_inverse=True)
    v, axis = vector[used].astype(np.float64), (softmax[:, 1] - softmax[:, 0]).astype(np.float64)
    part = v @ axis
    s = np.append(0, np.cumsum(part[at]))
    size = np.maximum(1, b.end - b.begin)
    z, share = pooled((s[b.end] - s[b.begin]) / size + bias[1] - bias[0], b.doc, b.n)
    some = np.bincount(b.doc, minlength=b.n) > 0
    p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    loss = float((weight * -np.log(np.where(y == 1, p, 1 - p) + 1e-12))[some].sum())
    g = (weight * (p - y))[b.doc] * share  # by each segment's logit
    ramp = np.zeros(len(b.ids) + 1)
    np.add.at(ramp, b.begin, g / size)
    np.add.at(ramp, b.end, -g / size)
    by_part = np.bincount(at, weights=np.cumsum(ramp[:-1]), minlength=len(used))
    by_axis = by_part @ v
    return loss, used, by_part[:, None] * axis, np.stack([-by_axis, by_axis], axis=1), np.array([-g.sum(), g.sum()])


def train(texts: list[str], labels: list[int], epochs: int = 20, rate: float = 0.5, batch: int = 64, seed: int = 7, kept: float = KEPT) -> Model:
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return Model(None, 0.0, float(np.log(1 / 9)))
    rng = np.random.default_rng(seed)
    vector = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    softmax, bias = rng.normal(0, 1, (DIM, 2)), np.zeros(2)
    fit = np.arange(len(y)) % 5 > 0  # the rest calibrates
    weight = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * fit.sum()
    column = pa.array(texts, pa.large_string())

    def bags(rows, rng=None):
        (_, t), = text_steps(column.take(pa.array(rows)), 1 << 40)
        return Bags(t, kept, rng)

    learnt = np.flatnonzero(fit)
    sums = [np.zeros(BUCKETS, np.float32), np.zeros_like(softmax), np.zeros_like(bias)]
    for _ in range(epochs):
        order = rng.permutation(learnt)
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            _, used, by_vector, by_softmax, by_bias = gradients(bags(rows, rng), y[rows], weight[rows] / len(rows), vector, softmax, bias)
            # Adagrad: a step size for each vector, and for each weight of the softmax
            sums[0][used] += (by_vector**2).mean(axis=1)
            vector[used] -= (rate * by_vector / (np.sqrt(sums[0][used])[:, None] + 1e-8)).astype(np.float32)
            for value, by, total in ((softmax, by_softmax, sums[1]), (bias, by_bias, sums[2])):
                total += by**2
                value -= 0.1 * rate * by / (np.sqrt(total) + 1e-8)
    value = vector @ (softmax[:, 1] - softmax[:, 0])
    known = np.zeros(BUCKETS, bool)
    model = Model(value.astype(np.float32), 1.0, 0.0, None, float(bias[1] - bias[0]))
    z = np.zeros(len(y))
    for i in range(0, len(y), batch):
        rows = np.arange(i, min(len(y), i + batch))
        b = bags(rows)
        known[b.ids] = True
        z[rows] = pooled(b.means(model.value) + model.bias, b.doc, b.n)[0]
    scale, shift = calibrated(z[~fit], y[~fit]) if len(set(y[~fit].tolist())) == 2 else (1.0, 0.0)
    return Model(value, scale, shift, known, model.bias, float(np.median(z[y == 0])))


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits by which a logistic curve fits best, both classes weighing alike (Newton's method)."""
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g, h = w * (p - y), w * p * (1 - p) + 1e-9
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * z).sum() + 1e-3 * (a - 1), g.sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


def remainder(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Model:
    """The model learnt from at most `most` labelled rows whose crc32(doc_id) mod 3 is not 1."""
    known = labels.where(F.col("toxic").isNotNull() & (remainder(3) != 1)).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    short = docs.where(F.octet_length("text") <= most_bytes).select(F.col("doc_id").cast("long").alias("doc_id"))
    usable = known.join(short, "doc_id", "left_semi")
    picked = None
    for c in (1, 0):
        part = usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= most_bytes).join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(most).collect()
    model = train([r.text for r in rows], [r.toxic for r in rows])
    del rows
    tidy()
    return model


SCORED = "doc_id long, held_out boolean, score double"


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS values

    def run(batches):
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m.scores(b.column(2)), pa.float64())], names=["doc_id", "held_out", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, SCORED).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
