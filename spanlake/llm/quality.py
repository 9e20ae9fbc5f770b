"""Quality rules by line sequence labelling.

A linear-chain conditional random field marks each line of a text as content or boilerplate (Viterbi decoding); the
share of a text's characters that stand on content lines decides whether the text is kept. The field is trained here,
in numpy, by gradient ascent on the exact likelihood of whole label sequences.

Labels are of documents, not of lines, so lines get their own in two steps. A logistic regression over the lines of all
training documents gives each line its evidence: what kind of document such lines stand in. A line is content if its
evidence says so, whatever document it stands in; only where a document's content share would then contradict its quality
label, its lines turn, those of the weakest evidence first, until it doesn't. So the lines of one text differ, and the
field learns from real sequences how labels follow each other.

Training takes at most TRAIN_DOCS labelled documents (those first by a hash of doc_id, each of at most TRAIN_LINES lines);
what leaves the executors for it are line features, not texts. Without labels of both classes, PRIOR is used as it is.

Beside the field stand rules on counts: under 50 words, or over half of the words in repeated 3-word windows, fails.

One narrow pass over the documents: no shuffle of texts. Cases: null and empty texts have no words and fail the
rules; very long texts are labelled whole; repeated rows are each judged; doc_id may be null; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Texts, arrow_schema, covered, documents, mix, prefix_hash, range_hash, text_steps, window_counts, _BYTE_VALUES

TRAIN_DOCS = 3000
TRAIN_LINES = 64
CONTENT_SHARE = 0.5
FEATURES = ("bias", "empty", "few words", "many words", "symbols", "symbol words", "repeated words", "repeated line", "sentence end", "digits", "capitals", "long words")
#: Weights of content over boilerplate by feature, and of staying in a label: the start of training.
PRIOR = np.array([1.0, 0.0, -0.2, 0.4, -6.0, -3.0, -4.0, -2.0, 0.5, -1.0, 0.0, 0.0])
PRIOR_STAY = 1.0

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
START = ~((np.arange(256) & 0xC0) == 0x80)  # first bytes of code points
END = np.zeros(256, bool)
END[list(b".!?\"')")] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True


class Lines:
    """Counts of each document and features of each line, for some documents at once."""

    def __init__(self, t: Texts):
        n, buf = len(t.begin), t.buf
        w0, w1, wd = t.words(SPACE)
        self.n_words = np.bincount(wd, minlength=n)

        def per(flags, begin, end):
            s = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return s[end] - s[begin]

        chars = START[buf] & ~SPACE[buf]
        self.word_chars = per(chars, t.begin, t.end)
        self.n_symbols = per(SYMBOL[buf], t.begin, t.end)
        ph = prefix_hash(_BYTE_VALUES[buf])
        wh = range_hash(ph, w0, w1)
        first, start = window_counts(wd, n, 3)
        wp = prefix_hash(wh)
        key = mix(range_hash(wp, start, start + 3) ^ mix(wd[start].astype(np.uint64))) if len(start) else np.zeros(0, np.uint64)
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        again = covered(start[count[inverse] > 1], 3, len(wd)) if len(start) else np.zeros(len(wd), bool)
        self.n_repeat = np.bincount(wd[again], minlength=n)
        # lines: cut at \n and at the ends of documents
        edge = np.zeros(len(buf) + 1, bool)
        edge[t.begin] = True
        edge[np.flatnonzero(buf == 10) + 1] = True
        l0 = np.flatnonzero(edge[:-1])
        l1 = np.append(l0[1:], len(buf)) if len(l0) else l0
        ld = np.searchsorted(t.begin, l0, side="right") - 1
        l1 = l1 - (buf[l1 - 1] == 10) if len(l0) else l1
        wl = np.searchsorted(l0, w0, side="right") - 1
        m = len(l0)
        words = np.bincount(wl, minlength=m)
        line_hash = mix(range_hash(ph, l0, l1) ^ mix(ld.astype(np.uint64))) if m else np.zeros(0, np.uint64)
        order = np.argsort(line_hash, kind="stable")
        twin = np.zeros(m, bool)
        if m:
            twin[order[1:]] = line_hash[order[1:]] == line_hash[order[:-1]]
        twin &= words > 0
        self.n_dup_lines = np.bincount(ld[twin], minlength=n)
        # distinct words of a line, by sorting its words' hashes
        by = np.lexsort((wh, wl))
        same = np.zeros(len(wl), bool)
        if len(wl):
            same[1:] = (wh[by][1:] == wh[by][:-1]) & (wl[by][1:] == wl[by][:-1])
        repeats = np.bincount(wl[by][same], minlength=m)
        self.line_chars = per(chars, l0, l1)
        bytes_ = np.maximum(1, per(~SPACE[buf], l0, l1))
        some = np.maximum(1, words)
        has_symbol = per(SYMBOL[buf], w0, w1) > 0
        last = np.zeros(m, bool)
        if len(wl):
            ends = np.flatnonzero(np.append(wl[1:] != wl[:-1], True))
            last[wl[ends]] = END[buf[w1[ends] - 1]]
        long_word = self.line_chars / some
        self.x = np.stack([
            np.ones(m), words == 0, (words > 0) & (words < 4), words > 10, np.minimum(1, per(SYMBOL[buf], l0, l1) / bytes_ * 5), np.bincount(wl[has_symbol], minlength=m) / some,
            repeats / some, twin, last, per(DIGIT[buf], l0, l1) / bytes_, per(CAPITAL[buf], l0, l1) / bytes_, np.minimum(2, long_word / 10),
        ], axis=1).astype(np.float32)
        self.line_doc = ld


def _padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in xs])
    out = np.zeros((len(xs), max(n, default=0), len(FEATURES)), np.float32)
    for i, x in enumerate(xs):
        out[i, : len(x)] = x
    return out, n


def line_labels(xs: list[np.ndarray], chars: list[np.ndarray], quality: list[int], share: float = CONTENT_SHARE, rounds: int = 40, l2: float = 1e-3) -> list[np.ndarray]:
    """Labels of the lines (1: content) of documents of known quality: by each line's own evidence, turned only as far as a document's share contradicts its quality."""
    x = np.concatenate(xs).astype(np.float64)
    n = np.array([len(d) for d in xs])
    y = np.repeat(np.array(quality, np.float64), n)
    weight = np.repeat(np.where(np.array(quality) == 1, 0.5 / max(1, sum(quality)), 0.5 / max(1, len(quality) - sum(quality))) / np.maximum(1, n), n)
    w = PRIOR.copy()
    for _ in range(rounds):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (weight * (p - y)) + l2 * (w - PRIOR))
    out = []
    for d, c, q in zip(xs, chars, quality, strict=True):
        e = d @ w
        label = (e > 0).astype(np.int8)
        total = max(1, c.sum())
        for i in np.argsort(np.abs(e), kind="stable"):
            if ((c @ label) / total >= share) == bool(q):
                break
            label[i] = q
        out.append(label)
    return out


def train(xs: list[np.ndarray], ys: list[np.ndarray], rounds: int = 60, rate: float = 0.15, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of content over boilerplate, and the 2 x 2 transition scores, at the (regularised) likelihood's maximum. ys: a label for each line."""
    w, tr = PRIOR.copy(), np.array([[PRIOR_STAY, 0.0], [0.0, PRIOR_STAY]])
    keep = [i for i, x in enumerate(xs) if len(x)]
    if len({int(v) for i in keep for v in np.unique(ys[i])}) < 2:
        return w, tr
    x, n = _padded([xs[i] for i in keep])
    docs, steps = x.shape[:2]
    live = np.arange(steps)[None] < n[:, None]
    y = np.zeros((docs, steps), np.int8)
    for k, i in enumerate(keep):
        y[k, : n[k]] = ys[i]
    mostly = (y.sum(1) * 2 >= n).astype(np.int8)
    share = np.where(mostly == 1, 0.5 / max(1, (mostly == 1).sum()), 0.5 / max(1, (mostly == 0).sum())) / n  # texts of mostly content and of mostly boilerplate weigh alike
    true = np.zeros((docs, 2, 2))
    for p in range(2):
        for q in range(2):
            true[:, p, q] = ((y[:, :-1] == p) & (y[:, 1:] == q) & live[:, 1:]).sum(1)
    m1, m2 = [np.zeros(len(w) + 4) for _ in range(2)]
    for k in range(1, rounds + 1):
        e = np.zeros((docs, steps, 2))
        e[..., 1] = x @ w
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, steps):
            s = a[:, t - 1, :, None] + tr
            top = s.max(1)
            a[:, t] = np.where(live[:, t, None], top + np.log(np.exp(s - top[:, None]).sum(1)) + e[:, t], a[:, t - 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        pair = np.zeros((docs, 2, 2))
        for t in range(steps - 2, -1, -1):
            s = tr + (e[:, t + 1] + b[:, t + 1])[:, None, :]
            top = s.max(2)
            nxt = live[:, t + 1, None]
            b[:, t] = np.where(nxt, top + np.log(np.exp(s - top[..., None]).sum(2)), b[:, t + 1])
            p = np.exp(np.minimum(0, a[:, t, :, None] + s - z[:, None, None]))
            pair += p * nxt[..., None]
        p1 = np.exp(np.minimum(0, a[..., 1] + b[..., 1] - z[:, None])) * live
        gw = np.einsum("dt,dtf->f", (live * y - p1) * share[:, None], x) - l2 * (w - PRIOR)
        gt = ((true - pair) * share[:, None, None]).sum(0) - l2 * tr
        g = np.concatenate([gw, gt.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
        w, tr = w + step[: len(w)], tr + step[len(w) :].reshape(2, 2)
    return w, tr


def viterbi(x: np.ndarray, line_doc: np.ndarray, n_docs: int, w: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """The likeliest labels of the lines (1: content) of all documents; line_doc ascends."""
    m = len(line_doc)
    out = np.zeros(m, np.int8)
    if not m:
        return out
    count = np.bincount(line_doc, minlength=n_docs)
    begin = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    begin, count = begin[order], count[order]
    live = np.searchsorted(-count, -np.arange(1, count[0] + 1), side="right")
    e = x @ w
    back = np.zeros((m, 2), np.int8)
    s = np.stack([np.zeros(len(order)), e[begin]], axis=1)
    for t in range(1, count[0]):
        k = live[t]
        at = begin[:k] + t
        zero, one = s[:k, 0:1] + tr[0], s[:k, 1:2] + tr[1]
        back[at] = one > zero
        best = np.maximum(zero, one)
        best[:, 1] += e[at]
        s[:k] = best
    label = (s[:, 1] > s[:, 0]).astype(np.int8)
    for t in range(count[0] - 1, -1, -1):
        k = live[t]
        at = begin[:k] + t
        out[at] = label[:k]
        label[:k] = back[at, label[:k]]
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights, from at most `most` labelled documents."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "quality")

    def run(batches):
        for b in batches:
            q = b.column(1).to_pylist()
            rows, ys = [], []
            for i, t in text_steps(b.column(0)):
                lines = Lines(t)
                edges = np.searchsorted(lines.line_doc, np.arange(len(t.begin) + 1))
                for k in range(len(t.begin)):
                    if 0 < edges[k + 1] - edges[k] <= TRAIN_LINES:
                        at = slice(edges[k], edges[k + 1])
                        rows.append(np.column_stack([lines.x[at], lines.line_chars[at]]).astype(np.float32).tobytes())
                        ys.append(q[i + k])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(ys, pa.int32())], names=["x", "y"])

    got = sorted((r.y, bytes(r.x)) for r in pairs.mapInArrow(run, "x binary, y int").collect())
    quality = [1 if y else 0 for y, _ in got]
    if len(set(quality)) < 2:
        return train([], [])
    rows = [np.frombuffer(x, np.float32).reshape(-1, len(FEATURES) + 1) for _, x in got]
    xs, chars = [r[:, :-1] for r in rows], [r[:, -1] for r in rows]
    return train(xs, line_labels(xs, chars, quality))


JUDGED = "doc_id bigint,n_words bigint,word_chars bigint,n_symbols bigint,n_dup_lines bigint,n_repeat_words bigint,base_failed boolean,content_share double,n_lines bigint,kept boolean"


def _judge(column, model, share: float) -> list[np.ndarray]:
    out = []
    for _, t in text_steps(column):
        n = len(t.begin)
        v = Lines(t)
        label = viterbi(v.x, v.line_doc, n, *model)
        good = np.bincount(v.line_doc, weights=v.line_chars * label, minlength=n) / np.maximum(1, np.bincount(v.line_doc, weights=v.line_chars, minlength=n))
        failed = (v.n_words < 50) | (100 * v.n_repeat > 50 * v.n_words)
        out.append([v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat, failed, good, np.bincount(v.line_doc, minlength=n), ~failed & (good >= share)])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], share: float = CONTENT_SHARE) -> DataFrame:
    """Per document its counts, its share of content, and whether it is kept."""
    s = arrow_schema(JUDGED)

    def run(batches):
        for b in batches:
            if b.num_rows:
                cols = _judge(b.column(1), model, share)
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(s)[1:], strict=True)]], schema=s)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, JUDGED)


def keep(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], share: float = CONTENT_SHARE) -> DataFrame:
    """The documents that are kept, unchanged."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_judge(b.column(at), model, share)[-1]))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
