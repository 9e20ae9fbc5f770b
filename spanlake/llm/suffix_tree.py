"""Language-model scoring by a probabilistic suffix tree.

The symbols are the bytes of the normalised text: A-Z lower-cased, words parted by one blank, one end. A context (up to
DEPTH last symbols) is a node of the tree if it stands LEAST_COUNT times or more in training and its next-symbol
distribution diverges from that of its suffix (the context without its oldest symbol): its count times the Kullback-Leibler
divergence, which is the log likelihood that the node gains, is LEAST_GAIN or more. Every depth is tested alike; the root
is always there. A node's distribution is smoothed towards that of its longest suffix in the tree in proportion to the
number of distinct next symbols (Witten-Bell), the root's towards all 256 bytes alike, so the probabilities of the 256
next symbols add up to 1 in every state. A text's score is the sum over its symbols, end included, of the log10
probability at the longest suffix of what stands before that is a node: words never seen are scored like all others.

The tree grows with the corpus and is never gathered in one place: counts cover all training texts. Each chunk ships its
distinct words and its distinct (DEPTH + 1)-grams with counts; buckets add them up. N-grams are dealt by the context's last
two symbols, so a context and all its suffixes down to two symbols meet in one bucket, which tests the nodes and sends
the log10 probability of each distinct n-gram back to the chunks that asked. Only contexts of one symbol and none span
buckets; their counts, at most 256 * 256 numbers whatever the corpus, are added up first and broadcast. The counts of
words (for the base score) go back in the same way. The answers are written once to the checkpoint folder.

Words are told apart by 64-bit hashes, n-grams by their bytes. Cases: null and empty texts hold just the end; a null doc_id counts as training
(its remainder isn't 0); repeated rows count each; very long texts are scored whole; other columns are ignored; an empty
table gives no rows; without training texts every byte is as likely as any other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, _BYTE_VALUES, answer, buckets_for, by_group, chunked, documents, mix, prefix_hash, range_hash, shared_path, split_sorted, table, text_bytes, text_steps
from .windows import release

DEPTH = 5
LEAST_COUNT = 2
LEAST_GAIN = 3.0
FOLDS = 10
END = 10  # the byte \n, which no word or blank is

_MASK = [np.uint64((1 << 8 * k) - 1) for k in range(8)]
_END_WORD = np.uint64(0x656E64)

FOUND = "bucket int,chunk int,hashes binary,counts binary"
ADDED = "kind int,bucket int,chunk int,a binary"
OUT = "doc_id bigint,held_out boolean,n_tokens bigint,n_known bigint,train_tokens bigint,base_score double,score double"


def held(ids) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % FOLDS == 0 for x in ids], bool)


class Symbols:
    """Some documents as one stream of symbols: DEPTH ends before each, its words with a blank after each, its end."""

    def __init__(self, t):
        n, buf = len(t.begin), LOWER[t.buf]
        self.n = n
        w0, w1, self.word_doc = t.words(SPACE)
        self.words = range_hash(prefix_hash(_BYTE_VALUES[buf]), w0, w1)
        self.n_words = np.bincount(self.word_doc, minlength=n)
        length = w1 - w0
        solid = buf[~SPACE[buf]]
        end_word = np.cumsum(length + 1)
        last = np.cumsum(self.n_words)
        bytes_to = np.append(0, end_word)[last]  # symbols of words up to and with each document
        self.end_at = bytes_to + (DEPTH + 1) * np.arange(1, n + 1) - 1
        self.stream = np.full(len(solid) + len(w0) + (DEPTH + 1) * n, 32, np.uint8)
        shift = np.arange(len(w0)) + DEPTH + (DEPTH + 1) * self.word_doc
        self.stream[np.arange(len(solid)) + np.repeat(shift, length)] = solid
        self.word_at = end_word - length - 1 + DEPTH + (DEPTH + 1) * self.word_doc
        self.word_to = self.word_at + length + 1
        self.begin_at = np.append(0, self.end_at[:-1] + 1) if n else self.end_at
        for k in range(DEPTH):
            self.stream[self.begin_at + k] = END
        self.stream[self.end_at] = END
        real = np.ones(len(self.stream), bool)
        for k in range(DEPTH):
            real[self.begin_at + k] = False
        self.real = real

    def grams(self, docs: np.ndarray) -> np.ndarray:
        """The DEPTH symbols before each symbol of the chosen documents and the symbol itself, in one number each."""
        s = self.stream.astype(np.uint64)
        key = s[DEPTH:].copy()
        for k in range(1, DEPTH + 1):
            key |= s[DEPTH - k : len(s) - k] << np.uint64(8 * k)
        keep = self.real[DEPTH:] & np.repeat(docs, np.diff(np.append(self.begin_at, len(s))))[DEPTH:]
        return key[keep]


def _sums(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[edge], np.add.reduceat(count[order], edge)


class Tally:
    """Distinct keys with sums of their counts. Parts of like size are united as they come, so little more than the distinct keys is held."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, count: np.ndarray) -> None:
        self.parts.append((key, count))
        while len(self.parts) > 1 and len(self.parts[-2][0]) <= 2 * len(self.parts[-1][0]):
            self._unite(2)

    def _unite(self, n: int) -> None:
        last = self.parts[-n:]
        del self.parts[-n:]
        self.parts.append(_sums(*map(np.concatenate, zip(*last, strict=True))))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        self._unite(len(self.parts))
        return self.parts[0]


def _packed(key: np.ndarray) -> bytes:
    """Sorted keys as byte planes, which compress well in an exchange."""
    return key.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _dealt(key: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted n-grams by bucket, and the buckets' edges in it. The last two symbols of the context decide."""
    bucket = (mix((key >> np.uint64(8)) & _MASK[2]) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def pairs(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How often each symbol follows each in training texts (256 x 256), and the number of training tokens: a scan that sends at most 65,536 sums a task."""

    def run(batches):
        total, n = np.zeros(1 << 16, np.int64), 0
        for b in batches:
            train = ~held(b.column(0).to_pylist())
            n += int(train.sum())
            for i, part in text_steps(b.column(1)):
                s = Symbols(part)
                learn = train[i : i + s.n]
                total += np.bincount((s.grams(learn) & _MASK[2]).astype(np.int64), minlength=1 << 16)
                n += int(learn[s.word_doc].sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["pair", "n"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, n = np.zeros(1 << 16, np.int64), 0
    for r in d.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 65,537 rows
        if r.pair < 0:
            n = r.n
        else:
            out[r.pair] = r.n
    return out.reshape(256, 256), n


class Stem:
    """The tree down to contexts of one symbol: counts, and the probability of each symbol after each."""

    def __init__(self, counts: np.ndarray, least_count: int = LEAST_COUNT, least_gain: float = LEAST_GAIN):
        self.counts = counts.astype(np.float64)
        self.total, root = self.counts.sum(1), self.counts.sum(0)
        kinds = (root > 0).sum()
        self.root = (root + kinds / 256) / (root.sum() + kinds) if kinds else np.full(256, 1 / 256)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(self.counts > 0, self.counts * np.log((self.counts / self.total[:, None]) / (root / root.sum())), 0).sum(1)
        self.is_node = (self.total >= least_count) & (gain >= least_gain)
        n1 = (self.counts > 0).sum(1)
        smooth = (self.counts + n1[:, None] * self.root) / np.maximum(1, self.total + n1)[:, None]
        self.prob = np.where(self.is_node[:, None], smooth, self.root)


def probabilities(key: np.ndarray, count: np.ndarray, stem: Stem, least_count: int = LEAST_COUNT, least_gain: float = LEAST_GAIN) -> tuple[np.ndarray, int]:
    """The probability of each distinct n-gram's last symbol at the longest suffix of its context that is a node, and the number of nodes of two symbols or more. All n-grams with the same last two context symbols are there."""
    p = stem.prob.ravel()[(key & _MASK[2]).astype(np.int64)]
    n_nodes = 0
    up_ctx = np.arange(256, dtype=np.uint64)
    up_total = stem.total
    up_gram, up_count = np.arange(1 << 16, dtype=np.uint64), stem.counts.ravel()
    for d in range(2, DEPTH + 1):
        own = key & _MASK[d + 1]
        gram, times = _sums(own, count)
        ctx, total = _sums(gram >> np.uint64(8), times)
        which = np.searchsorted(ctx, gram >> np.uint64(8))
        seen = times > 0
        kinds = np.bincount(which[seen], minlength=len(ctx))
        g, w = gram[seen], which[seen]
        parent = up_count[np.searchsorted(up_gram, g & _MASK[d])] / up_total[np.searchsorted(up_ctx, (g >> np.uint64(8)) & _MASK[d - 1])]
        gain = np.bincount(w, weights=times[seen] * np.log(times[seen] / total[w] / parent), minlength=len(ctx))
        is_node = (total >= least_count) & (gain >= least_gain)
        n_nodes += int(is_node.sum())
        at = np.searchsorted(gram, own)
        c = which[at]
        p = np.where(is_node[c], (times[at] + kinds[c] * p) / np.maximum(1, total[c] + kinds[c]), p)
        up_ctx, up_total, up_gram, up_count = ctx, total, gram, times
    return p, n_nodes


def _distinct(table_: pa.Table, places: bool = False):
    """What a chunk ships and looks up: (distinct words, their training counts, distinct n-grams, their training counts), and with places per step (first document, documents, their words, their symbols, distinct words of the step, each word's place among them, distinct n-grams, each symbol's place among them)."""
    train = ~held(table_["doc_id"].to_pylist())
    words, grams, steps = Tally(), Tally(), []
    words.add(np.array([_END_WORD]), np.array([int(train.sum())]))
    grams.add(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for i, part in text_steps(table_["text"]):
        s = Symbols(part)
        learn = train[i : i + s.n]
        w, w_at = np.unique(s.words, return_inverse=True)
        words.add(w, np.bincount(w_at, weights=learn[s.word_doc], minlength=len(w)).astype(np.int64))
        symbols = np.diff(np.append(s.begin_at, len(s.stream))) - DEPTH
        g, g_at = np.unique(s.grams(np.ones(s.n, bool)), return_inverse=True)
        grams.add(g, np.bincount(g_at, weights=np.repeat(learn, symbols), minlength=len(g)).astype(np.int64))
        if places:
            steps.append((i, s.n, s.n_words, symbols, w, w_at.astype(np.int32), g, g_at.astype(np.int32)))
    return (*words.sums(), *grams.sums(), steps)


def gather(docs: DataFrame, n_buckets: int) -> DataFrame:
    """FOUND rows: of each chunk its distinct words (buckets from 0) and n-grams (buckets below 0) with their counts in training texts (0 for those of held-out texts only)."""

    def run(t: pa.Table) -> pa.Table:
        chunk = t["chunk"][0].as_py()
        key, count, gram, times, _ = _distinct(t)
        edges = split_sorted(key, n_buckets)
        some = [i for i in range(n_buckets) if edges[i] < edges[i + 1]]
        rows = [(i, _packed(key[edges[i] : edges[i + 1]]), count[edges[i] : edges[i + 1]].astype("<u4").tobytes()) for i in some]
        order, cut = _dealt(gram, n_buckets)
        for i in range(n_buckets):
            at = order[cut[i] : cut[i + 1]]
            if len(at):
                rows.append((-1 - i, _packed(gram[at]), times[at].astype("<u4").tobytes()))
        return table(FOUND, [r[0] for r in rows], [chunk] * len(rows), [r[1] for r in rows], [r[2] for r in rows])

    return by_group(docs, "chunk", run, FOUND)


def added(found: DataFrame, stem: Stem) -> DataFrame:
    """ADDED rows: kind 0, for each chunk the corpus's counts of its words; 1, the distinct words and the nodes of a bucket; 2, for each chunk the log10 probabilities of its n-grams."""
    shared = found.sparkSession.sparkContext.broadcast(stem)  # 256 x 256 numbers

    def run(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        per = [_unpacked(x.as_py()) for x in t["hashes"]]
        tally = Tally()
        for h, x in zip(per, t["counts"], strict=True):
            tally.add(h, np.frombuffer(x.as_py(), "<u4").astype(np.int64))
        key, count = tally.sums()
        n = len(per)
        if bucket < 0:
            p, nodes = probabilities(key, count, shared.value)
            value, kind, totals = np.log10(p).astype("<f4"), 2, [0, nodes]
        else:
            value, kind, totals = count.astype("<i8"), 0, [int((count > 0).sum()), 0]
        back = [value[np.searchsorted(key, h)].tobytes() for h in per]
        return table(ADDED, [kind] * n + [1], [bucket] * (n + 1), [*t["chunk"].to_pylist(), -1], [*back, np.array(totals, np.int64).tobytes()])

    return by_group(found, "bucket", run, ADDED)


def scored(docs: DataFrame, answers: DataFrame, n_buckets: int, n_tokens: int, n_distinct: int) -> DataFrame:
    norm = np.log10(n_tokens + 0.1 * (n_distinct + 1))

    def run(t: pa.Table, other: pa.Table) -> pa.Table:
        key, _, gram, _, steps = _distinct(t, True)
        raw = dict(zip(zip(other["kind"].to_pylist(), other["bucket"].to_pylist(), strict=True), other["a"].to_pylist(), strict=True))
        blobs = [raw[0, i] for i in range(n_buckets) if (0, i) in raw]
        log = np.frombuffer(b"".join(blobs), "<i8")
        known, log = log > 0, np.log10(log + 0.1) - norm
        order, _ = _dealt(gram, n_buckets)
        value = np.empty(len(gram))
        value[order] = np.frombuffer(b"".join(raw[2, -1 - i] for i in range(n_buckets) if (2, -1 - i) in raw), "<f4")
        end = int(np.searchsorted(key, _END_WORD))
        ids = t["doc_id"].to_pylist()
        n = len(ids)
        n_words, base, n_known, total = np.zeros(n, np.int64), np.full(n, log[end]), np.full(n, int(known[end])), np.zeros(n)
        for i, m, words, symbols, w, w_at, g, g_at in steps:
            w_at, part = np.searchsorted(key, w)[w_at], slice(i, i + m)
            word_doc = np.repeat(np.arange(m), words)
            n_words[part] = words
            base[part] += np.bincount(word_doc, weights=log[w_at], minlength=m)
            n_known[part] += np.bincount(word_doc, weights=known[w_at], minlength=m).astype(np.int64)
            total[part] = np.bincount(np.repeat(np.arange(m), symbols), weights=value[np.searchsorted(gram, g)][g_at], minlength=m)
        return table(OUT, t["doc_id"], held(ids), n_words + 1, n_known, np.full(n, n_tokens), base, total)

    return answer(docs, answers, run, OUT)


def learn(docs: DataFrame, path: str | None = None):
    """(documents dealt by chunk, answers by chunk, buckets, tokens, distinct tokens, nodes) of a table."""
    spark = docs.sparkSession
    total = text_bytes(docs)
    counts, n_tokens = pairs(docs)
    stem = Stem(counts)
    dealt = chunked(docs, total=total, apart=True)
    n_buckets = buckets_for(spark, total)
    path = path or shared_path(spark, "suffix-tree")
    added(gather(dealt, n_buckets), stem).write.parquet(path)
    release(spark)
    both = spark.read.schema(ADDED.replace(",", ", ")).parquet(path)
    totals = np.zeros(2, np.int64)
    for r in both.where("kind = 1").select("a").collect():  # two numbers a bucket
        totals += np.frombuffer(r.a, np.int64)
    return dealt, both.where("kind <> 1").select("chunk", "kind", "bucket", "a"), n_buckets, n_tokens, int(totals[0]), int(totals[1] + stem.is_node.sum())


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    return scored(*learn(docs, path)[:5])


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
