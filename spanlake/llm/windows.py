"""Incremental substring dedup over a log-structured fingerprint index.

A window is SIZE consecutive words of a document; a word goes if a window over it also starts in a document with a
smaller doc_id. The index holds fingerprints of historical windows in sorted immutable runs, one run a batch. A window is
filed under its anchor: of the SIZE / 2-word grams that it contains the leftmost one with the smallest hash; equal windows
have equal anchors, and neighbouring windows share theirs, so a run has about a fourteenth as many entries as words.

Steps for a batch: (1) its anchors are sorted and written as a run; (2) the run is merge-joined, bucket by bucket of the
hash space, with itself and all older runs (each presorted, so the sort merges runs), which gives its anchors that stand in two or more documents; (3) only windows at
such anchors are verified, in the batch and in the chunks of history that the index names, by two independent hashes of
their whole word sequence (96 bits), each with the smallest doc_id it starts in; (4) words of the batch under windows that
start in a smaller document go; (5) the run joins the index, and when there are more than FANOUT runs they are compacted
into one. An entry names its chunk, also when compacted, so no run loses what verification needs; verification reads the
texts of history again. Batches come in order of doc_id, so what is settled for one stays settled. What a chunk of documents ships is deduplicated first, so a passage that a third of all documents
share is one entry per chunk, and buckets are ranges of a hash, so none grows with such a passage.

Cases: null and empty texts have no words; a text under SIZE words has no windows; a null doc_id counts as larger than
all others; repeated rows with one doc_id don't remove each other; ties can't arise, as only smaller ids count; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, _BYTE_VALUES, answer, buckets_for, by_group, chunked, covered, documents, empty, leftmost_minima, mix, prefix_hash, range_hash, shared_path, split_sorted, table, text_bytes, text_steps, window_counts

SIZE = 50
FANOUT = 8
NULL_ID = (1 << 63) - 1
SECOND_BASE = 0x2545F4914F6CDD1D

RUN = "bucket int,chunk int,hashes binary,lows binary,highs binary,owners binary"
SHARED = "chunk int,hashes binary"
SEEN = "bucket int,chunk int,hashes binary,checks binary,lows binary,highs binary"
HITS = "chunk int,hashes binary,checks binary,lows binary"
OUT = "doc_id bigint,n_words bigint,n_removed bigint,kept_sha256 string"


def _ids(column) -> np.ndarray:
    return column.combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """The words of some documents as hashes, with what is needed to hash windows."""

    def __init__(self, t, size: int):
        self.n = len(t.begin)
        w0, w1, self.doc = t.words(SPACE)
        wh = range_hash(prefix_hash(_BYTE_VALUES[t.buf]), w0, w1)
        self.prefix = prefix_hash(wh)
        self.second = prefix_hash(wh, SECOND_BASE)
        self.first, self.start = window_counts(self.doc, self.n, size)
        self.size = size

    def anchors(self) -> np.ndarray:
        """The hash of each window's anchor."""
        gram = self.size // 2
        if not len(self.start):
            return np.zeros(0, np.uint64)
        at = np.arange(len(self.doc) - gram + 1)
        g = range_hash(self.prefix, at, at + gram)
        return mix(g[leftmost_minima(g, self.size - gram + 1)[self.start]])  # smallest hashes are all small: mixed again, they fall evenly into buckets

    def window_hashes(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return range_hash(self.prefix, start, start + self.size), (range_hash(self.second, start, start + self.size) >> np.uint64(32)).astype(np.uint32)


def _smallest(key: np.ndarray, low: np.ndarray, high: np.ndarray, check: np.ndarray | None = None):
    """Distinct keys in order with the smallest low and the largest high of each (by check too, if given)."""
    order = np.argsort(key, kind="stable") if check is None else np.lexsort((check, key))
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    if check is not None and len(key):
        check = check[order]
        fresh[1:] |= check[1:] != check[:-1]
    edge = np.flatnonzero(fresh)
    if not len(edge):
        return key, low[:0], high[:0], None if check is None else check[:0]
    return key[edge], np.minimum.reduceat(low[order], edge), np.maximum.reduceat(high[order], edge), None if check is None else check[edge]


def _blobs(ddl: str, chunk: int, n_buckets: int, key: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One row per bucket that has entries: key (sorted) and the columns beside it, cut at the buckets' edges."""
    edges = split_sorted(key, n_buckets)
    some = [i for i in range(n_buckets) if edges[i] < edges[i + 1]]
    return table(ddl, some, [chunk] * len(some), *[[c[edges[i] : edges[i + 1]].tobytes() for i in some] for c in (key, *columns)])


def _joined(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in column]) if len(column) else np.zeros(0, kind)


def _lengths(column, width: int) -> np.ndarray:
    return np.array([len(x.as_py()) // width for x in column], np.int64)


def entries(docs: DataFrame, n_buckets: int, size: int = SIZE) -> DataFrame:
    """RUN rows: for each chunk and bucket the anchors' hashes in order, the smallest and largest doc_id of each, and its chunk."""

    def run(t: pa.Table) -> pa.Table:
        keys, ids = [], []
        doc = _ids(t["doc_id"])
        for i, part in text_steps(t["text"]):
            w = Words(part, size)
            a = w.anchors()
            d = doc[i + w.doc[w.start]]
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
            keys.append(a[fresh])
            ids.append(d[fresh])
        key, low, high, _ = _smallest(np.concatenate(keys), np.concatenate(ids), np.concatenate(ids))
        chunk = t["chunk"][0].as_py()
        return _blobs(RUN, chunk, n_buckets, key, low, high, np.full(len(key), chunk, np.int32))

    return by_group(docs, "chunk", run, RUN)


class FingerprintIndex:
    """Sorted immutable runs below a folder; each is a Parquet table of RUN rows."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int):
        self.spark, self.path, self.n_buckets = spark, path, n_buckets
        self.runs: list[str] = []
        self.written = 0

    def write(self, docs: DataFrame, size: int = SIZE) -> str:
        """Writes the anchors of a batch (dealt by chunked()) as a run that add() makes part of the index."""
        at = f"{self.path}/run-{self.written:05d}"
        entries(docs, self.n_buckets, size).write.parquet(at)
        self.written += 1
        return at

    def add(self, run: str) -> None:
        """Makes a written run part of the index; compacts when there are too many."""
        self.runs.append(run)
        if len(self.runs) > FANOUT:
            self.compact()

    def append(self, docs: DataFrame, size: int = SIZE) -> None:
        self.add(self.write(docs, size))

    def read(self, *runs: str) -> DataFrame:
        return self.spark.read.schema(RUN.replace(",", ", ").replace("bigint", "long")).parquet(*runs)

    def rows(self) -> DataFrame:
        return self.read(*self.runs)

    def matched(self, batch: str) -> DataFrame:
        """SHARED rows: for each chunk the anchors of a written run that stand in two or more documents of it and the index, by a merge join of the sorted runs."""

        def merge(t: pa.Table) -> pa.Table:
            key, low, high = _joined(t["hashes"], np.uint64), _joined(t["lows"], np.int64), _joined(t["highs"], np.int64)
            owner = _joined(t["owners"], np.int32)
            new = np.repeat(t["new"].to_numpy(zero_copy_only=False), _lengths(t["hashes"], 8))
            k, lo, hi, _ = _smallest(key, low, high)
            hit = np.isin(key, k[lo != hi]) & np.isin(key, key[new])
            key, owner = key[hit], owner[hit]
            order = np.argsort(owner, kind="stable")
            key, owner = key[order], owner[order]
            edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
            return table(SHARED, owner[edge], [x.tobytes() for x in np.split(key, edge[1:])] if len(edge) else [])

        rows = self.read(batch).withColumn("new", F.lit(True))
        if self.runs:
            rows = rows.unionByName(self.rows().withColumn("new", F.lit(False)))
        return by_group(rows, "bucket", merge, SHARED)

    def compact(self) -> None:
        """Merges all runs into one: a row per bucket (chunk -1) with an entry per distinct anchor and chunk."""

        def merge(t: pa.Table) -> pa.Table:
            key, low, high, owner = _smallest(_joined(t["hashes"], np.uint64), _joined(t["lows"], np.int64), _joined(t["highs"], np.int64), _joined(t["owners"], np.int32))
            return table(RUN, [t["bucket"][0].as_py()], [-1], [key.tobytes()], [low.tobytes()], [high.tobytes()], [owner.tobytes()])

        at = f"{self.path}/compacted-{self.written:05d}"
        by_group(self.rows(), "bucket", merge, RUN).write.parquet(at)
        self.runs = [at]


def verified(docs: DataFrame, shared: DataFrame, n_buckets: int, size: int = SIZE) -> DataFrame:
    """HITS rows: for each chunk the hashes of its windows that start in a document smaller than one of its own, with that smallest doc_id."""

    def windows(t: pa.Table, other: pa.Table) -> pa.Table:
        wanted = np.sort(_joined(other["hashes"], np.uint64))
        if not len(wanted):
            return empty(SEEN)
        doc, keys, checks, ids = _ids(t["doc_id"]), [], [], []
        for i, part in text_steps(t["text"]):
            w = Words(part, size)
            a = w.anchors()
            at = np.minimum(np.searchsorted(wanted, a), len(wanted) - 1)
            start = w.start[wanted[at] == a]
            k, c = w.window_hashes(start)
            keys.append(k)
            checks.append(c)
            ids.append(doc[i + w.doc[start]])
        ids = np.concatenate(ids)
        key, low, high, check = _smallest(np.concatenate(keys), ids, ids, np.concatenate(checks))
        return _blobs(SEEN, t["chunk"][0].as_py(), n_buckets, key, check, low, high)

    def smallest(t: pa.Table) -> pa.Table:
        key, check = _joined(t["hashes"], np.uint64), _joined(t["checks"], np.uint32)
        low, high = _joined(t["lows"], np.int64), _joined(t["highs"], np.int64)
        owner = np.repeat(t["chunk"].to_numpy(), _lengths(t["hashes"], 8))
        order = np.lexsort((check, key))
        key, check, low, high, owner = key[order], check[order], low[order], high[order], owner[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
        group = np.cumsum(fresh) - 1
        least = np.minimum.reduceat(low, np.flatnonzero(fresh))[group]
        hit = high > least
        key, check, least, owner = key[hit], check[hit], least[hit], owner[hit]
        order = np.argsort(owner, kind="stable")
        key, check, least, owner = key[order], check[order], least[order], owner[order]
        edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
        cut = (lambda x: [y.tobytes() for y in np.split(x, edge[1:])]) if len(edge) else (lambda x: [])
        return table(HITS, owner[edge], cut(key), cut(check), cut(least))

    return by_group(answer(docs, shared, windows, SEEN), "bucket", smallest, HITS)


def removals(docs: DataFrame, hits: DataFrame, size: int = SIZE, with_text: bool = False) -> DataFrame:
    """Per document: n_words, n_removed, the digest of what is kept, and (with_text) the kept words, joined by one blank."""
    ddl = OUT + (",kept string" if with_text else "")

    def run(t: pa.Table, other: pa.Table) -> pa.Table:
        key, check, least = _joined(other["hashes"], np.uint64), _joined(other["checks"], np.uint32), _joined(other["lows"], np.int64)
        order = np.lexsort((check, key))
        key, check, least = key[order], check[order], least[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)  # among windows of one first hash
        doc, n_words, n_removed, digest, kept_texts = _ids(t["doc_id"]), [], [], [], []
        for i, part in text_steps(t["text"]):
            gone = None
            if len(key):
                w = Words(part, size)
                h, c = w.window_hashes(w.start)
                at, dup = np.searchsorted(key, h), np.zeros(len(h), bool)
                for k in range(int(rank.max()) + 1):  # one round, but where first hashes collide
                    p = np.minimum(at + k, len(key) - 1)
                    dup |= (key[p] == h) & (check[p] == c) & (least[p] < doc[i + w.doc[w.start]])
                if dup.any():
                    gone = covered(w.start[dup], size, len(w.doc))
                    removed = np.bincount(w.doc[gone], minlength=w.n)
            for k, (a, z) in enumerate(zip(part.begin.tolist(), part.end.tolist(), strict=True)):
                words = part.buf[a:z].tobytes().split()
                n_words.append(len(words))
                if gone is not None and removed[k]:
                    f = w.first[k]
                    words = list(compress(words, (~gone[f : f + len(words)]).tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
        return table(ddl, t["doc_id"], n_words, n_removed, digest, *([kept_texts] if with_text else []))

    return answer(docs, hits, run, ddl)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dedup(docs: DataFrame, size: int = SIZE, batches: int = 2, path: str | None = None, with_text: bool = False) -> DataFrame:
    """Takes a table in `batches` batches in order of doc_id: each is matched and verified against the index and itself, then becomes a run of the index."""
    spark = docs.sparkSession
    total = text_bytes(docs)
    n_buckets = buckets_for(spark, total)
    path = path or shared_path(spark, "window-index")
    index = FingerprintIndex(spark, path, n_buckets)
    edges = [float("-inf")]
    if batches > 1:  # a summary of bounded size
        cuts = docs.where("doc_id is not null").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) or []
        edges += [x for x in sorted(set(cuts))]
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("inf")))
    outs = []
    for i, low in enumerate(edges):
        so_far = key <= edges[i + 1] if i + 1 < len(edges) else F.lit(True)
        batch = chunked(docs.where(so_far & (key > low) if i else so_far), total=total)
        run = index.write(batch, size)
        release(spark)
        hits = verified(chunked(docs.where(so_far), total=total), index.matched(run), n_buckets, size)
        outs.append(f"{path}/out-{i:05d}")
        removals(batch, hits, size, with_text).write.parquet(outs[-1])
        index.add(run)
        release(spark)
    return spark.read.schema((OUT + (",kept string" if with_text else "")).replace(",", ", ")).parquet(*outs)


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


OP8_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)),
least_id AS (SELECT h, min(doc_id) AS m, count(*) AS n FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i FROM win JOIN least_id USING (h) WHERE m < doc_id OR (doc_id IS NULL AND m IS NOT NULL)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM hit),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM doc),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.j) FILTER (gone.j IS NULL) AS s, count(gone.j) AS n FROM word LEFT JOIN gone ON word.r = gone.r AND word.j = gone.j GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)
"""
