"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits. The anchors are the words of a covering code: nine Hamming (7, 4) codes and one free bit, so
every fingerprint lies within radius 9 of an anchor and the nearest one is found without search. Two fingerprints at most
THRESHOLD = 2 bits apart have a point between them that is within 1 bit of both, and both are within (covering radius +
1) of that point's anchor. So a fingerprint is replicated to the anchors of all points within 1 bit (26 on average), and
fingerprints are compared only at an anchor they share. Copies collapse first: one row per distinct fingerprint.

At an anchor, small groups are compared by the bits that differ; a larger group is sorted by the points within 1 bit of
each member (65 each), where linked members meet, so the work stays linear in the group. Links leave an anchor as a
forest, never as all pairs. Anchors are dealt out by hash; a group holds distinct fingerprints only, so copies cannot
swell it. Components come from alternating large-star and small-star rounds on DataFrames, cut by checkpoints.

Cases: a text without words has fingerprint zero and is linked like any other; null texts are empty; a null doc_id never
names a component, one made only of such rows has a null component_id; repeated rows are each reported; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, documents, text_steps

SHINGLE = 3
THRESHOLD = 2
SEED = 42
#: A fingerprint with more than one in so many rows is joined back by broadcast; there are at most so many.
HOT_SHARE = 1000
#: Up to this many fingerprints at an anchor are compared bit by bit.
SMALL_GROUP = 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes) -> int:
    """The SimHash of the 3-word shingles of a text."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxh64_intdigest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def raw_texts(column):
    """The texts as UTF-8 bytes, a few megabytes at a time."""
    for _, t in text_steps(column):
        for i, j in zip(t.begin.tolist(), t.end.tolist(), strict=True):
            yield t.buf[i:j].tobytes()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) per document; fp is the fingerprint as a signed 64-bit number."""

    def run(batches):
        for b in batches:
            out = np.fromiter((fingerprint(x) for x in raw_texts(b.column(2))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _code() -> np.ndarray:
    """For each 7-bit value the nearest word of the Hamming (7, 4) code."""
    words = []
    for w in range(128):
        syndrome = 0
        for i in range(7):
            if w >> i & 1:
                syndrome ^= i + 1
        words.append(w ^ (1 << (syndrome - 1)) if syndrome else w)
    return np.array(words, np.uint64)


NEAREST = _code()
ONE = np.uint64(1)


def anchors(points: np.ndarray) -> np.ndarray:
    """The anchor nearest to each point: block by block, the last bit as it is."""
    out = points & (ONE << np.uint64(63))
    for i in range(9):
        shift = np.uint64(7 * i)
        out |= NEAREST[((points >> shift) & np.uint64(127)).astype(np.int64)] << shift
    return out


def near_anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint): each fingerprint at the anchors of all points within 1 bit of it, each once."""
    flips = np.append(np.uint64(0), ONE << np.arange(64, dtype=np.uint64))
    at = anchors((fp[:, None] ^ flips[None]).ravel()).reshape(len(fp), 65)
    at.sort(axis=1)
    fresh = np.ones(at.shape, bool)
    fresh[:, 1:] = at[:, 1:] != at[:, :-1]
    return at[fresh], np.repeat(fp, fresh.sum(axis=1))


def forest(fp: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links among distinct fingerprints of one anchor: as few as join what is linked."""
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    place = {int(x): i for i, x in enumerate(fp)}

    def join(i, j):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((int(fp[i]), int(fp[j])))

    if len(fp) <= SMALL_GROUP:
        apart = np.bitwise_count(fp[:, None] ^ fp[None])
        for i, j in zip(*np.nonzero(np.triu(apart <= threshold, 1)), strict=True):
            join(int(i), int(j))
        return links
    flips = np.append(np.uint64(0), ONE << np.arange(64, dtype=np.uint64))
    if threshold == 1:  # a member's points meet other members themselves
        ordered = np.sort(fp)
        for i, points in enumerate(fp[:, None] ^ flips[None, 1:]):
            at = np.minimum(np.searchsorted(ordered, points), len(fp) - 1)
            for x in points[ordered[at] == points].tolist():
                join(i, place[x])
        return links
    who = np.repeat(np.arange(len(fp), dtype=np.int32), 65)
    points = (fp[:, None] ^ flips[None]).ravel()
    order = np.argsort(points, kind="stable")
    same = np.flatnonzero(points[order][1:] == points[order][:-1])
    for i, j in zip(who[order][same].tolist(), who[order][same + 1].tolist(), strict=True):
        join(i, j)
    return links


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all that are at most `threshold` (2 or fewer) bits apart."""
    if not 1 <= threshold <= 2:
        raise ValueError("anchors within 1 bit of both cover thresholds 1 and 2")

    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 20_000):
                at, who = near_anchors(fp[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(who.view(np.int64))], names=["anchor", "fp"])

    def compare(batches):
        held = None
        for b in batches:  # rows come sorted by anchor; the last group of a batch may go on in the next
            at, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            if held is not None:
                at, fp = np.concatenate([held[0], at]), np.concatenate([held[1], fp])
            if not len(at):
                continue
            last = np.searchsorted(at, at[-1])
            yield out(at[:last], fp[:last])
            held = at[last:], fp[last:]
        if held is not None:
            yield out(*held)

    def out(at, fp):
        pairs = []
        if len(at):
            edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            size = np.diff(np.append(edge, len(at)))
            for e, n in zip(edge[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                pairs += forest(fp[e : e + n].view(np.uint64), threshold)
        p = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])

    spread_out = distinct.select("fp").mapInArrow(spread, "anchor long, fp long")
    return spread_out.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): each node that has a link, and the smallest node it is joined to. Large-star and small-star rounds until nothing changes."""
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()

    def star(e: DataFrame, large: bool) -> DataFrame:
        # each node's smallest neighbour (itself included); hubs are summed before the exchange and joined back
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(low, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    mark = None
    for _ in range(most_rounds):
        e = star(star(e, True), False).checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def grouped(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, keeper_id, keeper_hash): each document with its group's smallest doc_id and the row to keep of it."""
    checkpoint_dir(docs.sparkSession)
    prints = fingerprints(docs).checkpoint()
    total = prints.count()
    first = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash")
    distinct = prints.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("copies"))
    joined = components(links(distinct, threshold))
    named = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "copies")
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    by_fp = named.select("fp", "root", "copies").join(best, "root").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.doc_id").alias("keeper_id"), F.col("best.text_hash").alias("keeper_hash"), (F.col("copies") * HOT_SHARE > total).alias("hot")).checkpoint()
    # at most HOT_SHARE fingerprints have more than that share of all rows each: their copies stay where they are
    hot = F.broadcast(by_fp.where("hot"))
    apart = prints.join(hot, "fp").unionByName(prints.join(hot.select("fp"), "fp", "left_anti").join(by_fp.where("NOT hot"), "fp"))
    return apart.select("doc_id", "text_hash", "fp", "component_id", "keeper_id", "keeper_hash")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group: the one of the smallest doc_id (of equal ids, the smallest text hash); rows that repeat it go."""
    names, own = docs.columns, F.xxhash64(F.col("text").cast("string"))
    key = "__text_hash"
    while key in names:
        key += "_"
    keep = grouped(docs, threshold).select("keeper_id", "keeper_hash").distinct()
    d = docs.withColumn(key, own)
    out = d.join(keep, d["doc_id"].cast("long").eqNullSafe(keep["keeper_id"]) & (d[key] == keep["keeper_hash"]), "left_semi")
    return out.dropDuplicates(["doc_id", key]).select(*names)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(documents(spark, sf_dir))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
