"""Tokens and their tags: encoding spans as BIOES or BIO, decoding tags, sliding windows and merging their predictions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokenised
from .ranges import overlapping

#: Predictions that are merged at once.
PREDICTIONS = 1 << 17

# Tokens of texts with their spans at hand. Where tokens are made from texts, a document's spans go to its text, not its tokens to its
# spans: only texts and spans are shuffled, and tokens that nobody asks for never leave the pass that makes them.


def beside_texts(docs: DataFrame, **sides: DataFrame) -> DataFrame:
    """(doc_id, text, a column of sorted (start, end, label) a side): documents with their spans, null if a side has none."""
    every = None
    for name, spans in sides.items():
        one = spans.select("doc_id", F.struct("start", "end", "label").alias("x"), F.lit(name).alias("side")).where("x.start IS NOT NULL AND x.end IS NOT NULL")
        every = one if every is None else every.unionByName(one)
    lists = every.groupBy("doc_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("x")))).alias(name) for name in sides])
    return docs.select("doc_id", "text").join(lists, "doc_id", "left")


def places(tokens: pa.RecordBatch, doc: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first, behind the last) of the tokens that each span of the lists overlaps, and the spans' labels. doc: the list that a token belongs to.

    Documents are laid end to end, each as long as its tokens reach: what of a span lies outside meets no token."""
    start, end = (tokens.column(c).to_numpy().astype(np.int64) for c in ("start", "end"))
    reach = np.zeros(len(lists), np.int64)
    reach[doc] = end  # the last token's stays
    base = np.cumsum(reach + 1) - reach - 1
    whose, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    s, e = (base[whose] + np.clip(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64), 0, reach[whose]) for k in (0, 1))
    return np.searchsorted(base[doc] + end, s, side="right"), np.searchsorted(base[doc] + start, e, side="left"), flat.field(2)


def covered(tokens: pa.RecordBatch, doc: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Which tokens lie under any span."""
    first, behind, _ = places(tokens, doc, lists)
    some, edge = behind > first, np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, first[some], 1)
    np.add.at(edge, behind[some], -1)
    return np.cumsum(edge[:-1]) > 0


def owned(tokens: pa.RecordBatch, doc: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(token, its place in its span's tokens, how many those are, its span's label) of the tokens under spans: each belongs to the earliest that it overlaps.

    Spans come in order, so the tokens of one begin behind all that earlier ones have."""
    first, behind, labels = places(tokens, doc, lists)
    so_far = np.maximum.accumulate(np.append(0, behind))[:-1]
    begin = np.maximum(first, so_far)
    size = np.maximum(0, behind - begin)
    which = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return begin[which] + at, at, size[which], labels.take(pa.array(which))


def prefixes(at: np.ndarray, size: np.ndarray, scheme: str) -> np.ndarray:
    """0 to 3 for B, I, E and S."""
    inner = np.where(at == 0, 0, 1)
    return inner if scheme == "bio" else np.where(size == 1, 3, np.where((at > 0) & (at == size - 1), 2, inner))


def encode_texts(docs: DataFrame, spans: DataFrame, scheme: str = "bioes", outside: bool = True) -> DataFrame:
    """(doc_id, ix, start, end, tag): encode() for the tokens of texts; without `outside` only those under spans. docs: (doc_id, text), one row an id."""
    if scheme not in ("bioes", "bio"):
        raise ValueError(f"unknown scheme {scheme}")

    def tag(tokens, doc, rows):
        mine, at, size, labels = owned(tokens, doc, rows.column(0))
        head = pa.array(["B-", "I-", "E-", "S-"]).take(pa.array(prefixes(at, size, scheme)))
        tags = pc.fill_null(pc.binary_join_element_wise(head, labels.cast(pa.string()), ""), "O")
        if outside:
            which = np.zeros(len(doc), np.int64)
            which[mine] = np.arange(1, len(mine) + 1)
            return pa.RecordBatch.from_arrays([*tokens.columns, pa.concat_arrays([pa.array(["O"]), tags]).take(pa.array(which))], names=[*tokens.schema.names, "tag"])
        return pa.RecordBatch.from_arrays([*tokens.take(pa.array(mine)).columns, tags], names=[*tokens.schema.names, "tag"])

    d = beside_texts(docs, spans=spans)
    return tokenised(d, found=False, then=(tag, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ix int, start int, end int, tag string"), beside=["spans"])


def under_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, ix, start, end): the tokens of texts that lie under any span. docs: (doc_id, text), one row an id."""

    def keep(tokens, doc, rows):
        return tokens.filter(pa.array(covered(tokens, doc, rows.column(0))))

    d = beside_texts(docs, spans=spans)
    return tokenised(d, found=False, then=(keep, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ix int, start int, end int"), beside=["spans"])


def encode(tokens: DataFrame, spans: DataFrame, scheme: str = "bioes") -> DataFrame:
    """(doc_id, ix, tag): a token belongs to the earliest span that it overlaps, one without extent to none. tokens: (doc_id, ix, start, end)."""
    if scheme not in ("bioes", "bio"):
        raise ValueError(f"unknown scheme {scheme}")
    s = spans.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("label").alias("l"))
    own = overlapping(tokens.select("doc_id", "ix", "start", "end").where("start < end"), s).groupBy("doc_id", "ix").agg(F.min(F.struct("s", "e", F.col("l").alias("label"))).alias("span"))
    w = W.partitionBy("doc_id", "span")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("ix"))
    prefix = F.when((n == 1) & F.lit(scheme == "bioes"), "S-").when(i == 1, "B-").when((i == n) & F.lit(scheme == "bioes"), "E-").otherwise("I-")
    tags = own.select("doc_id", "ix", F.concat(prefix, "span.label").alias("tag"))
    return tokens.select("doc_id", "ix").join(tags, ["doc_id", "ix"], "left").select("doc_id", "ix", F.coalesce("tag", F.lit("O")).alias("tag"))


def decode(tagged: DataFrame, reduce: str = "mean", sparse: bool = False) -> DataFrame:
    """(doc_id, start, end, label, score) from rows (doc_id, ix, start, end, tag, prob); tolerant of tags out of order. Empty tokens don't count.
    `sparse`: tokens tagged O may be missing; a gap between two ix is one (then no token is without extent)."""
    w = W.partitionBy("doc_id").orderBy("ix")
    t = tagged.where("start <> end").withColumn("p", F.substring("tag", 1, 1)).withColumn("label", F.regexp_replace("tag", r"(?i)^[BIESLU]-", ""))
    before = lambda c: F.lag(c).over(w)
    new = F.col("p").isin("B", "S") | before("tag").isNull() | (before("tag") == "O") | before("p").isin("E", "S") | (before("label") != F.col("label"))
    if sparse:
        new = new | (before("ix") != F.col("ix") - 1)
    t = t.withColumn("new", ((F.col("tag") != "O") & new).cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    score = F.min("prob") if reduce == "min" else F.avg("prob")
    return t.where("tag <> 'O'").groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label"), score.alias("score")).drop("island")


def windows(n: Column, longest: int, stride: int) -> Column:
    """Array of (first, last) of sliding windows over n tokens: they begin every longest - stride tokens; the first that reaches the end is the last."""
    if longest <= 0 or stride >= longest:
        raise ValueError("windows don't advance")
    step = longest - stride
    last = F.when(n <= longest, 0).otherwise(F.ceil((n - longest) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).alias("first"), F.least(n, k * step + longest).cast("int").alias("last")))


def merge_windows(predictions: DataFrame, latest: bool = False) -> DataFrame:
    """One prediction a token from rows (doc_id, window, k, size, ix, tag, prob): that whose token stands farthest from its window's ends, then the earlier window's; with `latest` then by largest tag, probability and window."""
    inner = F.least(F.col("k"), F.col("size") - 1 - F.col("k")).desc()
    ties = [F.col(c).desc() for c in ("tag", "prob", "window")] if latest else ["window"]
    w = W.partitionBy("doc_id", "ix").orderBy(inner, *ties)
    return predictions.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "ix", "tag", "prob")


def merge_nested_windows(docs: DataFrame) -> DataFrame:
    """merge_windows() where a document's windows are in one row: (doc_id, windows array<struct<first: int, tags, probs>>), tags and probs those of the
    tokens from `first` on -> (doc_id, ix, tag, prob), in order. A narrow pass: no prediction is shuffled or sorted by the engine."""
    d = docs.select("doc_id", F.transform("windows", lambda w: F.struct(w["first"].cast("int").alias("first"), w["tags"].alias("tags"), w["probs"].alias("probs"))).alias("windows"))

    def merged(ids: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        flat = lists.flatten()
        tags, probs, whose = flat.field(1), flat.field(2), pc.list_parent_indices(lists).to_numpy()
        window = pc.list_parent_indices(tags).to_numpy()
        size = np.bincount(window, minlength=len(flat))
        k = np.arange(len(window)) - (np.cumsum(size) - size)[window]
        first = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ix, doc = first[window] + k, whose[window]
        low, reach = int(ix.min(initial=0)), int(ix.max(initial=0)) - int(ix.min(initial=0)) + 1
        cell = doc * reach + ix - low
        if len(lists) * reach > 8 * len(ix):  # number what is there, not what could be
            _, cell = np.unique(cell, return_inverse=True)
        rank = np.minimum(k, size[window] - 1 - k) * (len(flat) + 1) + len(flat) - window
        best = np.full(int(cell.max(initial=-1)) + 1, -1)
        np.maximum.at(best, cell, rank)
        won = np.flatnonzero(rank == best[cell])
        won = won[np.argsort(cell[won], kind="stable")]
        at = pa.array(won)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc[won])), pa.array(ix[won].astype(np.int32)), tags.flatten().take(at), probs.flatten().take(at)], names=["doc_id", "ix", "tag", "prob"])

    def run(batches):
        for b in batches:
            lists = b.column("windows")
            n = np.zeros(len(lists), np.int64)
            np.add.at(n, pc.list_parent_indices(lists).to_numpy(), pc.fill_null(pc.list_value_length(lists.flatten().field(1)), 0).to_numpy(zero_copy_only=False))
            ends = np.cumsum(n)
            i = done = 0
            while i < len(ends):
                j = max(i + 1, int(np.searchsorted(ends, done + PREDICTIONS, side="right")))
                yield merged(b.column("doc_id").slice(i, j - i), lists.slice(i, j - i))
                i, done = j, ends[j - 1]

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ix int, tag string, prob double")


def label_probability(dist: DataFrame, spans: DataFrame, reduce: str = "mean") -> DataFrame:
    """(doc_id, start, end, label, p): a span's mass of the tags of its label over its tokens. dist: (doc_id, ix, ts, te, tag, p)."""
    key = ["doc_id", "start", "end", "label"]
    d = dist.where("ts <> te").withColumn("tag_label", F.regexp_replace("tag", r"(?i)^[BIESLU]-", ""))
    per = overlapping(spans.select(*key).distinct(), d, b_at=("ts", "te")).groupBy(*key, "ix").agg(F.sum(F.when(F.col("tag_label") == F.col("label"), F.col("p")).otherwise(0.0)).alias("m"))
    got = per.groupBy(*key).agg((F.min("m") if reduce == "min" else F.avg("m")).alias("p"))
    return spans.select(*key).join(got, key, "left").fillna(0.0, ["p"])
