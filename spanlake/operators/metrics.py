"""Matching predicted spans with gold ones, and what is counted from it."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digests import md5_heads
from ..functions.labels import frequency_bucket, is_hipaa, relabel
from ..functions.text import tokenised
from .ranges import islands, overlapping
from .tokens import beside_texts, covered

KEY = ("start", "end", "label")


def prepare(spans: DataFrame, level: str = "subtype", hipaa: bool = False) -> DataFrame:
    s = spans.where(is_hipaa(F.col("label"), F.col("text"))) if hipaa else spans
    return s.withColumn("label", relabel(F.col("label"), level))


def match(gold: DataFrame, pred: DataFrame, mode: str = "strict", extents: bool = False) -> DataFrame:
    """(doc_id, gold_label, pred_label), with `extents` the gold span's start and end too: one row per pair, per missed gold span (pred_label null) and per spurious one (gold_label null).

    strict: equal extent and label, as an equi join of numbered repeats. relaxed (overlap and equal label) and typeless
    (overlap): gold spans in order take the best free prediction, as a fold over spans of both sides that hang together."""
    if mode == "strict":
        n = F.row_number().over(W.partitionBy("doc_id", *KEY).orderBy("source"))
        g = gold.withColumn("n", n).select("doc_id", *KEY, "n", F.col("label").alias("gold_label"))
        p = pred.withColumn("n", n).select("doc_id", *KEY, "n", F.col("label").alias("pred_label"))
        return g.join(p, ["doc_id", *KEY, "n"], "full").select("doc_id", "gold_label", "pred_label", *(KEY[:2] if extents else ()))
    if mode not in ("relaxed", "typeless"):
        raise ValueError(f"unknown mode {mode}")
    both = gold.select("doc_id", *KEY, F.lit("g").alias("side")).unionByName(pred.select("doc_id", *KEY, F.lit("p").alias("side")))
    side = lambda x: F.array_sort(F.collect_list(F.when(F.col("side") == x, F.struct(*KEY)))).alias(x)
    d = islands(both).groupBy("doc_id", "island").agg(side("g"), side("p"))
    label = "AND p[j].label = x.label" if mode == "relaxed" else ""
    taken = f"""aggregate(g, CAST(array() AS array<int>), (used, x) -> concat(used, array(coalesce(-array_max(transform(
        filter(sequence(0, size(p) - 1), j -> size(p) > 0 AND NOT array_contains(used, j) AND p[j].start < x.end AND x.start < p[j].end {label}),
        j -> struct(IF(p[j].start = x.start AND p[j].end = x.end, 1, 0) AS e, least(p[j].end, x.end) - greatest(p[j].start, x.start) AS o, -j AS j))).j, -1))))"""
    d = d.withColumn("used", F.expr(taken))
    where = [F.col(f"x.{c}").alias(c) for c in KEY[:2]] if extents else []
    hit = d.select("doc_id", F.posexplode("g").alias("i", "x"), "used", "p").select("doc_id", F.col("x.label").alias("gold_label"), F.expr("IF(used[i] >= 0, p[greatest(used[i], 0)].label, NULL)").alias("pred_label"), *where)
    spare = d.select("doc_id", F.posexplode("p").alias("i", "x"), "used").where(~F.array_contains("used", F.col("i"))).select("doc_id", F.lit(None).cast("string").alias("gold_label"), F.col("x.label").alias("pred_label"))
    return hit.unionByName(spare, allowMissingColumns=True)


def doc_counts(matched: DataFrame) -> DataFrame:
    """(doc_id, label, tp, fp, fn): hits and misses under the gold label, spurious ones under their own."""
    both = F.col("gold_label").isNotNull() & F.col("pred_label").isNotNull()
    return matched.groupBy("doc_id", F.coalesce("gold_label", "pred_label").alias("label")).agg(F.sum(both.cast("long")).alias("tp"), F.sum(F.col("gold_label").isNull().cast("long")).alias("fp"), F.sum(F.col("pred_label").isNull().cast("long")).alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    tp, fp, fn = F.col(tp), F.col(fp), F.col(fn)
    return [F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1")]


def per_label(counts: DataFrame) -> DataFrame:
    c = counts.groupBy("label").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    return c.select("label", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), *prf())


def report(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: micro and macro scores, and the share of documents that leak. Counts of documents outside docs don't matter."""
    counts = counts.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    labels = counts.groupBy("label").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    supported = F.col("tp") + F.col("fn") > 0
    exact = [ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))]
    total = labels.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")], *[F.round(F.coalesce(F.avg(F.when(supported, e)), F.lit(0.0)), 6).alias(n) for e, n in zip(exact, ("macro_precision", "macro_recall", "macro_f1"), strict=True)])
    by_doc = docs.select("doc_id").join(counts.groupBy("doc_id").agg(F.sum("fn").alias("fn"), F.sum(F.col("tp") + F.col("fn")).alias("gold")), "doc_id", "left")
    leaked = F.sum((F.col("fn") > 0).cast("long"))
    leaks = by_doc.agg(F.count("*").alias("n_docs"), F.coalesce(leaked, F.lit(0)).alias("n_leaked"), F.sum((F.col("gold") > 0).cast("long")).alias("n_gold_docs"))
    return total.crossJoin(leaks).select("*", *prf(), F.round(ratio(F.col("n_leaked"), F.col("n_docs")), 6).alias("leak_rate"), F.round(ratio(F.col("n_leaked"), F.col("n_gold_docs")), 6).alias("leak_rate_gold"))


def token_prf(tokens: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: tokens under gold spans, predicted spans, both. tokens: (doc_id, ix, start, end)."""
    t = tokens.select("doc_id", "ix", F.col("start").alias("ts"), F.col("end").alias("te"))

    def under(spans):
        return overlapping(t, spans.select("doc_id", "start", "end"), ("ts", "te"), ("start", "end")).select("doc_id", "ix").distinct()

    both = under(gold).withColumn("g", F.lit(1)).join(under(pred).withColumn("p", F.lit(1)), ["doc_id", "ix"], "full")
    c = both.agg(*[F.coalesce(F.sum(F.expr(f"CAST({e} AS BIGINT)")), F.lit(0)).alias(n) for n, e in (("tp", "g = 1 AND p = 1 AND g IS NOT NULL AND p IS NOT NULL"), ("fp", "g IS NULL"), ("fn", "p IS NULL"))])
    return c.select("*", *prf())


def token_prf_of_texts(docs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """token_prf() for the tokens of texts, counted where they are made. docs: (doc_id, text), one row an id."""

    def count(tokens, doc, rows):
        g, p = (covered(tokens, doc, rows.column(c)) for c in ("gold", "pred"))
        return pa.RecordBatch.from_arrays([pa.array([int(x.sum())], pa.int64()) for x in (g & p, p & ~g, g & ~p)], names=["tp", "fp", "fn"])

    c = tokenised(beside_texts(docs, gold=gold, pred=pred), found=False, then=(count, "tp bigint, fp bigint, fn bigint"), beside=["gold", "pred"])
    return c.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")]).select("*", *prf())


def by_bucket(counts: DataFrame, train: DataFrame) -> DataFrame:
    """(bucket, tp, fp, fn, ...) by how often a label is in training. train: (label, n)."""
    c = counts.groupBy("label").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]).join(F.broadcast(train), "label", "left")
    return c.groupBy(frequency_bucket(F.coalesce("n", F.lit(0))).alias("bucket")).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]).select("bucket", "tp", "fp", "fn", *prf())


def misses(gold: DataFrame, systems: dict[str, DataFrame], mode: str = "strict") -> DataFrame:
    """Gold spans with a column miss_<system>: that system matches no gold span of their extent and label."""
    out = gold
    for name, pred in systems.items():
        if mode == "strict":
            found = pred.select("doc_id", *KEY)
        else:
            found = match(gold, pred, mode, True).where("gold_label is not null and pred_label is not null").select("doc_id", *KEY[:2], F.col("gold_label").alias("label"))
        found = found.distinct().withColumn(f"miss_{name}", F.lit(False))
        out = out.join(found, ["doc_id", *KEY], "left").withColumn(f"miss_{name}", F.coalesce(f"miss_{name}", F.lit(True)))
    return out


def shared_misses(missed: DataFrame, names: list[str], by: str | None = None) -> DataFrame:
    """n_gold, n_all and n_any: gold spans, those that all systems miss, those that any misses; over all spans, or by group."""
    flags = [F.col(f"miss_{x}") for x in names]
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    every, some = flags[0], flags[0]
    for f in flags[1:]:
        every, some = every & f, some | f
    return missed.groupBy(*([by] if by else [])).agg(F.count("*").alias("n_gold"), total(every).alias("n_all"), total(some).alias("n_any"))


def complementarity(missed: DataFrame, a: str, b: str, by: str | None = None) -> DataFrame:
    """What two systems miss, together and alone: over all spans, or by group."""
    ma, mb = F.col(f"miss_{a}").cast("long"), F.col(f"miss_{b}").cast("long")
    g = missed.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), F.sum(ma).alias("fn_a"), F.sum(mb).alias("fn_b"), F.sum(ma * mb).alias("both"))
    n, fa, fb, both = (F.col(x) for x in ("n", "fn_a", "fn_b", "both"))
    either, b10, c01 = fa + fb - both, fa - both, fb - both
    agree, chance = ratio(n - b10 - c01, n), ratio(fa * fb + (n - fa) * (n - fb), n * n)
    chi = F.when(b10 + c01 > 0, F.pow(F.greatest(F.lit(0), F.abs(b10 - c01) - 1).cast("double"), 2) / (b10 + c01)).otherwise(0.0)
    return g.select(*([by] if by else []), "n", "fn_a", "fn_b", "both", either.alias("either"), F.round(ratio(both, either), 6).alias("jaccard"), F.round(F.when(n > 0, 1 - both / n).otherwise(0.0), 6).alias("oracle_union_recall"), F.round(F.when(n > 0, 1 - either / n).otherwise(0.0), 6).alias("intersection_recall"), F.round(chi, 6).alias("mcnemar"), F.round(F.when(n == 0, 0.0).when(chance == 1, 1.0).otherwise((agree - chance) / (1 - chance)), 6).alias("kappa"))


def mcnemar_p(chi: float) -> float:
    return math.erfc(math.sqrt(chi / 2)) if chi > 0 else 1.0


def with_p(tests: DataFrame, chi: str = "mcnemar") -> DataFrame:
    """A small table of tests with the p value of each statistic: Spark has no erfc."""

    def each(values: pd.Series) -> pd.Series:
        return values.map(mcnemar_p)

    return tests.withColumn("p", F.pandas_udf(each, "double")(F.coalesce(chi, F.lit(0.0))))


def holm(tests: DataFrame) -> DataFrame:
    """(name, p, adjusted): Holm's correction of a small table of tests."""
    w = W.orderBy("p", "name")
    t = tests.withColumn("i", F.row_number().over(w)).withColumn("m", F.count("*").over(W.partitionBy()))
    return t.withColumn("adjusted", F.max(F.least(F.lit(1.0), (F.col("m") - F.col("i") + 1) * F.col("p"))).over(w.rowsBetween(W.unboundedPreceding, 0))).select("name", "p", "adjusted")


def agreement(gold: DataFrame, systems: dict[str, DataFrame]) -> DataFrame:
    """(system, agreed, tp): of each system's predictions that all other systems make too, how many are right. Strict."""
    key = ["doc_id", *KEY]
    right = gold.select(*key).distinct().withColumn("right", F.lit(1))
    out = None
    for name, pred in systems.items():
        p = pred.select(*key)
        for other, theirs in systems.items():
            if other != name:
                p = p.join(theirs.select(*key).distinct(), key, "left_semi")
        one = p.join(right, key, "left").agg(F.lit(name).alias("system"), F.count("*").alias("agreed"), F.count("right").alias("tp"))
        out = one if out is None else out.unionByName(one)
    return out


#: Where a uniform 32-bit hash passes from one Poisson(1) weight to the next.
POISSON_EDGES = tuple(int(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(10))


def weighted_sums(counts: DataFrame, names: list[str], n_resamples: int, seed: int) -> DataFrame:
    """(r, names): for each resample the sums of columns of counts, each document weighed by its draw; a batch of documents gives a row a resample.
    A draw is the head of the MD5 of "seed:resample:doc_id" (without the last part for a null id)."""
    edges = np.array(POISSON_EDGES, np.int64)

    def heads(ids: pa.Array, r: int) -> np.ndarray:
        if pa.types.is_integer(ids.type) and not ids.null_count and pc.min(ids).as_py() >= 0:
            return md5_heads([f"{seed}:{r}:".encode()], np.zeros(len(ids), np.int64), ids.to_numpy().astype(np.int64))
        return np.array([int(hashlib.md5(":".join([str(seed), str(r), *([] if x is None else [x])]).encode()).hexdigest()[:8], 16) for x in ids.cast(pa.string()).to_pylist()], np.int64)

    def run(batches):
        for b in batches:
            b = b.take(pc.array_sort_indices(b.column("doc_id")))  # neighbours share all but their last digits
            x = np.stack([b.column(c).to_numpy() for c in names], axis=1) if b.num_rows else None
            out = []
            for r in range(n_resamples if b.num_rows else 0):
                weight = np.searchsorted(edges, heads(b.column("doc_id"), r), side="right")
                if weight.any():
                    out.append((r, *(weight @ x).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["r", *names])

    return counts.select("doc_id", *[F.col(c).cast("long").alias(c) for c in names]).mapInArrow(run, ", ".join(f"{c} bigint" for c in ("r", *names)))


def paired_bootstrap(a: DataFrame, b: DataFrame, metric: str = "recall", n_resamples: int = 1000, seed: int = 0, alpha: float = 0.05, docs: DataFrame | None = None) -> DataFrame:
    """One row: a metric of two systems, its difference, the interval (an order statistic, not interpolated) and the p value.

    a, b: doc_counts(). A resample weighs each document by Poisson(1), drawn from an MD5 of resample and id, instead of
    drawing n positions: no numbering of documents, and counts are summed before they are shuffled. docs: the documents that were
    evaluated; those without counts are drawn too (they matter to leak_rate), a count of any other document is an error. Without
    docs they are those with a count of either system."""
    if metric not in ("recall", "precision", "f1", "leak_rate"):
        raise ValueError(f"unknown metric {metric}")
    side = lambda d, x: d.groupBy("doc_id").agg(*[F.sum(c).alias(c + x) for c in ("tp", "fp", "fn")])
    both = side(a, "_a").join(side(b, "_b"), "doc_id", "full")
    if docs is not None:
        both = docs.select("doc_id", F.lit(1).alias("one")).distinct().join(both, "doc_id", "full")
        stray = F.raise_error(F.concat(F.lit("counts of a document that wasn't evaluated: "), F.col("doc_id").cast("string")))
        checked = lambda c: F.when(F.col("one").isNull(), stray.cast("long")).otherwise(F.col(c)).alias(c)
        both = both.select("doc_id", "one", *[checked(c + x) for x in ("_a", "_b") for c in ("tp", "fp", "fn")])
    else:
        both = both.withColumn("one", F.lit(1))
    both = both.fillna(0)
    both = both.select("*", *[(F.col(f"fn{x}") > 0).cast("long").alias(f"leak{x}") for x in ("_a", "_b")])
    names = [c + x for x in ("_a", "_b") for c in ("tp", "fp", "fn", "leak")] + ["one"]

    def value(x: str) -> Column:
        tp, fp, fn = (F.col(c + x) for c in ("tp", "fp", "fn"))
        if metric == "leak_rate":
            return ratio(F.col(f"leak{x}"), F.col("one"))
        return ratio(tp, tp + fn) if metric == "recall" else ratio(tp, tp + fp) if metric == "precision" else ratio(2 * tp, 2 * tp + fp + fn)

    draws = weighted_sums(both, names, n_resamples, seed)
    delta = draws.groupBy("r").agg(*[F.sum(c).alias(c) for c in names]).select((value("_a") - value("_b")).alias("d"))
    spread = delta.agg(F.array_sort(F.collect_list("d")).alias("d"), F.sum((F.col("d") <= 0).cast("long")).alias("le"), F.sum((F.col("d") >= 0).cast("long")).alias("ge"), F.count("*").alias("k"))
    at = lambda q: F.try_element_at("d", (F.floor(q * (F.col("k") - 1)) + 1).cast("int"))
    spread = spread.select(at(F.lit(alpha / 2)).alias("lo"), at(F.lit(1 - alpha / 2)).alias("hi"), F.least(F.lit(1.0), 2 * F.least("le", "ge") / F.col("k")).alias("p"))
    seen = both.agg(F.count("*").alias("n_docs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).select("n_docs", value("_a").alias("value_a"), value("_b").alias("value_b"))
    return seen.crossJoin(spread).select("n_docs", *[F.round(x, 6).alias(n) for n, x in (("value_a", F.col("value_a")), ("value_b", F.col("value_b")), ("delta", F.col("value_a") - F.col("value_b")), ("lo", F.col("lo")), ("hi", F.col("hi")), ("p", F.col("p")))])
