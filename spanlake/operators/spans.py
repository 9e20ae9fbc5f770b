"""The algebra of spans: (doc_id, start, end, label, text, source, score) rows, half-open code-point offsets."""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import UNSUPPORTED
from ..functions.outputs import per_row
from ..functions.text import RESIDUAL
from .ranges import islands

COLUMNS = ("doc_id", "start", "end", "label", "text", "source", "score")


def overlap(a: str, b: str) -> str:
    return f"{a}.start < {b}.end AND {b}.start < {a}.end"


def merge(spans: DataFrame) -> DataFrame:
    """Overlapping spans of one label become one: their whole extent, highest score, sources joined by +. Touching spans stay apart; a merged span has no text."""
    w = W.partitionBy("doc_id", "label").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.withColumn("__new", (before.isNull() | (F.col("start") >= before)).cast("int")).withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    sources = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("source", r"\+"))))), "+")
    return (
        islands.groupBy("doc_id", "label", "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.when(F.count("*") == 1, F.first("text")).otherwise("").alias("text"), F.when(F.count("*") == 1, F.first("source")).otherwise(sources).alias("source"), F.max("score").alias("score"))
        .select(*COLUMNS)
    )


def source_rank(source: Column, priority) -> Column:
    n = len(priority)
    return F.least(F.lit(n), *[F.when(F.array_contains(F.split(source, r"\+"), p), i).otherwise(n) for i, p in enumerate(priority)])


def resolve(spans: DataFrame, priority=("tc", "llm"), min_score: dict | None = None) -> DataFrame:
    """Of overlapping spans with different labels the first stays: by source's rank (a source under its least score ranks last), score, extent. A fold in that order over spans that hang together."""
    rank = source_rank(F.col("source"), priority)
    for source, least in (min_score or {}).items():
        rank = F.when(F.array_contains(F.split("source", r"\+"), source) & (F.col("score").isNull() | (F.col("score") < least)), len(priority)).otherwise(rank)
    s = F.struct(rank.alias("rank"), (-F.coalesce("score", F.lit(0.0))).alias("down"), (F.col("start") - F.col("end")).alias("short"), "start", "end", "label", "text", "source", "score")
    d = islands(spans).groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(s)).alias("all"))
    kept = F.expr("aggregate(all, filter(all, x -> false), (kept, s) -> IF(forall(kept, k -> k.label = s.label OR NOT (k.start < s.end AND s.start < k.end)), concat(kept, array(s)), kept))")
    return d.select("doc_id", F.explode(kept).alias("s")).select("doc_id", *[f"s.{c}" for c in COLUMNS[1:]])


def redact(docs: DataFrame, spans: DataFrame, template: str = "[{label}]") -> DataFrame:
    """(doc_id, text): each covered stretch replaced once, by its first span's label; a text without spans stays."""
    s = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("down"), "label", "end"))).alias("spans"))
    left, right = (x.replace("'", "\\'") for x in template.split("{label}"))
    text = F.expr(f"""aggregate(spans, struct('' AS out, 0 AS at), (a, s) -> IF(s.start >= a.at,
        struct(concat(a.out, substring(text, a.at + 1, s.start - a.at), '{left}', s.label, '{right}') AS out, s.end AS at), struct(a.out AS out, greatest(a.at, s.end) AS at)),
        a -> concat(a.out, substring(text, a.at + 1)))""")
    return docs.join(s, "doc_id", "left").select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(text).alias("text"))


def render_tagged(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text): spans written as tags in order; one that begins inside a tagged one is skipped."""
    s = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    text = F.expr("""aggregate(spans, struct('' AS out, 0 AS at), (a, s) -> IF(s.start >= a.at,
        struct(concat(a.out, substring(text, a.at + 1, s.start - a.at), '<PHI type="', s.label, '">', substring(text, s.start + 1, s.end - s.start), '</PHI>') AS out, s.end AS at), a), a -> concat(a.out, substring(text, a.at + 1)))""")
    return docs.join(s, "doc_id", "left").select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(text).alias("text"))


def rule_spans(text: str):
    """(start, end, label, text) of the rules' matches in order of rule and place; one that overlaps an earlier one goes."""
    taken: list[tuple[int, int]] = []  # apart from each other and in order, so only neighbours can overlap
    for label, pattern in RESIDUAL:
        rx = re.compile(pattern)
        for m in rx.finditer(text):
            start, end = m.span(1 if rx.groups else 0)
            i = bisect_left(taken, (start, end))
            if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                taken.insert(i, (start, end))
                yield start, end, label, text[start:end]


def residual(docs: DataFrame) -> DataFrame:
    """Spans of identifiers found by rule, in one narrow pass over the texts; no rows for empty ones."""
    found = per_row(docs, ["text"], "start int, end int, label string, text string", lambda text: rule_spans(text or ""))
    return found.select("*", F.lit("rule").alias("source"), F.lit(None).cast("double").alias("score"))


def union(spans: DataFrame, priority=("tc", "llm"), min_score: dict | None = None) -> DataFrame:
    return resolve(merge(spans), priority, min_score)


def label_routed(spans: DataFrame, counts: DataFrame, tau: int = 10, unsupported=UNSUPPORTED, both=()) -> DataFrame:
    """The classifier's span where its label is supported and has tau training spans, the language model's elsewhere, both for labels in `both`. counts: (label, n), one row a label."""
    s = spans.where(F.col("source").isin("tc", "llm")).join(F.broadcast(counts), "label", "left")
    known = ~F.col("label").isin(*unsupported) & (F.coalesce("n", F.lit(0)) >= tau)
    return resolve(merge(s.where(F.col("label").isin(*both) | F.when(F.col("source") == "tc", known).otherwise(~known)).select(*COLUMNS)))


def gate(spans: DataFrame, counts: DataFrame, high: float = 0.9, low: float = 0.3, tau: int = 10, unsupported=UNSUPPORTED, verdicts: DataFrame | None = None, forced: DataFrame | None = None) -> DataFrame:
    """The decisions of the confidence gate: spans with `rule` and `accepted`. verdicts: (doc_id, start, end, label, is_phi); forced: (doc_id, start, end, label, p)."""
    tc, llm = (merge(spans.where(F.col("source") == x)).withColumn("id", F.struct("start", "end", "label")) for x in ("tc", "llm"))
    l = llm.select(F.col("doc_id").alias("l_doc"), F.col("start").alias("l_start"), F.col("end").alias("l_end"), F.col("id").alias("l_id"))
    meets = (F.col("doc_id") == F.col("l_doc")) & (F.col("start") < F.col("l_end")) & (F.col("l_start") < F.col("end"))
    pairs = tc.join(l, meets, "left").groupBy(*COLUMNS).agg(F.min("l_id").alias("first"))
    agree = pairs.where("first is not null").withColumn("label", F.when(F.col("score").isNull() | (F.col("score") >= low), F.col("label")).otherwise(F.col("first.label"))).withColumn("source", F.lit("llm+tc")).select(*COLUMNS, F.lit("agree").alias("rule"))
    alone = pairs.where("first is null").select(*COLUMNS, F.when(F.col("score") >= high, "tc-only:high").otherwise("tc-only:low").alias("rule"))
    t = tc.select(F.col("doc_id").alias("t_doc"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    rest = llm.join(t, (F.col("doc_id") == F.col("t_doc")) & (F.col("start") < F.col("t_end")) & (F.col("t_start") < F.col("end")), "left_anti").join(F.broadcast(counts), "label", "left")
    key = ["doc_id", "start", "end", "label"]
    rest = rest.join(forced.select(*key, "p"), key, "left") if forced is not None else rest.withColumn("p", F.lit(None).cast("double"))
    rare = F.col("label").isin(*unsupported) | (F.coalesce("n", F.lit(0)) < tau)
    rest = rest.select(*COLUMNS, F.when(rare, "llm-only:rare-or-unsupported").when(F.col("p") >= low, "llm-only:tc-forced").otherwise("llm-only:frequent").alias("rule"))
    d = agree.unionByName(alone).unionByName(rest)
    ask = F.col("rule").isin("tc-only:low", "llm-only:frequent")
    if verdicts is None:
        return d.withColumn("accepted", ~ask).withColumn("rule", F.when(ask, F.concat("rule", F.lit(":no-verifier"))).otherwise(F.col("rule")))
    d = d.join(verdicts.select(*key, "is_phi"), key, "left")
    return d.withColumn("accepted", ~ask | F.coalesce("is_phi", F.lit(False))).withColumn("rule", F.when(ask, F.concat("rule", F.lit(":verified"))).otherwise(F.col("rule"))).select(*COLUMNS, "rule", "accepted")


def confidence_gated(spans: DataFrame, counts: DataFrame, **options) -> DataFrame:
    return resolve(merge(gate(spans, counts, **options).where("accepted").select(*COLUMNS)))
