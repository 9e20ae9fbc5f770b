"""Rows of one document whose extents overlap, found by stretches of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of a stretch.
STRETCH = 256


def overlapping(a: DataFrame, b: DataFrame, a_at=("start", "end"), b_at=("s", "e")) -> DataFrame:
    """Pairs of rows of a and b with one doc_id and overlapping extents, each pair once; other columns have different names.

    Both sides meet in the stretches that they touch, so a long document's rows aren't all compared with each other nor
    joined in one task; a pair counts in the stretch where the later of the two begins."""
    at = lambda c: F.floor(c / STRETCH).cast("int")
    cut = lambda d, s, e: d.withColumn("__k", F.explode(F.sequence(at(F.col(s)), at(F.greatest(F.col(s), F.col(e) - 1)))))
    pairs = cut(a, *a_at).join(cut(b, *b_at), ["doc_id", "__k"])
    meet = (F.col(a_at[0]) < F.col(b_at[1])) & (F.col(b_at[0]) < F.col(a_at[1]))
    return pairs.where(meet & (F.col("__k") == at(F.greatest(a_at[0], b_at[0])))).drop("__k")


def islands(spans: DataFrame, name: str = "island") -> DataFrame:
    """Spans with the number of the stretch without gaps that they lie in: spans of different islands don't overlap."""
    w = W.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = spans.withColumn(name, (before.isNull() | (F.col("start") >= before)).cast("int"))
    return new.withColumn(name, F.sum(name).over(w.rowsBetween(W.unboundedPreceding, 0)))
