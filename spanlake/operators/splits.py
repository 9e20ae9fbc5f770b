"""Splitting documents into training, development and test sets by stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLITS = ("train", "dev", "test")


def quotas(strata: DataFrame, ratios=(0.7, 0.1, 0.2)) -> DataFrame:
    """(stratum, n_train, n_dev) from (stratum, n): rounded half to even, what rounding leaves is carried to the next stratum.

    A fold over one array with an entry per stratum; documents aren't touched."""
    a = strata.agg(F.array_sort(F.collect_list(F.struct("stratum", F.col("n").cast("long").alias("n")))).alias("all"))
    fold = f"""aggregate(all, struct(CAST(0 AS DOUBLE) AS ct, CAST(0 AS DOUBLE) AS cd, CAST(array() AS array<struct<stratum: string, n_train: bigint, n_dev: bigint>>) AS out),
        (a, s) -> transform(array(struct(DOUBLE({ratios[0]}) * s.n + a.ct AS wt, DOUBLE({ratios[1]}) * s.n + a.cd AS wd)), w ->
            transform(array(least(s.n, greatest(0L, CAST(bround(w.wt) AS BIGINT)))), t ->
                transform(array(least(s.n - t, greatest(0L, CAST(bround(w.wd) AS BIGINT)))), d ->
                    struct(w.wt - t AS ct, w.wd - d AS cd, concat(a.out, array(struct(s.stratum AS stratum, t AS n_train, d AS n_dev))) AS out))[0])[0])[0],
        a -> a.out)"""
    return a.select(F.explode(F.expr(fold)).alias("q")).select("q.*")


def stratified(docs: DataFrame, key: str, ratios=(0.7, 0.1, 0.2), seed: int = 0) -> DataFrame:
    """(doc_id, stratum, split), a null key as its own stratum "". Within a stratum documents come in order of a seeded MD5 of their id.

    Ranks are counted within the digest's first two digits and added up over these, so that a stratum of a third of all
    documents is dealt to 256 groups. Repeated ids are told apart in no fixed order."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = docs.select("doc_id", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("stratum"), h.alias("h")).withColumn("part", F.substring("h", 1, 2))
    parts = d.groupBy("stratum", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("stratum").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = d.withColumn("r", F.row_number().over(W.partitionBy("stratum", "part").orderBy("h", "doc_id")))
    ranked = ranked.join(parts.select("stratum", "part", before.alias("before")), ["stratum", "part"])
    q = quotas(parts.groupBy("stratum").agg(F.sum("n").alias("n")), ratios)
    rank = F.col("before") + F.col("r")
    return ranked.join(q, "stratum").select("doc_id", "stratum", F.when(rank <= F.col("n_train"), SPLITS[0]).when(rank <= F.col("n_train") + F.col("n_dev"), SPLITS[1]).otherwise(SPLITS[2]).alias("split"))
