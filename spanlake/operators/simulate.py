"""Detectors that err in known ways: gold spans with drawn misses, noise and inventions, and oracles for the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import literal_map
from ..functions.text import hashed, uniform
from .spans import COLUMNS


def rate_of(rate: float | dict, label: Column) -> Column:
    if not isinstance(rate, dict):
        return F.lit(float(rate))
    own = {k: v for k, v in rate.items() if k != "default"}
    rest = F.lit(float(rate.get("default", 0.0)))
    return F.coalesce(literal_map(own)[label].cast("double"), rest) if own else rest


def detect(docs: DataFrame, gold: DataFrame, name: str, miss_rate: float | dict = 0.1, fp_rate: float = 0.0, boundary_noise: float = 0.0, score: float = 0.9, seed: int = 0) -> DataFrame:
    """What the detector `name` finds of the gold spans: each is missed at its label's rate, else found, shortened by one
    character (of three or more) at the rate of boundary noise, and joined by an invented span of five characters and half
    the score at fp_rate, where no gold span lies.

    Draws are MD5s of seed, name, document, extent and label: neither order nor partitions matter; equal gold spans share
    their draws. A null text has no room for inventions. docs: (doc_id, text), one row an id."""
    key = F.concat_ws(":", "doc_id", "start", "end", "label")
    draw = lambda what: uniform(F.concat(F.lit(f"{seed}:{name}:{what}:"), key))
    found = gold.select("doc_id", "start", "end", "label").where(draw("miss") >= rate_of(miss_rate, F.col("label")))
    cut = (draw("noise") < boundary_noise) & (F.col("end") - F.col("start") > 2)
    hits = found.withColumn("cut", cut.cast("int")).select("doc_id", "start", (F.col("end") - F.col("cut")).alias("end"), "label", F.lit(float(score)).alias("score"))
    texts = docs.select("doc_id", "text")
    if fp_rate:
        size = docs.select("doc_id", F.length("text").alias("n"))
        spot = found.where(draw("invent") < fp_rate).withColumn("h", hashed(F.concat(F.lit(f"{seed}:{name}:spot:"), key))).join(size, "doc_id").where("n > 0")
        spot = spot.withColumn("at", (F.col("h") % F.greatest(F.lit(1), F.col("n") - 6)).cast("int"))
        spot = spot.select("doc_id", F.col("at").alias("start"), F.least("n", F.col("at") + 5).alias("end"), "label", F.lit(score / 2.0).alias("score"))
        g = gold.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"))
        hits = hits.unionByName(spot.join(g, (F.col("doc_id") == F.col("d")) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), "left_anti"))
    return hits.join(texts, "doc_id", "left").withColumn("text", F.expr("substring(text, start + 1, end - start)")).withColumn("source", F.lit(name)).select(*COLUMNS)


def right(spans: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, is_phi), one row a distinct span: does it overlap a gold span of its label?"""
    key = ["doc_id", "start", "end", "label"]
    s = spans.select(*key).distinct()
    g = gold.select("doc_id", "label", F.col("start").alias("s"), F.col("end").alias("e"))
    hit = s.join(g, ["doc_id", "label"]).where("s < end AND start < e").select(*key).distinct().withColumn("is_phi", F.lit(True))
    return s.join(hit, key, "left").withColumn("is_phi", F.coalesce("is_phi", F.lit(False)))


def forced(verdicts: DataFrame, score: float = 0.9, other: float = 0.05) -> DataFrame:
    """(doc_id, start, end, label, p) from right(): the detector's score where it is, little elsewhere."""
    return verdicts.select("doc_id", "start", "end", "label", F.when(F.col("is_phi"), float(score)).otherwise(other).alias("p"))
