"""A benchmark of documents with known spans: built, read, exported."""

from __future__ import annotations

import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits
from ..operators.injection import Profile, inject
from . import files
from .records import DOC, to_opf

DEMO = (
    "The patient came to the hospital with a dry cough that had lasted for nine days, without fever or pain in the chest.\n\nThe physician listened to both lungs and found nothing. Rest was advised.",
    "Follow-up after a sprained ankle. The patient walks without help and sleeps well, and the swelling has gone down a good deal since the first visit.\n\nNo further visit is planned by the doctor.",
    "A routine check before travel. Blood pressure and pulse are normal, the patient takes no medicine and has no allergies that are known to the hospital.",
)


def demo(spark: SparkSession, copies: int = 1) -> DataFrame:
    """(doc_id, text, source): a few notes without identifiers, repeated under other ids."""
    rows = [(f"demo-{i}" + (f"-r{k}" if k else ""), t, "demo") for k in range(copies) for i, t in enumerate(DEMO)]
    return spark.createDataFrame(rows, "doc_id string, text string, source string")


def build(docs: DataFrame, profile: Profile, out: str, seed: int = 0, version: str = "0.1", ratios=(0.7, 0.1, 0.2)) -> dict:
    """Writes documents with identifiers put in to out/docs/split=<split>, and a manifest; returns the manifest.

    Injected once, into out/injected. Which document is in which split says the table itself; the manifest holds counts only.
    docs: (doc_id, text, source), one row an id."""
    spark = docs.sparkSession
    inject(docs, profile, seed, "source").write.mode("overwrite").parquet(f"{out}/injected")
    done = spark.read.parquet(f"{out}/injected")
    split = splits.stratified(done.select("doc_id", F.col("meta")["source"].alias("source")), "source", ratios, seed)
    done.join(split.select("doc_id", "split"), "doc_id").write.mode("overwrite").partitionBy("split").json(f"{out}/docs")
    whole = spark.read.schema(f"{DOC}, split string").json(f"{out}/docs")
    counts = {r.split: r for r in whole.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("spans"), F.count(F.col("meta")["ambiguous_strings"]).alias("ambiguous")).collect()}
    labels: dict[str, dict] = {}
    for r in whole.select("split", F.explode("spans.label").alias("label")).groupBy("split", "label").count().orderBy("split", "label").collect():
        labels.setdefault(r.split, {})[r.label] = r["count"]
    made = {
        "name": "spans", "version": version, "created_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "seed": seed, "profile": asdict(profile), "profile_fingerprint": profile.fingerprint(),
        "sources": {r.source or "": r["count"] for r in docs.groupBy("source").count().collect()}, "n_docs": sum(r.n for r in counts.values()),
        "splits": {s: {"n_docs": r.n, "n_spans": r.spans, "label_counts": labels.get(s, {}), "ambiguous_docs": r.ambiguous} for s, r in counts.items()},
    }
    files.write_json(spark, f"{out}/manifest.json", made)
    return made


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(doc_id, text, spans, meta) of one split; an error if it isn't there."""
    at = f"{path}/docs/split={split}"
    if not files.exists(spark, at):
        raise FileNotFoundError(at)
    return spark.read.schema(DOC).json(at)


def export_opf(spark: SparkSession, path: str, out: str, names=splits.SPLITS) -> dict:
    """Writes privacy-filter records to out/split=<split>; returns how many spans were kept and dropped."""
    counts = {}
    for name in names:
        d = read_split(spark, path, name)
        records = to_opf(d)
        records.write.mode("overwrite").json(f"{out}/split={name}")
        n = d.select(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
        kept = records.select(F.coalesce(F.sum(F.aggregate(F.map_values("spans"), F.lit(0), lambda a, x: a + F.size(x))), F.lit(0))).first()[0]
        counts[name] = {"kept": kept, "dropped": n - kept}
    return counts
