"""New documents as a stream: found by rule, written exactly once, counted by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.spans import residual
from ..sources.records import DOC

SPANS = "doc_id string, start int, end int, label string, text string, source string, score double"


def documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (doc_id, text) from JSON lines that arrive in a folder."""
    s = spark.readStream.schema(DOC).option("maxFilesPerTrigger", files_per_batch).json(path)
    return s.select("doc_id", "text").where("doc_id is not null and text is not null")


def unrepeated(stream: DataFrame, within: str | None = None, at: str = "seen_at") -> DataFrame:
    """Without texts that came before. `within`: only so far back, by the time in column `at` (else every hash is kept as state, 12 characters a text)."""
    s = stream.withColumn("__sha", F.substring(F.sha1("text"), 1, 12))
    s = s.withWatermark(at, within).dropDuplicatesWithinWatermark(["__sha"]) if within else s.dropDuplicates(["__sha"])
    return s.drop("__sha")


def detect(stream: DataFrame, out: str, checkpoint: str, once: bool = True, find=residual) -> StreamingQuery:
    """Writes the spans that `find` finds to out/batch=<number>. A batch that is run again after a loss replaces its own folder, so none counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        find(batch.select("doc_id", "text")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def label_counts(spark: SparkSession, out: str) -> DataFrame:
    """(label, n) of all batches so far."""
    return spark.read.schema(f"{SPANS}, batch long").parquet(out).groupBy("label").agg(F.count("*").alias("n"))
