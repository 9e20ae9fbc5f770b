"""Command lines: run, summarize, build, export-opf, convert-xml."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.injection import Profile
from .plans import experiment
from .sources import benchmark, files, records


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanlake")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, **options):
        c = sub.add_parser(name)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", **v)

    need = {"required": True}
    command("run", config=need, out={}, limit={"type": int})
    command("summarize", run=need)
    command("build", out=need, profile=need, seed={"type": int, "default": 0}, demo={"type": int, "default": 0, "metavar": "COPIES"}, documents={"help": "Parquet with doc_id, text, source"}, notes={"help": "CSV of notes"}, column={"default": "transcription"}, limit={"type": int})
    command("export-opf", benchmark=need, out=need)
    command("convert-xml", path=need, out=need, lenient={"action": "store_true"})
    return p


def main(argv=None, spark: SparkSession | None = None):
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("spanlake").getOrCreate()
    if a.command == "run":
        out = experiment.run(spark, files.read_config(spark, a.config), a.out, a.limit)
    elif a.command == "summarize":
        experiment.summarize(spark, a.run)
        out = a.run
    elif a.command == "build":
        out = benchmark.build(sources(spark, a), Profile.of(files.read_config(spark, a.profile)), a.out, a.seed)["splits"]
    elif a.command == "export-opf":
        out = benchmark.export_opf(spark, a.benchmark, a.out)
    else:
        records.write_jsonl(records.read_xml(spark, a.path, not a.lenient), a.out)
        out = a.out
    print(out if isinstance(out, str) else json.dumps(out))
    return out


def sources(spark: SparkSession, a: argparse.Namespace):
    """The union of the sources named; a limit takes the first by source order and id."""
    from pyspark.sql import functions as F

    parts = [benchmark.demo(spark, a.demo)] if a.demo else []
    if a.notes:
        parts.append(records.read_notes(spark, a.notes, a.column).withColumn("source", F.lit("notes")))
    if a.documents:
        parts.append(spark.read.parquet(a.documents).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source"))
    if not parts:
        raise SystemExit("no source given")
    out = None
    for i, x in enumerate(parts):
        x = x.withColumn("__part", F.lit(i))
        out = x if out is None else out.unionByName(x)
    return (out.orderBy("__part", "doc_id").limit(a.limit) if a.limit else out).drop("__part")


if __name__ == "__main__":
    main()
