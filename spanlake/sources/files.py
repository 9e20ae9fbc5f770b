"""Small files that the driver writes and reads on whatever file system the session uses."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def write_file(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_file(spark: SparkSession, path: str) -> str:
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def write_json(spark: SparkSession, path: str, value) -> None:
    write_file(spark, path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def read_config(spark: SparkSession, path: str) -> dict:
    """A mapping from a YAML file (where a reader is installed) or a JSON file."""
    text = read_file(spark, path)
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("no YAML reader here; give the configuration as JSON") from e
    return yaml.safe_load(text) or {}
