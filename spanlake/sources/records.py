"""Documents with spans from and to files: JSON lines, privacy-filter records, XML, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import CATEGORIES, OPF_OF, SUBTYPES
from ..functions.text import cuts

SPAN = "struct<start: int, end: int, label: string, text: string, source: string, score: double>"
DOC = f"doc_id string, text string, spans array<{SPAN}>, meta map<string, string>"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One document per line; blank lines are skipped, absent fields take their defaults."""
    d = spark.read.schema(DOC).json(path).where("doc_id is not null or text is not null")
    return d.withColumn("spans", F.coalesce("spans", F.expr(f"CAST(array() AS array<{SPAN}>)"))).withColumn("meta", F.coalesce("meta", F.expr("CAST(map() AS map<string, string>)")))


def write_jsonl(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def invalid(docs: DataFrame) -> DataFrame:
    """Spans that break a rule: empty or negative extent, no label, beyond the text, or a surface unlike the text's."""
    s = docs.select("doc_id", "text", F.explode("spans").alias("s"))
    return s.where("s.start < 0 OR s.end <= s.start OR coalesce(s.label, '') = '' OR s.end > length(text) OR (coalesce(s.text, '') <> '' AND s.text <> substring(text, s.start + 1, s.end - s.start))").select("doc_id", "s.*")


def to_opf(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans): spans grouped under "<label>: <surface>" as arrays of offsets; labels that the filter lacks are dropped."""
    # a document's spans are in its row already: nothing is exploded or shuffled, and each span is looked at once
    bare = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label")))
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), bare.alias("spans"))

    def places(text, spans):
        out: dict[str, list] = {}
        for x in spans or ():
            label = OPF_OF.get(x["label"])
            if None not in (text, label, x["start"], x["end"]):
                out.setdefault(f"{label}: {text[x['start'] : x['end']]}", []).append([x["start"], x["end"]])
        return [(k, sorted(out[k])) for k in sorted(out)]

    def run(batches):
        import pyarrow as pa

        kind = pa.map_(pa.string(), pa.list_(pa.list_(pa.int32())))
        for b in batches:
            for first, behind in cuts(b.column("text")):
                part = b.slice(first, behind - first)
                made = [places(*x) for x in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(made, kind)], names=["doc_id", "text", "spans"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string, spans map<string, array<array<int>>>")


def from_opf(records: DataFrame, source: str = "gold") -> DataFrame:
    """Spans from records (doc_id or null, text, spans map<string, array<array<int>>>): the key is cut at its first ": "."""
    r = records.withColumn("doc_id", F.coalesce("doc_id", F.concat(F.lit("opf-"), F.substring(F.sha1("text"), 1, 12))))
    e = r.select("doc_id", "text", F.explode("spans").alias("key", "at")).select("doc_id", "text", "key", F.explode("at").alias("o"))
    label = F.when(F.col("key").contains(": "), F.substring_index("key", ": ", 1)).otherwise(F.raise_error(F.concat(F.lit("no label in "), "key")).cast("string"))
    return e.select("doc_id", F.col("o")[0].alias("start"), F.col("o")[1].alias("end"), label.alias("label"), F.expr("substring(text, o[0] + 1, o[1] - o[0])").alias("text"), F.lit(source).alias("source"), F.lit(None).cast("double").alias("score"))


def read_xml(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(doc_id, text, spans, mismatches) from one XML file a document, named by its stem."""
    known, kinds = set(SUBTYPES), {*CATEGORIES, "PHI"}

    def parse(batches):
        import pandas as pd
        from xml.etree import ElementTree

        for b in batches:
            rows = []
            for name, raw in zip(b["path"], b["value"], strict=True):
                root = ElementTree.fromstring(raw)
                if root.tag != "deIdi2b2" or root.find("TEXT") is None:
                    raise ValueError(f"{name} is no annotated document")
                text, spans, wrong = root.find("TEXT").text or "", [], 0
                for x in root.iter():
                    if x.tag not in kinds:
                        continue
                    a, z, label = int(x.get("start")), int(x.get("end")), x.get("TYPE")
                    if label not in known or not 0 <= a < z <= len(text):
                        raise ValueError(f"{name}: bad span {a}-{z} {label}")
                    if x.get("text") not in (None, text[a:z]):
                        if strict:
                            raise ValueError(f"{name}: {x.get('text')!r} isn't at {a}-{z}")
                        wrong += 1
                    spans.append((a, z, label, text[a:z], "gold", None))
                rows.append((name.rsplit("/", 1)[-1].rsplit(".", 1)[0], text, spans, wrong))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "spans", "mismatches"])

    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.xml" if not path.endswith(".xml") else None).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(parse, f"doc_id string, text string, spans array<{SPAN}>, mismatches int")


def read_notes(spark: SparkSession, path: str, column: str = "transcription", least: int = 200) -> DataFrame:
    """Notes of a CSV file, stripped, those of at least `least` characters; the id holds the row's number in the file and a hash. Numbering one file's rows takes no shuffle (a file with line breaks in fields is read by one task)."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("row", F.monotonically_increasing_id())
    text = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"^\s+|\s+$", ""))
    return d.withColumn("text", text).where(F.length("text") >= least).select(F.format_string("mts-%05d-%s", "row", F.substring(F.sha1("text"), 1, 8)).alias("doc_id"), "text")


def dedup_sha1(docs: DataFrame) -> DataFrame:
    """Of equal texts the row with the smallest doc_id: aggregated before the exchange, so copies never meet in one task."""
    d = docs.where("text is not null").select(F.substring(F.sha1("text"), 1, 12).alias("sha"), "doc_id")
    return d.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
