"""Benchmark decontamination with one Aho-Corasick automaton.

Items of the benchmark (questions and answers) and documents are normalised alike: A-Z lower-cased, every other ASCII
character but digits and lower-case letters a blank, words joined by one blank. A window is 10 consecutive words of an
item (a shorter item is one window). All windows go into one automaton, a blank at both ends of each so that only whole
words match; a document is scanned once, and what is hit is mapped back to word numbers and to offsets in the original.

The automaton is built from the benchmark's windows, which are collected only after their number is checked against
MOST_WINDOWS (an automaton of so many takes a few hundred megabytes); each worker builds it once. A larger benchmark is
cut into slices of that size, one at a time on the driver: each slice scans the original texts, its hits are added to a
table below the checkpoint folder, and all are united once at the end, so slices give what one automaton would.
Documents are never shuffled.

Cases: null texts have no words, so are never contaminated; items without words have no windows; items with one text
each count; an item whose id is null counts as one named by the empty string; repeated documents are each reported;
other columns are ignored; an empty benchmark leaves all clean; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_path, string_column

WINDOW = 10
MOST_WINDOWS = 100_000

#: Bytes to normalised bytes: lower case, digits and non-ASCII stay, all else becomes a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


def windows(items: list[tuple], k: int = WINDOW) -> dict[str, list[int]]:
    """Window text, with its blanks, to the numbers of the items that have it."""
    out: dict[str, list[int]] = {}
    for at, (_, text) in enumerate(items):
        w = normal_words(text or "")
        for i in range(max(1, len(w) - k + 1) if w else 0):
            has = out.setdefault(f" {b' '.join(w[i : i + k]).decode()} ", [])
            if not has or has[-1] != at:
                has.append(at)
    return out


def automaton(items: list[tuple], k: int = WINDOW):
    import ahocorasick

    a = ahocorasick.Automaton()
    for text, has in windows(items, k).items():
        a.add_word(text, (len(text), has))
    if len(a):
        a.make_automaton()
    return a


def hits(machine, text: str) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, the hit windows as (first word, last word + 1), and the numbers of the items."""
    words = normal_words(text)
    if not words or not len(machine):
        return len(words), [], set()
    scanned = f" {b' '.join(words).decode()} "
    found = [(end, length, has) for end, (length, has) in machine.iter(scanned)]
    if not found:
        return len(words), [], set()
    # the blank before word i stands at blanks[i]
    blanks = np.flatnonzero(np.frombuffer(scanned.encode("utf-32-le"), np.uint32) == 32)
    ends = np.searchsorted(blanks, np.array([e for e, _, _ in found]))
    starts = np.searchsorted(blanks, np.array([e - n + 1 for e, n, _ in found]))
    return len(words), list(zip(starts.tolist(), ends.tolist(), strict=True)), {x for _, _, has in found for x in has}


def united(n_words: int, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of words as disjoint ones in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as offsets in code points of the original text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    solid = np.frombuffer(NORMAL, np.uint8)[raw] != 32
    first = np.flatnonzero(solid & ~np.append(False, solid[:-1]))
    last = np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1
    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    return [(int(chars[first[a]]), int(chars[last[b - 1]])) for a, b in runs]


def _slices(benchmark: DataFrame, k: int, most: int):
    """The benchmark's items, slice after slice of about `most` windows (one slice where there are no more)."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_words = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")  # an empty piece at either end counts, too
    total = b.agg(F.sum(n_words)).first()[0] or 0
    n = 1 if total <= most else -(-2 * total // most)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield i + 1 == n, [(r[0] or "", r[1]) for r in (b if n == 1 else b.where(part == i)).collect()]


_MACHINES: dict = {}


def _machine(shared, k: int):
    """The items of a broadcast and their automaton, built once a worker (the last one is held)."""
    key = (shared.value[0], k)
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = automaton(shared.value[1], k)
    return shared.value[1], _MACHINES[key]


FOUND, IDS = "__found", "__ids"


def found(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, most: int = MOST_WINDOWS) -> DataFrame:
    """docs with FOUND, the windows that were hit (first word and last + 1 of each, one after another), and IDS, the items they are from."""
    spark, out = docs.sparkSession, docs
    at = docs.columns.index("text")
    schema = docs.withColumn(FOUND, F.expr("CAST(array() AS ARRAY<INT>)")).withColumn(IDS, F.expr("CAST(array() AS ARRAY<STRING>)")).schema
    for last, items in _slices(benchmark, k, most):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, items))  # about MOST_WINDOWS words
        more = FOUND in out.columns

        def run(batches, shared=shared, more=more):
            named, machine = _machine(shared, k)
            for b in batches:
                spots, ids = ([[] for _ in range(b.num_rows)] for _ in range(2))
                if more:
                    spots, ids = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                    b = b.select(b.schema.names[:-2])
                for i, text in enumerate(b.column(at)):
                    _, hit, who = hits(machine, text.as_py() or "")
                    if hit:
                        spots[i] = spots[i] + [x for r in united(0, hit) for x in r]
                        ids[i] = ids[i] + sorted({named[x][0] for x in who})
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spots, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))], names=[*b.schema.names, FOUND, IDS])

        out = out.mapInArrow(run, schema)
        if not last:  # this slice is done before the next one is fetched
            path = shared_path(spark, "benchmark-slice")
            out.write.parquet(path)
            out = spark.read.schema(schema).parquet(path)
            shared.unpersist()
    return out


SCAN = "doc_id long, text string, n_words long, runs array<struct<first:int,last:int>>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, most: int = MOST_WINDOWS, keep_text: bool = True) -> DataFrame:
    """Per document: n_words, the disjoint runs of hit words, and the ids of the items with occurring windows (sorted as strings)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        for b in batches:
            n_words = [len(normal_words(x)) for x in string_column(b.column(1)).to_pylist()]
            runs = [[{"first": a, "last": z} for a, z in united(0, zip(x[::2], x[1::2], strict=True))] for x in b.column(2).to_pylist()]
            ids = [sorted(set(x)) for x in b.column(3).to_pylist()]
            text = b.column(1) if keep_text else pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array(n_words, pa.int64()), pa.array(runs, run_type), pa.array(ids, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "runs", "items"])

    return found(d, benchmark, k, most).mapInArrow(run, SCAN)


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, most: int = MOST_WINDOWS) -> DataFrame:
    """The same rows and columns without the passages of the benchmark: all windows that are hit are united, then cut once out of the original text; n_chars follows."""
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in batches:
            spots = b.column(len(names)).to_pylist()
            b = b.select(names)
            changed = [i for i, x in enumerate(spots) if x]
            if changed:
                cols, texts = list(b.columns), b.column(at).to_pylist()
                for i in changed:
                    out, last = [], 0
                    for a, z in original_spans(texts[i], united(0, zip(spots[i][::2], spots[i][1::2], strict=True))):
                        out.append(texts[i][last:a])
                        last = z
                    texts[i] = "".join(out) + texts[i][last:]
                cols[at] = pa.array(texts, b.schema.field(at).type)
                if size is not None:
                    before = b.column(size).to_pylist()
                    for i in changed:
                        before[i] = None if before[i] is None else len(texts[i])
                    cols[size] = pa.array(before, b.schema.field(size).type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return found(docs, benchmark, k, most).mapInArrow(run, docs.schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    n_hit = F.aggregate("runs", F.lit(0), lambda a, r: a + r["last"] - r["first"]).cast("long")
    return s.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


OP7_SQL = r"""
WITH item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
place AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, p.n, i, item_id FROM place p JOIN win v ON p.n = v.n AND p.s = v.s),
word AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN ids USING (r)
"""
