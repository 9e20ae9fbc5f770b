"""Shared pieces of the training-data operators.

Text is handled as UTF-8 bytes in numpy, a few megabytes at a time. Where an operator has to look a value up across
the corpus and come back to the text, documents are dealt into *chunks* by a hash of their content: a chunk is a
bounded set of documents, ships what it knows once per chunk (already deduplicated), and gets its answer back under its
chunk number. One exchange of the text serves every pass, as Spark reuses it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a chunk, on average. A chunk is what one Python call holds.
CHUNK_BYTES = 12 << 20
#: Fewest chunks, so that small inputs are dealt evenly too.
LEAST_CHUNKS = 48
#: Bytes of text that the numpy passes take at once (one longer document is taken whole).
STEP_BYTES = 1 << 19

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_POWER_CACHE: dict = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd)."""
    have = _POWER_CACHE.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, STEP_BYTES + 64)
        up, down = np.full(m, base, np.uint64), np.full(m, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if m <= 4 * STEP_BYTES:
            _POWER_CACHE[base] = have
    return have[0][:n], have[1][:n]


def prefix_hash(values: np.ndarray, base: int = 0x5851F42D4C957F2D) -> tuple[np.ndarray, np.ndarray]:
    """What range_hash() needs to hash any slice of values in constant time."""
    up, down = powers(len(values) + 1, base)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def range_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums, down = prefix
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Texts:
    """Some documents as one byte array: buf, and begin and end of each document in it."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.begin, self.end = buf, offsets[:-1], offsets[1:]

    def words(self, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each word, and the word's document; a word never crosses documents."""
        solid = ~is_space[self.buf]
        edge = np.zeros(len(solid) + 1, bool)
        edge[self.begin] = True
        before = np.zeros(len(solid), bool)
        if len(solid):
            before[1:] = solid[:-1]
        first = solid & (~before | edge[:-1])
        start = np.flatnonzero(first)
        after = np.zeros(len(solid), bool)
        if len(solid):
            after[:-1] = solid[1:]
        edge[self.end] = True
        last = solid & (~after | edge[1:])
        doc = np.searchsorted(self.begin, start, side="right") - 1
        return start, np.flatnonzero(last) + 1, doc


def space_table() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, 9, 10, 11, 12, 13]] = True
    return out


SPACE = space_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def string_column(column) -> pa.Array:
    """One string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.cast(pa.large_string()).fill_null("")


def text_steps(column, step: int | None = None):
    """(index of first document, Texts) over a string column, about `step` bytes at a time, documents whole."""
    arr = string_column(column)
    n = len(arr)
    if not n:
        return
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, step = 0, step or STEP_BYTES
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, side="right")) - 1)
        j = min(j, n)
        yield i, Texts(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def window_counts(doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For the words of documents in order: first word of each document, and the starts of the k-word windows that lie in one document."""
    count = np.bincount(doc, minlength=n_docs)
    last = np.cumsum(count)
    first = last - count
    start = np.arange(len(doc))
    return first, start[start + k <= last[doc]]


def leftmost_minima(key: np.ndarray, window: int) -> np.ndarray:
    """For each full window of `window` values: where its leftmost smallest value is. Keys count by their upper 32 bits."""
    n = len(key)
    if n < window:
        return np.zeros(0, np.int64)
    packed = (key >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // window)
    full = np.full(blocks * window, np.uint64(2**64 - 1))
    full[:n] = packed
    full = full.reshape(blocks, window)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[: n - window + 1], left[window - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def covered(start: np.ndarray, length, n: int) -> np.ndarray:
    """Which of n places some run [start, start + length) covers."""
    diff = np.zeros(n + 1, np.int32)
    np.add.at(diff, start, 1)
    np.add.at(diff, start + length, -1)
    return np.cumsum(diff[:-1]) > 0


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one number, by a scan."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def labels(n: int) -> list[int]:
    """n numbers of which Spark deals each to a partition of its own when it deals ints by hash over n partitions."""
    found, start = np.full(n, -1), 0
    while (found < 0).any():
        x = np.arange(start, start + 16 * n + 64, dtype=np.uint32)
        with np.errstate(over="ignore"):  # Murmur3 of an int, seed 42, as Spark's hash() has it
            k = x * np.uint32(0xCC9E2D51)
            h = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593) ^ np.uint32(42)
            h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
            h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
            h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        at, first = np.unique((h ^ h >> np.uint32(16)).view(np.int32) % n, return_index=True)
        found[at] = np.where(found[at] < 0, x[first], found[at])
        start += len(x)
    return found.tolist()


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, total: int | None = None, apart: bool = False) -> DataFrame:
    """(chunk, doc_id, text): documents dealt evenly by a hash of their content, whatever their source or group of copies. apart: chunks bear labels(), so a task has one of them and not, by chance, several."""
    n = max(LEAST_CHUNKS, -(-(text_bytes(docs) if total is None else total) // chunk_bytes))
    chunk = F.pmod(row_key(), F.lit(n)).cast("int")
    if apart:
        chunk = F.element_at(F.expr(f"array({','.join(map(str, labels(n)))})"), chunk + 1)
    return docs.select(chunk.alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartition(n, "chunk")


def tidy() -> None:
    """Gives freed memory back to the system; an idle worker would hold it otherwise."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def answer(docs: DataFrame, other: DataFrame, func, schema: str) -> DataFrame:
    """func(documents of a chunk, rows of `other` for it) for every chunk that has documents."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = func(a, b) if a.num_rows else empty(schema)
        tidy()
        return out

    return docs.groupBy("chunk").cogroup(other.groupBy("chunk")).applyInArrow(run, schema)


def by_group(rows: DataFrame, key: str, func, schema: str) -> DataFrame:
    """func(rows of a group) for every value of key."""

    def run(t: pa.Table) -> pa.Table:
        out = func(t)
        tidy()
        return out

    return rows.groupBy(key).applyInArrow(run, schema)


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def empty(ddl: str) -> pa.Table:
    return arrow_schema(ddl).empty_table()


def table(ddl: str, *columns) -> pa.Table:
    s = arrow_schema(ddl)
    return pa.Table.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) and c.type == f.type else (c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)) for c, f in zip(columns, s, strict=True)], schema=s)


def buckets_for(spark: SparkSession, total: int, bucket_bytes: int = 12 << 20) -> int:
    """How many buckets hashes are dealt into: in proportion to the corpus, so a bucket stays within memory."""
    return max(24, -(-total // bucket_bytes))


def split_sorted(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Edges of n_buckets equal ranges of the 64-bit hash space in the sorted array h."""
    step = -(-(1 << 64) // n_buckets)
    cuts = np.array([min(i * step, (1 << 64) - 1) for i in range(1, n_buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(h, cuts), [len(h)]])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a local master (tests) may go without: it gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        import tempfile

        at = f"{tempfile.gettempdir()}/spanlake-checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
