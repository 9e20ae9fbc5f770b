"""Packing by power-of-two decomposition.

A document of L ids is cut into pieces whose lengths are powers of two: as many of the largest length as fit, then the
binary digits of the rest, longest first. Every piece is a sequence of its own, so no sequence crosses documents, and as
each length is a power of two, none is padded. Equal lengths share a bucket (the exponent), from which batches of one
shape are drawn.

One narrow pass: no shuffle, nothing collected. Ids are those of the byte-level BPE vocabulary; it is read as ranks
(`byte_bpe_50k.tiktoken`), which give the same ids as `byte_bpe_50k.json` several times faster (tests compare both).

Cases: a null or empty text is one piece holding just the end id; repeated rows are packed each; doc_id may be null;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, documents, string_column

END_ID = 1
LONGEST = 2048
#: Fixed value: the vocabulary's own special token, which is one id wherever it stands in a text.
SPECIAL = {"<|endoftext|>": 50256}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids binary"


class Encoder:
    """encode(text) gives the ids of the public byte-level BPE vocabulary as little-endian 32-bit bytes."""

    def __init__(self, path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.plain, self.whole = enc.encode_ordinary, enc.encode

    def encode(self, text: str) -> bytes:
        special = any(x in text for x in SPECIAL)
        return array("I", self.whole(text, allowed_special="all") if special else self.plain(text)).tobytes()


def cuts(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    size = longest >> 1
    while size:
        if (n - at) & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


def pieces(docs: DataFrame, longest: int = LONGEST, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket (the length's exponent) and the ids themselves."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest is a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = Encoder(vocabulary)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"]
        kinds = (pa.int64(),) * 5 + (pa.int32(), pa.binary())
        for b in batches:
            texts = string_column(b.column(1))
            keys = b.column(0).to_pylist()
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            i = 0
            while i < len(keys):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP_BYTES)))
                cols = [[] for _ in names]
                for key, text in zip(keys[i:j], texts[i:j].to_pylist(), strict=True):
                    ids = memoryview(enc.encode(text) + end)
                    n = len(ids) // 4
                    for start, length in cuts(n, longest):
                        part = ids[4 * start : 4 * (start + length)]
                        for c, v in zip(cols, (key, start, length, zlib.crc32(part), n, length.bit_length() - 1, bytes(part) if with_ids else None), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
                i = j

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, longest: int = LONGEST, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """pieces() with sequence_id and offset. A sequence holds one piece; ids of a bucket are neighbours in order of sequence_id."""
    p = pieces(docs, longest, end_id, vocabulary, with_ids)
    return p.withColumn("sequence_id", F.shiftleft(F.col("bucket").cast("long"), 58) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """The packed pieces as one folder per length, for readers that draw batches of one shape."""
    packed.write.partitionBy("bucket").parquet(path)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
