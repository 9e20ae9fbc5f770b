"""Resharding by minimum-cost flow.

Documents lie in old shards of known sizes; new shards have capacities. Blocks of documents are the unit of moving: a
block is the part of an old shard that shares a hash of its text (so equal texts move together), and a block too large
for that is split by a hash of doc_id. A minimum-cost flow from old shards to new ones, where staying is free and each
moved byte costs one, gives how much goes where; whole blocks are then chosen to fill it. What reaches the driver is the
table of block sizes, of at most OLD * BLOCKS * PARTS rows whatever the input. Only the files of shards that lose or gain
blocks are rewritten.

Law: `bytes`. New shards are near equal in bytes (text bytes plus 8 a document): they differ by about a block.

Cases: a null text has size 8 and the checksum of no bytes; repeated rows are placed each; a null doc_id or source is
hashed as null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents

NEW_SHARDS = 24
OLD_SHARDS = 16
BLOCKS = 128
PARTS = 32


def min_cost_flow(sizes: list[int], capacities: list[int], cost) -> list[dict[int, int]]:
    """The cheapest flow of all sizes into the capacities, as {new: amount} per old: successive shortest paths with potentials."""
    n, m = len(sizes), len(capacities)
    if sum(capacities) < sum(sizes):
        raise ValueError("capacities are below the sizes")
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(u, v, cap, c):
        graph[u].append([v, cap, c, len(graph[v])])
        graph[v].append([u, 0, -c, len(graph[u]) - 1])

    for i, s in enumerate(sizes):
        edge(source, i, s, 0)
    for j, c in enumerate(capacities):
        edge(n + j, sink, c, 0)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, sizes[i], cost(i, j))
    potential, left = [0] * len(graph), sum(sizes)
    while left:
        dist, via = [float("inf")] * len(graph), [None] * len(graph)
        dist[source], heap = 0, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k, (v, cap, c, _) in enumerate(graph[u]):
                if cap and d + c + potential[u] - potential[v] < dist[v]:
                    dist[v], via[v] = d + c + potential[u] - potential[v], (u, k)
                    heapq.heappush(heap, (dist[v], v))
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, dist, strict=True)]
        amount, v = left, sink
        while v != source:
            u, k = via[v]
            amount, v = min(amount, graph[u][k][1]), u
        v = sink
        while v != source:
            u, k = via[v]
            graph[u][k][1] -= amount
            graph[v][graph[u][k][3]][1] += amount
            v = u
        left -= amount
    return [{v - n: graph[v][back][1] for v, _, _, back in graph[i] if n <= v < n + m and graph[v][back][1]} for i in range(n)]


def place(old: np.ndarray, size: np.ndarray, n_old: int, n_new: int) -> tuple[np.ndarray, list[dict[int, int]]]:
    """The new shard of each block, and the flow in bytes that it fills."""
    total = int(size.sum())
    capacity = [total * (j + 1) // n_new - total * j // n_new for j in range(n_new)]
    flow = min_cost_flow([int(size[old == i].sum()) for i in range(n_old)], capacity, lambda i, j: 0 if i == j else 1)
    out, room, rest = np.full(len(size), -1, np.int32), np.array(capacity, np.int64), []
    order = np.lexsort((np.arange(len(size)), -size))
    for i in range(n_old):
        want = dict(flow[i])
        for b in order[old[order] == i].tolist():
            # largest first, to where most of the flow is still open
            fits = [j for j, w in want.items() if w >= size[b] and room[j] >= size[b]]
            if fits:
                j = i if i in fits else max(fits, key=lambda j: (want[j], -j))
                out[b], want[j], room[j] = j, want[j] - int(size[b]), room[j] - size[b]
            else:
                rest.append(b)
    for b in sorted(rest, key=lambda b: (-size[b], b)):
        j = int(np.argmax(room))
        out[b] = j
        room[j] -= size[b]
    return out, flow


def sized(docs: DataFrame, old: Column, n_old: int, blocks: int = BLOCKS, parts: int = PARTS) -> DataFrame:
    """(doc_id, size, text_crc32, old, block, part) per document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.pmod(old, F.lit(n_old)).cast("int").alias("old"),
        F.pmod(F.shiftright(F.xxhash64("text"), 20), F.lit(blocks)).cast("int").alias("block"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(parts)).cast("int").alias("part"),
    )


def plan(rows: DataFrame, n_old: int = OLD_SHARDS, n_new: int = NEW_SHARDS) -> tuple[DataFrame, list[dict[int, int]]]:
    """(old, block, part, shard, first): where each part of a block goes and the number of its first row there; and the flow."""
    import pandas as pd

    got = rows.groupBy("old", "block", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values(["old", "block", "part"], ignore_index=True)
    schema = "old int, block int, part int, shard int, first long"
    spark = rows.sparkSession
    if not len(got):
        return spark.createDataFrame([], schema), []
    whole = got.groupby(["old", "block"]).bytes.transform("sum")
    split = whole * (8 * n_new) > got.bytes.sum()  # a block above an eighth of a shard moves in parts
    unit = got.assign(p=np.where(split, got.part, -1)).groupby(["old", "block", "p"], sort=True)
    number, sizes = unit.ngroup().to_numpy(), unit.bytes.sum().to_numpy()
    olds = unit.bytes.sum().index.get_level_values("old").to_numpy()
    shard, flow = place(olds, sizes, n_old, n_new)
    got["shard"] = shard[number]
    got["first"] = got.groupby("shard").rows.cumsum() - got.rows
    out = pd.DataFrame({"old": got.old.astype("int32"), "block": got.block.astype("int32"), "part": got.part.astype("int32"), "shard": got["shard"].astype("int32"), "first": got["first"].astype("int64")})
    return spark.createDataFrame(out, schema), flow


def reshard(docs: DataFrame, old: Column, n_old: int = OLD_SHARDS, n_new: int = NEW_SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, old, shard, slot) per document."""
    rows = sized(docs, old, n_old)
    where, _ = plan(rows, n_old, n_new)
    # at most n_old * BLOCKS * PARTS rows
    placed = rows.join(F.broadcast(where), ["old", "block", "part"])
    w = W.partitionBy("old", "block", "part").orderBy("doc_id", "text_crc32", "size")
    return placed.withColumn("slot", F.col("first") + F.row_number().over(w) - 1)


def rewrite(docs: DataFrame, old: Column, out: str, n_old: int = OLD_SHARDS, n_new: int = NEW_SHARDS, folder: str = "shard") -> list[int]:
    """Rewrites the folders `folder`=0, 1, ... below `out` of those shards that lose or gain blocks; gives their numbers.

    Folders of other shards stay as they are; that of a shard that is left without documents goes. New files are complete
    below a folder of their own before old ones are replaced, one rename a shard, so `docs` may be read from `out`. All
    columns of docs are written, whatever their names; only a column named `folder` is an error."""
    if folder in docs.columns:
        raise ValueError(f"documents have a column {folder}, too: name the folders otherwise")
    spark = docs.sparkSession
    rows = sized(docs, old, n_old)
    where, _ = plan(rows, n_old, n_new)
    moved = where.where("old <> shard").select("old", "shard").distinct().collect()  # at most n_old * n_new rows
    touched = sorted({x for r in moved for x in (r.old, r.shard)})
    text = F.col("text").cast("string")
    keys = (F.pmod(old, F.lit(n_old)).cast("int"), F.pmod(F.shiftright(F.xxhash64(text), 20), F.lit(BLOCKS)).cast("int"), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(1)), F.lit(PARTS)).cast("int"))
    d = docs.select(F.struct("*").alias("row"), *[k.alias(n) for k, n in zip(keys, ("old", "block", "part"), strict=True)])
    fresh = d.join(F.broadcast(where.select("old", "block", "part", "shard")), ["old", "block", "part"]).where(F.col("shard").isin(touched)).select("row.*", F.col("shard").alias(folder))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda *x: jvm.org.apache.hadoop.fs.Path("/".join((out.rstrip("/"), *x)))
    fs = path().getFileSystem(conf)
    stage = f"_rewrite-{uuid.uuid4().hex[:12]}"
    fresh.write.partitionBy(folder).parquet(path(stage).toString())
    for i in touched:
        name = f"{folder}={i}"
        fs.delete(path(name), True)
        if fs.exists(path(stage, name)) and not fs.rename(path(stage, name), path(name)):
            raise OSError(f"{name} wasn't put in place; it lies in {stage}")
    fs.delete(path(stage), True)
    return touched


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = reshard(docs, F.xxhash64("text"))  # the earlier layout: 16 shards by a hash of the text, so equal texts start together
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))
