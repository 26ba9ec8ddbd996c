"""Resharding by minimum-cost flow: block transfers that move the fewest bytes, then only the affected files are rewritten."""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from daybook.llm.common import shared_dir

#: A file holds so many rows at most; how the rows of a cut file are dealt goes to every task, as two bytes a row.
FILE_ROWS = 1 << 16
OLD_SHARDS, NEW_SHARDS = 16, 24


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[float]]) -> list[list[int]]:
    """flow[i][j] from sources to sinks that ships all supplies within the capacities at the least cost.

    Successive shortest paths with potentials (costs are at least 0) on the graph of shards: each path
    fills an arc, a source or a sink, so the work depends on the number of shards, not on what is shipped.
    """
    m, n = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are smaller than what there is")
    flow = [[0] * n for _ in range(m)]
    left, room = list(supply), list(capacity)
    height = [0.0] * (m + n)  # potentials: sources, then sinks
    while any(left):
        far = [float("inf")] * (m + n)
        via: list[int | None] = [None] * (m + n)
        heap = []
        for i in range(m):
            if left[i]:
                far[i] = 0.0
                heap.append((0.0, i))
        heapq.heapify(heap)
        done = [False] * (m + n)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            arcs = ((m + j, cost[u][j]) for j in range(n)) if u < m else ((i, -cost[i][u - m]) for i in range(m) if flow[i][u - m])
            for v, c in arcs:
                reached = d + max(0.0, c + height[u] - height[v])
                if reached < far[v] - 1e-12:
                    far[v], via[v] = reached, u
                    heapq.heappush(heap, (reached, v))
        ends = [m + j for j in range(n) if room[j] and far[m + j] < float("inf")]
        end = min(ends, key=lambda v: (far[v] + height[v], v))
        top = max(x for x in far if x < float("inf"))
        height = [h + min(x, top) for h, x in zip(height, far, strict=True)]
        path, v = [], end
        while via[v] is not None:
            path.append((via[v], v))
            v = via[v]
        most = min([left[v], room[end - m], *(flow[y][x - m] for x, y in path if x >= m)])
        for x, y in path:
            if x < m:
                flow[x][y - m] += most
            else:
                flow[y][x - m] -= most
        left[v] -= most
        room[end - m] -= most
    return flow


def shares_of(total: int, weights: Sequence[float]) -> list[int]:
    """Whole numbers that add up to ``total``, as the weights."""
    ends = [round(total * x) for x in np.cumsum(weights) / sum(weights)]
    return [b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class ShardedTable:
    """Rows as files ``epoch=e/shard=s/``; each row with its size in bytes, each shard's rows in the order of (file, row).

    A version, ``versions/e.json``, names for each earlier epoch and shard from which file on its rows have moved: files before it stay as
    they are. It is renamed into place once all files are written, so a reader sees the old shards or the new ones, and a job that dies
    leaves files that no version names. ``vacuum`` deletes files that the last version does not use.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- files

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, version: dict) -> None:
        draft, files = self._files(f"{self.path}/drafts/{version['epoch']:06d}.json")
        final, _ = self._files(f"{self.path}/versions/{version['epoch']:06d}.json")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(version).encode() + b"\n"))
        out.close()
        files.mkdirs(final.getParent())
        if files.exists(final) or not files.rename(draft, final):
            raise RuntimeError(f"epoch {version['epoch']} is there already")

    def version(self) -> dict:
        found = self.spark.read.text(f"{self.path}/versions").collect()  # one small file for each reshard
        return max((json.loads(r[0]) for r in found), key=lambda v: v["epoch"])

    def write(self, rows: DataFrame, size: str, shards: int) -> None:
        """The first layout: each task appends its rows to one shard as files of its own; nothing is shuffled."""
        stored = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.expr(size).cast("long").alias("bytes"), F.pmod(F.spark_partition_id(), F.lit(shards)).alias("shard"))
        self._write(stored, 0)
        self._commit({"epoch": 0, "shards": shards, "schema": json.loads(stored.select("row", "bytes").schema.json()), "moved": []})

    def _write(self, stored: DataFrame, epoch: int) -> None:
        stored.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy("shard").parquet(f"{self.path}/data/epoch={epoch}")

    def read(self, version: dict | None = None) -> DataFrame:
        """(row, bytes, epoch, shard, file, place): the rows of a version, the last one if none is named."""
        v = version or self.version()
        schema = StructType([*StructType.fromJson(v["schema"]).fields, StructField("epoch", IntegerType()), StructField("shard", IntegerType())])
        df = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/epoch={e}" for e in range(v["epoch"] + 1)])
        df = df.select("row", "bytes", "epoch", "shard", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
        for epoch, shard, first in v["moved"]:
            df = df.where((F.col("epoch") != epoch) | (F.col("shard") != shard) | (F.col("file") < first))
        return df

    # ---- resharding

    def sizes(self, version: dict) -> list[int]:
        """Bytes of each shard, from the sizes that are stored beside the rows."""
        found = {r["shard"]: r["n"] for r in self.read(version).groupBy("shard").agg(F.sum("bytes").alias("n")).collect()}
        return [int(found.get(s, 0)) for s in range(version["shards"])]

    def reshard(self, weights: Sequence[float], cost: Sequence[Sequence[float]] | None = None) -> dict:
        """Give shard j ``weights[j]`` of all bytes, moving as few bytes as that takes; returns the version.

        cost[i][j]: of a byte that goes from old shard i to new shard j (default: 0 where i = j, else 1). The flow is solved on the
        driver from the shards' sizes alone. What stays in a shard are its first files, then come the flows to others: so most
        files stay or move whole, and only those that a border falls into (fewer than there are flows) are cut. The rows of a cut file are
        dealt to the shards that share it, larger rows first, each to the shard that lacks most: sizes meet their goals within about a
        file's smallest rows, or within one row where a single row is larger than what is to be moved. Rows keep their order otherwise.
        """
        v = self.version()
        old = self.sizes(v)
        m, n = len(old), len(weights)
        goal = shares_of(sum(old), weights)
        flow = min_cost_flow(old, goal, cost or [[float(i != j) for j in range(n)] for i in range(m)])
        arcs = []
        for i in range(m):
            at = 0
            for j in sorted((j for j in range(n) if flow[i][j]), key=lambda j: (j != i, j)):
                arcs.append((i, j, at, at + flow[i][j]))
                at += flow[i][j]
        spans = self.spark.createDataFrame(arcs, "shard int, goal int, lo long, hi long")
        files = self.read(v).groupBy("shard", "epoch", "file").agg(F.sum("bytes").alias("bytes"))
        before = Window.partitionBy("shard").orderBy("epoch", "file").rowsBetween(Window.unboundedPreceding, -1)
        placed = files.withColumn("lo", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("hi", F.col("lo") + F.col("bytes"))
        over = placed.alias("f").join(F.broadcast(spans).alias("s"), (F.col("f.shard") == F.col("s.shard")) & (F.col("f.lo") < F.col("s.hi")) & (F.col("s.lo") < F.col("f.hi")))  # at most shards of both layouts rows
        over = over.select("f.shard", "epoch", "file", "goal", (F.least("f.hi", "s.hi") - F.greatest("f.lo", "s.lo")).alias("part"))
        parts = over.groupBy("shard", "epoch", "file").agg(F.array_sort(F.collect_list(F.struct("goal", "part"))).alias("parts"))
        parts = parts.withColumn("goal", F.when(F.size("parts") == 1, F.col("parts")[0]["goal"]).otherwise(-1))
        # files that stay or move whole are runs of one shard; each cut file is a run of its own
        runs = parts.groupBy("shard", "epoch", "goal", F.when(F.col("goal") < 0, F.col("file")).alias("cut")).agg(F.min("file").alias("first"), F.max("file").alias("last"), F.first("parts").alias("parts"))
        runs = runs.collect()  # fewer than twice the flows, for each epoch
        away = [r for r in runs if r["goal"] != r["shard"]]
        if not away:
            version = {**v, "epoch": v["epoch"] + 1, "shards": n}
            self._write(self.read(v).limit(0).select("row", "bytes", "shard"), version["epoch"])
            self._commit(version)
            return version
        moved: dict[tuple[int, int], str] = {}
        for r in away:
            key = (r["epoch"], r["shard"])
            moved[key] = min(moved.get(key, r["first"]), r["first"])
        leaving = self.read(v).join(F.broadcast(self.spark.createDataFrame([(e, s, f) for (e, s), f in moved.items()], "epoch int, shard int, from string")), ["epoch", "shard"]).where(F.col("file") >= F.col("from"))
        cuts = {(r["epoch"], r["shard"], r["cut"]): r["parts"] for r in runs if r["goal"] < 0}
        whole = [(r["epoch"], r["shard"], r["first"], r["last"], r["goal"], None) for r in runs if r["goal"] >= 0]
        table = self.spark.createDataFrame([*whole, *self._dealt(v, cuts)], "epoch int, shard int, first string, last string, goal int, dealt binary").withColumnsRenamed({"epoch": "__e", "shard": "__s"})
        same = (F.col("epoch") == F.col("__e")) & (F.col("shard") == F.col("__s")) & F.col("file").between(F.col("first"), F.col("last"))
        inside = F.conv(F.hex(F.substring("dealt", (2 * F.col("place") + 1).cast("int"), F.lit(2))), 16, 10).cast("int")
        fresh = leaving.join(F.broadcast(table), same).select("row", "bytes", F.coalesce(inside, "goal").alias("shard"))
        epoch = v["epoch"] + 1
        self._write(fresh, epoch)
        gone = {(e, s): f for e, s, f in v["moved"]}
        for key, first in moved.items():
            gone[key] = min(gone.get(key, first), first)
        version = {**v, "epoch": epoch, "shards": n, "moved": [[e, s, f] for (e, s), f in sorted(gone.items())]}
        self._commit(version)
        return version

    def _dealt(self, v: dict, cuts: dict) -> list[tuple]:
        """For each cut file the new shard of each of its rows, two bytes a row; a file's rows are bounded by ``FILE_ROWS``."""
        if not cuts:
            return []
        keys = self.spark.createDataFrame([(e, s, f, [(p["goal"], p["part"]) for p in parts]) for (e, s, f), parts in cuts.items()], "epoch int, shard int, file string, parts array<struct<goal: int, part: long>>")
        rows = self.read(v).select("epoch", "shard", "file", "place", "bytes").join(F.broadcast(keys), ["epoch", "shard", "file"])

        def deal(key, f):
            lack = [[-int(p["part"]), int(p["goal"])] for p in f["parts"].iloc[0]]
            heapq.heapify(lack)
            out = np.zeros(int(f["place"].max()) + 1, dtype=">u2")
            order = np.lexsort((f["place"].to_numpy(), -f["bytes"].to_numpy()))
            for place, size in zip(f["place"].to_numpy()[order].tolist(), f["bytes"].to_numpy()[order].tolist(), strict=True):
                out[place] = lack[0][1]
                heapq.heapreplace(lack, [lack[0][0] + size, lack[0][1]])
            return pd.DataFrame({"epoch": [key[0]], "shard": [key[1]], "first": [key[2]], "last": [key[2]], "goal": [-1], "dealt": [out.tobytes()]})

        found = rows.groupBy("epoch", "shard", "file").applyInPandas(deal, "epoch int, shard int, first string, last string, goal int, dealt binary")
        return [tuple(r) for r in found.collect()]

    def vacuum(self) -> int:
        """Delete the files of which all rows have moved; returns how many."""
        v, gone = self.version(), 0
        for epoch, shard, first in v["moved"]:
            folder, files = self._files(f"{self.path}/data/epoch={epoch}/shard={shard}")
            if files.exists(folder):
                for f in files.listStatus(folder):
                    if f.getPath().getName().startswith("part-") and f.getPath().getName() >= first:
                        gone += bool(files.delete(f.getPath(), False))
        return gone

    def slots(self, *cols: Column) -> DataFrame:
        """``cols`` of the rows, shard, and ``slot``, a row's place in its shard from 0: rows of the files before, and the place
        among the file's. Only these columns are shuffled."""
        rows = self.read().select(*cols, "shard", "epoch", "file", "place")
        files = rows.groupBy("shard", "epoch", "file").agg(F.count("*").alias("n"))
        before = Window.partitionBy("shard").orderBy("epoch", "file").rowsBetween(Window.unboundedPreceding, -1)
        starts = files.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        return rows.join(starts, ["shard", "epoch", "file"]).withColumn("slot", F.col("start") + F.col("place")).drop("start", "epoch", "file", "place")


def op13_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards as the tasks that read them wrote them, resharded to 24 of equal bytes (law ``bytes``).

    A row's size is its text's UTF-8 bytes (null: none) plus 8; rows that repeat are rows of their own, and equal texts may lie in different
    shards, as sizes decide. No rows: no shards are written.
    """
    table = ShardedTable(spark, f"{shared_dir(spark)}/shards")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table.write(docs, "octet_length(coalesce(text, '')) + 8", OLD_SHARDS)
    table.reshard([1.0] * NEW_SHARDS)
    table.vacuum()
    crc = F.crc32(F.encode(F.coalesce("row.text", F.lit("")), "UTF-8"))
    placed = table.slots(F.col("row.doc_id"), F.col("bytes").alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"))
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))
