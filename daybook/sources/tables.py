"""Tables that are replaced whole, and manifests of source files of any size."""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files are hashed in blocks of so many bytes; digests of so many blocks make one node of the tree.
BLOCK, FAN_OUT = 8 << 20, 1024


class VersionedTable:
    """A table of whole versions: ``data/<version>/`` holds Parquet files, and numbered records in ``commits/`` name a version each.

    The record with the highest number names the table as it is. A record is written beside and renamed to its number after all files of
    its version are there; the rename fails where the number is taken. So a reader sees one whole version at any time, a load that
    dies leaves the last one, and of two loads that overlap the second says so. ``keep`` earlier versions stay for readers that
    have begun with them; ``vacuum`` deletes all others, and files of loads that died.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(self.path).getFileSystem(self._conf)

    def _list(self, folder: str) -> list[str]:
        where = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._files.listStatus(where)) if self._files.exists(where) else []

    def commits(self) -> list[dict]:
        """All records that are there, in their order."""
        names = [n for n in self._list("commits") if n.endswith(".json") and not n.startswith((".", "_"))]
        if not names:
            return []
        found = self.spark.read.schema("number int, version string").json(f"{self.path}/commits").where("number IS NOT NULL").collect()
        return sorted(({"number": r["number"], "version": r["version"]} for r in found), key=lambda r: r["number"])

    def read(self) -> DataFrame:
        done = self.commits()
        if not done:
            raise FileNotFoundError(f"no version of {self.path} is committed")
        return self.spark.read.parquet(f"{self.path}/data/{done[-1]['version']}")

    def replace(self, df: DataFrame) -> str:
        """Write a version and commit it; returns its name."""
        number = (self.commits() or [{"number": 0}])[-1]["number"] + 1  # before the files: a load that is overtaken fails
        version = f"{number:06d}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/data/{version}")
        self._commit(number, version)
        return version

    def _commit(self, number: int, version: str) -> None:
        draft, final = self._path(f"{self.path}/drafts/{version}.json"), self._path(f"{self.path}/commits/{number:06d}.json")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps({"number": number, "version": version}).encode() + b"\n"))
        out.close()
        self._files.mkdirs(final.getParent())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        try:
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(rename, 0))
        except Exception as e:
            if self._files.exists(final):
                raise RuntimeError(f"another load of {self.path} was committed meanwhile") from e
            raise

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete versions before the last ``keep`` earlier ones, and those that were never committed; returns their names."""
        done = self.commits()
        live = {r["version"] for r in done[-1 - keep :]}
        gone = [v for v in self._list("data") if v not in live]
        for v in gone:
            self._files.delete(self._path(f"{self.path}/data/{v}"), True)
        for r in done[: -1 - keep]:
            self._files.delete(self._path(f"{self.path}/commits/{r['number']:06d}.json"), False)
        for d in self._list("drafts"):
            self._files.delete(self._path(f"{self.path}/drafts/{d}"), False)
        return gone


# ---- manifests


def file_hashes(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, sha256) of files (path, length): the SHA-256 of a file of one block, else of its blocks' digests as a tree.

    Tasks read byte ranges, so a file is hashed side by side and may be larger than any row; digests of ``FAN_OUT`` blocks make a node,
    nodes make the next level, until one is left. Empty files have the digest of nothing.
    """

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            out = []
            for path, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, name = fs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with files.open_input_file(name) as f:
                    f.seek(at * block)
                    left = min(block, n - at * block)
                    while left > 0 and (data := f.read(min(left, 1 << 20))):
                        digest.update(data)
                        left -= len(data)
                if left > 0:
                    raise OSError(f"{path} is shorter than it was")
                out.append(digest.digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["path", "place", "digest"])

    last = F.greatest(F.ceil(F.col("length") / block) - 1, F.lit(0)).cast("long")
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("place"), "length")
    level = blocks.repartition(F.col("path"), F.col("place")).mapInArrow(run, "path string, place long, digest binary")
    largest = files.agg(F.max("length")).first()[0] or 0
    count = max(1, -(-largest // block))
    while count > 1:  # files differ in height: a node of one digest is that digest
        parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: F.hex(x["digest"]))
        node = level.groupBy("path", F.floor(F.col("place") / FAN_OUT).alias("place")).agg(parts.alias("parts"))
        joined = F.unhex(F.array_join("parts", ""))
        level = node.select("path", "place", F.when(F.size("parts") == 1, joined).otherwise(F.unhex(F.sha2(joined, 256))).alias("digest"))
        count = -(-count // FAN_OUT)
    return level.select("path", F.lower(F.hex("digest")).alias("sha256"))


def source_manifest(spark: SparkSession, paths: dict[str, str], counts: DataFrame, run_id: str, content_hash: bool = True, policies: dict[str, str | None] | None = None, block: int = BLOCK) -> DataFrame:
    """Per source: run, policy, path, files, bytes, newest change, the SHA-256 of its files' hashes in their order, and ``counts`` (source_name, loaded_rows).

    Names, sizes and times come without reading any content. Empty files, which Spark's scans leave out, count as
    none, and a source without files has 0 of them.
    """
    files = None
    for name, path in paths.items():
        f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.lit(name).alias("source_name"), "path", "length", "modificationTime")
        files = f if files is None else files.unionByName(f)
    per = files.groupBy("source_name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified_at"))
    if content_hash:
        hashed = files.select("source_name", "path").join(file_hashes(files.select("path", "length").distinct(), block), "path")
        per = per.join(hashed.groupBy("source_name").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256")), "source_name", "left")
    rows = [(n, (policies or {}).get(n), p, run_id) for n, p in paths.items()]
    known = spark.createDataFrame(rows, "source_name string, source_policy_id string, source_path string, run_id string")
    out = known.join(per, "source_name", "left").withColumns({"files": F.coalesce("files", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))})
    return out.join(counts, "source_name", "left")


def publish_manifest(manifest: DataFrame, policy: Column | str = "source_policy_id") -> DataFrame:
    """The manifest as it is published: a policy that is missing or blank is the source's name, numbers and times are typed."""
    typed = {"files": "long", "bytes": "long", "loaded_rows": "long", "modified_at": "timestamp"}
    out = manifest.withColumn("source_policy_id", F.coalesce(F.nullif(F.trim(policy), F.lit("")), "source_name"))
    return out.withColumns({c: F.col(c).cast(t) for c, t in typed.items() if c in out.columns})


def load_sources(spark: SparkSession, frames: dict[str, DataFrame], path: str) -> DataFrame:
    """Replace the table at ``path`` by all its sources; (source_name, loaded_rows) as the committed version has them."""
    table = VersionedTable(spark, path)
    out = None
    for name, df in frames.items():
        part = df.withColumn("source_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    table.replace(out)
    loaded = table.read().groupBy("source_name").agg(F.count("*").alias("loaded_rows"))
    names = spark.createDataFrame([(n,) for n in frames], "source_name string")
    return names.join(loaded, "source_name", "left").fillna(0, ["loaded_rows"])

