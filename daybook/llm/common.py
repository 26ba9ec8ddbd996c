"""Helpers shared by the operators: staged tables, connected components and lean Python tasks."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Python task handles so many bytes of a batch at once.
PART_BYTES = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name in the one that driver and executors share (``spark.checkpoint.dir``).

    Only a local session, as in tests, may name none: it gets a temporary one. On a cluster
    tasks would write to their own disks, so there that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = local_dir()
    return f"{named.rstrip('/')}/daybook-{uuid.uuid4().hex}"


@functools.cache
def local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def stage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and gives the next
    join plain scans on both sides, so that AQE may split its skewed partitions.
    ``forget`` deletes the files.
    """
    folder = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.staged_in = folder
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more; others are left alone."""
    for t in tables:
        if folder := t.__dict__.pop("staged_in", None):
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], part_bytes: int = PART_BYTES) -> Callable:
    """``run``, a function for mapInArrow, on parts of batches of about ``part_bytes`` (one row at least),
    whatever Arrow's own batches hold. When the task ends, free memory goes back to the system, so that
    workers that Spark keeps for later stages are small."""

    def parts(batches):
        for batch in batches:
            rows = max(1, int(batch.num_rows * part_bytes / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, rows):
                yield from halves(batch.slice(at, rows))

    def halves(part):
        # rows differ in size: a part that is still far too large is cut further
        if part.num_rows > 1 and part.get_total_buffer_size() and part.nbytes > 2 * part_bytes:
            mid = part.num_rows // 2
            yield from halves(part.slice(0, mid))
            yield from halves(part.slice(mid))
        else:
            yield part

    def task(batches):
        try:
            yield from run(parts(batches))
        finally:
            give_back()

    return task


def give_back() -> None:
    """Return the memory that this process holds and doesn't use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph, by rounds of hooking, jumping and contraction.

    edges: (a, b), integers; self-loops, repeats and either direction are allowed, nulls
    are dropped. Returns (node, component) for every node that has an edge to another
    node; component is the smallest node reachable. Each round hooks a node to its
    smallest neighbour (an aggregation that combines before its shuffle), follows the
    pointers once more and rewrites the edges between what is left, so stars vanish
    in one round and a path of length n in about log n. No group of edges is ever
    gathered in a task: hubs meet joins of staged tables, which AQE splits.
    """
    a, b = F.col("a"), F.col("b")
    live = stage(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
        "edges",
    )
    labels = None
    while labels is None or not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(b.alias("a"), a.alias("b")))
        hook = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(a.alias("node"), F.least(a, b).alias("parent")), "hook")
        up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jump = stage(hook.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent")), "jump")
        of = lambda k: jump.select(F.col("node").alias(k), F.col("parent").alias(f"p{k}"))
        rest = stage(
            live.join(of("a"), "a")
            .join(of("b"), "b")
            .where(F.col("pa") != F.col("pb"))
            .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
            .distinct(),
            "edges",
        )
        forget(live, hook)
        live = rest
        if labels is None:
            labels = jump.withColumnRenamed("parent", "component")
            labels.staged_in = jump.__dict__.pop("staged_in")
        else:
            step = jump.select(F.col("node").alias("component"), "parent")
            newer = stage(labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
            forget(labels, jump)
            labels = newer
    forget(live)
    return labels
