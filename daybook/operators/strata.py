"""The first rows of strata of any size, and tables that must not move between two readings."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows are dealt into so many parts at least, so that a part is under two per cent of them.
PARTS = 64


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def pin(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that driver and executors share: what is read twice is the same twice,
    and a lost executor costs nothing. Only a local session, as in tests, may name no folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or _local_dir())
    return df.checkpoint()


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi join in which null keys are equal; the right side's keys go."""
    tmp = {k: f"__right_{k}" for k in keys}
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(t)) for k, t in tmp.items()])
    return left.join(right.withColumnsRenamed(tmp), on, how).drop(*tmp.values())


def first_rows(df: DataFrame, strata: Sequence[str], order: Sequence[str], quota: Callable[[Column], Column] | DataFrame, parts: int = PARTS) -> DataFrame:
    """The first rows of each stratum in ascending ``order`` (nulls first; rows that are equal there in any order).

    ``quota`` gives how many: a function of the stratum's number of rows, or a table (strata, __k); strata that it lacks get none.
    Rows are dealt by range of (strata, order), so a stratum that is most of the table lies in many parts and every part is
    in order behind the one before. Counts of the parts say which parts stay whole and which one is cut: only
    a stratum's cut part is sorted and numbered. No strata at all make one stratum.
    """
    n = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("__id", F.monotonically_increasing_id()).repartitionByRange(n, *strata, *order, "__id")
    dealt = pin(dealt.withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy(*strata, "__part").agg(F.count("*").alias("__c"))
    whole = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("__c").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"__before": before, "__n": F.sum("__c").over(whole)})
    if isinstance(quota, DataFrame):
        sizes = null_safe(sizes, quota, strata) if strata else sizes.crossJoin(quota)
    else:
        sizes = sizes.withColumn("__k", quota(F.col("__n")))
    there = sizes.where("__before < __k").drop("__n")
    rows = null_safe(dealt, there, [*strata, "__part"])
    place = F.row_number().over(Window.partitionBy(*strata, "__part").orderBy(*order, "__id"))
    cut = rows.where("__before + __c > __k").withColumn("__place", place).where("__place <= __k - __before")
    return rows.where("__before + __c <= __k").select(*df.columns).unionByName(cut.select(*df.columns))
