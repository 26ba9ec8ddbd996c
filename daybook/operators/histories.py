"""Statistics of all that a series had before each of its rows, in linear-logarithmic time and without Python."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.operators.strata import null_safe

#: Children of a node of the rank tree, as a power of two.
FAN_BITS = 4
#: Within a block the weights of an exponential mean fall by 2^-40 at most, so that they can be divided out.
BLOCK_BITS = 40


def expanding_quantile(df: DataFrame, keys: Sequence[str], order: str, y: str, out: str, q: float = 0.5) -> DataFrame:
    """Adds the q-quantile (interpolated) of the non-null values of ``y`` in the rows before; null where there are none.

    Values are ranked within their series. A tree over the ranks has 16 children a node; at each node, running counts in the series' order
    say how many values of each child have been seen, and a row's search for the k-th smallest goes down to the child that holds it.
    So a level is one window over nodes, there are log16(rows of the longest series) levels, and each row costs the same at each, however
    long its history. Rows of a series that are equal in ``order`` stand in any order. One more pass finds the longest series.
    """
    row, v = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.col(y).cast("double")
    names = [f"__key_{i}" for i in range(len(keys))]
    w = Window.partitionBy(*names).orderBy("__day")
    base = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(order).alias("__day"), v.alias("__v"), row.alias("__row"))
    longest = base.groupBy(*names).count().agg(F.max("count")).first()[0] or 1
    levels = max(1, math.ceil(math.log2(max(2, longest)) / FAN_BITS))
    base = base.withColumns({"__pos": F.row_number().over(w), "__m": F.count("__v").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    base = base.withColumn("__rank", F.row_number().over(Window.partitionBy(*names).orderBy(F.asc_nulls_last("__v"), "__pos")) - 1)
    at = (F.col("__m") - 1) * F.lit(q)
    low, high = F.floor(at) + 1, F.ceil(at) + 1
    # a row is a value, a search for the value below its quantile and, where that is another, one for the value above
    kind = lambda k, need, node: F.struct(F.lit(k).alias("kind"), need.cast("long").alias("need"), node.cast("long").alias("node"))
    roles = F.array(
        F.when(F.col("__v").isNotNull(), kind(0, F.lit(0), F.lit(0))),
        kind(1, low, F.when(F.col("__m") > 0, 0).otherwise(-1)),
        F.when((F.col("__m") > 0) & (low != high), kind(2, high, F.lit(0))),
    )
    rows = base.withColumn("__r", F.explode(F.filter(roles, lambda x: x.isNotNull())))
    rows = rows.select(*names, "__pos", "__rank", "__m", F.when(F.col("__r.kind") == 0, F.col("__v")).alias("__v"), F.when(F.col("__r.kind") == 1, F.col("__row")).alias("__row"), F.col("__r.kind").alias("__kind"), F.col("__r.need").alias("__need"), F.col("__r.node").alias("__node"))
    fan = 1 << FAN_BITS
    for level in reversed(range(levels)):
        node = Window.partitionBy(*names, "__node").orderBy("__pos", F.desc("__kind")).rowsBetween(Window.unboundedPreceding, 0)
        child = F.shiftright("__rank", level * FAN_BITS).bitwiseAND(fan - 1)
        rows = rows.withColumns({f"__c{j}": F.count(F.when((F.col("__kind") == 0) & (child <= j), 1)).over(node) for j in range(fan - 1)})
        found = sum((F.when(F.col(f"__c{j}") < F.col("__need"), 1).otherwise(0) for j in range(fan - 1)), F.lit(0))
        rows = rows.withColumn("__child", found)
        less = F.element_at(F.array(F.lit(0).cast("long"), *[F.col(f"__c{j}") for j in range(fan - 1)]), F.col("__child") + 1)
        down = F.when(F.col("__kind") == 0, F.shiftright("__rank", level * FAN_BITS)).when(F.col("__node") < 0, -1).otherwise(F.col("__node") * fan + F.col("__child"))
        rows = rows.withColumns({"__need": F.when(F.col("__kind") > 0, F.col("__need") - less).otherwise(0), "__node": down.cast("long")}).drop("__child", *[f"__c{j}" for j in range(fan - 1)])
    rows = rows.withColumn("__v", F.max("__v").over(Window.partitionBy(*names, "__node"))).where("__kind > 0")
    both = rows.groupBy(*names, "__pos").agg(F.first("__row", ignorenulls=True).alias("__row"), F.min(F.when(F.col("__node") >= 0, F.col("__v"))).alias("__low"), F.max(F.when(F.col("__node") >= 0, F.col("__v"))).alias("__high"), F.first("__m").alias("__m"))
    share = at - F.floor(at)
    return both.select("__row.*", F.when(F.col("__m") > 0, F.col("__low") * (1 - share) + F.col("__high") * share).alias(out))


def exponential_mean(df: DataFrame, keys: Sequence[str], order: str, y: str, out: str, span: int) -> DataFrame:
    """Adds the exponential mean m <- m + a (x - m), a = 2 / (span + 1), of the values before; it begins with the first value.

    Null values change nothing; where there was no value before, the mean is null. The recursion is an affine map of m, and maps of
    neighbouring stretches combine to one: (decay, sum). Blocks of a series are running sums of scaled values; a window over blocks
    alone folds the maps of those before, as many as a double can tell from 0.
    """
    x, a = F.col(y).cast("double"), 2.0 / (span + 1)
    d = 1.0 - a
    w = Window.partitionBy(*keys).orderBy(order)
    if d == 0.0:
        return df.withColumn(out, F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    size = max(1, math.floor(BLOCK_BITS / -math.log2(d)))
    back = math.ceil(1100 / (-math.log2(d) * size))
    rows = df.withColumn("__i", F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"__block": F.floor((F.col("__i") - 1) / size), "__o": F.pmod(F.col("__i") - 1, F.lit(size))})
    scaled = F.when(x.isNull(), 0.0).when(F.col("__i") == 1, x).otherwise(a * x) * F.pow(F.lit(d), -F.col("__o"))
    rows = rows.withColumn("__t", scaled).withColumn("__s", F.sum("__t").over(Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*keys, "__block").agg((F.sum("__t") * d ** (size - 1)).alias("__b"))
    earlier = F.collect_list("__b").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(-back, -1))
    ends = ends.withColumn("__carry", F.aggregate(earlier, F.lit(0.0), lambda m, b: m * d**size + b)).drop("__b")
    got = null_safe(rows, ends, [*keys, "__block"])
    mean = F.when(F.col("__i") > 0, F.pow(F.lit(d), F.col("__o") + 1) * F.col("__carry") + F.pow(F.lit(d), F.col("__o")) * F.col("__s"))
    return got.withColumn("__m", mean).withColumn(out, F.lag("__m").over(w)).select(*df.columns, out)
