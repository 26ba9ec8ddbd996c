"""Quality panels, training matrices, reference universes and typed training bundles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.functions import columns as C
from daybook.operators import evaluation as E
from daybook.operators import relational as R
from daybook.sources import readers as S

ROLES = ("static_cat", "static_real", "known_cat", "known_real", "unknown_cat", "unknown_real")


def role_of(name: str, kind: str) -> str | None:
    """A feature's role by its name and type: static attributes, what is known of the target day, and the rest."""
    if name in ("dt", "target_dt", "decision_timestamp", "split_bucket", "target", "residual", "delta_log_wow"):
        return None
    real = kind in ("double", "float", "int", "bigint")
    if name in ("dataset_source", "location_id", "product_id", "history_bucket"):
        return "static_cat"
    if name.startswith("target_") and not name.startswith("target_lag") and name not in ("target_source", "target_usable"):
        return "known_real" if real else "known_cat"
    return "unknown_real" if real else "unknown_cat"


def quality_panel(features: DataFrame, split: str = "split_bucket", source: str = "dataset_source") -> DataFrame:
    """Features with defaults for what is missing, flags of what was known, counts of both, and source weights."""
    reals = [c for c, t in features.dtypes if t == "double" and role_of(c, t)]
    missing = sum((F.col(c).isNull().cast("int") for c in reals), F.lit(0))
    app = R.applicability(features, source, reals)
    out = features.withColumn("missing_feature_count", missing).join(app, source, "left")
    unavailable = sum(((F.coalesce(f"{c}_applicable", F.lit(0)) == 0).cast("int") for c in reals), F.lit(0))
    out = out.withColumn("unavailable_feature_count", unavailable).drop(*[f"{c}_applicable" for c in reals])
    out = S.fill_defaults(out, reals)
    return out.join(R.source_weights(features, split, source).select(split, source, "source_weight"), [split, source], "left")


def training_matrix(quality: DataFrame) -> DataFrame:
    """Each feature and its role-suffixed alias, beside ids, dates and targets; horizon is one day."""
    kinds = dict(quality.dtypes)
    aliases = [F.col(c).alias(f"{c}_{r}") for c in quality.columns if (r := role_of(c, kinds[c]))]
    return quality.select(F.lit(1).alias("horizon_days"), *quality.columns, *aliases)


def typed_projection(df: DataFrame) -> DataFrame:
    """Narrow types for files: reals as floats, flags as bytes."""
    narrow = {"double": "float", "boolean": "tinyint", "decimal": "float"}
    return df.select(*[F.col(c).cast(narrow[t]).alias(c) if t in narrow else F.col(c) for c, t in df.dtypes])


def training_bundle(matrix: DataFrame, keys: Sequence[str], day: str = "dt", split: str = "split_bucket", sources: Sequence[str] = ()) -> dict[str, DataFrame]:
    """train, tuning (val) and valid (test) rows: scope and eligibility (the latter not on test), typed, with a
    time index that goes on from split to split."""
    rows = matrix.where(S.in_sources("dataset_source", list(sources)))
    fine = (F.col(split) == "test") | C.eligible(matrix.columns)
    indexed = rows.where(fine).withColumn("time_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(day)) - 1)
    typed = typed_projection(indexed)
    return {name: typed.where(F.col(split) == part) for name, part in (("train", "train"), ("tuning", "val"), ("valid", "test"))}


def exclusion_report(matrix: DataFrame, split: str = "split_bucket") -> DataFrame:
    """Per split what eligibility keeps and drops, in one pass."""
    return matrix.groupBy(split).agg(F.count("*").alias("input_rows"), F.count_if(C.eligible(matrix.columns)).alias("kept_rows"))


def reference_splits(sales: DataFrame, product: str = "product_id", day: str = "dt", qty: str = "qty", max_zero: float = 1 / 3) -> DataFrame:
    """Every product on every date of the calendar, 0 where not sold, is_missing_day where nothing was;
    products with too many zero days go; 70/15/15 by date within each product."""
    per = sales.groupBy(product, day).agg(F.sum(qty).alias(qty))
    calendar = per.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    cells = R.densify(R.with_scalar(per.select(product).distinct(), calendar), "lo", "hi", day)
    traded = per.select(day).distinct().withColumn("__traded", F.lit(True))
    full = cells.join(per, [product, day], "left").join(traded, day, "left")
    full = full.select(product, day, F.coalesce(qty, F.lit(0.0)).alias(qty), F.col("__traded").isNull().cast("int").alias("is_missing_day"))
    keep = full.groupBy(product).agg(F.avg((F.col(qty) == 0).cast("double")).alias("z")).where(F.col("z") <= max_zero).select(product)
    return E.row_split(full.join(keep, product, "left_semi"), [product], day=day)


def refit_seed(train: DataFrame, val: DataFrame, test_start, day: str = "dt") -> DataFrame:
    """History strictly before the test, tagged; an error if none of it may train."""
    seed = train.unionByName(val).where(F.col(day) < F.lit(test_start)).withColumn("is_seed", F.lit(True))
    if seed.where(C.eligible(seed.columns)).isEmpty():
        raise ValueError("no trainable seed row before the test")
    return seed


def refit_weights(history_days: str) -> Callable:
    """Share of the target source by days of its history: .70 at 30, .85 at 60, .95 at 90, 1 from 180 on, linear between."""
    d, points = F.col(history_days).cast("double"), [(0.0, 0.0), (30.0, 0.70), (60.0, 0.85), (90.0, 0.95), (180.0, 1.0)]
    out = None
    for (a, x), (b, y) in zip(points[:-1], points[1:], strict=True):
        part = F.lit(x) + (d - a) * ((y - x) / (b - a))
        out = F.when(d < b, part) if out is None else out.when(d < b, part)
    return out.otherwise(F.lit(1.0))
