"""Scans, schema contracts, loading, normalisation and sinks of source tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.functions.columns import TARGET_SEMANTICS, blank_to_null, parse_money, parse_timestamp, series_id
from daybook.sources.tables import load_sources


@dataclass(frozen=True)
class SourceSpec:
    """A raw source: where it is, how its headers map, which columns it must bring."""

    name: str
    path: str
    renames: dict[str, str] = field(default_factory=dict)
    policy_id: str | None = None
    constants: dict[str, object] = field(default_factory=dict)
    expected: tuple[str, ...] = ()
    required: bool = True


# ---- scans and sinks


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_parquet(spark: SparkSession, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def scan_table(spark: SparkSession, name: str, cols: Sequence[str], where: dict[str, object]) -> DataFrame:
    df = spark.table(name)
    for c, v in where.items():
        df = df.where(F.col(c) == F.lit(v))
    return df.select(*cols)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


# ---- contracts and loading


def bronze_prepare(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Renamed headers, the source's name and policy, the file, the time of loading, constants."""
    stamps = {"source_name": F.lit(spec.name), "source_policy_id": F.lit(spec.policy_id or spec.name), "source_file_path": F.col("_metadata.file_path"), "loaded_at": F.current_timestamp()}
    return df.withColumns(stamps | {k: F.lit(v) for k, v in spec.constants.items()}).withColumnsRenamed(spec.renames)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def validate_sources(spark: SparkSession, specs: Sequence[SourceSpec]) -> None:
    """Fails before anything is written if a required source is missing or empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for s in specs:
        p = jvm.org.apache.hadoop.fs.Path(s.path)
        fs = p.getFileSystem(conf)
        if s.required and not (fs.exists(p) and fs.getContentSummary(p).getLength() > 0):
            raise FileNotFoundError(f"source {s.name} is missing or empty: {s.path}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order, tolerantly cast; what the source lacks is null, all lacking is an error."""
    if not any(f.name in df.columns for f in schema):
        raise ValueError("no column of the target is in the source")
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def load_table(spark: SparkSession, frames: dict[str, DataFrame], schema: T.StructType, path: str) -> DataFrame:
    """Replace the table at ``path`` by all its sources, each conformed to the schema; (source_name, loaded_rows)."""
    return load_sources(spark, {name: conform(df, schema) for name, df in frames.items()}, path)


def load_inline(spark: SparkSession, rows: list | pd.DataFrame, spec: SourceSpec, schema: T.StructType, path: str) -> DataFrame:
    """``load_table`` of a frame in the driver's memory: headers mapped, constants added, the expected columns checked."""
    df = spark.createDataFrame(rows).withColumnsRenamed(spec.renames).withColumns({k: F.lit(v) for k, v in spec.constants.items()})
    return load_table(spark, {spec.name: require_columns(df, spec.expected)}, schema, path)


# ---- normalisation


def normalize_lines(df: DataFrame) -> DataFrame:
    """Typed order lines from raw text columns (quantity_raw, unit_price_raw, date_raw, time_raw, article_raw)."""
    ts = parse_timestamp(F.concat_ws(" ", "date_raw", "time_raw"))
    return df.withColumns({"quantity": F.col("quantity_raw").try_cast("double"), "unit_price": parse_money("unit_price_raw"), "sold_at": ts, "dt": F.to_date(ts), "product_id": F.upper(F.trim("article_raw"))})


def enrich_lines(df: DataFrame, location: str) -> DataFrame:
    df = df.withColumn("location_id", F.lit(location))
    return df.withColumns({"series_id": series_id("location_id", "product_id"), "revenue": F.col("quantity") * F.col("unit_price"), "weekday": F.weekday("dt"), "month": F.month("dt")})


def lines_to_daily(df: DataFrame) -> DataFrame:
    return df.groupBy("dt", "location_id", "product_id", "series_id").agg(F.sum("quantity").alias("observed_demand_qty"), F.sum("revenue").alias("observed_revenue_net"))


def stage_columns(df: DataFrame, casts: dict[str, tuple[str, str]], blanks: Sequence[str]) -> DataFrame:
    """New typed columns {name: (source column, type)}; blank text becomes null."""
    return df.withColumns({n: F.col(c).try_cast(t) for n, (c, t) in casts.items()} | {b: blank_to_null(b) for b in blanks})


def normalize_registry(df: DataFrame) -> DataFrame:
    status = F.lower(F.trim("review_status"))
    status = F.when(status == "quarantined", "quarantine").when(status.isin("allowed", "quarantine", "rejected"), status).otherwise("unreviewed")
    flags = {c: F.coalesce(F.col(c).try_cast("boolean"), F.lit(False)) for c in df.columns if c.endswith("_allowed")}
    return df.withColumns(flags | {"review_status": status, "source_priority": F.coalesce(F.col("source_priority").try_cast("int"), F.lit(999))})


def allowed_datasets(reg: DataFrame) -> DataFrame:
    ok = "source_kind = 'dataset' AND commercial_use_allowed AND ml_training_allowed AND include_in_training = 'include' AND review_status = 'allowed'"
    return reg.where(ok).select("dataset_source").distinct()


def allowed_providers(reg: DataFrame) -> DataFrame:
    return reg.where("source_kind = 'provider' AND review_status = 'allowed' AND commercial_use_allowed AND caching_allowed")


def quarantined(reg: DataFrame) -> DataFrame:
    return reg.where((F.col("source_kind") == "provider") & (F.coalesce("review_status", F.lit("unreviewed")) != "allowed"))


def provider_enabled(reg: DataFrame, allow_contract: bool) -> DataFrame:
    """runtime_enabled: allowed, or in quarantine with a contract where contracts are permitted."""
    contract = (F.col("review_status") == "quarantine") & F.coalesce("contract_required", F.lit(False)) & F.lit(allow_contract)
    return reg.withColumn("runtime_enabled", (F.col("review_status") == "allowed") | contract)


def label_flags(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Typed values, raw copies, and flags for missing and for unreadable ones."""
    raw = df.withColumns({f"{c}_raw": F.col(c) for c in types})
    typed = {c: F.col(f"{c}_raw").try_cast(t) for c, t in types.items()}
    missing = {f"{c}_missing_flag": F.col(f"{c}_raw").isNull() for c in types}
    broken = {f"{c}_parse_error_flag": F.col(f"{c}_raw").isNotNull() & F.col(f"{c}_raw").try_cast(t).isNull() for c, t in types.items()}
    return raw.withColumns(typed | missing | broken)


def standardize_first_party(df: DataFrame) -> DataFrame:
    """A customer's minimal feed as canonical rows: invalid rows go, label facts follow from stock-outs."""
    has = lambda c: c in df.columns
    out = df.withColumn("dt", F.col("dt").try_cast("date")).where("dt IS NOT NULL AND location_id IS NOT NULL AND product_id IS NOT NULL AND observed_demand_qty >= 0")
    stock = F.coalesce(F.col("observed_stockout_flag"), F.lit(False)) if has("observed_stockout_flag") else F.lit(False)
    known = F.col("observed_stockout_flag").isNotNull() if has("observed_stockout_flag") else F.lit(False)
    return out.withColumns({
        "series_id": series_id("location_id", "product_id"), "target_semantics": F.lit(TARGET_SEMANTICS[0]), "target_source": F.lit("observed_sales"), "censor_flag": stock,
        "label_quality_score": F.when(stock, 0.5).when(known, 1.0).otherwise(0.75), "usable_for_training_flag": ~stock, "calendar_month": F.month("dt"), "calendar_day_of_week": F.weekday("dt"),
    })


def unpivot_columns(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long, without null values."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(list(ids), list(cols), name, value).where(F.col(value).isNotNull())


def fill_defaults(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """0, false or '0' for what is missing, and a flag that says what was known."""
    default = {"boolean": F.lit(False), "string": F.lit("0")}
    kinds = dict(df.dtypes)
    known = {f"{c}_known_flag": F.col(c).isNotNull() for c in cols}
    return df.withColumns(known).withColumns({c: F.coalesce(F.col(c), default.get(kinds[c], F.lit(0).cast(kinds[c]))) for c in cols})


def in_sources(c: str, names: Sequence[str]) -> Column:
    return F.col(c).isin(*names) if names else F.lit(True)


def not_in_sources(c: str, names: Sequence[str]) -> Column:
    return ~F.col(c).isin(*names) if names else F.lit(True)


# ---- encoders fitted on training rows


def fit_encoder(df: DataFrame, c: str) -> DataFrame:
    """(value, code): categories in order from 2 on; 0 is missing and 1 unknown."""
    from pyspark.sql.window import Window

    values = df.select(F.col(c).alias("value")).where("value IS NOT NULL").distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy("value")) + 1)


def encode(df: DataFrame, fitted: DataFrame, c: str) -> DataFrame:
    out = df.join(fitted.withColumnRenamed("value", c), c, "left")
    return out.withColumn(f"{c}_code", F.when(F.col(c).isNull(), 0).otherwise(F.coalesce("code", F.lit(1)))).drop("code")


def fit_median(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.percentile(c, 0.5).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols if row[c] is not None}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.fillna(medians)


def zero_only(df: DataFrame, cols: Sequence[str]) -> list[str]:
    row = df.agg(*[F.max((F.coalesce(F.col(c), F.lit(1.0)) != 0).cast("int")).alias(c) for c in cols]).first()
    return [c for c in cols if not row[c]]


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c).alias(f"{n}{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{c}"], row[f"s{c}"] or 1.0) for c in cols}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in fitted.items()})


def ledger(df: DataFrame, keys: Sequence[str], signs: dict[str, int]) -> DataFrame:
    """Daily facts as signed movements, where there are any."""
    rows = df.unpivot(list(keys), list(signs), "kind", "qty").where("qty > 0")
    sign = F.element_at(F.create_map(*[x for k, v in signs.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    return rows.withColumn("qty", F.col("qty") * sign)
