"""Which columns may be read, projected and learned from, and what is known of each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.operators import selection as FS
from daybook.sources.readers import conform

STATIC_AND_KNOWN = ("static_cat", "static_real", "known_cat", "known_real")
KNOWN = ("known_cat", "known_real")

# Words in a column's name that tell the system it comes from, first match first.
SYSTEMS = (
    ("weather", ("weather_",), (), ()),
    ("data_quality", ("label_quality_score", "data_quality_"), (), ()),
    ("calendar_operational", ("target_", "current_"), (), ()),
    ("macro", ("fr_", "gdp_", "lending_", "government_"), (), ()),
    ("events", ("event_", "major_"), (), ()),
    ("calendar", (), ("_holiday_name", "_holiday_flag"), ()),
    ("operations", (), (), ("stockout", "closure", "saturation", "restriction", "censor", "anomaly", "missing_sales", "day_complete")),
    ("pricing", (), (), ("price", "discount", "promo")),
)
METADATA = ("dataset_source", "client_id", "source_role", "is_synthetic_source", "country_code", "region_code", "city_name", "product_family", "product_subfamily", "product_taxonomy_depth")
SCOPES = (
    ("target_calendar_known", ("target_", "sin_target_", "cos_target_"), (), ()),
    ("decision_day_history", ("field_baseline_",), (), ()),
    ("historical_observed", ("lag_",), (), ("_lag_",)),
    ("decision_day_history", ("rolling_",), ("_rate_7", "_rate_28"), ("_rolling_",)),
    ("decision_day_observed", ("current_", "observed_"), (), ()),
    ("pipeline_metadata", ("data_quality_",), (), ()),
)
LAG_HOURS = {"macro": 744, "weather": 24, "events": 24}

REGISTRY_TYPES = {
    "feature_name": "string", "feature_family": "string", "tft_role": "string", "available_at_prediction": "boolean", "source_system": "string",
    "missing_policy": "string", "default_value": "string", "include_in_training": "boolean", "allow_constant": "boolean", "notes": "string",
}
FORECAST_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("dataset_source", "location_id")]
    + [T.StructField("dt", T.DateType()), T.StructField("forecast_generated_at", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude", "weather_temperature_mean", "weather_temperature_min", "weather_temperature_max", "weather_precipitation_sum", "weather_relative_humidity_mean", "weather_wind_speed_mean")]
    + [T.StructField(c, T.StringType()) for c in ("source_name", "source_policy_id", "source_policy_ids")]
    + [T.StructField("provider_count", T.IntegerType()), T.StructField("weather_available_flag", T.BooleanType()), T.StructField("weather_observation_type", T.StringType())]
)


def weather_forecasts(feed: DataFrame) -> DataFrame:
    """``feed`` under the forecast contract: its columns cast, those it lacks null, tagged ``forecast``.

    A forecast for a day counts only if it was generated before that day began; rows that come later, that say no time of
    generation or that have no day go, as features made of them would know the future. A feed without rows gives the typed empty table.
    """
    rows = conform(feed, FORECAST_SCHEMA).withColumn("weather_observation_type", F.lit("forecast"))
    return rows.where(F.col("forecast_generated_at") < F.col("dt").cast("timestamp"))


def _first_match(name: Column, rules: Sequence[tuple], extra: Sequence[tuple[Column, str]] = (), default: str = "") -> Column:
    tests = [(reduce(Column.__or__, [*[name.startswith(p) for p in starts], *[name.endswith(e) for e in ends], *[name.contains(i) for i in inside]]), out) for out, starts, ends, inside in rules]
    return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed([*tests, *extra]), F.lit(default))


def feature_contract(columns: DataFrame, profile: str = "post_close", name: str = "feature", role: str = "role") -> DataFrame:
    """Of each named column: source system, decision-time scope, publication lag, leakage risk and why it is blocked.

    A trailing role suffix of the name (``_known_real`` and so on) is not part of it. ``blocked`` is null for
    columns that may be used; with the profile ``pre_close_d_plus_1`` what the day itself tells is blocked too.
    """
    n = F.regexp_replace(F.col(name), "_(static|known|unknown)_(cat|real)$", "")
    out = columns.withColumns({
        "source_system": _first_match(n, SYSTEMS, [(n.isin(*METADATA), "metadata"), (n.endswith("_status"), "data_quality")], "operations"),
        "decision_time_scope": _first_match(n, SCOPES, default="static_or_planned"),
        "available_at_prediction": F.col(role).isin(*STATIC_AND_KNOWN),
    })
    system, scope = F.col("source_system"), F.col("decision_time_scope")
    late = (system == "weather") & (scope != "historical_observed")
    risk = F.when((F.col(role).isin(*KNOWN) & (scope == "decision_day_observed")) | late, "medium").otherwise("low")
    why = F.when(scope.isin("decision_day_observed", "decision_day_history"), scope).when(late, "weather_not_point_in_time")
    return out.withColumns({
        "max_publication_lag_hours": reduce(lambda rest, x: F.when(system == x[0], x[1]).otherwise(rest), LAG_HOURS.items(), F.lit(0)),
        "leakage_risk_level": risk, "decision_profile": F.lit(profile), "blocked": why if profile == "pre_close_d_plus_1" else F.lit(None).cast("string"),
    })


def projection_columns(df: DataFrame, required: Sequence[str], explicit: Sequence[str] = ()) -> list[str]:
    """The columns to read, in the table's order: required ones, numbers and flags, and features mapped by name."""
    plain = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema if f.name in {*required, *explicit} or isinstance(f.dataType, plain)]


def model_features(df: DataFrame, roles: Mapping[str, str], excluded: Sequence[str] = (), identifiers: Sequence[str] = (), zero_only: bool = False) -> dict[str, list[str]]:
    """Model inputs: columns with a role, less excluded ones, identifiers and those with one value only.

    With ``zero_only`` a column goes only if it is zero in every row, and other constants stay: whether a flag or a
    static attribute varies is then no matter of how many rows a table has. One aggregation finds the constant ones. Returns features, constant and
    identifiers.
    """
    mapped = [c for c in df.columns if c in roles and c not in {*excluded, *identifiers}]
    kept = (FS.drop_zero_only if zero_only else FS.drop_constant)(df, mapped) if mapped else []
    return {"features": kept, "constant": [c for c in mapped if c not in kept], "identifiers": [c for c in identifiers if c in df.columns]}


def cast_feature_registry(df: DataFrame) -> DataFrame:
    """The feature registry with its columns' types; missing columns and unreadable values are null."""
    return df.select(*[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in REGISTRY_TYPES.items()])


def provider_snapshot(registry: DataFrame, ids: Sequence[str], allow_contract: bool, facts: Sequence[str] = ("review_status", "contract_required")) -> DataFrame:
    """enabled and licence facts of each named provider, as of this run."""
    from daybook.sources.readers import provider_enabled

    return provider_enabled(registry.where(F.col("source_id").isin(*ids)), allow_contract).select("source_id", F.col("runtime_enabled").alias("enabled"), *facts)


def location_metadata(locations: DataFrame, defaults: DataFrame, source: str = "dataset_source") -> DataFrame:
    """Locations with the geographic and service attributes that their source assumes; unknown sources go.

    ``defaults`` has a row for each source, so Spark broadcasts it by its size.
    """
    return locations.join(defaults, source)
