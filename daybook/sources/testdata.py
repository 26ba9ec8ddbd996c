"""The driver's star schema as order lines of a demand panel, with small literal dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_KEYS = ["dataset_source", "location_id", "product_id", "dt"]

REGISTRY = [
    ("AFRICA", "dataset", "AFRICA", True, True, True, "allowed", "include", 10, "field"),
    ("AMERICA", "dataset", "AMERICA", True, True, True, "allowed", "include", 20, "field"),
    ("ASIA", "dataset", "ASIA", True, False, True, "allowed", "include", 30, "synthetic"),
    ("EUROPE", "dataset", "EUROPE", True, True, True, "quarantined", "include", 40, "field"),
    ("MIDDLE EAST", "dataset", "MIDDLE EAST", True, True, True, "allowed", "include", 50, "supplemental"),
    ("weather_a", "provider", None, True, True, True, "allowed", "exclude", 10, "provider"),
    ("weather_b", "provider", None, True, True, False, "allowed", "exclude", 20, "provider"),
    ("weather_c", "provider", None, False, True, True, "quarantine", "exclude", None, "provider"),
    ("weather_d", "provider", None, True, True, True, None, "exclude", 40, "provider"),
]
REGISTRY_SCHEMA = "source_id string, source_kind string, dataset_source string, commercial_use_allowed boolean, ml_training_allowed boolean, caching_allowed boolean, review_status string, include_in_training string, source_priority int, source_role string"
MACRO = [
    ("AFRICA", "rate", "2000-01-01", "2000-02-10", 1, 3.0),
    ("AFRICA", "rate", "2000-04-01", "2000-04-01", 1, 3.5),
    ("AFRICA", "rate", "2000-02-01", "2000-06-15", 1, 3.2),
    ("AFRICA", "rate", "2000-04-01", "2000-04-01", 2, 9.9),
    ("AMERICA", "rate", "2000-03-01", "2000-03-20", 1, 1.5),
    ("AMERICA", "cpi", "2000-05-01", "2000-05-02", 1, 101.5),
    ("EUROPE", "cpi", "2001-01-01", "2001-02-01", 1, 99.0),
]
MACRO_SCHEMA = "country_code string, metric_name string, effective_from string, available_from string, source_priority int, value double"
HOLIDAYS = [("AFRICA", "2000-05-01", "labour"), ("AFRICA", "2000-05-01", "may day"), ("AFRICA", "2000-12-25", "xmas"), ("AMERICA", "2000-07-04", "fourth"), ("AMERICA", "2000-07-06", "extra"), ("EUROPE", "2001-01-01", "new year")]


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its part, supplier's nation and region, as order lines of a day."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    places = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_nationkey", "r_name")
    return (
        read("lineitem")
        .join(read("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("r_name").alias("dataset_source"),
            F.concat(F.lit("loc_"), (F.col("s_nationkey") % 3).cast("string")).alias("location_id"),
            F.col("p_type").alias("product_id"),
            F.to_date("l_shipdate").alias("dt"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("amount"),
            F.col("l_discount").alias("discount"),
            "l_orderkey",
            "l_linenumber",
            "l_returnflag",
        )
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qty and revenue per source, location, product and day."""
    return order_lines(spark, sf_dir).groupBy(*LINE_KEYS).agg(F.sum("quantity").alias("qty"), F.round(F.sum("amount"), 2).alias("revenue"), F.count("*").alias("n_lines"))


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, REGISTRY_SCHEMA)


def macro(spark: SparkSession) -> DataFrame:
    raw = spark.createDataFrame(MACRO, MACRO_SCHEMA)
    return raw.withColumns({c: F.col(c).cast("date") for c in ("effective_from", "available_from")})


def holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOLIDAYS, "country_code string, dt string, name string").withColumn("dt", F.col("dt").cast("date"))


def _values(rows: list[tuple], names: str, casts: dict[str, str]) -> str:
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    cols = [f"CAST({c} AS {casts[c]}) AS {c}" if c in casts else c for c in names.split(", ")]
    return f"SELECT {', '.join(cols)} FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


#: Common table expressions for the SQL of the queries.
CTES = {
    "lines": "SELECT r_name AS dataset_source, 'loc_' || CAST(s_nationkey % 3 AS VARCHAR) AS location_id, p_type AS product_id, CAST(l_shipdate AS DATE) AS dt, l_quantity AS quantity, l_extendedprice AS amount, l_discount AS discount, l_orderkey, l_linenumber, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "daily": "SELECT dataset_source, location_id, product_id, dt, sum(quantity) AS qty, round(sum(amount), 2) AS revenue, count(*) AS n_lines FROM lines GROUP BY ALL",
    "registry": _values(REGISTRY, "source_id, source_kind, dataset_source, commercial_use_allowed, ml_training_allowed, caching_allowed, review_status, include_in_training, source_priority, source_role", {}),
    "macro": _values(MACRO, "country_code, metric_name, effective_from, available_from, source_priority, value", {"effective_from": "DATE", "available_from": "DATE", "value": "DOUBLE"}),
    "holidays": _values(HOLIDAYS, "country_code, dt, name", {"dt": "DATE"}),
    "bounds": "SELECT dataset_source, location_id, product_id, min(dt) AS min_dt, max(dt) AS max_dt FROM daily GROUP BY ALL",
    "spine": "SELECT dataset_source, location_id, product_id, CAST(unnest(generate_series(min_dt, max_dt, INTERVAL 1 DAY)) AS DATE) AS dt FROM bounds",
    "active": "SELECT DISTINCT dataset_source, location_id, dt FROM daily",
    "panel": "SELECT s.*, d.qty IS NOT NULL AS is_observed_row, CASE WHEN d.qty IS NOT NULL THEN d.qty WHEN a.dt IS NOT NULL THEN 0.0 END AS demand, CASE WHEN d.qty IS NOT NULL THEN 'observed_sales' WHEN a.dt IS NOT NULL THEN 'dense_calendar_zero_fill' ELSE 'closed_or_missing_observation' END AS target_source, CASE WHEN d.qty IS NOT NULL THEN 1.0 WHEN a.dt IS NOT NULL THEN 0.8 ELSE 0.0 END AS label_quality_score, d.revenue FROM spine s LEFT JOIN daily d USING (dataset_source, location_id, product_id, dt) LEFT JOIN active a ON s.dataset_source = a.dataset_source AND s.location_id = a.location_id AND s.dt = a.dt",
}
NEEDS = {"daily": ["lines"], "bounds": ["daily"], "spine": ["bounds"], "active": ["daily"], "panel": ["spine", "active"]}


def with_ctes(names: str, body: str) -> str:
    """``body`` behind the named common table expressions and those that they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    body = body.strip()
    word = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
    rest = ", " + body[len(word) :] if body.upper().startswith(word) else " " + body
    return word + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + rest if order else body
