"""Queries of contracts on columns, the reference universe and quantile points."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions import columns as C
from daybook.operators import contracts as K
from daybook.operators import evaluation as E
from daybook.operators import universe as U
from daybook.plans.evaluation_queries import EWM, PRED, SER, WP, predictions, series
from daybook.plans.panel import feature_panel
from daybook.plans.panel_queries import SERIES, panel, table
from daybook.plans.registry import query
from daybook.sources import readers as S
from daybook.sources import testdata as TD

# ---- the reference universe

GOLD = "g AS (SELECT product_id, dt, avg(discount) AS weather, max(discount) > 0.09 AS promo_flag, max(l_returnflag) AS region_code, count(*) > 3 AS is_observed_row, CASE WHEN count(*) > 9 THEN -1.0 END AS lag_7 FROM lines GROUP BY ALL HAVING count(*) > 2)"
IW = "PARTITION BY product_id ORDER BY dt"


@query(
    "reference_feature_frame",
    f"""WITH {SER}, {GOLD},
t AS (SELECT dt, arg_min(weather, product_id) AS weather FROM g GROUP BY ALL), i AS (SELECT product_id, arg_max(region_code, dt) AS region_code FROM g GROUP BY ALL),
m AS (SELECT s.product_id, s.dt, s.demand, coalesce(g.weather, t.weather) AS weather, coalesce(g.region_code, i.region_code) AS region_code, coalesce(g.promo_flag, false) AS promo_flag, coalesce(g.is_observed_row, true) AS obs, g.lag_7 AS old_7
  FROM s LEFT JOIN g USING (product_id, dt) LEFT JOIN t USING (dt) LEFT JOIN i USING (product_id)),
f AS (SELECT *, dt + 1 AS target_dt, lag(demand) OVER ({IW}) AS lag_1, coalesce(old_7, lag(demand, 7) OVER ({IW})) AS lag_7, lag(demand, 28) OVER ({IW}) AS lag_28, lag(demand, 6) OVER ({IW}) AS target_lag_7,
  avg(promo_flag::INT) OVER ({IW} ROWS 6 PRECEDING) AS promo_rate_7, lag(promo_flag) OVER ({IW}) AS promo_flag_lag_1,
  avg(demand) OVER (PARTITION BY product_id, isodow(dt) ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 7 PRECEDING) AS dow FROM m)
SELECT r.product_id, CAST(r.dt AS VARCHAR) AS target_dt, r.demand AS target, round(f.weather, 6) AS weather, f.region_code, f.lag_1, f.lag_7, f.lag_28, f.demand AS target_lag_1, f.target_lag_7, round(f.promo_rate_7, 6) AS promo_rate_7, f.promo_flag_lag_1, round(f.dow, 6) AS target_same_dow_mean_4w,
  coalesce(0.5 * f.demand + 0.5 * f.target_lag_7, f.demand, f.target_lag_7) AS field_baseline, r.demand - coalesce(0.5 * f.demand + 0.5 * f.target_lag_7, f.demand, f.target_lag_7) AS residual,
  CASE WHEN NOT coalesce(f.obs, true) AND r.demand = 0 THEN 'dense_calendar_zero_fill' ELSE 'observed_sales' END AS target_source
FROM s r LEFT JOIN f ON r.product_id = f.product_id AND r.dt = f.target_dt""",
    "daily",
)
def _(spark, d):
    s = series(spark, d)
    gold = TD.order_lines(spark, d).groupBy("product_id", "dt").agg(
        F.avg("discount").alias("weather"), (F.max("discount") > 0.09).alias("promo_flag"), F.max("l_returnflag").alias("region_code"),
        (F.count("*") > 3).alias("is_observed_row"), F.when(F.count("*") > 9, -1.0).alias("lag_7"), F.count("*").alias("n"),
    ).where("n > 2").drop("n")
    out = U.reference_features(s, s, gold, by_day=["weather"], by_item=["region_code"], defaults={"promo_flag": False, "is_observed_row": True})
    return out.select("product_id", "target_dt", "target", "weather", "region_code", "lag_1", "lag_7", "lag_28", "target_lag_1", "target_lag_7", "promo_rate_7", "promo_flag_lag_1", "target_same_dow_mean_4w", "field_baseline", "residual", "target_source")


# ---- contracts: what is known of each column, with the values that the panel has of it

CONTRACT = {
    "lag_7_unknown_real": ("demand", "unknown_real"), "observed_revenue_known_real": ("revenue", "known_real"), "weather_temperature_known_real": ("revenue", "known_real"),
    "target_month_known_real": ("label_quality_score", "known_real"), "field_baseline_blend": ("demand", "unknown_real"), "dataset_source": ("dataset_source", "static_cat"),
    "unit_price": ("revenue", "unknown_real"), "gdp_growth": ("label_quality_score", "unknown_real"), "stockout_rate_7": ("demand", "unknown_real"),
}
CONTRACT_FACTS = {
    "lag_7_unknown_real": ("operations", "historical_observed", False, 0, "low", None), "observed_revenue_known_real": ("operations", "decision_day_observed", True, 0, "medium", "decision_day_observed"),
    "weather_temperature_known_real": ("weather", "static_or_planned", True, 24, "medium", "weather_not_point_in_time"), "target_month_known_real": ("calendar_operational", "target_calendar_known", True, 0, "low", None),
    "field_baseline_blend": ("operations", "decision_day_history", False, 0, "low", "decision_day_history"), "dataset_source": ("metadata", "static_or_planned", True, 0, "low", None),
    "unit_price": ("pricing", "static_or_planned", False, 0, "low", None), "gdp_growth": ("macro", "static_or_planned", False, 744, "low", None),
    "stockout_rate_7": ("operations", "decision_day_history", False, 0, "low", "decision_day_history"),
}


def _facts(name: str) -> str:
    system, scope, there, hours, risk, why = CONTRACT_FACTS[name]
    return f"'{system}' AS source_system, '{scope}' AS decision_time_scope, {there} AS available_at_prediction, {hours} AS max_publication_lag_hours, '{risk}' AS leakage_risk_level, {f"'{why}'" if why else 'CAST(NULL AS VARCHAR)'} AS blocked"


@query("feature_contract", " UNION ALL ".join(f"SELECT '{n}' AS feature, '{r}' AS role, count({c}) AS n_known, {_facts(n)} FROM panel" for n, (c, r) in CONTRACT.items()), "panel")
def _(spark, d):
    p = panel(spark, d)
    counts = p.agg(*[F.count(c).alias(n) for n, (c, _) in CONTRACT.items()]).unpivot([], list(CONTRACT), "feature", "n_known")
    role = F.element_at(F.create_map(*[F.lit(x) for n, (_, r) in CONTRACT.items() for x in (n, r)]), F.col("feature"))
    return K.feature_contract(counts.withColumn("role", role), "pre_close_d_plus_1").drop("decision_profile")


@query("model_feature_select", "SELECT 'demand' AS feature, count(demand) AS n_known FROM panel UNION ALL SELECT 'is_observed_row', count(*) FROM panel", "panel")
def _(spark, d):
    p = panel(spark, d).withColumns({"always_zero": F.lit(0.0), "unmapped": F.col("demand")})
    roles = {"demand": "unknown_real", "is_observed_row": "unknown_cat", "always_zero": "unknown_real", "revenue": "unknown_real", "product_id": "static_cat"}
    chosen = K.model_features(p, roles, excluded=["revenue"], identifiers=["product_id"], zero_only=True)["features"]
    return p.agg(*[F.count(c).alias(c) for c in chosen]).unpivot([], chosen, "feature", "n_known")


@query("projection_resolve", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select(*K.projection_columns(c, ["c_name"]))


@query("feature_registry_cast", "SELECT p_name AS feature_name, p_type AS feature_family, p_size > 25 AS available_at_prediction, CAST(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END AS BOOLEAN) AS include_in_training, CAST(p_retailprice AS VARCHAR) AS default_value, CAST(NULL AS VARCHAR) AS notes FROM part")
def _(spark, d):
    flag = F.when(F.col("p_size") % 3 == 0, "n/a").when(F.col("p_size") % 3 == 1, "true").otherwise("no")
    raw = table(spark, d, "part").select(F.col("p_name").alias("feature_name"), F.col("p_type").alias("feature_family"), (F.col("p_size") > 25).cast("string").alias("available_at_prediction"), flag.alias("include_in_training"), F.col("p_retailprice").alias("default_value"))
    return K.cast_feature_registry(raw).select("feature_name", "feature_family", "available_at_prediction", "include_in_training", "default_value", "notes")


#: Forecasts of the next day as feeds bring them: known in time, known too late, and of unknown age.
FORECAST_AGE = "CASE event_type WHEN 'view' THEN ts WHEN 'click' THEN ts + INTERVAL 2 DAYS END"


@query(
    "weather_forecast_contract",
    """SELECT 'actual' AS weather_observation_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, round(avg(value), 6) AS weather_temperature_mean, count(*) AS n_rows FROM events GROUP BY CAST(ts AS DATE)
UNION ALL SELECT 'forecast', CAST(CAST(ts AS DATE) + 1 AS VARCHAR), round(avg(value), 6), count(*) FROM events WHERE event_type = 'view' GROUP BY CAST(ts AS DATE)""",
)
def _(spark, d):
    e = table(spark, d, "events")
    feed = e.select(F.col("user_id").alias("location_id"), F.date_add(F.to_date("ts"), 1).alias("dt"), F.expr(FORECAST_AGE).alias("forecast_generated_at"), F.col("value").alias("weather_temperature_mean"))
    actual = e.select(F.to_date("ts").alias("dt"), F.col("value").alias("weather_temperature_mean"), F.lit("actual").alias("weather_observation_type"))
    both = actual.unionByName(K.weather_forecasts(feed), allowMissingColumns=True)
    return both.groupBy("weather_observation_type", "dt").agg(F.avg("weather_temperature_mean").alias("weather_temperature_mean"), F.count("*").alias("n_rows"))


@query("provider_policy_snapshot", "SELECT r.source_id, r.review_status IN ('allowed', 'quarantine') AS enabled, r.review_status, count(e.event_id) AS n_rows FROM registry r LEFT JOIN events e ON r.source_id = 'weather_' || chr((97 + e.user_id % 3)::INT) WHERE r.source_id IN ('weather_a', 'weather_c') GROUP BY ALL", "registry")
def _(spark, d):
    reg = S.normalize_registry(TD.registry(spark)).withColumn("contract_required", F.lit(True))
    snapshot = K.provider_snapshot(reg, ["weather_a", "weather_c"], True)
    n = table(spark, d, "events").groupBy(F.concat(F.lit("weather_"), F.char((F.col("user_id") % 3 + 97).cast("int"))).alias("source_id")).agg(F.count("*").alias("n"))
    return snapshot.join(n, "source_id", "left").select("source_id", "enabled", "review_status", F.coalesce("n", F.lit(0)).alias("n_rows"))


PLACES = [("AFRICA", "FR", "A", 48.9, 2.3, False, True), ("AMERICA", "US", None, None, None, True, True), ("ASIA", "CN", None, None, None, True, False)]
PLACE_COLS = "dataset_source string, country_code string, school_zone string, latitude double, longitude double, delivery_flag boolean, pickup_flag boolean"


@query("location_metadata_build", "SELECT dataset_source, location_id, p.* EXCLUDE (src) FROM (SELECT DISTINCT dataset_source, location_id FROM daily) l JOIN (VALUES ('AFRICA', 'FR', 'A', CAST(48.9 AS DOUBLE), CAST(2.3 AS DOUBLE), false, true), ('AMERICA', 'US', NULL, NULL, NULL, true, true), ('ASIA', 'CN', NULL, NULL, NULL, true, false)) p(src, country_code, school_zone, latitude, longitude, delivery_flag, pickup_flag) ON l.dataset_source = p.src", "daily")
def _(spark, d):
    return K.location_metadata(TD.daily(spark, d).select("dataset_source", "location_id").distinct(), spark.createDataFrame(PLACES, PLACE_COLS))


REVIEW = "CASE s_suppkey % 5 WHEN 0 THEN ' Allowed ' WHEN 1 THEN 'quarantined' WHEN 2 THEN 'rejected' WHEN 3 THEN 'whatever' END"


@query("registry_normalize", f"SELECT s_name AS source_id, CASE s_suppkey % 5 WHEN 0 THEN 'allowed' WHEN 1 THEN 'quarantine' WHEN 2 THEN 'rejected' ELSE 'unreviewed' END AS review_status, s_suppkey % 3 = 0 AS caching_allowed, CASE WHEN s_nationkey % 4 = 0 THEN 999 ELSE s_nationkey END::BIGINT AS source_priority FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    flag = F.when(k % 3 == 0, "true").when(k % 3 == 1, "false")
    prio = F.when(F.col("s_nationkey") % 4 == 0, "none").otherwise(F.col("s_nationkey").cast("string"))
    raw = table(spark, d, "supplier").select(F.col("s_name").alias("source_id"), F.expr(REVIEW).alias("review_status"), flag.alias("caching_allowed"), prio.alias("source_priority"))
    return S.normalize_registry(raw)


# ---- residuals and baselines


def _normal_sql(p: str) -> str:
    a, b, c, d = U.NORMAL
    poly = lambda k, x: ("(" * (len(k) - 1)) + f"CAST({k[0]!r} AS DOUBLE)" + "".join(f" * {x} + {v!r})" for v in k[1:])
    low, high, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    r = f"({q} * {q})"
    return f"CASE WHEN {p} < 0.02425 THEN {poly(c, low)} / {poly(d, low)} WHEN {p} > 0.97575 THEN -{poly(c, high)} / {poly(d, high)} ELSE {poly(a, r)} * {q} / {poly(b, r)} END"


@query("residual_qq", f"{PRED}, r AS (SELECT row_number() OVER (ORDER BY actual - prediction) AS rank, actual - prediction AS residual, count(*) OVER () AS n FROM p), z AS (SELECT rank, residual, (rank - 0.5) / n::DOUBLE AS u FROM r) SELECT rank, round({_normal_sql('u')}, 6) AS theoretical, round(residual, 6) AS residual FROM z", "panel")
def _(spark, d):
    return U.qq_points(predictions(spark, d).withColumn("residual", F.col("actual") - F.col("prediction")), "residual")


@query("bl_blend_mean7_ewm7", f"WITH {SER}, w AS (SELECT product_id, dt, avg(demand) OVER ({WP} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS a, {EWM.format(a=0.25)} AS b FROM s) SELECT product_id, CAST(dt AS VARCHAR) AS dt, round(0.5 * a + 0.5 * b, 6) AS prediction FROM w", "daily")
def _(spark, d):
    s = E.baseline(E.baseline(series(spark, d), "ewm_span_7", ["product_id"]), "rolling_mean_7", ["product_id"])
    return s.select("product_id", "dt", C.blend("rolling_mean_7", "ewm_span_7").alias("prediction"))


LAST = f"lag(demand) OVER ({WP})"


@query("bl_same_weekday_median_expanding", f"WITH {SER} SELECT product_id, CAST(dt AS VARCHAR) AS dt, round(coalesce(quantile_cont(demand, 0.5) OVER (PARTITION BY product_id, isodow(dt) ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {LAST}), 6) AS prediction FROM s", "daily")
def _(spark, d):
    name = "same_weekday_median_expanding"
    return E.baseline(series(spark, d), name, ["product_id"]).select("product_id", "dt", F.col(name).alias("prediction"))


@query("bl_resolve", f"WITH {SER} SELECT product_id, CAST(dt AS VARCHAR) AS dt, {LAST} AS naive, demand + 1 AS seasonal, round(avg(demand) OVER ({WP} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS trailing, round(avg(demand) OVER ({WP} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS long_, demand * 2 AS weekday FROM s", "daily")
def _(spark, d):
    s = series(spark, d).withColumns({"anchor": F.col("demand") + 1, "lag_7": F.lit(-1.0), "same_dow_mean_4w": F.col("demand") * 2})
    names = {"naive": "naive_lag_1", "seasonal": "seasonal_naive_lag_7", "trailing": "trailing_mean_7", "long_": "trailing_mean_28", "weekday": "same_weekday_mean_4"}
    for out, name in names.items():
        s = E.resolve_baseline(s, name, ["product_id"], out=out, anchor="anchor")
    return s.select("product_id", "dt", *names)


# ---- gain over the baseline

GAIN_PRICE = "SELECT product_id, sum(revenue) / sum(qty) AS price FROM daily GROUP BY ALL"


@query(
    "economic_gain",
    f"""{PRED}, n AS (SELECT product_id, avg(actual) AS base FROM p GROUP BY ALL),
e AS (SELECT product_id, round_even(actual, 0) AS a, round_even(prediction, 0) AS m, round_even(base, 0) AS b, actual, prediction, base, price FROM p JOIN n USING (product_id) JOIN ({GAIN_PRICE}) USING (product_id)),
g AS (SELECT product_id, count(*) AS n_rows, sum(greatest(m - a, 0)) AS model_over_units, sum(greatest(a - m, 0)) AS model_under_units, sum(greatest(b - a, 0)) AS baseline_over_units, sum(greatest(a - b, 0)) AS baseline_under_units,
 sum(greatest(m - a, 0) * price * 0.35 + greatest(a - m, 0) * price * 0.65 * 0.5) AS ml, sum(greatest(b - a, 0) * price * 0.35 + greatest(a - b, 0) * price * 0.65 * 0.5) AS bl, avg(abs(prediction - actual)) AS mm, avg(abs(base - actual)) AS bm FROM e GROUP BY ALL),
w AS (SELECT *, bm - mm AS saved FROM g)
SELECT product_id, n_rows, model_over_units, model_under_units, baseline_over_units, baseline_under_units, round(ml, 2) AS model_loss, round(bl, 2) AS baseline_loss, round(bl - ml, 2) AS savings, round(saved, 6) AS mae_saved, round(saved / bm, 6) AS mae_improvement FROM w
UNION ALL SELECT NULL, sum(n_rows)::BIGINT, sum(model_over_units), sum(model_under_units), sum(baseline_over_units), sum(baseline_under_units), round(sum(ml), 2), round(sum(bl), 2), round(sum(bl - ml), 2), round(sum(saved), 6), NULL FROM w""",
    "panel",
)
def _(spark, d):
    p = predictions(spark, d)
    base = p.groupBy("product_id").agg(F.avg("actual").alias("baseline"))
    price = TD.daily(spark, d).groupBy("product_id").agg((F.sum("revenue") / F.sum("qty")).alias("price"))
    gain = E.economic_gain(p.join(base, "product_id").join(price, "product_id").withColumn("family", F.lit("default")), ["product_id"], "price")
    return gain.withColumns({c: F.round(c, 2) for c in ("model_loss", "baseline_loss", "savings")})


# ---- checks on panels with planted faults

G3 = "dataset_source, location_id, product_id, CAST(dt AS VARCHAR) AS dt"


@query("dq_target_is_next_day", f"SELECT {G3} FROM panel WHERE day(dt) = 13", "panel")
def _(spark, d):
    """On the 13th of each month the target day is written one day late."""
    f = feature_panel(panel(spark, d), SERIES).withColumn("target_dt", F.date_add("target_dt", F.when(F.dayofmonth("dt") == 13, 1).otherwise(0)))
    return E.violations_expression(f, "target_dt = date_add(dt, 1)").select(*SERIES, "dt")


@query("dq_decision_before_target", f"SELECT {G3} FROM panel WHERE day(dt) = 14", "panel")
def _(spark, d):
    """On the 14th of each month the decision is stamped two days late."""
    late = F.when(F.dayofmonth("dt") == 14, F.col("decision_timestamp") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("decision_timestamp"))
    f = feature_panel(panel(spark, d), SERIES).withColumn("decision_timestamp", late)
    return E.violations_expression(f, "decision_timestamp < CAST(target_dt AS TIMESTAMP_NTZ)").select(*SERIES, "dt")


@query("dq_no_leaky_columns", f"SELECT 'oracle_demand' AS violation, count(*) AS n_rows FROM panel UNION ALL SELECT 'usable_but_unlabelled', count(*) FROM panel WHERE demand IS NULL", "panel")
def _(spark, d):
    """A banned column is planted, and every row is called usable."""
    p = panel(spark, d).withColumns({"oracle_demand": F.col("demand"), "usable_for_training_flag": F.lit(True)})
    return E.leaks(p, ("oracle_", "debug_"), "demand")

