"""Queries of quality panels, matrices, bundles, payload-like parsing and governance leftovers."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions import columns as C
from daybook.operators import evaluation as E
from daybook.operators import relational as R
from daybook.plans import bundle as B
from daybook.plans.evaluation_queries import HOLD
from daybook.plans.panel import feature_panel
from daybook.plans.panel_queries import GRAIN, SERIES, G, K, panel, table
from daybook.plans.registry import query
from daybook.sources import payloads as P
from daybook.sources import readers as S
from daybook.sources import testdata as TD


def split_features(spark, d):
    return E.holdout_split(feature_panel(panel(spark, d), SERIES), "dataset_source")


PSPLIT = HOLD.replace("FROM daily", "FROM panel")


@query("quality_panel", f"WITH {PSPLIT}, w AS (SELECT split_bucket, dataset_source, count(*) AS n FROM panel JOIN b USING (dataset_source, dt) GROUP BY ALL), v AS (SELECT *, avg(n) OVER (PARTITION BY split_bucket) / n AS source_weight FROM w) SELECT {G}, b.split_bucket, coalesce(demand, 0) AS demand, demand IS NOT NULL AS demand_known_flag, round(source_weight, 6) AS source_weight FROM panel JOIN b USING (dataset_source, dt) JOIN v USING (dataset_source) WHERE v.split_bucket = b.split_bucket", "panel")
def _(spark, d):
    return B.quality_panel(split_features(spark, d)).select(*GRAIN, "split_bucket", "demand", "demand_known_flag", "source_weight")


@query("training_matrix", f"WITH {PSPLIT} SELECT {G}, b.split_bucket, 1 AS horizon_days, coalesce(demand, 0) AS demand_unknown_real FROM panel JOIN b USING (dataset_source, dt)", "panel")
def _(spark, d):
    return B.training_matrix(B.quality_panel(split_features(spark, d))).select(*GRAIN, "split_bucket", "horizon_days", "demand_unknown_real")


@query("training_bundle", f"WITH {PSPLIT} SELECT b.split_bucket, count(*) AS n_rows, count(DISTINCT location_id || '__' || product_id) AS n_series FROM panel JOIN b USING (dataset_source, dt) WHERE b.split_bucket = 'test' OR target_source = 'observed_sales' GROUP BY ALL", "panel")
def _(spark, d):
    m = split_features(spark, d).withColumns({"usable_for_training_flag": F.lit(True), "censor_flag": F.lit(False), "target_semantics": F.lit("observed_sales")})
    parts = R.union_all(list(B.training_bundle(m, SERIES).values()))
    return parts.groupBy("split_bucket").agg(F.count("*").alias("n_rows"), F.countDistinct(C.series_id("location_id", "product_id")).alias("n_series"))


@query("typed_bundle_projection", "SELECT event_id, value > 10 AS big, event_type FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") > 10).alias("big"), "event_type", "value")
    t = B.typed_projection(e)
    return t.select("event_id", (F.col("big") == 1).alias("big"), "event_type")


@query("reference_splits", "WITH per AS (SELECT product_id, dt, sum(qty) AS q FROM daily GROUP BY ALL), cal AS (SELECT unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY))::DATE AS dt FROM per), f AS (SELECT p.product_id, cal.dt, coalesce(q, 0) AS qty, cal.dt NOT IN (SELECT dt FROM per) AS missing FROM cal CROSS JOIN (SELECT DISTINCT product_id FROM per) p LEFT JOIN per ON per.product_id = p.product_id AND per.dt = cal.dt), k AS (SELECT product_id FROM f GROUP BY ALL HAVING avg((qty = 0)::INT) <= 0.5), i AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY product_id) AS n FROM f WHERE product_id IN (SELECT product_id FROM k)) SELECT product_id, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split, count(*) AS n_rows, sum(qty) AS qty, sum(missing::INT)::BIGINT AS missing_days FROM i GROUP BY ALL", "daily")
def _(spark, d):
    r = B.reference_splits(TD.daily(spark, d), max_zero=0.5)
    return r.groupBy("product_id", "split").agg(F.count("*").alias("n_rows"), F.sum("qty").alias("qty"), F.sum("is_missing_day").alias("missing_days"))


@query("refit_weight_schedule", "SELECT CAST(dt AS VARCHAR) AS dt, h AS history, round(CASE WHEN h < 30 THEN h * 0.7 / 30 WHEN h < 60 THEN 0.7 + (h - 30) * 0.15 / 30 WHEN h < 90 THEN 0.85 + (h - 60) * 0.1 / 30 WHEN h < 180 THEN 0.95 + (h - 90) * 0.05 / 90 ELSE 1 END, 6) AS share FROM (SELECT dt, row_number() OVER (ORDER BY dt) AS h FROM (SELECT DISTINCT dt FROM daily))", "daily")
def _(spark, d):
    h = E.daily_folds(TD.daily(spark, d)).select(F.col("eval_date").alias("dt"), F.col("fold").alias("history"))
    return h.withColumn("share", B.refit_weights("history"))


@query("provider_runtime_enabled", "SELECT e.event_type, count(*) AS n_rows FROM events e JOIN registry r ON r.source_id = 'weather_' || chr((97 + e.user_id % 3)::INT) WHERE r.review_status = 'allowed' GROUP BY ALL", "registry")
def _(spark, d):
    reg = S.provider_enabled(S.normalize_registry(TD.registry(spark)).withColumn("contract_required", F.lit(True)), False).where("runtime_enabled").select("source_id")
    e = table(spark, d, "events").withColumn("source_id", F.concat(F.lit("weather_"), F.char((F.col("user_id") % 3 + 97).cast("int"))))
    return R.govern(e, reg).groupBy("event_type").agg(F.count("*").alias("n_rows"))


@query("ingest_indicator_json", "SELECT user_id, year(ts) AS year, CAST(make_date(year(ts)::INT + 1, 1, 1) AS VARCHAR) AS effective_from, max(CAST(json_extract(props, '$.k') AS DOUBLE)) AS value FROM events GROUP BY ALL HAVING max(CAST(json_extract(props, '$.k') AS DOUBLE)) IS NOT NULL")
def _(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.year("ts").alias("y")).agg(F.max(F.get_json_object("props", "$.k").cast("double")).alias("v"))
    payload = F.to_json(F.array(F.struct(F.col("user_id").cast("string").alias("countryiso3code"), F.col("y").cast("string").alias("date"), F.col("v").alias("value"))))
    return P.parse_indicator(e.select(payload.alias("payload"))).select(F.col("country_code").cast("long").alias("user_id"), "year", "effective_from", "value")


@query("ingest_weather_json", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, round(max(value), 6) AS temperature FROM events GROUP BY user_id, CAST(ts AS DATE)")
def _(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("dt")).agg(F.max("value").alias("v"))
    packed = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("dt").cast("string").alias("dt"), "v"))).alias("r"))
    payload = F.to_json(F.struct(F.struct(F.col("r.dt").alias("time"), F.col("r.v").alias("temperature_2m_mean")).alias("daily")))
    out = P.parse_weather(packed.select(F.col("user_id").alias("location_id"), payload.alias("payload")))
    return out.select(F.col("location_id").alias("user_id"), "dt", F.col("temperature_2m_mean").alias("temperature"))


_GB_FIXED = "dt IN (SELECT CASE WHEN m = 12 AND dd = 26 THEN CASE isodow(x) WHEN 6 THEN x + 2 WHEN 7 THEN x + 2 WHEN 1 THEN x + 1 ELSE x END ELSE CASE isodow(x) WHEN 6 THEN x + 2 WHEN 7 THEN x + 1 ELSE x END END FROM (SELECT make_date(y, m, dd) AS x, m, dd FROM range(1990, 2010) t(y), (VALUES (1, 1), (12, 25), (12, 26)) f(m, dd)))"
_GB_MONDAYS = "isodow(dt) = 1 AND (month(dt) = 5 AND (day(dt) <= 7 OR day(dt) > 24) OR month(dt) = 8 AND day(dt) > 24)"
_EASTERS = "(VALUES (DATE '1995-04-16'), (DATE '1996-04-07'), (DATE '1997-03-30'), (DATE '1998-04-12'), (DATE '1999-04-04'), (DATE '2000-04-23'), (DATE '2001-04-15'), (DATE '2002-03-31')) e(easter)"


@query(
    "holiday_rules_calendar",
    f"""SELECT 'FR' AS country_code, year, count(*) AS n_lines FROM (SELECT year(dt) AS year, dt FROM lines) WHERE (month(dt), day(dt)) IN ((1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)) OR dt IN (SELECT easter + later FROM {_EASTERS}, (VALUES (1), (39), (50)) l(later)) GROUP BY ALL
UNION ALL SELECT 'GB', year(dt), count(*) FROM lines WHERE {_GB_FIXED} OR {_GB_MONDAYS} OR dt IN (SELECT easter + later FROM {_EASTERS}, (VALUES (-2), (1)) l(later)) GROUP BY ALL""",
    "lines",
)
def _(spark, d):
    lines = TD.order_lines(spark, d)
    b = lines.agg(F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt")).withColumn("country_code", F.explode(F.array(F.lit("FR"), F.lit("GB"))))
    days = P.holiday_calendar(P.country_years(b)).select("country_code", "dt").distinct()
    return lines.join(days, "dt").groupBy("country_code", F.year("dt").alias("year")).agg(F.count("*").alias("n_lines"))


@query("country_years", "SELECT dataset_source AS country_code, unnest(generate_series(year(a), year(b + 1))) AS year FROM (SELECT dataset_source, min(dt) AS a, max(dt) AS b FROM daily GROUP BY ALL)", "daily")
def _(spark, d):
    return P.country_years(R.series_bounds(TD.daily(spark, d).withColumnRenamed("dataset_source", "country_code"), ["country_code"]))


@query("country_date_bounds", "SELECT dataset_source AS country_code, CAST(min(dt) - 30 AS VARCHAR) AS min_dt, CAST(max(dt) + 1 AS VARCHAR) AS max_dt FROM daily GROUP BY ALL", "daily")
def _(spark, d):
    return P.country_bounds(R.series_bounds(TD.daily(spark, d).withColumnRenamed("dataset_source", "country_code"), ["country_code"]), 30)


@query("location_bounds", "SELECT dataset_source, location_id, CAST(min(dt) AS VARCHAR) AS min_dt, CAST(max(dt) AS VARCHAR) AS max_dt FROM daily GROUP BY ALL", "daily")
def _(spark, d):
    return R.series_bounds(TD.daily(spark, d), ["dataset_source", "location_id"])


POI = {"click": ("kind", "click"), "parking": ("kind", "signup"), "transit": ("kind", "error")}
POI_SQL = """WITH w AS (SELECT user_id, event_id, event_type, value, CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'click' THEN 40.0 WHEN 'view' THEN 120.0 END AS people FROM events),
 c AS (SELECT user_id, {counts} FROM w GROUP BY ALL)
SELECT *, CASE WHEN parking_20_0km >= 4 THEN 'high' WHEN parking_20_0km >= 1 AND transit_20_0km <= 2 THEN 'medium' WHEN parking_20_0km >= 1 OR transit_20_0km > 0 THEN 'low' ELSE 'unknown' END AS parking_score FROM c"""
POI_COUNTS = [f"count(DISTINCT CASE WHEN value <= {r} AND event_type = '{v}' THEN event_id END) AS {n}_{r}_0km" for n, (_, v) in POI.items() for r in (5, 20)]
POI_COUNTS += [f"CAST(coalesce(sum(CASE WHEN value <= {r} THEN people END), 0) AS DOUBLE) AS population_{r}_0km" for r in (5, 20)]


@query("poi_catchment", POI_SQL.format(counts=", ".join(POI_COUNTS)))
def _(spark, d):
    kind = F.col("event_type")
    building, area = F.when(kind == "purchase", "house").when(kind == "click", "apartments"), F.when(kind == "view", "residential")
    tags = F.create_map(F.lit("kind"), kind, F.lit("building"), building, F.lit("landuse"), area)
    e = table(spark, d, "events").select("user_id", "value", F.lit("node").alias("type"), F.col("event_id").alias("id"), tags.alias("tags"))
    return P.poi_catchment(e, ["user_id"], "value", POI, (5.0, 20.0)).withColumn("parking_score", P.parking_bucket("parking_20_0km", "transit_20_0km"))


@query("snapshot_cache_resolve", "SELECT c_custkey % 50 AS k, count(*) AS n_rows, max(CASE WHEN c_custkey % 50 < 10 THEN 2 ELSE 1 END) AS version FROM customer WHERE c_custkey % 50 < 30 GROUP BY ALL")
def _(spark, d):
    loc = table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("cache_key"))
    ids = loc.distinct()
    cache, fresh = ids.where("cache_key < 30").withColumn("version", F.lit(1)), ids.where("cache_key < 10").withColumn("version", F.lit(2))
    return P.cache_resolve(loc, cache, fresh)[0].groupBy(F.col("cache_key").alias("k")).agg(F.count("*").alias("n_rows"), F.max("version").alias("version"))


@query("school_zone_fanout", "SELECT DISTINCT h.country_code AS zone, CAST(h.dt AS VARCHAR) AS dt, b.location_id FROM holidays h JOIN (SELECT dataset_source, location_id, min(dt) AS lo, max(dt) AS hi FROM daily GROUP BY ALL) b ON h.country_code = b.dataset_source AND h.dt BETWEEN lo AND hi", "daily holidays")
def _(spark, d):
    loc = R.series_bounds(TD.daily(spark, d), ["dataset_source", "location_id"]).withColumnRenamed("dataset_source", "zone")
    return P.zone_fanout(TD.holidays(spark).select(F.col("country_code").alias("zone"), "dt"), loc)


@query("join_series_selection", f"SELECT {K}, count(*) AS n_rows FROM daily WHERE product_id LIKE 'S%' GROUP BY ALL", "daily")
def _(spark, d):
    day = TD.daily(spark, d)
    return R.keep_series(day, day.where("product_id LIKE 'S%'"), SERIES).groupBy(*SERIES).agg(F.count("*").alias("n_rows"))


@query("demand_all", f"SELECT {G}, qty, src FROM (SELECT *, row_number() OVER (PARTITION BY {K}, dt ORDER BY pr) AS r FROM (SELECT {K}, dt, qty, 'pos' AS src, 1 AS pr FROM daily UNION ALL SELECT {K}, dt, qty + 1, 'erp', 2 FROM daily WHERE n_lines > 1 UNION ALL SELECT {K}, dt - 1, qty, 'erp', 2 FROM daily)) WHERE r = 1", "daily")
def _(spark, d):
    day = TD.daily(spark, d)
    feed = lambda df, src, pr: df.select(*GRAIN, "qty", F.lit(src).alias("src"), F.lit(pr).alias("pr"))
    every = R.union_all([feed(day, "pos", 1), feed(day.where("n_lines > 1").withColumn("qty", F.col("qty") + 1), "erp", 2), feed(day.withColumn("dt", F.date_sub("dt", 1)), "erp", 2)])
    return R.dedup(every, GRAIN, [F.col("pr")]).drop("pr")
