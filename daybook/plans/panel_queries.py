"""Queries of scans, normalisation, joins, aggregates, windows, sets and panels on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from daybook.functions import columns as C
from daybook.operators import relational as R
from daybook.plans.panel import dense_panel, feature_panel
from daybook.plans.registry import query
from daybook.sources import readers as S
from daybook.sources import testdata as TD

SERIES = ["dataset_source", "location_id", "product_id"]
GRAIN = [*SERIES, "dt"]
K = "dataset_source, location_id, product_id"
W = f"PARTITION BY {K} ORDER BY dt"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark, sf_dir):
    return dense_panel(TD.daily(spark, sf_dir))


# ---- scans and normalisation


@query("scan_parquet", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 49")
def _(spark, d):
    return S.scan_parquet(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"]).where("l_quantity > 49")


@query("scan_table_filtered", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error'")
def _(spark, d):
    table(spark, d, "events").createOrReplaceTempView("daybook_events")
    return S.scan_table(spark, "daybook_events", ["event_id", "user_id", "value"], {"event_type": "error"})


@query("bronze_prepare", "SELECT l_orderkey AS ticket_number, l_quantity AS quantity, 'pos' AS source_name, 'pos_v1' AS source_policy_id, 'raw' AS source_partition FROM lineitem")
def _(spark, d):
    spec = S.SourceSpec("pos", f"{d}/lineitem.parquet", renames={"l_orderkey": "ticket_number", "l_quantity": "quantity"}, policy_id="pos_v1", constants={"source_partition": "raw"}, expected=("ticket_number", "quantity"))
    return S.require_columns(S.bronze_prepare(table(spark, d, "lineitem"), spec), spec.expected).select("ticket_number", "quantity", "source_name", "source_policy_id", "source_partition")


@query("bronze_column_intersect", "SELECT p_partkey, p_type, CAST(NULL AS VARCHAR) AS colour FROM part")
def _(spark, d):
    return S.conform(table(spark, d, "part"), T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_type", T.StringType()), T.StructField("colour", T.StringType())]))


@query("order_line_normalize", "SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS unit_price, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS dt, upper(l_returnflag) AS product_id FROM lineitem")
def _(spark, d):
    raw = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("quantity_raw"), F.concat(F.translate(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), ".", ","), F.lit(" €")).alias("unit_price_raw"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_raw"), F.lit("08:15").alias("time_raw"), F.concat(F.lit(" "), F.lower("l_returnflag")).alias("article_raw"))
    return S.normalize_lines(raw).select("l_orderkey", "l_linenumber", "quantity", "unit_price", "dt", "product_id")


@query("money_parse", "SELECT s_suppkey, s_acctbal AS strict, s_acctbal AS lenient FROM supplier")
def _(spark, d):
    text = F.concat(F.translate(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), ".", ","), F.lit(" €"))
    return table(spark, d, "supplier").select("s_suppkey", C.parse_money(text).alias("strict"), C.parse_money(text, True).alias("lenient"))


@query("order_line_enrich", "SELECT l_orderkey, l_linenumber, location_id || '__' || product_id AS series_id, round(quantity * amount, 6) AS revenue, (isodow(dt) - 1)::BIGINT AS weekday, month(dt) AS month FROM lines", "lines")
def _(spark, d):
    return TD.order_lines(spark, d).select("l_orderkey", "l_linenumber", C.series_id("location_id", "product_id").alias("series_id"), (F.col("quantity") * F.col("amount")).alias("revenue"), F.weekday("dt").alias("weekday"), F.month("dt").alias("month"))


@query("staging_clean", "SELECT event_id, CAST(value AS BIGINT) AS value_int, nullif(trim(CASE WHEN event_type = 'click' THEN '  ' ELSE event_type END), '') AS event_type FROM events WHERE value = floor(value)")
def _(spark, d):
    e = table(spark, d, "events").where("value = floor(value)").withColumn("event_type", F.when(F.col("event_type") == "click", "  ").otherwise(F.col("event_type")))
    return S.stage_columns(e, {"value_int": ("value", "long")}, ["event_type"]).select("event_id", "value_int", "event_type")


@query("canonical_source_id", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_mktsegment END), ''), nullif(trim(c_name), '')) AS source_id FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.canonical_source_id(F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_mktsegment")), "c_name").alias("source_id"))


ALLOWED = "SELECT DISTINCT dataset_source FROM registry WHERE source_kind = 'dataset' AND commercial_use_allowed AND ml_training_allowed AND include_in_training = 'include' AND review_status = 'allowed'"


@query("allowed_training_sources", f"SELECT dataset_source, count(*) AS n_rows FROM lines WHERE dataset_source IN ({ALLOWED}) GROUP BY ALL", "lines registry")
def _(spark, d):
    return TD.order_lines(spark, d).join(S.allowed_datasets(TD.registry(spark)), "dataset_source", "left_semi").groupBy("dataset_source").agg(F.count("*").alias("n_rows"))


@query("allowed_provider_sources", "SELECT e.event_type, r.source_id, count(*) AS n_rows FROM events e JOIN registry r ON r.source_kind = 'provider' AND r.review_status = 'allowed' AND r.commercial_use_allowed AND r.caching_allowed AND e.user_id % 2 = r.source_priority % 20 / 10 GROUP BY ALL", "registry")
def _(spark, d):
    p = S.allowed_providers(TD.registry(spark)).withColumn("k", ((F.col("source_priority") % 20) / 10).cast("long"))
    return table(spark, d, "events").withColumn("k", F.col("user_id") % 2).join(p, "k").groupBy("event_type", "source_id").agg(F.count("*").alias("n_rows"))


@query("quarantined_provider_sources", "SELECT e.event_type, r.source_id, count(*) AS n_rows FROM events e JOIN registry r ON r.source_kind = 'provider' AND coalesce(r.review_status, 'unreviewed') <> 'allowed' AND r.source_id = 'weather_' || substr('abcd', CAST(e.user_id % 4 AS INT) + 1, 1) GROUP BY ALL", "registry")
def _(spark, d):
    e = table(spark, d, "events").withColumn("source_id", F.concat(F.lit("weather_"), F.substring(F.lit("abcd"), (F.col("user_id") % 4 + 1).cast("int"), F.lit(1))))
    return e.join(S.quarantined(TD.registry(spark)).select("source_id"), "source_id").groupBy("event_type", "source_id").agg(F.count("*").alias("n_rows"))


@query("label_contract_flags", "SELECT event_id, TRY_CAST(v AS DOUBLE) AS value, v IS NULL AS value_missing_flag, v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL AS value_parse_error_flag FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'error' THEN 'n/a' ELSE CAST(round(value, 2) AS VARCHAR) END AS v FROM events)")
def _(spark, d):
    v = F.when(F.col("event_type") == "click", None).when(F.col("event_type") == "error", "n/a").otherwise(F.round("value", 2).cast("string"))
    return S.label_flags(table(spark, d, "events").select("event_id", v.alias("value")), {"value": "double"}).select("event_id", "value", "value_missing_flag", "value_parse_error_flag")


@query("canonical_align", "SELECT dataset_source, CAST(dt AS VARCHAR) AS dt, qty AS observed_demand_qty, CAST(NULL AS VARCHAR) AS region_id FROM daily", "daily")
def _(spark, d):
    s = T.StructType([T.StructField("dataset_source", T.StringType()), T.StructField("dt", T.DateType()), T.StructField("observed_demand_qty", T.DoubleType()), T.StructField("region_id", T.StringType())])
    return S.conform(TD.daily(spark, d).withColumnRenamed("qty", "observed_demand_qty"), s)


@query("wide_to_long_sales", "SELECT dataset_source, measure, sum(value) AS value FROM (SELECT dataset_source, 'qty' AS measure, qty AS value FROM daily UNION ALL SELECT dataset_source, 'n_lines', CAST(n_lines AS DOUBLE) FROM daily) GROUP BY ALL", "daily")
def _(spark, d):
    return S.unpivot_columns(TD.daily(spark, d), ["dataset_source"], ["qty", "n_lines"], "measure", "value").groupBy("dataset_source", "measure").agg(F.sum("value").alias("value"))


@query("training_candidates", f"SELECT {K}, CAST(dt AS VARCHAR) AS dt, qty IS NOT NULL AND qty >= 5 AS usable FROM daily WHERE dataset_source IN ({ALLOWED})", "daily registry")
def _(spark, d):
    return TD.daily(spark, d).join(S.allowed_datasets(TD.registry(spark)), "dataset_source", "left_semi").select(*GRAIN, (F.col("qty").isNotNull() & (F.col("qty") >= 5)).alias("usable"))


@query("missing_to_default", f"SELECT {K}, CAST(dt AS VARCHAR) AS dt, coalesce(demand, 0) AS demand, demand IS NOT NULL AS demand_known_flag, round(coalesce(revenue, 0), 6) AS revenue, revenue IS NOT NULL AS revenue_known_flag FROM panel", "panel")
def _(spark, d):
    return S.fill_defaults(panel(spark, d).select(*GRAIN, "demand", "revenue"), ["demand", "revenue"])


@query("eligibility_filter", f"SELECT {K}, count(*) AS n_rows, sum(CASE WHEN label_quality_score >= 0.75 AND target_source NOT IN ('closed_or_missing_observation', 'dense_calendar_zero_fill') THEN 1 ELSE 0 END)::BIGINT AS n_eligible FROM panel GROUP BY ALL", "panel")
def _(spark, d):
    p = panel(spark, d).withColumns({"usable_for_training_flag": F.lit(True), "censor_flag": F.lit(False), "target_semantics": F.lit("observed_sales")})
    return p.groupBy(*SERIES).agg(F.count("*").alias("n_rows"), F.count_if(C.eligible(p.columns)).alias("n_eligible"))


@query("source_scope_filter", "SELECT dataset_source, count(*) AS n_rows FROM daily WHERE dataset_source IN ('ASIA', 'EUROPE') GROUP BY ALL", "daily")
def _(spark, d):
    return TD.daily(spark, d).where(S.in_sources("dataset_source", ["ASIA", "EUROPE"])).groupBy("dataset_source").agg(F.count("*").alias("n_rows"))


FAMILY = {"STANDARD": "BAGUETTE", "MEDIUM": "PAIN AU CHOCOLAT", "LARGE": "FORMULE SANDWICH", "SMALL": "COOKIE", "ECONOMY": "EAU 50CL", "PROMO": "DIVERS"}
FAMILY_SQL = "CASE p_type WHEN 'STANDARD' THEN 'bread' WHEN 'MEDIUM' THEN 'viennoiserie' WHEN 'LARGE' THEN 'sandwich' WHEN 'SMALL' THEN 'patisserie' WHEN 'ECONOMY' THEN 'beverage' ELSE 'default' END"
RATE_SQL = "CASE f WHEN 'bread' THEN 0.75 WHEN 'viennoiserie' THEN 0.65 WHEN 'patisserie' THEN 0.45 WHEN 'sandwich' THEN 0.35 WHEN 'beverage' THEN 0.80 ELSE 0.50 END"


def article(c):
    return F.element_at(F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv]), F.col(c))


@query("substitution_family", f"SELECT p_partkey, f AS family, CAST({RATE_SQL} AS DOUBLE) AS recovery_rate FROM (SELECT p_partkey, {FAMILY_SQL} AS f FROM part)")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", C.substitution_family(article("p_type")).alias("family")).withColumn("recovery_rate", C.recovery_rate("family"))


@query("economic_segment", f"SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'product:PROMO' ELSE {FAMILY_SQL} END AS segment FROM part")
def _(spark, d):
    return table(spark, d, "part").withColumn("article", article("p_type")).select("p_partkey", C.economic_segment("p_type", None, "article", ["PROMO"]).alias("segment"))


@query("label_quality_bucket", f"SELECT CASE WHEN label_quality_score >= 0.95 THEN 'high' WHEN label_quality_score >= 0.75 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n_rows FROM panel GROUP BY ALL", "panel")
def _(spark, d):
    return panel(spark, d).groupBy(C.quality_bucket("label_quality_score").alias("bucket")).agg(F.count("*").alias("n_rows"))


@query("reconstruct_absolute", "SELECT event_id, round(greatest(exp(value / 100 + ln(1 + value)) - 1, 0), 6) AS y FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", C.reconstruct_absolute("delta_log_wow", F.col("value") / 100, "value").alias("y"))


@query("categorical_encode", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) + 1 AS code FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return S.encode(e, S.fit_encoder(e, "event_type"), "event_type").select("event_id", F.col("event_type_code").alias("code"))


@query("median_impute", "SELECT dataset_source, round(sum(coalesce(revenue, (SELECT quantile_cont(revenue, 0.5) FROM panel))), 2) AS revenue FROM panel GROUP BY ALL", "panel")
def _(spark, d):
    p = panel(spark, d)
    return S.impute(p, S.fit_median(p, ["revenue"])).groupBy("dataset_source").agg(F.round(F.sum("revenue"), 2).alias("revenue"))


@query("invalid_article_filter", "SELECT p_type, count(*) AS n_rows FROM part WHERE p_type NOT IN ('PROMO', 'SMALL') GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "part").where(~F.col("p_type").isin("PROMO", "SMALL")).groupBy("p_type").agg(F.count("*").alias("n_rows"))


@query("group_identifier", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, '<NA>') || '__' || o_orderpriority AS gid FROM orders")
def _(spark, d):
    return table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).select("o_orderkey", C.group_id(["s", "o_orderpriority"]).alias("gid"))


@query("dataset_slice", "SELECT dataset_source, count(*) AS n_rows FROM daily WHERE dataset_source LIKE 'A%' GROUP BY ALL", "daily")
def _(spark, d):
    return TD.daily(spark, d).where(F.col("dataset_source").like("A%")).groupBy("dataset_source").agg(F.count("*").alias("n_rows"))


@query("select_exclude", "SELECT * EXCLUDE (p_name, p_brand) FROM part")
def _(spark, d):
    return table(spark, d, "part").drop("p_name", "p_brand")


@query("profiles_project", "SELECT product_id, max(dataset_source) AS category_level_1, count(*) AS n_rows FROM daily GROUP BY ALL", "daily")
def _(spark, d):
    return TD.daily(spark, d).groupBy("product_id").agg(F.max("dataset_source").alias("category_level_1"), F.count("*").alias("n_rows"))


@query("drop_zero_only_features", "SELECT 'nothing' AS feature, count(*) AS n_rows FROM events")
def _(spark, d):
    e = table(spark, d, "events").withColumn("nothing", F.lit(0.0))
    names = S.zero_only(e, ["value", "nothing"])
    return e.agg(F.count("*").alias("n_rows")).select(F.lit(",".join(names)).alias("feature"), "n_rows")


# ---- joins


@query("join_inner_equi", "SELECT p_type, count(*) AS n_rows, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(spark, d):
    return R.join_on(table(spark, d, "lineitem").withColumnRenamed("l_partkey", "k").select("k", "l_quantity"), table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_type"), ["k"]).groupBy("p_type").agg(F.count("*").alias("n_rows"), F.sum("l_quantity").alias("qty"))


@query("join_left_star", f"SELECT {K}, CAST(s.dt AS VARCHAR) AS dt, qty, h.dt IS NOT NULL AS holiday FROM spine s LEFT JOIN daily USING (dataset_source, location_id, product_id, dt) LEFT JOIN (SELECT DISTINCT country_code, dt FROM holidays) h ON h.country_code = dataset_source AND h.dt = s.dt", "spine holidays")
def _(spark, d):
    day = TD.daily(spark, d)
    spine = R.densify(R.series_bounds(day, SERIES), "min_dt", "max_dt")
    h = TD.holidays(spark).select(F.col("country_code").alias("dataset_source"), "dt", F.lit(True).alias("holiday")).distinct()
    return R.star_join(spine, [(day.select(*GRAIN, "qty"), GRAIN), (h, ["dataset_source", "dt"])]).withColumn("holiday", F.coalesce("holiday", F.lit(False)))


@query("join_left_expr_key", "SELECT n_nationkey, coalesce(r.r_name, 'NONE') AS region FROM nation LEFT JOIN region r ON coalesce(nullif(n_regionkey, 2), 0) = r.r_regionkey")
def _(spark, d):
    out = R.join_expr(table(spark, d, "nation"), table(spark, d, "region"), {"r_regionkey": F.coalesce(F.nullif(F.col("n_regionkey"), F.lit(2)), F.lit(0))})
    return out.select("n_nationkey", F.coalesce("r_name", F.lit("NONE")).alias("region"))


@query("join_semi_governance", f"SELECT dataset_source, count(*) AS n_rows FROM daily WHERE dataset_source IN ({ALLOWED}) GROUP BY ALL", "daily registry")
def _(spark, d):
    return R.govern(TD.daily(spark, d), S.allowed_datasets(TD.registry(spark)), "dataset_source").groupBy("dataset_source").agg(F.count("*").alias("n_rows"))


@query("join_anti_ungoverned", f"SELECT DISTINCT dataset_source FROM daily WHERE dataset_source NOT IN ({ALLOWED})", "daily registry")
def _(spark, d):
    return R.ungoverned(TD.daily(spark, d), S.allowed_datasets(TD.registry(spark)), "dataset_source")


@query("join_anti_rowid", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    return R.minus_rows(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("join_cross_scalar", f"SELECT {K}, CAST(dt AS VARCHAR) AS dt, datediff('day', dt, (SELECT max(dt) FROM daily))::BIGINT AS days_left FROM daily", "daily")
def _(spark, d):
    day = TD.daily(spark, d)
    return R.with_scalar(day, day.agg(F.max("dt").alias("last"))).select(*GRAIN, F.datediff("last", "dt").alias("days_left"))


@query("join_lateral_series", f"SELECT {K}, CAST(dt AS VARCHAR) AS dt FROM spine", "spine")
def _(spark, d):
    return R.densify(R.series_bounds(TD.daily(spark, d), SERIES), "min_dt", "max_dt")


@query("join_cross_calendar", "SELECT CAST(a.dt AS VARCHAR) AS dt, b.product_id FROM (SELECT DISTINCT dt FROM daily) a CROSS JOIN (SELECT DISTINCT product_id FROM daily) b", "daily")
def _(spark, d):
    day = TD.daily(spark, d)
    days = day.select("dt").distinct().agg(F.array_sort(F.collect_set("dt")).alias("days"))
    return R.with_scalar(day.select("product_id").distinct(), days).select("product_id", F.explode("days").alias("dt"))


MACRO_SQL = """SELECT CAST(dt AS VARCHAR) AS dt, country_code, metric_name, value FROM (
 SELECT s.dt, s.country_code, s.metric_name, m.value, row_number() OVER (PARTITION BY s.dt, s.country_code, s.metric_name ORDER BY m.effective_from DESC NULLS LAST, m.source_priority) AS rn
 FROM (SELECT DISTINCT a.dt, b.country_code, b.metric_name FROM (SELECT DISTINCT dataset_source, dt FROM daily) a JOIN (SELECT DISTINCT country_code, metric_name FROM macro) b ON a.dataset_source = b.country_code) s
 LEFT JOIN macro m ON m.country_code = s.country_code AND m.metric_name = s.metric_name AND m.effective_from <= s.dt AND m.available_from <= s.dt) WHERE rn = 1"""


def macro_spine(spark, d):
    m = TD.macro(spark)
    days = TD.daily(spark, d).select(F.col("dataset_source").alias("country_code"), "dt").distinct()
    return R.asof_join(days.join(m.select("country_code", "metric_name").distinct(), "country_code"), m, ["country_code", "metric_name"])


@query("join_asof_macro", MACRO_SQL, "daily macro")
def _(spark, d):
    return macro_spine(spark, d).select("dt", "country_code", "metric_name", "value")


@query("win_asof_rank", "SELECT dataset_source, CAST(dt AS VARCHAR) AS dt, qty FROM (SELECT *, row_number() OVER (PARTITION BY dataset_source ORDER BY dt DESC, location_id, product_id) AS r FROM daily) WHERE r = 1", "daily")
def _(spark, d):
    return R.first_row(TD.daily(spark, d), ["dataset_source"], [F.desc("dt"), F.col("location_id"), F.col("product_id")]).select("dataset_source", "dt", "qty")


@query("join_range_clip", f"SELECT h.country_code, CAST(h.dt AS VARCHAR) AS dt, b.location_id FROM holidays h JOIN (SELECT dataset_source, location_id, min(dt) AS lo, max(dt) AS hi FROM daily GROUP BY ALL) b ON h.country_code = b.dataset_source AND h.dt BETWEEN lo AND hi", "daily holidays")
def _(spark, d):
    b = R.series_bounds(TD.daily(spark, d), ["dataset_source", "location_id"]).withColumnRenamed("dataset_source", "country_code")
    return R.clip_join(TD.holidays(spark), b, ["country_code"]).select("country_code", "dt", "location_id")


@query("join_template_fill", f"SELECT {K}, CAST(dt AS VARCHAR) AS dt, round(coalesce(revenue, (first_value(revenue) OVER (PARTITION BY dataset_source ORDER BY revenue IS NULL, dt, location_id, product_id))), 6) AS revenue FROM panel", "panel")
def _(spark, d):
    p = panel(spark, d)
    t = R.first_row(p.where("revenue IS NOT NULL"), ["dataset_source"], [F.col("dt"), F.col("location_id"), F.col("product_id")])
    return R.fill_from_template(p, t, ["dataset_source"], ["revenue"]).select(*GRAIN, "revenue")


@query("join_target_shift", f"SELECT a.dataset_source, a.location_id, a.product_id, CAST(a.dt AS VARCHAR) AS dt, b.qty AS feature FROM daily a JOIN daily b ON a.dataset_source = b.dataset_source AND a.location_id = b.location_id AND a.product_id = b.product_id AND a.dt = b.dt + 1", "daily")
def _(spark, d):
    day = TD.daily(spark, d)
    feats = day.select(*SERIES, F.date_add("dt", 1).alias("target_dt"), F.col("qty").alias("feature"))
    return R.join_target(day.select(*GRAIN), feats, SERIES, "dt", "target_dt").select(*GRAIN, "feature")


@query("join_one_to_one", f"SELECT {K}, CAST(s.dt AS VARCHAR) AS dt, qty FROM spine s LEFT JOIN daily USING (dataset_source, location_id, product_id, dt)", "spine")
def _(spark, d):
    day = TD.daily(spark, d)
    return R.align_one_to_one(R.densify(R.series_bounds(day, SERIES), "min_dt", "max_dt"), day.select(*GRAIN, "qty"), GRAIN)


@query("join_horizon_fallback", "WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events), b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) SELECT a.user_id, a.step, a.event_id, round(b.value, 6) AS value FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.step = b.step")
def _(spark, d):
    e = table(spark, d, "events")
    return R.align_by_step(e.select("user_id", F.struct("event_id").alias("o"), "event_id"), e.select("user_id", F.struct("ts", "event_id").alias("o"), "value"), "user_id", "o").select("user_id", "step", "event_id", "value")


@query("join_prediction_prices", f"SELECT product_id, round(sum(revenue) / sum(qty), 6) AS unit_price FROM daily GROUP BY ALL", "daily")
def _(spark, d):
    day = TD.daily(spark, d)
    return day.select("product_id", "dt").distinct().join(day, ["product_id", "dt"]).groupBy("product_id").agg((F.sum("revenue") / F.sum("qty")).alias("unit_price"))


@query("join_year_ago_lookup", f"SELECT a.dataset_source, a.location_id, a.product_id, CAST(a.dt AS VARCHAR) AS dt, coalesce(b.qty, c.qty, e.qty) AS year_ago_qty FROM daily a LEFT JOIN daily b ON a.dataset_source = b.dataset_source AND a.location_id = b.location_id AND a.product_id = b.product_id AND b.dt = a.dt - 365 LEFT JOIN daily c ON a.dataset_source = c.dataset_source AND a.location_id = c.location_id AND a.product_id = c.product_id AND c.dt = a.dt - 364 LEFT JOIN daily e ON a.dataset_source = e.dataset_source AND a.location_id = e.location_id AND a.product_id = e.product_id AND e.dt = a.dt - 366", "daily")
def _(spark, d):
    return R.year_ago(TD.daily(spark, d), SERIES, "qty").select(*GRAIN, "year_ago_qty")


@query("join_prediction_fill", f"SELECT {K}, CAST(s.dt AS VARCHAR) AS dt, coalesce(qty, 0) AS prediction FROM spine s LEFT JOIN daily USING (dataset_source, location_id, product_id, dt)", "spine")
def _(spark, d):
    day = TD.daily(spark, d)
    return R.fill_predictions(R.densify(R.series_bounds(day, SERIES), "min_dt", "max_dt"), day.select(*GRAIN, F.col("qty").alias("prediction")), GRAIN)


TOP = f"SELECT {K} FROM daily GROUP BY ALL HAVING count(*) >= 10 AND sum(qty) > 100 ORDER BY count(*) DESC, {K} LIMIT 7"


@query("join_smoke_series", f"SELECT {K}, count(*) AS n_rows FROM daily JOIN ({TOP}) USING ({K}) GROUP BY ALL", "daily")
def _(spark, d):
    day = TD.daily(spark, d)
    top = R.top_rows(day.groupBy(*SERIES).agg(F.count("*").alias("n"), F.sum("qty").alias("q")).where("n >= 10 AND q > 100"), [F.desc("n"), *map(F.col, SERIES)], 7)
    return R.keep_series(day, top, SERIES).groupBy(*SERIES).agg(F.count("*").alias("n_rows"))


@query("join_cold_start_context", "SELECT user_id, count(*) AS n_rows FROM (SELECT user_id FROM events WHERE event_type = 'error' UNION ALL SELECT u.user_id FROM (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')) u, (SELECT DISTINCT CAST(ts AS DATE) FROM events WHERE event_type = 'error') c) GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "events")
    ctx = e.where("event_type = 'error'").select("user_id", F.to_date("ts").alias("dt"), "value")
    cold = ctx.groupBy("dt").agg(F.avg("value").alias("value"))
    return R.add_cold_start(ctx, e.select("user_id"), cold, "user_id").groupBy("user_id").agg(F.count("*").alias("n_rows"))


# ---- aggregates


@query("agg_daily_demand", f"SELECT {K}, CAST(dt AS VARCHAR) AS dt, qty, revenue, n_lines FROM daily", "daily")
def _(spark, d):
    return TD.daily(spark, d)


@query("agg_series_bounds", f"SELECT {K}, CAST(min_dt AS VARCHAR) AS min_dt, CAST(max_dt AS VARCHAR) AS max_dt FROM bounds", "bounds")
def _(spark, d):
    return R.series_bounds(TD.daily(spark, d), SERIES)


@query("agg_location_day_context", "SELECT dataset_source, location_id, CAST(dt AS VARCHAR) AS dt, bool_or(l_returnflag = 'R') AS returned, round(avg(discount), 6) AS discount, max(product_id) AS event_name FROM lines GROUP BY ALL", "lines")
def _(spark, d):
    return TD.order_lines(spark, d).groupBy("dataset_source", "location_id", "dt").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.avg("discount").alias("discount"), F.max("product_id").alias("event_name"))


@query("agg_source_policy", "SELECT l.dataset_source, max(review_status) AS review_status, bool_or(source_role = 'synthetic') AS is_synthetic, min(source_priority)::BIGINT AS priority FROM lines l JOIN registry r ON l.dataset_source = r.dataset_source GROUP BY ALL", "lines registry")
def _(spark, d):
    return TD.order_lines(spark, d).join(TD.registry(spark), "dataset_source").groupBy("dataset_source").agg(F.max("review_status").alias("review_status"), F.bool_or(F.col("source_role") == "synthetic").alias("is_synthetic"), F.min("source_priority").alias("priority"))


@query("agg_multi_provider_resolve", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, round(avg(value), 6) AS value, max(user_id) AS user_id, count(DISTINCT event_type) AS provider_count, count(DISTINCT user_id) > 1 AS user_id_conflict FROM events GROUP BY CAST(ts AS DATE)")
def _(spark, d):
    e = table(spark, d, "events").withColumn("dt", F.to_date("ts"))
    return R.resolve_providers(e, ["dt"], "event_type", ["user_id"], ["value"], ["user_id"])


@query("agg_string_ordered", "SELECT user_id, string_agg(event_type, ' | ' ORDER BY event_type) AS types FROM events GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(R.ordered_concat("event_type").alias("types"))


@query("agg_holiday_by_country_day", "SELECT country_code, CAST(h.dt AS VARCHAR) AS dt, string_agg(DISTINCT h.name, ' | ' ORDER BY h.name) AS names, count(DISTINCT d.location_id) AS locations FROM holidays h LEFT JOIN daily d ON d.dataset_source = country_code AND d.dt = h.dt GROUP BY ALL", "daily holidays")
def _(spark, d):
    day = TD.daily(spark, d).withColumnRenamed("dataset_source", "country_code")
    return TD.holidays(spark).join(day, ["country_code", "dt"], "left").groupBy("country_code", "dt").agg(F.array_join(F.array_sort(F.collect_set("name")), " | ").alias("names"), F.countDistinct("location_id").alias("locations"))


@query("agg_pivot_metrics", f"SELECT dt, country_code, max(CASE WHEN metric_name = 'rate' THEN value END) AS rate_latest, max(CASE WHEN metric_name = 'cpi' THEN value END) AS cpi_latest, count(value) > 0 AS any_available FROM ({MACRO_SQL}) GROUP BY ALL", "daily macro")
def _(spark, d):
    return R.pivot_metrics(macro_spine(spark, d), ["dt", "country_code"], ["rate", "cpi"])


@query("agg_applicability", "SELECT dataset_source, max((demand IS NOT NULL)::INT)::BIGINT AS demand_applicable, max((revenue IS NOT NULL)::INT)::BIGINT AS revenue_applicable FROM panel GROUP BY ALL", "panel")
def _(spark, d):
    return R.applicability(panel(spark, d), "dataset_source", ["demand", "revenue"])


@query("agg_quality_counts", f"SELECT {K}, CAST(dt AS VARCHAR) AS dt, ((demand IS NULL)::INT + (revenue IS NULL)::INT)::BIGINT AS missing_count FROM panel", "panel")
def _(spark, d):
    return panel(spark, d).select(*GRAIN, (F.col("demand").isNull().cast("int") + F.col("revenue").isNull().cast("int")).alias("missing_count"))


@query("agg_source_weights", "SELECT yr AS split, dataset_source, n AS row_count, round(avg(n) OVER (PARTITION BY yr) / n, 6) AS source_weight FROM (SELECT year(dt) AS yr, dataset_source, count(*) AS n FROM daily GROUP BY ALL)", "daily")
def _(spark, d):
    return R.source_weights(TD.daily(spark, d).withColumn("split", F.year("dt")), "split", "dataset_source")


@query("agg_equal_dataset_weights", "SELECT dataset_source, round(sum(w), 4) AS total, count(*) AS n_rows FROM (SELECT dataset_source, CAST((SELECT count(*) FROM daily) AS DOUBLE) / ((SELECT count(DISTINCT dataset_source) FROM daily) * count(*) OVER (PARTITION BY dataset_source)) AS w FROM daily) GROUP BY ALL", "daily")
def _(spark, d):
    return R.equal_weights(TD.daily(spark, d), "dataset_source").groupBy("dataset_source").agg(F.round(F.sum("weight"), 4).alias("total"), F.count("*").alias("n_rows"))


@query("agg_run_manifest", "SELECT dataset_source, CAST(min(dt) AS VARCHAR) AS min_dt, CAST(max(dt) AS VARCHAR) AS max_dt, count(*) AS n_rows, count(DISTINCT location_id || '__' || product_id) AS n_series, sum((demand IS NULL)::INT)::BIGINT AS null_targets FROM panel GROUP BY ALL", "panel")
def _(spark, d):
    return panel(spark, d).groupBy("dataset_source").agg(F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"), F.count("*").alias("n_rows"), F.countDistinct(C.series_id("location_id", "product_id")).alias("n_series"), F.count_if(F.col("demand").isNull()).alias("null_targets"))


@query("agg_granularity", "SELECT event_type, CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS VARCHAR) AS bucket, round(sum(value), 4) AS value, count(*) AS n_rows FROM events GROUP BY ALL")
def _(spark, d):
    return R.roll_up(table(spark, d, "events"), "quarter_hour", ["event_type"], "ts", ["value"]).withColumn("value", F.round("value", 4))


@query("agg_profile_stats", "SELECT round(avg((demand = 0)::INT), 6) AS zero_rate, round(avg(demand), 6) AS mean, round(quantile_cont(demand, 0.5), 6) AS median, round(stddev_samp(demand), 6) AS sd, round(stddev_samp(demand) / avg(demand), 6) AS cv FROM panel", "panel")
def _(spark, d):
    return panel(spark, d).agg(F.avg((F.col("demand") == 0).cast("double")).alias("zero_rate"), F.avg("demand").alias("mean"), F.percentile("demand", 0.5).alias("median"), F.stddev_samp("demand").alias("sd"), (F.stddev_samp("demand") / F.avg("demand")).alias("cv"))


@query("agg_series_autocorr", f"SELECT {K}, round(covar_pop(demand, p) / nullif(stddev_pop(CASE WHEN p IS NOT NULL THEN demand END) * stddev_pop(CASE WHEN demand IS NOT NULL THEN p END), 0), 6) AS autocorr FROM (SELECT *, lag(demand, 7) OVER ({W}) AS p FROM panel) GROUP BY ALL HAVING count(*) >= 17 AND count(DISTINCT demand) > 1", "panel")
def _(spark, d):
    return R.series_autocorr(panel(spark, d), SERIES, "demand", 7)


@query("agg_dow_lift", "SELECT (isodow(dt) - 1)::BIGINT AS weekday, round(avg(qty) / (SELECT avg(qty) FROM daily), 6) AS lift FROM daily GROUP BY ALL", "daily")
def _(spark, d):
    return R.dow_lift(TD.daily(spark, d), "qty")


@query("agg_frame_summary", "SELECT coalesce(dataset_source, 'all') AS source, count(*) AS n_rows, count(DISTINCT location_id || '__' || product_id) AS n_series, CAST(min(dt) AS VARCHAR) AS first_dt, CAST(max(dt) AS VARCHAR) AS last_dt FROM daily GROUP BY ROLLUP (dataset_source)", "daily")
def _(spark, d):
    return TD.daily(spark, d).rollup("dataset_source").agg(F.count("*").alias("n_rows"), F.countDistinct(C.series_id("location_id", "product_id")).alias("n_series"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")).select(F.coalesce("dataset_source", F.lit("all")).alias("source"), "n_rows", "n_series", "first_dt", "last_dt")


@query("agg_generation_stats", "SELECT coalesce(dataset_source, 'all') AS source, count(*) AS n_rows, count(DISTINCT location_id) AS n_sites, sum((l_returnflag = 'R')::INT)::BIGINT AS n_returned FROM lines GROUP BY ROLLUP (dataset_source)", "lines")
def _(spark, d):
    return TD.order_lines(spark, d).rollup("dataset_source").agg(F.count("*").alias("n_rows"), F.countDistinct("location_id").alias("n_sites"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned")).select(F.coalesce("dataset_source", F.lit("all")).alias("source"), "n_rows", "n_sites", "n_returned")


@query("agg_zero_day_ratio", "SELECT product_id, round(avg((demand = 0)::INT), 6) AS zero_ratio FROM panel WHERE demand IS NOT NULL GROUP BY ALL HAVING avg((demand = 0)::INT) <= 0.9", "panel")
def _(spark, d):
    return panel(spark, d).where("demand IS NOT NULL").groupBy("product_id").agg(F.avg((F.col("demand") == 0).cast("double")).alias("zero_ratio")).where("zero_ratio <= 0.9")


@query("agg_unit_price", "SELECT product_id, round(sum(revenue) / sum(qty), 6) AS unit_price FROM daily WHERE qty > 0 GROUP BY ALL", "daily")
def _(spark, d):
    return TD.daily(spark, d).where("qty > 0").groupBy("product_id").agg((F.sum("revenue") / F.sum("qty")).alias("unit_price"))


@query("agg_exclusion_report", "SELECT year(dt) AS split, count(*) AS input_rows, sum((label_quality_score >= 0.75)::INT)::BIGINT AS kept_rows, sum((target_source <> 'observed_sales')::INT)::BIGINT AS dense_rows FROM panel GROUP BY ALL", "panel")
def _(spark, d):
    return panel(spark, d).groupBy(F.year("dt").alias("split")).agg(F.count("*").alias("input_rows"), F.count_if(F.col("label_quality_score") >= 0.75).alias("kept_rows"), F.count_if(F.col("target_source") != "observed_sales").alias("dense_rows"))


@query("agg_null_diagnostics", "SELECT 'demand' AS column_name, sum((demand IS NULL)::INT)::BIGINT AS null_count FROM panel UNION ALL SELECT 'revenue', sum((revenue IS NULL)::INT)::BIGINT FROM panel", "panel")
def _(spark, d):
    return R.null_counts(panel(spark, d), ["demand", "revenue"])


@query("agg_feature_audit", "SELECT dataset_source, min(demand) AS lo, max(demand) AS hi, round(avg(demand), 6) AS mean, sum((demand <= 0)::INT)::BIGINT AS nonpositive, round(avg((revenue IS NULL)::INT), 6) AS revenue_null_rate FROM panel GROUP BY ALL", "panel")
def _(spark, d):
    return panel(spark, d).groupBy("dataset_source").agg(F.min("demand").alias("lo"), F.max("demand").alias("hi"), F.avg("demand").alias("mean"), F.count_if(F.col("demand") <= 0).alias("nonpositive"), F.avg(F.col("revenue").isNull().cast("double")).alias("revenue_null_rate"))


@query("agg_cold_start_series", "SELECT CAST(dt AS VARCHAR) AS dt, round(avg(qty), 6) AS qty, min(product_id) AS product_id FROM daily GROUP BY ALL", "daily")
def _(spark, d):
    return TD.daily(spark, d).groupBy("dt").agg(F.avg("qty").alias("qty"), F.min("product_id").alias("product_id"))


@query("agg_group_having", TOP, "daily")
def _(spark, d):
    return R.top_rows(TD.daily(spark, d).groupBy(*SERIES).agg(F.count("*").alias("n"), F.sum("qty").alias("q")).where("n >= 10 AND q > 100"), [F.desc("n"), *map(F.col, SERIES)], 7).select(*SERIES)


@query("agg_train_group_sizes", f"SELECT {K}, count(*) AS n_rows FROM daily GROUP BY ALL", "daily")
def _(spark, d):
    return TD.daily(spark, d).groupBy(*SERIES).agg(F.count("*").alias("n_rows"))


@query("agg_distinct_keys", f"SELECT DISTINCT {K} FROM daily", "daily")
def _(spark, d):
    return TD.daily(spark, d).select(*SERIES).distinct()


# ---- windows

ORDER = "l_quantity DESC, l_extendedprice, l_partkey, l_suppkey, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"


def order_cols():
    return [F.desc("l_quantity"), *[F.col(c) for c in "l_extendedprice l_partkey l_suppkey l_discount l_tax l_shipdate l_returnflag l_linestatus".split()]]


@query("win_dedup_rank", f"SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ORDER}) AS r FROM lineitem) WHERE r = 1")
def _(spark, d):
    return R.dedup(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order_cols()).select("l_orderkey", "l_linenumber", "l_quantity")


@query("win_dedup_audit", f"SELECT l_orderkey, l_linenumber, l_quantity, r AS dedup_rank, n AS duplicate_count FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ORDER}) AS r, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE r > 1")
def _(spark, d):
    return R.dedup_audit(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order_cols()).select("l_orderkey", "l_linenumber", "l_quantity", "dedup_rank", "duplicate_count")


G = f"{K}, CAST(dt AS VARCHAR) AS dt"


@query("win_lead_target", f"SELECT {G}, lead(demand) OVER ({W}) AS next_demand, lead(target_source) OVER ({W}) AS next_target_source FROM panel", "panel")
def _(spark, d):
    return R.lead_target(panel(spark, d), SERIES, ["demand", "target_source"]).select(*GRAIN, "next_demand", "next_target_source")


@query("win_lags", f"SELECT {G}, {', '.join(f'lag(demand, {k}) OVER ({W}) AS demand_lag_{k}' for k in (1, 2, 7, 14, 21, 28))} FROM panel", "panel")
def _(spark, d):
    return R.add_lags(panel(spark, d).select(*GRAIN, "demand"), SERIES, {"demand": (1, 2, 7, 14, 21, 28)}).drop("demand")


@query("win_target_lags", f"SELECT {G}, {', '.join(f'lag(demand, {k - 1}) OVER ({W}) AS target_lag_{k}' for k in (1, 7, 14))} FROM panel", "panel")
def _(spark, d):
    return R.add_target_lags(panel(spark, d).select(*GRAIN, "demand"), SERIES, "demand", (1, 7, 14)).drop("demand")


@query("win_rolling", f"SELECT {G}, {', '.join(f'round(avg(demand) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS demand_mean_{n}' for n in (7, 28))} FROM panel", "panel")
def _(spark, d):
    return R.add_rolling(panel(spark, d).select(*GRAIN, "demand"), SERIES, {"demand": (7, 28)}).drop("demand")


@query("win_running_count", f"SELECT {G}, sum(is_observed_row::INT) OVER ({W})::BIGINT AS history_available_days FROM panel", "panel")
def _(spark, d):
    return R.history_days(panel(spark, d), SERIES, "is_observed_row").select(*GRAIN, "history_available_days")


@query("win_ffill_limited", f"SELECT {G}, round(CASE WHEN revenue IS NOT NULL THEN revenue WHEN datediff('day', ld, dt) BETWEEN 1 AND 2 THEN lv END, 6) AS revenue FROM (SELECT *, last_value(revenue IGNORE NULLS) OVER ({W}) AS lv, last_value(CASE WHEN revenue IS NOT NULL THEN dt END IGNORE NULLS) OVER ({W}) AS ld FROM panel)", "panel")
def _(spark, d):
    return R.ffill_limited(panel(spark, d).select(*GRAIN, "revenue"), SERIES, ["revenue"])


@query("win_holiday_neighbours", "WITH f AS (SELECT d.dataset_source, d.dt, h.dt IS NOT NULL AS f FROM (SELECT DISTINCT dataset_source, dt FROM spine) d LEFT JOIN (SELECT DISTINCT country_code, dt FROM holidays) h ON h.country_code = d.dataset_source AND h.dt = d.dt), n AS (SELECT *, lead(f, 1, false) OVER (PARTITION BY dataset_source ORDER BY dt) AS pre, lag(f, 1, false) OVER (PARTITION BY dataset_source ORDER BY dt) AS post FROM f) SELECT dataset_source, CAST(dt AS VARCHAR) AS dt, f AS holiday_flag, pre AS pre_holiday_flag, post AS post_holiday_flag, isodow(dt) BETWEEN 2 AND 5 AND (pre OR post) AND NOT f AS bridge_day_flag FROM n", "spine holidays")
def _(spark, d):
    spine = R.densify(R.series_bounds(TD.daily(spark, d), SERIES), "min_dt", "max_dt").select("dataset_source", "dt").distinct()
    h = TD.holidays(spark).select(F.col("country_code").alias("dataset_source"), "dt", F.lit(True).alias("holiday_flag")).distinct()
    return R.holiday_neighbours(spine.join(h, ["dataset_source", "dt"], "left").fillna(False, ["holiday_flag"]), ["dataset_source"])


@query("win_date_rank_split", "SELECT dataset_source, CAST(dt AS VARCHAR) AS dt, row_number() OVER (PARTITION BY dataset_source ORDER BY dt) AS date_rank, count(*) OVER (PARTITION BY dataset_source) AS date_count FROM (SELECT DISTINCT dataset_source, dt FROM daily)", "daily")
def _(spark, d):
    return R.date_ranks(TD.daily(spark, d), "dataset_source")


@query("win_time_index", f"SELECT {G}, row_number() OVER ({W}) - 1 AS time_idx FROM daily", "daily")
def _(spark, d):
    return R.time_index(TD.daily(spark, d), SERIES).select(*GRAIN, "time_idx")


@query("win_weekday_rolling", f"SELECT {G}, round(avg(demand) OVER (PARTITION BY {K}, isodow(dt) ORDER BY dt ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS weekday_mean_4 FROM panel", "panel")
def _(spark, d):
    return R.weekday_rolling(panel(spark, d), SERIES, "demand").select(*GRAIN, "weekday_mean_4")


@query("win_group_transform", "SELECT product_id, CAST(dt AS VARCHAR) AS dt, location_id, dataset_source, round(avg(qty) OVER p, 6) AS qty_mean, round(quantile_cont(qty, 0.5) OVER p, 6) AS qty_median, round(quantile_cont(qty, 0.2) OVER p, 6) AS qty_q20, round(quantile_cont(qty, 0.8) OVER p, 6) AS qty_q80 FROM daily WINDOW p AS (PARTITION BY product_id)", "daily")
def _(spark, d):
    return R.group_stats(TD.daily(spark, d), ["product_id"], "qty").select(*GRAIN, "qty_mean", "qty_median", "qty_q20", "qty_q80")


@query("win_lagged_planning", "SELECT location_id, CAST(dt AS VARCHAR) AS dt, qty, round(coalesce(avg(qty) OVER (PARTITION BY location_id ORDER BY dt ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0), 6) AS planned FROM (SELECT location_id, dt, sum(qty) AS qty FROM daily GROUP BY ALL)", "daily")
def _(spark, d):
    return R.lagged_plan(TD.daily(spark, d), ["location_id"], "qty")


@query("win_tail_n", f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY dt DESC) AS r, count(*) OVER (PARTITION BY {K}) AS n FROM daily WHERE dt < DATE '2001-06-01'), k AS (SELECT {K}, dt FROM t WHERE r <= 20 AND n >= 20), v AS (SELECT {K}, dt FROM daily WHERE dt >= DATE '2001-06-01' AND ({K}) IN (SELECT {K} FROM k)), u AS (SELECT *, 'train' AS part FROM k UNION ALL SELECT *, 'valid' FROM v) SELECT {G}, part, row_number() OVER ({W}) - 1 AS time_idx FROM u".replace(f"({K}) IN (SELECT {K} FROM k)", "EXISTS (SELECT 1 FROM k WHERE k.dataset_source = daily.dataset_source AND k.location_id = daily.location_id AND k.product_id = daily.product_id)"), "daily")
def _(spark, d):
    day = TD.daily(spark, d).select(*GRAIN)
    return R.tail_window(day.where("dt < DATE'2001-06-01'"), day.where("dt >= DATE'2001-06-01'"), SERIES, 20)


# ---- sorts and sets


@query("sort_contract", f"SELECT {G}, qty FROM daily ORDER BY {K}, dt", "daily")
def _(spark, d):
    return TD.daily(spark, d).select(*GRAIN, "qty").orderBy(*GRAIN)


@query("topk_series", f"SELECT {K}, count(*) AS n_rows FROM daily GROUP BY ALL ORDER BY n_rows DESC, {K} LIMIT 5", "daily")
def _(spark, d):
    return R.top_rows(TD.daily(spark, d).groupBy(*SERIES).agg(F.count("*").alias("n_rows")), [F.desc("n_rows"), *map(F.col, SERIES)], 5)


@query("head_per_stratum", f"SELECT {G} FROM (SELECT *, row_number() OVER (PARTITION BY dataset_source, dt ORDER BY location_id, product_id) AS r, count(*) OVER (PARTITION BY dataset_source, dt) AS n FROM daily) WHERE r <= floor(n * 0.5)", "daily")
def _(spark, d):
    return R.head_fraction(TD.daily(spark, d), ["dataset_source", "dt"], ["location_id", "product_id"], 0.5).select(*GRAIN)


@query("union_all_sources", "SELECT nation, count(*) AS n_rows FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY ALL")
def _(spark, d):
    return R.union_all([table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))]).groupBy("nation").agg(F.count("*").alias("n_rows"))


@query("union_relaxed", "SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, NULL FROM supplier")
def _(spark, d):
    return R.union_relaxed([table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))])


@query("distinct_rows", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def _(spark, d):
    return R.keep_last(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("replace_partition_by_source", "SELECT dataset_source, count(*) AS n_rows, sum(qty) AS qty FROM (SELECT dataset_source, qty FROM daily WHERE dataset_source <> 'ASIA' UNION ALL SELECT dataset_source, qty * 2 FROM daily WHERE dataset_source = 'ASIA') GROUP BY ALL", "daily")
def _(spark, d):
    day = TD.daily(spark, d).select("dataset_source", "qty")
    return R.replace_sources(day, day.where("dataset_source = 'ASIA'").withColumn("qty", F.col("qty") * 2), "dataset_source").groupBy("dataset_source").agg(F.count("*").alias("n_rows"), F.sum("qty").alias("qty"))


@query("union_tagged_splits", "SELECT CASE WHEN dt < DATE '2001-01-01' THEN 'train' ELSE 'valid' END AS split, count(*) AS n_rows FROM daily GROUP BY ALL", "daily")
def _(spark, d):
    day = TD.daily(spark, d)
    return R.tag_and_union({"train": day.where("dt < DATE'2001-01-01'"), "valid": day.where("dt >= DATE'2001-01-01'")}).groupBy("split").agg(F.count("*").alias("n_rows"))


# ---- panels


@query("dense_panel", f"SELECT {G}, is_observed_row, demand, target_source, CAST(label_quality_score AS DOUBLE) AS label_quality_score, round(revenue, 6) AS revenue FROM panel", "panel")
def _(spark, d):
    return panel(spark, d).select(*GRAIN, "is_observed_row", "demand", "target_source", "label_quality_score", "revenue")


@query("spine_dates", "SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS VARCHAR) AS dt FROM (SELECT min(dt) AS a, max(dt) + 35 AS b FROM daily)", "daily")
def _(spark, d):
    return TD.daily(spark, d).agg(F.min("dt").alias("a"), F.date_add(F.max("dt"), 35).alias("b")).select(F.explode(F.sequence("a", "b")).alias("dt"))


@query("spine_location", "SELECT dataset_source, location_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS VARCHAR) AS dt FROM (SELECT dataset_source, location_id, min(dt) AS a, max(dt) + 35 AS b FROM daily GROUP BY ALL)", "daily")
def _(spark, d):
    b = R.series_bounds(TD.daily(spark, d), ["dataset_source", "location_id"]).withColumn("max_dt", F.date_add("max_dt", 35))
    return R.densify(b, "min_dt", "max_dt")


@query("spine_series", f"SELECT {G} FROM spine", "spine")
def _(spark, d):
    return R.densify(R.series_bounds(TD.daily(spark, d), SERIES), "min_dt", "max_dt")


CAL = "(isodow(dt) - 1)::BIGINT AS target_day_of_week, weekofyear(dt) AS target_week_of_year, quarter(dt) AS target_quarter, isodow(dt) >= 6 AS target_is_weekend, round(sin(2 * pi() * (isodow(dt) - 1) / 7), 6) AS target_dow_sin, round(cos(2 * pi() * weekofyear(dt) / 53), 6) AS target_week_cos, day(dt) <= 3 AS month_start_flag, month(dt + 1) <> month(dt) AS month_end_flag"


@query("target_calendar_features", f"SELECT CAST(dt AS VARCHAR) AS dt, {CAL} FROM (SELECT DISTINCT dt FROM daily)", "daily")
def _(spark, d):
    names = ("target_day_of_week", "target_week_of_year", "target_quarter", "target_is_weekend", "target_dow_sin", "target_week_cos")
    f = {k: v for k, v in C.calendar_features("dt").items() if k in names} | C.month_flags("dt")
    return TD.daily(spark, d).select("dt").distinct().withColumns(f)


@query("location_calendar", "SELECT DISTINCT location_id, CAST(dt AS VARCHAR) AS dt, month(dt) AS month, isodow(dt) >= 6 AS weekend FROM spine", "spine")
def _(spark, d):
    return R.densify(R.series_bounds(TD.daily(spark, d), SERIES), "min_dt", "max_dt").select("location_id", "dt", F.month("dt").alias("month"), (F.weekday("dt") >= 5).alias("weekend")).distinct()


BLEND = f"WITH f AS (SELECT *, lead(demand) OVER w AS target, demand AS l1, lag(demand, 6) OVER w AS l7, lag(demand, 13) OVER w AS l14, lag(demand, 20) OVER w AS l21, lag(demand, 27) OVER w AS l28, sum(is_observed_row::INT) OVER w AS h FROM panel WINDOW w AS ({W}))"


@query("same_dow_mean_4w", f"{BLEND} SELECT {G}, round((coalesce(l7, 0) + coalesce(l14, 0) + coalesce(l21, 0) + coalesce(l28, 0)) / nullif((l7 IS NOT NULL)::INT + (l14 IS NOT NULL)::INT + (l21 IS NOT NULL)::INT + (l28 IS NOT NULL)::INT, 0), 6) AS same_dow_mean_4w FROM f", "panel")
def _(spark, d):
    return feature_panel(panel(spark, d), SERIES).select(*GRAIN, "same_dow_mean_4w")


@query("field_baseline_blend", f"{BLEND} SELECT {G}, coalesce(0.5 * l1 + 0.5 * l7, l1, l7) AS field_baseline, target - coalesce(0.5 * l1 + 0.5 * l7, l1, l7) AS residual FROM f", "panel")
def _(spark, d):
    return feature_panel(panel(spark, d), SERIES).select(*GRAIN, "field_baseline", "residual")


@query("delta_log_wow", f"{BLEND} SELECT {G}, round(CASE WHEN target >= 0 AND l7 >= 0 THEN ln(1 + target) - ln(1 + l7) END, 6) AS delta_log_wow FROM f", "panel")
def _(spark, d):
    return feature_panel(panel(spark, d), SERIES).select(*GRAIN, "delta_log_wow")


@query("cold_start_bucket", f"{BLEND} SELECT CASE WHEN h <= 0 THEN '0' WHEN h <= 7 THEN '1_7' WHEN h <= 14 THEN '8_14' WHEN h <= 28 THEN '15_28' WHEN h <= 56 THEN '29_56' ELSE '56_plus' END AS bucket, count(*) AS n_rows FROM f GROUP BY ALL", "panel")
def _(spark, d):
    return feature_panel(panel(spark, d), SERIES).groupBy(F.col("history_bucket").alias("bucket")).agg(F.count("*").alias("n_rows"))


@query("training_usability_gold", f"WITH f AS (SELECT *, lead(label_quality_score) OVER ({W}) AS q, lead(target_source) OVER ({W}) AS s FROM panel) SELECT {G}, CASE WHEN q IS NULL THEN NULL ELSE q >= 0.75 AND s NOT IN ('closed_or_missing_observation', 'dense_calendar_zero_fill') END AS usable FROM f", "panel")
def _(spark, d):
    return feature_panel(panel(spark, d), SERIES).select(*GRAIN, F.col("target_usable").alias("usable"))


@query("decision_timestamp", f"SELECT {G}, strftime(dt, '%Y-%m-%d') || ' 23:59:59' AS decision_ts FROM daily", "daily")
def _(spark, d):
    return TD.daily(spark, d).select(*GRAIN, C.decision_timestamp("dt").alias("decision_ts"))


@query("feature_panel", f"{BLEND} SELECT {G}, target, l1 AS target_lag_1, l7 AS target_lag_7, round(avg(demand) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS demand_mean_7, round(avg(demand) OVER ({W} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 6) AS demand_mean_28, coalesce(0.5 * l1 + 0.5 * l7, l1, l7) AS field_baseline FROM f", "panel")
def _(spark, d):
    return feature_panel(panel(spark, d), SERIES).select(*GRAIN, "target", "target_lag_1", "target_lag_7", "demand_mean_7", "demand_mean_28", "field_baseline")


@query("inventory_ledger", "SELECT user_id, kind, round(sum(qty), 4) AS qty FROM (SELECT user_id, 'production' AS kind, value AS qty FROM events WHERE value > 0 UNION ALL SELECT user_id, 'sale', -floor(value / 2) FROM events WHERE floor(value / 2) > 0) GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("value").alias("production"), F.floor(F.col("value") / 2).cast("double").alias("sale"))
    return S.ledger(e, ["user_id"], {"production": 1, "sale": -1}).groupBy("user_id", "kind").agg(F.round(F.sum("qty"), 4).alias("qty"))


@query("reference_dense_dataset", f"SELECT CAST(a.dt AS VARCHAR) AS dt, b.product_id, coalesce(q, 0) AS qty, q IS NULL AS filled FROM (SELECT DISTINCT dt FROM daily) a CROSS JOIN (SELECT DISTINCT product_id FROM daily) b LEFT JOIN (SELECT product_id, dt, sum(qty) AS q FROM daily GROUP BY ALL) c ON a.dt = c.dt AND b.product_id = c.product_id", "daily")
def _(spark, d):
    per = TD.daily(spark, d).groupBy("product_id", "dt").agg(F.sum("qty").alias("q"))
    days = per.agg(F.array_sort(F.collect_set("dt")).alias("days"))
    cells = R.with_scalar(per.select("product_id").distinct(), days).select("product_id", F.explode("days").alias("dt"))
    return cells.join(per, ["product_id", "dt"], "left").select("dt", "product_id", F.coalesce("q", F.lit(0.0)).alias("qty"), F.col("q").isNull().alias("filled"))


@query("standard_scaler", "SELECT event_type, round(avg((value - m) / s), 4) AS z FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "events")
    return S.scale(e, S.fit_scaler(e, ["value"])).groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("z"))


@query("covariate_matrix", f"SELECT {K}, list(qty ORDER BY dt)[1:3]::VARCHAR AS head, count(*) AS n_steps FROM daily GROUP BY ALL", "daily")
def _(spark, d):
    out = TD.daily(spark, d).groupBy(*SERIES).agg(F.transform(F.array_sort(F.collect_list(F.struct("dt", "qty"))), lambda x: x["qty"]).alias("v"))
    return out.select(*SERIES, F.concat(F.lit("["), F.array_join(F.transform(F.slice("v", 1, 3), lambda x: x.cast("string")), ", "), F.lit("]")).alias("head"), F.size("v").alias("n_steps"))
