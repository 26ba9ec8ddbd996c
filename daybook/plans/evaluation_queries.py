"""Queries of splits, folds, samples, baselines, metrics, economics, selection and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions import columns as C
from daybook.operators import evaluation as E
from daybook.operators import relational as R
from daybook.operators import selection as FS
from daybook.plans.panel import feature_panel
from daybook.plans.panel_queries import BLEND, FAMILY_SQL, GRAIN, SERIES, G, K, W, article, panel, table
from daybook.plans.registry import query
from daybook.sources import readers as S
from daybook.sources import testdata as TD

RANKS = "r AS (SELECT dataset_source, dt, row_number() OVER (PARTITION BY dataset_source ORDER BY dt) AS r, count(*) OVER (PARTITION BY dataset_source) AS n FROM (SELECT DISTINCT dataset_source, dt FROM daily))"


@query("split_chrono_60_20_20", f"WITH {RANKS} SELECT dataset_source, CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS split_bucket, count(*) AS n_rows FROM daily JOIN r USING (dataset_source, dt) GROUP BY ALL", "daily")
def _(spark, d):
    return E.chrono_split(TD.daily(spark, d), "dataset_source", [("train", 0.6), ("val", 0.8), ("test", 1.0)]).groupBy("dataset_source", "split_bucket").agg(F.count("*").alias("n_rows"))


@query("split_chrono_60_40", f"WITH {RANKS} SELECT dataset_source, CASE WHEN r <= floor(n * 0.6) THEN 'train' ELSE 'val' END AS split_bucket, count(*) AS n_rows FROM daily JOIN r USING (dataset_source, dt) GROUP BY ALL", "daily")
def _(spark, d):
    return E.chrono_split(TD.daily(spark, d), "dataset_source", [("train", 0.6), ("val", 1.0)]).groupBy("dataset_source", "split_bucket").agg(F.count("*").alias("n_rows"))


@query("split_train_only", "SELECT dataset_source, 'train' AS split_bucket, count(*) AS n_rows FROM daily GROUP BY ALL", "daily")
def _(spark, d):
    return E.chrono_split(TD.daily(spark, d), "dataset_source", [("train", 1.0)]).groupBy("dataset_source", "split_bucket").agg(F.count("*").alias("n_rows"))


HOLD = "d AS (SELECT DISTINCT dataset_source, dt FROM daily), m AS (SELECT dataset_source, max(dt) - INTERVAL 3 MONTH AS f FROM d GROUP BY ALL), t AS (SELECT d.*, dt > f AS test FROM d JOIN m USING (dataset_source)), q AS (SELECT *, row_number() OVER (PARTITION BY dataset_source, test ORDER BY dt) AS r, count(*) OVER (PARTITION BY dataset_source, test) AS n FROM t), b AS (SELECT dataset_source, dt, CASE WHEN test THEN 'test' WHEN r <= greatest(1, floor(n * 0.75)) THEN 'train' ELSE 'val' END AS split_bucket FROM q)"


@query("split_holdout_months", f"WITH {HOLD} SELECT dataset_source, split_bucket, count(*) AS n_rows FROM daily JOIN b USING (dataset_source, dt) GROUP BY ALL", "daily")
def _(spark, d):
    return E.holdout_split(TD.daily(spark, d), "dataset_source").groupBy("dataset_source", "split_bucket").agg(F.count("*").alias("n_rows"))


@query("split_test_only", f"WITH {HOLD} SELECT dataset_source, count(*) AS n_rows FROM daily JOIN b USING (dataset_source, dt) WHERE split_bucket = 'test' GROUP BY ALL", "daily")
def _(spark, d):
    return E.holdout_split(TD.daily(spark, d), "dataset_source").where("split_bucket = 'test'").groupBy("dataset_source").agg(F.count("*").alias("n_rows"))


@query("split_row_70_15_15", f"SELECT {G}, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY {K}) AS n FROM daily)", "daily")
def _(spark, d):
    return E.row_split(TD.daily(spark, d), SERIES).select(*GRAIN, "split")


@query("folds_daily", "SELECT CAST(dt AS VARCHAR) AS eval_date, row_number() OVER (ORDER BY dt) AS fold FROM (SELECT DISTINCT dt FROM daily)", "daily")
def _(spark, d):
    return E.daily_folds(TD.daily(spark, d))


def _folds_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"WITH r AS (SELECT {keys}dt, row_number() OVER ({part} ORDER BY dt) AS r, count(*) OVER ({part}) AS u FROM (SELECT DISTINCT {keys}dt FROM daily)), f AS (SELECT *, greatest(1, u // 6) AS v, unnest([1, 2, 3, 4, 5]) AS fold FROM r WHERE u >= 6) SELECT {keys}fold, CAST(max(CASE WHEN r <= v * fold THEN dt END) AS VARCHAR) AS train_end, CAST(min(CASE WHEN r > v * fold AND r <= v * fold + v THEN dt END) AS VARCHAR) AS valid_start, CAST(max(CASE WHEN r > v * fold AND r <= v * fold + v THEN dt END) AS VARCHAR) AS valid_end FROM f GROUP BY {keys}fold"


@query("folds_expanding", _folds_sql(""), "daily")
def _(spark, d):
    return E.expanding_folds(TD.daily(spark, d), 5)


@query("folds_expanding_by_dataset", _folds_sql("dataset_source"), "daily")
def _(spark, d):
    return E.expanding_folds(TD.daily(spark, d), 5, ["dataset_source"])


@query("folds_grouped", f"WITH b AS ({_folds_sql('dataset_source')}) SELECT b.fold, CASE WHEN CAST(dt AS VARCHAR) <= train_end THEN 'train' ELSE 'valid' END AS role, count(*) AS n_rows FROM daily d JOIN b ON d.dataset_source = b.dataset_source WHERE CAST(dt AS VARCHAR) <= train_end OR CAST(dt AS VARCHAR) BETWEEN valid_start AND valid_end GROUP BY ALL", "daily")
def _(spark, d):
    day = TD.daily(spark, d)
    return E.fold_rows(day, E.expanding_folds(day, 5, ["dataset_source"]), ["dataset_source"]).groupBy("fold", "role").agg(F.count("*").alias("n_rows"))


@query("folds_chunked", "WITH r AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS r, count(*) OVER () AS u FROM (SELECT DISTINCT dt FROM daily)) SELECT CAST(dt AS VARCHAR) AS dt, CASE WHEN r < (u % 5) * (u // 5 + 1) THEN r // (u // 5 + 1) ELSE u % 5 + (r - (u % 5) * (u // 5 + 1)) // greatest(u // 5, 1) END AS chunk FROM r", "daily")
def _(spark, d):
    return E.chunked_folds(TD.daily(spark, d), 4)


@query("sample_complete_series", f"WITH k AS (SELECT DISTINCT {K}, md5(location_id || '|' || product_id) AS h FROM daily), q AS (SELECT *, row_number() OVER (PARTITION BY dataset_source ORDER BY h, location_id, product_id) AS r, count(*) OVER (PARTITION BY dataset_source) AS n FROM k) SELECT {K}, count(*) AS n_rows FROM daily JOIN q USING ({K}) WHERE r <= least(n, greatest(1, ceil(n * 0.3))) GROUP BY ALL", "daily")
def _(spark, d):
    return E.sample_series(TD.daily(spark, d), 0.3, ["dataset_source"], ["location_id", "product_id"]).groupBy(*SERIES).agg(F.count("*").alias("n_rows"))


MD = "md5(dataset_source || '|' || location_id || '|' || product_id || '|' || CAST(dt AS VARCHAR))"
TAKEN = f"t AS (SELECT *, row_number() OVER (PARTITION BY dataset_source, location_id ORDER BY {MD}, {K}, dt) AS r, count(*) OVER (PARTITION BY dataset_source, location_id) AS n FROM daily), s AS (SELECT {K}, dt FROM t WHERE r <= floor(n * 0.1))"


@query("sample_stratified_hash", f"WITH {TAKEN} SELECT {G} FROM s", "daily")
def _(spark, d):
    return E.sample_rows(TD.daily(spark, d), 0.1, ["dataset_source", "location_id"], GRAIN).select(*GRAIN)


@query("sample_stratified_topup", f"WITH {TAKEN}, w AS (SELECT dataset_source, greatest(ceil(count(*) * 0.1), 60) - coalesce((SELECT count(*) FROM s WHERE s.dataset_source = daily.dataset_source), 0) AS lack FROM daily GROUP BY dataset_source), u AS (SELECT x.*, row_number() OVER (PARTITION BY x.dataset_source ORDER BY x.location_id, x.product_id, x.dt) AS r FROM daily x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.dataset_source = x.dataset_source AND s.location_id = x.location_id AND s.product_id = x.product_id AND s.dt = x.dt)) SELECT {G} FROM s UNION ALL SELECT u.dataset_source, location_id, product_id, CAST(dt AS VARCHAR) FROM u JOIN w ON u.dataset_source = w.dataset_source WHERE r <= lack", "daily")
def _(spark, d):
    return E.sample_rows_topup(TD.daily(spark, d), 0.1, ["dataset_source", "location_id"], GRAIN, "dataset_source", 60).select(*GRAIN)


@query("sampling_metadata", f"WITH {TAKEN}, o AS (SELECT dataset_source, count(*) AS original_rows, count(DISTINCT location_id) AS original_strata FROM daily GROUP BY ALL), p AS (SELECT dataset_source, count(*) AS sampled_rows, count(DISTINCT location_id) AS sampled_strata FROM s GROUP BY ALL) SELECT o.dataset_source, original_rows, original_strata, coalesce(sampled_rows, 0) AS sampled_rows, coalesce(sampled_strata, 0) AS sampled_strata, round(coalesce(sampled_rows, 0) / original_rows, 6) AS effective_fraction FROM o LEFT JOIN p USING (dataset_source)", "daily")
def _(spark, d):
    day = TD.daily(spark, d)
    return E.sampling_report(day, E.sample_rows(day, 0.1, ["dataset_source", "location_id"], GRAIN), "dataset_source", ["location_id"])


@query("min_history_filter", f"SELECT {K}, count(*) AS n_rows FROM daily GROUP BY ALL HAVING count(*) >= 20", "daily")
def _(spark, d):
    return E.min_history(TD.daily(spark, d), SERIES, 20).groupBy(*SERIES).agg(F.count("*").alias("n_rows"))


# ---- baselines: each sees truth up to the day before


def series(spark, d):
    """Product totals of each day on which anything was sold, as the evaluation series."""
    return TD.daily(spark, d).groupBy("product_id", "dt").agg(F.sum("qty").alias("demand"))


SER = "s AS (SELECT product_id, dt, sum(qty) AS demand FROM daily GROUP BY ALL)"
WP, WD = "PARTITION BY product_id ORDER BY dt", "PARTITION BY product_id, isodow(dt) ORDER BY dt"
LAST = f"lag(demand) OVER ({WP})"
BASELINES = {
    **{f"lag_{k}": f"coalesce(lag(demand, {k}) OVER ({WP}), {LAST})" for k in (1, 7, 14)},
    **{f"rolling_mean_{k}": f"avg(demand) OVER ({WP} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (3, 7, 14)},
    **{f"rolling_median_{k}": f"quantile_cont(demand, 0.5) OVER ({WP} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (7, 14)},
    "expanding_mean": f"avg(demand) OVER ({WP} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "expanding_median": f"quantile_cont(demand, 0.5) OVER ({WP} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "trimmed_mean_7": f"list_avg(list_sort(list(demand) OVER ({WP} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))[CAST(floor(least(row_number() OVER ({WP}) - 1, 7) * 0.2) AS INT) + 1 : CAST(least(row_number() OVER ({WP}) - 1, 7) - floor(least(row_number() OVER ({WP}) - 1, 7) * 0.2) AS INT)])",
    "blend_lag_1_lag_7": f"0.5 * {LAST} + 0.5 * coalesce(lag(demand, 7) OVER ({WP}), {LAST})",
    "same_weekday_mean_4": f"coalesce(avg(demand) OVER ({WD} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), {LAST})",
    "same_weekday_median_4": f"coalesce(quantile_cont(demand, 0.5) OVER ({WD} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), {LAST})",
    "same_weekday_mean_expanding": f"coalesce(avg(demand) OVER ({WD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {LAST})",
}


#: The exponential mean as a fold over the values before.
EWM = f"list_reduce(list(demand) OVER ({WP} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda m, x: m + CAST({{a!r}} AS DOUBLE) * (x - m))"


def _baseline(name: str, sql: str | None):
    body = f"WITH {SER} SELECT product_id, CAST(dt AS VARCHAR) AS dt, round({sql}, 6) AS prediction FROM s" if sql else None

    @query(f"bl_{name}", body, "daily")
    def _(spark, d):
        return E.baseline(series(spark, d), name, ["product_id"]).select("product_id", "dt", F.col(name).alias("prediction"))


for _name, _sql in BASELINES.items():
    _baseline(_name, _sql)
for _k in (3, 7, 14):
    _baseline(f"ewm_span_{_k}", EWM.format(a=2 / (_k + 1)))


@query("bl_same_day_last_year", f"WITH {SER} SELECT a.product_id, CAST(a.dt AS VARCHAR) AS dt, coalesce(b.demand, c.demand, e.demand) AS prediction FROM s a LEFT JOIN s b ON a.product_id = b.product_id AND b.dt = a.dt - 365 LEFT JOIN s c ON a.product_id = c.product_id AND c.dt = a.dt - 364 LEFT JOIN s e ON a.product_id = e.product_id AND e.dt = a.dt - 366", "daily")
def _(spark, d):
    return R.year_ago(series(spark, d), ["product_id"], "demand").select("product_id", "dt", F.col("year_ago_demand").alias("prediction"))


LONG = f"{SER}, w AS (SELECT product_id, dt, demand AS actual, {BASELINES['lag_7']} AS a, {BASELINES['rolling_mean_7']} AS b, {BASELINES['blend_lag_1_lag_7']} AS c FROM s), l AS (SELECT product_id, dt, actual, 'lag_7' AS baseline, a AS prediction FROM w UNION ALL SELECT product_id, dt, actual, 'rolling_mean_7', b FROM w UNION ALL SELECT product_id, dt, actual, 'blend_lag_1_lag_7', c FROM w)"
MSQL = "count(*) AS n_rows, round(avg(abs(prediction - actual)), 6) AS mae, round(sqrt(avg((prediction - actual) * (prediction - actual))), 6) AS rmse, round(avg(prediction - actual), 6) AS bias, round(avg(CASE WHEN abs(actual) + abs(prediction) = 0 THEN 0 ELSE 2 * abs(prediction - actual) / (abs(actual) + abs(prediction)) END), 6) AS smape, round(sum(abs(prediction - actual)) / sum(abs(actual)), 6) AS wape"


def long_(spark, d):
    return E.long_baselines(series(spark, d), ["lag_7", "rolling_mean_7", "blend_lag_1_lag_7"], ["product_id"]).where("prediction IS NOT NULL")


@query("bl_metrics_rank", f"WITH {LONG}, g AS (SELECT product_id, baseline, {MSQL} FROM l WHERE prediction IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY mae, rmse, baseline) AS rank FROM g", "daily")
def _(spark, d):
    m = E.metrics(long_(spark, d), ["product_id", "baseline"])
    m = m.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "bias", "smape", "wape")})
    return m.withColumn("rank", F.row_number().over(R.over(["product_id"], ["mae", "rmse", "baseline"])))


@query("win_rank_baselines", f"WITH {LONG}, g AS (SELECT baseline, {MSQL} FROM l WHERE prediction IS NOT NULL GROUP BY ALL) SELECT baseline, mae, row_number() OVER (ORDER BY mae, rmse, baseline) AS rank FROM g", "daily")
def _(spark, d):
    m = E.metrics(long_(spark, d), ["baseline"]).withColumns({c: F.round(c, 6) for c in ("mae", "rmse")})
    return m.select("baseline", "mae", F.row_number().over(R.Window.orderBy("mae", "rmse", "baseline")).alias("rank"))


@query("bl_score_by_fold", f"WITH {LONG}, f AS (SELECT product_id, baseline, year(dt) * 12 + month(dt) AS fold, sum(abs(prediction - actual)) / sum(abs(actual)) AS wape FROM l WHERE prediction IS NOT NULL GROUP BY ALL), m AS (SELECT product_id, baseline, avg(wape) AS wape FROM f GROUP BY ALL) SELECT baseline, round(avg(wape), 6) AS macro_wape, count(*) AS n_series FROM m GROUP BY ALL", "daily")
def _(spark, d):
    fold = (F.year("dt") * 12 + F.month("dt")).alias("fold")
    f = long_(spark, d).groupBy("product_id", "baseline", fold).agg(E.wape("actual", "prediction").alias("wape"))
    return f.groupBy("product_id", "baseline").agg(F.avg("wape").alias("wape")).groupBy("baseline").agg(F.avg("wape").alias("macro_wape"), F.count("*").alias("n_series"))


# ---- metrics on panel rows with the field baseline as prediction

PRED = f"{BLEND}, p AS (SELECT {K}, dt, target AS actual, coalesce(0.5 * l1 + 0.5 * l7, l1, l7) AS prediction, label_quality_score FROM f WHERE target IS NOT NULL AND l1 IS NOT NULL)"


def predictions(spark, d):
    f = feature_panel(panel(spark, d), SERIES).where("target IS NOT NULL AND target_lag_1 IS NOT NULL")
    return f.select(*GRAIN, F.col("target").alias("actual"), F.col("field_baseline").alias("prediction"), "label_quality_score")


def _metric(name: str, sql: str, f):
    @query(f"m_{name}", f"{PRED} SELECT product_id, round({sql}, 6) AS {name} FROM p GROUP BY ALL", "panel")
    def _(spark, d):
        return predictions(spark, d).groupBy("product_id").agg(f("actual", "prediction").alias(name))


_metric("mae", "avg(abs(prediction - actual))", E.mae)
_metric("rmse", "sqrt(avg((prediction - actual) * (prediction - actual)))", E.rmse)
_metric("bias", "avg(prediction - actual)", E.bias)
_metric("smape", "avg(CASE WHEN abs(actual) + abs(prediction) = 0 THEN 0 ELSE 2 * abs(prediction - actual) / (abs(actual) + abs(prediction)) END)", E.smape)
_metric("wape", "sum(abs(prediction - actual)) / sum(abs(actual))", E.wape)


@query("m_mase", f"WITH {LONG}, h AS (SELECT product_id, avg(abs(x)) AS s FROM (SELECT product_id, demand - lag(demand, 7) OVER ({WP}) AS x FROM s) GROUP BY ALL) SELECT product_id, round(avg(abs(prediction - actual)) / max(s), 6) AS mase FROM l JOIN h USING (product_id) WHERE baseline = 'lag_7' AND prediction IS NOT NULL GROUP BY ALL", "daily")
def _(spark, d):
    return E.mase(long_(spark, d).where("baseline = 'lag_7'"), series(spark, d).withColumnRenamed("demand", "actual"), ["product_id"])


@query("m_coverage", f"{PRED} SELECT product_id, round(avg((actual BETWEEN prediction * 0.5 AND prediction * 1.5)::INT), 6) AS coverage, round(avg(prediction), 6) AS width FROM p GROUP BY ALL", "panel")
def _(spark, d):
    p = predictions(spark, d).withColumns({"lo": F.col("prediction") * 0.5, "hi": F.col("prediction") * 1.5})
    return p.groupBy("product_id").agg(E.coverage("actual", "lo", "hi").alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"))


PIN = "SELECT quantile, round(avg(greatest(q * (actual - v), (q - 1) * (actual - v))), 6) AS pinball, round(avg((actual <= v)::INT) - max(q), 6) AS calibration_error FROM (SELECT actual, 'p10' AS quantile, 0.1 AS q, prediction * 0.5 AS v FROM p UNION ALL SELECT actual, 'p50', 0.5, prediction FROM p UNION ALL SELECT actual, 'p90', 0.9, prediction * 2 FROM p) GROUP BY ALL"


@query("m_pinball", f"{PRED} {PIN}", "panel")
def _(spark, d):
    p = predictions(spark, d).withColumns({"p10": F.col("prediction") * 0.5, "p50": F.col("prediction"), "p90": F.col("prediction") * 2})
    return E.pinball(p, {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("quantile_calibration", f"{PRED} SELECT quantile, calibration_error FROM ({PIN})", "panel")
def _(spark, d):
    p = predictions(spark, d).withColumns({"p10": F.col("prediction") * 0.5, "p50": F.col("prediction"), "p90": F.col("prediction") * 2})
    return E.pinball(p, {"p10": 0.1, "p50": 0.5, "p90": 0.9}).select("quantile", "calibration_error")


@query("m_overall_and_per_product", f"{PRED} SELECT product_id, {MSQL} FROM p GROUP BY ALL UNION ALL SELECT 'all', {MSQL} FROM p", "panel")
def _(spark, d):
    p = predictions(spark, d)
    return E.metrics(p, ["product_id"]).unionByName(E.metrics(p.withColumn("product_id", F.lit("all")), ["product_id"]))


@query("m_segments", f"{PRED} SELECT dataset_source, CASE WHEN label_quality_score >= 0.95 THEN 'high' WHEN label_quality_score >= 0.75 THEN 'medium' ELSE 'low' END AS bucket, {MSQL} FROM p GROUP BY ALL HAVING sum(abs(actual)) > 0", "panel")
def _(spark, d):
    p = predictions(spark, d).withColumn("bucket", C.quality_bucket("label_quality_score"))
    return E.metrics(p, ["dataset_source", "bucket"]).where(F.col("wape") < float("inf"))


@query("residual_stats", f"{PRED} SELECT product_id, round(avg(actual - prediction), 6) AS mean, round(stddev_pop(actual - prediction), 6) AS sd, min(actual - prediction) AS lo, max(actual - prediction) AS hi FROM p GROUP BY ALL", "panel")
def _(spark, d):
    r = F.col("actual") - F.col("prediction")
    return predictions(spark, d).groupBy("product_id").agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("sd"), F.min(r).alias("lo"), F.max(r).alias("hi"))


@query("residual_acf", f"WITH {SER}, c AS (SELECT product_id, dt, demand - avg(demand) OVER (PARTITION BY product_id) AS c FROM s), g AS (SELECT product_id, c, lag(c, 1) OVER ({WP}) AS a, lag(c, 2) OVER ({WP}) AS b FROM c) SELECT product_id, round(sum(c * a) / sum(c * c), 6) AS acf_1, round(sum(c * b) / sum(c * c), 6) AS acf_2 FROM g GROUP BY ALL", "daily")
def _(spark, d):
    return E.residual_acf(series(spark, d), ["product_id"], "demand", 2)


SHAPE_SQL = f"""{PRED}, s AS (SELECT product_id, avg(prediction) AS mean_p, quantile_cont(prediction, 0.5) AS median_p,
 quantile_cont(actual, 0.8) AS hi, quantile_cont(actual, 0.2) AS lo FROM p GROUP BY ALL)
SELECT product_id, count(*) AS n_rows, round(stddev_pop(prediction) / stddev_pop(actual), 6) AS sigma_ratio, round(corr(prediction, actual), 6) AS correlation,
 round(avg(abs(mean_p - actual)) - avg(abs(prediction - actual)), 6) AS gain_vs_mean, round(avg(abs(median_p - actual)) - avg(abs(prediction - actual)), 6) AS gain_vs_median,
 count(*) FILTER (actual >= hi) AS high_rows, round(avg(prediction - actual) FILTER (actual >= hi), 6) AS high_bias, round(avg(abs(prediction - actual)) FILTER (actual >= hi), 6) AS high_mae,
 count(*) FILTER (actual <= lo) AS low_rows, round(avg(prediction - actual) FILTER (actual <= lo), 6) AS low_bias, round(avg(abs(prediction - actual)) FILTER (actual <= lo), 6) AS low_mae
FROM p JOIN s USING (product_id) GROUP BY ALL"""


@query("shape_diagnostics", SHAPE_SQL, "panel")
def _(spark, d):
    return E.shape_diagnostics(predictions(spark, d), "product_id")


@query(
    "shape_summary",
    f"""{PRED}, m AS (SELECT product_id, avg(prediction) AS mean, median(prediction) AS med FROM p GROUP BY ALL),
g AS (SELECT product_id, count(*) AS n, stddev_pop(prediction) / nullif(stddev_pop(actual), 0) AS s, corr(prediction, actual) AS c, avg(abs(mean - actual)) - avg(abs(prediction - actual)) AS gm, avg(abs(med - actual)) - avg(abs(prediction - actual)) AS gd FROM p JOIN m USING (product_id) GROUP BY ALL)
SELECT count(*) AS product_count, sum(n)::BIGINT AS row_count, round(sum(gm * n) / sum(n), 6) AS gain_vs_mean, round(sum(gd * n) / sum(n), 6) AS gain_vs_median, count(*) FILTER (gm < 0) AS constant_mean_beats_model, count(*) FILTER (gd < 0) AS constant_median_beats_model, count(*) FILTER (s < 0.5) AS low_variance_products,
count(s) AS sigma_ratio_count, round(avg(s), 6) AS sigma_ratio_mean, round(median(s), 6) AS sigma_ratio_median, round(min(s), 6) AS sigma_ratio_min, round(max(s), 6) AS sigma_ratio_max, count(c) AS correlation_count, round(avg(c), 6) AS correlation_mean, round(median(c), 6) AS correlation_median, round(min(c), 6) AS correlation_min, round(max(c), 6) AS correlation_max FROM g""",
    "panel",
)
def _(spark, d):
    return E.shape_summary(E.shape_diagnostics(predictions(spark, d), "product_id"))


@query(
    "shape_daily",
    f"""{PRED}, b AS (SELECT dt, actual, prediction, avg(actual) OVER (PARTITION BY dataset_source, location_id, product_id) AS base FROM p),
g AS (SELECT dt, sum(actual) AS a, sum(prediction) AS m, sum(base) AS b, avg(abs(prediction - actual)) AS me, avg(abs(base - actual)) AS be FROM b GROUP BY ALL)
SELECT count(*) AS day_count, round(avg(me), 6) AS daily_model_mae, round(avg(abs(m - a)), 6) AS daily_model_total_error, round(corr(m, a), 6) AS daily_model_correlation, round(avg(be), 6) AS daily_baseline_mae, round(avg(abs(b - a)), 6) AS daily_baseline_total_error, round(corr(b, a), 6) AS daily_baseline_correlation, count(*) FILTER (me < be) AS days_model_better, count(*) FILTER (be < me) AS days_baseline_better, count(*) FILTER (be = me) AS days_equal FROM g""",
    "panel",
)
def _(spark, d):
    p = predictions(spark, d)
    base = p.groupBy(*SERIES).agg(F.avg("actual").alias("base"))
    return E.shape_daily(p.join(base, SERIES), base="base")


@query("ensemble_equal", f"WITH {LONG} SELECT product_id, CAST(dt AS VARCHAR) AS dt, round(avg(prediction), 6) AS prediction FROM l WHERE prediction IS NOT NULL GROUP BY ALL", "daily")
def _(spark, d):
    return long_(spark, d).groupBy("product_id", "dt").agg(F.avg("prediction").alias("prediction"))


@query("m_wape_improvement", f"WITH {LONG}, g AS (SELECT product_id, baseline, sum(abs(prediction - actual)) / sum(abs(actual)) AS w FROM l WHERE prediction IS NOT NULL GROUP BY ALL) SELECT a.product_id, round(100 * (a.w - b.w) / a.w, 6) AS improvement FROM g a JOIN g b ON a.product_id = b.product_id AND a.baseline = 'lag_7' AND b.baseline = 'rolling_mean_7'", "daily")
def _(spark, d):
    g = long_(spark, d).groupBy("product_id").pivot("baseline", ["lag_7", "rolling_mean_7"]).agg(E.wape("actual", "prediction"))
    return g.select("product_id", (100 * (F.col("lag_7") - F.col("rolling_mean_7")) / F.nullif("lag_7", F.lit(0.0))).alias("improvement"))


# ---- economics

SEG = FAMILY_SQL.replace("p_type", "product_id")


def segmented(spark, d):
    return predictions(spark, d).withColumn("segment", C.substitution_family(article("product_id")))


@query("economic_loss_rows", f"{PRED}, u AS (SELECT product_id, sum(revenue) / sum(qty) AS price FROM daily GROUP BY ALL), e AS (SELECT p.product_id, round_even(actual, 0) AS a, round_even(prediction, 0) AS b, price, {SEG.replace('product_id', 'p.product_id')} AS f FROM p JOIN u ON p.product_id = u.product_id) SELECT product_id, sum(greatest(b - a, 0)) AS over_units, sum(greatest(a - b, 0)) AS under_units, round(sum(greatest(b - a, 0) * price * 0.35 + greatest(a - b, 0) * price * 0.65 * (1 - CASE f WHEN 'bread' THEN 0.75 WHEN 'viennoiserie' THEN 0.65 WHEN 'patisserie' THEN 0.45 WHEN 'sandwich' THEN 0.35 WHEN 'beverage' THEN 0.80 ELSE 0.50 END)), 2) AS loss FROM e GROUP BY ALL", "panel")
def _(spark, d):
    price = TD.daily(spark, d).groupBy("product_id").agg((F.sum("revenue") / F.sum("qty")).alias("price"))
    rows = E.economic_loss(segmented(spark, d).withColumnRenamed("segment", "family").join(price, "product_id"), "price")
    return rows.groupBy("product_id").agg(F.sum("over_units").alias("over_units"), F.sum("under_units").alias("under_units"), F.round(F.sum("loss"), 2).alias("loss"))


_cost = lambda attr: "CASE segment " + " ".join(f"WHEN '{k}' THEN {getattr(v, attr)}" for k, v in E.PROFILES.items()) + " END"
SCORE = f"""x AS (SELECT product_id, {SEG} AS segment, actual, prediction, greatest(prediction - actual, 0) AS o, greatest(actual - prediction, 0) AS u FROM p),
y AS (SELECT segment, count(*) AS n_rows, sum(o) AS over_units, sum(least(u, abs(actual) * 0.1)) AS mild_units, sum(u - least(u, abs(actual) * 0.1)) AS severe_units, sum(prediction - actual) AS b, sum(abs(actual)) AS denominator FROM x GROUP BY ALL),
z AS (SELECT *, (over_units * {_cost("over")} + mild_units * {_cost("mild")} + severe_units * {_cost("severe")}) AS economic_loss, greatest(b / denominator + 0.02, 0) * 2.0 + greatest(-0.05 - b / denominator, 0) * 1.5 AS penalty FROM y)"""


@query("decision_score", f"{PRED}, {SCORE} SELECT segment, n_rows, round(economic_loss, 4) AS economic_loss, round(economic_loss / denominator + penalty, 6) AS decision_loss FROM z", "panel")
def _(spark, d):
    return E.decision_score(segmented(spark, d)).select("segment", "n_rows", F.round("economic_loss", 4).alias("economic_loss"), "decision_loss")


@query("decision_score_segmented", f"{PRED}, {SCORE} SELECT round(sum(economic_loss) / sum(denominator) + sum(penalty * denominator) / sum(denominator), 6) AS decision_loss FROM z", "panel")
def _(spark, d):
    return E.segmented_score(E.decision_score(segmented(spark, d))).select("decision_loss")


@query("decision_score_by_group", f"{PRED}, {SCORE.replace('SELECT product_id, ', 'SELECT product_id, dataset_source, ').replace('SELECT segment, count', 'SELECT dataset_source, segment, count')} SELECT dataset_source, segment, round(economic_loss / denominator + penalty, 6) AS decision_loss FROM z", "panel")
def _(spark, d):
    return E.decision_score(segmented(spark, d), ["dataset_source"]).select("dataset_source", "segment", "decision_loss")


@query("decision_score_folds", f"{PRED}, {SCORE.replace('SELECT product_id, ', 'SELECT product_id, year(dt) AS fold, ').replace('SELECT segment, count', 'SELECT fold, segment, count')} SELECT segment, round(avg(economic_loss / denominator + penalty), 6) AS decision_loss FROM z GROUP BY ALL", "panel")
def _(spark, d):
    return E.decision_score(segmented(spark, d).withColumn("fold", F.year("dt")), ["fold"]).groupBy("segment").agg(F.avg("decision_loss").alias("decision_loss"))


#: One product has costs of its own, so all scopes occur.
OWN = E.DecisionConfig(products={"PROMO": E.CostProfile(1.2, 0.6, 1.8, 0.2)})


def own_segments(spark, d):
    return predictions(spark, d).withColumn("family", C.substitution_family(article("product_id"))).withColumn("segment", OWN.segment("family", "product_id"))


def _own_cost(attr):
    return "CASE segment WHEN 'product:PROMO' THEN " + str(getattr(OWN.products["PROMO"], attr)) + " " + " ".join(f"WHEN '{k}' THEN {getattr(v, attr)}" for k, v in E.PROFILES.items()) + " END"


_SLOPES, _SHIFTS = list(E.GRID_SLOPES), list(E.GRID_INTERCEPTS)
FIT = f"""sg AS (SELECT CASE WHEN product_id = 'PROMO' THEN 'product:PROMO' ELSE {SEG} END AS segment, product_id, dt, actual, prediction FROM p),
gr AS (SELECT k, CASE WHEN k < 0 THEN 1.0 ELSE {_SLOPES}[k // 5 + 1] END AS slope, CASE WHEN k < 0 THEN 0.0 ELSE {_SHIFTS}[k % 5 + 1] END AS intercept FROM range(-1, 20) t(k)),
fc AS (SELECT segment, k, slope, intercept, actual, CASE WHEN k < 0 THEN prediction ELSE greatest(prediction * CAST(slope AS DOUBLE) + CAST(intercept AS DOUBLE), 0) END AS f FROM sg CROSS JOIN gr),
su AS (SELECT segment, k, slope, intercept, count(*) AS n, sum(greatest(f - actual, 0)) AS o, sum(least(greatest(actual - f, 0), abs(actual) * {_own_cost("mild_share")})) AS m, sum(greatest(actual - f, 0)) AS u, sum(f - actual) AS b, sum(abs(actual)) AS y, sum(abs(f - actual)) AS e FROM fc GROUP BY ALL),
sc AS (SELECT 'global' AS scope, 'global' AS key, * FROM su UNION ALL SELECT 'family', segment, * FROM su WHERE NOT starts_with(segment, 'product:') UNION ALL SELECT 'product', substr(segment, 9), * FROM su WHERE starts_with(segment, 'product:')),
de AS (SELECT *, o * {_own_cost("over")} + m * {_own_cost("mild")} + (u - m) * {_own_cost("severe")} AS loss, greatest(b / y + 0.02, 0) * 2.0 + greatest(-0.05 - b / y, 0) * 1.5 AS penalty FROM sc),
tr AS (SELECT scope, key, k, slope, intercept, sum(n)::BIGINT AS n_rows, (sum(loss) + sum(penalty * y)) / sum(y) AS loss, sum(e) / sum(y) AS wape FROM de GROUP BY ALL),
rw AS (SELECT *, max(CASE WHEN k < 0 THEN loss END) OVER q AS raw_loss, max(CASE WHEN k < 0 THEN wape END) OVER q AS raw_wape FROM tr WINDOW q AS (PARTITION BY scope, key)),
ca AS (SELECT *, k >= 0 AS applied FROM rw WHERE (scope = 'global' OR n_rows >= 60) AND (k < 0 OR (wape <= raw_wape * 1.05 AND loss < raw_loss)) QUALIFY row_number() OVER (PARTITION BY scope, key ORDER BY loss, k) = 1)"""


@query("economic_calibration_fit", f"{PRED}, {FIT} SELECT scope, key, CAST(slope AS DOUBLE) AS slope, CAST(intercept AS DOUBLE) AS intercept, round(raw_loss, 6) AS raw_loss, round(loss, 6) AS loss, round(raw_wape, 6) AS raw_wape, round(wape, 6) AS wape, applied, n_rows FROM ca", "panel")
def _(spark, d):
    return E.fit_calibration(own_segments(spark, d), product="product_id", cfg=OWN)


@query(
    "economic_calibration_apply",
    f"""{PRED}, {FIT}, us AS (SELECT s.segment, s.prediction AS raw, coalesce(p.scope, f.scope, g.scope, 'none') AS scope, coalesce(p.slope, f.slope, g.slope, 1.0) AS slope, coalesce(p.intercept, f.intercept, g.intercept, 0.0) AS intercept
FROM sg s LEFT JOIN ca p ON p.applied AND p.scope = 'product' AND p.key = s.product_id LEFT JOIN ca f ON f.applied AND f.scope = 'family' AND f.key = s.segment LEFT JOIN ca g ON g.applied AND g.scope = 'global')
SELECT segment, scope AS calibration_scope, count(*) AS n_rows, round(sum(raw), 4) AS raw, round(sum(CASE WHEN scope = 'none' THEN raw ELSE greatest(raw * CAST(slope AS DOUBLE) + CAST(intercept AS DOUBLE), 0) END), 4) AS calibrated FROM us GROUP BY ALL""",
    "panel",
)
def _(spark, d):
    s = own_segments(spark, d)
    out = E.apply_calibration(s, E.fit_calibration(s, product="product_id", cfg=OWN), product="product_id")
    return out.groupBy("segment", "calibration_scope").agg(F.count("*").alias("n_rows"), F.round(F.sum("prediction_uncalibrated"), 4).alias("raw"), F.round(F.sum("prediction"), 4).alias("calibrated"))


LS = "g AS (SELECT dt, count(*) AS n, sum(prediction) AS sx, sum(actual) AS sy, sum(prediction * prediction) AS sxx, sum(prediction * actual) AS sxy FROM p GROUP BY ALL), h AS (SELECT dt, " + ", ".join(f"coalesce(sum({c}) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS {c}" for c in ("n", "sx", "sy", "sxx", "sxy")) + " FROM g), i AS (SELECT *, CASE WHEN n < 30 OR n * sxx - sx * sx <= 1e-9 THEN 1.0 ELSE least(greatest((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 0.5), 1.5) END AS slope FROM h)"


@query("ls_calibration_walkforward", f"{PRED}, {LS} SELECT CAST(dt AS VARCHAR) AS dt, round(slope, 6) AS slope, round(CASE WHEN n < 30 THEN 0 ELSE (sy - slope * sx) / n END, 6) AS intercept, n::BIGINT AS n FROM i", "panel")
def _(spark, d):
    return E.ls_walk_forward(predictions(spark, d))


@query("ls_calibration", f"{PRED} SELECT product_id, round(least(greatest(regr_slope(actual, prediction), 0.5), 1.5), 6) AS slope, round(avg(actual) - least(greatest(regr_slope(actual, prediction), 0.5), 1.5) * avg(prediction), 6) AS intercept FROM p GROUP BY ALL HAVING count(*) >= 30", "panel")
def _(spark, d):
    s = F.least(F.greatest(F.regr_slope("actual", "prediction"), F.lit(0.5)), F.lit(1.5))
    g = predictions(spark, d).groupBy("product_id").agg(s.alias("slope"), (F.avg("actual") - s * F.avg("prediction")).alias("intercept"), F.count("*").alias("n"))
    return g.where("n >= 30").drop("n")


@query(
    "daily_refit_report",
    f"""{PRED}, {LS}, c AS (SELECT dt, slope, CASE WHEN n < 30 THEN 0 ELSE (sy - slope * sx) / n END AS intercept, n FROM i),
r AS (SELECT dt, count(*) AS n_rows, avg(abs(greatest(prediction * slope + intercept, 0) - actual)) AS mae, sqrt(avg((greatest(prediction * slope + intercept, 0) - actual) ** 2)) AS rmse, max(slope) AS slope, max(intercept) AS intercept, max(n)::BIGINT AS n FROM p JOIN c USING (dt) GROUP BY dt)
SELECT CAST(dt AS VARCHAR) AS eval_date, row_number() OVER (ORDER BY dt) AS fold, n_rows, round(mae, 6) AS mae, round(rmse, 6) AS rmse, CAST(coalesce(sum(n_rows) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS history_rows, round(slope, 6) AS calibration_slope, round(intercept, 6) AS calibration_intercept, n AS calibration_rows, 'none' AS economic_scopes, false AS economic_applied FROM r""",
    "panel",
)
def _(spark, d):
    p = predictions(spark, d)
    fits = E.ls_walk_forward(p).select("dt", F.col("slope").alias("ls_slope"), F.col("intercept").alias("ls_intercept"), F.col("n").alias("ls_rows"))
    moved = F.greatest(F.col("prediction") * F.col("ls_slope") + F.col("ls_intercept"), F.lit(0.0))
    return E.refit_report(p.join(fits, "dt").withColumn("prediction", moved))


@query(
    "return_cancellation",
    """WITH r AS (SELECT product_id, dt, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -quantity ELSE quantity END AS q FROM lines),
s AS (SELECT *, sum(q) OVER (PARTITION BY product_id ORDER BY dt, l_orderkey, l_linenumber, q) AS s FROM r),
h AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY product_id ORDER BY dt, l_orderkey, l_linenumber, q)) AS h FROM s),
e AS (SELECT *, min(h) OVER (PARTITION BY product_id ORDER BY dt, l_orderkey, l_linenumber, q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM h),
k AS (SELECT product_id, CASE WHEN e >= h THEN q ELSE e - (h - q) END AS kept FROM e WHERE q > 0)
SELECT product_id, count(*) AS n_lines, sum(kept) AS quantity FROM k WHERE kept > 0 GROUP BY ALL""",
    "lines",
)
def _(spark, d):
    lines = TD.order_lines(spark, d).select("product_id", "dt", "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", -F.col("quantity")).otherwise(F.col("quantity")).alias("quantity"))
    return E.cancel_returns(lines, "product_id", ["dt", "l_orderkey", "l_linenumber", "quantity"], "quantity").groupBy("product_id").agg(F.count("*").alias("n_lines"), F.sum("quantity").alias("quantity"))


@query("stock_position", "SELECT event_id, round(greatest(value - floor(value / 2) - 1, 0), 6) AS stock FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", C.stock_position("value", F.floor(F.col("value") / 2), F.lit(1)).alias("stock"))


#: Flags as feeds bring them: words, numbers and nothing.
FLAGS = {
    "usable_for_training_flag": "CASE WHEN day(dt) % 5 = 0 THEN 'no' WHEN day(dt) % 5 = 1 THEN ' Yes ' WHEN day(dt) % 5 = 2 AND month(dt) = 2 THEN NULL ELSE 'TRUE' END",
    "censor_flag": "CASE WHEN day(dt) = 13 THEN 1 WHEN day(dt) = 14 THEN NULL ELSE 0 END",
    "baseline": "CASE WHEN day(dt) = 20 THEN NULL ELSE actual * 0.5 + 1 END",
}


@query(
    "baseline_fallback_policy",
    f"""{PRED}, fl AS (SELECT p.*, target_source, {", ".join(f"{e} AS {n}" for n, e in FLAGS.items())} FROM p JOIN panel USING (dataset_source, location_id, product_id, dt)),
aw AS (SELECT *, baseline IS NOT NULL AND (target_source IN ('closed_or_missing_observation', 'dense_calendar_zero_fill') OR coalesce(lower(trim(usable_for_training_flag)), '') NOT IN ('1', 'true', 't', 'yes', 'y') OR coalesce(censor_flag, 0) <> 0 OR label_quality_score IS NULL OR label_quality_score < 0.75) AS away FROM fl)
SELECT dataset_source, location_id, product_id, CAST(dt AS VARCHAR) AS dt, round(CASE WHEN away THEN baseline ELSE prediction END, 6) AS prediction_raw, round_even(CASE WHEN away THEN baseline ELSE prediction END, 0) AS prediction_rounded, CASE WHEN away THEN 'baseline_non_trainable_or_low_quality' ELSE 'model' END AS prediction_policy FROM aw""",
    "panel",
)
def _(spark, d):
    p = predictions(spark, d).join(panel(spark, d).select(*GRAIN, "target_source"), GRAIN)
    flagged = p.withColumns({n: F.expr(e) for n, e in FLAGS.items()})
    return E.fallback(flagged).select(*GRAIN, "prediction_raw", "prediction_rounded", "prediction_policy")


# ---- feature selection

FEATS = ["l1", "l7", "m7"]
FSQL = f"{BLEND}, q AS (SELECT target AS y, l1, l7, avg(demand) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7 FROM f)"


def features(spark, d):
    f = feature_panel(panel(spark, d), SERIES)
    return f.select(F.col("target").alias("y"), F.col("target_lag_1").alias("l1"), F.col("target_lag_7").alias("l7"), F.col("demand_mean_7").alias("m7"))


@query("fs_rank_by_target_corr", f"{FSQL} SELECT feature, round(c, 6) AS corr FROM (SELECT 'l1' AS feature, abs(corr(l1, y)) AS c FROM q UNION ALL SELECT 'l7', abs(corr(l7, y)) FROM q UNION ALL SELECT 'm7', abs(corr(m7, y)) FROM q)", "panel")
def _(spark, d):
    return FS.rank_by_corr(features(spark, d), FEATS, "y")


@query("fs_drop_constant", FSQL + " UNION ALL ".join(f" SELECT '{c}' AS feature FROM (SELECT *, 1.0 AS one FROM q) HAVING count(DISTINCT {c}) > 1 OR count({c}) BETWEEN 1 AND count(*) - 1" for c in ("l1", "l7", "m7", "one")), "panel")
def _(spark, d):
    f = features(spark, d).withColumn("one", F.lit(1.0))
    return spark.createDataFrame([(c,) for c in FS.drop_constant(f, [*FEATS, "one"])], "feature string")


#: Candidates of the selection: the features, a constant, two that repeat another one linearly, one that does otherwise.
DERIVED = {"one": "1.0", "twice": "2 * l1", "shifted": "5 - 3 * m7", "shelf": "least(l7, 20)"}
ALL_FEATS = [*FEATS, *DERIVED]
XSQL = f"{FSQL}, x AS (SELECT y, l1, l7, m7, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in DERIVED.items()) + " FROM q)"


def more_features(spark, d):
    return features(spark, d).withColumns({n: F.expr(e).cast("double") for n, e in DERIVED.items()})


def _pairs_sql(cols, tie, name="t"):
    """``t(a, b, v)``: both ways round, the association of each pair of features, by ``tie(a, b)``."""
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, ({tie(a, b)}) AS v" for a in cols for b in cols if a != b) + ")"


def _greedy_sql(cols, limit=0.95, name="kept", ties="t", among="true"):
    """``kept(feature)``: strongest first by the correlation with y, unless ``ties`` has a kept feature with it."""
    own = " UNION ALL ".join(f"SELECT '{c}' AS f, coalesce(round(abs(corr({c}, y)), 12), 0) AS c FROM x" for c in cols)
    return f"""o{name} AS (SELECT f, row_number() OVER (ORDER BY c DESC, f) AS r, (SELECT coalesce(list(b), []) FROM {ties} WHERE a = f AND v > {limit}) AS rivals FROM ({own}) WHERE {among}),
walk{name} AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS taken UNION ALL SELECT o.r, CASE WHEN len(list_intersect(w.taken, o.rivals)) > 0 THEN w.taken ELSE list_append(w.taken, o.f) END FROM walk{name} w JOIN o{name} o ON o.r = w.r + 1),
{name} AS (SELECT unnest(taken) AS feature FROM (SELECT taken FROM walk{name} ORDER BY r DESC LIMIT 1))"""


def _pearson_sql(a, b):
    return f"SELECT coalesce(abs(nullif(corr({a}, {b}), 'nan'::DOUBLE)), 0) FROM x WHERE {a} IS NOT NULL AND {b} IS NOT NULL"


def _ratio_sql(a, b):
    """The correlation ratio of b on bins of a at quantiles."""
    edges = f"SELECT list_distinct(quantile_cont({a}, [{', '.join(f'{i / 20}' for i in range(1, 20))}])) AS e FROM x"
    bins = f"SELECT count(*) AS n, avg({b}) AS m, count(*) * var_pop({b}) AS inside FROM x, ({edges}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY len(list_filter(e, lambda k: {a} > k))"
    between = "sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)"
    return f"SELECT coalesce(sqrt(greatest(0, {between}) / nullif(greatest(0, {between}) + sum(inside), 0)), 0) FROM ({bins}) HAVING count(*) > 1"


def _ratios_sql(cols):
    return f"{_pairs_sql(cols, _ratio_sql, 'eta')}, t AS (SELECT e.a, e.b, greatest(coalesce(e.v, 0), coalesce(f.v, 0)) AS v FROM eta e JOIN eta f ON e.a = f.b AND e.b = f.a)"


def _net_sql(cols, among=None, strength=0.01, mix=0.5, rounds=400):
    """``net(feature, importance)``: coordinate descent on the correlations of the zero-imputed features, those of ``among`` if that is named."""
    t, u = strength * mix, 1 + strength * (1 - mix)
    k = range(len(cols))
    pairs = [(i, j) for i in k for j in k if i < j]
    there = lambda c: f"(SELECT count(*) FROM {among} WHERE feature = '{c}')" if among else "1"
    stats = ", ".join([f"coalesce(nullif(corr(x{i}, x{j}), 'nan'::DOUBLE), 0) AS g{i}_{j}" for i, j in pairs] + [f"coalesce(covar_pop(x{i}, y) / nullif(stddev_pop(x{i}), 0), 0) * {there(c)} AS r{i}, {there(c)} AS k{i}" for i, c in enumerate(cols)])
    inner = "w"
    for i in k:
        rest = f"(r{i}" + "".join(f" - g{min(i, j)}_{max(i, j)} * {'n' if j < i else 'w'}{j}" for j in k if j != i) + ")"
        inner = f"(SELECT *, k{i} * sign({rest}) * greatest(abs({rest}) - {t}, 0) / {u} AS n{i} FROM {inner})"
    names = ", ".join([*(f"g{i}_{j}" for i, j in pairs), *(f"r{i}, k{i}" for i in k)])
    step = f"SELECT it + 1, {', '.join(f'n{i}' for i in k)}, {names} FROM {inner} WHERE it < {rounds}"
    return f"""z AS (SELECT y, {', '.join(f'CAST(coalesce({c}, 0) AS DOUBLE) AS x{i}' for i, c in enumerate(cols))} FROM x WHERE y IS NOT NULL),
s AS (SELECT {stats} FROM z),
w AS (SELECT 0 AS it, {', '.join(f'0::DOUBLE AS w{i}' for i in k)}, {names} FROM s UNION ALL {step}),
net AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, abs(w{i}) AS importance FROM w WHERE it = {rounds} AND k{i} > 0" for i, c in enumerate(cols))})"""


def recursive(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("fs_candidates", "SELECT unnest(['demand_real', 'lag_1_real', 'n_lines_real']) AS feature")
def _(spark, d):
    f = feature_panel(panel(spark, d), SERIES).select("demand", F.col("demand").alias("demand_real"), F.col("target_lag_1").alias("lag_1_real"), F.lit(1).alias("n_lines_real"), F.lit("x").alias("family_real"), F.col("dt").alias("dt_real"), F.col("target_lag_7").alias("lag_7_known"))
    return spark.createDataFrame([(c,) for c in FS.candidates(f)], "feature string")


@query("fs_pearson_redundancy", recursive(f"{XSQL}, {_pairs_sql(ALL_FEATS, _pearson_sql)}, {_greedy_sql(ALL_FEATS)} SELECT feature FROM kept"), "panel")
def _(spark, d):
    return spark.createDataFrame([(c,) for c in FS.drop_correlated(more_features(spark, d), ALL_FEATS, "y")], "feature string")


@query("fs_correlation_ratio_redundancy", recursive(f"{XSQL}, {_ratios_sql(ALL_FEATS)}, {_greedy_sql(ALL_FEATS)} SELECT feature FROM kept"), "panel")
def _(spark, d):
    return spark.createDataFrame([(c,) for c in FS.drop_nonlinear(more_features(spark, d), ALL_FEATS, "y")], "feature string")


@query("fs_elastic_net", recursive(f"{XSQL}, {_net_sql(FEATS)} SELECT feature, round(importance, 6) AS importance, round(importance / sum(importance) OVER (), 6) AS normalized_importance, importance > 1e-9 AS selected FROM net"), "panel")
def _(spark, d):
    return FS.elastic_net(features(spark, d).where("y IS NOT NULL"), FEATS, "y")


# ---- checks


@query("dq_required_not_null", "SELECT 'revenue' AS column_name, sum((revenue IS NULL)::INT)::BIGINT AS null_rows FROM panel HAVING sum((revenue IS NULL)::INT) > 0", "panel")
def _(spark, d):
    return E.violations_not_null(panel(spark, d), ["dataset_source", "revenue"])


@query("dq_unique_combination", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return E.violations_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq_accepted_values", "SELECT event_type, count(*) AS n_rows FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY ALL")
def _(spark, d):
    return E.violations_accepted(table(spark, d, "events"), "event_type", ["click", "view"])


@query("dq_expression", "SELECT event_id FROM events WHERE NOT (value >= 1)")
def _(spark, d):
    return E.violations_expression(table(spark, d, "events"), "value >= 1").select("event_id")


#: Faults planted in the holdout splits: a source without a test split, one whose test begins among its training days, one nobody expects.
FAULTS = "CASE WHEN dataset_source = 'ASIA' AND split_bucket = 'test' THEN 'val' WHEN dataset_source = 'EUROPE' AND dt < DATE '1995-06-01' THEN 'test' ELSE split_bucket END"


@query(
    "dq_split_contract",
    f"""WITH {HOLD}, f AS (SELECT dataset_source, dt, {FAULTS} AS s FROM daily JOIN b USING (dataset_source, dt)),
g AS (SELECT dataset_source, count(DISTINCT s) AS n_splits, count(*) FILTER (s = 'train') AS train_rows, count(*) FILTER (s = 'val') AS val_rows, count(*) FILTER (s = 'test') AS test_rows, max(dt) FILTER (s = 'train') AS a, min(dt) FILTER (s = 'val') AS v, min(dt) FILTER (s = 'test') AS t, max(dt) AS m FROM f GROUP BY ALL),
w AS (SELECT *, n_splits <> 3 OR train_rows = 0 OR val_rows = 0 OR test_rows = 0 AS lacks FROM g)
SELECT violation, dataset_source, n_splits, train_rows, val_rows, test_rows FROM (SELECT CASE WHEN dataset_source IN ('AMERICA', 'EUROPE') THEN CASE WHEN lacks OR coalesce(a >= v OR v >= t OR t <= m - INTERVAL 3 MONTH, false) THEN 'train_val_test_holdout_contract' END WHEN dataset_source LIKE 'A%' THEN CASE WHEN lacks THEN 'three_splits_contract' END ELSE 'unexpected_source' END AS violation, * FROM w) WHERE violation IS NOT NULL""",
    "daily",
)
def _(spark, d):
    s = E.holdout_split(TD.daily(spark, d), "dataset_source").withColumn("split_bucket", F.expr(FAULTS))
    return E.violations_split(s, "dataset_source", {"AMERICA": 3, "EUROPE": 3}, ["A"]).select("violation", "dataset_source", "n_splits", "train_rows", "val_rows", "test_rows")


@query("dq_incident_log", "SELECT event_id, rule_name, severity, md5(CAST(event_id AS VARCHAR) || '|' || rule_name) AS incident_id FROM (SELECT event_id, 'low_value' AS rule_name, 'high' AS severity FROM events WHERE value < 1 UNION ALL SELECT event_id, 'is_error', 'low' FROM events WHERE event_type = 'error')")
def _(spark, d):
    rules = [("low_value", "high", "value < 1", "value"), ("is_error", "low", "event_type = 'error'", "event_type")]
    return E.incidents(table(spark, d, "events"), ["event_id"], rules).select("event_id", "rule_name", "severity", "incident_id")


@query("topk_sample_rows", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events WHERE value < 5) WHERE r <= 5")
def _(spark, d):
    e = table(spark, d, "events").where("value < 5")
    return e.withColumn("r", F.row_number().over(R.over(["event_type"], ["event_id"]))).where("r <= 5").select("event_type", "event_id")


@query("topk_missingness", "SELECT 'revenue' AS column_name, round(avg((revenue IS NULL)::INT), 6) AS null_rate FROM panel UNION ALL SELECT 'demand', round(avg((demand IS NULL)::INT), 6) FROM panel", "panel")
def _(spark, d):
    p = panel(spark, d)
    one = p.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in ("demand", "revenue")])
    return R.top_rows(one.unpivot([], ["demand", "revenue"], "column_name", "null_rate"), [F.desc("null_rate"), F.col("column_name")], 25)


@query("bronze_contract_check", "SELECT 'missing columns: c_fax, c_email' AS failure, count(*) AS n_rows FROM customer")
def _(spark, d):
    raw = table(spark, d, "customer")
    try:
        S.require_columns(raw, ["c_custkey", "c_fax", "c_name", "c_email"])
        failure = None
    except ValueError as e:
        failure = str(e)
    return S.require_columns(raw, ["c_custkey", "c_name"]).agg(F.lit(failure).alias("failure"), F.count("*").alias("n_rows"))


@query("fit_boosted_forecaster")
def _(spark, d):
    """Held-out rows, errors of the model and of its baseline, and the rounds that early stopping kept."""
    from daybook.operators.models import fit_forecaster

    f = feature_panel(panel(spark, d), SERIES).where("target IS NOT NULL AND field_baseline IS NOT NULL")
    f = f.select(*SERIES, F.col("dt"), "target", "field_baseline", "target_lag_1", "target_lag_7", "demand_mean_7", "demand_mean_28", F.weekday("target_dt").alias("weekday"), F.coalesce("next_quality", F.lit(0.0)).alias("weight"))
    parts = E.chrono_split(f, "dataset_source", [("train", 0.6), ("val", 0.8), ("test", 1.0)])
    of = lambda name: parts.where(F.col("split_bucket") == name)
    model = fit_forecaster(of("train").where("weight > 0"), of("val"), ["target_lag_1", "target_lag_7", "demand_mean_7", "demand_mean_28"], ["product_id", "weekday"], "target", "field_baseline", "weight", rounds=12, depth=4)
    out = model.predict(of("test"))
    return out.agg(F.count("*").alias("n_rows"), E.mae("target", "prediction").alias("mae"), E.mae("target", "field_baseline").alias("baseline_mae"), F.lit(model.rounds).alias("rounds"))
