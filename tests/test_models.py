"""Walk-forward refits against refitting, the boosted pipeline on a planted signal, calibration by scopes, fallback and contracts."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.operators import contracts as K
from daybook.operators import evaluation as E
from daybook.operators import models as M
from daybook.operators import relational as R

D = dt.date


def history(n=900, days=30, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.choice([None, float("nan"), *range(8)]) if rng.random() < 0.2 else rng.gauss(0, 5), rng.randrange(5)
        a = None if a is None else float(a)
        x = 0.0 if a is None or a != a else a
        out.append((D(2024, 1, 1) + dt.timedelta(rng.randrange(days)), a, b, None if i % 41 == 0 else 3 * x + (10 if b == 3 else 0) + rng.gauss(0, 1), i))
    return out


@pytest.mark.parametrize("every", [1, 3])
def test_walk_forward_equals_refitting_on_all_rows_before(spark, every):
    rows = history()
    df = spark.createDataFrame(rows, "dt date, a double, b int, y double, n int").repartition(3)
    dates = [D(2024, 1, 1) + dt.timedelta(k) for k in (0, 12, 13, 17, 22, 29)]
    got = {r["n"]: r["prediction"] for r in M.walk_forward(df, dates, ["a", "b"], "y", every=every, bins=8, rounds=6).collect()}
    assert set(got) == {r[4] for r in rows if r[0] in dates}
    later = dates[1:] if every == 1 else dates[3:]
    edges = M.feature_edges(df.where(F.col("dt") < F.lit(dates[0])), ["a", "b"], 8)
    assert edges == [[], []] and all(got[r[4]] is None for r in rows if r[0] == dates[0])
    df2 = df.where(F.col("dt") >= F.lit(D(2024, 1, 5)))
    edges = M.feature_edges(df2.where(F.col("dt") < F.lit(dates[1])), ["a", "b"], 8)
    got = {r["n"]: r["prediction"] for r in M.walk_forward(df2, dates[1:], ["a", "b"], "y", every=every, bins=8, rounds=6).collect()}
    binned = {r["n"]: r["c"] for r in df2.select("n", M.bins_of(["a", "b"], edges).alias("c")).collect()}
    kept = [r for r in rows if r[0] >= D(2024, 1, 5)]
    refits = dates[1:][::every]
    for d in dates[1:]:
        at = max(x for x in refits if x <= d)
        known = [r for r in kept if r[0] < at and r[3] is not None]
        asked = [r for r in kept if r[0] == d]
        cells = np.array([binned[r[4]] for r in known + asked])
        n = np.array([1.0] * len(known) + [0.0] * len(asked))
        want = M.boost(cells, n, np.array([r[3] for r in known] + [0.0] * len(asked)), 6, 3, 0.3)[len(known) :]
        assert np.allclose([got[r[4]] for r in asked], want, atol=1e-9)
    assert later


def test_a_walk_reads_its_rows_a_fixed_number_of_times(spark, tmp_path):
    df = spark.createDataFrame(history(), "dt date, a double, b int, y double, n int")
    df.write.parquet(f"{tmp_path}/rows")
    scans = []
    for k in (3, 12):
        out = M.walk_forward(spark.read.parquet(f"{tmp_path}/rows"), [D(2024, 1, 15) + dt.timedelta(i) for i in range(k)], ["a", "b"], "y", rounds=2)
        scans.append(out._jdf.queryExecution().executedPlan().toString().count("Scan parquet"))
    assert scans[0] == scans[1] <= 4


def test_boosting_finds_a_step_and_stands_nothing():
    bins = np.array([[i, j] for i in range(6) for j in range(4)])
    n = np.ones(len(bins)) * 5
    y = np.where(bins[:, 0] > 2, 10.0, 0.0) + np.where(bins[:, 1] == 1, 4.0, 0.0)
    out = M.boost(bins, n, n * y, rounds=40, depth=3, rate=0.5)
    assert np.abs(out - y).max() < 0.05
    assert np.isnan(M.boost(bins, n * 0, n * 0)).all()


def test_the_pipeline_recovers_a_planted_signal_on_held_out_rows(spark):
    rng = np.random.default_rng(5)
    n = 4000
    x, base, kind = rng.normal(size=n), rng.uniform(20, 40, n), rng.integers(0, 6, n)
    y = base + 8 * (x > 0.3) - 5 * (kind == 4) + rng.normal(size=n)
    y[:40], x[40:80] = np.nan, np.nan
    rows = [(float(v), None if np.isnan(a) else float(a), f"k{k}", None if np.isnan(t) else float(t), 0.0 if i % 97 == 0 else 1.0, i) for i, (v, a, k, t) in enumerate(zip(base, x, kind, y, strict=True))]
    df = spark.createDataFrame(rows, "base double, x double, kind string, y double, w double, i int")
    train, valid, test = df.where("i < 2400 AND kind <> 'k5'"), df.where("i BETWEEN 2400 AND 3199"), df.where("i >= 3200")
    model = M.fit_forecaster(train, valid, ["x"], ["kind"], "y", "base", "w", rounds=80, depth=3, rate=0.3)
    out = model.predict(test.withColumn("__x", F.lit("mine")))
    assert out.columns == [*test.columns, "__x", "prediction"] and out.count() == test.count()
    r = out.agg(E.mae("y", "prediction").alias("m"), E.mae("y", "base").alias("b")).first()
    assert r["m"] < 1.3 < 3 < r["b"] and model.rounds < 80
    assert model.predict(test.withColumn("base", F.lit(-1000.0))).agg(F.max("prediction")).first()[0] == 0.0


# ---------------------------------------------------------------- calibration, fallback, contracts

PRED = "product_id string, family string, actual double, prediction double, prediction_p90 double"


def test_calibration_by_scopes_and_its_order(spark):
    rows = [("BAGUETTE", "bread", 100.0, 102.0, 110.0)] * 80 + [("OWN", "bread", 50.0, 53.0, 60.0)] * 70 + [("RARE", "sandwich", 10.0, 9.0, 12.0)] * 20
    cfg = E.DecisionConfig(products={"OWN": E.CostProfile(1.0, 0.2, 1.0), "FEW": E.CostProfile()})
    df = spark.createDataFrame(rows, PRED).withColumn("segment", cfg.segment("family", "product_id"))
    cal = {(r["scope"], r["key"]): r for r in E.fit_calibration(df, product="product_id", cfg=cfg).collect()}
    assert set(cal) == {("global", "global"), ("family", "bread"), ("product", "OWN")}
    assert cal["global", "global"]["applied"] and cal["family", "bread"]["intercept"] < 0 and cal["family", "bread"]["n_rows"] == 80
    # the product's own entry by hand: all points, the first of the best
    def loss(f):
        e, a = f - 50.0, 50.0
        under = max(-e, 0)
        mild = min(under, a * 0.1)
        bias = e / a
        return (max(e, 0) * 1.0 + mild * 0.2 + (under - mild) * 1.0) / a + max(bias + 0.02, 0) * 2 + max(-0.05 - bias, 0) * 1.5
    grid = [(s, i) for s in E.GRID_SLOPES for i in E.GRID_INTERCEPTS if abs(53 * s + i - 50) <= 3 * 1.05]
    best = min(grid, key=lambda g: loss(53 * g[0] + g[1]))
    own = cal["product", "OWN"]
    assert (own["slope"], own["intercept"]) == best and abs(own["loss"] - loss(53 * best[0] + best[1])) < 1e-12
    out = {r["product_id"]: r for r in E.apply_calibration(df, E.fit_calibration(df, product="product_id", cfg=cfg), product="product_id").collect()}
    assert [out[p]["calibration_scope"] for p in ("OWN", "BAGUETTE", "RARE")] == ["product", "family", "global"]
    b = cal["family", "bread"]
    assert out["BAGUETTE"]["prediction"] == 102 * b["slope"] + b["intercept"] < 102 and out["BAGUETTE"]["prediction_p90"] == 110 * b["slope"] + b["intercept"] and out["BAGUETTE"]["prediction_uncalibrated"] == 102


def test_calibration_leaves_what_is_right(spark):
    df = spark.createDataFrame([("P", "bread", 100.0, 97.0, None)] * 70, PRED).withColumn("segment", F.col("family"))
    cal = E.fit_calibration(df)
    assert not any(r["applied"] for r in cal.where("slope = 1 AND intercept = 0").collect())
    r = E.apply_calibration(df, cal.where("false")).first()
    assert (r["prediction"], r["calibration_scope"], r["calibration_key"], r["calibration_slope"]) == (97.0, "none", "", 1.0)
    assert E.fit_calibration(df.limit(0)).isEmpty()


def test_fallback_by_each_condition(spark):
    rows = [("observed_sales", "Yes", 0, 0.9, 5.0), ("dense_calendar_zero_fill", "1", 0, 0.9, 5.0), ("observed_sales", None, 0, 0.9, 5.0), ("observed_sales", "t", 2, 0.9, 5.0), ("observed_sales", "true", None, 0.74, 5.0), ("observed_sales", "true", 0, None, 5.0), ("observed_sales", "no", 1, 0.1, None), (None, "y", 0, 0.75, 5.0)]
    df = spark.createDataFrame([(*r, 7.5, i) for i, r in enumerate(rows)], "target_source string, usable_for_training_flag string, censor_flag int, label_quality_score double, baseline double, prediction double, i int")
    got = [(r["prediction_raw"], r["prediction_rounded"], r["prediction_policy"][:5]) for r in E.fallback(df).orderBy("i").collect()]
    model, base = (7.5, 8.0, "model"), (5.0, 5.0, "basel")
    assert got == [model, base, base, base, base, base, model, model]
    bare = E.fallback(df.select("prediction", "baseline").limit(1)).first()
    assert bare["prediction_policy"] == "model"


def test_split_violations(spark):
    def of(source, days):
        return [(source, D(2024, m, d), b) for b, m, d in days]

    good = [("train", 1, 1), ("val", 6, 1), ("test", 11, 1), ("test", 12, 31)]
    rows = of("bakery", good) + of("late", [*good[:2], ("test", 9, 30), ("test", 12, 31)]) + of("mixed", [*good, ("train", 6, 1)]) + of("two", good[:2]) + of("syn_a", good) + of("syn_b", good[1:]) + of("who", good)
    df = spark.createDataFrame(rows, "s string, dt date, split_bucket string")
    got = {r["s"]: r["violation"] for r in E.violations_split(df, "s", {"bakery": 3, "late": 3, "mixed": 3, "two": 3}, ["syn_"]).collect()}
    whole = "train_val_test_holdout_contract"
    assert got == {"late": whole, "mixed": whole, "two": whole, "syn_b": "three_splits_contract", "who": "unexpected_source"}


def test_a_scalar_of_several_rows_is_an_error(spark):
    df = spark.range(3)
    assert R.with_scalar(df, spark.range(1).withColumnRenamed("id", "x")).count() == 3
    assert R.with_scalar(df, spark.range(0).withColumnRenamed("id", "x")).count() == 0
    with pytest.raises(Exception, match="several rows"):
        R.with_scalar(df, spark.range(2).withColumnRenamed("id", "x")).collect()


def test_cold_series_get_the_whole_context(spark):
    context = spark.createDataFrame([("a", 1, 5.0)], "k string, d int, v double")
    cold = spark.createDataFrame([(d, d * 1.0) for d in range(200)] + [(7, 7.0)], "d int, v double")
    out = R.add_cold_start(context, spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "k string"), cold, "k")
    assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == {"a": 1, "b": 201, "c": 201}


def test_forecasts_that_know_the_future_go(spark):
    at = dt.datetime
    feed = spark.createDataFrame(
        [("a", D(2024, 5, 2), at(2024, 5, 1, 23, 59), 1.5, 7), ("b", D(2024, 5, 2), at(2024, 5, 2), 2.5, 7), ("c", D(2024, 5, 2), None, 3.5, 7), ("d", None, at(2024, 5, 1), 4.5, 7), (None, D(2024, 5, 2), at(2024, 1, 1), None, 7)],
        "location_id string, dt date, forecast_generated_at timestamp, weather_temperature_mean double, weather_observation_type long",
    )
    out = K.weather_forecasts(feed.withColumn("noise", F.lit(1)))
    assert out.columns == K.FORECAST_SCHEMA.names and [t for _, t in out.dtypes] == [f.dataType.simpleString() for f in K.FORECAST_SCHEMA]
    got = sorted((r["location_id"] or "", r["weather_temperature_mean"], r["weather_observation_type"], r["latitude"]) for r in out.collect())
    assert got == [("", None, "forecast", None), ("a", 1.5, "forecast", None)]
    assert K.weather_forecasts(feed.limit(0)).columns == K.FORECAST_SCHEMA.names and K.weather_forecasts(feed.limit(0)).isEmpty()
