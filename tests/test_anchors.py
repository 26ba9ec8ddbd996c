"""Numeric anchors of single operators on small frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daybook.functions import columns as C
from daybook.operators import evaluation as E
from daybook.operators import relational as R
from daybook.operators import selection as FS
from daybook.sources import payloads as P
from daybook.sources import readers as S

D = dt.date


def one(df):
    return [tuple(r) for r in df.collect()]


def test_money(spark):
    df = spark.createDataFrame([("1,20 €",), ("",), (None,), ("-3.5",)], "x string")
    assert one(df.select(C.parse_money("x"))) == [(1.2,), (None,), (None,), (-3.5,)]
    assert one(df.select(C.parse_money("x", lenient=True)))[1] == (0.0,)


def test_order_lines_to_daily(spark):
    raw = spark.createDataFrame([("1", "0,90 €", "2024-01-02", "08:15", " baguette"), ("2", "0,90 €", "2024-01-02", "09:00:10", "BAGUETTE ")], "quantity_raw string, unit_price_raw string, date_raw string, time_raw string, article_raw string")
    got = S.lines_to_daily(S.enrich_lines(S.normalize_lines(raw), "bakery_42")).first()
    assert (got["series_id"], got["observed_demand_qty"], round(got["observed_revenue_net"], 6)) == ("bakery_42__BAGUETTE", 3.0, 2.7)


def test_first_party_label_facts(spark):
    df = spark.createDataFrame([("2024-01-02", "s", "p", 3, True), ("2024-01-03", "s", "p", 3, False), ("2024-01-04", "s", "p", 3, None), ("x", "s", "p", 3, None)], "dt string, location_id string, product_id string, observed_demand_qty int, observed_stockout_flag boolean")
    assert [r["label_quality_score"] for r in S.standardize_first_party(df).orderBy("dt").collect()] == [0.5, 1.0, 0.75]


def test_families(spark):
    df = spark.createDataFrame([("FORMULE SANDWICH",), ("PAIN AU CHOCOLAT",), ("PAIN BANETTE",), ("x",)], "n string")
    assert [r[0] for r in df.select(C.substitution_family("n")).collect()] == ["sandwich", "viennoiserie", "bread", "default"]


def test_eligibility(spark):
    rows = [(1, True, False, 1.0, "observed_sales", "observed_sales"), (2, False, False, 1.0, "observed_sales", "observed_sales"), (3, True, True, 1.0, "observed_sales", "observed_sales"), (4, True, False, 0.5, "observed_sales", "observed_sales"), (5, True, False, 1.0, "observed_sales", "closed_or_missing_observation"), (6, True, True, 0.9, "latent_demand_estimated", "observed_sales")]
    df = spark.createDataFrame(rows, "row_id int, usable_for_training_flag boolean, censor_flag boolean, label_quality_score double, target_semantics string, target_source string")
    assert [r["row_id"] for r in df.where(C.eligible(df.columns)).orderBy("row_id").collect()] == [1, 6]


def test_under_production_loss(spark):
    df = spark.createDataFrame([(10.0, 8.0, 1.0, "default"), (10.0, 9.0, 1.0, "default")], "actual double, prediction double, price double, family string")
    assert [round(r["loss"], 6) for r in E.economic_loss(df, "price").collect()] == [0.65, 0.325]


def test_all_zero_actuals(spark):
    df = spark.createDataFrame([(0.0, 2.0, "default"), (0.0, 0.0, "default"), (0.0, 1.0, "default")], "actual double, prediction double, segment string")
    assert E.decision_score(df).first()["normalized_bias"] == 1.0


def test_surplus_costs_more_than_a_mild_shortage(spark):
    df = spark.createDataFrame([("hi", 100.0, 110.0, "bread"), ("lo", 100.0, 90.0, "bread")], "k string, actual double, prediction double, segment string")
    got = {r["k"]: r["decision_loss"] for r in E.decision_score(df, ["k"]).collect()}
    assert got["hi"] > got["lo"]


def test_calibration_takes_a_surplus_back(spark):
    df = spark.createDataFrame([(100.0, 102.0, "bread")] * 80, "actual double, prediction double, segment string")
    cal = E.fit_calibration(df).first()
    assert cal["applied"] and cal["loss"] < cal["raw_loss"] and cal["intercept"] < 0
    out = E.apply_calibration(df, E.fit_calibration(df)).first()
    assert out["prediction"] < out["prediction_uncalibrated"] == 102.0


def test_folds(spark):
    days = spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(i),) for i in range(18)], "dt date")
    got = E.fold_rows(days, E.expanding_folds(days, 5)).groupBy("fold", "role").count().collect()
    counts = {(r["fold"], r["role"]): r["count"] for r in got}
    assert counts[1, "train"] == counts[1, "valid"] == 3 and counts[5, "train"] == 15 and counts[5, "valid"] == 3
    assert E.expanding_folds(days.limit(4), 5).count() == 0


def test_whole_series_sample(spark):
    rows = [("d", "s", f"p{p}", D(2024, 1, 1 + i)) for p in range(4) for i in range(3)]
    got = E.sample_series(spark.createDataFrame(rows, "dataset_source string, location_id string, product_id string, dt date"), 0.5, ["dataset_source", "location_id"], ["product_id"])
    assert got.count() == 6 and got.select("product_id").distinct().count() == 2


def test_asof_out_of_order_publication(spark):
    spine = spark.createDataFrame([("FR", D(2024, 1, d)) for d in (1, 5, 20)], "c string, dt date")
    events = spark.createDataFrame([("FR", D(2024, 1, 4), D(2024, 1, 4), 1, 2.0), ("FR", D(2024, 1, 2), D(2024, 1, 15), 1, 1.0), ("FR", D(2024, 1, 4), D(2024, 1, 4), 2, 9.0)], "c string, effective_from date, available_from date, source_priority int, value double")
    assert [r["value"] for r in R.asof_join(spine, events, ["c"]).orderBy("dt").collect()] == [None, 2.0, 2.0]


def test_limited_fill(spark):
    df = spark.createDataFrame([("a", D(2024, 1, i + 1), v) for i, v in enumerate([1.0, None, None, None, 5.0])], "k string, dt date, v double")
    assert [r["v"] for r in R.ffill_limited(df, ["k"], ["v"]).orderBy("dt").collect()] == [1.0, 1.0, 1.0, None, 5.0]


def test_returns_cancel_the_latest_lines(spark):
    df = spark.createDataFrame([("p", 1, 3.0), ("p", 2, 2.0), ("p", 3, -4.0), ("p", 4, 1.0), ("p", 5, -9.0), ("p", 6, 2.0)], "p string, n int, q double")
    assert one(E.cancel_returns(df, "p", ["n"], "q").orderBy("n").select("n", "q")) == [(6, 2.0)]


def test_returns_cancel_across_blocks_of_a_product(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", None]), n, float(r.choice([-3, -2, 1, 2, 3, 3]) if n % 900 > 300 else r.choice([-2, 1, 1])), "x") for n in range(3000)] + [("b", 1, -5.0, "x"), ("b", 2, None, "x"), ("b", 3, 2.0, "x")]
    want = []
    for p in ("a", "b", None):
        stack = []
        for _, n, q, _ in (x for x in rows if x[0] == p and x[2]):
            if q > 0:
                stack.append([n, q])
            while q < 0 and stack:
                use = min(-q, stack[-1][1])
                q, stack[-1][1] = q + use, stack[-1][1] - use
                if not stack[-1][1]:
                    stack.pop()
        want += [(p, n, q, "x") for n, q in stack]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "p string, n int, q double, note string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = E.cancel_returns(df, "p", ["n"], "q")
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and len(want) > 20
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["ewm_span_3", "expanding_median", "trimmed_mean_7", "rolling_median_7", "same_weekday_mean_4"])
def test_baselines_equal_a_loop(spark, name):
    import numpy as np
    import pandas as pd

    y = [float((i * 7) % 11) for i in range(40)]
    days = [D(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    df = spark.createDataFrame([("a", d, v) for d, v in zip(days, y, strict=True)], "k string, dt date, demand double")
    got = [r[name] for r in E.baseline(df, name, ["k"]).orderBy("dt").collect()]
    for i in range(1, 40):
        h = y[:i]
        same = [v for d, v in zip(days[:i], h, strict=True) if d.weekday() == days[i].weekday()][-4:]
        t = sorted(h[-7:])
        cut = int(len(t) * 0.2)
        want = {"ewm_span_3": pd.Series(h).ewm(span=3, adjust=False).mean().iloc[-1], "expanding_median": np.median(h), "trimmed_mean_7": np.mean(t[cut : len(t) - cut]), "rolling_median_7": np.median(h[-7:]), "same_weekday_mean_4": np.mean(same) if same else h[-1]}[name]
        assert abs(got[i] - want) < 1e-9


def test_payloads(spark):
    w = spark.createDataFrame([("l", '{"daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_mean": [1.0, 2.5]}}')], "location_id string, payload string")
    assert [(r["dt"], r["temperature_2m_mean"]) for r in P.parse_weather(w).collect()] == [(D(2024, 1, 1), 1.0), (D(2024, 1, 2), 2.5)]
    ics = spark.createDataFrame([("BEGIN:VEVENT\nDTSTART;VALUE=DATE:20240101\nDTEND;VALUE=DATE:20240103\nSUMMARY:break\nEND:VEVENT",)], "value string")
    assert [r["dt"] for r in P.parse_ics(ics).orderBy("dt").collect()] == [D(2024, 1, 1), D(2024, 1, 2)]
    xml = spark.createDataFrame([('<Series><Obs TIME_PERIOD="2024-02" OBS_VALUE="3.5"/><Obs TIME_PERIOD="2024-03" OBS_VALUE="4"/></Series>',)], "payload string")
    assert one(P.parse_sdmx(xml, "M")) == [("2024-02", 3.5, D(2024, 3, 1)), ("2024-03", 4.0, D(2024, 4, 1))]
    ind = spark.createDataFrame([('[{"countryiso3code": "FRA", "date": "2022", "value": 2.0}, {"countryiso3code": "FRA", "date": "2023", "value": null}]',)], "payload string")
    assert one(P.parse_indicator(ind).select("year", "effective_from")) == [(2022, D(2023, 1, 1))]


def test_holiday_rules(spark):
    got = {(r["country_code"], r["dt"]) for r in P.holiday_calendar(spark.createDataFrame([("FR", 2024), ("GB", 2022), ("XX", 2024)], "country_code string, year int")).collect()}
    assert ("FR", D(2024, 4, 1)) in got and ("FR", D(2024, 5, 9)) in got and ("GB", D(2022, 1, 3)) in got and ("GB", D(2022, 12, 27)) in got and ("GB", D(2022, 8, 29)) in got
    years = P.country_years(spark.createDataFrame([("FR", D(2023, 12, 1), D(2023, 12, 31))], "country_code string, min_dt date, max_dt date"))
    assert sorted(r["year"] for r in years.collect()) == [2023, 2024]


def test_contracts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    with pytest.raises(ValueError, match="z"):
        S.require_columns(df, ["x", "z"])
    with pytest.raises(FileNotFoundError):
        S.validate_sources(spark, [S.SourceSpec("none", f"{tmp_path}/none.csv")])
    with pytest.raises(ValueError, match="repeat"):
        R.align_one_to_one(df, df.union(df), ["x"])
    from pyspark.sql import types as T

    counts = S.load_table(spark, {"a": df, "b": df}, T.StructType([T.StructField("x", T.IntegerType())]), f"{tmp_path}/t")
    assert sorted(one(counts)) == [("a", 1), ("b", 1)]


def test_redundant_features_go(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x, float(x * x), float(x) + 0.1 * (x % 3)) for x in range(-10, 11)], "a double, b double, c double, y double")
    assert FS.drop_correlated(df, ["a", "b", "c"], "y") == ["a", "c"]
    assert FS.drop_nonlinear(df, ["a", "c"], "y") == ["a"]
    assert FS.drop_constant(df.withColumn("k", F.lit(1.0)), ["a", "k"]) == ["a"]


def test_streamed_rollup_equals_batch(spark, tmp_path):
    from daybook.streaming.rollup import rollup_stream

    rows = [(dt.datetime(2024, 1, 1, 0, m), "e", 1.0) for m in (1, 2, 16, 40)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.write.parquet(f"{tmp_path}/in")
    q = rollup_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["event_type"], ["value"]).writeStream.format("memory").queryName("rolled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = one(spark.table("rolled").select("bucket", "value").orderBy("bucket"))
    want = one(R.roll_up(df, "quarter_hour", ["event_type"], "ts", ["value"]).select("bucket", "value").orderBy("bucket"))
    assert got == want


def test_ranks_of_a_whole_table_split_equal_values(spark):
    from daybook.operators.universe import global_rank

    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 5.0D ELSE CAST(id % 700 AS DOUBLE) END AS v", "id").unionByName(spark.createDataFrame([(None, -1)], "v double, id long"))
    rows = sorted((r["rank"], r["v"], r["n_ranked"]) for r in global_rank(df, "v", edges=10, salts=4).collect())
    assert [r[0] for r in rows] == list(range(1, 3001)) and {r[2] for r in rows} == {3000}
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)
    assert global_rank(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


def test_normal_quantiles(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    from daybook.operators.universe import normal_quantile

    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.98, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()
    assert all(abs(r[0] - NormalDist().inv_cdf(p)) < 1e-7 for r, p in zip(got, ps, strict=True))


def test_contract_blocks_what_the_day_itself_tells(spark):
    from daybook.operators.contracts import feature_contract, model_features, projection_columns

    cols = spark.createDataFrame([("weather_temperature_lag_1_unknown_real", "unknown_real"), ("current_sales_known_real", "known_real"), ("fr_cpi", "unknown_real"), ("rolling_mean_7", "unknown_real")], "feature string, role string")
    got = {r["feature"]: r for r in feature_contract(cols, "pre_close_d_plus_1").collect()}
    assert got["weather_temperature_lag_1_unknown_real"]["blocked"] is None
    assert got["current_sales_known_real"]["leakage_risk_level"] == "medium" and got["current_sales_known_real"]["blocked"] == "decision_day_observed"
    assert got["fr_cpi"]["max_publication_lag_hours"] == 744 and got["rolling_mean_7"]["blocked"] == "decision_day_history"
    assert {r["blocked"] for r in feature_contract(cols).collect()} == {None}
    df = spark.createDataFrame([("a", 1.0, 2.0, True, "x")], "k string, one double, two double, flag boolean, note string")
    assert projection_columns(df, ["k"]) == ["k", "one", "two", "flag"]
    df = df.unionByName(spark.createDataFrame([("b", 1.0, 3.0, True, "y")], df.schema))
    assert model_features(df, dict.fromkeys(df.columns, "unknown_real"), excluded=["note"], identifiers=["k"]) == {"features": ["two"], "constant": ["one", "flag"], "identifiers": ["k"]}
