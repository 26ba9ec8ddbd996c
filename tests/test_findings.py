"""What queries return on tables that differ from the smallest ones: nothing missing, constants, ties."""

import datetime as dt

from pyspark.sql import functions as F

from daybook.operators import evaluation as E
from daybook.operators import selection as FS
from daybook.operators.contracts import model_features


def test_leaks_report_zero_rows_without_a_label(spark):
    df = spark.createDataFrame([(1.0, 1.0, True), (2.0, 2.0, True)], "y double, oracle_y double, usable_for_training_flag boolean")
    assert sorted(map(tuple, E.leaks(df, ("oracle_",), "y").collect())) == [("oracle_y", 2), ("usable_but_unlabelled", 0)]
    assert sorted(map(tuple, E.leaks(df.where("y > 2"), ("oracle_",), "y").collect())) == [("oracle_y", 0), ("usable_but_unlabelled", 0)]


def test_constant_flags_stay_model_features_and_zeros_go(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1.0, True, False, 0.0, " 0", "FR", None, day), (2.0, True, False, 0.0, "0.0", "FR", 0.0, day)]
    df = spark.createDataFrame(rows, "y double, seen boolean, never boolean, nil double, nought string, country string, part double, day date")
    got = model_features(df, dict.fromkeys(df.columns, "unknown_real"), zero_only=True)
    assert got == {"features": ["y", "seen", "country", "part", "day"], "constant": ["never", "nil", "nought"], "identifiers": []}
    assert model_features(df.where("y > 2"), {"nil": "unknown_real"}, zero_only=True)["features"] == ["nil"]


def test_equal_lines_are_peers_when_returns_cancel(spark):
    df = spark.createDataFrame([("p", 1, 5.0), ("p", 1, 5.0), ("p", 2, -3.0), ("p", 3, -1.0), ("p", 3, 4.0), ("p", 4, 1.0)], "p string, n int, q double")
    want = [(1, 1.0), (1, 1.0), (3, 4.0), (4, 1.0)]
    for order in (["n"], ["n", "q"]):
        assert sorted((r["n"], r["q"]) for r in E.cancel_returns(df, "p", order, "q").collect()) == want


def test_day_totals_that_differ_by_rounding_only_have_no_correlation(spark):
    rows = [(1, x, float(k)) for k, x in enumerate((0.1, 0.2, 0.3))] + [(2, x, float(k * k)) for k, x in enumerate((0.3, 0.2, 0.1))]
    df = spark.createDataFrame(rows, "dt int, base double, actual double").withColumn("prediction", F.col("actual") + 1).coalesce(1)
    got = E.shape_daily(df, base="base").first()
    assert got["daily_baseline_correlation"] is None and abs(got["daily_model_correlation"] - 1) < 1e-9


def test_features_are_worked_out_once_whatever_the_passes(spark):
    n, seen = 2000, spark.sparkContext.accumulator(0)

    def work(x):
        seen.add(1)
        return float(x % 7)

    df = spark.range(n).select(F.udf(work, "double")("id").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 35).cast("double").alias("y"))
    for run in (FS.drop_nonlinear, FS.drop_correlated, lambda *x: FS.elastic_net(*x).collect(), lambda *x: FS.select_features(*x).collect()):
        seen.value = 0
        assert run(df, ["a", "b"], "y")
        assert seen.value <= n


def test_fs_pipeline_equals_its_sql_where_a_candidate_is_constant(spark, tmp_path):
    import duckdb

    from daybook.plans import source_queries  # noqa: F401
    from daybook.plans.registry import ORACLES, QUERIES

    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(k)
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, 0)], "n_nationkey int, n_regionkey int"),
        "supplier": ([(1, 0)], "s_suppkey long, s_nationkey int"),
        "part": ([(1, "SMALL"), (2, "LARGE")], "p_partkey long, p_type string"),
        "lineitem": ([(k, 1 + k % 2, 1, 1, 30.0 + k * k % 41, 9.0, 0.1, "N", day(k // 2)) for k in range(160)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    mine = {r["feature"]: r["importance"] for r in QUERIES["fs_pipeline"](spark, str(tmp_path)).collect()}
    theirs = dict(con.sql(f"SELECT feature, importance FROM ({ORACLES['fs_pipeline']})").fetchall())
    assert set(mine) == set(theirs) and mine["shelf"] == theirs["shelf"] == 0.0
    assert all(abs(mine[c] - theirs[c]) < 1e-5 for c in mine)
