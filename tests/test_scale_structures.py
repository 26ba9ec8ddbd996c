"""Order statistics and exponential means of long series, first rows of hot strata, and sums of all pairs of features, against plain code."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.operators import histories as H
from daybook.operators import relational as R
from daybook.operators import selection as FS
from daybook.operators import strata as S


def series(seed, lengths, nulls=0.1, ties=6):
    rng = random.Random(seed)
    return [(None if s == 1 else f"s{s}", d, None if rng.random() < nulls else float(rng.randrange(ties)) - 2 if s % 2 else rng.gauss(0, 50), "extra") for s, n in enumerate(lengths) for d in range(n)]


@pytest.mark.parametrize("q", [0.5, 0.0, 0.37, 1.0])
def test_expanding_quantiles_equal_a_loop(spark, q):
    rows = series(3, [1, 40, 300, 17, 2], nulls=0.2) + [("empty", d, None, "extra") for d in range(4)]
    df = spark.createDataFrame(rows, "__key_0 string, d int, y double, out string").repartition(3)
    got = {(r["__key_0"], r["d"]): r["m"] for r in H.expanding_quantile(df, ["__key_0"], "d", "y", "m", q).collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        seen = []
        for _, d, y, _ in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            want = float(np.quantile(seen, q)) if seen else None
            assert got[k, d] == want or abs(got[k, d] - want) < 1e-9
            seen += [] if y is None else [y]


def test_an_expanding_median_of_a_long_series_takes_few_windows(spark):
    n = 100_000
    df = spark.range(n).selectExpr("'s' AS k", "id AS d", "CAST(pmod(hash(id), 1000) AS DOUBLE) AS y")
    began = time.time()
    got = H.expanding_quantile(df, ["k"], "d", "y", "m").where("d IN (1, 2, 50000, 99999)").select("d", "m").collect()
    assert time.time() - began < 180
    y = [r["y"] for r in df.orderBy("d").collect()]
    assert {r["d"]: r["m"] for r in got} == {d: float(np.median(y[:d])) for d in (1, 2, 50_000, 99_999)}


@pytest.mark.parametrize("span", [1, 2, 3, 14, 365])
def test_exponential_means_equal_a_loop_and_need_no_python(spark, span):
    rows = series(4, [1, 700, 2500, 90], nulls=0.15)
    df = spark.createDataFrame(rows, "k string, d int, y double, __b string").repartition(3).drop("__b")
    out = H.exponential_mean(df, ["k"], "d", "y", "m", span)
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()
    got = {(r["k"], r["d"]): r["m"] for r in out.collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        m = None
        for _, d, y, _ in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            assert (got[k, d] is None) == (m is None) and (m is None or math.isclose(got[k, d], m, rel_tol=1e-9, abs_tol=1e-9))
            m = m if y is None else y if m is None else m + 2 / (span + 1) * (y - m)


def test_first_rows_of_hot_strata(spark):
    rng = random.Random(5)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 20}", rng.randrange(40), i) for i in range(3000)] + [("hot", 7, 7)] * 50
    df = spark.createDataFrame(rows, "g string, o int, __n int").repartition(5)
    for f in (0.0, 0.1, 0.5, 1.0):
        got = [tuple(r) for r in R.head_fraction(df, ["g"], ["o", "__n"], f).collect()]
        want = []
        for g in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])
            want += mine[: math.floor(len(mine) * f)]
        key = lambda r: (r[0] or "", r[1:])
        assert sorted(got, key=key) == sorted(want, key=key)
    quota = spark.createDataFrame([("hot", 5), (None, 10_000), ("absent", 3)], "g string, __k long")
    got = [tuple(r) for r in S.first_rows(df, ["g"], ["o", "__n"], quota).collect()]
    assert sorted(r for r in got if r[0] == "hot") == sorted(r for r in rows if r[0] == "hot")[:5] and sum(r[0] is None for r in got) == sum(r[0] is None for r in rows) and len(got) == 5 + sum(r[0] is None for r in rows)
    assert S.first_rows(df, [], ["o", "__n"], lambda n: F.lit(4)).count() == 4
    assert R.head_fraction(df.limit(0), ["g"], ["o"], 0.5).isEmpty()


def test_no_part_holds_more_than_a_few_per_cent_of_one_stratum(spark):
    df = spark.range(20_000).selectExpr("'one' AS g", "pmod(hash(id), 50) AS o", "id")
    n = S.pin(df.withColumn("__id", F.monotonically_increasing_id()).repartitionByRange(S.PARTS, "g", "o", "__id")).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert n < 20_000 * 0.05


# ---------------------------------------------------------------- features


def matrix(seed, n=4000):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 50, 0.01, 3] + [0, 1e6, 0, -5]
    cols = {"a": x[:, 0], "b": x[:, 1], "c": x[:, 0] * 2 + rng.normal(size=n) * 0.01, "d": np.abs(x[:, 3] + 5), "e": x[:, 3], "f": np.full(n, 7.0), "y": x[:, 0] + 0.02 * x[:, 1] + x[:, 3] + rng.normal(size=n)}
    for i, k in enumerate("abe"):
        cols[k] = np.where(rng.random(n) < 0.05 * i, np.nan, cols[k])
    return cols


def frame(spark, cols):
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in zip(*cols.values(), strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{k} double" for k in cols)).repartition(5)


def test_correlations_of_all_pairs_equal_numpy(spark):
    cols = matrix(1)
    got = FS.correlations(frame(spark, cols), list(cols))
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            there = ~np.isnan(cols[a]) & ~np.isnan(cols[b])
            want = 0.0 if "f" in (a, b) else abs(np.corrcoef(cols[a][there], cols[b][there])[0, 1])
            assert abs(got[i, j] - want) < 1e-9
    assert FS.drop_correlated(frame(spark, cols), ["a", "b", "c", "d", "e", "f"], "y")[:3] == ["e", "a" if got[0, 6] > got[2, 6] else "c", "b"]


def test_correlation_ratios_of_all_pairs_equal_a_loop(spark):
    cols = matrix(2)
    names = list(cols)
    df = frame(spark, cols)
    edges, got = FS.bin_edges(df, names), FS.correlation_ratios(df, names)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            there = ~np.isnan(cols[a]) & ~np.isnan(cols[b])
            bins, v = np.searchsorted(edges[i], cols[a][there], "left"), cols[b][there]
            total = ((v - v.mean()) ** 2).sum()
            groups = [v[bins == k] for k in np.unique(bins)]
            want = 0.0 if len(groups) < 2 or b == "f" else math.sqrt(sum(len(g) * (g.mean() - v.mean()) ** 2 for g in groups) / total)
            assert abs(got[i, j] - want) < 1e-7, (a, b)
    assert len(edges[0]) == 19 and got[names.index("e"), names.index("d")] > 0.95 > got[names.index("d"), names.index("e")]
    assert "d" not in FS.drop_nonlinear(df, ["d", "e", "b"], "y")


def test_jobs_do_not_grow_with_the_features(spark):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("features"))
    counts = []
    for p in (3, 12):
        df = spark.range(500).select(*[F.rand(i).alias(f"x{i}") for i in range(p)])
        before = jobs()
        spark.sparkContext.setJobGroup("features", "count jobs")
        FS.correlation_ratios(df, df.columns)
        counts.append(jobs() - before)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]


def test_elastic_net_satisfies_its_optimum_conditions_for_many_features(spark):
    rng = np.random.default_rng(3)
    n, p, strength, mix = 3000, 120, 0.05, 0.5
    x = rng.normal(size=(n, p)) * rng.uniform(0.1, 20, p) + rng.normal(size=p) * 30
    x[:, 1] = x[:, 0] + rng.normal(size=n) * 0.1
    y = x[:, :6] @ [1, 0, -2, 0.5, 0.1, 3] + rng.normal(size=n)
    cols = [f"x{i}" for i in range(p)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], ", ".join(f"{c} double" for c in [*cols, "y"])).repartition(4)
    w = FS.elastic_net_weights(df, cols, "y", strength, mix)
    z, t = (x - x.mean(0)) / x.std(0), y - y.mean()
    slope = z.T @ (t - z @ w) / n - strength * (1 - mix) * w  # of the smooth part: within the penalty's subgradient
    assert np.allclose(slope[w != 0], strength * mix * np.sign(w[w != 0]), atol=1e-8) and (np.abs(slope[w == 0]) <= strength * mix + 1e-8).all()
    # an independent solver of the same problem: proximal gradient steps
    v, step = np.zeros(p), 1 / (np.linalg.norm(z.T @ z / n, 2) + strength * (1 - mix))
    for _ in range(20_000):
        u = v + step * (z.T @ (t - z @ v) / n - strength * (1 - mix) * v)
        v = np.sign(u) * np.maximum(np.abs(u) - step * strength * mix, 0)
    assert np.abs(v - w).max() < 1e-6


def test_elastic_net_selects_one_at_least_and_stands_empty_tables(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (1.0, None, 6.0)], "b double, a double, y double")
    assert [(r["feature"], r["importance"], r["selected"]) for r in FS.elastic_net(df, ["b", "a"], "y").collect()] == [("b", 0.0, False), ("a", 0.0, True)]
    none = df.limit(0)
    assert FS.correlations(none, ["a", "b"]).tolist() == [[0, 0], [0, 0]] and FS.correlation_ratios(none, ["a", "b"]).shape == (2, 2)
    assert FS.elastic_net(none, ["a"], "y").first()["selected"]
    got = FS.select_features(df, ["a", "b"], "y").collect()
    assert {r["feature"]: r["stage"] for r in got} == {"a": "constant", "b": "constant"}
