"""Joins, aggregates, windows, sorts and set operations of demand panels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.operators.strata import first_rows

SMALL_ROWS = 100_000

# ---------------------------------------------------------------- joins


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marked for broadcast if at most ``rows`` rows are counted; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")


def star_join(spine: DataFrame, dims: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left joins of a spine to its dimensions; Spark broadcasts those below its size threshold."""
    return reduce(lambda df, d: df.join(d[0], list(d[1]), "left"), dims, spine)


def join_expr(left: DataFrame, right: DataFrame, keys: dict[str, Column], how: str = "left") -> DataFrame:
    """Equi join on expressions of the left side: they become columns first, so it stays a hash join."""
    tmp = {k: f"__{k}" for k in keys}
    out = left.withColumns({tmp[k]: e for k, e in keys.items()}).join(right.withColumnsRenamed(tmp), list(tmp.values()), how)
    return out.drop(*tmp.values())


def govern(df: DataFrame, allowed: DataFrame, key: str = "source_id") -> DataFrame:
    return df.join(allowed.select(key).distinct(), key, "left_semi")


def ungoverned(df: DataFrame, allowed: DataFrame, key: str = "source_id") -> DataFrame:
    return df.select(key).distinct().join(allowed.select(key), key, "left_anti")


def minus_rows(df: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(taken.select(*keys), list(keys), "left_anti")


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row with the columns of a relation of one row (an aggregate without keys); one of several rows is an error."""
    two = one_row.limit(2).agg(F.collect_list(F.struct(*one_row.columns)).alias("__rows")).where(F.size("__rows") > 0)
    only = F.when(F.size("__rows") == 1, F.get("__rows", F.lit(0))).otherwise(F.raise_error(F.lit("a scalar relation has several rows")))
    return df.crossJoin(F.broadcast(two.select(only.alias("__one")).select("__one.*")))


def densify(bounds: DataFrame, lo: str, hi: str, out: str = "dt") -> DataFrame:
    """A row for each day from ``lo`` to ``hi``."""
    return bounds.withColumn(out, F.explode(F.sequence(lo, hi))).drop(lo, hi)


def grid(dates: DataFrame, items: DataFrame, date_col: str = "dt") -> DataFrame:
    """Every item on every date of a calendar; the dates ride along as one array of bounded length."""
    days = dates.agg(F.array_sort(F.collect_set(date_col)).alias("__days"))
    return with_scalar(items, days).withColumn(date_col, F.explode("__days")).drop("__days")


def asof_join(spine: DataFrame, events: DataFrame, keys: Sequence[str], day: str = "dt", effective: str = "effective_from", available: str = "available_from", priority: str = "source_priority", values: Sequence[str] = ("value",)) -> DataFrame:
    """Each spine row with the latest event in force and published by its day, the smaller priority first.

    Events become visible on the later of both dates. Spine and events are united and carried
    forward by a running maximum of (effective date, -priority, values), so each key is one
    sort and no pair of rows is formed; rows that see no event keep nulls.
    """
    visible = F.greatest(effective, available)
    seen = F.struct(F.col(effective).alias("e"), (-F.col(priority)).alias("p"), *[F.col(v).alias(v) for v in values])
    cols = spine.columns
    up = events.select(*[F.col(k) for k in keys], visible.alias(day), F.lit(0).alias("__row"), seen.alias("__seen"))
    down = spine.withColumn("__row", F.lit(1))
    both = down.unionByName(up, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(day), F.col("__row")).rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("__best", F.max("__seen").over(w)).where("__row = 1")
    return got.select(*cols, *[F.col(f"__best.{v}").alias(v) for v in values], F.col("__best.e").alias(effective))


def clip_join(days: DataFrame, bounds: DataFrame, keys: Sequence[str], day: str = "dt", lo: str = "min_dt", hi: str = "max_dt") -> DataFrame:
    return days.join(bounds, list(keys)).where(F.col(day).between(F.col(lo), F.col(hi))).drop(lo, hi)


def fill_from_template(df: DataFrame, template: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Only what is missing is taken from the template, a row for each key."""
    tmp = template.select(*key, *[F.col(c).alias(f"__{c}") for c in cols])
    out = df.join(tmp, list(key), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) if c in df.columns else F.col(f"__{c}") for c in cols}).drop(*[f"__{c}" for c in cols])


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def join_target(reference: DataFrame, features: DataFrame, keys: Sequence[str], date_col: str = "date", target_col: str = "target_dt") -> DataFrame:
    return reference.join(features.withColumnRenamed(target_col, date_col), [*keys, date_col], "inner")


def align_one_to_one(expected: DataFrame, forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Forecasts beside expected rows; fails if a key of the forecast repeats."""
    if not forecast.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"forecast rows repeat a key of {list(keys)}")
    return expected.join(forecast, list(keys), "left")


def align_by_step(expected: DataFrame, forecast: DataFrame, key: str, order: str) -> DataFrame:
    """Beside each other by their places in the series, where time stamps do not match."""
    step = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return expected.withColumn("step", step).join(forecast.withColumn("step", step).drop(order), [key, "step"], "left")


def keep_series(df: DataFrame, selected: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(selected.select(*key).distinct(), list(key), "left_semi")


def add_cold_start(context: DataFrame, future: DataFrame, cold: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """Series of ``future`` without context get a copy of the aggregate context ``cold``.

    Missing series meet the context's rows by a constant that is salted: the context is cut into ``salts`` parts and each series asks for every
    part, so no task holds the context whole, and none makes all copies of a part where AQE splits it.
    """
    missing = future.select(key).distinct().join(context.select(key).distinct(), key, "left_anti")
    part = F.pmod(F.xxhash64(*cold.columns), F.lit(salts)).cast("int")
    asked = missing.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = cold.withColumn("__part", part).join(asked, "__part").drop("__part")
    return context.unionByName(copies.select(key, *cold.columns), allowMissingColumns=True)


def year_ago(df: DataFrame, keys: Sequence[str], value: str, date_col: str = "dt", offsets: Sequence[int] = (365, 364, 366)) -> DataFrame:
    """year_ago_<value>: the value 365 days before, else 364, else 366; one join on exploded offsets."""
    past = df.select(*keys, F.col(date_col).alias("__d"), F.col(value).alias("__v")).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(len(offsets) - 1))))
    days = F.element_at(F.array(*map(F.lit, offsets)), F.col("__k") + 1)
    past = past.select(*keys, F.date_add("__d", days).alias(date_col), F.col("__k"), "__v").groupBy(*keys, date_col).agg(F.min_by("__v", "__k").alias(f"year_ago_{value}"))
    return df.join(past, [*keys, date_col], "left")


def fill_predictions(expected: DataFrame, predictions: DataFrame, keys: Sequence[str], baseline: str | None = None, strict: bool = False) -> DataFrame:
    """Predictions aligned one to one; the rest take the clipped baseline or 0, or fail if strict."""
    out = align_one_to_one(expected, predictions, keys)
    if strict and not out.where("prediction IS NULL").isEmpty():
        raise ValueError("rows without a prediction")
    other = F.greatest(F.coalesce(F.col(baseline), F.lit(0.0)), F.lit(0.0)) if baseline else F.lit(0.0)
    return out.withColumn("prediction", F.coalesce("prediction", other))


# ---------------------------------------------------------------- aggregates


def series_bounds(df: DataFrame, keys: Sequence[str], attrs: Sequence[str] = (), day: str = "dt") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(day).alias("min_dt"), F.max(day).alias("max_dt"), *[F.max(a).alias(a) for a in attrs])


def ordered_concat(c: str, sep: str = " | ") -> Column:
    """Values joined in their order; an aggregate."""
    return F.array_join(F.array_sort(F.collect_list(c)), sep)


def pivot_metrics(df: DataFrame, keys: Sequence[str], names: Sequence[str], name_col: str = "metric_name", value_col: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(name_col) == n, F.col(value_col))).alias(f"{n}_latest") for n in names], (F.count(value_col) > 0).alias("any_available"))


def applicability(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(f"{c}_applicable") for c in cols])


def resolve_providers(df: DataFrame, keys: Sequence[str], provider: str, max_cols: Sequence[str] = (), avg_cols: Sequence[str] = (), conflict_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in max_cols],
        *[F.avg(c).alias(c) for c in avg_cols],
        F.countDistinct(provider).alias("provider_count"),
        *[(F.countDistinct(c) > 1).alias(f"{c}_conflict") for c in conflict_cols],
    )


def equal_weights(df: DataFrame, source: str) -> DataFrame:
    """weight: rows over (sources x rows of the source), so all sources weigh the same."""
    per = df.groupBy(source).agg(F.count("*").alias("__n"))
    whole = per.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    per = with_scalar(per, whole).select(source, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return df.join(per, source, "left")


def source_weights(df: DataFrame, split: str, source: str) -> DataFrame:
    """Mean rows of a split's sources over a source's rows."""
    per = df.groupBy(split, source).agg(F.count("*").alias("row_count"))
    return per.withColumn("source_weight", F.avg("row_count").over(Window.partitionBy(split)) / F.col("row_count"))


def roll_up(df: DataFrame, grain: str, keys: Sequence[str], day: str, sums: Sequence[str]) -> DataFrame:
    """Sums by ISO week, month, hour, quarter of an hour or half day."""
    d = F.col(day)
    bucket = {
        "week": F.date_trunc("week", d), "month": F.date_trunc("month", d), "hour": F.date_trunc("hour", d),
        "quarter_hour": F.timestamp_seconds(F.floor(F.unix_timestamp(d) / 900) * 900),
        "half_day": F.concat(F.date_format(d, "yyyy-MM-dd"), F.when(F.hour(d) < 14, " AM").otherwise(" PM")),
    }[grain]
    return df.groupBy(*keys, bucket.alias("bucket")).agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("n_rows"))


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation over rows with both values; null, not an error, where one does not vary."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def series_autocorr(df: DataFrame, keys: Sequence[str], value: str, lag: int, day: str = "dt") -> DataFrame:
    """Lag-k autocorrelation of series with k + 10 rows at least and more than one value."""
    w = Window.partitionBy(*keys).orderBy(day)
    pairs = df.withColumn("__past", F.lag(value, lag).over(w))
    return pairs.groupBy(*keys).agg(safe_corr(value, "__past").alias("autocorr"), F.count("*").alias("n"), F.countDistinct(value).alias("k")).where((F.col("n") >= lag + 10) & (F.col("k") > 1)).drop("n", "k")


def dow_lift(df: DataFrame, value: str, day: str = "dt") -> DataFrame:
    per = df.groupBy(F.weekday(day).alias("weekday")).agg(F.avg(value).alias("__m"))
    return with_scalar(per, df.agg(F.avg(value).alias("__all"))).select("weekday", (F.col("__m") / F.nullif("__all", F.lit(0.0))).alias("lift"))


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], list(cols), "column_name", "null_count")


# ---------------------------------------------------------------- windows


def over(keys: Sequence[str], order: Sequence[Column | str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def ranked(df: DataFrame, grain: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = over(grain, order)
    return df.withColumn("dedup_rank", F.row_number().over(w)).withColumn("duplicate_count", F.count("*").over(Window.partitionBy(*grain)))


def dedup(df: DataFrame, grain: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return ranked(df, grain, order).where("dedup_rank = 1").drop("dedup_rank", "duplicate_count")


def dedup_audit(df: DataFrame, grain: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return ranked(df, grain, order).where("dedup_rank > 1")


def lead_target(df: DataFrame, keys: Sequence[str], cols: Sequence[str], day: str = "dt") -> DataFrame:
    """Tomorrow's target and its label metadata."""
    w = over(keys, [day])
    return df.withColumns({f"next_{c}": F.lead(c, 1).over(w) for c in cols})


def add_lags(df: DataFrame, keys: Sequence[str], lags: dict[str, Sequence[int]], day: str = "dt") -> DataFrame:
    w = over(keys, [day])
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c, ks in lags.items() for k in ks})


def add_target_lags(df: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int], day: str = "dt") -> DataFrame:
    """target_lag_k: k days before the target day, which is k - 1 before the decision day."""
    w = over(keys, [day])
    return df.withColumns({f"target_lag_{k}": F.lag(value, k - 1).over(w) if k > 1 else F.col(value) for k in lags})


def add_rolling(df: DataFrame, keys: Sequence[str], windows: dict[str, Sequence[int]], fn: Callable[[Column], Column] = F.avg, name: str = "mean", day: str = "dt") -> DataFrame:
    w = over(keys, [day])
    return df.withColumns({f"{c}_{name}_{n}": fn(F.col(c).cast("double")).over(w.rowsBetween(-(n - 1), 0)) for c, ns in windows.items() for n in ns})


def history_days(df: DataFrame, keys: Sequence[str], observed: str, day: str = "dt") -> DataFrame:
    return df.withColumn("history_available_days", F.sum(F.when(F.col(observed), 1).otherwise(0)).over(over(keys, [day])))


def ffill_limited(df: DataFrame, keys: Sequence[str], cols: Sequence[str], days: int = 2, day: str = "dt") -> DataFrame:
    """Missing values take the last one of the days before, if it is at most ``days`` days old."""
    w = over(keys, [day]).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for c in cols:
        last = F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(day).alias("d"))), ignorenulls=True).over(w)
        out[c] = F.coalesce(F.col(c), F.when(F.datediff(F.col(day), last["d"]).between(1, days), last["v"]))
    return df.withColumns(out)


def holiday_neighbours(df: DataFrame, keys: Sequence[str], flag: str = "holiday_flag", day: str = "dt") -> DataFrame:
    """Days before and after holidays; bridge days, working days from Tuesday to Friday beside one."""
    w = over(keys, [day])
    before, after = F.lead(flag, 1, False).over(w), F.lag(flag, 1, False).over(w)
    out = df.withColumns({"pre_holiday_flag": before, "post_holiday_flag": after})
    beside = F.col("pre_holiday_flag") | F.col("post_holiday_flag")
    return out.withColumn("bridge_day_flag", F.weekday(day).isin(1, 2, 3, 4) & beside & ~F.col(flag))


def date_ranks(df: DataFrame, source: str, day: str = "dt") -> DataFrame:
    """Distinct dates of each source with rank and count."""
    d = df.select(source, day).distinct()
    return d.withColumn("date_rank", F.row_number().over(over([source], [day]))).withColumn("date_count", F.count("*").over(Window.partitionBy(source)))


def time_index(df: DataFrame, keys: Sequence[str], day: str = "dt") -> DataFrame:
    return df.withColumn("time_idx", F.row_number().over(over(keys, [day])) - 1)


def weekday_rolling(df: DataFrame, keys: Sequence[str], value: str, n: int = 4, day: str = "dt") -> DataFrame:
    """Mean of the last n values of the same weekday, today's left out."""
    w = Window.partitionBy(*keys, F.weekday(day)).orderBy(day).rowsBetween(-n, -1)
    return df.withColumn(f"weekday_mean_{n}", F.avg(value).over(w))


def group_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumns({f"{value}_mean": F.avg(value).over(w), f"{value}_median": F.percentile(value, 0.5).over(w), f"{value}_q20": F.percentile(value, 0.2).over(w), f"{value}_q80": F.percentile(value, 0.8).over(w)})


def lagged_plan(df: DataFrame, keys: Sequence[str], value: str, n: int = 7, day: str = "dt") -> DataFrame:
    """Day sums, and the mean of the n days before; 0 without history."""
    sums = df.groupBy(*keys, day).agg(F.sum(value).alias(value))
    return sums.withColumn("planned", F.coalesce(F.avg(value).over(over(keys, [day]).rowsBetween(-n, -1)), F.lit(0.0)))


def tail_window(train: DataFrame, valid: DataFrame, keys: Sequence[str], n: int, day: str = "dt") -> DataFrame:
    """The last n training rows of each series and its validation rows, numbered; shorter series go."""
    back = train.withColumn("__r", F.row_number().over(over(keys, [F.desc(day)]))).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    tail = back.where((F.col("__r") <= n) & (F.col("__n") >= n)).drop("__r", "__n").withColumn("part", F.lit("train"))
    rest = valid.join(tail.select(*keys).distinct(), list(keys), "left_semi").withColumn("part", F.lit("valid"))
    return time_index(tail.unionByName(rest), keys, day)


# ---------------------------------------------------------------- sorts, limits, sets


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def head_fraction(df: DataFrame, strata: Sequence[str], order: Sequence[str], f: float) -> DataFrame:
    """The first floor(n f) rows of each stratum, however large it is."""
    return first_rows(df, strata, order, lambda n: F.floor(n * f))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Columns that a frame lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_row(df, keys, order)


def replace_sources(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def tag_and_union(frames: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    return union_all([df.withColumn(tag, F.lit(name)) for name, df in frames.items()])
