"""Next-day features of a reference universe, ranks over whole tables, and quantile points of residuals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.functions import columns as C
from daybook.operators import relational as R


def reference_features(
    full: DataFrame,
    test: DataFrame,
    panel: DataFrame,
    by_day: Sequence[str] = (),
    by_item: Sequence[str] = (),
    defaults: Mapping[str, object] | None = None,
    item: str = "product_id",
    day: str = "dt",
    y: str = "demand",
) -> DataFrame:
    """Features of the day before for each row of ``test`` (item, day, y), of the history ``full`` (item, day, y).

    Columns of ``panel`` (unique by item and day) come along; gaps in ``by_day`` are filled from the day's first item, those
    in ``by_item`` from the item's last day, the rest from ``defaults``. A feature that ``panel`` has keeps its values and is computed only where
    it is null. Label facts follow from is_missing_day, is_observed_row and the demand. Test rows without a day before stay, with null
    features. All windows of an item share one order; its rows are bounded by the calendar.
    """
    extra = [c for c in panel.columns if c not in (item, day, y, "target_dt")]
    base = full.select(item, day, y).join(panel.select(item, day, *extra), [item, day], "left")
    if by_day:
        base = R.fill_from_template(base, R.first_row(panel, [day], [F.col(item)]), [day], list(by_day))
    if by_item:
        base = R.fill_from_template(base, R.first_row(panel, [item], [F.desc(day)]), [item], list(by_item))
    given = defaults or {}
    base = base.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in base.columns else F.lit(v) for c, v in given.items()})
    base = base.withColumn("target_dt", F.date_add(day, 1)).withColumn("__dow", F.weekday("target_dt"))
    w = Window.partitionBy(item).orderBy(day)
    ww = Window.partitionBy(item, "__dow").orderBy(day)
    old = lambda c, e: F.coalesce(F.col(c), e) if c in base.columns else e
    back = lambda k: F.lag(y, k).over(w)
    feats = {**{f"lag_{k}": old(f"lag_{k}", back(k)) for k in (1, 7, 14, 21, 28)}, "target_lag_1": old("target_lag_1", F.col(y)), "target_lag_7": old("target_lag_7", back(6))}
    for flag in ("promo", "activity"):
        if f"{flag}_flag" in base.columns:
            feats[f"{flag}_rate_7"] = old(f"{flag}_rate_7", F.avg(F.col(f"{flag}_flag").cast("double")).over(w.rowsBetween(-6, 0)))
    if "promo_flag" in base.columns:
        feats["promo_flag_lag_1"] = old("promo_flag_lag_1", F.lag("promo_flag").over(w))
    # of the target's weekday: the four values that end a week before the latest one
    feats["target_same_dow_mean_4w"] = old("target_same_dow_mean_4w", F.avg(y).over(ww.rowsBetween(-10, -7)))
    out = base.withColumns(feats).withColumn("__b", C.blend("target_lag_1", "target_lag_7"))
    out = out.withColumn("field_baseline", F.coalesce("field_baseline", "__b") if "field_baseline" in base.columns else F.col("__b"))
    rows = test.select(item, F.col(day).alias("target_dt"), F.col(y).cast("double").alias("target"))
    joined = rows.join(out.drop("__dow", "__b"), [item, "target_dt"], "left")
    return joined.withColumns(label_facts(joined, "target")).withColumn("residual", F.col("target") - F.col("field_baseline"))


def label_facts(df: DataFrame, y: str) -> dict[str, Column]:
    """target_source, label_quality_score, usability and the true-zero flag, by missing day, observed row and demand."""
    flag = lambda c, v: F.coalesce(F.col(c).cast("boolean"), F.lit(v)) if c in df.columns else F.lit(v)
    zero = F.coalesce(F.col(y), F.lit(0.0)) == 0
    source = F.when(flag("is_missing_day", False), "closed_or_missing_observation").when(~flag("is_observed_row", True) & zero, "dense_calendar_zero_fill").otherwise("observed_sales")
    quality = F.when(source == "observed_sales", 1.0).when(source == "dense_calendar_zero_fill", 0.8).otherwise(0.0)
    return {"target_source": source, "label_quality_score": quality, "usable_for_training_flag": source == "observed_sales", "target_true_zero_demand_flag": zero}


def global_rank(df: DataFrame, value: str, edges: int = 200, salts: int = 16) -> DataFrame:
    """Adds rank (from 1, in order of ``value``) and n_ranked, with no window over the whole table; nulls go.

    ``edges`` approximate quantiles cut the values: what lies between two of them is one bucket, and each
    edge itself is dealt into ``salts`` more, as equal values may stand in any order; so a value that is most of the
    table is split too. The buckets' sizes are the only thing that one task sees: (2 * edges + 1) * salts rows at most.
    """
    v = F.col(value)
    df = df.where(v.isNotNull())
    cuts = df.agg(F.percentile_approx(value, [i / edges for i in range(edges + 1)], 100 * edges)).first()[0]
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]) if cuts else F.array().cast("array<double>")
    below, upto = F.size(F.filter(cuts, lambda c: c < v)), F.size(F.filter(cuts, lambda c: c <= v))
    salt = F.when(below < upto, F.pmod(F.xxhash64(*df.columns), F.lit(salts))).otherwise(0).cast("int")
    dealt = df.withColumns({"__bucket": below + upto, "__salt": salt})
    sizes = dealt.groupBy("__bucket", "__salt").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("__bucket", "__salt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select("__bucket", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(everything).alias("n_ranked"))
    one = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__bucket", "__salt").orderBy(value)))
    return one.join(starts, ["__bucket", "__salt"]).withColumn("rank", F.col("__r") + F.col("__before")).drop("__bucket", "__salt", "__r", "__before")


# A published rational approximation of the inverse normal distribution, error below 1.2e-9.
NORMAL = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)


def normal_quantile(p: Column) -> Column:
    """The standard normal's quantile of 0 < p < 1."""
    a, b, c, d = NORMAL

    def poly(k: Sequence[float], x: Column) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    q = p - 0.5
    r = q * q
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return F.when(p < 0.02425, poly(c, low) / poly(d, low)).when(p > 0.97575, -poly(c, high) / poly(d, high)).otherwise(poly(a, r) * q / poly(b, r))


def qq_points(df: DataFrame, residual: str) -> DataFrame:
    """(rank, theoretical, residual): the i-th smallest of n residuals against the normal quantile of (i - 0.5) / n."""
    r = global_rank(df.select(F.col(residual).cast("double").alias("residual")), "residual")
    return r.select("rank", normal_quantile((F.col("rank") - 0.5) / F.col("n_ranked")).alias("theoretical"), "residual")
