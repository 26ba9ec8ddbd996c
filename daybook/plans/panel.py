"""Dense panels and next-day features, composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.functions import columns as C
from daybook.operators import relational as R

SERIES = ("dataset_source", "location_id", "product_id")


def dense_panel(daily: DataFrame, series: Sequence[str] = SERIES, place: Sequence[str] = ("dataset_source", "location_id"), qty: str = "qty", day: str = "dt") -> DataFrame:
    """A row for each series and day between its first and last one.

    Three zeros stay apart: sold nothing (observed), not listed on a day when the location sold other
    things (filled with 0), and no sales in the whole location (null: closed or missing).
    """
    spine = R.densify(R.series_bounds(daily, series, day=day), "min_dt", "max_dt", day)
    active = daily.select(*place, day).distinct().withColumn("active", F.lit(True))
    p = spine.join(daily, [*series, day], "left").join(active, [*place, day], "left")
    seen, open_ = F.col(qty).isNotNull(), F.coalesce("active", F.lit(False))
    return p.select(
        *series,
        day,
        seen.alias("is_observed_row"),
        F.when(seen, F.col(qty)).when(open_, 0.0).alias("demand"),
        F.when(seen, "observed_sales").when(open_, "dense_calendar_zero_fill").otherwise("closed_or_missing_observation").alias("target_source"),
        F.when(seen, 1.0).when(open_, 0.8).otherwise(0.0).alias("label_quality_score"),
        *[c for c in daily.columns if c not in (*series, day, qty)],
    )


def feature_panel(panel: DataFrame, series: Sequence[str] = SERIES, day: str = "dt") -> DataFrame:
    """Next-day target with its label facts, lags, rolling means, field baseline and calendar parts.

    All windows share one partitioning and order, so the panel is shuffled and sorted once.
    """
    w = Window.partitionBy(*series).orderBy(day)
    back = lambda k: F.lag("demand", k).over(w)
    one = panel.withColumns(
        {
            "target": F.lead("demand").over(w), "next_quality": F.lead("label_quality_score").over(w), "next_source": F.lead("target_source").over(w),
            "target_lag_1": F.col("demand"), **{f"target_lag_{k}": back(k - 1) for k in (2, 3, 4, 5, 6, 7, 14, 21, 28)}, **{f"lag_{k}": back(k) for k in (1, 7, 14, 21, 28)},
            "demand_mean_7": F.avg("demand").over(w.rowsBetween(-6, 0)), "demand_mean_14": F.avg("demand").over(w.rowsBetween(-13, 0)), "demand_mean_28": F.avg("demand").over(w.rowsBetween(-27, 0)),
            "demand_sd_28": F.stddev_samp("demand").over(w.rowsBetween(-27, 0)), "history_available_days": F.sum(F.col("is_observed_row").cast("int")).over(w),
        }
    )
    two = one.withColumns(
        {
            "same_dow_mean_4w": C.mean_available(["target_lag_7", "target_lag_14", "target_lag_21", "target_lag_28"]), "field_baseline": C.blend("target_lag_1", "target_lag_7"),
            "delta_log_wow": C.log_delta("target", "target_lag_7"), "history_bucket": C.history_bucket("history_available_days"), "target_dt": F.date_add(day, 1), "decision_timestamp": C.decision_timestamp(day),
            "target_usable": (F.col("next_quality") >= C.MIN_LABEL_QUALITY) & ~F.col("next_source").isin(*C.NON_TRAINABLE_SOURCES),
        }
    )
    return two.withColumn("residual", F.col("target") - F.col("field_baseline")).withColumns(C.calendar_features("target_dt"))
