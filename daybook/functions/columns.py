"""Column expressions: parsing, keys, calendar parts, baselines and label rules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result-relevant constants of the domain.
MIN_LABEL_QUALITY = 0.75
NON_TRAINABLE_SOURCES = ("closed_or_missing_observation", "dense_calendar_zero_fill")
TARGET_SEMANTICS = ("observed_sales", "latent_demand_estimated")
FAMILY_KEYWORDS = (
    ("sandwich", ("SANDWICH", "SAND ", "FORMULE")),
    ("beverage", ("BOISSON", "CAFE", "EAU")),
    ("viennoiserie", ("BRIOCHE", "CHAUSSON", "CHOCOLAT", "CHOCO", "CROISSANT", "RAISINS")),
    ("patisserie", ("COOKIE", "ECLAIR", "FINANCIER", "KOUIGN", "TARTELETTE")),
    ("bread", ("BAGUETTE", "BANETTE", "BANETTINE", "BOULE", "BREAD", "CAMPAGNE", "COMPLET", "FICELLE", "MOISSON", "PAIN", "SEIGLE")),
)
RECOVERY_RATES = {"bread": 0.75, "viennoiserie": 0.65, "patisserie": 0.45, "sandwich": 0.35, "beverage": 0.80, "default": 0.50}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_money(c: Column | str, lenient: bool = False) -> Column:
    """``"1,20 €"`` becomes 1.2; what is no number becomes null, or 0 if lenient."""
    digits = F.regexp_replace(F.translate(col(c), ",", "."), r"[^0-9.\-]", "")
    number = F.nullif(digits, F.lit("")).try_cast("double")
    return F.coalesce(number, F.lit(0.0)) if lenient else number


def series_id(location: Column | str, product: Column | str) -> Column:
    """``location__product``; null if either is."""
    return F.concat(col(location), F.lit("__"), col(product))


def group_id(cols: Sequence[str]) -> Column:
    """A key of several columns; nulls show as ``<NA>``, and no columns give one constant group."""
    if not cols:
        return F.lit("all")
    return F.concat_ws("__", *[F.coalesce(col(c).cast("string"), F.lit("<NA>")) for c in cols])


def canonical_source_id(policy: Column | str, name: Column | str) -> Column:
    blank = lambda c: F.nullif(F.trim(col(c)), F.lit(""))
    return F.coalesce(blank(policy), blank(name))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def parse_timestamp(c: Column | str) -> Column:
    """Two accepted forms, with and without seconds."""
    return F.coalesce(F.try_to_timestamp(col(c), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(col(c), F.lit("yyyy-MM-dd HH:mm")))


def mean_available(cols: Sequence[Column | str]) -> Column:
    """Mean of those that are not null; null if all are."""
    cs = [col(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cs), F.lit(0))
    return total / F.nullif(n, F.lit(0))


def blend(a: Column | str, b: Column | str, w: float = 0.5) -> Column:
    """w a + (1 - w) b, or whichever is there."""
    return F.coalesce(w * col(a) + (1 - w) * col(b), col(a), col(b))


def log_delta(y: Column | str, anchor: Column | str) -> Column:
    return F.when((col(y) >= 0) & (col(anchor) >= 0), F.log1p(col(y)) - F.log1p(col(anchor)))


def calendar_features(d: Column | str, prefix: str = "target_") -> dict[str, Column]:
    """Calendar parts and cyclic encodings of a date; Monday is 0 and weeks are ISO weeks."""
    d = col(d)
    weekday, week, month = F.weekday(d), F.weekofyear(d), F.month(d)
    turn = 2 * math.pi
    parts = {
        "day_of_week": weekday, "day_of_month": F.dayofmonth(d), "week_of_year": week, "month": month, "quarter": F.quarter(d), "year": F.year(d),
        "is_weekend": weekday >= 5, "dow_sin": F.sin(turn * weekday / 7), "dow_cos": F.cos(turn * weekday / 7), "week_sin": F.sin(turn * week / 53), "week_cos": F.cos(turn * week / 53),
        "month_sin": F.sin(turn * month / 12), "month_cos": F.cos(turn * month / 12),
    }
    return {prefix + k: v for k, v in parts.items()}


def month_flags(d: Column | str) -> dict[str, Column]:
    d = col(d)
    return {"month_start_flag": F.dayofmonth(d) <= 3, "month_end_flag": F.month(F.date_add(d, 1)) != F.month(d)}


def history_bucket(days: Column | str) -> Column:
    """How much history a series has: 0, 1_7, 8_14, 15_28, 29_56 or 56_plus days."""
    d = F.coalesce(col(days), F.lit(0))
    return F.when(d <= 0, "0").when(d <= 7, "1_7").when(d <= 14, "8_14").when(d <= 28, "15_28").when(d <= 56, "29_56").otherwise("56_plus")


def quality_bucket(c: Column | str) -> Column:
    q = col(c)
    return F.when(q.isNull(), "unknown").when(q >= 0.95, "high").when(q >= MIN_LABEL_QUALITY, "medium").otherwise("low")


def decision_timestamp(d: Column | str) -> Column:
    """The end of the decision day, 23:59:59."""
    return (F.date_add(col(d), 1).cast("timestamp") - F.expr("INTERVAL 1 SECOND")).cast("timestamp_ntz")


def stock_position(production: Column | str, sold: Column | str, waste: Column | str) -> Column:
    return F.greatest(col(production) - col(sold) - col(waste), F.lit(0.0))


def substitution_family(name: Column | str) -> Column:
    """First family of the ordered keyword list that the upper-cased name contains."""
    upper, out = F.trim(F.upper(col(name))), None
    for family, words in FAMILY_KEYWORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | upper.contains(w)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return F.coalesce(out, F.lit("default"))


def recovery_rate(family: Column | str) -> Column:
    out = F.lit(RECOVERY_RATES["default"])
    for name, rate in RECOVERY_RATES.items():
        out = F.when(col(family) == name, rate).otherwise(out)
    return out


def economic_segment(product: str, family: str | None, name: str, products: Sequence[str] = ()) -> Column:
    """``product:<id>`` for products with a profile of their own, else the family column in canonical
    form if it is a known family (whole, then as a part), else by the name's keywords."""
    known = list(RECOVERY_RATES)
    out = F.when(F.col(product).isin(list(products)), F.concat(F.lit("product:"), F.col(product))) if products else F.when(F.lit(False), F.lit(""))
    if family:
        canonical = F.regexp_replace(F.lower(F.trim(F.col(family))), r"[^a-z]+", "_")
        out = out.when(canonical.isin(known), canonical)
        for k in known:
            out = out.when(canonical.contains(k), F.lit(k))
    return out.otherwise(substitution_family(name))


def eligible(columns: Sequence[str]) -> Column:
    """Rows that may train: usable, of quality 0.75 at least, from a trainable source, and not censored
    unless the target is latent demand. True for all where a needed column is missing."""
    need = {"usable_for_training_flag", "label_quality_score", "target_source", "censor_flag", "target_semantics"}
    if not need <= set(columns):
        return F.lit(True)
    fine = F.coalesce(F.col("usable_for_training_flag"), F.lit(False)) & (F.coalesce(F.col("label_quality_score"), F.lit(0.0)) >= MIN_LABEL_QUALITY)
    source = ~F.coalesce(F.col("target_source").isin(*NON_TRAINABLE_SOURCES), F.lit(False))
    censored = ~F.coalesce(F.col("censor_flag"), F.lit(False)) | F.coalesce(F.col("target_semantics") == "latent_demand_estimated", F.lit(False))
    return fine & source & censored


def reconstruct_absolute(kind: str, prediction: Column | str, anchor: Column | str | None = None) -> Column:
    """From the learned target back to demand, never below 0."""
    p = col(prediction)
    if kind == "delta_log_wow":
        p = F.expm1(p + F.log1p(F.greatest(col(anchor), F.lit(0.0))))
    elif kind == "additive_residual":
        p = col(anchor) + p
    elif kind == "log1p":
        p = F.expm1(p)
    return F.greatest(p, F.lit(0.0))
