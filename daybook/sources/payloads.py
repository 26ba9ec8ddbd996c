"""Open-data payloads (JSON, SDMX, ICS) and calendars, parsed by Spark's own functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEATHER_FIELDS = ("temperature_2m_mean", "temperature_2m_min", "temperature_2m_max", "precipitation_sum", "relative_humidity_2m_mean", "wind_speed_10m_mean")


def parse_weather(df: DataFrame, key: str = "location_id", payload: str = "payload") -> DataFrame:
    """Column arrays of a daily block become a row per location and day; shorter arrays give nulls."""
    schema = "daily struct<time array<string>, " + ", ".join(f"{f} array<double>" for f in WEATHER_FIELDS) + ">"
    there = lambda f: F.coalesce(F.col(f"p.daily.{f}"), F.array().cast("array<double>" if f != "time" else "array<string>")).alias(f)
    cols = ("time", *WEATHER_FIELDS)
    day = df.select(key, F.from_json(payload, schema).alias("p")).select(key, *map(there, cols)).select(key, F.explode(F.arrays_zip(*cols)).alias("d"))
    return day.select(key, F.col("d.time").try_cast("date").alias("dt"), *[F.col(f"d.{f}").alias(f) for f in WEATHER_FIELDS])


def parse_indicator(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Yearly observations that are not null; they count from the first of January after their year."""
    schema = "array<struct<countryiso3code: string, date: string, value: double>>"
    o = df.select(F.explode(F.from_json(payload, schema)).alias("o")).select("o.*").where("value IS NOT NULL")
    return o.select(F.col("countryiso3code").alias("country_code"), F.col("date").cast("int").alias("year"), "value", F.make_date(F.col("date").cast("int") + 1, F.lit(1), F.lit(1)).alias("effective_from"))


def parse_sdmx(df: DataFrame, freq: str, payload: str = "payload") -> DataFrame:
    """SDMX observations; they count from the first day after their month (M) or quarter (Q)."""
    schema = "Obs array<struct<_TIME_PERIOD: string, _OBS_VALUE: double>>"
    o = df.select(F.explode(F.from_xml(F.col(payload), schema)["Obs"]).alias("o")).select(F.col("o._TIME_PERIOD").alias("period"), F.col("o._OBS_VALUE").alias("value"))
    year, part = F.substring("period", 1, 4).cast("int"), F.regexp_extract("period", r"(\d+)$", 1).cast("int")
    first = F.make_date(year, part if freq == "M" else part * 3 - 2, F.lit(1))
    return o.select("period", "value", F.add_months(first, 1 if freq == "M" else 3).alias("effective_from"))


def parse_ics(df: DataFrame, text: str = "value") -> DataFrame:
    """Calendar events as a row per day, the end left out; an event without an end is one day."""
    event = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))).alias("e")
    field = lambda name: F.nullif(F.regexp_extract("e", rf"(?m)^{name}[^:\n]*:([^\r\n]*)", 1), F.lit(""))
    day = lambda name: F.try_to_timestamp(F.substring(field(name), 1, 8), F.lit("yyyyMMdd")).cast("date")
    rows = df.select(event).select(day("DTSTART").alias("s"), day("DTEND").alias("x"), field("SUMMARY").alias("summary")).where("s IS NOT NULL")
    last = F.greatest(F.date_sub(F.coalesce("x", F.date_add("s", 1)), 1), F.col("s"))
    return rows.select(F.explode(F.sequence("s", last)).alias("dt"), "summary")


def easter(year) -> Column:
    """Easter Sunday of a year column (Gregorian computus)."""
    y = F.col(year) if isinstance(year, str) else year
    a, b, c = y % 19, F.floor(y / 100), y % 100
    h = (19 * a + b - F.floor(b / 4) - F.floor((b - F.floor((b + 8) / 25) + 1) / 3) + 15) % 30
    w = (32 + 2 * (b % 4) + 2 * F.floor(c / 4) - h - c % 4) % 7
    m = F.floor((a + 11 * h + 22 * w) / 451)
    n = h + w - 7 * m + 114
    return F.make_date(y, F.floor(n / 31).cast("int"), (n % 31 + 1).cast("int"))


def holiday_calendar(country_years: DataFrame) -> DataFrame:
    """Public holidays of FR and GB for rows (country_code, year): fixed days, days from Easter, Mondays,
    and substitutes in GB for those that fall on a weekend."""
    y, e = F.col("year"), easter("year")
    fixed = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    monday = lambda m, d: F.next_day(F.date_sub(fixed(m, d), 1), "Mon")
    last_monday = lambda m, d: F.date_sub(F.next_day(fixed(m, d), "Mon"), 7)

    def moved(d, taken=False):
        w = F.weekday(d)
        return F.when(w == 5, F.date_add(d, 2)).when(w == 6, F.date_add(d, 2 if taken else 1)).when((w == 0) & F.lit(taken), F.date_add(d, 1)).otherwise(d)

    fr = {"new year": fixed(1, 1), "easter monday": F.date_add(e, 1), "labour day": fixed(5, 1), "victory 1945": fixed(5, 8), "ascension": F.date_add(e, 39), "whit monday": F.date_add(e, 50), "bastille day": fixed(7, 14), "assumption": fixed(8, 15), "all saints": fixed(11, 1), "armistice": fixed(11, 11), "christmas": fixed(12, 25)}
    gb = {"new year": moved(fixed(1, 1)), "good friday": F.date_sub(e, 2), "easter monday": F.date_add(e, 1), "early may": monday(5, 1), "spring": last_monday(5, 31), "summer": last_monday(8, 31), "christmas": moved(fixed(12, 25)), "boxing day": moved(fixed(12, 26), True)}
    listed = lambda days: F.array(*[F.struct(d.alias("dt"), F.lit(n).alias("name")) for n, d in days.items()])
    rows = country_years.where(F.col("country_code").isin("FR", "GB")).withColumn("h", F.explode(F.when(F.col("country_code") == "FR", listed(fr)).otherwise(listed(gb))))
    return rows.select("country_code", "h.dt", "h.name").distinct()


def country_years(bounds: DataFrame) -> DataFrame:
    """(country_code, year) of (country_code, min_dt, max_dt), the target day behind max_dt with it."""
    return bounds.select("country_code", F.explode(F.sequence(F.year("min_dt"), F.year(F.date_add("max_dt", 1)))).alias("year")).distinct()


def country_bounds(bounds: DataFrame, lookback: int) -> DataFrame:
    return bounds.groupBy("country_code").agg(F.date_sub(F.min("min_dt"), lookback).alias("min_dt"), F.date_add(F.max("max_dt"), 1).alias("max_dt"))


# Residents that a building of a kind, and a residential area, stand for.
RESIDENTS = {"apartments": 40.0, "residential": 18.0, "house": 3.0, "detached": 3.0, "semidetached_house": 4.0, "terrace": 6.0}
AREA_RESIDENTS = 120.0


def residents(tags: str = "tags") -> Column:
    """What an element adds to the population: by its kind of building, else by residential land use, else null."""
    tag = lambda k: F.element_at(tags, F.lit(k))
    building = F.coalesce(*[F.when(tag("building") == k, w) for k, w in RESIDENTS.items()])
    return F.coalesce(building, F.when(tag("landuse") == "residential", AREA_RESIDENTS))


def parking_bucket(parking: str, transit: str) -> Column:
    """high, medium, low or unknown, by the numbers of car parks and of stations around."""
    p, t = F.col(parking), F.col(transit)
    return F.when(p >= 4, "high").when((p >= 1) & (t <= 2), "medium").when((p >= 1) | (t > 0), "low").otherwise("unknown")


def poi_catchment(elements: DataFrame, keys: Sequence[str], radius: str, tags: dict[str, tuple[str, str]], rings: Sequence[float] = (0.5, 1.0, 3.0)) -> DataFrame:
    """Distinct points of interest by tag predicate and the population proxy within rings (km); elements: (keys,
    radius, type, id, tags map). A point that comes several times counts once, with its largest number of residents."""
    within = lambda r: F.col(radius) <= r
    counts = {f"{name}_{str(r).replace('.', '_')}km": within(r) & (F.element_at("tags", F.lit(k)) == v) for name, (k, v) in tags.items() for r in rings}
    people = {f"population_{str(r).replace('.', '_')}km": F.when(within(r), residents()) for r in rings}
    points = elements.groupBy(*keys, "type", "id").agg(*[F.max(there).alias(n) for n, there in counts.items()], *[F.max(w).alias(n) for n, w in people.items()])
    return points.groupBy(*keys).agg(*[F.count_if(n).alias(n) for n in counts], *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in people])


def cache_key(source: str, location: str, lat: str, lon: str) -> Column:
    return F.concat_ws("|", source, location, F.format_string("%.5f", F.col(lat)), F.format_string("%.5f", F.col(lon)))


def cache_resolve(locations: DataFrame, cache: DataFrame, fresh: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(resolved locations, merged cache): fresh rows take the place of cached ones with their key."""
    merged = cache.join(fresh.select(key), key, "left_anti").unionByName(fresh)
    return locations.join(merged, key), merged


def cache_misses(locations: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return locations.join(cache.select(key), key, "left_anti")


def zone_fanout(days: DataFrame, locations: DataFrame) -> DataFrame:
    """Zone days for each of the zone's locations, within its own dates."""
    return days.join(locations, "zone").where("dt BETWEEN min_dt AND max_dt").drop("min_dt", "max_dt").distinct()
