"""Where queries and their SQL are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.sources.testdata import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text and doubles to six places, as the SQL of the queries gives them."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        elif kind == "double":
            c = F.round(c, 6)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None, ctes: str = ""):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            # shares are doubles on both sides: DuckDB would take a literal as a decimal and round elsewhere
            ORACLES[name] = re.sub(r"(floor|ceil)\((\w+(?:\(\*\))?) \* (0\.\d+)\)", r"\1(\2 * CAST(\3 AS DOUBLE))", with_ctes(ctes, sql))
        return f

    return keep
