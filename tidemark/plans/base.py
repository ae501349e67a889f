"""How queries are registered, with their DuckDB equivalents.

Market queries take candles from ``events`` (symbol: event_type, one bar per hour), text queries take posts from
``documents`` and comments from ``conversations``. Times are returned as epoch seconds, doubles with six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its DuckDB SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scientific(x: Column | str, digits: int) -> Column:
    """x as C's printf writes it, null for null; Spark's own format calls what is not finite by other names."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x.isNotNull(), F.format_string(f"%.{digits}e", x))


def result(df: DataFrame, *cols: str) -> DataFrame:
    """The columns (all, if none is named): timestamps as seconds (``t``), doubles rounded."""
    out = []
    kinds = dict(df.dtypes)
    for c in cols or df.columns:
        if kinds[c] == "timestamp":
            out.append(F.unix_seconds(c).alias("t" if c == "timestamp" else c))
        elif kinds[c] == "double":
            out.append(F.round(c, 6).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
