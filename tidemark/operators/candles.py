"""Candles: from ticks, at other intervals, on a dense grid; their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import ordered

CANDLE = ["timestamp", "symbol", "open", "high", "low", "close", "volume"]
UNITS = {"m": 60, "h": 3600, "d": 86400}


def interval_seconds(interval: str) -> int:
    """"4h" -> 14400; the number has to be positive, the unit m, h or d."""
    if interval[-1:] not in UNITS or not interval[:-1].isdigit() or int(interval[:-1]) < 1:
        raise ValueError(f"not an interval: {interval!r}")
    return int(interval[:-1]) * UNITS[interval[-1]]


def instant(column: str) -> Column:
    """A time without zone as the instant that it is in UTC, whatever the session's zone is."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz)))")


def bucket(time: Column, seconds: int) -> Column:
    """The start of the epoch-aligned bucket of a timestamp."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(time) / seconds) * seconds)


def ticks_to_candles(ticks: DataFrame, seconds: int = 3600, key: str = "symbol", time: str = "time", price: str = "price", quantity: str = "quantity", ties: Sequence[str] = ()) -> DataFrame:
    """Open and close are the first and last price by (time, ties)."""
    order = F.struct(time, *ties)
    return ticks.groupBy(bucket(F.col(time), seconds).alias("timestamp"), F.col(key).cast("string").alias("symbol")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(quantity).cast("double").alias("volume")
    )


def resample(candles: DataFrame, interval: str, source: str = "1h", complete: bool = True) -> DataFrame:
    """Candles at a longer interval; buckets without all their source candles are dropped."""
    seconds = interval_seconds(interval)
    grouped = candles.groupBy("symbol", bucket(F.col("timestamp"), seconds).alias("bucket")).agg(
        F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_source")
    )
    rows = grouped.where(F.col("n_source") == seconds // interval_seconds(source)) if complete else grouped
    return rows.withColumnRenamed("bucket", "timestamp")


def resample_diagnostics(candles: DataFrame, interval: str, source: str = "1h") -> DataFrame:
    """Per symbol: complete and incomplete buckets, rows in incomplete ones."""
    whole = interval_seconds(interval) // interval_seconds(source)
    n = F.col("n_source")
    return resample(candles, interval, source, complete=False).groupBy("symbol").agg(F.count_if(n == whole).alias("complete"), F.count_if(n != whole).alias("incomplete"), F.sum(F.when(n != whole, n).otherwise(0)).alias("dropped_rows"))


def resample_many(candles: DataFrame, intervals: Sequence[str], source: str = "1h") -> DataFrame:
    """All intervals in one pass over the candles: each row goes to one bucket of every interval."""
    whole = interval_seconds(source)
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("interval"), F.lit(interval_seconds(i)).alias("seconds")) for i in intervals]))
    rows = candles.withColumn("_i", steps).select("*", "_i.*")
    start = F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / F.col("seconds")) * F.col("seconds"))
    grouped = rows.groupBy("symbol", "interval", "seconds", start.alias("bucket")).agg(
        F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_source")
    )
    return grouped.where(F.col("n_source") * whole == F.col("seconds")).drop("seconds").withColumnRenamed("bucket", "timestamp")


def hour_grid(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Every hour from a key's first to its last one."""
    ends = df.groupBy(key).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    return ends.select(key, F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("timestamp"))


def dense(candles: DataFrame) -> DataFrame:
    """Hours without trades carry the last close and have no volume."""
    rows = hour_grid(candles).join(candles, ["symbol", "timestamp"], "left")
    last = F.last("close", ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_c", last).select("timestamp", "symbol", *[F.coalesce(c, "_c").alias(c) for c in ("open", "high", "low", "close")], F.coalesce("volume", F.lit(0.0)).alias("volume"))


RULES = {
    "invalid_timestamp": "timestamp is null",
    "empty_symbol": "symbol is null or trim(symbol) = ''",
    "price_not_positive": "least(open, high, low, close) <= 0",
    "not_numeric": "open is null or high is null or low is null or close is null or volume is null or isnan(open) or isnan(high) or isnan(low) or isnan(close) or isnan(volume)",
    "negative_volume": "volume < 0",
}


def normalize(rows: DataFrame) -> DataFrame:
    """Projects to the candle columns with their types; what cannot be read becomes null."""
    return rows.select(F.expr("try_cast(timestamp as timestamp)").alias("timestamp"), F.trim(F.col("symbol").cast("string")).alias("symbol"), *[F.nanvl(F.expr(f"try_cast({c} as double)"), F.lit(None).cast("double")).alias(c) for c in CANDLE[2:]])


def check(candles: DataFrame, symbol: str | None = None) -> DataFrame:
    """One row per violation: the candle and the rule that it breaks. With ``symbol`` all candles have to be of it."""
    rules = [F.when(F.expr(cond), F.lit(rule)) for rule, cond in RULES.items()]
    if symbol is not None:
        rules.append(F.when(~F.col("symbol").eqNullSafe(symbol), F.lit("wrong_symbol")))
    return candles.withColumn("rule", F.explode(F.array_compact(F.array(*rules))))


def valid(candles: DataFrame) -> DataFrame:
    return candles.where(" and ".join(f"not coalesce({cond}, false)" for cond in RULES.values()))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def gaps(candles: DataFrame, seconds: int = 3600) -> DataFrame:
    """Rows after a gap, with the number of candles missing before them."""
    missing = (F.unix_seconds("timestamp") - F.unix_seconds(F.lag("timestamp").over(ordered()))) / seconds - 1
    return candles.withColumn("missing", missing.cast("long")).where("missing > 0").select("symbol", "timestamp", "missing")
