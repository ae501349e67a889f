"""Hourly aggregates that merge: distinct sources and quantiles of scores that roll up to days without the posts.

Exact distinct counts and quantiles need all rows of a group again for every longer period. A sketch of an hour is a few
kilobytes whatever the hour holds, and sketches of hours merge into those of days. Distinct counts are off by about
1.04 / sqrt(2^bits) of them (HyperLogLog), ranks of quantiles by about 1.7 / k (KLL); small groups are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.candles import bucket


def hourly(posts: DataFrame, keys: Sequence[str] = ("symbol",), of: str = "sentiment_score", source: str = "source", bits: int = 12, k: int = 400) -> DataFrame:
    """keys, timestamp (the hour), n, total, sources (HyperLogLog), scores (KLL; null where there is no score)."""
    return posts.groupBy(*keys, bucket(F.col("timestamp"), 3600).alias("timestamp")).agg(
        F.count(of).alias("n"), F.sum(of).alias("total"), F.hll_sketch_agg(source, bits).alias("sources"), F.kll_sketch_agg_double(of, k).alias("scores")
    )


def roll_up(hours: DataFrame, keys: Sequence[str] = ("symbol",), period: Column | None = None) -> DataFrame:
    """keys, period, n, total, sources, scores of longer periods (days, if none is given), from those of hours."""
    when = F.date_trunc("day", "timestamp") if period is None else period
    return hours.groupBy(*keys, when.alias("timestamp")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("sources").alias("sources"), F.kll_merge_agg_double("scores").alias("scores"))


def estimates(rows: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The sketches' columns as numbers: mean, n_sources and a column q_* for each quantile."""
    found = {f"q_{int(q * 100)}": F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("scores", F.lit(q))) for q in quantiles}
    return rows.withColumns({"mean": F.try_divide("total", "n"), "n_sources": F.hll_sketch_estimate("sources"), **found}).drop("sources", "scores", "total")
