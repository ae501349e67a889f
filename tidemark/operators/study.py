"""Studies across series: engagement splits, collinearity, sessions, sector momentum, funding carried forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.distributions import t_test_p
from tidemark.functions.windows import as_of, change, ordered, roll


def engagement_split(posts: DataFrame, market: DataFrame, hours: int, share: float = 0.75) -> DataFrame:
    """Per symbol the forward return of the market after posts above and below the symbol's engagement quantile, with
    the pooled t statistic and its two-sided p-value.

    posts(symbol, timestamp, engagement), market(symbol, timestamp, close): entry is the first bar of the symbol at or
    after a post, exit the first one ``hours`` later.
    """
    rows = posts.withColumn("leave", F.timestamp_seconds(F.unix_seconds("timestamp") + hours * 3600))
    bars = market.select("symbol", F.col("timestamp").alias("bar"), "close")
    entered = as_of(rows, bars.withColumnRenamed("close", "p0"), ["symbol"], F.col("timestamp"), F.col("bar"), ["p0"], forward=True)
    left = as_of(entered, bars.withColumnRenamed("close", "p1"), ["symbol"], F.col("leave"), F.col("bar"), ["p1"], forward=True)
    cut = rows.groupBy("symbol").agg(F.percentile("engagement", F.lit(share)).alias("cut"))
    both = left.where("p0 is not null and p1 is not null").join(cut, "symbol").withColumn("r", F.col("p1") / F.col("p0") - 1)
    high = F.col("engagement") >= F.col("cut")
    pick = lambda c: F.when(c, F.col("r"))
    s = both.groupBy("symbol").agg(*[f.alias(n) for n, f in {"n_high": F.count(pick(high)), "n_low": F.count(pick(~high)), "mean_high": F.avg(pick(high)), "mean_low": F.avg(pick(~high)), "std_high": F.stddev_pop(pick(high)), "std_low": F.stddev_pop(pick(~high)), "v_high": F.var_samp(pick(high)), "v_low": F.var_samp(pick(~high)), "positive_high": F.avg((pick(high) > 0).cast("double")), "positive_low": F.avg((pick(~high) > 0).cast("double"))}.items()])
    pooled = F.try_divide((F.col("n_high") - 1) * F.col("v_high") + (F.col("n_low") - 1) * F.col("v_low"), F.col("n_high") + F.col("n_low") - 2)
    s = s.withColumn("t_statistic", F.try_divide(F.col("mean_high") - F.col("mean_low"), F.sqrt(pooled * (F.try_divide(F.lit(1), F.col("n_high")) + F.try_divide(F.lit(1), F.col("n_low"))))))
    return s.withColumn("p_value", t_test_p(F.col("t_statistic"), F.col("n_high") + F.col("n_low") - 2)).drop("v_high", "v_low")


def collinear_pairs(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    return pairs.where(F.abs("r") > threshold).orderBy(F.abs("r").desc(), "a", "b")


def variance_inflation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """1 / (1 - R^2) of each column on the others: the diagonal of the inverse correlation matrix (k x k numbers)."""
    import numpy as np

    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    full = df.na.drop(subset=list(cols))
    row = full.agg(*[F.corr(cols[i], cols[j]).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]).first()
    m = np.eye(len(cols))
    for k, (i, j) in enumerate(pairs):
        m[i, j] = m[j, i] = row[k] if row[k] is not None else 0.0
    vif = np.diag(np.linalg.pinv(m))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, vif, strict=True)], "feature string, vif double")


def constant_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns with at most one value."""
    row = df.agg(*[(F.min(c).eqNullSafe(F.max(c))).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def sessions(df: DataFrame) -> DataFrame:
    """Session by UTC hour, weekend, days to the end of the month."""
    hour = F.pmod(F.floor(F.unix_seconds("timestamp") / 3600), F.lit(24))
    day = F.to_date(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("timestamp") / 86400).cast("int")))
    return df.withColumn("session", F.when(hour < 8, "asia").when(hour < 16, "europe").otherwise("america")).withColumn("days_to_month_end", F.datediff(F.last_day(day), day)).withColumn("month_end", (F.datediff(F.last_day(day), day) <= 2).cast("int"))


def hour_of_day_volatility(df: DataFrame, vol: str) -> DataFrame:
    """Volatility against the mean of earlier values at the same hour: no value of the future is used."""
    hour = F.pmod(F.floor(F.unix_seconds("timestamp") / 3600), F.lit(24))
    w = Window.partitionBy("symbol", "_h").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_h", hour).withColumn("vol_vs_hour", F.try_divide(F.col(vol), F.avg(vol).over(w))).drop("_h")


def sector_momentum(df: DataFrame, sector: str, n: int = 6) -> DataFrame:
    """Mean return of a sector per timestamp and its rolling mean."""
    rows = df.withColumn("_r", change(F.col("close"), 1, ordered())).where("_r is not null")
    each = rows.groupBy(F.col(sector).alias("symbol"), "timestamp").agg(F.avg("_r").alias("sector_return"), F.count(F.lit(1)).alias("n_symbols"))
    return each.withColumn("sector_momentum", roll(F.avg, F.col("sector_return"), n, ordered()))


def reference_spread(df: DataFrame, symbol: str) -> DataFrame:
    """Per timestamp: the reference symbol's return less the mean of the others."""
    rows = df.withColumn("_r", change(F.col("close"), 1, ordered()))
    return rows.groupBy("timestamp").agg((F.max(F.when(F.col("symbol") == symbol, F.col("_r"))) - F.avg(F.when(F.col("symbol") != symbol, F.col("_r")))).alias("reference_spread"))


def carry_forward(df: DataFrame, rates: DataFrame, value: str) -> DataFrame:
    """The last known value (a funding rate) at or before each bar."""
    return as_of(df, rates.withColumnRenamed("timestamp", "_rt"), ["symbol"], F.col("timestamp"), F.col("_rt"), [value])


def reference_correlation(df: DataFrame, symbol: str, least: int = 30, fallback: float = 0.9) -> DataFrame:
    """Correlation of each symbol's returns with the reference's over the table; the fallback below ``least`` pairs."""
    rows = df.withColumn("_r", change(F.col("close"), 1, ordered())).where("_r is not null")
    ref = rows.where(F.col("symbol") == symbol).select("timestamp", F.col("_r").alias("_m"))
    each = rows.join(ref, "timestamp").groupBy("symbol").agg(F.corr("_r", "_m").alias("_c"), F.count(F.lit(1)).alias("n_pairs"))
    return each.select("symbol", "n_pairs", F.when(F.col("symbol") == symbol, 1.0).when(F.col("n_pairs") >= least, F.coalesce("_c", F.lit(fallback))).otherwise(fallback).alias("correlation"))


def correlated_exposure(values: DataFrame, correlation: DataFrame) -> DataFrame:
    """Sum of position value times its correlation with the reference."""
    return values.join(correlation, "symbol").agg(F.sum(F.col("value") * F.col("correlation")).alias("correlated_exposure"), F.sum("value").alias("exposure"))
