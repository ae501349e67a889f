"""Further technical indicators; exponential ones run on the affine scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import change, ewma, ewmas, logarithm, ordered, quotient, roll, span_alpha


def _flag(cond) -> F.Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def rsi_exponential(df: DataFrame, ns: tuple[int, ...] = (6, 14)) -> DataFrame:
    """RSI of exponential means (span n) of gains and losses, from the first row on; null while there is no loss."""
    step = F.col("close") - F.lag("close").over(ordered())
    rows = df.withColumn("_g", F.when(step > 0, step).otherwise(0.0)).withColumn("_l", F.when(step < 0, -step).otherwise(0.0))
    rows = ewmas(rows, {f"_{k}{n}": (F.col(f"_{k}"), span_alpha(n), 1) for n in ns for k in "gl"})
    rows = rows.withColumns({f"rsi_exp_{n}": 100 - 100 / (1 + F.try_divide(f"_g{n}", f"_l{n}")) for n in ns}).drop("_g", "_l", *[f"_{k}{n}" for n in ns for k in "gl"])
    return rows.withColumn("rsi_oversold", _flag(F.col(f"rsi_exp_{ns[-1]}") < 30)).withColumn("rsi_overbought", _flag(F.col(f"rsi_exp_{ns[-1]}") > 70))


def rsi_divergence(df: DataFrame, rsi: str, n: int = 5) -> DataFrame:
    """-1: the price rose and the index did not; 1: the index rose and the price did not; unknown changes are no rise."""
    w = ordered()
    price, index = (F.coalesce(F.col(c) - F.lag(c, n).over(w) > 0, F.lit(False)) for c in ("close", rsi))
    return df.withColumn("_p", price).withColumn("_i", index).withColumn("rsi_divergence", F.col("_i").cast("int") - F.col("_p").cast("int")).drop("_p", "_i")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, of: str = "close", prefix: str = "macd") -> DataFrame:
    rows = ewmas(df, {"_f": (F.col(of), span_alpha(fast), 1), "_s": (F.col(of), span_alpha(slow), 1)})
    rows = rows.withColumn(prefix, F.col("_f") - F.col("_s")).drop("_f", "_s")
    rows = ewma(rows, F.col(prefix), span_alpha(signal), f"{prefix}_signal")
    rows = rows.withColumn(f"{prefix}_histogram", F.col(prefix) - F.col(f"{prefix}_signal"))
    w = ordered()
    above = F.col(prefix) > F.col(f"{prefix}_signal")
    rows = rows.withColumn("_above", above).withColumn("_was", F.lag("_above", 1).over(w))
    cross = F.when(F.col("_above") & ~F.coalesce("_was", F.lit(False)), 1).when(~F.col("_above") & F.coalesce("_was", F.lit(True)), -1).otherwise(0)
    return rows.withColumn(f"{prefix}_crossover", cross).withColumn(f"{prefix}_rising", _flag(F.col(f"{prefix}_histogram") > F.lag(f"{prefix}_histogram").over(w))).drop("_above", "_was")


def stochastic(df: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    w = ordered()
    low, high = roll(F.min, F.col("low"), n, w), roll(F.max, F.col("high"), n, w)
    rows = df.withColumn("stoch_k", 100 * F.try_divide(F.col("close") - low, high - low))
    rows = rows.withColumn("stoch_d", roll(F.avg, F.col("stoch_k"), d, w))
    return rows.withColumn("stoch_oversold", _flag(F.col("stoch_k") < 20)).withColumn("stoch_overbought", _flag(F.col("stoch_k") > 80))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    w = ordered()
    rows = df.withColumn("_m", roll(F.avg, F.col("close"), n, w)).withColumn("_sd", roll(F.stddev_samp, F.col("close"), n, w))
    up, low = F.col("_m") + k * F.col("_sd"), F.col("_m") - k * F.col("_sd")
    rows = rows.withColumn("bb_percent", F.try_divide(F.col("close") - low, up - low)).withColumn("bb_bandwidth", F.try_divide(up - low, F.col("_m")))
    rows = rows.withColumn("bb_squeeze", _flag(F.col("bb_bandwidth") <= 1.1 * roll(F.min, F.col("bb_bandwidth"), n, w)))
    return rows.withColumn("bb_above", _flag(F.col("close") > up)).withColumn("bb_below", _flag(F.col("close") < low)).drop("_m", "_sd")


def true_range(df: DataFrame) -> DataFrame:
    before = F.lag("close").over(ordered())
    return df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(df: DataFrame, ns: tuple[int, ...] = (7, 14)) -> DataFrame:
    """Exponential means (span n) of the true range, as shares of the close, expansion and contraction of the last."""
    rows = ewmas(true_range(df), {f"atr_{n}": (F.col("true_range"), span_alpha(n), 1) for n in ns})
    rows = rows.withColumns({f"atr_{n}_percent": F.try_divide(f"atr_{n}", "close") for n in ns})
    last = F.col(f"atr_{ns[-1]}")
    mean = roll(F.avg, last, 20, ordered())
    return rows.withColumn("atr_expansion", _flag(last > 1.5 * mean)).withColumn("atr_contraction", _flag(last < 0.7 * mean))


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Directional index (span n), strength 0, 1, 2 (up to 20, 40, 100), direction where it is above 20."""
    w = ordered()
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    rows = true_range(df).withColumn("_up", F.when((up > down) & (up > 0), up).otherwise(0.0)).withColumn("_dn", F.when((down > up) & (down > 0), down).otherwise(0.0))
    rows = ewmas(rows, {out: (F.col(x), span_alpha(n), 1) for x, out in (("true_range", "_atr"), ("_up", "_pu"), ("_dn", "_pd"))})
    rows = rows.withColumn("plus_di", 100 * F.try_divide("_pu", "_atr")).withColumn("minus_di", 100 * F.try_divide("_pd", "_atr"))
    rows = rows.withColumn("_dx", 100 * F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    rows = ewma(rows, F.col("_dx"), span_alpha(n), "adx")
    rows = rows.withColumn("adx", F.when(F.col("adx") > 100, 100.0).otherwise(F.col("adx")))  # rounding may pass 100
    strength = F.when(F.col("adx") <= 0, None).when(F.col("adx") <= 20, 0.0).when(F.col("adx") <= 40, 1.0).when(F.col("adx") <= 100, 2.0)
    strong = F.col("adx") > 20
    rows = rows.withColumn("trend_strength", strength).withColumn("adx_bullish", _flag((F.col("plus_di") > F.col("minus_di")) & strong)).withColumn("adx_bearish", _flag((F.col("minus_di") > F.col("plus_di")) & strong))
    return rows.drop("_up", "_dn", "_atr", "_pu", "_pd", "_dx", "true_range")


def moving_averages(df: DataFrame) -> DataFrame:
    """Simple and exponential means, the close against them, crosses, and (SMA 20 - SMA 50) / close."""
    w = ordered()
    rows = ewmas(df, {f"ema_{n}": (F.col("close"), span_alpha(n), 1) for n in (12, 26)})
    for n in (10, 20, 50):
        rows = rows.withColumn(f"sma_{n}", roll(F.avg, F.col("close"), n, w))
    rows = rows.withColumns({f"close_vs_sma_{n}": F.try_divide(F.col("close") - F.col(f"sma_{n}"), F.col(f"sma_{n}")) for n in (10, 20, 50)})
    rows = rows.withColumns({f"above_sma_{n}": _flag(F.col("close") > F.col(f"sma_{n}")) for n in (20, 50)}).withColumn("ma_spread", F.try_divide(F.col("sma_20") - F.col("sma_50"), F.col("close")))
    above = F.col("sma_20") > F.col("sma_50")
    rows = rows.withColumn("_a", F.coalesce(above, F.lit(False))).withColumn("_w", F.lag("_a").over(w))
    return rows.withColumn("golden_cross", _flag(F.col("_a") & ~F.coalesce("_w", F.lit(True)))).withColumn("death_cross", _flag(~F.col("_a") & F.coalesce("_w", F.lit(False)))).drop("_a", "_w")


def taker_ratio(df: DataFrame, bought: str = "taker_buy_volume", n: int = 20) -> DataFrame:
    """Share of the volume that takers bought and its mean; df as it is if it has no such column."""
    if bought not in df.columns:
        return df
    rows = df.withColumn("taker_buy_ratio", F.try_divide(F.col(bought), F.col("volume")))
    return rows.withColumn("taker_buy_ratio_mean", roll(F.avg, F.col("taker_buy_ratio"), n, ordered()))


def annual_volatility(df: DataFrame, ns: tuple[int, ...] = (6, 12, 24, 72), hours: float = 8760.0) -> DataFrame:
    """Sample deviation of the returns in n bars, a year's, and the shortest against the longest."""
    w = ordered()
    rows = df.withColumn("_r", change(F.col("close"), 1, w))
    rows = rows.withColumns({f"annual_volatility_{n}": roll(F.stddev_samp, F.col("_r"), n, w) * F.sqrt(F.lit(hours)) for n in ns}).drop("_r")
    return rows.withColumn("volatility_ratio", F.try_divide(f"annual_volatility_{ns[0]}", f"annual_volatility_{ns[-1]}"))


def volume_indicators(df: DataFrame, n: int = 20) -> DataFrame:
    w = ordered()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("volume_ratio_20", F.try_divide(F.col("volume"), roll(F.avg, F.col("volume"), n, w)))
    rows = rows.withColumn("volume_spike", _flag(F.col("volume_ratio_20") > 2))
    step = F.signum(F.col("close") - F.lag("close").over(w))
    rows = rows.withColumn("_s", F.col("volume") * step).withColumn("_v", F.col("volume") * change(F.col("close"), 1, w))
    rows = rows.withColumn("obv", F.sum("_s").over(running)).withColumn("volume_price_trend", F.sum("_v").over(running))
    rows = rows.withColumn("obv_rising", _flag(F.col("obv") > roll(F.avg, F.col("obv"), n, w))).drop("_s", "_v")
    rows = rows.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    move = F.col("_tp") - F.lag("_tp").over(w)
    flow = F.col("_tp") * F.col("volume")
    rows = rows.withColumn("_pos", F.when(move > 0, flow).otherwise(0.0)).withColumn("_neg", F.when(move < 0, flow).otherwise(0.0))
    mfi = 100 - 100 / (1 + F.try_divide(roll(F.sum, F.col("_pos"), 14, w), roll(F.sum, F.col("_neg"), 14, w)))
    return rows.withColumn("mfi_14", mfi).drop("_tp", "_pos", "_neg")


def price_action(df: DataFrame) -> DataFrame:
    w = ordered()
    span = F.col("high") - F.col("low")
    rows = df.withColumn("body_percent", F.try_divide(F.col("close") - F.col("open"), span))
    rows = rows.withColumn("upper_wick", F.try_divide(F.col("high") - F.greatest("open", "close"), span)).withColumn("lower_wick", F.try_divide(F.least("open", "close") - F.col("low"), span))
    rows = rows.withColumn("doji", _flag(F.abs(F.col("body_percent")) < 0.1)).withColumn("momentum_up", _flag(F.col("body_percent") > 0.7)).withColumn("momentum_down", _flag(F.col("body_percent") < -0.7))
    high, low = roll(F.max, F.col("high"), 24, w), roll(F.min, F.col("low"), 24, w)
    return rows.withColumn("below_24h_high", F.try_divide(high - F.col("close"), F.col("close"))).withColumn("above_24h_low", F.try_divide(F.col("close") - low, F.col("close")))


def vol_regime(df: DataFrame, n: int = 24, back: int = 168) -> DataFrame:
    """Volatility (sample deviation of returns) and its average rank in the last values, 24 at least."""
    w = ordered()
    rows = df.withColumn("_r", change(F.col("close"), 1, w)).withColumn("vol_24", roll(F.stddev_samp, F.col("_r"), n, w))
    frame = F.collect_list("vol_24").over(w.rowsBetween(1 - back, 0))
    less, same = F.size(F.filter(frame, lambda x: x < F.col("vol_24"))), F.size(F.filter(frame, lambda x: x == F.col("vol_24")))
    rank = (less + (same + 1) / 2) / F.size(frame)
    rows = rows.withColumn("vol_rank", F.when((F.size(frame) >= 24) & F.col("vol_24").isNotNull(), rank)).drop("_r")
    return rows.withColumn("vol_state", F.when(F.col("vol_rank") <= 0.25, "low").when(F.col("vol_rank") <= 0.75, "normal").when(F.col("vol_rank").isNotNull(), "high"))


def range_volatility(df: DataFrame, n: int = 24) -> DataFrame:
    """Parkinson and Garman-Klass volatility; prices of 0 make them infinite or NaN."""
    w = ordered()
    hl, co = (F.pow(logarithm(quotient(F.col(a), F.col(b))), 2) for a, b in (("high", "low"), ("close", "open")))
    import math

    rows = df.withColumn("parkinson", F.sqrt(roll(F.avg, hl, n, w) / (4 * math.log(2))))
    return rows.withColumn("garman_klass", F.sqrt(F.greatest(roll(F.avg, 0.5 * hl - (2 * math.log(2) - 1) * co, n, w), F.lit(0.0))))


def versus_reference(df: DataFrame, symbol: str, n: int = 24) -> DataFrame:
    """Rolling correlation, beta and idiosyncratic return against a reference symbol, on equal timestamps."""
    w = ordered()
    rows = df.withColumn("_r", change(F.col("close"), 1, w))
    ref = rows.where(F.col("symbol") == symbol).select("timestamp", F.col("_r").alias("_m"))
    both = rows.join(ref, "timestamp")
    frame = w.rowsBetween(1 - n, 0)
    full = F.count(F.when(F.col("_r").isNotNull() & F.col("_m").isNotNull(), 1)).over(frame) == n
    both = both.withColumn("ref_corr", F.when(full, F.corr("_r", "_m").over(frame))).withColumn("ref_beta", F.when(full, F.try_divide(F.covar_pop("_r", "_m").over(frame), F.var_pop("_m").over(frame))))
    return both.withColumn("idiosyncratic", F.col("_r") - F.col("ref_beta") * F.col("_m")).drop("_r", "_m")


def breadth(df: DataFrame) -> DataFrame:
    """Per timestamp: symbols, mean return, share of rising symbols."""
    rows = df.withColumn("_r", change(F.col("close"), 1, ordered())).where("_r is not null")
    return rows.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n_symbols"), F.avg("_r").alias("market_return"), F.avg((F.col("_r") > 0).cast("double")).alias("breadth"))
