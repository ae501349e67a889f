"""Signals to trades, equity and performance as window queries; benchmarks and metrics per run.

All-in or all-out with fills at the next bar's open; the last bar's signal is ignored and an open position is closed
at the last close. ``keys`` name what separates runs (symbol, fold, threshold, ...): a grid is one query.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import logarithm, ordered, quotient

FEE, SLIPPAGE, CAPITAL = 0.001, 0.0005, 10_000.0


def _costs(fee: float, slip: float) -> tuple[float, float]:
    """What a price is multiplied by in buying and in selling: products of decimals, rounded once."""
    fee_, slip_ = Decimal(str(fee)), Decimal(str(slip))
    return float((1 + slip_) * (1 + fee_)), float((1 - slip_) * (1 - fee_))


def to_signal(df: DataFrame, threshold: float = 0.5, probability: str = "probability") -> DataFrame:
    return df.withColumn("signal", (F.col(probability) >= threshold).cast("int"))


def to_action(df: DataFrame, enter: float, leave: float, least: float, probability: str = "probability") -> DataFrame:
    """BUY, SELL or HOLD with a confidence (distance from 0.5, doubled); below ``least`` it is HOLD."""
    p = F.col(probability)
    sure = F.abs(p - 0.5) * 2
    return df.withColumn("confidence", sure).withColumn("action", F.when(sure < least, "HOLD").when(p >= enter, "BUY").when(p <= leave, "SELL").otherwise("HOLD"))


def _positions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = ordered(keys)
    rows = df.withColumn("_last", F.lead("timestamp").over(w).isNull())
    held = F.when(F.col("_last"), F.coalesce(F.lag("signal").over(w), F.lit(0))).otherwise(F.greatest(F.lit(0), F.least(F.lit(1), F.coalesce("signal", F.lit(0)))))
    rows = rows.withColumn("_pos", held.cast("int")).withColumn("_open1", F.lead("open").over(w))
    return rows.withColumn("_prev", F.coalesce(F.lag("_pos").over(w), F.lit(0)))


def equity(df: DataFrame, keys: Sequence[str] = ("symbol",), fee: float = FEE, slip: float = SLIPPAGE, capital: float = CAPITAL) -> DataFrame:
    """keys, timestamp, position, cash, quantity, equity (after the cost of selling), exposure per bar."""
    w = ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = _positions(df, keys)
    bought, sold = _costs(fee, slip)
    buy, sell = F.col("_open1") * bought, F.col("_open1") * sold
    moved = F.col("_pos") - F.col("_prev")
    factor = F.when(F.col("_last"), 1.0).when(moved > 0, 1 / buy).when(moved < 0, sell).otherwise(1.0)
    rows = rows.withColumn("_w", capital * F.product(factor).over(w))
    out = F.col("close") * sold
    long_ = F.col("_pos") == 1
    rows = rows.withColumn("quantity", F.when(long_ & ~F.col("_last"), F.col("_w")).otherwise(0.0)).withColumn("cash", F.when(~long_, F.col("_w")).when(F.col("_last"), F.col("_w") * out).otherwise(0.0))
    rows = rows.withColumn("equity", F.when(long_, F.col("_w") * out).otherwise(F.col("_w"))).withColumn("exposure", F.when(long_ & ~F.col("_last"), 1.0).otherwise(0.0))
    return rows.select(*keys, "timestamp", F.col("_pos").alias("position"), "cash", "quantity", "equity", "exposure", "close")


def trades(df: DataFrame, keys: Sequence[str] = ("symbol",), fee: float = FEE, slip: float = SLIPPAGE, capital: float = CAPITAL) -> DataFrame:
    """One row per fill: side, price, quantity, notional, fee, slippage cost, reason."""
    w = ordered(keys)
    rows = _positions(df, keys)
    moved = F.col("_pos") - F.col("_prev")
    raw = F.when(F.col("_last"), F.col("close")).otherwise(F.col("_open1"))
    side = F.when(F.col("_last") & (F.col("_pos") == 1), "SELL").when(~F.col("_last") & (moved > 0), "BUY").when(~F.col("_last") & (moved < 0), "SELL")
    rows = rows.withColumn("side", side).withColumn("_raw", raw).where("side is not null")
    buying = F.col("side") == "BUY"
    rows = rows.withColumn("price", F.col("_raw") * F.when(buying, 1 + slip).otherwise(1 - slip))
    bought, sold = _costs(fee, slip)
    factor = F.when(buying, 1 / (F.col("_raw") * bought)).otherwise(F.col("_raw") * sold)
    rows = rows.withColumn("_w", capital * F.product(factor).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("quantity", F.when(buying, F.col("_w")).otherwise(F.lag("_w").over(w)))
    rows = rows.withColumn("notional", F.col("quantity") * F.col("price")).withColumn("fee", F.col("notional") * fee).withColumn("slippage", F.col("quantity") * F.col("_raw") * slip)
    return rows.select(*keys, "timestamp", "side", "price", "quantity", "notional", "fee", "slippage", F.when(F.col("_last"), "final_close").otherwise("signal").alias("reason"))


def round_trips(fills: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Every buy with the sell after it: pnl after fees, return, hours."""
    w = ordered(keys)
    rows = fills.withColumn("_n", F.lead("notional").over(w)).withColumn("_f", F.lead("fee").over(w)).withColumn("exit_time", F.lead("timestamp").over(w)).withColumn("exit_reason", F.lead("reason").over(w))
    cost, gain = F.col("notional") + F.col("fee"), F.col("_n") - F.col("_f")
    return rows.where("side = 'BUY'").select(*keys, F.col("timestamp").alias("entry_time"), "exit_time", "exit_reason", (gain - cost).alias("pnl"), (gain / cost - 1).alias("return"), ((F.unix_seconds("exit_time") - F.unix_seconds("timestamp")) / 3600).alias("hours"))


def drawdown(df: DataFrame, keys: Sequence[str] = ("symbol",), of: str = "equity") -> DataFrame:
    top = F.max(of).over(ordered(keys).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("drawdown", F.col(of) / top - 1)


def metrics(eq: DataFrame, fills: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Total and annualised return, drawdown, Sharpe, fills, win rate, profit factor, turnover, costs, exposure.

    Returns and turnover are against the first equity value; trades are fills; win rate, mean return and profit factor
    (null without losses) are of the round trips' returns."""
    w = ordered(keys)
    rows = drawdown(eq, keys).withColumn("_r", F.col("equity") / F.lag("equity").over(w) - 1)
    a = rows.groupBy(*keys).agg(
        F.max_by("equity", "timestamp").alias("_end"), F.min_by("equity", "timestamp").alias("_start"), F.min("drawdown").alias("max_drawdown"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_sd"), F.avg("exposure").alias("exposure"),
        ((F.max(F.unix_seconds("timestamp")) - F.min(F.unix_seconds("timestamp"))) / 3600).alias("_h"),
    )
    total = F.col("_end") / F.col("_start")
    a = a.select(
        *keys, "_start", (total - 1).alias("total_return"), F.when((F.col("_h") >= 24) & (total > 0), F.pow(total, 8766 / F.col("_h")) - 1).alias("annual_return"),
        "max_drawdown", F.when(F.col("_sd") > 0, F.col("_m") / F.col("_sd") * F.sqrt(F.lit(8766.0))).alias("sharpe"), "exposure",
    )
    b = fills.groupBy(*keys).agg(F.sum("notional").alias("_notional"), F.sum("fee").alias("fees"), F.sum("slippage").alias("slippage_cost"), F.count(F.lit(1)).alias("n_trades"))
    r = F.col("return")
    c = round_trips(fills, keys).groupBy(*keys).agg(
        F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("mean_trade_return"), F.try_divide(F.sum(F.when(r > 0, r).otherwise(0.0)), F.nullif(-F.sum(F.when(r < 0, r).otherwise(0.0)), F.lit(0.0))).alias("profit_factor")
    )
    rows = a.join(b, list(keys), "left").join(c, list(keys), "left").na.fill(0.0, ["_notional", "fees", "slippage_cost"]).na.fill(0, ["n_trades"])
    return rows.withColumn("turnover", F.col("_notional") / F.col("_start")).drop("_notional", "_start")


def run_metrics(df: DataFrame, keys: Sequence[str] = ("symbol",), fee: float = FEE, slip: float = SLIPPAGE, capital: float = CAPITAL) -> DataFrame:
    """The metrics of every run straight from its bars and signals: positions, wealth, fills and round trips are columns
    of one windowed pass, and one aggregation by the same keys follows, so a grid costs one shuffle and one sort."""
    w = ordered(keys)
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = _positions(df, keys)
    last, moved, held = F.col("_last"), F.col("_pos") - F.col("_prev"), F.col("_pos") == 1
    out = (1 - slip) * (1 - fee)
    factor = F.when(last, 1.0).when(moved > 0, 1 / (F.col("_open1") * (1 + slip) * (1 + fee))).when(moved < 0, F.col("_open1") * out).otherwise(1.0)
    side = F.when(last & held, -1).when(~last & (moved > 0), 1).when(~last & (moved < 0), -1)
    rows = rows.withColumn("_w", capital * F.product(factor).over(until)).withColumn("_side", side)
    rows = rows.withColumn("_raw", F.when(last, F.col("close")).otherwise(F.col("_open1"))).withColumn("_q", F.when(F.col("_side") > 0, F.col("_w")).when(F.col("_side") < 0, F.lag("_w").over(w)))
    rows = rows.withColumn("_notional", F.col("_q") * F.col("_raw") * (1 + slip * F.col("_side"))).withColumn("_equity", F.when(held, F.col("_w") * F.col("close") * out).otherwise(F.col("_w")))
    bought = F.last(F.when(F.col("_side") > 0, F.col("_notional")), ignorenulls=True).over(until)
    rows = rows.withColumn("_trip", F.when(F.col("_side") < 0, F.col("_notional") * (1 - fee) / (bought * (1 + fee)) - 1)).withColumn("_dd", F.col("_equity") / F.max("_equity").over(until) - 1).withColumn("_r", F.col("_equity") / F.lag("_equity").over(w) - 1)
    trip = F.col("_trip")
    a = rows.groupBy(*keys).agg(
        F.max_by("_equity", "timestamp").alias("_end"), F.min_by("_equity", "timestamp").alias("_start"), F.min("_dd").alias("max_drawdown"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_sd"), F.avg((held & ~last).cast("double")).alias("exposure"),
        ((F.max(F.unix_seconds("timestamp")) - F.min(F.unix_seconds("timestamp"))) / 3600).alias("_h"), F.coalesce(F.sum("_notional"), F.lit(0.0)).alias("_notional"), F.coalesce(F.sum(F.col("_q") * F.col("_raw") * slip), F.lit(0.0)).alias("slippage_cost"), F.count("_side").alias("n_trades"),
        F.avg((trip > 0).cast("double")).alias("win_rate"), F.avg(trip).alias("mean_trade_return"), F.try_divide(F.sum(F.when(trip > 0, trip).when(trip <= 0, 0.0)), F.nullif(-F.sum(F.when(trip < 0, trip)), F.lit(0.0))).alias("profit_factor"),
    )
    total = F.col("_end") / F.col("_start")
    return a.select(
        *keys, (total - 1).alias("total_return"), F.when((F.col("_h") >= 24) & (total > 0), F.pow(total, 8766 / F.col("_h")) - 1).alias("annual_return"), "max_drawdown", F.when(F.col("_sd") > 0, F.col("_m") / F.col("_sd") * F.sqrt(F.lit(8766.0))).alias("sharpe"), "exposure",
        (F.col("_notional") * fee).alias("fees"), "slippage_cost", "n_trades", "win_rate", "mean_trade_return", "profit_factor", (F.col("_notional") / F.col("_start")).alias("turnover"),
    )


def check_ledger_input(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """keys, rule, n: runs with fewer than two rows, timestamps that are missing or not unique."""
    each = df.groupBy(*keys, "timestamp").agg(F.count(F.lit(1)).alias("_n"))
    rows = each.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.sum(F.when(F.col("timestamp").isNull(), F.col("_n")).otherwise(0)).alias("missing"), F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1).otherwise(0)).alias("repeated"))
    rules = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("rule"), n.alias("n"))) for name, cond, n in (("too_few_rows", F.col("rows") < 2, F.col("rows")), ("missing_timestamp", F.col("missing") > 0, F.col("missing")), ("repeated_timestamp", F.col("repeated") > 0, F.col("repeated")))]))
    return rows.select(*keys, F.explode(rules).alias("_r")).select(*keys, "_r.*")


def join_predictions(market: DataFrame, predictions: DataFrame, on: Sequence[str] = ("timestamp",)) -> DataFrame:
    """market with the predictions' signal: 0 where there is none, clipped to 0 and 1."""
    rows = market.drop("signal").join(predictions.select(*on, "signal"), list(on), "left")
    return rows.withColumn("signal", F.greatest(F.lit(0), F.least(F.lit(1), F.coalesce("signal", F.lit(0)))).cast("int"))


def trading_statistics(eq: DataFrame, trips: DataFrame, keys: Sequence[str] = ("symbol",), bars: float = 6048.0, capital: float = CAPITAL) -> DataFrame:
    """Sharpe and Sortino on ``bars`` a year, Calmar, mean win and loss, hours held. Ratios that would be infinite are
    null and flagged (no_downside, no_drawdown, no_losses). Returns above -1e-12 are rounding and no losses."""
    rows = drawdown(eq, keys).withColumn("_r", F.col("equity") / F.lag("equity").over(ordered(keys)) - 1)
    a = rows.groupBy(*keys).agg(F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_sd"), F.stddev_samp(F.when(F.col("_r") < -1e-12, F.col("_r"))).alias("_dd"), F.min("drawdown").alias("_low"), F.max_by("equity", "timestamp").alias("_end"))
    varies, year = F.coalesce(F.col("_sd") > 0, F.lit(False)), bars**0.5
    a = a.select(
        *keys, F.when(varies, F.col("_m") / F.col("_sd") * year).otherwise(0.0).alias("sharpe"), F.when(~varies, 0.0).when(F.col("_dd") > 0, F.col("_m") / F.col("_dd") * year).alias("sortino"), (-F.col("_low")).alias("max_drawdown"),
        F.when(F.col("_low") < 0, (F.col("_end") / capital - 1) / -F.col("_low")).alias("calmar"), (varies & ~F.coalesce(F.col("_dd") > 0, F.lit(False))).cast("int").alias("no_downside"), (F.col("_low") >= 0).cast("int").alias("no_drawdown"),
    )
    p = F.col("pnl")
    b = trips.groupBy(*keys).agg(F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("mean_win"), F.coalesce(F.avg(F.when(p <= 0, p)), F.lit(0.0)).alias("mean_loss"), F.avg("hours").alias("mean_hours"), F.try_divide(F.sum(F.when(p > 0, p).otherwise(0.0)), F.nullif(-F.sum(F.when(p <= 0, p).otherwise(0.0)), F.lit(0.0))).alias("profit_factor"))
    return a.join(b, list(keys), "left").withColumn("no_losses", F.isnull("profit_factor").cast("int"))


def compare_runs(named: dict[str, DataFrame], keys: Sequence[str] = ("symbol",), capital: float = CAPITAL) -> DataFrame:
    """The metrics of several strategies below each other, with the value that ``capital`` grows to and the difference to
    the first one's total return."""
    first = next(iter(named))
    rows = None
    for name, df in named.items():
        own = df.select(*keys, F.lit(name).alias("strategy"), "total_return", "max_drawdown", "sharpe", "n_trades", "win_rate", "profit_factor", (capital * (1 + F.col("total_return"))).alias("final_value"))
        rows = own if rows is None else rows.unionByName(own)
    base = F.max(F.when(F.col("strategy") == first, F.col("total_return"))).over(Window.partitionBy(*keys))
    return rows.withColumn("excess_return", F.col("total_return") - base)


def symbol_breakdown(trips: DataFrame) -> DataFrame:
    """Trades, profit and win rate per symbol, with the rank by total profit."""
    rows = trips.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("mean_pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("total_pnl").desc(), "symbol")))  # one row per symbol


def benchmark_signals(df: DataFrame, lookback: int = 24) -> DataFrame:
    """The rows once per benchmark: cash, buy_and_hold, momentum."""
    trail = F.col("close") / F.lag("close", lookback).over(ordered()) - 1
    rows = df.withColumn("_m", F.coalesce((trail > 0).cast("int"), F.lit(0)))
    kinds = F.explode(F.array(F.struct(F.lit("cash").alias("benchmark"), F.lit(0).alias("signal")), F.struct(F.lit("buy_and_hold").alias("benchmark"), F.lit(1).alias("signal")), F.struct(F.lit("momentum").alias("benchmark"), F.col("_m").alias("signal"))))
    return rows.withColumn("_k", kinds).select(*df.columns, "_k.*")


def buy_and_hold(df: DataFrame, fee: float = FEE, bars: float = 8766.0) -> DataFrame:
    """Closed form: first to last close with a fee on both sides; Sharpe of the closes' returns on ``bars`` a year (null
    where they do not vary) and their deepest drawdown."""
    w = ordered()
    rows = df.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1).withColumn("_d", F.col("close") / F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    spread = F.stddev_samp("_r")
    return rows.groupBy("symbol").agg((F.max_by("close", "timestamp") / F.min_by("close", "timestamp") * (1 - fee) * (1 - fee) - 1).alias("buy_hold_return"), F.when(spread > 0, F.avg("_r") / spread * bars**0.5).alias("sharpe"), F.min("_d").alias("max_drawdown"))


def equal_weight(df: DataFrame) -> DataFrame:
    """Mean return over the symbols per timestamp, compounded; a price of 0 makes the next return infinite (or NaN)."""
    rows = df.withColumn("_r", quotient(F.col("close"), F.lag("close").over(ordered())) - 1).where("_r is not null")
    mean = rows.groupBy("timestamp").agg(F.avg("_r").alias("r"), F.count(F.lit(1)).alias("n_symbols"))
    return mean.agg(F.count(F.lit(1)).alias("n_bars"), F.avg("r").alias("mean_return"), (F.exp(F.sum(logarithm(1 + F.col("r")))) - 1).alias("total_return"))


def exit_breakdown(trips: DataFrame, by: str = "exit_reason") -> DataFrame:
    return trips.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("mean_pnl"), F.avg("return").alias("mean_return"), F.avg("hours").alias("mean_hours"))


def monthly_returns(eq: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    month = eq.groupBy(*keys, F.date_format("timestamp", "yyyy-MM").alias("month")).agg(F.max_by("equity", "timestamp").alias("equity"))
    return month.withColumn("month_return", F.col("equity") / F.lag("equity").over(Window.partitionBy(*keys).orderBy("month")) - 1)


def trade_stats(trips: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return trips.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("return").alias("mean_return"), F.max("return").alias("best"), F.min("return").alias("worst"), F.avg("hours").alias("mean_hours"))


# Risk as table operators.


def size_orders(orders: DataFrame, capital: float, risk: float = 0.02, most: float = 0.1, target_vol: float = 0.02, base: float = 0.05, sure: tuple[float, float] = (0.55, 0.80)) -> DataFrame:
    """Sizes by fixed fraction, volatility, quarter Kelly and confidence; the least within the capacity, and its name.

    orders: volatility, win_rate, mean_win, mean_loss, confidence, capacity. Without a positive volatility the base size
    holds; Kelly inputs outside their ranges give 1 % of the capital; below the least confidence there is no position."""
    top = F.lit(capital * most)
    fixed = F.least(F.lit(capital * risk), top)
    vol = F.when(F.col("volatility") > 0, F.greatest(F.lit(0.01 * capital), F.least(capital * base * F.try_divide(F.lit(target_vol), F.col("volatility")), top))).otherwise(F.least(F.lit(capital * base), top))
    p, b = F.col("win_rate"), F.try_divide("mean_win", "mean_loss")
    valid = (p > 0) & (p < 1) & (F.col("mean_win") > 0) & (F.col("mean_loss") > 0)
    share = F.try_divide(p * b - (1 - p), b)
    kelly = F.when(F.coalesce(valid, F.lit(False)), F.when(share <= 0, 0.0).otherwise(capital * F.least(0.25 * share, F.lit(most)))).otherwise(min(capital * 0.01, capital * most))
    step = F.least((F.col("confidence") - sure[0]) / (sure[1] - sure[0]), F.lit(1.0))
    weighted = F.when(F.col("confidence") < sure[0], 0.0).otherwise(top * (0.25 + 0.75 * step))
    sizes = [("fixed", fixed), ("volatility", vol), ("kelly", kelly), ("confidence", weighted), ("capacity", F.col("capacity"))]
    best = F.array_min(F.array(*[F.struct(F.round(v, 8).alias("size"), F.lit(n).alias("limit")) for n, v in sizes]))
    return orders.withColumns({f"size_{n}": v for n, v in sizes[:-1]}).withColumn("_b", best).withColumn("size", F.col("_b.size")).withColumn("limited_by", F.col("_b.limit")).drop("_b")


def open_risk(positions: DataFrame) -> DataFrame:
    """Per position (side 1 or -1): profit so far, risk to the stop, potential to the take, reward for risk."""
    q, p, side = F.col("quantity"), F.col("price"), F.coalesce("side", F.lit(1))
    rows = positions.withColumns({"unrealized": q * (p - F.col("entry_price")) * side, "unrealized_percent": F.try_divide(p - F.col("entry_price"), F.col("entry_price")) * side, "risk_to_stop": q * (p - F.col("stop")) * side, "potential": q * (F.col("take") - p) * side})
    return rows.withColumn("reward_risk", F.when(F.col("risk_to_stop") > 0, F.col("potential") / F.col("risk_to_stop")))


def check_entries(candidates: DataFrame, snapshot: DataFrame, correlations: DataFrame, cash: float, reference: str, most_positions: int = 5, single: float = 0.2, total: float = 0.8, sector: float = 0.4, correlated: float = 0.6, unknown: float = 0.9) -> DataFrame:
    """candidates(symbol, sector, size) against the open positions (symbol, sector, value): the first limit that an
    entry would break, each candidate on its own; null: none.

    Limits are shares of what is there now, cash and positions. In this order: the number of positions, a position in the
    symbol already, all exposure, the position alone, its sector, and (but for the reference itself) exposure weighted by
    the correlation with the reference; correlations(symbol, correlation), ``unknown`` where there is none."""
    weight = F.coalesce("correlation", F.lit(unknown))
    weighted = snapshot.join(correlations, "symbol", "left")
    all_ = weighted.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("_value"), F.coalesce(F.sum(F.col("value") * weight), F.lit(0.0)).alias("_with"))
    by_sector = snapshot.groupBy("sector").agg(F.sum("value").alias("_sector"))
    held = snapshot.select("symbol").distinct().withColumn("_held", F.lit(True))
    rows = candidates.join(all_, how="cross").join(by_sector, "sector", "left").join(held, "symbol", "left").join(correlations, "symbol", "left")  # all_: one row
    share = lambda x: F.coalesce(F.try_divide(x, F.col("_value") + cash), F.lit(0.0))
    size = F.col("size")
    reason = (
        F.when(F.col("_n") >= most_positions, "positions").when(F.col("_held"), "duplicate").when(share(F.col("_value") + size) > total, "exposure").when(share(size) > single, "single")
        .when(share(F.coalesce("_sector", F.lit(0.0)) + size) > sector, "sector").when((F.col("symbol") != reference) & (share(F.col("_with") + size * weight) > correlated), "correlated")
    )
    return rows.withColumn("rejected_by", reason).select(*candidates.columns, "rejected_by")


def stop_levels(positions: DataFrame, stop: float = 0.05, multiple: float = 2.0, reward: float = 2.0, hours: float = 48) -> DataFrame:
    """Fixed and ATR levels around the entry, and the time at which a position is left whatever its price."""
    e, a = F.col("entry_price"), F.col("atr")
    levels = {"stop_fixed": e * (1 - stop), "take_fixed": e * (1 + stop * reward), "stop_atr": e - multiple * a, "take_atr": e + multiple * a * reward}
    entered = F.col("entry_time") if "entry_time" in positions.columns else F.col("timestamp")
    return positions.withColumns(levels | {"time_limit": F.timestamp_seconds(F.unix_seconds(entered) + int(hours * 3600))})


def trailing_stop(df: DataFrame, keys: Sequence[str], activate: float = 0.02, trail: float = 0.03) -> DataFrame:
    """Ratchet from the running high once it is ``activate`` above entry; it never falls."""
    w = ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_top", F.max("high").over(w))
    level = F.when(F.col("_top") >= F.col("entry_price") * (1 + activate), F.col("_top") * (1 - trail))
    return rows.withColumn("_l", level).withColumn("trailing_stop", F.max("_l").over(w)).drop("_top", "_l")


def evaluate_exits(positions: DataFrame, max_hours: float = 48, min_hours: float = 1) -> DataFrame:
    """positions with price, stop, take, hours, signal: the first reason in order of priority."""
    p = F.col("price")
    reason = F.when(p <= F.col("stop"), "stop_loss").when(p >= F.col("take"), "take_profit").when(F.col("hours") >= max_hours, "max_hold").when((F.col("signal") == 0) & (F.col("hours") >= min_hours), "signal")
    return positions.withColumn("exit_reason", reason)


def portfolio_snapshot(positions: DataFrame, by: Sequence[str]) -> DataFrame:
    value = F.col("quantity") * F.col("price")
    return positions.groupBy(*by).agg(F.count(F.lit(1)).alias("n_positions"), F.sum(value).alias("value"), F.sum(F.col("quantity") * F.col("entry_price")).alias("cost_basis"), F.sum(F.col("quantity") * (F.col("price") - F.col("entry_price"))).alias("unrealized"))


def exposures(snapshot: DataFrame, cash: float) -> DataFrame:
    """snapshot(symbol, sector, value) with each position's and its sector's share of all value, cash included."""
    total = snapshot.agg((F.coalesce(F.sum("value"), F.lit(0.0)) + cash).alias("_total"))
    sectors = snapshot.groupBy("sector").agg(F.sum("value").alias("_sector"))
    rows = snapshot.join(sectors, snapshot["sector"].eqNullSafe(sectors["sector"])).drop(sectors["sector"]).crossJoin(total)  # total: one row
    return rows.withColumns({"exposure": F.try_divide("value", "_total"), "sector_exposure": F.try_divide("_sector", "_total")}).drop("_total", "_sector")


def risk_halts(eq: DataFrame, keys: Sequence[str] = ("symbol",), daily: float = 0.05, most: float = 0.15) -> DataFrame:
    """Per day: loss against the day before's last equity, deepest drawdown, and whether trading halts."""
    rows = drawdown(eq, keys).withColumn("day", F.floor(F.unix_seconds("timestamp") / 86400))
    each = rows.groupBy(*keys, "day").agg(F.max_by("equity", "timestamp").alias("equity"), F.min("drawdown").alias("drawdown"))
    change = F.col("equity") / F.lag("equity").over(Window.partitionBy(*keys).orderBy("day")) - 1
    return each.withColumn("daily_return", change).withColumn("halt", (F.coalesce(F.col("daily_return") <= -daily, F.lit(False)) | (F.col("drawdown") <= -most)).cast("int"))


def in_cooldown(candidates: DataFrame, exits: DataFrame, hours: float) -> DataFrame:
    """candidates(symbol, timestamp) with the last exit before them and whether it is nearer than ``hours``."""
    from tidemark.functions.windows import as_of

    found = as_of(candidates, exits.withColumnRenamed("timestamp", "last_exit"), ["symbol"], F.col("timestamp"), F.col("last_exit"), ["last_exit"])
    return found.withColumn("cooling", F.coalesce((F.unix_seconds("timestamp") - F.unix_seconds("last_exit")) / 3600 < hours, F.lit(False)).cast("int"))
