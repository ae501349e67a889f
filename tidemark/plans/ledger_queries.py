"""Ledgers, metrics, benchmarks and risk on a deterministic signal: long while the last 12 bars' return is positive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import change, ordered
from tidemark.operators import ledger as L
from tidemark.operators import technical as K
from tidemark.plans.market_queries import BARS, RET, VOL, W, bars, exp_mean, win
from tidemark.plans.base import ORACLES, QUERIES, query, result, scientific


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).withColumn("_r", change(F.col("close"), 12, ordered()))
    return rows.withColumn("probability", F.coalesce(1 / (1 + F.exp(-F.col("_r"))), F.lit(0.5))).withColumn("signal", (F.col("probability") >= 0.6).cast("int")).drop("_r")


SIGNALS = f"sig AS (SELECT *, (p >= 0.6)::INT AS signal FROM (SELECT *, coalesce(1 / (1 + exp(-(close / lag(close, 12) OVER w - 1))), 0.5) AS p FROM bars {W}))"
B, S = "(1.0005 * 1.001)", "(0.9995 * 0.999)"


def chain(source: str, keys: str) -> str:
    """SQL of positions, wealth and equity of ``source`` (with signal) by keys; tables pos, eq."""
    w = f"WINDOW w AS (PARTITION BY {keys} ORDER BY t)"
    return f"""pos0 AS (SELECT *, lead(t) OVER w IS NULL AS fin, lead(open) OVER w AS o1, CASE WHEN lead(t) OVER w IS NULL THEN coalesce(lag(signal) OVER w, 0) ELSE greatest(0, least(1, coalesce(signal, 0))) END AS pos FROM {source} {w}),
 pos1 AS (SELECT *, coalesce(lag(pos) OVER w, 0) AS prev FROM pos0 {w}), fac AS (SELECT *, CASE WHEN fin THEN 1.0 WHEN pos > prev THEN 1 / (o1 * {B}) WHEN pos < prev THEN o1 * {S} ELSE 1.0 END AS f FROM pos1),
 wea AS (SELECT *, 10000.0 * product(f) OVER w AS wealth FROM fac {w}), eq AS (SELECT *, CASE WHEN pos = 1 THEN wealth * close * {S} ELSE wealth END AS equity, CASE WHEN pos = 1 AND NOT fin THEN 1.0 ELSE 0.0 END AS exposure FROM wea),
 dd AS (SELECT *, equity / max(equity) OVER w - 1 AS drawdown, equity / lag(equity) OVER w - 1 AS r FROM eq {w}),
 fil0 AS (SELECT *, CASE WHEN fin AND pos = 1 THEN 'SELL' WHEN NOT fin AND pos > prev THEN 'BUY' WHEN NOT fin AND pos < prev THEN 'SELL' END AS side, CASE WHEN fin THEN close ELSE o1 END AS raw FROM wea),
 fil1 AS (SELECT *, raw * CASE WHEN side = 'BUY' THEN 1.0005 ELSE 0.9995 END AS price FROM fil0 WHERE side IS NOT NULL),
 fil2 AS (SELECT *, CASE WHEN fin THEN wealth * price * 0.999 ELSE wealth END AS w2 FROM fil1), fil3 AS (SELECT *, CASE WHEN side = 'BUY' THEN w2 ELSE lag(w2) OVER w END AS quantity FROM fil2 {w}),
 fil AS (SELECT *, quantity * price AS notional, quantity * price * 0.001 AS fee, quantity * raw * 0.0005 AS slip FROM fil3),
 tri0 AS (SELECT *, lead(notional) OVER w AS n2, lead(fee) OVER w AS f2, lead(t) OVER w AS t2, lead(fin) OVER w AS fin2 FROM fil {w}),
 tri AS (SELECT *, (n2 - f2) - (notional + fee) AS pnl, (n2 - f2) / (notional + fee) - 1 AS ret, (t2 - t) / 3600 AS hours, CASE WHEN fin2 THEN 'final_close' ELSE 'signal' END AS reason FROM tri0 WHERE side = 'BUY')"""


def met(keys: str) -> str:
    return f"""met AS (SELECT {keys}, arg_max(equity, t) / arg_min(equity, t) - 1 AS total_return, arg_min(equity, t) AS first_equity, min(drawdown) AS max_drawdown, CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(8766.0) END AS sharpe, avg(exposure) AS exposure FROM dd GROUP BY {keys}),
 mef AS (SELECT {keys}, sum(notional) AS notional, sum(fee) AS fees, count(*) AS n_trades FROM fil GROUP BY {keys}), met3 AS (SELECT {keys}, avg((ret > 0)::INT) AS win_rate, avg(ret) AS mean_trade_return, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / nullif(-sum(CASE WHEN ret < 0 THEN ret ELSE 0 END), 0) AS profit_factor FROM tri GROUP BY {keys})"""


KEY = "symbol"


@query(f"WITH {BARS}, {SIGNALS} SELECT symbol, t, round(p, 6) AS probability, signal FROM sig")
def signal_threshold(spark, sf_dir):
    return result(L.to_signal(signals(spark, sf_dir), 0.6), "symbol", "timestamp", "probability", "signal")


@query(f"WITH {BARS}, {SIGNALS} SELECT symbol, t, round(abs(p - 0.5) * 2, 6) AS confidence, CASE WHEN abs(p - 0.5) * 2 < 0.1 THEN 'HOLD' WHEN p >= 0.6 THEN 'BUY' WHEN p <= 0.4 THEN 'SELL' ELSE 'HOLD' END AS action FROM sig")
def signal_actions(spark, sf_dir):
    return result(L.to_action(signals(spark, sf_dir), 0.6, 0.4, 0.1), "symbol", "timestamp", "confidence", "action")


@query(f"WITH {BARS}, {SIGNALS}, {chain('sig', KEY)} SELECT symbol, t, pos::INT AS position, printf('%.6e', equity) AS equity, exposure FROM eq")
def ledger_equity(spark, sf_dir):
    return L.equity(signals(spark, sf_dir)).select("symbol", F.unix_seconds("timestamp").alias("t"), "position", scientific("equity", 6).alias("equity"), "exposure")


@query(f"WITH {BARS}, {SIGNALS}, {chain('sig', KEY)} SELECT symbol, t, side, round(price, 6) AS price, printf('%.6e', notional) AS notional, printf('%.6e', fee) AS fee, printf('%.6e', slip) AS slippage, CASE WHEN fin THEN 'final_close' ELSE 'signal' END AS reason FROM fil")
def ledger_trades(spark, sf_dir):
    return L.trades(signals(spark, sf_dir)).select("symbol", F.unix_seconds("timestamp").alias("t"), "side", F.round("price", 6).alias("price"), *[scientific(c, 6).alias(c) for c in ("notional", "fee", "slippage")], "reason")


@query(f"WITH {BARS}, {SIGNALS}, {chain('sig', KEY)} SELECT symbol, t AS entry_time, t2 AS exit_time, reason AS exit_reason, printf('%.6e', pnl) AS pnl, round(ret, 6) AS return, round(hours, 6) AS hours FROM tri")
def ledger_round_trips(spark, sf_dir):
    rows = L.round_trips(L.trades(signals(spark, sf_dir))).withColumn("pnl", scientific("pnl", 6))
    return result(rows)


@query(f"WITH {BARS}, {SIGNALS}, {chain('sig', KEY)}, {met(KEY)} SELECT symbol, printf('%.6e', total_return) AS total_return, round(max_drawdown, 6) AS max_drawdown, round(sharpe, 6) AS sharpe, round(exposure, 6) AS exposure, printf('%.6e', notional / first_equity) AS turnover, n_trades, round(win_rate, 6) AS win_rate, round(mean_trade_return, 6) AS mean_trade_return, round(profit_factor, 6) AS profit_factor FROM met JOIN mef USING (symbol) JOIN met3 USING (symbol)")
def ledger_metrics(spark, sf_dir):
    s = signals(spark, sf_dir)
    rows = L.metrics(L.equity(s), L.trades(s)).withColumn("total_return", scientific("total_return", 6)).withColumn("turnover", scientific("turnover", 6))
    return result(rows, "symbol", "total_return", "max_drawdown", "sharpe", "exposure", "turnover", "n_trades", "win_rate", "mean_trade_return", "profit_factor")


@query(f"""WITH {BARS}, {SIGNALS}, {chain('sig', KEY)}, a AS (SELECT symbol, avg(r) AS m, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < -1e-12) AS dd, min(drawdown) AS low, arg_max(equity, t) AS e FROM dd GROUP BY 1),
 b AS (SELECT symbol, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS w, coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS l, avg(hours) AS h, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(-sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END), 0) AS pf FROM tri GROUP BY 1)
 SELECT symbol, round(CASE WHEN sd > 0 THEN m / sd * sqrt(6048) ELSE 0 END, 6) AS sharpe, round(CASE WHEN sd > 0 THEN CASE WHEN dd > 0 THEN m / dd * sqrt(6048) END ELSE 0 END, 6) AS sortino, printf('%.6e', (e / 10000 - 1) / -low) AS calmar, printf('%.6e', w) AS mean_win, printf('%.6e', l) AS mean_loss, round(h, 6) AS mean_hours, round(pf, 6) AS profit_factor FROM a JOIN b USING (symbol)""")
def ledger_statistics(spark, sf_dir):
    s = signals(spark, sf_dir)
    rows = L.trading_statistics(L.equity(s), L.round_trips(L.trades(s))).withColumns({c: scientific(c, 6) for c in ("calmar", "mean_win", "mean_loss")})
    return result(rows, "symbol", "sharpe", "sortino", "calmar", "mean_win", "mean_loss", "mean_hours", "profit_factor")


@query(f"WITH {BARS}, {SIGNALS}, {chain('sig', KEY)}, a AS (SELECT symbol, count(*) AS n, sum(pnl) AS p, avg((pnl > 0)::INT) AS w FROM tri GROUP BY 1) SELECT symbol, n, printf('%.6e', p) AS total_pnl, round(w, 6) AS win_rate, row_number() OVER (ORDER BY p DESC, symbol)::INT AS place FROM a")
def ledger_symbol_breakdown(spark, sf_dir):
    rows = L.symbol_breakdown(L.round_trips(L.trades(signals(spark, sf_dir)))).withColumn("total_pnl", scientific("total_pnl", 6))
    return result(rows, "symbol", "n", "total_pnl", "win_rate", "place")


@query(f"WITH {BARS}, b AS (SELECT symbol, CASE WHEN t % 7 = 0 THEN NULL ELSE t // 7200 END AS t FROM bars), e AS (SELECT symbol, t, count(*) AS n FROM b GROUP BY 1, 2), r AS (SELECT symbol, sum(n) AS rows, sum(CASE WHEN t IS NULL THEN n ELSE 0 END) AS missing, sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) AS repeated FROM e GROUP BY 1) SELECT symbol, 'missing_timestamp' AS rule, missing::BIGINT AS n FROM r WHERE missing > 0 UNION ALL SELECT symbol, 'repeated_timestamp', repeated::BIGINT FROM r WHERE repeated > 0 UNION ALL SELECT symbol, 'too_few_rows', rows::BIGINT FROM r WHERE rows < 2")
def ledger_input_checks(spark, sf_dir):
    """Bars with some timestamps taken away and others made equal."""
    t = F.unix_seconds("timestamp")
    rows = bars(spark, sf_dir).withColumn("timestamp", F.when(t % 7 == 0, None).otherwise(F.timestamp_seconds(F.floor(t / 7200))))
    return L.check_ledger_input(rows)


@query(f"WITH {BARS}, {SIGNALS}, p AS (SELECT symbol, t, signal * 3 - 1 AS signal FROM sig WHERE t % 10800 != 0) SELECT b.symbol, b.t, greatest(0, least(1, coalesce(p.signal, 0)))::INT AS signal FROM bars b LEFT JOIN p ON p.symbol = b.symbol AND p.t = b.t")
def join_market_predictions(spark, sf_dir):
    p = signals(spark, sf_dir).where(F.unix_seconds("timestamp") % 10800 != 0).withColumn("signal", F.col("signal") * 3 - 1)
    return result(L.join_predictions(bars(spark, sf_dir), p, ["symbol", "timestamp"]), "symbol", "timestamp", "signal")


BENCH = f"ben AS (SELECT b.*, k.benchmark, CASE k.benchmark WHEN 'cash' THEN 0 WHEN 'buy_and_hold' THEN 1 ELSE m END AS signal FROM (SELECT *, coalesce((close / lag(close, 24) OVER w - 1 > 0)::INT, 0) AS m FROM bars {W}) b, (SELECT unnest(['cash', 'buy_and_hold', 'momentum']) AS benchmark) k)"
BKEY = "symbol, benchmark"


@query(f"WITH {BARS}, {BENCH}, {chain('ben', BKEY)}, {met(BKEY)} SELECT symbol, benchmark, printf('%.6e', total_return) AS total_return, round(max_drawdown, 6) AS max_drawdown, round(exposure, 6) AS exposure, coalesce(n_trades, 0) AS n_trades FROM met LEFT JOIN mef USING (symbol, benchmark)")
def ledger_benchmarks(spark, sf_dir):
    s, by = L.benchmark_signals(bars(spark, sf_dir)), ["symbol", "benchmark"]
    rows = L.metrics(L.equity(s, by), L.trades(s, by), by).withColumn("total_return", scientific("total_return", 6))
    return result(rows, "symbol", "benchmark", "total_return", "max_drawdown", "exposure", "n_trades")


@query(f"""WITH {BARS}, {SIGNALS}, {BENCH}, al AS (SELECT symbol, t, open, high, low, close, volume, 'strategy' AS strategy, signal FROM sig UNION ALL SELECT symbol, t, open, high, low, close, volume, benchmark, signal FROM ben), {chain('al', 'symbol, strategy')}, {met('symbol, strategy')}
 SELECT symbol, strategy, printf('%.6e', total_return) AS total_return, round(max_drawdown, 6) AS max_drawdown, round(sharpe, 6) AS sharpe, coalesce(n_trades, 0) AS n_trades, round(win_rate, 6) AS win_rate, round(profit_factor, 6) AS profit_factor, printf('%.6e', 10000 * (1 + total_return)) AS final_value, printf('%.5e', total_return - max(CASE WHEN strategy = 'strategy' THEN total_return END) OVER (PARTITION BY symbol)) AS excess_return FROM met LEFT JOIN mef USING (symbol, strategy) LEFT JOIN met3 USING (symbol, strategy)""")
def ledger_comparison(spark, sf_dir):
    s, b = signals(spark, sf_dir), L.benchmark_signals(bars(spark, sf_dir))
    named = {"strategy": L.metrics(L.equity(s), L.trades(s))}
    every = L.metrics(L.equity(b, ["symbol", "benchmark"]), L.trades(b, ["symbol", "benchmark"]), ["symbol", "benchmark"])
    named |= {k: every.where(F.col("benchmark") == k) for k in ("cash", "buy_and_hold", "momentum")}
    rows = L.compare_runs(named)
    return result(rows.withColumn("total_return", scientific("total_return", 6)).withColumn("excess_return", scientific("excess_return", 5)).withColumn("final_value", scientific("final_value", 6)))


@query(f"WITH {BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS r, close / max(close) OVER w - 1 AS d FROM bars {W}) SELECT symbol, round(arg_max(close, t) / arg_min(close, t) * 0.999 * 0.999 - 1, 6) AS buy_hold_return, round(avg(r) / stddev_samp(r) * sqrt(8766.0), 6) AS sharpe, round(min(d), 6) AS max_drawdown FROM r GROUP BY symbol")
def ledger_buy_and_hold(spark, sf_dir):
    return result(L.buy_and_hold(bars(spark, sf_dir)))


@query(f"WITH {BARS}, {RET}, m AS (SELECT t, avg(return_1h) AS r FROM ret WHERE return_1h IS NOT NULL GROUP BY t) SELECT count(*) AS n_bars, round(avg(r), 6) AS mean_return, printf('%.5e', exp(sum(ln(1 + r))) - 1) AS total_return FROM m")
def ledger_equal_weight(spark, sf_dir):
    rows = L.equal_weight(bars(spark, sf_dir)).withColumn("total_return", scientific("total_return", 5))
    return result(rows)


@query(f"WITH {BARS}, {SIGNALS}, {chain('sig', KEY)} SELECT reason AS exit_reason, count(*) AS n, round(avg(ret), 6) AS mean_return, round(avg(hours), 6) AS mean_hours FROM tri GROUP BY 1")
def ledger_exit_breakdown(spark, sf_dir):
    return result(L.exit_breakdown(L.round_trips(L.trades(signals(spark, sf_dir)))), "exit_reason", "n", "mean_return", "mean_hours")


@query(f"WITH {BARS}, {SIGNALS}, {chain('sig', KEY)} SELECT symbol, count(*) AS n, round(avg((pnl > 0)::INT), 6) AS win_rate, round(max(ret), 6) AS best, round(min(ret), 6) AS worst FROM tri GROUP BY 1")
def ledger_trade_stats(spark, sf_dir):
    return result(L.trade_stats(L.round_trips(L.trades(signals(spark, sf_dir)))), "symbol", "n", "win_rate", "best", "worst")


DAILY = f"dl AS ({ORACLES['candles_daily_lineitem']}), ds AS (SELECT *, (coalesce(close / lag(close, 12) OVER w - 1, 0) > 0)::INT AS signal FROM dl {W})"


@query(f"WITH {DAILY}, {chain('ds', KEY)}, m AS (SELECT symbol, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m') AS month, arg_max(equity, t) AS e FROM eq GROUP BY 1, 2) SELECT symbol, month, printf('%.6e', e) AS equity, round(e / lag(e) OVER (PARTITION BY symbol ORDER BY month) - 1, 6) AS month_return FROM m")
def ledger_monthly_returns(spark, sf_dir):
    """Returns by month of a ledger on daily candles of several years."""
    daily = QUERIES["candles_daily_lineitem"](spark, sf_dir).withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
    rows = daily.withColumn("signal", (F.coalesce(change(F.col("close"), 12, ordered()), F.lit(0.0)) > 0).cast("int"))
    rows = L.monthly_returns(L.equity(rows)).withColumn("equity", scientific("equity", 6))
    return result(rows)


# Risk.


@query(f"WITH {BARS}, {SIGNALS}, {chain('sig', KEY)}, y AS (SELECT symbol, t // 86400 AS day, arg_max(equity, t) AS e, min(drawdown) AS d FROM dd GROUP BY 1, 2), z AS (SELECT *, e / lag(e) OVER (PARTITION BY symbol ORDER BY day) - 1 AS r FROM y) SELECT symbol, day, round(r, 6) AS daily_return, round(d, 6) AS drawdown, (coalesce(r <= -0.05, false) OR d <= -0.15)::INT AS halt FROM z")
def risk_halt_flags(spark, sf_dir):
    return result(L.risk_halts(L.equity(signals(spark, sf_dir))), "symbol", "day", "daily_return", "drawdown", "halt")


@query(f"""WITH {BARS}, {RET}, {VOL}, {SIGNALS}, o AS (SELECT v.symbol, v.t, v.realized_volatility_24h AS volatility, s.p AS confidence, 400.0 + v.t % 1000 AS capacity FROM vol v JOIN sig s ON s.symbol = v.symbol AND s.t = v.t WHERE v.realized_volatility_24h IS NOT NULL),
 z AS (SELECT *, least(10000.0 * 0.02, 1000.0) AS f, CASE WHEN volatility > 0 THEN greatest(100.0, least(500.0 * 0.02 / volatility, 1000.0)) ELSE 500.0 END AS vo, CASE WHEN t % 5 = 0 THEN 100.0 ELSE 10000.0 * greatest(0, least(0.1, 0.25 * (0.55 * 1.5 - 0.45) / 1.5)) END AS k, CASE WHEN confidence < 0.55 THEN 0.0 ELSE 1000.0 * (0.25 + 0.75 * least((confidence - 0.55) / 0.25, 1.0)) END AS c FROM o)
 SELECT symbol, t, round(f, 6) AS size_fixed, round(vo, 6) AS size_volatility, round(k, 6) AS size_kelly, round(c, 6) AS size_confidence, round(least(f, vo, k, c, capacity), 6) AS size, (list_sort([{{'v': round(f, 8), 'n': 'fixed'}}, {{'v': round(vo, 8), 'n': 'volatility'}}, {{'v': round(k, 8), 'n': 'kelly'}}, {{'v': round(c, 8), 'n': 'confidence'}}, {{'v': round(capacity, 8), 'n': 'capacity'}}]))[1].n AS limited_by FROM z""")
def risk_position_sizes(spark, sf_dir):
    from tidemark.operators.features import realized_vol, returns

    rows = realized_vol(returns(signals(spark, sf_dir), [1])).where("realized_volatility_24h is not null")
    orders = rows.withColumns({"volatility": F.col("realized_volatility_24h"), "confidence": F.col("probability"), "capacity": 400.0 + F.unix_seconds("timestamp") % 1000, "win_rate": F.when(F.unix_seconds("timestamp") % 5 == 0, 1.0).otherwise(0.55), "mean_win": F.lit(0.03), "mean_loss": F.lit(0.02)})
    return result(L.size_orders(orders, 10_000.0), "symbol", "timestamp", "size_fixed", "size_volatility", "size_kelly", "size_confidence", "size", "limited_by")


@query(f"""WITH {BARS}, tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {W}), a AS (SELECT *, {exp_mean('tr', 2 / 15)} AS atr FROM tr {W})
 SELECT symbol, t, round(close * 0.95, 6) AS stop_fixed, round(close * 1.1, 6) AS take_fixed, round(close - 2 * atr, 6) AS stop_atr, round(close + 4 * atr, 6) AS take_atr, t + 172800 AS time_limit FROM a""")
def risk_stop_levels(spark, sf_dir):
    rows = K.atr(bars(spark, sf_dir)).withColumns({"entry_price": F.col("close"), "atr": F.col("atr_14")})
    return result(L.stop_levels(rows), "symbol", "timestamp", "stop_fixed", "take_fixed", "stop_atr", "take_atr", "time_limit")


@query(f"""WITH {BARS}, e AS (SELECT *, first_value(close) OVER w AS ep, max(high) OVER w AS top FROM bars {W}), l AS (SELECT *, CASE WHEN top >= ep * 1.02 THEN top * 0.97 END AS l FROM e) SELECT symbol, t, round(max(l) OVER w, 6) AS trailing_stop FROM l {W}""")
def risk_trailing_stop(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("entry_price", F.first("close").over(ordered()))
    return result(L.trailing_stop(rows, ["symbol"]), "symbol", "timestamp", "trailing_stop")


@query(f"""WITH {BARS}, {SIGNALS}, p AS (SELECT *, lag(close, 6) OVER w AS ep, (t - lag(t, 6) OVER w) / 3600 AS h FROM sig {W}) SELECT symbol, t, CASE WHEN close <= ep * 0.9 THEN 'stop_loss' WHEN close >= ep * 1.3 THEN 'take_profit' WHEN h >= 8 THEN 'max_hold' WHEN signal = 0 AND h >= 1 THEN 'signal' END AS exit_reason FROM p WHERE ep IS NOT NULL""")
def risk_exit_rules(spark, sf_dir):
    w = ordered()
    rows = signals(spark, sf_dir).withColumn("ep", F.lag("close", 6).over(w)).withColumn("hours", (F.unix_seconds("timestamp") - F.unix_seconds(F.lag("timestamp", 6).over(w))) / 3600).where("ep is not null")
    rows = rows.withColumns({"price": F.col("close"), "stop": F.col("ep") * 0.9, "take": F.col("ep") * 1.3})
    return result(L.evaluate_exits(rows, 8, 1), "symbol", "timestamp", "exit_reason")


@query(f"WITH {BARS}, l AS (SELECT *, first_value(close) OVER w AS ep FROM bars {W}) SELECT symbol, count(*) AS n_positions, round(sum(volume * close), 4) AS value, round(sum(volume * ep), 4) AS cost_basis, round(sum(volume * (close - ep)), 4) AS unrealized FROM l GROUP BY 1")
def risk_portfolio_snapshot(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("entry_price", F.first("close").over(ordered())).withColumns({"quantity": F.col("volume"), "price": F.col("close")})
    return L.portfolio_snapshot(rows, ["symbol"]).select("symbol", "n_positions", *[F.round(c, 4).alias(c) for c in ("value", "cost_basis", "unrealized")])


@query(f"""WITH {BARS}, {SIGNALS}, {chain('sig', KEY)}, x AS (SELECT symbol, t2 FROM tri WHERE t2 IS NOT NULL), c AS (SELECT b.symbol, b.t, max(x.t2) AS le FROM bars b LEFT JOIN x ON x.symbol = b.symbol AND x.t2 <= b.t GROUP BY 1, 2) SELECT symbol, t, le AS last_exit, coalesce((t - le) / 3600 < 6, false)::INT AS cooling FROM c""")
def risk_cooldown(spark, sf_dir):
    trips = L.round_trips(L.trades(signals(spark, sf_dir)))
    exits = trips.where("exit_time is not null").select("symbol", F.col("exit_time").alias("timestamp"))
    return result(L.in_cooldown(bars(spark, sf_dir).select("symbol", "timestamp"), exits, 6), "symbol", "timestamp", "last_exit", "cooling")


@query(f"""WITH {BARS}, p AS (SELECT *, first_value(close) OVER w AS ep, CASE WHEN t % 7200 = 0 THEN 1 ELSE -1 END AS side FROM bars {W}), q AS (SELECT *, ep * (1 - 0.1 * side) AS stop, ep * (1 + 0.3 * side) AS take FROM p)
 SELECT symbol, t, round(volume * (close - ep) * side, 6) + 0.0 AS unrealized, round((close - ep) / ep * side, 6) + 0.0 AS unrealized_percent, round(volume * (close - stop) * side, 6) AS risk_to_stop, round(volume * (take - close) * side, 6) AS potential, round(CASE WHEN volume * (close - stop) * side > 0 THEN (take - close) * side / ((close - stop) * side) END, 5) AS reward_risk FROM q""")
def risk_open_positions(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("entry_price", F.first("close").over(ordered())).withColumns({"quantity": F.col("volume"), "price": F.col("close"), "side": F.when(F.unix_seconds("timestamp") % 7200 == 0, 1).otherwise(-1)})
    rows = rows.withColumns({"stop": F.col("entry_price") * (1 - 0.1 * F.col("side")), "take": F.col("entry_price") * (1 + 0.3 * F.col("side"))})
    rows = L.open_risk(rows).withColumn("reward_risk", F.round("reward_risk", 5))
    return result(rows, "symbol", "timestamp", "unrealized", "unrealized_percent", "risk_to_stop", "potential", "reward_risk").withColumns({c: F.col(c) + 0.0 for c in ("unrealized", "unrealized_percent")})


@query(f"WITH {BARS}, h AS (SELECT symbol, CASE WHEN symbol IN ('click', 'view') THEN 'browse' ELSE 'act' END AS sector, sum(volume * close) AS value FROM bars GROUP BY 1, 2) SELECT symbol, sector, round(value / (sum(value) OVER () + 10000), 6) AS exposure, round(sum(value) OVER (PARTITION BY sector) / (sum(value) OVER () + 10000), 6) AS sector_exposure FROM h")
def risk_exposures(spark, sf_dir):
    held = bars(spark, sf_dir).withColumn("sector", F.when(F.col("symbol").isin("click", "view"), "browse").otherwise("act")).withColumns({"quantity": F.col("volume"), "price": F.col("close"), "entry_price": F.col("close")})
    return result(L.exposures(L.portfolio_snapshot(held, ["symbol", "sector"]), 10_000.0), "symbol", "sector", "exposure", "sector_exposure")
