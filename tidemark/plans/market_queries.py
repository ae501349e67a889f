"""Candles, features, labels and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import candles as C
from tidemark.operators import features as X
from tidemark.operators import technical as K
from tidemark.plans.base import query, result

BARS = """bars AS (SELECT event_type AS symbol, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS t, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
 min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""
W = "WINDOW w AS (PARTITION BY symbol ORDER BY t)"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ticks = events.select(F.col("event_type").alias("symbol"), C.instant("ts").alias("time"), F.col("value").alias("price"), F.lit(1.0).alias("quantity"), "event_id")
    return C.ticks_to_candles(ticks, 3600, ties=["event_id"])


def win(agg: str, n: int) -> str:
    """SQL of a rolling aggregate that needs all its values: agg has {x}."""
    name, x = agg.split("(", 1)
    x = x[:-1]
    frame = f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {name}({x}) {frame} END"


def exp_mean(x: str, alpha: float, least: int = 1) -> str:
    return f"CASE WHEN count({x}) OVER w >= {least} THEN list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER w, lambda a, b: a * (1 - {alpha!r}) + b * {alpha!r}) END"


@query(f"WITH {BARS} SELECT symbol, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def candles_hourly(spark, sf_dir):
    return result(bars(spark, sf_dir), "symbol", "timestamp", "open", "high", "low", "close", "volume")


@query("""SELECT l_returnflag || l_linestatus AS symbol, (floor(epoch(l_shipdate) / 86400) * 86400)::BIGINT AS t, first(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, p) AS open,
 max(p) AS high, min(p) AS low, last(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, p) AS close, sum(l_quantity)::DOUBLE AS volume
 FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2""")
def candles_daily_lineitem(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ticks = rows.select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), C.instant("l_shipdate").alias("time"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = C.ticks_to_candles(ticks, 86400, ties=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"])
    return rows.select("symbol", F.unix_seconds("timestamp").alias("t"), "open", "high", "low", "close", "volume")


def _buckets(seconds: int) -> str:
    return f"""SELECT symbol, t // {seconds} * {seconds} AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(volume) AS volume, count(*) AS n_source FROM bars GROUP BY 1, 2"""


@query(f"WITH {BARS}, b AS ({_buckets(14400)}) SELECT symbol, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, n_source FROM b WHERE n_source = 4")
def resample_4h(spark, sf_dir):
    return result(C.resample(bars(spark, sf_dir), "4h"), "symbol", "timestamp", "open", "high", "low", "close", "volume", "n_source")


@query(f"WITH {BARS}, b AS ({_buckets(18000)}) SELECT symbol, count(*) FILTER (n_source = 5) AS complete, count(*) FILTER (n_source != 5) AS incomplete, sum(CASE WHEN n_source != 5 THEN n_source ELSE 0 END)::BIGINT AS dropped_rows FROM b GROUP BY 1")
def resample_diagnostics_5h(spark, sf_dir):
    return C.resample_diagnostics(bars(spark, sf_dir), "5h")


INTERVALS = ["1h", "2h", "3h", "4h", "5h", "6h", "7h", "8h", "12h", "13h", "14h", "1d"]


@query(f"WITH {BARS}, r AS (" + " UNION ALL ".join(f"SELECT '{i}' AS interval, * FROM ({_buckets(C.interval_seconds(i))}) WHERE n_source * 3600 = {C.interval_seconds(i)}" for i in INTERVALS) + ") SELECT symbol, interval, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, n_source FROM r")
def resample_many_intervals(spark, sf_dir):
    return result(C.resample_many(bars(spark, sf_dir), INTERVALS), "symbol", "interval", "timestamp", "open", "high", "low", "close", "volume", "n_source")


DENSE = """grid AS (SELECT symbol, unnest(range(min(t), max(t) + 3600, 3600)) AS t FROM bars GROUP BY symbol),
 dense AS (SELECT g.symbol, g.t, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, b.* EXCLUDE (symbol, t) FROM grid g LEFT JOIN bars b ON b.symbol = g.symbol AND b.t = g.t)"""


@query(f"WITH {BARS}, {DENSE} SELECT symbol, t, round(coalesce(open, c), 6) AS open, round(coalesce(close, c), 6) AS close, coalesce(volume, 0.0) AS volume FROM dense")
def dense_hours(spark, sf_dir):
    return result(C.dense(bars(spark, sf_dir)), "symbol", "timestamp", "open", "close", "volume")


@query(f"WITH {BARS}, g AS (SELECT symbol, t, ((t - lag(t) OVER w) / 3600 - 1)::BIGINT AS missing FROM bars {W}) SELECT * FROM g WHERE missing > 0")
def candle_gaps(spark, sf_dir):
    return result(C.gaps(bars(spark, sf_dir)))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_line_keys(spark, sf_dir):
    return C.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


RAW = """raw AS (SELECT symbol, t, CASE WHEN t % 7 = 0 THEN -open ELSE open END AS open, high, low, CASE WHEN (t // 3600) % 11 = 0 THEN NULL ELSE close END AS close, CASE WHEN (t // 3600) % 5 = 0 THEN -volume ELSE volume END AS volume FROM bars)"""


@query(f"""WITH {BARS}, {RAW} SELECT symbol, t, unnest(list_filter([CASE WHEN least(open, high, low, close) <= 0 THEN 'price_not_positive' END, CASE WHEN close IS NULL THEN 'not_numeric' END, CASE WHEN volume < 0 THEN 'negative_volume' END], lambda x: x IS NOT NULL)) AS rule FROM raw""")
def candle_violations(spark, sf_dir):
    hour = F.unix_seconds("timestamp")
    raw = bars(spark, sf_dir).withColumns({"open": F.when(hour % 7 == 0, -F.col("open")).otherwise(F.col("open")), "close": F.when(F.floor(hour / 3600) % 11 == 0, None).otherwise(F.col("close")), "volume": F.when(F.floor(hour / 3600) % 5 == 0, -F.col("volume")).otherwise(F.col("volume"))})
    return result(C.check(C.normalize(raw)), "symbol", "timestamp", "rule")


# Features.

RET = f"ret AS (SELECT *, " + ", ".join(f"close / lag(close, {n}) OVER w - 1 AS return_{n}h" for n in X.RETURNS) + f" FROM bars {W})"  # noqa: F541
VOL = f"vol AS (SELECT *, {win('stddev_pop(return_1h)', 24)} AS realized_volatility_24h FROM ret)"


@query(f"WITH {BARS}, {RET} SELECT symbol, t, " + ", ".join(f"round(return_{n}h, 6) AS return_{n}h" for n in X.RETURNS) + " FROM ret")
def feature_returns(spark, sf_dir):
    return result(X.returns(bars(spark, sf_dir)), "symbol", "timestamp", *[f"return_{n}h" for n in X.RETURNS])


@query(f"""WITH {BARS}, {RET}, {VOL} SELECT symbol, t, round(realized_volatility_24h, 6) AS realized_volatility_24h, round(volume / ({win('avg(volume)', 24)}), 6) AS volume_ratio_24h,
 round(realized_volatility_24h / lag(realized_volatility_24h, 24) OVER w - 1, 6) AS realized_volatility_change_24h, round((high - low) / close, 6) AS high_low_range_1h FROM vol {W}""")
def feature_volatility(spark, sf_dir):
    rows = X.range_pct(X.vol_change(X.volume_ratio(X.realized_vol(X.returns(bars(spark, sf_dir), [1])))))
    return result(rows, "symbol", "timestamp", "realized_volatility_24h", "volume_ratio_24h", "realized_volatility_change_24h", "high_low_range_1h")


@query(f"""WITH {BARS}, d AS (SELECT *, close - lag(close) OVER w AS s FROM bars {W}), g AS (SELECT *, CASE WHEN s IS NOT NULL THEN greatest(s, 0) END AS g, CASE WHEN s IS NOT NULL THEN greatest(-s, 0) END AS l FROM d),
 m AS (SELECT symbol, t, {win('avg(g)', 14)} AS a, {win('avg(l)', 14)} AS b FROM g) SELECT symbol, t, round(CASE WHEN a IS NULL THEN NULL WHEN b = 0 AND a = 0 THEN 50 WHEN b = 0 THEN 100 ELSE 100 - 100 / (1 + a / b) END, 6) AS rsi_14 FROM m""")
def feature_rsi(spark, sf_dir):
    return result(X.rsi(bars(spark, sf_dir)), "symbol", "timestamp", "rsi_14")


@query(f"WITH {BARS} SELECT symbol, t, round(close / ({win('avg(close)', 24)}) - 1, 6) AS sma_24_distance, round(close / ({win('avg(close)', 168)}) - 1, 6) AS sma_168_distance, round(close / ({win('max(high)', 24)}) - 1, 6) AS drawdown_from_24h_high, round(close / ({win('min(low)', 24)}) - 1, 6) AS distance_from_24h_low FROM bars")
def feature_distances(spark, sf_dir):
    rows = X.range_position(X.sma_distance(X.sma_distance(bars(spark, sf_dir), 24), 168))
    return result(rows, "symbol", "timestamp", "sma_24_distance", "sma_168_distance", "drawdown_from_24h_high", "distance_from_24h_low")


@query(f"WITH {BARS} SELECT symbol, t, round(({exp_mean('close', 2 / 13, 12)}) / ({exp_mean('close', 2 / 27, 26)}) - 1, 6) AS ema_12_26_distance FROM bars {W}")
def feature_ema_distance(spark, sf_dir):
    return result(X.ema_distance(bars(spark, sf_dir)), "symbol", "timestamp", "ema_12_26_distance")


@query(f"""WITH {BARS}, {RET}, {VOL}, f AS (SELECT *, list(realized_volatility_24h) FILTER (WHERE realized_volatility_24h IS NOT NULL) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS l FROM vol)
 SELECT symbol, t, round(CASE WHEN len(l) = 168 THEN len(list_filter(l, lambda x: x <= realized_volatility_24h)) / 168.0 END, 6) AS volatility_percentile_168h FROM f""")
def feature_volatility_percentile(spark, sf_dir):
    return result(X.vol_percentile(X.realized_vol(X.returns(bars(spark, sf_dir), [1]))), "symbol", "timestamp", "volatility_percentile_168h")


def _z(x: str, n: int) -> str:
    return f"(({x}) - ({win(f'avg({x})', n)})) / nullif({win(f'stddev_pop({x})', n)}, 0)"


@query(f"WITH {BARS}, b AS (SELECT *, volume * close AS dv FROM bars) SELECT symbol, t, round({_z('volume', 24)}, 5) AS volume_zscore_24h, round({_z('volume', 168)}, 5) AS volume_zscore_168h, round({_z('dv', 168)}, 5) AS dollar_volume_zscore_168h FROM b")
def feature_zscores(spark, sf_dir):
    v = F.col("volume")
    rows = X.rolling_zscore(X.rolling_zscore(X.rolling_zscore(bars(spark, sf_dir), v, 24, "volume_zscore_24h"), v, 168, "volume_zscore_168h"), v * F.col("close"), 168, "dollar_volume_zscore_168h")
    return rows.select("symbol", F.unix_seconds("timestamp").alias("t"), *[F.round(c, 5).alias(c) for c in ("volume_zscore_24h", "volume_zscore_168h", "dollar_volume_zscore_168h")])


@query(f"""WITH {BARS}, b AS (SELECT symbol, t, (t // 3600) % 24 AS h, (t // 86400 + 3) % 7 AS d FROM bars) SELECT symbol, t, round(sin(2 * pi() * h / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * h / 24), 6) + 0.0 AS hour_cos,
 round(sin(2 * pi() * d / 7), 6) + 0.0 AS day_of_week_sin, round(cos(2 * pi() * d / 7), 6) + 0.0 AS day_of_week_cos, (d >= 5)::INT AS weekend_flag FROM b""")
def feature_calendar(spark, sf_dir):
    rows = result(X.calendar(bars(spark, sf_dir)), "symbol", "timestamp", "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "weekend_flag")
    return rows.withColumns({c: F.col(c) + 0.0 for c in rows.columns if c.endswith(("sin", "cos"))})


@query(f"""WITH {BARS}, {RET}, f AS (SELECT *, list(return_1h) FILTER (WHERE return_1h IS NOT NULL) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS l FROM ret),
 m AS (SELECT *, list_median(l) AS m FROM f), k AS (SELECT *, list_median(list_transform(l, lambda x: abs(x - m))) AS mad FROM m)
 SELECT symbol, t, round(CASE WHEN len(l) = 48 AND mad > 0 AND return_1h IS NOT NULL THEN greatest(m - 3 * mad, least(m + 3 * mad, return_1h)) ELSE return_1h END, 6) AS return_1h_clipped, (return_1h IS NULL)::TINYINT AS return_1h_missing FROM k""")
def feature_mad_clip(spark, sf_dir):
    return result(X.mad_clip(X.missing_flags(X.returns(bars(spark, sf_dir), [1]), ["return_1h"]), ["return_1h"], 48, 3.0), "symbol", "timestamp", "return_1h_clipped", "return_1h_missing")


def _dataset_sql() -> str:
    """SQL of all features, their flags, clipped columns and the label."""
    plain = [c for g in X.GROUPS if g != "calendar" for c in X.GROUPS[g]]
    frame = "OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)"
    h, d = "2 * pi() * ((t // 3600) % 24) / 24", "2 * pi() * ((t // 86400 + 3) % 7) / 7"
    calendar = f"round(sin({h}), 6) + 0.0 AS hour_sin, round(cos({h}), 6) + 0.0 AS hour_cos, round(sin({d}), 6) + 0.0 AS day_of_week_sin, round(cos({d}), 6) + 0.0 AS day_of_week_cos, ((t // 86400 + 3) % 7 >= 5)::INT AS weekend_flag"
    steps = [
        f"f1 AS (SELECT *, volume / ({win('avg(volume)', 24)}) AS volume_ratio_24h, close - lag(close) OVER w AS s, volume * close AS dv, close / ({win('avg(close)', 24)}) - 1 AS sma_24_distance, close / ({win('avg(close)', 168)}) - 1 AS sma_168_distance, close / ({win('max(high)', 24)}) - 1 AS drawdown_from_24h_high, close / ({win('min(low)', 24)}) - 1 AS distance_from_24h_low, (high - low) / close AS high_low_range_1h, realized_volatility_24h / lag(realized_volatility_24h, 24) OVER w - 1 AS realized_volatility_change_24h, list(realized_volatility_24h) FILTER (WHERE realized_volatility_24h IS NOT NULL) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS vl, ({exp_mean('close', 2 / 13, 12)}) / ({exp_mean('close', 2 / 27, 26)}) - 1 AS ema_12_26_distance FROM vol {W})",
        "f2 AS (SELECT *, CASE WHEN s IS NOT NULL THEN greatest(s, 0) END AS g, CASE WHEN s IS NOT NULL THEN greatest(-s, 0) END AS lo FROM f1)",
        f"f3 AS (SELECT *, {win('avg(g)', 14)} AS ga, {win('avg(lo)', 14)} AS la, CASE WHEN len(vl) = 168 THEN len(list_filter(vl, lambda x: x <= realized_volatility_24h)) / 168.0 END AS volatility_percentile_168h, {_z('volume', 24)} AS volume_zscore_24h, {_z('volume', 168)} AS volume_zscore_168h, {_z('dv', 168)} AS dollar_volume_zscore_168h FROM f2)",
        f"f4 AS (SELECT *, CASE WHEN ga IS NULL THEN NULL WHEN la = 0 AND ga = 0 THEN 50 WHEN la = 0 THEN 100 ELSE 100 - 100 / (1 + ga / la) END AS rsi_14, lead(close, 12) OVER w / close - 1 AS nr, 0.003 + 0.1 * realized_volatility_24h AS band FROM f3 {W})",
        "f5 AS (SELECT *, " + ", ".join(f"list({c}) FILTER (WHERE {c} IS NOT NULL) {frame} AS l_{c}" for c in plain) + " FROM f4)",
        "f6 AS (SELECT *, " + ", ".join(f"list_median(l_{c}) AS m_{c}" for c in plain) + " FROM f5)",
        "f7 AS (SELECT *, " + ", ".join(f"list_median(list_transform(l_{c}, lambda x: abs(x - m_{c}))) AS k_{c}" for c in plain) + " FROM f6)",
    ]
    clips = ", ".join(f"round(CASE WHEN len(l_{c}) = 168 AND k_{c} > 0 AND {c} IS NOT NULL THEN greatest(m_{c} - 8 * k_{c}, least(m_{c} + 8 * k_{c}, {c})) ELSE {c} END, 5) AS {c}_clipped, ({c} IS NULL)::TINYINT AS {c}_missing" for c in plain)
    return f"WITH {BARS}, {RET}, {VOL}, {', '.join(steps)} SELECT symbol, t, {clips}, {calendar}, CASE WHEN nr IS NOT NULL AND band IS NOT NULL THEN (nr > band)::TINYINT END AS target FROM f7"


@query(_dataset_sql())
def feature_dataset(spark, sf_dir):
    """All groups with flags, clipped columns and label: the model table."""
    groups = list(X.GROUPS)
    rows = X.build(bars(spark, sf_dir), groups, labels=lambda d: X.label(d, 12, X.cost_buffer("round_trip", 0.001, 0.0005), 0.1), ahead=12)
    rows = rows.withColumns({c: F.round(c, 5) for c in rows.columns if c.endswith("_clipped")})
    rows = result(rows, "symbol", "timestamp", *X.feature_columns(groups), "target")
    return rows.withColumns({c: F.col(c) + 0.0 for c in rows.columns if c.endswith(("sin", "cos"))})


# Labels.

LABEL = f"lab AS (SELECT symbol, t, close, lead(close) OVER w / close - 1 AS nr, 0.003 + 0.1 * realized_volatility_24h AS band FROM vol {W})"
TARGET = "tgt AS (SELECT *, CASE WHEN nr IS NOT NULL AND band IS NOT NULL THEN (nr > band)::INT END AS target FROM lab)"


@query(f"""WITH {BARS}, {RET}, {VOL}, {LABEL}, {TARGET} SELECT symbol, count(*) AS n_rows, count(target) AS n_labeled, count(*) FILTER (target = 1) AS n_positive, count(*) FILTER (target = 0) AS n_negative,
 round(avg(target), 6) AS positive_rate, min(t) FILTER (target IS NOT NULL) AS first_labeled, max(t) FILTER (target IS NOT NULL) AS last_labeled FROM tgt GROUP BY symbol""")
def flagship_label_distribution(spark, sf_dir):
    rows = X.volume_ratio(X.realized_vol(X.returns(bars(spark, sf_dir), [1, 3])))
    return result(X.label_distribution(X.label(rows, 1, X.cost_buffer("round_trip", 0.001, 0.0005), 0.1)))


@query(f"WITH {BARS}, n AS (SELECT symbol, t, lead(close) OVER w / close - 1 AS r FROM bars {W}) SELECT symbol, t, CASE WHEN r > 0.005 THEN 1 WHEN r < -0.005 THEN -1 WHEN r IS NOT NULL THEN 0 END AS label3 FROM n")
def label_three_way(spark, sf_dir):
    return result(X.label_ternary(bars(spark, sf_dir)), "symbol", "timestamp", "label3")


@query(f"""WITH {BARS}, r AS (SELECT symbol, t, CASE WHEN close / lag(close, 24) OVER w - 1 >= 0 THEN 'bull' WHEN close / lag(close, 24) OVER w - 1 < 0 THEN 'bear' END AS regime, CASE WHEN t % 172800 < 86400 THEN 'even' ELSE 'odd' END AS period FROM bars {W}),
 x AS (SELECT period, regime, t FROM r WHERE regime IS NOT NULL UNION ALL SELECT 'all', regime, t FROM r WHERE regime IS NOT NULL), n AS (SELECT period, count(*) AS total FROM x GROUP BY 1)
 SELECT x.period, regime, count(*) AS n, round(count(*) / any_value(total), 6) AS fraction, min(t) AS first_t, max(t) AS last_t FROM x JOIN n USING (period) GROUP BY 1, 2""")
def regime_periods(spark, sf_dir):
    return result(X.regime_diagnostics(X.regime(bars(spark, sf_dir)), F.when(F.unix_seconds("timestamp") % 172800 < 86400, "even").otherwise("odd")))


LAGS = (1, 2, 3, 6, 12, 24, 36, 48)


@query(f"WITH {BARS} SELECT symbol, t, " + ", ".join(f"round(lag({c}, {n}) OVER w, 6) AS {c}_lag_{n}" for c in ("close", "volume") for n in LAGS) + f" FROM bars {W}")
def feature_lag_pack(spark, sf_dir):
    return result(X.lag_pack(bars(spark, sf_dir), ["close", "volume"]), "symbol", "timestamp", *[f"{c}_lag_{n}" for c in ("close", "volume") for n in LAGS])


@query(f"""WITH {BARS}, p AS (SELECT *, row_number() OVER w AS p FROM bars {W}), h AS (SELECT a.symbol, a.t, b.p - a.p AS bar, CASE WHEN b.low <= a.close * 0.9 THEN 'stop' WHEN b.high >= a.close * 1.2 THEN 'take' END AS reason FROM p a LEFT JOIN p b ON b.symbol = a.symbol AND b.p > a.p AND b.p <= a.p + 6),
 f AS (SELECT symbol, t, arg_min(reason, bar) FILTER (reason IS NOT NULL) AS reason, min(bar) FILTER (reason IS NOT NULL) AS bar, count(bar) AS n FROM h GROUP BY 1, 2)
 SELECT symbol, t, coalesce(reason, CASE WHEN n = 6 THEN 'time' END) AS barrier, coalesce(bar, CASE WHEN n = 6 THEN 6 END)::INT AS barrier_bar FROM f""")
def label_first_barrier(spark, sf_dir):
    return result(X.first_barrier(bars(spark, sf_dir), 0.1, 0.2, 6), "symbol", "timestamp", "barrier", "barrier_bar")


# Technical indicators.

STEP = f"d AS (SELECT *, close - lag(close) OVER w AS s FROM bars {W}), g AS (SELECT *, CASE WHEN s > 0 THEN s ELSE 0.0 END AS g, CASE WHEN s < 0 THEN -s ELSE 0.0 END AS l FROM d)"


@query(f"""WITH {BARS}, {STEP}, e AS (SELECT symbol, t, close, {exp_mean('g', 2 / 15)} AS a, {exp_mean('l', 2 / 15)} AS b, {exp_mean('g', 2 / 7)} AS a6, {exp_mean('l', 2 / 7)} AS b6 FROM g {W}), r AS (SELECT *, CASE WHEN b != 0 THEN 100 - 100 / (1 + a / b) END AS rsi, CASE WHEN b6 != 0 THEN 100 - 100 / (1 + a6 / b6) END AS rsi6 FROM e),
 x AS (SELECT *, coalesce(close - lag(close, 5) OVER w > 0, false) AS pu, coalesce(rsi - lag(rsi, 5) OVER w > 0, false) AS iu FROM r {W})
 SELECT symbol, t, round(rsi, 6) AS rsi_exp_14, round(rsi6, 6) AS rsi_exp_6, coalesce(rsi < 30, false)::INT AS rsi_oversold, coalesce(rsi > 70, false)::INT AS rsi_overbought, CASE WHEN pu AND NOT iu THEN -1 WHEN iu AND NOT pu THEN 1 ELSE 0 END AS rsi_divergence FROM x""")
def technical_rsi(spark, sf_dir):
    return result(K.rsi_divergence(K.rsi_exponential(bars(spark, sf_dir)), "rsi_exp_14"), "symbol", "timestamp", "rsi_exp_14", "rsi_exp_6", "rsi_oversold", "rsi_overbought", "rsi_divergence")


@query(f"""WITH {BARS}, m AS (SELECT symbol, t, ({exp_mean('close', 2 / 13)}) - ({exp_mean('close', 2 / 27)}) AS macd FROM bars {W}), s AS (SELECT *, {exp_mean('macd', 0.2)} AS sig FROM m {W}), h AS (SELECT *, macd - sig AS hist, macd > sig AS a FROM s)
 SELECT symbol, t, round(macd, 6) AS macd, round(sig, 6) AS macd_signal, round(hist, 6) AS macd_histogram, CASE WHEN a AND NOT coalesce(lag(a) OVER w, false) THEN 1 WHEN NOT a AND coalesce(lag(a) OVER w, true) THEN -1 ELSE 0 END AS macd_crossover FROM h {W}""")
def technical_macd(spark, sf_dir):
    return result(K.macd(bars(spark, sf_dir)), "symbol", "timestamp", "macd", "macd_signal", "macd_histogram", "macd_crossover")


@query(f"""WITH {BARS}, r AS (SELECT *, {win('min(low)', 14)} AS lo, {win('max(high)', 14)} AS hi FROM bars), k AS (SELECT *, CASE WHEN hi != lo THEN 100 * (close - lo) / (hi - lo) END AS stoch_k FROM r)
 SELECT symbol, t, round(stoch_k, 6) AS stoch_k, round({win('avg(stoch_k)', 3)}, 6) AS stoch_d, coalesce(stoch_k < 20, false)::INT AS stoch_oversold, coalesce(stoch_k > 80, false)::INT AS stoch_overbought FROM k""")
def technical_stochastic(spark, sf_dir):
    return result(K.stochastic(bars(spark, sf_dir)), "symbol", "timestamp", "stoch_k", "stoch_d", "stoch_oversold", "stoch_overbought")


@query(f"""WITH {BARS}, m AS (SELECT *, {win('avg(close)', 20)} AS m, {win('stddev_samp(close)', 20)} AS sd FROM bars), b AS (SELECT *, (close - (m - 2 * sd)) / nullif((m + 2 * sd) - (m - 2 * sd), 0) AS pb, ((m + 2 * sd) - (m - 2 * sd)) / m AS bw FROM m)
 SELECT symbol, t, round(pb, 6) AS bb_percent, round(bw, 6) AS bb_bandwidth, coalesce(bw <= 1.1 * ({win('min(bw)', 20)}), false)::INT AS bb_squeeze, coalesce(close > m + 2 * sd, false)::INT AS bb_above, coalesce(close < m - 2 * sd, false)::INT AS bb_below FROM b""")
def technical_bollinger(spark, sf_dir):
    return result(K.bollinger(bars(spark, sf_dir)), "symbol", "timestamp", "bb_percent", "bb_bandwidth", "bb_squeeze", "bb_above", "bb_below")


TR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM bars {W})"


@query(f"""WITH {BARS}, {TR}, a AS (SELECT *, {exp_mean('tr', 2 / 15)} AS atr, {exp_mean('tr', 2 / 8)} AS atr7 FROM tr {W}) SELECT symbol, t, round(tr, 6) AS true_range, round(atr7, 6) AS atr_7, round(atr, 6) AS atr_14, round(atr7 / close, 6) AS atr_7_percent, round(atr / close, 6) AS atr_14_percent,
 coalesce(atr > 1.5 * ({win('avg(atr)', 20)}), false)::INT AS atr_expansion, coalesce(atr < 0.7 * ({win('avg(atr)', 20)}), false)::INT AS atr_contraction FROM a""")
def technical_atr(spark, sf_dir):
    return result(K.atr(bars(spark, sf_dir)), "symbol", "timestamp", "true_range", "atr_7", "atr_14", "atr_7_percent", "atr_14_percent", "atr_expansion", "atr_contraction")


@query(f"""WITH {BARS}, {TR}, m AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pu, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS pd FROM tr),
 e AS (SELECT symbol, t, {exp_mean('tr', 2 / 15)} AS a, {exp_mean('pu', 2 / 15)} AS u, {exp_mean('pd', 2 / 15)} AS d FROM m {W}), i AS (SELECT *, 100 * u / nullif(a, 0) AS pdi, 100 * d / nullif(a, 0) AS mdi FROM e),
 x AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM i), y AS (SELECT * REPLACE (CASE WHEN adx > 100 THEN 100 ELSE adx END AS adx) FROM (SELECT *, {exp_mean('dx', 2 / 15)} AS adx FROM x {W}))
 SELECT symbol, t, round(pdi, 6) AS plus_di, round(mdi, 6) AS minus_di, round(adx, 6) AS adx, CASE WHEN adx <= 0 THEN NULL WHEN adx <= 20 THEN 0.0::DOUBLE WHEN adx <= 40 THEN 1.0::DOUBLE WHEN adx <= 100 THEN 2.0::DOUBLE END AS trend_strength,
 coalesce(pdi > mdi AND adx > 20, false)::INT AS adx_bullish, coalesce(mdi > pdi AND adx > 20, false)::INT AS adx_bearish FROM y""")
def technical_adx(spark, sf_dir):
    return result(K.adx(bars(spark, sf_dir)), "symbol", "timestamp", "plus_di", "minus_di", "adx", "trend_strength", "adx_bullish", "adx_bearish")


@query(f"""WITH {BARS}, m AS (SELECT *, {win('avg(close)', 10)} AS s10, {win('avg(close)', 20)} AS s20, {win('avg(close)', 50)} AS s50, {exp_mean('close', 2 / 13)} AS e12, {exp_mean('close', 2 / 27)} AS e26 FROM bars {W}), a AS (SELECT *, coalesce(s20 > s50, false) AS a FROM m)
 SELECT symbol, t, round(s10, 6) AS sma_10, round(s20, 6) AS sma_20, round(s50, 6) AS sma_50, round(e12, 6) AS ema_12, round(e26, 6) AS ema_26, round((close - s10) / s10, 6) AS close_vs_sma_10, round((close - s50) / s50, 6) AS close_vs_sma_50, coalesce(close > s20, false)::INT AS above_sma_20, coalesce(close > s50, false)::INT AS above_sma_50,
 round((s20 - s50) / close, 6) AS ma_spread, (a AND NOT coalesce(lag(a) OVER w, true))::INT AS golden_cross, (NOT a AND coalesce(lag(a) OVER w, false))::INT AS death_cross FROM a {W}""")
def technical_moving_averages(spark, sf_dir):
    return result(K.moving_averages(bars(spark, sf_dir)), "symbol", "timestamp", "sma_10", "sma_20", "sma_50", "ema_12", "ema_26", "close_vs_sma_10", "close_vs_sma_50", "above_sma_20", "above_sma_50", "ma_spread", "golden_cross", "death_cross")


@query(f"""WITH {BARS}, b AS (SELECT *, volume * (t // 3600 % 4) / 4.0 AS tb FROM bars), r AS (SELECT *, tb / volume AS tr FROM b) SELECT symbol, t, round(tr, 6) AS taker_buy_ratio, round({win('avg(tr)', 20)}, 6) AS taker_buy_ratio_mean FROM r""")
def technical_taker_ratio(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("taker_buy_volume", F.col("volume") * (F.floor(F.unix_seconds("timestamp") / 3600) % 4) / 4.0)
    return result(K.taker_ratio(rows), "symbol", "timestamp", "taker_buy_ratio", "taker_buy_ratio_mean")


@query(f"""WITH {BARS}, {RET}, v AS (SELECT *, {', '.join(f"({win('stddev_samp(return_1h)', n)}) * sqrt(8760.0) AS v{n}" for n in (6, 12, 24, 72))} FROM ret) SELECT symbol, t, {', '.join(f'round(v{n}, 4) AS annual_volatility_{n}' for n in (6, 12, 24, 72))}, round(v6 / v72, 6) AS volatility_ratio FROM v""")
def technical_annual_volatility(spark, sf_dir):
    rows = K.annual_volatility(bars(spark, sf_dir))
    return result(rows.withColumns({f"annual_volatility_{n}": F.round(f"annual_volatility_{n}", 4) for n in (6, 12, 24, 72)}), "symbol", "timestamp", *[f"annual_volatility_{n}" for n in (6, 12, 24, 72)], "volatility_ratio")


@query(f"""WITH {BARS}, a AS (SELECT *, volume * sign(close - lag(close) OVER w) AS s, volume * (close / lag(close) OVER w - 1) AS v, (high + low + close) / 3 AS tp FROM bars {W}),
 b AS (SELECT *, sum(s) OVER w AS obv, sum(v) OVER w AS vpt, CASE WHEN tp > lag(tp) OVER w THEN tp * volume ELSE 0 END AS pos, CASE WHEN tp < lag(tp) OVER w THEN tp * volume ELSE 0 END AS neg FROM a {W})
 SELECT symbol, t, round(volume / ({win('avg(volume)', 20)}), 6) AS volume_ratio_20, coalesce(volume / ({win('avg(volume)', 20)}) > 2, false)::INT AS volume_spike, round(obv, 6) AS obv, round(vpt, 3) AS volume_price_trend, coalesce(obv > ({win('avg(obv)', 20)}), false)::INT AS obv_rising,
 round(100 - 100 / (1 + ({win('sum(pos)', 14)}) / nullif(({win('sum(neg)', 14)}), 0)), 6) AS mfi_14 FROM b""")
def technical_volume(spark, sf_dir):
    rows = K.volume_indicators(bars(spark, sf_dir)).withColumn("volume_price_trend", F.round("volume_price_trend", 3))
    return result(rows, "symbol", "timestamp", "volume_ratio_20", "volume_spike", "obv", "volume_price_trend", "obv_rising", "mfi_14")


@query(f"""WITH {BARS}, b AS (SELECT *, CASE WHEN high != low THEN (close - open) / (high - low) END AS bp FROM bars) SELECT symbol, t, round(bp, 6) AS body_percent, round((high - greatest(open, close)) / nullif(high - low, 0), 6) AS upper_wick, round((least(open, close) - low) / nullif(high - low, 0), 6) AS lower_wick,
 coalesce(abs(bp) < 0.1, false)::INT AS doji, coalesce(bp > 0.7, false)::INT AS momentum_up, coalesce(bp < -0.7, false)::INT AS momentum_down, round((({win('max(high)', 24)}) - close) / close, 6) AS below_24h_high, round((close - ({win('min(low)', 24)})) / close, 6) AS above_24h_low FROM b""")
def technical_price_action(spark, sf_dir):
    return result(K.price_action(bars(spark, sf_dir)), "symbol", "timestamp", "body_percent", "upper_wick", "lower_wick", "doji", "momentum_up", "momentum_down", "below_24h_high", "above_24h_low")


@query(f"""WITH {BARS}, {RET}, v AS (SELECT symbol, t, {win('stddev_samp(return_1h)', 24)} AS v FROM ret), l AS (SELECT *, list(v) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS l FROM v),
 r AS (SELECT *, CASE WHEN len(l) >= 24 AND v IS NOT NULL THEN (len(list_filter(l, lambda x: x < v)) + (len(list_filter(l, lambda x: x = v)) + 1) / 2) / len(l) END AS k FROM l)
 SELECT symbol, t, round(v, 6) AS vol_24, round(k, 6) AS vol_rank, CASE WHEN k <= 0.25 THEN 'low' WHEN k <= 0.75 THEN 'normal' WHEN k IS NOT NULL THEN 'high' END AS vol_state FROM r""")
def technical_volatility_regime(spark, sf_dir):
    return result(K.vol_regime(bars(spark, sf_dir)), "symbol", "timestamp", "vol_24", "vol_rank", "vol_state")


@query(f"""WITH {BARS}, x AS (SELECT *, ln(high / low) ** 2 AS hl, 0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 AS gk FROM bars) SELECT symbol, t, round(sqrt(({win('avg(hl)', 24)}) / (4 * ln(2))), 6) AS parkinson, round(sqrt(CASE WHEN ({win('avg(gk)', 24)}) IS NULL THEN 0.0 ELSE greatest({win('avg(gk)', 24)}, 0) END), 6) AS garman_klass FROM x""")
def technical_range_volatility(spark, sf_dir):
    return result(K.range_volatility(bars(spark, sf_dir)), "symbol", "timestamp", "parkinson", "garman_klass")


@query(f"""WITH {BARS}, {RET}, j AS (SELECT a.symbol, a.t, a.return_1h AS r, b.return_1h AS m FROM ret a JOIN ret b ON b.t = a.t AND b.symbol = 'click'),
 f AS (SELECT *, count(*) FILTER (r IS NOT NULL AND m IS NOT NULL) OVER x AS n, corr(r, m) OVER x AS c, covar_pop(r, m) OVER x AS cv, var_pop(m) FILTER (r IS NOT NULL OR r IS NULL) OVER x AS vm FROM j WINDOW x AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
 SELECT symbol, t, CASE WHEN n = 24 THEN round(c, 5) END AS ref_corr, CASE WHEN n = 24 THEN round(cv / nullif(vm, 0), 5) END AS ref_beta FROM f""")
def technical_versus_reference(spark, sf_dir):
    rows = K.versus_reference(bars(spark, sf_dir), "click")
    return rows.select("symbol", F.unix_seconds("timestamp").alias("t"), F.round("ref_corr", 5).alias("ref_corr"), F.round("ref_beta", 5).alias("ref_beta"))


@query(f"WITH {BARS}, {RET} SELECT t, count(*) AS n_symbols, round(avg(return_1h), 6) AS market_return, round(avg((return_1h > 0)::INT), 6) AS breadth FROM ret WHERE return_1h IS NOT NULL GROUP BY t")
def technical_breadth(spark, sf_dir):
    return result(K.breadth(bars(spark, sf_dir)), "timestamp", "n_symbols", "market_return", "breadth")
