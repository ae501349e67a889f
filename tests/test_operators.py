"""Hand values, causality, isolation of symbols, and batch against stream."""

from __future__ import annotations

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.windows import affine_scan, as_of, ewma, kalman, span_alpha
from tidemark.operators import candles as C
from tidemark.operators import features as X
from tidemark.operators import ledger as L
from tidemark.operators import technical as K
from tidemark.operators import text as T
from tidemark.plans import validation as V
from tidemark.plans.base import scientific

T0 = dt.datetime(2024, 1, 1)


def market(spark, closes, symbol="A", volume=10.0):
    rows = [(T0 + dt.timedelta(hours=i), symbol, float(c), c + 1.0, c - 1.0, float(c), volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "timestamp timestamp, symbol string, open double, high double, low double, close double, volume double")


def walk(n, seed=1):
    x, out = 100.0, []
    for i in range(n):
        x *= 1 + 0.01 * math.sin(i * seed) + 0.003 * math.cos(7.3 * i)
        out.append(x)
    return out


def test_intervals():
    assert C.interval_seconds("4h") == 14400 and C.interval_seconds("1d") == 86400
    for bad in ("", "h", "0h", "4w", "-1h"):
        with pytest.raises(ValueError):
            C.interval_seconds(bad)


def test_resample_drops_incomplete_buckets(spark):
    rows = market(spark, range(100, 110)).where(F.col("timestamp") >= T0 + dt.timedelta(hours=1))
    assert C.resample(rows, "4h").count() == 1
    d = C.resample_diagnostics(rows, "4h").first()
    assert (d.complete, d.incomplete, d.dropped_rows) == (1, 2, 5)


@pytest.mark.parametrize("block", [4, 32, 128])
def test_affine_scan_does_not_depend_on_blocks(spark, block):
    got = affine_scan(market(spark, walk(150)), F.lit(0.9), F.col("close") * 0.1, "y", block=block).orderBy("timestamp").toPandas()
    y = 0.0
    for x, z in zip(got.close, got.y, strict=True):
        y = 0.9 * y + 0.1 * x
        assert abs(y - z) < 1e-9


def test_ewma_with_gaps_equals_pandas(spark):
    xs = [None, 1.0, 2.0, None, None, 4.0, 3.0, None, 5.0]
    rows = spark.createDataFrame([(T0 + dt.timedelta(hours=i), "A", x) for i, x in enumerate(xs)], "timestamp timestamp, symbol string, x double")
    got = ewma(rows, F.col("x"), span_alpha(5), "y", min_periods=2).orderBy("timestamp").toPandas().y
    want = pd.Series(xs, dtype=float).ewm(span=5, adjust=False, min_periods=2).mean()
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_kalman_equals_the_loop(spark):
    got = kalman(market(spark, walk(300)), F.col("close"), "y").orderBy("timestamp").toPandas()
    level, p = 0.0, 1.0
    for x, z in zip(got.close, got.y, strict=True):
        p += 0.01
        g = p / (p + 0.25)
        level, p = level + g * (x - level), (1 - g) * p
        assert abs(level - z) < 1e-9


def test_rsi_limits(spark):
    up = X.rsi(market(spark, range(1, 20))).orderBy("timestamp").toPandas().rsi_14
    flat = X.rsi(market(spark, [5] * 20)).orderBy("timestamp").toPandas().rsi_14
    assert up.isna()[:14].all() and (up[14:] == 100).all() and (flat[14:] == 50).all()


def test_mad_clip(spark):
    got = X.mad_clip(market(spark, [1, 2, 3, 100]), ["close"], 3, 1.0).orderBy("timestamp").toPandas()
    assert got.close_clipped.tolist() == [1, 2, 3, 3.0]
    same = X.mad_clip(market(spark, [1, 1, 1, 5]), ["close"], 3, 1.0).orderBy("timestamp").toPandas()
    assert same.close_clipped.tolist() == [1, 1, 1, 5]  # no variation: unchanged


def test_prices_of_zero_give_what_the_sql_gives(spark):
    rows = market(spark, [3, 1, 2, 0, 4]).withColumn("low", F.when(F.col("close") == 1, 0.0).otherwise(F.col("close")))
    got = K.range_volatility(X.sma_distance(X.range_position(rows, 2), 1), 2).orderBy("timestamp").toPandas()
    inf = math.inf
    assert [str(x) for x in got.distance_from_2h_low] == ["nan", "inf", "inf", "nan", "inf"]
    assert [str(x) for x in got.sma_1_distance] == ["0.0", "0.0", "0.0", "nan", "0.0"]
    assert got.parkinson[1:].tolist() == [inf, inf, inf, inf]
    known = X.range_position(rows, 2).orderBy("timestamp").select(F.isnull("distance_from_2h_low").alias("x")).toPandas().x
    assert known.tolist() == [True, False, False, False, False]


def test_clipping_takes_infinite_values_and_nan_as_greatest(spark):
    values = [1.0, 2.0, 4.0, math.inf, math.nan, 3.0, None, 9.0]
    rows = market(spark, range(8)).join(spark.createDataFrame([(float(i), v) for i, v in enumerate(values)], "close double, x double"), "close")
    got = [r.x_clipped for r in X.mad_clip(rows, ["x"], 3, 1.0).orderBy("timestamp").collect()]
    assert got[:3] == [1, 2, 4] and got[3:5] == [3, 6] and math.isnan(got[5]) and got[6:] == [None, 9]


def test_equal_weight_past_a_price_of_zero(spark):
    one = L.equal_weight(market(spark, [2, 0, 5, 10])).first()
    assert (one.n_bars, one.mean_return) == (3, math.inf) and math.isnan(one.total_return)
    grown = L.equal_weight(market(spark, [10.0**k for k in range(0, 330, 30)])).first()
    shown = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (None,), (-12345.678,)], "x double").select(scientific("x", 5).alias("s"))
    assert math.isclose(grown.total_return, 1e300, rel_tol=1e-9) and [r.s for r in shown.collect()] == ["inf", "-inf", "nan", None, "-1.23457e+04"]


def test_ledger_costs_are_rounded_once(spark):
    closes = [x / 7 for x in range(10, 60)]
    rows = market(spark, closes).withColumn("signal", F.when(F.col("close") * 7 % 2 < 1, 1).otherwise(0))
    w = 1.0
    for fill in L.trades(rows).orderBy("timestamp").collect():
        raw = next(c for c in closes if abs(fill.price / c - (1.0005 if fill.side == "BUY" else 0.9995)) < 1e-9)
        w *= 1 / (raw * 1.0015005) if fill.side == "BUY" else raw * 0.9985005
        if fill.side == "BUY":
            assert fill.quantity == 10_000.0 * w


def test_labels(spark):
    rows = market(spark, [100, 100.3, 100.55, 100.65])
    got = X.label(rows, 1, 0.0025).orderBy("timestamp").toPandas().target
    assert got.isna().tolist() == [False, False, False, True] and got[:3].astype(int).tolist() == [1, 0, 0]


@pytest.mark.parametrize("make", [lambda d: X.build(d, ["baseline", "volatility"], 10, 4.0), K.adx, K.macd, K.bollinger, K.vol_regime, lambda d: X.regime(d, 5)])
def test_the_past_does_not_know_the_future(spark, make):
    closes = walk(60)
    changed = closes[:50] + [c * 3 for c in closes[50:]]
    a, b = (make(market(spark, c)).orderBy("timestamp").toPandas()[:50] for c in (closes, changed))
    pd.testing.assert_frame_equal(a, b)


def test_symbols_do_not_mix(spark):
    one = market(spark, walk(60))
    both = one.unionByName(market(spark, walk(60, 3), "B"))
    a, b = (K.macd(X.rsi(d)).where("symbol = 'A'").orderBy("timestamp").toPandas() for d in (one, both))
    pd.testing.assert_frame_equal(a, b)


def test_ledger_by_hand(spark):
    rows = market(spark, [100, 110, 120]).join(spark.createDataFrame([(T0 + dt.timedelta(hours=i), s) for i, s in enumerate([1, 0, 0])], "timestamp timestamp, signal int"), "timestamp")
    t = L.trades(rows, fee=0.002, slip=0.001).orderBy("timestamp").toPandas()
    assert t.side.tolist() == ["BUY", "SELL"]
    assert t.price[0] == pytest.approx(110 * 1.001) and t.quantity[0] == pytest.approx(10000 / (110 * 1.001 * 1.002))
    e = L.equity(rows, fee=0.002, slip=0.001).orderBy("timestamp").toPandas().equity
    assert e.iloc[-1] == pytest.approx(t.quantity[0] * 120 * 0.999 * 0.998)


def test_ledger_against_a_loop(spark):
    closes, fee, slip = walk(200), 0.001, 0.0005
    signals = [int((i // 7) % 2) for i in range(200)]
    rows = market(spark, closes).join(spark.createDataFrame([(T0 + dt.timedelta(hours=i), s) for i, s in enumerate(signals)], "timestamp timestamp, signal int"), "timestamp")
    cash, q, want = 10_000.0, 0.0, []
    for i, c in enumerate(closes):
        if i + 1 < len(closes):
            o = closes[i + 1]
            if signals[i] and not q:
                q, cash = cash / (o * (1 + slip) * (1 + fee)), 0.0
            elif not signals[i] and q:
                cash, q = q * o * (1 - slip) * (1 - fee), 0.0
        want.append(cash + q * c * (1 - slip) * (1 - fee))
    got = L.equity(rows).orderBy("timestamp").toPandas().equity
    assert max(abs(a / b - 1) for a, b in zip(got, want, strict=True)) < 1e-9


def test_metrics_without_trades(spark):
    rows = market(spark, walk(30)).withColumn("signal", F.lit(0))
    m = L.metrics(L.equity(rows), L.trades(rows)).first()
    assert (m.total_return, m.n_trades, m.sharpe, m.profit_factor) == (0.0, 0, None, None)


def test_lexicon_and_tags(spark):
    df = spark.createDataFrame([("Good, good BAD.",), ("",), (None,), ("goods",)], "text string")
    assert [r[0] for r in T.lexicon_score(df, "text", ["good"], ["bad"]).select(F.round("sentiment_score", 4)).collect()] == [0.3333, 0.0, 0.0, 0.0]
    assert [r.symbol for r in T.tag_symbols(df, "text", {"G": ["good"], "B": ["bad"]}).collect()] == ["G", "B"]


def test_as_of_takes_equal_times(spark):
    left = spark.createDataFrame([("A", 5), ("A", 7), ("B", 1)], "k string, t int")
    right = spark.createDataFrame([("A", 5, 1.0), ("A", 6, 2.0)], "k string, t int, v double").withColumnRenamed("t", "u")
    back = {(r.k, r.t): r.v for r in as_of(left, right, ["k"], F.col("t"), F.col("u"), ["v"]).collect()}
    ahead = {(r.k, r.t): r.v for r in as_of(left, right, ["k"], F.col("t"), F.col("u"), ["v"], forward=True).collect()}
    assert back == {("A", 5): 1.0, ("A", 7): 2.0, ("B", 1): None} and ahead == {("A", 5): 1.0, ("A", 7): None, ("B", 1): None}


def test_folds_do_not_leak(spark):
    folds = V.walk_forward(spark.createDataFrame([("A", 300)], "symbol string, n long"), 100, 50, 25, gap=12).collect()
    assert folds and all(f.train_end + 12 == f.test_start < f.test_end <= 300 for f in folds)
    k = V.purged_kfold(spark.createDataFrame([("A", 100)], "symbol string, n long"), 4, 5).orderBy("fold").collect()
    assert [(f.test_start, f.test_end) for f in k] == [(0, 25), (25, 50), (50, 75), (75, 100)] and k[1].train_before_end == 20


def test_logistic_equals_newton(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] + 0.5)))).astype(float)
    df = spark.createDataFrame([("c", float(a), float(b), float(t)) for (a, b), t in zip(x, y, strict=True)], "cell string, a double, b double, target double")
    got = V.fit_logistic(df, ["a", "b"], ["cell"], steps=8).first().beta
    d, beta = np.c_[np.ones(400), x], np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ beta))
        beta += np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + np.eye(3), d.T @ (y - p) - beta)
    assert np.abs(np.array(got) - beta).max() < 1e-6


def test_stream_filters_equal_batch(spark, small):
    from tidemark.plans import market_queries, registry

    got = registry.QUERIES["stream_filters"](spark, small).toPandas().sort_values(["symbol", "t"]).reset_index(drop=True)
    rows = kalman(ewma(market_queries.bars(spark, small), F.col("close"), 2 / 13, "ewma"), F.col("close"), "kalman")
    want = registry.result(rows, "symbol", "timestamp", "ewma", "kalman").toPandas().sort_values(["symbol", "t"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, atol=2e-6, rtol=0)


def test_normalize_and_check(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "A", "1", "2", "1", "x", "5"), ("bad", " ", "1", "2", "0", "1", "-5")], "timestamp string, symbol string, open string, high string, low string, close string, volume string")
    broken = {(r.symbol, r.rule) for r in C.check(C.normalize(rows)).collect()}
    assert broken == {("A", "not_numeric"), ("", "invalid_timestamp"), ("", "empty_symbol"), ("", "price_not_positive"), ("", "negative_volume")}
    assert C.valid(C.normalize(rows)).count() == 0
