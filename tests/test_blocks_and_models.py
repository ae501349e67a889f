"""Long series in blocks, models fitted per cell, single-pass metrics, ranks and distributions: against plain versions."""

from __future__ import annotations

import time
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import blocks as B
from tidemark.functions.distributions import log_gamma, regularized_beta, t_test_p
from tidemark.functions.ranks import global_place, salted_join
from tidemark.functions.windows import ewmas
from tidemark.operators import features as X
from tidemark.operators import ledger as L
from tidemark.operators import text as T
from tidemark.plans import models as M
from tidemark.plans import registry
from tidemark.plans import validation as V

CANDLES = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume double"


def at(hours: int) -> datetime:
    return datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=hours)


@pytest.fixture(scope="module")
def candles(spark):
    """Two series of several blocks, one shorter than a halo, one of a null symbol; gaps and missing closes."""
    rng = np.random.default_rng(4)
    rows = []
    for symbol, n in (("long", 3000), ("mid", 700), ("short", 30), (None, 300)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        hours = np.cumsum(rng.integers(1, 4, n))
        for h, c, v in zip(hours, close, rng.integers(1, 50, n), strict=True):
            rows.append((symbol, at(int(h)), float(c), float(c * 1.01), float(c * 0.99), None if symbol == "mid" and h % 41 == 0 else float(c), float(v)))
    return spark.createDataFrame(rows, CANDLES).cache()


def same(a, b, cols, keys=("symbol", "timestamp")):
    left, right = (d.select(*keys, *cols).toPandas().sort_values(list(keys)).reset_index(drop=True) for d in (a, b))
    pd.testing.assert_frame_equal(left, right, check_exact=False, rtol=1e-9, atol=1e-12)


def test_rows_are_numbered(candles):
    got = B.numbered(candles, span=7 * 86400).toPandas()
    for _, own in got.groupby("symbol", dropna=False):
        assert own.sort_values("timestamp")._pos.tolist() == list(range(len(own)))


def plain_features(rows):
    rows = X.volume_ratio(X.realized_vol(X.returns(rows)))
    rows = X.vol_percentile(X.vol_change(X.rsi(rows)))
    return X.rolling_zscore(rows, F.col("volume"), 168, "z")


def test_blocks_equal_plain_windows(candles):
    cols = ["return_72h", "realized_volatility_24h", "volume_ratio_24h", "rsi_14", "realized_volatility_change_24h", "volatility_percentile_168h", "z"]
    same(B.in_blocks(candles, plain_features, X.LONGEST, block=256), plain_features(candles), cols)
    ahead = lambda d: X.label(d, 12, 0.001)
    same(B.in_blocks(candles, ahead, 0, 12, block=100), ahead(candles), ["next_return", "target"])


def test_blocks_are_many_tasks(spark):
    rows = spark.range(200_000).select(F.lit("one").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("timestamp"), (F.sin(F.col("id") / 50) + 2).alias("close"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = B.in_blocks(rows, X.returns, 72, block=4096, span=86400).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in got) == 200_000 and len(got) >= 8 and max(r["count"] for r in got) < 60_000


def test_running_values(candles):
    got = B.running(candles, {"total": ("sum", F.col("volume")), "top": ("max", F.col("close")), "low": ("min", F.col("close")), "grown": ("product", 1 + F.col("volume") / 1e4), "earlier": ("max", F.col("close"))}, block=128, before=["earlier"]).toPandas()
    for _, own in got.groupby("symbol", dropna=False):
        own = own.sort_values("timestamp")
        np.testing.assert_allclose(own.total, own.volume.cumsum())
        np.testing.assert_allclose(own.top, own.close.cummax().ffill())
        np.testing.assert_allclose(own.low, own.close.cummin().ffill())
        np.testing.assert_allclose(own.grown, (1 + own.volume / 1e4).cumprod(), rtol=1e-9)
        np.testing.assert_allclose(own.earlier.iloc[1:], own.close.cummax().ffill().shift().iloc[1:])


def test_means_in_blocks(candles):
    means = {"fast": (F.col("close"), 0.2, 5), "slow": (F.col("close"), 0.01, 20)}
    same(B.ewmas_in_blocks(candles, means, block=64), ewmas(candles, means), ["fast", "slow"])


def test_clip_equals_its_definition(candles):
    got = X.mad_clip(candles, ["close", "volume"], 24, 2.0, block=100).toPandas()
    for _, own in got.groupby("symbol", dropna=False):
        own = own.sort_values("timestamp").reset_index(drop=True)
        for c in ("close", "volume"):
            x = own[c]
            for i in range(len(x)):
                frame = x[max(0, i - 24) : i]
                wanted = x[i]
                if len(frame) == 24 and frame.notna().all() and pd.notna(x[i]):
                    mad = (frame - frame.median()).abs().median()
                    wanted = min(max(x[i], frame.median() - 2 * mad), frame.median() + 2 * mad) if mad > 0 else x[i]
                assert own[f"{c}_clipped"][i] == wanted or (pd.isna(wanted) and pd.isna(own[f"{c}_clipped"][i]))
    assert X.mad_clip(candles, []).columns == candles.columns


def test_run_metrics_equal_the_ledger(candles):
    rows = candles.na.drop().withColumn("signal", (F.pmod(F.xxhash64("timestamp"), F.lit(5)) < 2).cast("int"))
    one, other = L.run_metrics(rows), L.metrics(L.equity(rows), L.trades(rows))
    same(one, other, sorted(set(other.columns) - {"symbol"}), ["symbol"])


# Models.


def newton(x, y, c):
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(c * (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(b)), c * x.T @ (y - p) - b)
    return b


@pytest.fixture(scope="module")
def labeled(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s in ("A", "B"):
        for i in range(400):
            a, b = rng.normal(size=2)
            state = None if i < 5 else "up" if (i // 40) % 2 else "down"
            p = 1 / (1 + np.exp(-(a if state == "up" else -a)))
            price = float(100 + i % 7)
            rows.append((s, at(i), price, price, None if i % 50 == 3 else float(a), float(b), state, None if i == 399 else int(rng.random() < p)))
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp, open double, close double, a double, b double, state string, target int").cache()


def test_cells_equal_newton_in_numpy(labeled):
    candidates = [M.Candidate("one", ("a", "b")), M.Candidate("states", ("a",), state="state"), M.Candidate("cash", ("a",), cash=F.col("state") == "down"), M.Candidate("recent", ("a",), window=50), M.Candidate("tight", ("a", "b"), c=0.01)]
    scored, cells = M.fit_and_route(labeled, candidates, ["symbol"], 100, 60, 60)
    got = {(r.symbol, r.variant, r.fold, r.cell): r for r in cells.collect()}
    frame = labeled.toPandas().sort_values("timestamp")
    points = scored.toPandas()
    for s, own in frame.groupby("symbol"):
        own = own.reset_index(drop=True)
        for fold, start, end in ((0, 100, 160), (3, 280, 320), (V.HOLDOUT, 320, 400)):
            for c in candidates:
                train = own[max(0, start - (c.window or start)) : start]
                train = train[train.target.notna()]
                for cell in ("up", "down") if c.state else ("all",):
                    part = train[train.state == cell] if c.state else train
                    x = part[list(c.features)].fillna(part[list(c.features)].median())
                    scale = x.std(ddof=0)
                    beta = newton(((x - x.mean()) / scale).to_numpy(), part.target.to_numpy(float), c.c)
                    r = got[s, c.name, fold, cell]
                    assert r.status == "ok" and r.n_train == len(part)
                    named = dict(zip(["1", "a", "b"], r.beta, strict=True))
                    np.testing.assert_allclose([named["1"], *[named[f] for f in c.features]], beta, atol=1e-8)
                    assert all(named[f] == 0 for f in ("a", "b") if f not in c.features)
                    tested = own[start:end]
                    tested = tested[tested.target.notna() & ((tested.state == cell) if c.state else True)]
                    z = ((tested[list(c.features)].fillna(part[list(c.features)].median()) - x.mean()) / scale).to_numpy()
                    wanted = 1 / (1 + np.exp(-(beta[0] + z @ beta[1:])))
                    if c.cash is not None:
                        wanted = np.where(tested.state == "down", -1, wanted)
                    mine = points[(points.symbol == s) & (points.variant == c.name) & (points.fold == fold)]
                    if c.state:
                        mine = mine[mine.state == cell]
                    np.testing.assert_allclose(mine.sort_values("timestamp").probability, wanted, atol=1e-8)


def test_folds_without_a_model_are_skipped(labeled):
    rows = labeled.withColumn("target", F.when(F.col("state") == "down", 0).otherwise(F.col("target"))).withColumn("state", F.when(F.hour("timestamp") == 0, "rare").otherwise(F.col("state")))
    scored, cells = M.fit_and_route(rows, [M.Candidate("one", ("a",)), M.Candidate("states", ("a",), state="state")], ["symbol"], 100, 60, 60)
    status = {(r.variant, r.cell, r.status) for r in cells.where("fold = 0").collect()}
    assert ("states", "down", "one_class") in status and ("states", "rare", "too_few") in status and ("one", "all", "ok") in status
    assert {r.variant for r in scored.select("variant").distinct().collect()} == {"one"}
    folds = {(r.variant, r.status) for r in M.fold_status(scored, cells, ["symbol"]).collect()}
    assert folds == {("one", "ok"), ("states", "skipped")}


def summary(spark, rows):
    names = "symbol string, variant string, fold int, threshold double, total_return double, max_drawdown double, turnover double, exposure double, n_trades long, buy_hold_return double"
    return spark.createDataFrame(rows, names)


def test_ranks_and_decisions(spark):
    def row(variant, fold, threshold, r, dd=-0.1, turn=1.0, n=2, held=0.0):
        return ("A", variant, fold, threshold, r, dd, turn, 0.5, n, held)

    rows = [row("first", f, 0.3, 0.02) for f in (0, 1, 2)] + [row("same", f, 0.3, 0.02 + 1e-13) for f in (0, 1, 2)] + [row("calm", f, 0.3, 0.02, -0.05) for f in (0, 1, 2)] + [row("bad", f, 0.3, -0.5) for f in (0, 1, 2)]
    rows += [row(v, V.HOLDOUT, 0.3, r, held=0.01) for v, r in (("first", 0.5), ("same", 0.5), ("calm", 0.005), ("bad", 0.9))]
    order = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(("first", "same", "calm", "bad")) for x in (v, i)]), F.col("variant"))
    got = {r.variant: (r.rank, r.decision) for r in V.select_and_confirm(summary(spark, rows), ["symbol", "variant"], "return", among=["symbol"], candidate_order=[order]).collect()}
    # the smaller drawdown first, then the candidates' order; the holdout ranks nothing, and only the first is decided on
    assert got == {"calm": (1, "not_confirmed"), "first": (2, None), "same": (3, None), "bad": (None, None)}


# Ranks, joins, distributions, lexicons.


def test_places_in_a_global_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), "id")
    placed, total = global_place(df.repartition(5), ["x"], "place")
    got = placed.orderBy("x").toPandas()
    assert total == 5000 and got.place.tolist() == list(range(5000))
    assert global_place(df.limit(0), ["x"], "place")[1] == 0
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_salted_join_is_a_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 5), (3, 6)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    assert sorted(map(tuple, salted_join(left, right, ["k"], 4).collect())) == sorted(map(tuple, left.join(right, ["k"]).collect()))
    assert salted_join(left, right, ["k"], 4, "left").count() == 102


def test_distributions(spark):
    t = spark.createDataFrame([(2.0, 10, 0.07338803477074039), (1.0, 1, 0.5), (2.2281388519649385, 10, 0.05), (0.0, 5, 1.0), (12.706204736432095, 1, 0.05), (1.959963984540054, 10**7, 0.05), (-2.0, 10, 0.07338803477074039)], "t double, n long, p double")
    for r in t.select("p", "n", t_test_p(F.col("t"), F.col("n")).alias("q")).collect():
        assert abs(r.p - r.q) < (1e-9 if r.n < 10**6 else 1e-7)
    assert t.limit(1).select(t_test_p(F.col("t"), F.lit(0)).alias("q")).first().q is None
    (r,) = spark.range(1).select(log_gamma(F.lit(0.5)).alias("half"), log_gamma(F.lit(10.0)).alias("ten"), regularized_beta(F.lit(2.0), F.lit(3.0), F.lit(0.4)).alias("i")).collect()
    assert abs(r.half - 0.5723649429247001) < 1e-12 and abs(r.ten - np.log(362880)) < 1e-11 and abs(r.i - 0.5248) < 1e-12


def test_lexicons_and_patterns_as_tables(spark):
    posts = spark.createDataFrame([(1, "Good, good day! bad"), (2, None), (3, "nothing here"), (4, "the BIG apple is big"), (5, "big  apple")], "id long, text string")
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -1.0), ("day", 2.0), ("day", 1.0)], "word string, weight double")
    got = {r.id: r.s for r in T.lexicon_scores(posts, "id", "text", lexicon, "s").collect()}
    assert got == {1: (2 + 3 - 1) / 6, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}
    patterns = spark.createDataFrame([("NYC", "big apple"), ("DAY", "day"), ("NYC", "Big Apple"), ("NO", "apple big")], "symbol string, pattern string")
    tagged = {(r.id, r.symbol) for r in T.tag_by_patterns(posts, "id", "text", patterns).collect()}
    assert tagged == {(1, "DAY"), (4, "NYC"), (5, "NYC")}
    with pytest.raises(ValueError):
        T.tag_by_patterns(posts, "id", "text", spark.createDataFrame([("X", "a b c d e f")], "symbol string, pattern string"))
    many = spark.range(100_000).select(F.lit("S").alias("symbol"), F.concat(F.lit("w"), "id").alias("pattern"))
    few, lots = (len(T.tag_by_patterns(posts, "id", "text", p)._jdf.queryExecution().optimizedPlan().toString()) for p in (patterns, many))
    assert lots < few + 4000  # patterns are rows of a table, not words of the plan


def test_each_post_meets_every_symbol(spark, small):
    rows = registry.QUERIES["join_as_of_forward"](spark, small)
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    kinds = spark.read.parquet(f"{small}/events.parquet").select("event_type").distinct().count()
    assert kinds > 1 and rows.count() == n * kinds == rows.select("doc_id", "symbol").distinct().count()


def test_a_long_text_of_different_words_is_tagged_in_linear_time(spark):
    posts = spark.range(2).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60_000)), lambda x: F.concat(F.lit("w"), x)), " ").alias("text"))
    patterns = spark.createDataFrame([("A", "w59999 w60000"), ("B", "w60000 w0"), ("C", "w7"), ("D", "w1 w2 w3")], "symbol string, pattern string")
    start = time.time()
    got = {(r.id, r.symbol) for r in T.tag_by_patterns(posts, "id", "text", patterns).collect()}
    assert got == {(k, s) for k in (0, 1) for s in "ACD"} and time.time() - start < 60


def test_listed_words_are_added_up_in_one_shuffle_of_sums(spark):
    posts = spark.createDataFrame([(1, "a b a")], "id long, text string")
    lexicon = spark.createDataFrame([("a", 1.0)], "word string, weight double")
    plan = T.lexicon_scores(posts, "id", "text", lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" not in plan  # words are not counted, and shuffled, before they meet the lexicon


def test_sentiment_join_takes_the_last_row(spark):
    market = spark.createDataFrame([(at(0), "A"), (at(0), "B"), (at(1), "A")], "timestamp timestamp, symbol string")
    hourly = spark.createDataFrame([(at(0), "A", 0.9, 1), (at(0), "A", 0.1, 2), (at(0), "B", 0.5, 1)], "timestamp timestamp, symbol string, s double, seq int")
    got = {(r.symbol, r.timestamp.hour): (r.s, r.sentiment_join_missing) for r in T.join_sentiment(market, hourly, ["s"], ["timestamp", "symbol"], "seq").collect()}
    assert sorted(got.values()) == [(0.0, 1), (0.1, 0), (0.5, 0)]
