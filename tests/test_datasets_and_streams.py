"""Sentiment datasets, mergeable sketches, streaming state with timers and time to live, late rows, importances."""

from __future__ import annotations

import hashlib
import math
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ranks import shuffled_place
from tidemark.functions.shared import new_path
from tidemark.operators import ledger as L
from tidemark.operators import sketches as SK
from tidemark.plans import experiments as E
from tidemark.plans import models as M
from tidemark.sources import datasets as D
from tidemark.sources import sentiment as DS
from tidemark.streaming import stream as S


def at(hours: float) -> datetime:
    return datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=hours)


def tables(spark, n=100):
    posts = spark.createDataFrame([(f"p{i}", f"s{i % 3}", at(i), "t", None if i % 7 == 0 else "", i) for i in range(n)], "submission_id string, subreddit string, created_utc timestamp, title string, selftext string, score int")
    comments = spark.createDataFrame([(f"c{i}", f"p{i}", at(i), "b") for i in range(n)], "comment_id string, submission_id string, created_utc timestamp, body string")
    return posts, comments


def test_sentiment_dataset_round_trip(spark, tmp_path):
    posts, comments = tables(spark)
    path = f"file://{tmp_path}/d"
    DS.write_posts(posts, comments, path, "one", "test")
    back = DS.read_table(spark, path, "submissions", verify=True)
    assert back.columns == [n for n, _ in DS._columns(DS.POSTS)]
    assert {(r.submission_id, r.selftext, r.score) for r in back.collect()} == {(r.submission_id, r.selftext, r.score) for r in posts.collect()}
    assert DS.read_table(spark, path, "comments").count() == 100
    about = {r.table: r for r in DS.read_metadata(spark, path).collect()}
    assert about["submissions"].row_count == 100 and about["comments"].dataset_id == "one" and about["submissions"].start == 1704067200
    part = DS.read_table(spark, path, "submissions", F.lit("2024-01-02 12:00:00").cast("timestamp"), F.lit("2024-01-03 00:00:00").cast("timestamp"))
    assert part.count() == 13
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan  # only the days between are read
    with pytest.raises(ValueError):
        DS.write_posts(posts, comments, path, "one", "test")


def test_half_datasets_and_changed_rows_are_refused(spark, tmp_path):
    posts, comments = tables(spark, 10)
    path = f"file://{tmp_path}/half"
    DS._write_by_day(DS.normalize(posts, DS.POSTS, "submission_id"), f"{path}/submissions", "created_utc")
    with pytest.raises(ValueError, match="no whole dataset"):
        DS.read_table(spark, path, "submissions")
    with pytest.raises(ValueError):
        DS.write_posts(posts.union(posts), comments, f"file://{tmp_path}/twice", "x", "t")
    whole = f"file://{tmp_path}/whole"
    DS.write_posts(posts, comments, whole, "x", "t")
    DS.read_table(spark, whole, "comments", verify=True)
    spark.read.parquet(f"{whole}/comments").limit(1).withColumn("body", F.lit("more")).write.mode("append").partitionBy("day").parquet(f"{whole}/comments")
    with pytest.raises(ValueError, match="do not fit"):
        DS.read_table(spark, whole, "comments", verify=True)


def test_hourly_dataset(spark, tmp_path):
    hours = spark.createDataFrame([(at(i), 0.5 * i) for i in range(30)], "timestamp timestamp, sentiment_mean double")
    path = f"file://{tmp_path}/h"
    DS.write_hourly(hours, path, "hourly", "one")
    assert DS.read_table(spark, path, "hourly", verify=True).count() == 30
    assert DS.read_metadata(spark, path).first().source_dataset_id == "one"
    with pytest.raises(ValueError):
        DS.write_hourly(hours.union(hours.limit(1)), f"{path}2", "hourly", "one")


def test_results_and_reports(spark, tmp_path):
    df = spark.range(5)
    D.write_report({"trades": df, "equity": df.limit(2)}, f"file://{tmp_path}/r", "a")
    D.write_table(df, f"file://{tmp_path}/r", "rows", "a", "csv")
    assert spark.read.parquet(f"file://{tmp_path}/r/run=a/trades").count() == 5
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r/run=a/rows").count() == 5
    with pytest.raises(Exception):  # noqa: B017
        D.write_table(df, f"file://{tmp_path}/r", "rows", "a", "csv")
    a, b = D.frame_signature(df).first(), D.frame_signature(df.orderBy(F.col("id").desc())).first()
    assert a == b and a != D.frame_signature(df.limit(4)).first()


def test_sketches_merge_within_their_bounds(spark):
    posts = spark.range(60_000).select(F.lit("A").alias("symbol"), F.timestamp_seconds(1704067200 + F.col("id") * 4).alias("timestamp"), F.concat(F.lit("s"), F.col("id") % 9000).alias("source"), ((F.col("id") * 7919) % 60_000 / 60_000.0).alias("sentiment_score"))
    got = SK.estimates(SK.roll_up(SK.hourly(posts), period=F.lit("2024-01-01").cast("timestamp"))).first()
    assert got.n == 60_000 and abs(got.n_sources - 9000) < 9000 * 4 * 1.04 / 64
    assert all(abs(got[f"q_{int(q * 100)}"] - q) < 4 * 1.7 / 400 for q in (0.25, 0.5, 0.75)) and abs(got["mean"] - 0.5) < 1e-3
    empty = SK.estimates(SK.hourly(posts.limit(2).withColumn("sentiment_score", F.lit(None).cast("double")))).first()
    assert empty.n == 0 and empty.q_50 is None and empty["mean"] is None


# Streams.


@pytest.fixture()
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_cooldown_state_expires_and_comes_back(spark, state_store):
    source, checkpoint, schema = new_path(spark, "ttl"), new_path(spark, "stream"), "symbol string, timestamp timestamp, is_exit boolean"

    def push(*rows):
        spark.createDataFrame([(s, at(h), e) for s, h, e in rows], schema).coalesce(1).write.mode("append").parquet(source)
        got = S.run_to_table(S.cooldown(spark.readStream.schema(schema).parquet(source), 100, keep=5 * 3600), checkpoint)
        return {int(r.timestamp.timestamp() - at(0).timestamp()) // 3600: r.cooling for r in got.where("symbol = 'A'").collect()}

    assert push(("A", 0, True), ("A", 1, False)) == {0: 1, 1: 1}
    assert push(("A", 3, False))[3] == 1  # the exit is remembered
    push(("B", 50, False))  # time passes, which another symbol shows
    assert push(("A", 60, False))[60] == 0  # and it is forgotten, though 100 hours are not over
    assert push(("A", 61, True), ("A", 62, False)) == {0: 1, 1: 1, 3: 1, 60: 0, 61: 1, 62: 1}  # the key is there again


def bars(spark, n=90, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("A", "B"):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        rows += [(s, at(3 * i), float(p), float(p * 1.01), int(rng.random() < 0.5)) for i, p in enumerate(price)]
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp, open double, close double, signal int")


def test_streaming_ledger_equals_the_batch(spark, state_store):
    rows, source = bars(spark), new_path(spark, "ledger")
    beat = spark.createDataFrame([("~", at(10_000), 1.0, 1.0, 0)], rows.schema)
    for low, high in ((0, 60), (60, 150), (150, 10**6)):
        rows.union(beat).where((F.unix_seconds("timestamp") >= 1704067200 + low * 3600) & (F.unix_seconds("timestamp") < 1704067200 + high * 3600)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = S.run_to_table(S.ledger(stream, daily=0.02, most=0.1), new_path(spark, "stream")).where("symbol != '~'").toPandas()
    wanted = L.equity(rows)
    mine = got[got.kind == "bar"].sort_values(["symbol", "t"])
    theirs = wanted.select("symbol", F.unix_seconds("timestamp").alias("t"), "position", "equity").toPandas().sort_values(["symbol", "t"])
    assert mine.t.tolist() == theirs.t.tolist() and mine.position.astype(int).tolist() == theirs.position.tolist()
    np.testing.assert_allclose(mine.equity, theirs.equity, rtol=1e-12)
    days = got[got.kind == "day"].sort_values(["symbol", "t"])
    halts = L.risk_halts(wanted, daily=0.02, most=0.1).toPandas().sort_values(["symbol", "day"])
    assert (days.t // 86400).tolist() == halts.day.tolist() and days.halt.astype(int).tolist() == halts.halt.tolist() and halts.halt.nunique() == 2
    np.testing.assert_allclose(days.drawdown, halts.drawdown, atol=1e-12)
    np.testing.assert_allclose(days.daily_return.astype(float), halts.daily_return.astype(float), atol=1e-12)


def test_late_rows_are_kept_apart(spark):
    source, schema = new_path(spark, "late"), "k int, time timestamp"
    for rows in ([(1, at(0)), (2, at(10))], [(3, at(7.5)), (4, at(8)), (5, at(9)), (6, None)], [(7, at(20)), (8, at(7.9))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    rows, late = S.split_late(stream, "time", 7200, new_path(spark, "stream"))
    assert {(r.k, r.batch_id) for r in late.collect()} == {(3, 1), (8, 2)}
    assert {r.k for r in rows.collect()} == {1, 2, 4, 5, 6, 7}


# Models.


def test_importance_by_hand(spark):
    rows = spark.createDataFrame([("A", i, float(i - 2), 1.0, int(i > 2)) for i in range(6)] + [("A", 9, 1.0, 1.0, None)], "symbol string, id int, x double, c double, target int")
    beta = spark.createDataFrame([("A", [0.1, 2.0, 5.0]), ("B", None)], "symbol string, beta array<double>")
    got = {r.feature: r for r in M.permutation_importance(rows, beta, ["x", "c"], ["symbol"], F.col("id"), seed=3).collect()}
    order = lambda *parts: sorted(range(6), key=lambda i: hashlib.md5(":".join([*parts, str(i)]).encode()).hexdigest())
    given = dict(zip(order("3"), [float(i - 2) for i in order("3", "x")], strict=True))
    loss = lambda eta, y: math.log(1 + math.exp(-eta if y else eta))
    base = [loss(0.1 + 2 * (i - 2) + 5, i > 2) for i in range(6)]
    dealt = [loss(0.1 + 2 * given[i] + 5, i > 2) for i in range(6)]
    assert abs(got["x"].importance - (sum(dealt) - sum(base)) / 6) < 1e-9 and abs(got["c"].importance) < 1e-12
    assert {f: r.place for f, r in got.items()} == ({"x": 1, "c": 2} if got["x"].importance > 0 else {"c": 1, "x": 2})


def test_shuffled_places_are_a_permutation(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), "id")
    got = shuffled_place(df, ["k"], "place", F.lit("s"), "id").toPandas()
    for k, own in got.groupby("k"):
        wanted = sorted(own.id, key=lambda i: hashlib.md5(f"s:{i}".encode()).hexdigest())
        assert own.sort_values("place").id.tolist() == wanted and own.place.min() == 0


def test_saved_models_and_votes(spark, tmp_path):
    rng = np.random.default_rng(0)
    train = spark.createDataFrame([(float(a), float(b), float(a + 0.1 * b > 0)) for a, b in rng.normal(size=(200, 2))], "a double, b double, target double")
    model = E.pipeline(["a", "b"], E.estimators()["logistic"]).fit(train)
    path = f"file://{tmp_path}/m"
    E.save_model(model, path, ["a", "b"], spark)
    again = E.load_model(path, ["a", "b"], spark)
    same = [[list(r.probability) for r in m.transform(train.limit(20)).select("probability").collect()] for m in (model, again)]
    assert same[0] == same[1]
    with pytest.raises(ValueError):
        E.load_model(path, ["b", "a"], spark)
    votes = E.soft_vote(spark.createDataFrame([(0.2, 0.4), (None, 0.6), (None, None)], "p double, q double"), ["p", "q"]).collect()
    assert [None if v.probability is None else round(v.probability, 9) for v in votes] == [0.3, 0.6, None]


def test_balanced_weights_and_actions(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "y int")
    assert sorted((r.y, r.weight) for r in E.balanced_weights(df.na.drop(), "y").collect()) == [(0, 4 / 6), (0, 4 / 6), (0, 4 / 6), (1, 2.0)]
    p = spark.createDataFrame([(0.2, 0.3, 0.5), (0.4, 0.4, 0.2), (0.1, 0.8, 0.1), (None, None, None)], "d double, f double, u double")
    assert [r.action for r in E.argmax_action(p, {-1: "d", 0: "f", 1: "u"}).collect()] == ["BUY", "SELL", "HOLD", "HOLD"]
