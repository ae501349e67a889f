"""Sources and sinks: round trips, refusals, CSV ingest."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import study as Y
from tidemark.sources import datasets as D

T0 = dt.datetime(2024, 1, 1)


def candles(spark, n=5):
    return spark.createDataFrame([(T0 + dt.timedelta(hours=i), "A", 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, 3.0) for i in range(n)], D.CANDLE_SCHEMA)


def test_candles_round_trip_and_refusals(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    D.write_candles(candles(spark), path, "test")
    assert sorted(D.read_candles(spark, path).collect()) == sorted(candles(spark).collect())
    with pytest.raises(Exception):  # noqa: B017
        D.write_candles(candles(spark), path, "test")
    with pytest.raises(ValueError):
        D.write_candles(candles(spark, 0), f"{path}2", "test")
    with pytest.raises(ValueError):
        D.write_candles(candles(spark).withColumn("open", -F.col("open")), f"{path}3", "test")
    candles(spark, 1).withColumn("timestamp", F.col("timestamp") - F.expr("interval 1 hour")).write.mode("append").partitionBy("symbol").parquet(f"{path}/data")
    with pytest.raises(ValueError):
        D.read_candles(spark, path)


def test_hash_does_not_depend_on_order(spark):
    a = candles(spark)
    assert D.metadata(a).first() == D.metadata(a.orderBy(F.col("timestamp").desc())).first()
    assert D.metadata(a).first() != D.metadata(a.withColumn("symbol", F.lit("B"))).first()


def test_posts_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,created_utc,title,selftext,score\n1,2024-01-01 00:00:00,"x, y",,5\n2,1704067200,b,c,zz\n')
    (tmp_path / "b.csv").write_text("id,created_utc,title,source\n1,2024-01-02 00:00:00,later,s\n3,2024-01-03 00:00:00,,s\n")
    rows = {r.id: r for r in D.read_posts_csv(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"]).collect()}
    assert rows["1"].title == "x, y" and rows["1"].selftext == "" and rows["1"].score == 5 and rows["1"].source == "csv"
    assert rows["2"].score == 0 and rows["2"].created_utc == T0 and rows["3"].title == "" and rows["3"].source == "s"
    with pytest.raises(ValueError):
        (tmp_path / "c.csv").write_text("id,title\n1,x\n")
        D.read_posts_csv(spark, [f"file://{tmp_path}/c.csv"])


def test_klines(spark):
    df = spark.createDataFrame([("A", '["0","1","2","0.5","1.5","9","3599999","x"]'), ("A", '["1"]'), ("A", "bad")], "symbol string, kline string")
    got = D.parse_klines(df).collect()
    assert len(got) == 1 and got[0].high == 2.0 and got[0].volume == 9.0


def test_variance_inflation_of_independent_columns(spark):
    df = spark.range(1000).select(F.sin("id").alias("a"), F.cos(F.col("id") * 1.7).alias("b")).withColumn("c", F.col("a") + 0.01 * F.col("b"))
    v = {r.feature: r.vif for r in Y.variance_inflation(df, ["a", "c"]).collect()}
    assert v["a"] > 100 and v["c"] > 100 and Y.constant_columns(df.withColumn("k", F.lit(1)), ["a", "k"]) == ["k"]
