"""Streams over ``events``: what has come out when everything there has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shared import new_path
from tidemark.operators.candles import instant
from tidemark.plans.base import query, result, scientific
from tidemark.plans.ledger_queries import SIGNALS, chain, signals
from tidemark.plans.market_queries import BARS, W, bars
from tidemark.plans.text_queries import POSTS, scored
from tidemark.streaming import stream as S


def _source(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as a file stream."""
    folder = new_path(spark, "stream-source")
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    return S.run_to_table(stream, new_path(spark, "stream"))


def _stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream takes a folder or a pattern; the pattern fits the table whether it is a file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return events.select(F.col("event_type").alias("symbol"), instant("ts").alias("time"), F.col("value").alias("price"), F.lit(1.0).alias("quantity"), F.col("event_id").alias("tick_id"))


@query(f"WITH {BARS} SELECT symbol, t, open, high, low, close, volume FROM bars WHERE t + 3600 <= (SELECT epoch(max(ts)) - 7200 FROM events)")
def stream_candles(spark, sf_dir):
    """Closed candles only: those that end before the watermark."""
    return result(_run(spark, S.candles(ticks(spark, sf_dir))), "symbol", "timestamp", "open", "high", "low", "close", "volume")


@query("SELECT DISTINCT user_id FROM events")
def stream_unseen_users(spark, sf_dir):
    """The first event of each user while the watermark keeps the user."""
    events = _events(spark, sf_dir).select("user_id", instant("ts").alias("time"))
    rows = S.unseen(events, "user_id", "time", "100 days")
    return _run(spark, rows).select("user_id")


LEVELS = f"""pos AS (SELECT symbol, t, close, row_number() OVER w AS k FROM bars {W}), fil AS (SELECT symbol, t, k, close AS e, 1.01 / 1.26 * close AS y, 1.01 * (1 - 1.01 / 1.26) AS v FROM pos WHERE k = 1
 UNION ALL SELECT pos.symbol, pos.t, pos.k, fil.e * 11 / 13 + pos.close * 2 / 13, fil.y + (fil.v + 0.01) / (fil.v + 0.26) * (pos.close - fil.y), (1 - (fil.v + 0.01) / (fil.v + 0.26)) * (fil.v + 0.01) FROM fil JOIN pos ON pos.symbol = fil.symbol AND pos.k = fil.k + 1)"""


@query(f"WITH RECURSIVE {BARS}, {LEVELS} SELECT symbol, t, round(e, 6) AS ewma, round(y, 6) AS kalman FROM fil")
def stream_filters(spark, sf_dir):
    """EWMA and Kalman levels of the candles' closes with state per symbol, row by row as in the batch operators."""
    _stateful(spark)
    rows = _source(spark, bars(spark, sf_dir).select("symbol", "timestamp", F.col("close").alias("x")))
    return result(_run(spark, S.filters(rows, 2 / 13)), "symbol", "timestamp", "ewma", "kalman")


@query(f"WITH {BARS}, b AS (SELECT symbol, t // 14400 * 14400 AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(volume) AS volume, count(*) AS n FROM bars GROUP BY 1, 2) SELECT symbol, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM b WHERE n = 4 AND t + 14400 <= (SELECT max(t) - 7200 FROM bars)")
def stream_resample(spark, sf_dir):
    """Complete 4-hour candles from a stream of 1-hour candles, as far as the watermark has come."""
    rows = _source(spark, bars(spark, sf_dir).select("symbol", "timestamp", "open", "high", "low", "close", "volume"))
    return result(_run(spark, S.resample(rows, 4)), "symbol", "timestamp", "open", "high", "low", "close", "volume")


@query(f"WITH {POSTS} SELECT symbol, t // 3600 * 3600 AS t, round(avg(s), 6) AS sentiment_mean, count(*) AS sentiment_count FROM posts WHERE t // 3600 * 3600 + 3600 <= (SELECT max(t) - 7200 FROM posts) GROUP BY 1, 2")
def stream_hourly_sentiment(spark, sf_dir):
    rows = _source(spark, scored(spark, sf_dir).select("symbol", "timestamp", "sentiment_score"))
    return result(_run(spark, S.hourly_sentiment(rows)), "symbol", "timestamp", "sentiment_mean", "sentiment_count")


#: A symbol of one row a year behind the others, which moves the watermark past all of them.
BEAT = "~beat"


def _with_beat(rows: DataFrame) -> DataFrame:
    """rows and a last row of the symbol BEAT."""
    late = rows.agg(F.max("timestamp").alias("timestamp")).select(F.lit(BEAT).alias("symbol"), (F.col("timestamp") + F.expr("interval 365 days")).alias("timestamp"))
    return rows.unionByName(late, allowMissingColumns=True)


@query(f"WITH {BARS} SELECT a.symbol, a.t, round(a.close, 6) AS close, round(b.open / 2, 6) AS sentiment_mean, b.volume::BIGINT AS sentiment_count FROM bars a LEFT JOIN (SELECT * FROM bars WHERE volume > 1) b ON b.symbol = a.symbol AND b.t = a.t")
def stream_with_sentiment(spark, sf_dir):
    """Candles joined with a stream of hourly values that some hours lack; hours without one come out as well."""
    b = bars(spark, sf_dir)
    left = _source(spark, _with_beat(b.select("symbol", "timestamp", "close")))
    right = _source(spark, _with_beat(b.where("volume > 1").select("symbol", "timestamp", (F.col("open") / 2).alias("sentiment_mean"), F.col("volume").cast("long").alias("sentiment_count"))))
    return result(_run(spark, S.with_sentiment(left, right)).where(F.col("symbol") != BEAT), "symbol", "timestamp", "close", "sentiment_mean", "sentiment_count")


def _in_batches(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """The parts as a file stream that comes in several micro-batches, each symbol's rows of a part in one of them."""
    folder = new_path(spark, "stream-source")
    for part in parts:
        part.write.mode("append").parquet(folder)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 4).parquet(folder)


def _ledger(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    _stateful(spark)
    rows = _with_beat(signals(spark, sf_dir).select("symbol", "timestamp", "open", "close", "signal")).na.fill(1.0, ["open", "close"])
    day = F.date_format("timestamp", "yyyy-MM-dd")
    parts = [rows.where(cond).repartition(4, "symbol") for cond in (day < "2024-01-10", (day >= "2024-01-10") & (day < "2024-01-20"), day >= "2024-01-20")]
    return _run(spark, S.ledger(_in_batches(spark, parts), grace=7 * 86400, delay="60 days")).where((F.col("kind") == kind) & (F.col("symbol") != BEAT))


@query(f"WITH {BARS}, {SIGNALS}, {chain('sig', 'symbol')} SELECT symbol, t, pos::INT AS position, printf('%.6e', equity) AS equity FROM eq")
def stream_ledger(spark, sf_dir):
    """The ledger with state per symbol over several micro-batches; a timer closes what is open at the last bar."""
    return _ledger(spark, sf_dir, "bar").select("symbol", "t", "position", scientific("equity", 6).alias("equity"))


@query(f"WITH {BARS}, {SIGNALS}, {chain('sig', 'symbol')}, dy AS (SELECT symbol, t // 86400 AS day, arg_max(equity, t) AS equity, min(drawdown) AS drawdown FROM dd GROUP BY 1, 2), ch AS (SELECT *, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY day) - 1 AS change FROM dy) SELECT symbol, day * 86400 AS t, printf('%.6e', equity) AS equity, round(drawdown, 6) AS drawdown, round(change, 6) AS daily_return, (coalesce(change <= -0.05, false) OR drawdown <= -0.15)::INT AS halt FROM ch")
def stream_risk_halts(spark, sf_dir):
    """Per symbol and day the last equity, deepest drawdown, return and halt, from the stateful ledger."""
    return result(_ledger(spark, sf_dir, "day").withColumn("equity", scientific("equity", 6)), "symbol", "t", "equity", "drawdown", "daily_return", "halt")


@query("WITH e AS (SELECT event_id, epoch(ts) AS t, event_id % 50 = 0 AS held FROM events), f AS (SELECT max(t) AS m FROM e WHERE NOT held AND t < 1705708800) SELECT event_id, 1 AS batch_id FROM e, f WHERE (held OR t >= 1705708800) AND t < m - 7200")
def stream_late_rows(spark, sf_dir):
    """Ticks that come in the second micro-batch, more than two hours behind the first one's latest, as a table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", instant("ts").alias("time"))
    first = (F.col("event_id") % 50 != 0) & (F.unix_seconds("time") < 1705708800)
    stream = _in_batches(spark, [events.where(cond).repartition(4) for cond in (first, ~first)])
    return S.split_late(stream, "time", 7200, new_path(spark, "stream"))[1].select("event_id", F.col("batch_id").cast("int").alias("batch_id"))


@query(f"WITH {BARS}, e AS (SELECT symbol, t, max(CASE WHEN t // 3600 % 9 = 0 THEN t END) OVER w AS x FROM bars {W}) SELECT symbol, t, coalesce(t - x < 4 * 3600, false)::INT AS cooling FROM e")
def stream_cooldown(spark, sf_dir):
    """Rows less than four hours behind their symbol's last exit, the exit kept in the state store."""
    _stateful(spark)
    rows = _source(spark, bars(spark, sf_dir).select("symbol", "timestamp", (F.floor(F.unix_seconds("timestamp") / 3600) % 9 == 0).alias("is_exit")))
    return result(_run(spark, S.cooldown(rows, 4)), "symbol", "timestamp", "cooling")
