"""Streams: closed candles from ticks, deduplication, hourly aggregates, stateful filters per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """A file stream of tick tables: one micro-batch per ``files`` files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def candles(ticks: DataFrame, interval: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """ticks(symbol, time, price, quantity): candles of closed intervals; later ticks are dropped by the watermark."""
    order = F.struct("time", "tick_id")
    rows = ticks.withWatermark("time", delay).groupBy(F.window("time", interval), "symbol").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("n_ticks")
    )
    return rows.select(F.col("window.start").alias("timestamp"), "symbol", "open", "high", "low", "close", "volume", "n_ticks")


def resample(bars: DataFrame, hours: int, delay: str = "2 hours") -> DataFrame:
    """Complete k-hour candles from a stream of 1-hour candles."""
    rows = bars.withWatermark("timestamp", delay).groupBy(F.window("timestamp", f"{hours} hours"), "symbol").agg(
        F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n")
    )
    return rows.where(F.col("n") == hours).select(F.col("window.start").alias("timestamp"), "symbol", "open", "high", "low", "close", "volume")


def unseen(posts: DataFrame, key: str, time: str, delay: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return posts.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def hourly_sentiment(posts: DataFrame, delay: str = "2 hours") -> DataFrame:
    rows = posts.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 hour"), "symbol").agg(F.avg("sentiment_score").alias("sentiment_mean"), F.count(F.lit(1)).alias("sentiment_count"))
    return rows.select(F.col("window.start").alias("timestamp"), "symbol", "sentiment_mean", "sentiment_count")


def with_sentiment(bars: DataFrame, sentiment: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Stream-stream left join on symbol and hour; an hour without sentiment comes out when the watermark has passed."""
    a = bars.withWatermark("timestamp", delay).alias("a")
    b = sentiment.withWatermark("timestamp", delay).alias("b")
    on = F.expr("a.symbol = b.symbol and b.timestamp >= a.timestamp and b.timestamp < a.timestamp + interval 1 hour")
    return a.join(b, on, "left").select("a.*", F.col("b.sentiment_mean"), F.col("b.sentiment_count"))


class _Filter(StatefulProcessor):
    """EWMA and Kalman state of a symbol: rows of a batch in time order, state kept between batches."""

    def __init__(self, alpha: float, q: float, r: float):
        self.alpha, self.q, self.r = alpha, q, r

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filter", "ewma double, level double, variance double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("timestamp")
        mean, level, variance = self.state.get() if self.state.exists() else (None, 0.0, 1.0)
        means, levels = [], []
        for x in frame["x"]:
            mean = x if mean is None else (1 - self.alpha) * mean + self.alpha * x
            variance += self.q
            gain = variance / (variance + self.r)
            level, variance = level + gain * (x - level), (1 - gain) * variance
            means.append(mean)
            levels.append(level)
        self.state.update((mean, level, variance))
        yield pd.DataFrame({"symbol": key[0], "timestamp": frame["timestamp"], "ewma": means, "kalman": levels})

    def close(self) -> None:
        pass


def filters(rows: DataFrame, alpha: float, q: float = 0.01, r: float = 0.25) -> DataFrame:
    """rows(symbol, timestamp, x): EWMA and Kalman level per row, state by symbol in the state store."""
    schema = "symbol string, timestamp timestamp, ewma double, kalman double"
    return rows.groupBy("symbol").transformWithStateInPandas(_Filter(alpha, q, r), schema, "Append", "None")


class _Cooldown(StatefulProcessor):
    """The last exit of a symbol, and whether an entry comes too soon after it. keep: an event-time timer forgets an exit
    so many seconds behind it, so that symbols that are gone leave no state."""

    def __init__(self, hours: float, keep: int | None):
        self.hours, self.keep = hours, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last_exit", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("timestamp")
        before = last = self.last.get()[0] if self.last.exists() else None
        cooling = []
        for t, is_exit in zip(frame["timestamp"].map(pd.Timestamp.timestamp), frame["is_exit"], strict=True):
            if is_exit:
                last = t
            cooling.append(int(last is not None and t - last < self.hours * 3600))
        if last is not None and last != before:
            self.last.update((last,))
            if self.keep:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int((last + self.keep) * 1000))
        yield pd.DataFrame({"symbol": key[0], "timestamp": frame["timestamp"], "cooling": cooling})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame({"symbol": pd.Series([], dtype=str), "timestamp": pd.Series([], dtype="datetime64[ns]"), "cooling": pd.Series([], dtype="int32")})

    def close(self) -> None:
        pass


def cooldown(rows: DataFrame, hours: float, keep: int | None = None, delay: str = "2 hours") -> DataFrame:
    """rows(symbol, timestamp, is_exit): whether each row lies less than ``hours`` behind the last exit, itself included.
    keep: an exit is forgotten when the watermark has passed it by so many seconds; rows later than ``delay`` go then."""
    schema, make = "symbol string, timestamp timestamp, cooling int", _Cooldown(hours, keep)
    if not keep:
        return rows.groupBy("symbol").transformWithStateInPandas(make, schema, "Append", "None")
    return rows.withWatermark("timestamp", delay).groupBy("symbol").transformWithStateInPandas(make, schema, "Append", "EventTime")


class _Ledger(StatefulProcessor):
    """A symbol's long-or-cash ledger, bar by bar. A bar's fill needs the next bar's open, so a bar comes out with the
    next one; an event-time timer ``grace_ms`` behind the last bar closes what is open at that bar's close. A day's
    row (last equity, deepest drawdown, return, halt) comes out with its last bar."""

    def __init__(self, fee: float, slip: float, capital: float, daily: float, most: float, grace_ms: int):
        self.fee, self.slip, self.capital, self.daily, self.most, self.grace_ms = fee, slip, capital, daily, most, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", "wealth double, position int, peak double, day long, day_equity double, day_drawdown double, before double")
        self.waiting = handle.getListState("waiting", "t long, close double, signal int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("timestamp")
        account = self.account.get() if self.account.exists() else (self.capital, 0, 0.0, None, 0.0, 0.0, None)
        waiting, out = list(self.waiting.get()) if self.waiting.exists() else [], []
        for t, opened, close, signal in zip(frame["timestamp"].map(lambda x: int(x.timestamp())), frame["open"], frame["close"], frame["signal"], strict=True):
            if waiting:
                account = self._settle(key, waiting[0], float(opened), account, out)
            waiting = [(t, float(close), int(min(1, max(0, 0 if pd.isna(signal) else signal))))]
        self.account.update(account)
        self.waiting.put(waiting)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(waiting[0][0] * 1000 + self.grace_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.waiting.exists():
            (last,) = list(self.waiting.get())
            account = self._settle(key, last, None, self.account.get(), out)
            self._day(key, account, out)
            self.waiting.clear()
            self.account.clear()
        yield self._frame(out)

    def _settle(self, key, bar, opened: float | None, account, out: list):
        """The bar's row and the account behind it; without a next open the bar is the last."""
        wealth, held, peak, day, day_equity, day_drawdown, before = account
        t, close, signal = bar
        sold = (1 - self.slip) * (1 - self.fee)
        position = held if opened is None else signal
        if opened is not None and position > held:
            wealth /= opened * (1 + self.slip) * (1 + self.fee)
        elif opened is not None and position < held:
            wealth *= opened * sold
        equity = wealth * close * sold if position else wealth
        if day is not None and t // 86400 != day:
            self._day(key, account, out)
            before, day_drawdown = day_equity, 0.0
        peak = max(peak, equity)
        day, day_drawdown = t // 86400, min(day_drawdown, equity / peak - 1)
        out.append((key[0], "bar", t, position, equity, day_drawdown, None, None))
        return (wealth, position, peak, day, equity, day_drawdown, before)

    def _day(self, key, account, out: list) -> None:
        _, _, _, day, equity, drawdown, before = account
        change = None if before is None else equity / before - 1
        halt = int((change is not None and change <= -self.daily) or drawdown <= -self.most)
        out.append((key[0], "day", day * 86400, None, equity, drawdown, change, halt))

    def _frame(self, out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["symbol", "kind", "t", "position", "equity", "drawdown", "daily_return", "halt"])
        return frame.astype({"position": "Int32", "halt": "Int32", "equity": float, "drawdown": float, "daily_return": float, "t": "int64"})

    def close(self) -> None:
        pass


LEDGER = "symbol string, kind string, t long, position int, equity double, drawdown double, daily_return double, halt int"


def ledger(bars: DataFrame, fee: float = 0.001, slip: float = 0.0005, capital: float = 10_000.0, daily: float = 0.05, most: float = 0.15, grace: int = 86400, delay: str = "2 hours") -> DataFrame:
    """bars(symbol, timestamp, open, close, signal) in time order per symbol: rows of kind ``bar`` (position, equity) and
    ``day`` (last equity, deepest drawdown, return against the day before, halt), the same as the batch ledger and its
    risk halts. A symbol without a bar for ``grace`` seconds of event time is closed at its last one; bars after that
    start anew."""
    rows = bars.withWatermark("timestamp", delay).groupBy("symbol")
    return rows.transformWithStateInPandas(_Ledger(fee, slip, capital, daily, most, grace * 1000), LEDGER, "Append", "EventTime")


def run_to_table(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there into a Parquet table beside its checkpoint and reads it: no row passes through
    the driver, and a restarted stream goes on where it was."""
    folder = f"{checkpoint.rstrip('/')}-rows"
    query = stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def split_late(stream: DataFrame, time: str, delay_seconds: int, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Runs a stream over what is there into two tables, each with the number of its micro-batch (``batch_id``): the rows
    that were in time and those that came more than the delay behind the latest time of the batches before theirs. A
    batch that is run again replaces its own rows."""
    spark, folder = stream.sparkSession, checkpoint.rstrip("/")
    spark_read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}-{name}")
    schema = StructType([*stream.schema.fields]).add("batch_id", "long")

    def write(batch: DataFrame, batch_id: int) -> None:
        latest = batch.sparkSession.read.schema("batch_id long, latest double").option("pathGlobFilter", "*.parquet").parquet(f"{folder}-times").where(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0] if batch_id else None
        late = F.lit(False) if latest is None else F.col(time).cast("double") < latest - delay_seconds
        rows = batch.withColumn("_late", F.coalesce(late, F.lit(False))).persist()
        for name, part in (("rows", rows.where("not _late")), ("late", rows.where("_late"))):
            part.drop("_late").withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}-{name}/batch={batch_id}")
        rows.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.max(F.col(time).cast("double")).alias("latest")).write.mode("overwrite").parquet(f"{folder}-times/batch={batch_id}")
        rows.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark_read("rows", schema), spark_read("late", schema)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark has dropped so far, of all stateful operators of the progress that Spark keeps."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
