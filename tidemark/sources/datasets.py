"""Datasets: candles and posts with a metadata row beside them, landed exchange rows, CSV posts, result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.candles import CANDLE, check, duplicate_keys, normalize
from tidemark.operators.text import content_hash

CANDLE_SCHEMA = "timestamp timestamp, symbol string, open double, high double, low double, close double, volume double"
POST_COLUMNS = ["id", "created_utc", "title", "selftext", "subreddit", "score", "num_comments", "source"]
VERSION = "candles.v1"


def metadata(df: DataFrame, time: str = "timestamp", source: str = "", version: str = VERSION, distinct: str = "symbol") -> DataFrame:
    """One row: count, start, end, distinct values of a column (null where there is no such column), version, source, and a
    hash of the rows whatever their order, in which a null is no empty string."""
    about = df.agg(F.count(F.lit(1)).alias("row_count"), F.min(F.unix_seconds(time)).alias("start"), F.max(F.unix_seconds(time)).alias("end"), (F.countDistinct(distinct) if distinct in df.columns else F.lit(None).cast("long")).alias(f"n_{distinct}s"))
    digest = content_hash(df, sorted(df.columns))
    hashed = digest.select(F.concat_ws("-", *digest.columns).alias("content_hash"))
    return about.crossJoin(hashed).withColumns({"schema_version": F.lit(version), "source": F.lit(source)})  # one row each


def frame_signature(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("signature"))


def write_candles(df: DataFrame, path: str, source: str) -> None:
    """Writes valid candles by symbol and their metadata; refuses empty tables, rule violations and existing paths."""
    rows = df.select(*CANDLE)
    if rows.isEmpty():
        raise ValueError("there are no candles")
    if not check(rows).isEmpty() or not duplicate_keys(rows, ["symbol", "timestamp"]).isEmpty():
        raise ValueError("the candles break a rule or repeat a key")
    rows.repartition("symbol").sortWithinPartitions("symbol", "timestamp").write.mode("errorifexists").partitionBy("symbol").parquet(f"{path}/data")
    metadata(read_raw(df.sparkSession, path), source=source).write.mode("errorifexists").json(f"{path}/metadata")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDLE_SCHEMA).parquet(f"{path}/data").select(*CANDLE)


def read_candles(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The candles; with verify their metadata has to fit the rows that are there."""
    rows = read_raw(spark, path)
    if verify:
        kept = spark.read.json(f"{path}/metadata").first()
        now = metadata(rows).first()
        if (kept["row_count"], kept["content_hash"]) != (now["row_count"], now["content_hash"]):
            raise ValueError("the rows do not fit their metadata")
    return rows


def write_table(df: DataFrame, path: str, name: str, run: str, form: str = "parquet") -> None:
    """A result table under the run's folder; an existing one is not overwritten."""
    writer = df.write.mode("errorifexists")
    (writer.option("header", True).csv if form == "csv" else getattr(writer, form))(f"{path}/run={run}/{name}")


def write_report(tables: dict[str, DataFrame], path: str, run: str) -> None:
    """Predictions, trades, equity, metrics, ...: one folder per table."""
    for name, df in tables.items():
        write_table(df, path, name, run)


def read_posts_csv(spark: SparkSession, paths: Sequence[str], default_source: str = "csv") -> DataFrame:
    """Posts of several CSV files, all columns as text first; the first file that has an id wins."""
    order = {p: k for k, p in enumerate(paths)}
    raw = None
    for p, k in order.items():
        one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p)
        missing = [c for c in ("id", "created_utc", "title") if c not in one.columns]
        if missing:
            raise ValueError(f"{p} lacks {missing}")
        one = one.withColumn("_file", F.lit(k)).withColumn("_row", F.monotonically_increasing_id())
        raw = one if raw is None else raw.unionByName(one, allowMissingColumns=True)
    for c in POST_COLUMNS:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    first = Window.partitionBy("id").orderBy("_file", "_row")
    rows = raw.where("id is not null and trim(id) != ''").withColumn("_k", F.row_number().over(first)).where("_k = 1")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select("id", F.expr("coalesce(try_to_timestamp(created_utc), timestamp_seconds(try_cast(created_utc as double)))").alias("created_utc"), text("title"), text("selftext"), "subreddit", *[F.coalesce(F.expr(f"try_cast({c} as long)"), F.lit(0)).alias(c) for c in ("score", "num_comments")], F.coalesce("source", F.lit(default_source)).alias("source"))


def parse_klines(df: DataFrame, column: str = "kline", symbol: str = "symbol") -> DataFrame:
    """Landed JSON arrays [open time ms, o, h, l, c, v, close time ms, ...] as typed candles; short arrays are dropped."""
    a = F.from_json(column, "array<string>")
    rows = df.withColumn("_a", a).where(F.size("_a") >= 7)
    number = lambda k, n: F.expr(f"try_cast(_a[{k}] as double)").alias(n)
    return rows.select(F.expr("timestamp_millis(try_cast(_a[0] as long))").alias("timestamp"), symbol, *[number(k + 1, n) for k, n in enumerate(CANDLE[2:])], F.expr("timestamp_millis(try_cast(_a[6] as long))").alias("close_time"))


def closed_only(df: DataFrame, end: Column, now: Column) -> DataFrame:
    """Candles whose close time is not after the end nor after now."""
    return df.where(F.col("close_time") <= F.least(end, now))


def tradable(info: DataFrame) -> DataFrame:
    """Symbols in trading with spot allowed."""
    return info.where((F.col("status") == "TRADING") & F.col("spot_allowed")).select("symbol").distinct()


def restrict(candles: DataFrame, symbols: DataFrame) -> DataFrame:
    return candles.join(symbols, "symbol", "left_semi")


def load_between(df: DataFrame, time: str, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Rows from low to high, both included."""
    rows = df if low is None else df.where(F.col(time) >= low)
    return rows if high is None else rows.where(F.col(time) <= high)


def normalized(df: DataFrame, strict: bool = False) -> DataFrame:
    """Typed candles in key order; strict: a rule violation is an error."""
    rows = normalize(df)
    if strict and not check(rows).isEmpty():
        raise ValueError("the candles break a rule")
    return rows.orderBy("timestamp", "symbol")
