"""Datasets of posts and comments, and of hourly sentiment: tables by day with a metadata row that commits them.

A dataset is a folder. Its tables are written first, its metadata last: a folder without metadata is half a dataset and
is not read. Readers take days from the folder names, so a time range reads only its own days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.candles import duplicate_keys
from tidemark.operators.text import content_hash

# The columns of the two tables.
POSTS = "submission_id string, subreddit string, created_utc timestamp, title string, selftext string, author string, permalink string, collection_status string, collected_at timestamp, source string, score long, num_comments long"
COMMENTS = "comment_id string, submission_id string, parent_id string, subreddit string, created_utc timestamp, body string, author string, collection_status string, collected_at timestamp, source string, score long, depth long"
VERSION = "sentiment-dataset.v1"


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ")) for c in schema.split(",")]


def normalize(df: DataFrame, schema: str, key: str) -> DataFrame:
    """df with the columns of the schema, those that are missing null; an empty or repeated key is an error."""
    rows = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _columns(schema)])
    if not rows.where(F.col(key).isNull() | (F.trim(key) == "")).isEmpty() or not duplicate_keys(rows, [key]).isEmpty():
        raise ValueError(f"{key} is empty or repeated")
    return rows


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _write_by_day(rows: DataFrame, path: str, time: str) -> None:
    """Days are dealt out with their hours, so that no day is one task or one file, and none is many small ones."""
    day = F.to_date(time)
    rows.withColumn("day", day).repartition("day", F.hour(time)).write.mode("errorifexists").partitionBy("day").parquet(path)


def _summary(spark: SparkSession, path: str, name: str, time: str) -> DataFrame:
    """One row about a written table: its name, rows, first and last time, and the hash of its rows in any order."""
    rows = spark.read.parquet(f"{path}/{name}").drop("day")
    about = rows.agg(F.count(F.lit(1)).alias("row_count"), F.min(F.unix_seconds(time)).alias("start"), F.max(F.unix_seconds(time)).alias("end"))
    digest = content_hash(rows, sorted(rows.columns))
    return about.crossJoin(digest.select(F.concat_ws("-", *digest.columns).alias("content_hash"))).withColumn("table", F.lit(name))  # one row each


def _commit(tables: Sequence[DataFrame], path: str, **labels: str) -> None:
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    rows.withColumns({k: F.lit(v) for k, v in labels.items()}).coalesce(1).write.mode("errorifexists").json(f"{path}/metadata")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The dataset's metadata, one row per table; an error where it was not committed."""
    if not _exists(spark, f"{path}/metadata/_SUCCESS"):
        raise ValueError(f"{path} is no whole dataset: its metadata is missing")
    return spark.read.json(f"{path}/metadata")


def write_posts(posts: DataFrame, comments: DataFrame, path: str, dataset_id: str, source: str) -> None:
    """Both tables as one dataset; an existing one is not overwritten."""
    spark = posts.sparkSession
    if _exists(spark, path):
        raise ValueError(f"{path} exists")
    _write_by_day(normalize(posts, POSTS, "submission_id"), f"{path}/submissions", "created_utc")
    _write_by_day(normalize(comments, COMMENTS, "comment_id"), f"{path}/comments", "created_utc")
    _commit([_summary(spark, path, t, "created_utc") for t in ("submissions", "comments")], path, dataset_id=dataset_id, source=source, schema_version=VERSION)


def write_hourly(hourly: DataFrame, path: str, dataset_id: str, source_dataset_id: str, variant: str = "all_features") -> None:
    """Derived hourly columns as a dataset of its own that names the one it comes from; an hour may stand once."""
    spark = hourly.sparkSession
    if _exists(spark, path):
        raise ValueError(f"{path} exists")
    if not hourly.where("timestamp is null").isEmpty() or not duplicate_keys(hourly, ["timestamp"]).isEmpty():
        raise ValueError("an hour is missing or repeated")
    _write_by_day(hourly, f"{path}/hourly", "timestamp")
    _commit([_summary(spark, path, "hourly", "timestamp")], path, dataset_id=dataset_id, source_dataset_id=source_dataset_id, variant=variant, schema_version=f"hourly-{VERSION}")


def read_table(spark: SparkSession, path: str, name: str, low: Column | None = None, high: Column | None = None, verify: bool = False) -> DataFrame:
    """A table of a whole dataset, from low to high (both included), reading only the days between. With verify its rows
    have to fit their metadata."""
    kept = read_metadata(spark, path).where(F.col("table") == name)
    if verify:
        time = "timestamp" if name == "hourly" else "created_utc"
        then, now = kept.select("row_count", "content_hash").first(), _summary(spark, path, name, time).select("row_count", "content_hash").first()
        if then != now:
            raise ValueError(f"the rows of {name} do not fit their metadata")
    rows, time = spark.read.parquet(f"{path}/{name}"), "timestamp" if name == "hourly" else "created_utc"
    if low is not None:
        rows = rows.where((F.col("day") >= F.to_date(low)) & (F.col(time) >= low))
    if high is not None:
        rows = rows.where((F.col("day") <= F.to_date(high)) & (F.col(time) <= high))
    return rows.drop("day")
