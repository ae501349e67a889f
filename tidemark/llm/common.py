"""Helpers shared by the corpus operators: work tables in the shared folder, ranks inside hot groups, Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import shared_dir

#: Bytes of text that an Arrow operator takes in hand at once, and rows and bytes of an Arrow batch on its way to Python.
SLICE_BYTES = 1_500_000
BATCH_ROWS, BATCH_BYTES = "2000", "4000000"

def free_units() -> None:
    """Starts a task in a small worker: what an earlier task of a reused one left free, and a tokenizer's units, go."""
    tokens = sys.modules.get("tidemark.llm.tokens")
    if tokens:
        tokens._OPENED.clear()
    trim()


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def small_batches(spark: SparkSession) -> None:
    """Texts are long: with Spark's default of 10,000 rows a batch of them is held several times outside of the heap.
    And every step ends in a table, so a finished step's shuffle files are deleted at once."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def apart(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: so the Python steps before and behind the join are in stages of their
    own, and an executor has one Python worker for each core, not one for each step."""
    return df.hint("merge")


def work_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidemark/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut, and a lost executor costs no recomputation."""
    path = work_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize whose successors are written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.work_table)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def salted_rank(df: DataFrame, group: list[str], order: list[str], name: str, salts: int = 64) -> DataFrame:
    """Adds ``name``: a number from 0 without gaps inside each group, without bringing a group to one task.

    A group is cut into ``salts`` parts by a hash of the order columns; rows are numbered inside a part, and the
    parts' counts (one row each) give where a part starts.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    inside = Window.partitionBy(*group, "_salt").orderBy(*order)
    counts = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = salted.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(starts, [*group, "_salt"]).withColumn(name, F.col("_start") + F.col("_at")).drop("_salt", "_start", "_at")


def salted_lookup(df: DataFrame, table: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """df joined with a table that has each key once: rows of a frequent key go to ``salts`` tasks, the table's rows to all of them.
    The copies are never broadcast: what Spark knows of the table's size is that of its file, not of its copies."""
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(apart(copies), [*on, "_salt"], how).drop("_salt")


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part has about ``size`` bytes of the column, one row at least."""
    if not batch.num_rows:
        return
    per_row = max(1, batch.column(column).nbytes // batch.num_rows)
    step = max(1, size // per_row)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]
