"""Places in an order over a whole table, and joins of frequent keys, without one task that holds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import checkpointed


def global_place(df: DataFrame, order: Sequence[Column | str], name: str) -> tuple[DataFrame, int]:
    """df with ``name``, its rows' places (from 0) in the order, and the number of rows.

    The rows are dealt out by ranges of the order and written down, so that a lost task cannot deal them anew; a row's
    place is its place in its range behind all rows of the ranges before it, whose counts pass through the driver, one
    number a range. Equal rows stand in any order, in one range."""
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    starts, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(k, 0)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    start = F.get(F.array(*[F.lit(s).cast("long") for s in starts or [0]]), F.col("_range"))
    return dealt.withColumn(name, start + inside).drop("_range"), total


def shuffled_place(df: DataFrame, keys: Sequence[str], name: str, *seeds: Column | str) -> DataFrame:
    """df with ``name``, each row's place (from 0) among the rows of its keys in the order of the MD5 of the seeds, which
    must tell the rows apart: a permutation that any engine repeats. A key's rows are ordered in 256 parts by the first
    two digits of the hash, whose counts (one row each) give where a part starts, so no key is one task."""
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", *seeds))).withColumn("_part", F.substring("_hash", 1, 2))
    counts = hashed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = hashed.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_hash")) - 1)
    return inside.join(starts, [*keys, "_part"]).withColumn(name, F.col("_start") + F.col("_row")).drop("_hash", "_part", "_start", "_row")


def salted_join(df: DataFrame, table: DataFrame, on: Sequence[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """df joined with a table of few rows per key: the rows of a frequent key go to ``salts`` tasks, the table's to all of them."""
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")
