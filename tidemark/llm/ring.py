"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard owns many points of a ring of 64-bit hashes; a row belongs to the next point clockwise. A shard takes its
share of the rows and no more: rows beyond that continue clockwise to the next shard with room. Shares are equal to
one row (the first N mod n shards take one more), so counts are at most one apart, and only the overflow moves.

The overflow is settled on counts per arc (shards x points numbers), not on rows: an arc's rows are numbered, and the
plan says which numbers go to which shard. Rows are numbered in parts of an arc by a hash, so that rows with one
doc_id do not meet in one task unless they are equal in doc_id and text; equal rows are numbered in one sorted run.

Defined results: a null text has size 16 and crc 0; null doc_ids hash as null; repeated rows each get a slot of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, salted_rank

#: The ring is looked up by this many leading bits, then by comparison.
BUCKET_BITS = 12


def ring_points(n_shards: int, points: int) -> list[tuple[int, int]]:
    """(position, shard) in ring order; positions are signed 64-bit."""
    spots = [(xxhash.xxh64_intdigest(f"shard {s} point {v}") - (1 << 63), s) for s in range(n_shards) for v in range(points)]
    return sorted(spots)


def _arcs(spark: SparkSession, ring: list[tuple[int, int]]) -> DataFrame:
    """(bucket, low, high, arc): the part of an arc (low, high] inside a bucket of the ring."""
    width, rows, low = 1 << (64 - BUCKET_BITS), [], -(1 << 63)
    spans = [(a, b, k) for k, (a, b) in enumerate(zip([low, *(p + 1 for p, _ in ring)], [*(p for p, _ in ring), (1 << 63) - 1], strict=True))]
    for first, last, arc in spans:
        bucket = (first - low) // width
        while first <= last:
            end = min(last, low + (bucket + 1) * width - 1)
            rows.append((bucket, first, end, arc % len(ring)))
            first, bucket = end + 1, bucket + 1
    return spark.createDataFrame(rows, "bucket int, low long, high long, arc int")


def settle(counts: dict[int, int], ring: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first number, last number, shard, first slot): own rows come first, overflow continues clockwise."""
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    filled, rows, over = [0] * n_shards, [], []

    def give(arc: int, at: int, n: int, shard: int) -> int:
        taken = min(n, room[shard] - filled[shard])
        if taken:
            rows.append((arc, at, at + taken - 1, shard, filled[shard]))
            filled[shard] += taken
        return taken

    for arc, (_, shard) in enumerate(ring):
        n = counts.get(arc, 0)
        taken = give(arc, 0, n, shard)
        if taken < n:
            over.append((arc, taken, n - taken))
    for arc, at, n in over:
        step = arc
        while n:
            step = (step + 1) % len(ring)
            taken = give(arc, at, n, ring[step][1])
            at, n = at + taken, n - taken
    return rows


def assign_shards(docs: DataFrame, n_shards: int = 40, points: int = 128, rows: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, arc, shard, slot of every row (and with ``rows`` the whole row as a struct, ``row``)."""
    spark = docs.sparkSession
    ring = ring_points(n_shards, points)
    text = F.coalesce(F.col("text"), F.lit(""))
    held = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("_t"), F.xxhash64("doc_id").alias("_h"), *held,
    ).withColumn("bucket", (F.shiftrightunsigned(F.col("_h"), 64 - BUCKET_BITS).bitwiseXOR(F.lit(1 << (BUCKET_BITS - 1)))).cast("int"))
    names = ["doc_id", "size", "text_crc32", "_t", "arc", *["row"] * rows]
    arcs = F.broadcast(_arcs(spark, ring))  # shards x points + 2 ** BUCKET_BITS rows at most
    on_ring = keyed.join(arcs, (keyed["bucket"] == arcs["bucket"]) & keyed["_h"].between(arcs["low"], arcs["high"])).select(*names)
    on_ring = on_ring if rows else materialize(on_ring, "ring")  # a few numbers a row: the texts are read once
    counts = {r["arc"]: r["count"] for r in on_ring.groupBy("arc").count().collect()}  # shards x points rows at most
    plan = settle(counts, ring, n_shards)
    spans = F.broadcast(spark.createDataFrame(plan, "_arc int, _first long, _last long, shard int, _slot long"))
    numbered = salted_rank(on_ring, ["arc"], ["doc_id", "_t"], "_k", salts=16)
    placed = numbered.join(spans, (F.col("arc") == F.col("_arc")) & F.col("_k").between(F.col("_first"), F.col("_last")))
    return placed.select("doc_id", "size", "text_crc32", "arc", "shard", (F.col("_slot") + F.col("_k") - F.col("_first")).alias("slot"), *["row"] * rows)


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, points: int = 128, file_rows: int = 100_000) -> str:
    """Writes the documents, with all their columns, under shard=<n>/ folders in files of about ``file_rows`` rows, so a
    shard is many tasks; repeated rows are placed one by one. Returns the folders' column: shard, or with blanks (_) in
    front where docs has such a column."""
    column = "shard"
    while column in docs.columns:
        column = f"_{column}"
    placed = assign_shards(docs, n_shards, points, rows=True).select("row", F.col("shard").alias("_s"), F.floor(F.col("slot") / file_rows).alias("_f"))
    placed.repartition("_s", "_f").select("row.*", F.col("_s").alias(column)).write.partitionBy(column).parquet(path)
    return column
