"""One long series as many tasks: row numbers, blocks with a halo, and running values carried from block to block.

Windows by symbol bring a symbol to one task. Here a series is cut into blocks of rows. A bounded frame needs only the
rows just before (or behind) a block, its halo, which is copied into the block; a running value needs one number of
all blocks before it, its carry. Series shorter than a block are one block without a halo, as they were.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import checkpointed
from tidemark.functions.windows import KEYS, ORDER, affine_scans

#: Rows of a block, and seconds of the time blocks in which rows are numbered.
BLOCK, SPAN = 8192, 30 * 86400


def _lookup(df: DataFrame, table: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """df with the values of the row of ``table`` that has its keys, nulls being equal."""
    there = table.select(*[F.col(k).alias(f"_on{i}") for i, k in enumerate(on)], *values)
    same = F.lit(True)
    for i, k in enumerate(on):
        same = same & df[k].eqNullSafe(there[f"_on{i}"])
    return df.join(there, same, "left").drop(*[f"_on{i}" for i in range(len(on))])


def numbered(df: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER, span: int = SPAN) -> DataFrame:
    """``_pos``: the place of a row in its series, from 0. Rows are numbered inside time blocks of ``span`` seconds, whose
    counts (one row each) give where a block starts. Rows of one time must be few, their order among each other is open.
    The rows are written down first, as everything that is carried between blocks reads them more than once."""
    if "_pos" in df.columns:
        return df
    timed = checkpointed(df.withColumn("_time", F.floor(F.unix_seconds(order) / span)))
    counts = timed.groupBy(*keys, "_time").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_time").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = timed.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_time").orderBy(order)) - 1)
    return _lookup(inside, starts, [*keys, "_time"], ["_start"]).withColumn("_pos", F.col("_start") + F.col("_row")).drop("_time", "_start", "_row")


def with_halo(df: DataFrame, behind: int, ahead: int = 0, block: int = BLOCK) -> DataFrame:
    """The rows of ``numbered`` once for every block that needs them (``_block``): their own, those that start up to
    ``behind`` rows later and those that end up to ``ahead`` rows earlier."""
    first, last = F.floor(F.greatest(F.col("_pos") - ahead, F.lit(0)) / block), F.floor((F.col("_pos") + behind) / block)
    return df.withColumn("_block", F.explode(F.sequence(first, last)))


def own_rows(block: int = BLOCK) -> Column:
    """Whether a row of ``with_halo`` is its block's own."""
    return F.floor(F.col("_pos") / block) == F.col("_block")


def in_blocks(df: DataFrame, operator: Callable[[DataFrame], DataFrame], behind: int, ahead: int = 0, key: str = "symbol", order: str = ORDER, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """operator(df), an operator with windows by ``key`` that reach ``behind`` rows back and ``ahead`` rows on in all.

    The operator sees each block as a series of its own (the key is the pair of key and block) and must keep the rows
    and columns that it is given. If df is numbered already, its numbers stay."""
    known = "_pos" in df.columns
    rows = with_halo(numbered(df, [key], order, span), behind, ahead, block)
    rows = rows.withColumn(key, F.struct(F.col(key).alias("key"), F.col("_block").alias("block")))
    found = operator(rows).where(own_rows(block)).withColumn(key, F.col(f"{key}.key"))
    return found.drop("_block") if known else found.drop("_block", "_pos")


_KINDS: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "product": (F.product, lambda a, b: F.coalesce(a * b, a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(df: DataFrame, values: dict[str, tuple[str, Column]], keys: Sequence[str] = KEYS, order: str = ORDER, block: int = BLOCK, span: int = SPAN, before: Sequence[str] = ()) -> DataFrame:
    """For each name (kind, x): the sum, product, max or min of x up to each row (names in ``before``: without it), null
    where there is none yet. A block's total goes on to the blocks behind it as one number."""
    known = "_pos" in df.columns
    rows = numbered(df, keys, order, span).withColumn("_block", F.floor(F.col("_pos") / block)).withColumns({f"_x_{n}": x for n, (_, x) in values.items()})
    inside = Window.partitionBy(*keys, "_block").orderBy("_pos")
    totals = rows.groupBy(*keys, "_block").agg(*[_KINDS[kind][0](f"_x_{n}").alias(f"_t_{n}") for n, (kind, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.withColumns({f"_c_{n}": _KINDS[kind][0](f"_t_{n}").over(earlier) for n, (kind, _) in values.items()})
    rows = rows.withColumns({f"_i_{n}": _KINDS[kind][0](f"_x_{n}").over(inside.rowsBetween(Window.unboundedPreceding, -1 if n in before else 0)) for n, (kind, _) in values.items()})
    rows = _lookup(rows, carries, [*keys, "_block"], [f"_c_{n}" for n in values])
    rows = rows.withColumns({n: _KINDS[kind][1](F.col(f"_c_{n}"), F.col(f"_i_{n}")) for n, (kind, _) in values.items()})
    return rows.drop("_block", *([] if known else ["_pos"]), *[f"_{p}_{n}" for p in "xic" for n in values])


def affine_scans_in_blocks(df: DataFrame, maps: dict[str, tuple[Column, Column]], keys: Sequence[str] = KEYS, order: str = ORDER, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """``affine_scans``, the maps composed inside blocks; a block's map goes into a scan over the blocks."""
    known = "_pos" in df.columns
    rows = numbered(df, keys, order, span).withColumn("_block", F.floor(F.col("_pos") / block))
    by, names = [*keys, "_block"], list(maps)
    rows = rows.withColumns({f"_c{i}": maps[n][0].cast("double") for i, n in enumerate(names)} | {f"_u{i}": maps[n][1].cast("double") for i, n in enumerate(names)})
    rows = affine_scans(rows, {f"_y{i}": (F.col(f"_c{i}"), F.col(f"_u{i}")) for i in range(len(names))}, by, "_pos")
    until = Window.partitionBy(*by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_p{i}": F.product(f"_c{i}").over(until) for i in range(len(names))})
    ends = rows.groupBy(*by).agg(*[F.max_by(f"_{k}{i}", "_pos").alias(f"_{k}{i}") for i in range(len(names)) for k in "py"])
    ends = affine_scans(ends, {f"_z{i}": (F.col(f"_p{i}"), F.col(f"_y{i}")) for i in range(len(names))}, keys, "_block")
    ends = ends.select(*keys, (F.col("_block") + 1).alias("_block"), *[f"_z{i}" for i in range(len(names))])
    rows = _lookup(rows, ends, by, [f"_z{i}" for i in range(len(names))])
    rows = rows.withColumns({n: F.coalesce(F.col(f"_p{i}") * F.col(f"_z{i}"), F.lit(0.0)) + F.col(f"_y{i}") for i, n in enumerate(names)})
    return rows.drop("_block", *([] if known else ["_pos"]), *[f"_{k}{i}" for i in range(len(names)) for k in "cuypz"])


def ewmas_in_blocks(df: DataFrame, means: dict[str, tuple[Column, float, int]], keys: Sequence[str] = KEYS, order: str = ORDER, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """``ewmas`` of long series: counts, places of earlier values and the means themselves are carried between blocks."""
    known = "_pos" in df.columns
    rows = numbered(df, keys, order, span).withColumns({f"_v{i}": x for i, (x, _, _) in enumerate(means.values())})
    here = {i: F.col(f"_v{i}").isNotNull() for i in range(len(means))}
    carried = {f"_n{i}": ("sum", c.cast("long")) for i, c in here.items()} | {f"_b{i}": ("max", F.when(c, F.col("_pos"))) for i, c in here.items()}
    rows = running(rows, carried, keys, order, block, span, before=[f"_b{i}" for i in here])
    maps = {}
    for i, (_, alpha, _) in enumerate(means.values()):
        x, old = F.col(f"_v{i}"), F.pow(F.lit(1.0 - alpha), F.col("_pos") - F.col(f"_b{i}"))
        later = here[i] & F.col(f"_b{i}").isNotNull()
        maps[f"_e{i}"] = (F.when(later, old / (old + alpha)).when(here[i], 0.0).otherwise(1.0), F.when(later, alpha * x / (old + alpha)).when(here[i], x).otherwise(0.0))
    rows = affine_scans_in_blocks(rows, maps, keys, order, block, span)
    out = {n: F.when(F.col(f"_n{i}") >= max(least, 1), F.col(f"_e{i}")) for i, (n, (_, _, least)) in enumerate(means.items())}
    return rows.withColumns(out).drop(*([] if known else ["_pos"]), *[f"_{k}{i}" for k in "vnbe" for i in range(len(means))])
