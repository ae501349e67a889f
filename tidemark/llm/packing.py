"""Best-fit packing of documents into sequences, planned on the histogram of piece lengths.

Only documents longer than a sequence are cut. Exact-complement hashing: lengths, sums of pairs and sums of triples of
the lengths still available are looked up for the gap that a longer piece leaves; a combination that fills it exactly
is used as often as the counts allow. What is left is packed best-fit decreasing, again by counts. The plan depends on
how many pieces have each length (at most ``capacity`` numbers), never on the rows; each row then finds its place from
its number among the pieces of its length.

Defined results: a null or empty text is one piece with the end id alone; rows with the same doc_id are packed as
separate documents, each in a place of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, salted_rank, slices
from tidemark.llm.tokens import TOKEN_BYTES, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keeps_space: bool = True, keep_ids: bool = False) -> DataFrame:
    """One row per piece: a document's ids and the end id, cut into pieces of ``capacity``; the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=TOKEN_BYTES):
                ids, at = encoder(tokenizer, keeps_space).encode(part.column("text"))
                rows, kept = [], []
                for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    start, end, piece = 0, (len(own) - 1) % capacity + 1, 0
                    while start < len(own):
                        rows.append((doc_id, piece, start, end - start, zlib.crc32(own[start:end].tobytes())))
                        if keep_ids:
                            kept.append(own[start:end].astype(np.int64))
                        start, end, piece = end, end + capacity, piece + 1
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.list_(pa.int64()))] * keep_ids, names + ["ids"] * keep_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + ", ids array<long>" * keep_ids)


def plan_patterns(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """counts[n]: pieces of length n; len(counts) - 1: the capacity. Returns (lengths in a sequence, how many such)."""
    left, capacity = counts.astype(np.int64).copy(), len(counts) - 1
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> None:
        need = {n: lengths.count(n) for n in lengths}
        times = int(min(left[n] // c for n, c in need.items()))
        for n, c in need.items():
            left[n] -= c * times
        patterns.append((lengths, times))

    if left[capacity]:
        use((capacity,))
    for longest in range(capacity - 1, 0, -1):
        gap = capacity - longest
        while left[longest]:
            left[longest] -= 1  # the piece itself isn't its own complement
            found = _complement(left, gap)
            left[longest] += 1
            if not found:
                break
            use((longest, *found))
    _best_fit(left, patterns)
    return patterns


def _complement(left: np.ndarray, gap: int) -> tuple[int, ...]:
    """One, two or three available lengths with the sum ``gap``, the longest first; none: ()."""
    if gap < 1:
        return ()
    if gap < len(left) and left[gap]:
        return (gap,)
    there = np.flatnonzero(left[1:gap]) + 1
    if not len(there):
        return ()
    has = left > 0
    twice = left > 1
    high = there[::-1]
    low = gap - high
    fits = np.flatnonzero((low >= 1) & (low <= high) & has[low] & ((low != high) | twice[low]))
    if len(fits):
        return int(high[fits[0]]), int(low[fits[0]])
    for first in high.tolist():
        rest = gap - first
        if 3 * first < gap:
            break
        second = high[(high <= min(first, rest - 1))]
        third = rest - second
        ok = (third <= second) & has[third]
        if ok.any():
            for b, c in zip(second[ok].tolist(), third[ok].tolist(), strict=True):
                need = {n: (first, b, c).count(n) for n in (first, b, c)}
                if all(left[n] >= k for n, k in need.items()):
                    return first, b, c
    return ()


def _best_fit(left: np.ndarray, patterns: list[tuple[tuple[int, ...], int]]) -> None:
    """Best-fit decreasing by counts: open sequences are kept as gap -> [(lengths, how many)]."""
    capacity = len(left) - 1
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = np.zeros(capacity + 1, np.int64)  # how many open sequences have this gap
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fitting = np.flatnonzero(gaps[length:])
            if len(fitting):
                gap = int(fitting[0]) + length
                lengths, times = open_[gap].pop()
                used = min(times, n)
                if used < times:
                    open_[gap].append((lengths, times - used))
                gaps[gap] -= used
                lengths = (*lengths, length)
            else:
                gap, per = capacity, min(n, capacity // length)
                used, lengths = n // per, (length,) * per
            rest = capacity - sum(lengths)
            open_.setdefault(rest, []).append((lengths, used))
            gaps[rest] += used
            n -= used * (len(lengths) if len(set(lengths)) == 1 and gap == capacity else 1)
        left[length] = 0
    patterns += [x for group in open_.values() for x in group if x[1]]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number of a piece of this length, sequence of that piece, offset), sorted."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, taken.get(n, 0), sequence, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        sequence += times
    return np.asarray(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, keeps_space: bool = True, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset; with keep_ids also their ids."""
    pieces = materialize(pieces_of(docs, tokenizer, end_id, capacity, keeps_space, keep_ids), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    slots = _slots(plan_patterns(counts))
    numbered = salted_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_k")
    names = [c for c in pieces.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            number = batch.column("_k").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 44 | number, "right") - 1
            sequence, offset = slots[at, 2] + number - slots[at, 1], slots[at, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, PIECES + ", ids array<long>" * keep_ids + ", sequence_id long, offset long")
