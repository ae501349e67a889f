"""Substring deduplication by content-defined chunking.

1. A gear rolling hash over the last 16 bytes is read at the end of every word; a chunk ends where it is least among the
   words around (AROUND on both sides), and after MAX_WORDS words at the latest. So where chunks end is decided by the
   text nearby, and an insertion moves chunks without changing them. Lengths are counted in words, so short words make
   no difference, and text that repeats itself has the same chunks again and again.
2. Chunks are deduplicated by digest: Spark groups them and keeps the digests that several documents hold. Documents
   with LEAST_WORDS words in a row in such chunks are candidates.
3. In candidates, a run of ``min_words`` words can be repeated only if all chunks that lie inside of it, and whose ends
   are decided by words inside of it, are held by several documents. Those runs are compared by 128-bit digests of their
   words: grouped minima give the smallest doc_id that holds the same run, whichever documents share its pieces. Runs in
   a row with the same first document are one passage; the first document keeps its copy.

A copy of a whole earlier text is found by a digest of the text, and neither it nor its chunks count in these steps.
Only texts with candidates are moved, each once; no text is brought to another one. A hot digest (a passage in a third of
all documents) is met by partial aggregation, then by a join that Spark splits by itself.

Defined results: words are parted by ASCII white space, and two passages are equal if their words are; null and empty
texts have no chunks; rows with a null doc_id are left as they are and are never a first document; rows that share a
doc_id count as one document with several texts; repeats inside one document are not cross-document passages and stay;
other columns are ignored and kept, whatever their names are; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import apart, discard, free_units, materialize, slices

MIN_WORDS = 50
SPACES = " \t\n\r\x0b\x0c"
AROUND, MAX_WORDS, LEAST_WORDS = 3, 8, 12
#: Words before a place that its rolling hash may reach into: at most 16 bytes, of one letter and a blank each at least.
REACH = 8
MAP_BITS = 1 << 25

#: The gear table: 256 random 16-bit numbers from a fixed seed; none for the padding between texts.
GEAR = np.random.default_rng(20240607).integers(0, 1 << 16, 256, dtype=np.uint16)
GEAR[0] = 0
#: Factors of the polynomials over words (odd, so that they have inverses modulo 2**64).
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_INVERSES = tuple(np.uint64(pow(int(f), -1, 1 << 64)) for f in _FACTORS)


@dataclass(frozen=True)
class Words:
    """The words of several texts in a row."""

    hashes: np.ndarray
    bounds: np.ndarray  # first word of each text; one more for the end
    start: np.ndarray  # first byte of each word in its text
    size: np.ndarray  # bytes of each word
    gear: np.ndarray  # the rolling hash at each word's end


def words_of(column: pa.Array) -> Words:
    import xxhash

    column = pc.fill_null(column.cast(pa.large_string()), "")
    for c in "\t\n\r\x0b\x0c":
        column = pc.replace_substring(column, c, " ")
    parts = pc.split_pattern(column, " ")
    coded, offsets = parts.values.dictionary_encode(), parts.offsets.to_numpy()
    digest = xxhash.xxh3_64_intdigest
    words = [w.encode("utf-8", "surrogatepass") for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))[coded.indices.to_numpy()]
    size = pc.binary_length(parts.values).to_numpy()
    after = np.cumsum(size + 1)
    base = np.repeat(np.concatenate(([0], after))[offsets[:-1]], np.diff(offsets))
    start = after - size - 1 - base
    held = size > 0
    padded = pc.binary_join_element_wise(column, pa.scalar("\0" * 16, pa.large_string()), pa.scalar("", pa.large_string()))
    ends = np.repeat(np.frombuffer(padded.buffers()[1], np.int64, len(padded) + 1, padded.offset * 8)[:-1], np.diff(offsets)) + start + size - 1
    h = GEAR[np.frombuffer(padded.buffers()[2], np.uint8)]
    for s in (1, 2, 4, 8):  # sums of 2, 4, 8, 16 shifted entries
        rolled = h.copy()
        rolled[s:] += h[:-s] << np.uint16(s)
        h = rolled
    return Words(hashes[held], np.concatenate(([0], np.cumsum(held)))[offsets], start[held], size[held], h[ends[held]])


def chunk_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks end (numbers of the words behind them), all texts in a row, and which of the ends the text nearby
    decides (not the length of the chunk)."""
    n = len(words.gear)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    least = np.ones(n, bool)
    for k in range(1, AROUND + 1):
        beside = text[k:] == text[:-k]
        least[k:] &= ~beside | (words.gear[k:] < words.gear[:-k])
        least[:-k] &= ~beside | (words.gear[:-k] <= words.gear[k:])
    ends = np.unique(np.concatenate((np.flatnonzero(least) + 1, words.bounds[1:][np.diff(words.bounds) > 0])))
    gaps = np.diff(ends, prepend=0)
    more = (gaps - 1) // MAX_WORDS  # cuts inside of long gaps
    inside = np.repeat(ends - gaps, more) + (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1) * MAX_WORDS
    order = np.argsort(both := np.concatenate((ends, inside)), kind="stable")
    return both[order], (np.arange(len(both)) < len(ends))[order]


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of the words from each start to each end: differences of running sums, moved to the same place."""
    powers, back = (np.full(len(hashes) + 1, f, np.uint64) for f in (_FACTORS[lane], _INVERSES[lane]))
    powers[0] = back[0] = 1
    powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers[:-1], out=sums[1:])
    out = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ out >> np.uint64(29)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), check (another one and the length), text; without nulls."""
    check = F.concat_ws(" ", F.crc32(F.col("text").cast("binary")), F.octet_length("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), check.alias("check"), "text").where("doc_id is not null and text is not null")


def whole_copies(docs: DataFrame) -> DataFrame:
    """doc_id, key, first_doc_id of the rows whose whole text stands in an earlier document."""
    rows = _keyed(docs).select("doc_id", "key", "check")
    first = rows.groupBy("key", "check").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("_hi")).where("first_doc_id < _hi").drop("_hi")
    return materialize(rows.join(first, ["key", "check"]).where("doc_id != first_doc_id").select("doc_id", "key", "first_doc_id").distinct(), "copies")


#: Tables of rows with the bits of the doc_ids that are to be left out while they are read (None: none).
Sources = list[tuple[DataFrame, np.ndarray | None]]


def _without(rows: DataFrame, copies: DataFrame) -> Sources:
    """The rows that are no copies: those without a bit are read as they are, the others are joined exactly."""
    if copies.isEmpty():
        return [(rows, None)]
    bits = bit_map(copies.select("doc_id"))
    return [(rows, bits), (filtered(rows, bits).join(apart(copies.select("doc_id", "key")), ["doc_id", "key"], "left_anti"), None)]


def _union(parts: list[DataFrame]) -> DataFrame:
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def chunks(rows: DataFrame, without: np.ndarray | None = None) -> DataFrame:
    """digest, doc_id, pos (first word * 256 + words) of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        for batch in batches:
            for part in slices(batch if without is None else of_ids(batch, without, with_bit=False)):
                words = words_of(part.column("text"))
                ends, _ = chunk_ends(words)
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                text = np.searchsorted(words.bounds, starts, "right") - 1
                row = pa.array(text)
                found = run_hashes(words.hashes, starts, ends).view(np.int64)
                pos = (starts - words.bounds[text]) << 8 | ends - starts
                yield pa.RecordBatch.from_arrays([pa.array(found), part.column("doc_id").take(row), pa.array(pos)], ["digest", "doc_id", "pos"])

    return rows.select("doc_id", "text").mapInArrow(run, "digest long, doc_id long, pos long")


def candidates(sources: Sources) -> DataFrame:
    """doc_id, pos: the chunks that other documents hold too, of documents with LEAST_WORDS words of them in a row."""
    cut = materialize(_union([chunks(*source) for source in sources]), "chunks")
    shared = cut.groupBy("digest").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo < _hi").select("digest")
    grouped = cut.join(shared, "digest").groupBy("doc_id").agg(F.collect_set("pos").alias("pos"))  # at most a document's chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        for batch in batches:
            keep = []
            for own in batch.column("pos"):
                own = np.sort(own.values.to_numpy())
                start, end = own >> 8, (own >> 8) + (own & 255)
                first = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
                keep.append(bool((np.concatenate((end[first[1:] - 1], end[-1:])) - start[first] >= LEAST_WORDS).any()))
            yield batch.filter(pa.array(keep, pa.bool_()))

    found = materialize(grouped.mapInArrow(run, "doc_id long, pos array<long>"), "candidates")
    discard(cut)
    return found


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ h >> np.uint64(31)) % np.uint64(MAP_BITS)).astype(np.int64)


def bit_map(ids: DataFrame) -> np.ndarray:
    """Bits of the ids (one long column) in a map of MAP_BITS bits: its size does not depend on the data."""
    block = 1 << 15  # bits

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        sent = np.zeros(MAP_BITS // 8, np.uint8)
        for batch in batches:
            at = np.unique(_mixed(batch.column(0).to_numpy()))
            at = at[sent[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 0]  # a task sends a place once
            np.bitwise_or.at(sent, at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(at // block), pa.array(at)], ["block", "place"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        own = np.zeros((MAP_BITS // block, block // 8), np.uint8)
        for batch in batches:
            at = batch.column("place").to_numpy()
            np.bitwise_or.at(own.reshape(-1), at >> 3, (1 << (at & 7)).astype(np.uint8))
        held = np.flatnonzero(own.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([zlib.compress(own[k].tobytes(), 1) for k in held.tolist()], pa.binary())], ["block", "bits"])

    out = np.zeros(MAP_BITS // 8, np.uint8)
    rows = ids.mapInArrow(places, "block long, place long").repartition("block").mapInArrow(gathered, "block long, bits binary")
    for r in rows.collect():  # MAP_BITS bits at most
        out[r["block"] * (block // 8) : (r["block"] + 1) * (block // 8)] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def has_bit(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _mixed(ids)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def of_ids(batch: pa.RecordBatch, bits: np.ndarray, with_bit: bool = True, column: str = "doc_id") -> pa.RecordBatch:
    """The rows whose id has (or lacks) its bit; a null has none. It saves moving the other rows and never decides."""
    ids = batch.column(column)
    there = has_bit(bits, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) & ids.is_valid().to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(there == with_bit))


def filtered(rows: DataFrame, bits: np.ndarray, with_bit: bool = True, column: str = "doc_id", without: np.ndarray | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        for batch in batches:
            batch = of_ids(batch, bits, with_bit, column)
            yield batch if without is None else of_ids(batch, without, with_bit=False, column=column)

    return rows.mapInArrow(run, rows.schema)


def possible_starts(words: Words, shared: list[np.ndarray], min_words: int) -> np.ndarray:
    """The first words of the runs in which no chunk speaks against a repetition; shared: each text's chunks in others.

    A chunk [a, b) that others do not hold speaks against the runs [s, s + min_words) that hold it with AROUND words
    behind, and before it a decided end with the words that decided it."""
    ends, decided = chunk_ends(words)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    text = np.searchsorted(words.bounds, starts, "right") - 1
    pos = (starts - words.bounds[text]) << 8 | ends - starts
    known = np.zeros(len(ends), bool)
    for k, (a, b) in enumerate(zip(np.searchsorted(text, np.arange(len(shared))), np.searchsorted(text, np.arange(len(shared)), "right"), strict=True)):
        known[a:b] = np.isin(pos[a:b], shared[k])
    begins = np.concatenate(([True], decided[:-1])) if len(decided) else decided
    at = np.maximum.accumulate(np.where(begins, starts, 0)) if len(starts) else starts  # the decided end before each chunk
    low, high = words.bounds[text], words.bounds[text + 1] - min_words
    first, last = np.maximum(ends + AROUND - min_words, low), np.minimum(at - AROUND - 1 - REACH, high)
    against = ~known & (first <= last)
    step = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(step, first[against], 1)
    np.add.at(step, last[against] + 1, -1)
    ok = np.cumsum(step)[:-1] == 0
    whole = np.repeat(words.bounds[1:] - min_words, np.diff(words.bounds))
    return np.flatnonzero(ok & (np.arange(len(ok)) <= whole))


def runs(sources: Sources, found: DataFrame, min_words: int) -> DataFrame:
    """h1, h2, doc_id, key (hash of the text), at (first word), chars (first << 32 | behind) of the runs to compare."""
    names = ["h1", "h2", "doc_id", "key", "at", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"))
                first = words.bounds[:-1]
                starts = possible_starts(words, [x.values.to_numpy() for x in part.column("pos")], min_words)
                text = np.searchsorted(words.bounds, starts, "right") - 1
                begin, end = words.start[starts], words.start[starts + min_words - 1] + words.size[starts + min_words - 1]
                for k, (a, b) in enumerate(zip(np.searchsorted(text, np.arange(len(first))), np.searchsorted(text, np.arange(len(first)), "right"), strict=True)):
                    if a < b and not (raw := part.column("text")[k].as_py().encode("utf-8", "surrogatepass")).isascii():
                        chars = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)))
                        begin[a:b], end[a:b] = chars[begin[a:b]], chars[end[a:b]]
                lanes = [run_hashes(words.hashes, starts, starts + min_words, lane).view(np.int64) for lane in (0, 1)]
                row, chars = pa.array(text), begin.astype(np.int64) << 32 | end
                columns = [pa.array(lanes[0]), pa.array(lanes[1]), part.column("doc_id").take(row), part.column("key").take(row), pa.array(starts - first[text]), pa.array(chars)]
                yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], names)

    bits = bit_map(found.select("doc_id"))
    own = [filtered(rows, bits, without=without).join(apart(found), "doc_id").select("doc_id", "key", "text", "pos") for rows, without in sources]
    return _union(own).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _whole_passages(rows: DataFrame, copies: DataFrame, min_words: int) -> DataFrame:
    names = ["doc_id", "key", "start_char", "end_char", "n_words", "first_doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        for batch in batches:
            found = []
            for doc, key, text, first in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text", "first_doc_id")), strict=True):
                plain = text.strip(SPACES)
                if (n := len(plain.encode("utf-8", "surrogatepass").split())) >= min_words:
                    start = len(text) - len(text.lstrip(SPACES))
                    found.append((doc, key, start, start + len(plain), n, first))
            columns = zip(*found, strict=True) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    held = filtered(rows, bit_map(copies.select("doc_id"))).join(apart(copies), ["doc_id", "key"]).select("doc_id", "key", "text", "first_doc_id")
    return held.mapInArrow(run, ", ".join(f"{c} long" for c in names)).distinct()


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key (hash of its text), start_char, end_char, n_words, first_doc_id of every repeated passage."""
    copies = whole_copies(docs)
    rows = _keyed(docs).drop("check")
    sources = _without(rows, copies)
    found = candidates(sources)
    held = materialize(runs(sources, found, min_words), "runs")
    firsts = held.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("_hi")).where("first_doc_id < _hi").drop("_hi")
    hits = held.join(firsts, ["h1", "h2"]).where("doc_id != first_doc_id")
    place = F.dense_rank().over(Window.partitionBy("doc_id", "key", "first_doc_id").orderBy("at"))  # at most a document's words
    passages = hits.withColumn("_run", F.col("at") - place).groupBy("doc_id", "key", "first_doc_id", "_run").agg(
        F.min(F.shiftright("chars", 32)).alias("start_char"), F.max(F.col("chars").bitwiseAND(F.lit((1 << 32) - 1))).alias("end_char"), (F.max("at") - F.min("at") + min_words).cast("long").alias("n_words")
    )
    passages = passages.select("doc_id", "key", "start_char", "end_char", "n_words", "first_doc_id")
    whole = [] if len(sources) == 1 else [_whole_passages(rows, copies, min_words)]
    out = materialize(_union([passages, *whole]), "passages")
    discard(copies, found, held)
    return out


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the passages taken out of their texts (all columns kept; a text may become empty).

    Rows whose doc_id is not in a bit map of the passages' are passed on in one pass, the others are joined."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    text, doc_id = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    spans = materialize(passages.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start_char", "end_char")).alias("spans")), "spans")
    rows = docs.toDF(*names)
    bits, schema = bit_map(spans.select("doc_id")), rows.schema
    same = filtered(rows.withColumn("doc_id", F.col(doc_id).cast("long")), bits, with_bit=False).drop("doc_id")
    other = filtered(rows.withColumn("doc_id", F.col(doc_id).cast("long")), bits).withColumn("key", F.xxhash64(text)).join(apart(spans), ["doc_id", "key"], "left").select(*names, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        for batch in batches:
            columns = [batch.column(c) for c in names]
            texts = columns[names.index(text)].to_pylist()
            for k, own in enumerate(batch.column("spans").to_pylist()):
                if own:
                    kept, last = [], 0
                    for a, b in sorted((s["start_char"], s["end_char"]) for s in own):
                        kept.append(texts[k][last : max(a, last)])
                        last = max(last, b)
                    texts[k] = "".join([*kept, texts[k][last:]])
            columns[names.index(text)] = pa.array(texts, columns[names.index(text)].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return same.unionByName(other.mapInArrow(run, schema)).toDF(*docs.columns)
