"""SimHash near duplicates through an inverted index on byte positions, with count filtering.

Two 64-bit fingerprints with at most 3 differing bits agree in at least 5 of their 8 bytes. The index lists every
fingerprint under each set of LISTED byte positions with the bytes that it has there (70 lists of 32-bit values; lists
of single bytes would grow with the corpus, and their pairs with its square). In a list the positional bytes that a pair
shares are tallied; pairs with the guaranteed 5 are verified bit by bit. Linked fingerprints form components.

Only distinct fingerprints are linked, so a group of exact copies is one entry. A long list is listed again by each
further byte, as a pair with 5 shared bytes shares one more; a list with 5 fixed bytes that is still longer than
LARGE_LIST is linked without looking at all pairs: fingerprints that agree outside of 3 of the bits in which the list
varies are within distance 3, so chains of equal masked values give the same components. From each list only a spanning
forest leaves the task.

Defined results: a null or wordless text has fingerprint 0 and is linked like any other; rows with a null doc_id get a
fingerprint and the component of the others that it meets (null if none has an id); repeated rows return repeatedly;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, slices, texts_of
from tidemark.llm.components import connected_components

MAX_BITS = 3
SHARED_BYTES = 8 - MAX_BITS
#: Byte positions of a list; fewer than SHARED_BYTES, so the tally decides.
LISTED = 4
LARGE_LIST = 1024
#: A-Z to a-z on UTF-8 bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_digests(text: str, words_in: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of words_in words, repeats included, as rows of 8 bytes, highest first."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    if len(words) <= words_in:
        return np.frombuffer(xxhash.xxh64_digest(joined, 42), np.uint8).reshape(1, 8)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - words_in].tolist()]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words_in - 1 :] - 1).tolist(), strict=True)]), np.uint8).reshape(-1, 8)


def fingerprint(text: str, words_in: int = 3) -> int:
    """64 bits: 1 where more than half of the shingles' hashes have 1; 0 without words."""
    rows = shingle_digests(text, words_in)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 4096):
        ones += np.unpackbits(rows[at : at + 4096], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_in: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, words_in) for t in texts_of(part)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _masks() -> list[int]:
    out = []
    for kept in combinations(range(8), LISTED):
        mask = sum(0xFF << (8 * k) for k in kept)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def local_roots(fps: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For each of the distinct fingerprints of a list (uint64) the index of the first one of its component."""
    n = len(fps)
    labels = np.arange(n)
    if n <= LARGE_LIST:
        apart = fps[:, None] ^ fps[None, :]
        tally = (apart.view(np.uint8).reshape(n, n, 8) == 0).sum(2)
        near = (tally >= SHARED_BYTES) & (np.bitwise_count(apart) <= max_bits)
        while True:
            least = np.where(near, labels[None, :], n).min(1)
            least = least[least]
            if (least == labels).all():
                return labels
            labels = least
    parent = list(range(n))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    places = fps.view(np.uint8).reshape(n, 8)
    free = np.flatnonzero((places != places[0]).any(0))
    if len(free) > 8 - SHARED_BYTES:
        for p in free.tolist():
            order = np.argsort(places[:, p], kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(places[order, p])) + 1):
                for x, y in zip(own.tolist(), own[local_roots(fps[own], max_bits)].tolist(), strict=True):
                    if x != y and (x := find(x)) != (y := find(y)):
                        parent[max(x, y)] = min(x, y)
        return np.array([find(k) for k in range(n)])
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [b for b in range(64) if varying >> b & 1]
    for free in combinations(bits, min(max_bits, len(bits))):
        kept = fps & np.uint64(~sum(1 << b for b in free) & (1 << 64) - 1)
        order = np.argsort(kept, kind="stable")
        same = kept[order][1:] == kept[order][:-1]
        a, b = order[:-1][same], order[1:][same]
        apart = labels[a] != labels[b]
        if apart.any():
            for x, y in np.unique(np.stack((labels[a][apart], labels[b][apart]), 1), axis=0).tolist():
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
            labels = np.array([find(k) for k in range(n)])
            if not labels.any():
                break
    return labels


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key and fp: edges from every fingerprint to the first of its component in a list."""
    held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, sizes = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(keys)])))
        two = starts[sizes == 2]
        x, y = fps[two], fps[two + 1]
        tally = ((x ^ y).view(np.uint8).reshape(-1, 8) == 0).sum(1)
        ok = (tally >= SHARED_BYTES) & (np.bitwise_count(x ^ y) <= MAX_BITS)
        out = [np.stack((y[ok], x[ok]), 1)]
        for k, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = fps[k : k + n]
            roots = local_roots(own)
            away = roots != np.arange(n)
            out.append(np.stack((own[away], own[roots[away]]), 1))
        found = np.concatenate(out).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    for batch in batches:
        held_key = np.concatenate((held_key, batch.column("key").to_numpy()))
        held = np.concatenate((held, batch.column("fp").to_numpy().view(np.uint64)))
        last = int(np.searchsorted(held_key, held_key[-1])) if len(held_key) else 0  # the last list may go on
        if last:
            yield edges(held_key[:last], held[:last])
            held_key, held = held_key[last:], held[last:]
    if len(held_key):
        yield edges(held_key, held)


def links(distinct: DataFrame) -> DataFrame:
    """distinct(fp): edges (a, b) with the components of all links at MAX_BITS or fewer."""
    lists = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(_masks())]))
    rows = distinct.select("fp", lists.alias("key"))
    return rows.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(_link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words_in: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id that links lead to) of every row."""
    rows = materialize(fingerprints(docs, words_in), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    roots = connected_components(links(distinct)).select(F.col("node").alias("fp"), "root")
    linked = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = materialize(linked.join(least, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
