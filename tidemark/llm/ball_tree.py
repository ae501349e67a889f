"""Ranked lexical search: exact inner products of sparse term vectors through ball trees.

A document is a vector with one number per term, w * ((1000000000 * tf) div (1000 * tf + 8 * m)); an item is the
indicator of its terms, so the score is an inner product of whole numbers. Tasks put their documents into ball trees:
a node has the centroid and the radius of its documents, and no document below it scores above
``item . centroid + |item| * radius`` (rounded up, see ``_bounds``). An item goes down the tree best-first, leaves
compute exact 64-bit scores, and a subtree goes unread once its bound is below the tenth best score so far. Every task
gives its best documents of each item, so their best are the best of all.

Items are taken in blocks of about BLOCK_TERMS terms: a block's vocabulary, its weights and its items are all that a
task is sent, whatever the number of items; each block reads the documents once. Vectors hold the block's terms only.

Defined results: rows of the same item_id are one item with the terms of all; a null item_id is an item of its own;
rows of documents are ranked one by one, also repeated ones; a null doc_id comes last among equal scores; a text
without terms (or null) counts nowhere; an item without terms, or an empty table, has no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, slices

#: Terms of the items that are searched in one pass over the documents.
BLOCK_TERMS = 60_000
#: A tree's documents and entries, at most, and a leaf's documents.
TREE_DOCS, TREE_ENTRIES, LEAF = 4096, 1_000_000, 64

#: Bytes that end a term become spaces, A-Z become a-z; bytes of other characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"
HITS = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """A text's terms: maximal runs of ASCII letters, digits and characters from U+0080 on."""
    return text.translate(_TABLE).split() if text else []


def _raw(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = [sorted(set(terms_of(t))) for t in _raw(piece, "text")]
                at = np.repeat(np.arange(piece.num_rows), [len(f) for f in found])
                yield pa.record_batch([piece.column("item_id").take(pa.array(at)), pa.array(list(chain.from_iterable(found)), pa.binary()).cast(pa.string())], ["item_id", "term"])

    kind = dict(items.dtypes)["item_id"]
    return items.select("item_id", "text").mapInArrow(split, f"item_id {kind}, term string").distinct()


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with a term: its length in terms, and its counts of the vocabulary's terms."""
    width = max(len(vocabulary), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                words = [terms_of(t) for t in _raw(piece, "text")]
                n = np.fromiter(map(len, words), np.int64, len(words))
                ids = np.fromiter(map(vocabulary.get, chain.from_iterable(words), repeat(-1)), np.int64, int(n.sum()))
                keys = np.repeat(np.arange(len(words)), n) * width + ids
                keys, counts = np.unique(keys[ids >= 0], return_counts=True)
                there = np.flatnonzero(n)
                of = np.searchsorted(there, keys // width)
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(there)))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % width, counts)]
                yield pa.record_batch([piece.column("doc_id").take(pa.array(there)), pa.array(n[there]), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, VECTORS)


class BallTree:
    """Documents (rows of a sparse matrix of whole numbers) in nested balls; ``rows`` is their order in the leaves."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf: int = LEAF):
        self.vocabulary, local = np.unique(terms, return_inverse=True)
        self.leaf, width = leaf, len(self.vocabulary)
        sizes = np.diff(ends)
        real = values.astype(np.float64)
        norms = np.bincount(np.repeat(np.arange(len(sizes)), sizes), real * real, len(sizes))
        centroids, self.radius, self.left, self.span = [], [], [], []
        order, todo = np.arange(len(sizes)), [(0, len(sizes), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.radius)
            if parent >= 0:
                self.left[parent].append(node)
            mine = order[a:b]
            lengths = sizes[mine]
            entries = np.repeat(ends[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            cols, vals, at = local[entries], real[entries], np.repeat(np.arange(b - a), lengths)
            center = np.bincount(cols, vals, width) / (b - a)
            c2 = float(center @ center)
            squares = norms[mine] - 2 * np.bincount(at, vals * center[cols], b - a) + c2
            # what rounding may have taken away from a square is added before the root
            slack = 1e-12 * (norms[mine] + c2 + 2 * np.sqrt(norms[mine] * c2))
            centroids.append(center)
            self.radius.append(float(np.sqrt(np.maximum(squares, 0) + slack).max()))
            self.left.append([])
            self.span.append((a, b))
            if b - a > leaf:
                order[a:b] = mine[np.argsort(self._along(cols, vals, at, b - a, width, node), kind="stable")]
                middle = (a + b) // 2
                todo += [(middle, b, node), (a, middle, node)]
        self.rows, self.radius = order, np.asarray(self.radius)
        self.centroids = np.ascontiguousarray(np.stack(centroids, axis=1))
        lengths = sizes[order]
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        entries = np.repeat(ends[order] - self.ends[:-1], lengths) + np.arange(lengths.sum())
        self.terms, self.values = local[entries], values[entries]

    @staticmethod
    def _along(cols, vals, at, n: int, width: int, seed: int, turns: int = 2) -> np.ndarray:
        """The documents' places along about the direction in which they differ most (power iteration from a random one),
        so that a cut in the middle leaves like documents together."""
        places = np.bincount(at, vals * np.random.default_rng(seed).standard_normal(width)[cols], n)
        for _ in range(turns):
            places -= places.mean()
            along = np.bincount(cols, vals * places[at], width)
            along /= np.sqrt(along @ along) or 1.0
            places = np.bincount(at, vals * along[cols], n)
        return places

    def _bounds(self, item: np.ndarray) -> np.ndarray:
        """For every node a number that no score below it exceeds: sums of doubles are off by far less than 1e-9 of them."""
        return (self.centroids[item].sum(axis=0) + math.sqrt(len(item)) * self.radius) * (1 + 1e-9) + 1

    def search(self, item: np.ndarray, k: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, scores) of the leaves best-first; the caller sends the score that is still of use, at first ``least``."""
        where = np.searchsorted(self.vocabulary, item)
        where = where[(where < len(self.vocabulary)) & (self.vocabulary[np.minimum(where, len(self.vocabulary) - 1)] == item)] if len(self.vocabulary) else where[:0]
        if not len(where):
            return
        bounds, hit = self._bounds(where), np.zeros(len(self.vocabulary), np.int64)
        hit[where] = 1
        heap = [(-float(bounds[0]), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                return
            if self.left[node]:
                for child in self.left[node]:
                    heapq.heappush(heap, (max(bound, -float(bounds[child])), child))
                continue
            a, b = self.span[node]
            at = self.ends[a : b + 1]
            sums = np.concatenate([[0], np.cumsum(self.values[at[0] : at[-1]] * hit[self.terms[at[0] : at[-1]]])])
            scores = sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]
            sent = yield self.rows[a:b], scores
            least = least if sent is None else sent


class _Best:
    """The k best documents of an item so far, equal scores by doc_id."""

    def __init__(self, k: int):
        self.k, self.found = k, []

    @property
    def least(self) -> int:
        return -self.found[-1][0] if len(self.found) == self.k else 1

    def add(self, docs: list, scores: np.ndarray, rows: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.least)
        if len(good) > self.k:  # of one leaf, none below its own k-th score
            good = good[scores[good] >= np.partition(scores[good], -self.k)[-self.k]]
        if len(good):
            self.found = sorted(self.found + [(-int(scores[g]), docs[rows[g]] is None, docs[rows[g]] or 0) for g in good])[: self.k]


def _search_block(vectors: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (place in ``items``), doc_id, score: the k best of every task."""

    def values(lengths: np.ndarray, terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        m = 10 + (90 * lengths * n_docs) // n_terms
        return weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, BallTree]]:
        held, entries = [], 0
        for batch in batches:
            step = max(1, TREE_DOCS // 8)
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                held.append(piece)
                entries += len(piece.column("terms").flatten())
                if sum(h.num_rows for h in held) >= TREE_DOCS or entries >= TREE_ENTRIES:
                    yield grown(held)
                    held, entries = [], 0
        if held:
            yield grown(held)

    def grown(held: list[pa.RecordBatch]) -> tuple[list, BallTree]:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("terms").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        terms = lists.flatten().to_numpy().astype(np.int64)
        tf = table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return table.column("doc_id").to_pylist(), BallTree(ends, terms, values(table.column("n").to_numpy(), terms, tf, sizes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in items]
        for docs, tree in trees(batches):
            for item, own in zip(items, best, strict=True):
                leaves = tree.search(item, k, own.least)
                leaf = next(leaves, None)
                while leaf is not None:
                    own.add(docs, leaf[1], leaf[0])
                    try:
                        leaf = leaves.send(own.least)
                    except StopIteration:
                        leaf = None
        rows = [(i, None if absent else d, -s) for i, b in enumerate(best) for s, absent, d in b.found]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64())], ["item", "doc_id", "score"])

    return vectors.where(F.size("terms") > 0).mapInArrow(search, HITS)


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score: the k highest-scoring documents of every item with a score above 0."""
    spark = docs.sparkSession
    terms = materialize(item_terms(items), "item-terms")
    blocks = max(1, math.ceil(terms.count() / BLOCK_TERMS))
    found = []
    for block in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else terms
        rows = mine.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).collect()  # one block of the query set
        if not rows:
            continue
        names = sorted({t for r in rows for t in r.terms})
        vocabulary = {t.encode(): i for i, t in enumerate(names)}
        vectors = materialize(_vectors(docs, vocabulary), "term-vectors")
        n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = np.zeros(len(names), np.int64)
        for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the block's terms
            df[r["term"]] = r["count"]
        weights = np.asarray([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        wanted = [np.asarray([vocabulary[t.encode()] for t in r.terms], np.int64) for r in rows]
        wanted = [x[weights[x] > 0] for x in wanted]
        hits = _search_block(vectors, wanted, weights, n_docs, n_terms or 1, k)
        named = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {dict(items.dtypes)['item_id']}")
        found.append(materialize(hits.join(F.broadcast(named), "item").drop("item"), "term-hits"))  # named: one block of items
        discard(vectors)
    if not found:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
