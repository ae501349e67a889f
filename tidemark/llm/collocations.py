"""Phrase collocations: exact counts of all two- and three-word phrases in counting quotient filters.

1. Words are counted per language. A word's id is 64 bits of XXH64 of its language and itself; a grouping checks that
   no two words share an id (else all ids are made anew with another seed), so ids stand for words without loss.
2. A task packs the ids of every phrase, counts them in filters (``quotient_filter``), and gives one filter for each
   range of the leading bits; Spark deals out the ranges, and a range's sorted filters are merged. Ranges are as many
   as the words need for about RANGE_WORDS each, so no merge grows with the corpus, and a very frequent phrase is one
   counter of a task.
3. A phrase can only be frequent if its words are (of three words: both its pairs). Bit maps of fixed size of what is
   frequent save counting others; a map's false hits are counted exactly and dropped, so it never decides.
4. Frequent phrases are joined with the counts of their parts and scored, in whole numbers (decimals of 38 digits).

Defined results: a null language is ``und``, a null text is empty, phrases do not cross texts; rows count as often as
they occur, whatever their doc_id; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import quotient_filter as Q
from tidemark.llm.common import discard, materialize, salted_lookup, slices

#: Words of the corpus for each range of the filters; phrases and words that a task holds at once.
RANGE_WORDS, HELD_PHRASES, HELD_WORDS = 2_000_000, 2_000_000, 500_000
#: Bits of a map of frequent words or pairs: 4 MB.
MAP_BITS = 1 << 25
_BUCKET = 1 << 15
#: Bits of a word's number inside a task: three fit into a key.
_LOCAL = 21

#: Ends of pieces become a byte that no UTF-8 text has; A-Z become a-z.
_END = b"\xff"
_TABLE = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """A text's words in order, with ``_END`` between pieces."""
    return text.translate(_TABLE).replace(_END, b" \xff ").split() if text else []


class _Numbers(dict):
    """Numbers words from 1 as they come, per language (0: the end of a piece)."""

    def __init__(self, lang: str, words: list):
        super().__init__({_END: 0})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = len(self.words)
        return len(self.words)


class _Held:
    """What a task has in hand: the words by number, and the texts' words as numbers."""

    def __init__(self) -> None:
        self.words: list[tuple[str, bytes]] = []
        self.langs: dict[str, _Numbers] = {}
        self.known = np.zeros(1, np.uint64)

    def numbers(self, piece: pa.RecordBatch) -> np.ndarray:
        """The words of a piece's texts, an end behind every text."""
        out = []
        for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist(), strict=True):
            lang = "und" if lang is None else lang
            own = self.langs.get(lang)
            if own is None:
                own = self.langs[lang] = _Numbers(lang, self.words)
            out.append(list(map(own.__getitem__, chain(words_of(text), (_END,)))))
        return np.fromiter(chain.from_iterable(out), np.int64, sum(map(len, out)))

    def ids(self, seed: int) -> np.ndarray:
        """Word ids by number; only those of new words are computed."""
        starts = {lang: xxhash.xxh64_intdigest(lang.encode(), seed) for lang in self.langs}
        new = self.words[len(self.known) - 1 :]
        self.known = np.concatenate([self.known, np.fromiter((xxhash.xxh64_intdigest(word, starts[lang]) for lang, word in new), np.uint64, len(new))])
        return self.known


def _count_words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, id, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = _Held(), np.zeros(0, np.int64)
        for batch in batches:
            for piece in slices(batch):
                more = held.numbers(piece)
                n = np.bincount(more, np.ones(len(more)), len(held.words) + 1).astype(np.int64) + np.pad(n, (0, len(held.words) + 1 - len(n)))
                if len(held.words) > HELD_WORDS:
                    yield rows(held, n)
                    held, n = _Held(), n[:0]
        yield rows(held, n)

    def rows(held: _Held, n: np.ndarray) -> pa.RecordBatch:
        langs, words = zip(*held.words, strict=True) if held.words else ((), ())
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(held.ids(seed)[1:].view(np.int64)), pa.array(n[1:])], ["lang", "word", "id", "n"])

    return docs.mapInArrow(count, "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def count_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """The table of words (lang, word, id, n) and the seed of its ids, which no two words share."""
    seed = 42
    while True:
        words = materialize(_count_words(docs, seed), "words")
        if words.groupBy("id").count().where("count > 1 or id = 0").isEmpty():
            return words, seed
        discard(words)
        seed += 1


def _map_of(rows: DataFrame, column: str) -> np.ndarray:
    """A bit map of MAP_BITS bits of the numbers in a column."""
    bit = F.col(column).bitwiseAND(F.lit(MAP_BITS - 1))
    found = rows.select((bit / _BUCKET).cast("int").alias("bucket"), (bit % _BUCKET).alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in found.collect():  # MAP_BITS / _BUCKET rows at most
        out[r.bucket * _BUCKET // 8 :][: _BUCKET // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _in_map(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = (numbers & np.uint64(MAP_BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _count_phrases(docs: DataFrame, length: int, seed: int, n_words: int, least: int, common_words: np.ndarray, common_pairs: np.ndarray | None) -> DataFrame:
    """w1, .. (word ids), f, first (the first word of the permuted key) of the phrases that occur ``least`` times."""
    lead = max(4, (n_words // RANGE_WORDS).bit_length())
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((common_words, common_pairs))  # two maps of fixed size

    def packed(at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The phrases of words in a row (numbers into ids, whose first stands for the end of a piece) as numbers packed into one."""
        words, pairs = sent.value
        good = _in_map(words, ids)
        good[0] = False
        there = good[at]
        n = max(len(at) - length + 1, 0)
        start = there[:n].copy()
        for k in range(1, length):
            start &= there[k : n + k]
        if pairs is not None and n:
            seconds = np.flatnonzero(there[:-1] & there[1:])
            both = np.zeros(len(at), bool)
            both[seconds] = _in_map(pairs, Q.permute([ids[at[seconds]], ids[at[seconds + 1]]])[0])
            start &= both[:n] & both[1 : n + 1]
        first = np.flatnonzero(start)
        key = at[first]
        for k in range(1, length):
            key = key << _LOCAL | at[first + k]
        return key

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys = _Held(), []
        for batch in batches:
            for piece in slices(batch):
                at = held.numbers(piece)
                ids = held.ids(seed)
                if len(ids) >> _LOCAL:  # a text of millions of different words: it is numbered anew in parts that overlap
                    yield rows(ids, keys)
                    for low in range(0, len(at), 1 << _LOCAL - 1):
                        part, own = np.unique(np.concatenate([[0], at[low : low + (1 << _LOCAL - 1) + length - 1]]), return_inverse=True)
                        yield rows(ids[part], [packed(own[1:], ids[part])])
                    held, keys = _Held(), []
                    continue
                keys.append(packed(at, ids))
                if sum(map(len, keys)) > HELD_PHRASES or len(held.words) > HELD_WORDS:
                    yield rows(ids, keys)
                    held, keys = _Held(), []
        yield rows(held.ids(seed), keys)

    def rows(ids: np.ndarray, keys: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        mask = (1 << _LOCAL) - 1
        words = [ids[(found >> (_LOCAL * (length - 1 - k))) & mask] for k in range(length)]
        parts = Q.split(*Q.merged(Q.permute(words), counts), lead)
        return pa.record_batch([pa.array([r for r, _ in parts], pa.int32()), pa.array([f for _, f in parts], pa.binary())], ["range", "filter"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [Q.decode(f) for f in table.column("filter").to_pylist()]
        words, counts = Q.merged([np.concatenate([p[0][k] for p in parts]) for k in range(length)], np.concatenate([p[1] for p in parts]))
        often = counts >= least
        permuted = [w[often] for w in words]
        return pa.table([*[pa.array(w.view(np.int64)) for w in Q.restore(permuted)], pa.array(counts[often]), pa.array(permuted[0].view(np.int64))], names)

    names = [*[f"w{k + 1}" for k in range(length)], "f", "first"]
    parts = docs.mapInArrow(filters, "range int, filter binary")
    return parts.groupBy("range").applyInArrow(merge, ", ".join(f"{n} long" for n in names))


def mine(docs: DataFrame, least: int = 10, top: int = 2000, salts: int = 8) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by the lower of their cuts' scores, without
    those that mostly occur inside a longer phrase."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    words, seed = count_words(texts)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    n_words = words.agg(F.sum("n")).first()[0] or 0
    known = words.where(F.col("n") >= least).select("id", "lang", "word", F.col("n").alias("f"))
    common = _map_of(known, "id")
    pairs = materialize(_count_phrases(texts, 2, seed, n_words, least, common, None), "pairs")
    triples = materialize(_count_phrases(texts, 3, seed, n_words, least, common, _map_of(pairs, "first")), "triples")

    inside = triples.select(F.explode(F.array(F.struct("w1", "w2", "f"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))).alias("p")).select("p.*")
    longer = inside.groupBy("w1", "w2").agg(F.max("f").alias("_longer"))
    left = pairs.drop("first").join(longer, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("_longer") < 50 * F.col("f"), F.lit(True))).drop("_longer")

    def named(df: DataFrame, k: int) -> DataFrame:
        return salted_lookup(df, known.select(F.col("id").alias(f"w{k}"), *([F.col("lang")] if k == 1 else []), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}")), [f"w{k}"], salts)

    two = named(named(left, 1), 2).select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), F.col("f").alias("a"), F.array(F.struct(F.col("f1").alias("l"), F.col("f2").alias("r"))).alias("cuts"))
    of = pairs.drop("first")
    three = salted_lookup(triples.drop("first"), of.withColumnRenamed("f", "f12"), ["w1", "w2"], salts)
    three = salted_lookup(three, of.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23")), ["w2", "w3"], salts)
    three = named(named(named(three, 1), 2), 3)
    cuts = F.array(F.struct(F.col("f1").alias("l"), F.col("f23").alias("r")), F.struct(F.col("f12").alias("l"), F.col("f3").alias("r")))
    three = three.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), F.col("f").alias("a"), cuts.alias("cuts"))

    a = "cast({} as decimal(16,0))"  # a million times a square, below 10^38 for counts below 10^16
    score = F.expr(f"transform(cuts, (c, k) -> struct(cast(1000000 as decimal(7,0)) * ({a.format('a')} * {a.format('a')}) div ({a.format('c.l')} * {a.format('c.r')}) as score, k as k, c.l as l, c.r as r))")
    rows = two.unionByName(three).withColumn("_c", F.array_min(score)).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= top).drop("_s")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
