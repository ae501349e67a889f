"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answer checks.

1. The terms are the words of the benchmark, so everything that is fitted or sent to tasks depends on the benchmark's
   size, not on the corpus. Other words count in a passage's length only. Items and texts are read by the same function:
   cut at Unicode white space, lower case, without outer punctuation; what is only punctuation is no word.
2. One pass over all texts counts the passages (64 words) that hold each term, which gives the IDF, and writes the
   passages down as terms. The IDF is never 0: however frequent, no term loses its direction.
3. A randomised SVD of TF-IDF passages: its rows are benchmark segments and all passages. It needs A'(A Q) only: A'A is
   a table of pairs of terms, which one pass over the passages adds up, so its products cost nothing that grows with the
   corpus (with more than GRAM_TERMS terms each product is a pass over the passages). Every PART_ITEMS items have a space
   of their own, so that the share of an item inside its space does not shrink with the benchmark.
4. One pass over all texts: windows of 8, 16, 32 and 64 words at half steps are compared with the segments of the
   matching length by cosine in the latent space, by sums over blocks of 8 words (projection and product are linear).
5. Beside the cosine, a place where RUN words of an item stand in a row (or all, if it has fewer) is a candidate, so
   verbatim copies are found whatever their cosine is.
6. In the same task every candidate is verified: the longest common subsequence of the item and the words around the
   window, and for paraphrases (a smaller share) the item's last words, its answer, too.

No text is shuffled, and there is no limit on candidates.

Defined results: null and empty texts have no windows; texts shorter than a window are one; null or empty items match
nothing; cosine is null where only the run of words led to the item; a null doc_id or item_id stays null; repeated rows are returned repeatedly; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free_units, materialize, slices

RANK, OVERSAMPLED = 192, 208
PASSAGE = 64
#: Tasks, at least, that add up the matrices of the tasks before them, term by term.
FIT_TASKS = 6
#: Most terms whose pairs a task has in hand (8 bytes each; twice the terms, four times the memory), and passages that it
#: reads for them, so that what such tasks return is a small share of what they read.
GRAM_TERMS, GRAM_PASSAGES = 8_000, 400_000
#: Weight of a benchmark row against all passages in the fit, so that the space holds what is searched for.
ITEM_SHARE = 0.05
BLOCK, SCALES = 8, (8, 16, 32, 64)
MIN_COSINE = 0.3
PART_ITEMS, RUN = 256, 8
#: Contaminated: this share of the item in order, or the smaller one if the answer's share is reached too.
SURE, PARAPHRASE, ANSWER = 0.75, 0.5, 0.75
ANSWER_WORDS = 8
#: White space (of str.split) besides the blank.
_ASCII_SPACES, _OTHER_SPACES = "\t\n\r\x0b\x0c", "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Blocks whose sums a searching task has in hand at once.
PIECE_BLOCKS = 16_384


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' parts between white space in a row (some are empty), and where each text starts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    for c in _ASCII_SPACES:
        column = pc.replace_substring(column, c, " ")
    if pc.any(pc.match_substring_regex(column, _OTHER_SPACES)).as_py():
        column = pc.replace_substring_regex(column, _OTHER_SPACES, " ")
    parts = pc.split_pattern(column, " ")
    return parts.values, parts.offsets.to_numpy()


def bare_words(words: pa.Array) -> pa.Array:
    """Lower case, without outer punctuation."""
    return pc.utf8_trim(pc.utf8_lower(words), characters=string.punctuation)


def bare(word: str) -> str:
    return bare_words(pa.array([word]))[0].as_py()


@dataclass(frozen=True)
class Terms:
    """The benchmark's words."""

    words: list[str]


def word_codes(column: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all texts in a row (-1: another word), and where each text starts (one more for the end)."""
    words, offsets = split_words(column)
    coded = words.dictionary_encode()
    plain = bare_words(coded.dictionary)
    code_of = pc.fill_null(pc.index_in(plain, value_set=terms), -1).to_numpy(zero_copy_only=False).copy()
    code_of[pc.equal(plain, "").to_numpy(zero_copy_only=False)] = -2  # no word
    codes = code_of[coded.indices.to_numpy()]
    held = codes != -2
    return codes[held], np.concatenate(([0], np.cumsum(held)))[offsets]


def _first_pass(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int, DataFrame]:
    """For every term the passages that hold it, the number of passages, and all passages (arrays of terms)."""
    n_terms = len(terms.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        known_terms = pa.array(terms.words, pa.large_string())
        total = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                codes, at = word_codes(part.column("text"), known_terms)
                sizes = np.diff(at)
                per = -(-sizes // PASSAGE)
                passage = np.repeat(np.concatenate(([0], np.cumsum(per)[:-1])), sizes) + (np.arange(len(codes)) - np.repeat(at[:-1], sizes)) // PASSAGE
                known = codes >= 0
                held = np.sort(passage[known] * n_terms + codes[known])
                total[:-1] += np.bincount(held[np.diff(held, prepend=-1) != 0] % n_terms, minlength=n_terms)
                total[-1] += int(per.sum())
                starts = np.append(np.flatnonzero(np.diff(passage, prepend=-1)), len(codes))
                rows = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(codes, pa.int32()))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int64()), rows], ["term", "n", "codes"])
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there]), pa.nulls(len(there), pa.list_(pa.int32()))], ["term", "n", "codes"])

    table = materialize(docs.select("text").mapInArrow(run, "term int, n long, codes array<int>"), "terms")
    counts = np.zeros(n_terms + 1, np.int64)
    for r in table.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect():  # terms + 1 rows at most
        counts[r["term"]] = r["n"]
    passages = table.where("codes is not null").select("codes")
    passages.work_table = table.work_table
    return counts[:-1], int(counts[-1]), passages


def _sums(codes: np.ndarray, rows: np.ndarray, n_rows: int, factor: np.ndarray) -> np.ndarray:
    """For each of the (sorted) row numbers the sum of factor over its codes."""
    out = np.zeros((n_rows, factor.shape[1]), np.float32)
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows)))
    order = np.argsort(place, kind="stable")
    for own in np.split(order, np.cumsum(np.bincount(place))[:-1]) if len(rows) else []:  # a row once in each
        out[rows[own]] += factor[codes[own]]
    return out


def _added(parts: DataFrame, n_tasks: int) -> DataFrame:
    """The sum of each term's rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, row in zip(batch.column("term").to_pylist(), batch.column("row"), strict=True):
                held[k] = held.get(k, 0) + row.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float32()))], ["term", "row"])

    return parts.repartition(n_tasks, "term").mapInArrow(add, "term long, row array<float>")


def _collected(parts: DataFrame, n_terms: int, width: int) -> np.ndarray:
    out = np.zeros((n_terms, width), np.float32)
    for r in _added(parts, FIT_TASKS).collect():  # terms x width numbers
        out[r["term"]] = r["row"]
    return out


def _gram_times(passages: DataFrame, idf: np.ndarray, other: float, q: np.ndarray) -> np.ndarray:
    """A'(A q) over the passages; a task returns its sum term by term, Spark adds them up."""
    n_terms, width = q.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        total = np.zeros((n_terms, width), np.float32)
        for batch in batches:
            codes, rows, square = _squares(batch.column("codes"), idf, other)
            known = np.flatnonzero(codes >= 0)
            codes, rows = codes[known], rows[known]
            hit = _sums(codes, rows, len(square), (idf[:, None] * q).astype(np.float32)) / square[:, None].astype(np.float32)
            for k in range(0, len(codes), 20_000):
                own = codes[k : k + 20_000]
                order = np.argsort(own, kind="stable")
                cuts = np.flatnonzero(np.diff(own[order], prepend=-1))
                total[own[order][cuts]] += np.add.reduceat(hit[rows[k : k + 20_000][order]], cuts, axis=0)
        total *= idf[:, None].astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_terms)), pa.array(list(total), pa.list_(pa.float32()))], ["term", "row"])

    return _collected(passages.mapInArrow(run, "term long, row array<float>"), n_terms, width)


def _squares(column: pa.Array, idf: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The passages' terms in a row, the passage of each, and each passage's squared norm."""
    codes = column.flatten().to_numpy()
    rows = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return codes, rows, np.maximum(np.bincount(rows, np.where(codes >= 0, idf[codes], other) ** 2, len(column)), 1e-9)


def _gram(passages: DataFrame, counts: np.ndarray, n: int, idf: np.ndarray, other: float) -> DataFrame:
    """A'A over the passages: for each term its products with the terms that are not rarer (``_by_count``), itself last.

    A task adds up all pairs of terms of its passages; Spark adds the tasks' sums up. Pairs of frequent terms, the most
    by far, stand close together in a task's memory."""
    n_terms, rank = len(idf), np.argsort(_by_count(counts))
    first = np.arange(n_terms + 1) * np.arange(1, n_terms + 2) // 2  # of each term's row in the triangle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        total, of_rank = np.zeros(first[-1]), np.zeros(n_terms)
        of_rank[rank] = idf  # in an array made here: np.add.at is twenty times slower with types that came from the driver
        for batch in batches:
            codes, rows, square = _squares(batch.column("codes"), idf, other)
            known = codes >= 0
            held = np.sort(rows[known] * n_terms + rank[codes[known]])
            cuts = np.flatnonzero(np.diff(held, prepend=-1))
            row, term = np.divmod(held[cuts], n_terms)
            value = np.diff(cuts, append=len(held)) * of_rank[term] / np.sqrt(square[row])
            begin = np.searchsorted(row, row)
            own = np.arange(len(row))
            pairs = own - begin + 1  # with itself and the terms before it in the passage
            before = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs - begin, pairs)
            np.add.at(total, np.repeat(first[term], pairs) + term[before], np.repeat(value, pairs) * value[before])
        for a in range(0, n_terms, 256):
            at = first[a : min(a + 256, n_terms) + 1]
            lists = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(total[at[0] : at[-1]].astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(lists))), lists], ["term", "row"])

    tasks = max(1, -(-n // GRAM_PASSAGES))
    parts = passages.coalesce(tasks).mapInArrow(run, "term long, row array<float>")
    return materialize(_added(parts, max(FIT_TASKS, tasks)), "gram")


def _by_count(counts: np.ndarray) -> np.ndarray:
    """The terms, frequent ones first."""
    return np.argsort(-counts, kind="stable")


def _triangle_times(gram: DataFrame, counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'A q from the table of ``_gram``: each of its rows counts as a row and, but for its last number, as a column."""
    n_terms, width = q.shape
    order = _by_count(counts)
    ranked = q[order].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        total = np.zeros((n_terms, width), np.float32)
        for batch in batches:
            terms = batch.column("term").to_numpy()
            dense = np.zeros((len(terms), n_terms), np.float32)
            dense[np.arange(n_terms) <= terms[:, None]] = batch.column("row").flatten().to_numpy()
            total[terms] += dense @ ranked
            dense[np.arange(len(terms)), terms] = 0
            total += dense.T @ ranked[terms]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_terms)), pa.array(list(total), pa.list_(pa.float32()))], ["term", "row"])

    out = np.empty((n_terms, width), np.float32)
    out[order] = _collected(gram.mapInArrow(run, "term long, row array<float>"), n_terms, width)
    return out


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """An orthonormal base of z's columns, through the small matrix z'z, twice for accuracy."""
    for _ in range(2):
        values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
        kept = values > max(values.max(), 1e-30) * 1e-10
        z = z @ (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)
    return z


@dataclass(frozen=True)
class Part:
    """The space of PART_ITEMS items.

    For a segment with the unit vector v, a window's cosine is the sum over its words of (idf times right singular
    vectors) v, over the window's norm. As this is linear in the words, the product of both is kept, one column a segment.
    """

    products: np.ndarray  # terms + 1 x segments, in the order of their scales; the last row, for other words, is 0
    owners: dict[int, tuple[int, int, np.ndarray]]  # scale: first and last column, the items that its segments belong to


@dataclass(frozen=True)
class Space:
    """What a searching task needs: its size depends on the benchmark only."""

    terms: Terms
    parts: list[Part]
    squares: np.ndarray  # idf squared of the terms, then of other words
    runs: dict[int, tuple[np.ndarray, np.ndarray]]  # length: sorted hashes of runs of words, the items they belong to
    items: list[np.ndarray]
    ids: list[int | None]


def _scale_of(n: int) -> int:
    return next((s for s in reversed(SCALES) if n >= 1.25 * s), SCALES[0])


def fit_space(docs: DataFrame, benchmark: DataFrame) -> Space | None:
    """None: the benchmark has no words."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").collect()  # the stated query set
    cut, at = split_words(pa.array([r["text"] for r in rows], pa.large_string()))
    cut = bare_words(cut).to_pylist()
    ids, words = [r["item_id"] for r in rows], [[w for w in cut[a:b] if w] for a, b in zip(at[:-1], at[1:], strict=True)]
    terms = Terms(sorted({w for item in words for w in item}))
    number = {w: k for k, w in enumerate(terms.words)}
    items = [np.array([number[w] for w in item], np.int32) for item in words]
    if not terms.words:
        return None
    counts, n, passages = _first_pass(docs, terms)
    idf = np.log((n + 1) / (counts + 1)) + 0.1
    other = float(np.median(idf))
    squares = np.append(idf, other) ** 2
    if len(terms.words) <= GRAM_TERMS:
        gram = _gram(passages, counts, n, idf, other)
        discard(passages)
        times = lambda q: _triangle_times(gram, counts, q)
    else:
        times = lambda q: _gram_times(passages, idf, other, q)
    parts = [_fit_part(items, range(k, min(k + PART_ITEMS, len(items))), idf, n, times) for k in range(0, len(items), PART_ITEMS)]
    return Space(terms, [p for p in parts if p], squares.astype(np.float32), _runs(items), items, ids)


def _fit_part(items: list[np.ndarray], own_items: range, idf: np.ndarray, n: int, times: Callable[[np.ndarray], np.ndarray]) -> Part | None:
    """times: the passages' A'A times a matrix."""
    segments = [(k, own[a : a + 80]) for k in own_items if len(own := items[k]) for a in range(0, max(1, len(own) - 40), 40)]
    if not segments:
        return None
    a = np.zeros((len(segments), len(idf)), np.float32)
    for k, (_, own) in enumerate(segments):
        np.add.at(a[k], own, idf[own].astype(np.float32))
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    weight = np.float32(max(1.0, ITEM_SHARE * n))
    image_of = lambda q: times(q) + weight * (a.T @ (a @ q))
    width = min(OVERSAMPLED, len(idf))
    q = _orthonormal(image_of(np.random.default_rng(7).standard_normal((len(idf), width), dtype=np.float32)))
    image = image_of(q)
    values, vectors = np.linalg.eigh((q.T @ image + image.T @ q).astype(np.float64) / 2)
    kept = values > max(values.max(), 1e-30) * 1e-7  # A'A is about image (q' image)^-1 image'
    half = image @ (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)
    values, vectors = np.linalg.eigh((half.T @ half).astype(np.float64))
    top = np.argsort(values)[::-1][:RANK]
    basis = half @ (vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-12))).astype(np.float32)
    latent = a @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    products, owners, width = [], {}, 0
    for scale in SCALES:
        own = [k for k, (_, seg) in enumerate(segments) if _scale_of(len(seg)) == scale]
        if own:
            owners[scale] = (width, width + len(own), np.array([segments[k][0] for k in own]))
            products.append(idf[:, None].astype(np.float32) * (basis @ latent[own].T))
            width += len(own)
    return Part(np.concatenate((np.concatenate(products, 1), np.zeros((1, width))), dtype=np.float32), owners)


_FACTORS = np.random.default_rng(31).integers(0, 1 << 63, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _run_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` codes from each place on (candidates only: they are verified)."""
    n = max(len(codes) - length + 1, 0)
    own, out = (codes + 1).astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(length):
        out += own[k : k + n] * _FACTORS[k]
    return out


def _runs(items: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    for k, own in enumerate(items):
        if len(own):
            found.setdefault(length := min(len(own), RUN), []).append((np.unique(_run_hashes(own, length)), k))
    out = {}
    for length, rows in found.items():
        hashes, owner = np.concatenate([h for h, _ in rows]), np.repeat([k for _, k in rows], [len(h) for h, _ in rows])
        order = np.argsort(hashes, kind="stable")
        out[length] = hashes[order], owner[order]
    return out


def _run_places(codes: np.ndarray, at: np.ndarray, space: Space) -> Iterator[tuple[int, int, int]]:
    """(text, item, first word in the row) where a run of an item stands; of near places of an item one each n / 2 words."""
    for length, (hashes, owner) in space.runs.items():
        own = _run_hashes(codes, length)
        low = np.searchsorted(hashes, own)
        hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == own)
        text = np.searchsorted(at, hit, "right") - 1
        inside = hit + length <= at[text + 1]
        last: dict[tuple[int, int], int] = {}
        for t, p, a in zip(text[inside].tolist(), hit[inside].tolist(), low[hit[inside]].tolist(), strict=True):
            while a < len(hashes) and hashes[a] == own[p]:
                item = int(owner[a])
                if (t, item) not in last or p > last[t, item] + len(space.items[item]) // 2:
                    last[t, item] = p
                    yield t, item, p
                a += 1


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit per element of a."""
    at: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << k
    full = v = (1 << len(a)) - 1
    for x in b.tolist():
        if m := at.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass(frozen=True)
class Blocks:
    """Blocks of BLOCK words of several texts, with empty ones behind each text for windows that reach over its end."""

    first: np.ndarray  # of each text; one more for the end
    count: np.ndarray  # of each text
    codes: np.ndarray  # block x BLOCK: terms, -1: another word or none
    square: np.ndarray  # of each block: sum of squared IDFs


def _blocks(codes: np.ndarray, at: np.ndarray, squares: np.ndarray) -> Blocks:
    sizes = np.diff(at)
    count = np.maximum(-(-sizes // BLOCK), 1)
    first = np.concatenate(([0], np.cumsum(count + SCALES[-1] // BLOCK - 1)))
    inside = np.arange(len(codes)) - np.repeat(at[:-1], sizes)
    place = np.repeat(first[:-1] * BLOCK, sizes) + inside
    table = np.full(first[-1] * BLOCK, -1, np.int32)
    table[place] = codes
    return Blocks(first, count, table.reshape(-1, BLOCK), np.bincount(place // BLOCK, squares[codes], first[-1]))


def _starts(blocks: Blocks, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: text, first word in it, first block. Steps of half a window; a short text has one window."""
    n = scale // BLOCK
    step = max(1, n // 2)
    per = np.where(blocks.count <= n, 1, -(-(blocks.count - n) // step) + 1)
    text = np.repeat(np.arange(len(per)), per)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * step
    return text, begin * BLOCK, blocks.first[text] + begin


def _near(blocks: Blocks, space: Part) -> Iterator[tuple[int, int, int, float, int]]:
    """(text, first word, item, cosine, scale) of the windows and segments with MIN_COSINE or more."""
    windows = {scale: _starts(blocks, scale) for scale in space.owners}
    for begin in range(0, len(blocks.codes), PIECE_BLOCKS):
        codes = blocks.codes[begin : begin + PIECE_BLOCKS + SCALES[-1] // BLOCK]
        square, n, done = blocks.square[begin : begin + len(codes)].copy(), 1, 0
        sums = space.products[codes[:, 0]]
        for k in range(1, BLOCK):
            sums += space.products[codes[:, k]]
        for scale, (low, high, owner) in space.owners.items():
            while n < scale // BLOCK:  # sums over twice as many blocks; those at the end of a piece belong to the next one
                sums[:-n, done:] += sums[n:, done:].copy()
                square[:-n] += square[n:].copy()
                n *= 2
            text, first, starts = windows[scale]
            a, b = np.searchsorted(starts, (begin, begin + PIECE_BLOCKS))
            own = sums[starts[a:b] - begin, low:high]
            norm = np.sqrt(np.maximum(square[starts[a:b] - begin], 1e-9)).astype(np.float32)
            w, s = np.nonzero(own >= MIN_COSINE * norm[:, None])
            yield from zip(text[a:b][w].tolist(), first[a:b][w].tolist(), owner[s].tolist(), (own[w, s] / norm[w]).tolist(), [scale] * len(w), strict=True)
            done = high


def _found(texts: pa.Array, space: Space, terms: pa.Array) -> dict[tuple[int, int], tuple]:
    """(text, item): cosine, share of the longest common subsequence, the answer's share, first word."""
    codes, at = word_codes(texts, terms)
    best: dict[tuple[int, int], tuple] = {}

    def check(t: int, item: int, a: int, b: int, cosine: float | None, first: int) -> None:
        if (before := best.get((t, item), (None, 0.0)))[1] >= 0.999:
            return
        words, n = space.items[item], len(space.items[item])
        own = codes[max(a, at[t]) : min(b, at[t + 1])]
        if sum(map(set(own.tolist()).__contains__, words.tolist())) < PARAPHRASE * n:
            return  # a common subsequence has no other words
        share = common_subsequence(words, own) / n
        if share < PARAPHRASE or share <= before[1]:
            return
        answer = common_subsequence(words[-ANSWER_WORDS:], own) / min(n, ANSWER_WORDS)
        if share >= SURE or answer >= ANSWER:
            best[t, item] = (before[0] if cosine is None else cosine, share, answer, first)

    blocks = _blocks(codes, at, space.squares)
    for place in space.parts:
        for t, first, item, cosine, scale in _near(blocks, place):
            n = len(space.items[item])
            check(t, item, at[t] + first - n, at[t] + first + scale + n, cosine, first)
    for t, item, p in _run_places(codes, at, space):
        n = len(space.items[item])
        check(t, item, p - n, p + n + n // 2 + 1, None, p - int(at[t]))
    return best


def search(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share, first_word of every contaminated text and its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        terms = pa.array(space.terms.words, pa.large_string())
        for batch in batches:
            for part in slices(batch):
                best = _found(part.column("text"), space, terms)
                if best:
                    docs_of = part.column("doc_id").to_pylist()
                    columns = zip(*((docs_of[t], space.ids[item], *v) for (t, item), v in best.items()), strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word"])

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return sent.mapInArrow(run, SCHEMA)


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose own texts hold no item: one pass, nothing is shuffled."""
    space = fit_space(docs, benchmark)
    if space is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        terms = pa.array(space.terms.words, pa.large_string())
        for batch in batches:
            for part in slices(batch):
                clean = np.ones(part.num_rows, bool)
                clean[[t for t, _ in _found(part.column("text"), space, terms)]] = False
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


SCHEMA = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    space = fit_space(docs, benchmark)
    return docs.sparkSession.createDataFrame([], SCHEMA) if space is None else search(docs, space)
