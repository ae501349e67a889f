"""One document of each group of near copies: 5-word shingles, Jaccard similarity of MIN_JACCARD or more, complete.

1. Texts are reduced to their sets of shingle hashes and a SimHash fingerprint, in one pass.
2. The fingerprints go through the byte-position index of ``simhash``: its links are verified on the whole sets. This
   joins most copies before anything is paired.
3. The rest is found by prefixes. In any fixed order of all shingles, two sets with a Jaccard similarity of 0.8 share
   one of the first ``n - ceil(0.8 n) + 1`` shingles of each. The order is: shingles that many texts hold last, then by
   hash; so a passage that many documents share makes no lists unless a text is made of such passages. Which shingles
   are frequent is counted in Spark and kept as a bit map of fixed size; any map gives a valid order, so it never decides.
4. The lists are worked off in three turns, each of which verifies pairs and merges what they join. First: all pairs of
   short lists, links to leaders in long ones (lists of frequent shingles are cut into SALTS parts). Second: one member
   for each group in a list, against the largest group. Third: all pairs of different groups in the long lists, in parts
   of PART members that Spark spreads. A pair leaves a part only if the parities of both sets allow MIN_JACCARD (a bound
   that no near pair fails), so texts that are made of one passage and are not near to each other make no rows. So every
   pair that shares a list is verified, excluded by that bound or inside a verified group, while a large group of copies
   is never paired with itself.

Pairs are verified on the sets alone (63 bits of each shingle's hash), by sorted intersections.

Defined results: exact copies (null and empty texts count as equal, by SHA-256) keep the row with the smallest doc_id;
texts without words are linked to their exact copies only, texts of fewer than 5 words have their whole sequence as one
shingle; rows with a null doc_id are kept; of fully repeated rows one is kept; texts that share a doc_id are documents
of their own; all columns are kept, whatever their names are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.cdc import bit_map, filtered, has_bit, of_ids
from tidemark.llm.common import apart, discard, free_units, materialize, slices
from tidemark.llm.components import connected_components

WORDS, MIN_JACCARD = 5, 0.8
#: A shingle in more texts is frequent; the share of the hashes that is counted (prefixes hold a fifth).
FREQUENT, COUNTED = 64, 0.25
SHORT_LIST, SALTS, PART = 16, 32, 2048
#: Half fingerprints of a long list that differ in so few bits are linked to one leader; others are left to the later turns.
LEADER_BITS = 8
#: Bits of a set's parities.
PARITIES = 1024
_HALF = (1 << 32) - 1
_TOP = np.uint64(1 << 63)
_ODD = np.random.default_rng(99).integers(0, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of WORDS words of all texts in a row, repeats included, and where each text starts (one
    more for the end). Words are parted by ASCII white space, A-Z are lower-cased."""
    import xxhash

    column = pc.fill_null(column.cast(pa.large_string()), "")
    for c in "\t\n\r\x0b\x0c":
        column = pc.replace_substring(column, c, " ")
    parts = pc.split_pattern(column, " ")
    coded = parts.values.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    words = [w.encode("utf-8", "surrogatepass") for w in pc.ascii_lower(coded.dictionary).to_numpy(zero_copy_only=False).tolist()]
    hashes = np.fromiter((digest(w) if w else 0 for w in words), np.uint64, len(words))
    held = np.fromiter(map(bool, words), bool, len(words))[codes := coded.indices.to_numpy()]
    flat = hashes[codes][held]
    bounds = np.concatenate(([0], np.cumsum(held)))[parts.offsets.to_numpy()]
    sizes = np.diff(bounds)
    mixed = np.zeros(max(len(flat) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        mixed += flat[k : k + len(mixed)] * _ODD[k]
    counts = np.maximum(sizes - WORDS + 1, sizes > 0)
    starts = np.concatenate(([0], np.cumsum(counts)))
    at = np.repeat(bounds[:-1] - starts[:-1], counts) + np.arange(starts[-1])
    out = np.zeros(starts[-1], np.uint64)
    whole = np.repeat(sizes >= WORDS, counts)
    out[whole] = mixed[at[whole]]
    for t in np.flatnonzero((sizes > 0) & (sizes < WORDS)).tolist():
        own = flat[bounds[t] : bounds[t + 1]]
        out[starts[t]] = (np.append(own, np.uint64(len(own))) * _ODD[[*range(len(own)), WORDS]]).sum()
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(29), starts


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes (63 bits) of the shingles."""
    return np.unique(shingles(pa.array([text]))[0] >> np.uint64(1))


def majority(hashes: np.ndarray) -> int:
    """A SimHash fingerprint: the bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def prefix_length(n: np.ndarray | int):
    return n - (4 * n + 4) // 5 + 1


def near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of distinct hashes have a Jaccard similarity of MIN_JACCARD or more."""
    a, b = len(x), len(y)
    if not a or not b or 5 * min(a, b) < 4 * max(a, b):
        return False
    both = np.sort(np.concatenate((x, y)))
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * (a + b)


def parities(x: np.ndarray) -> bytes:
    """For each of PARITIES cells whether an odd number of the set's hashes falls into it. Two sets' parities differ in
    no more cells than there are hashes in only one of the sets."""
    return np.packbits((np.bincount(x.view(np.int64) & (PARITIES - 1), minlength=PARITIES) & 1).astype(np.uint8)).tobytes()


def _parities_allow(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether parities (one row of words a set) allow MIN_JACCARD for sets of m and n hashes: at most a ninth of m + n
    may be in only one of them."""
    differ = np.zeros(len(x), np.int64)
    for k in range(x.shape[1]):
        differ += np.bitwise_count(x[:, k] ^ y[:, k])
    return 9 * differ <= m + n


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the text), text; rows with a doc_id only."""
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), "text")


def _frequent(rows: DataFrame, bits: np.ndarray) -> np.ndarray:
    """A bit map of the shingles that occur more than FREQUENT times, of those with a hash in the lowest COUNTED share."""
    bound = np.uint64(int(COUNTED * (1 << 63)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        for batch in batches:
            for part in slices(of_ids(batch, bits)):
                found = shingles(part.column("text"))[0] >> np.uint64(1)
                yield pa.RecordBatch.from_arrays([pa.array(found[found < bound].view(np.int64))], ["token"])

    counts = rows.select("doc_id", "text").mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return bit_map(materialize(counts.where(F.col("n") > FREQUENT).select("token"), "frequent"))


def _nodes(docs: DataFrame) -> DataFrame:
    """node, doc_id, digest, n, fp, tokens (the set in order, frequent ones with the top bit): one row per distinct
    text, and few of its copies, which the root (the digest's smallest node) joins."""
    keyed = _keyed(docs)
    least = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    bits = bit_map(materialize(least.select("doc_id"), "least"))
    frequent = _frequent(keyed, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        for batch in batches:
            for part in slices(of_ids(batch, bits)):
                hashes, at = shingles(part.column("text"))
                tokens = hashes >> np.uint64(1)
                tokens[has_bit(frequent, tokens.view(np.int64))] |= _TOP
                sets, prints = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    sets.append(np.unique(tokens[a:b]))
                    prints.append(majority(hashes[a:b]))
                columns = [
                    part.column("doc_id"), part.column("digest"), pa.array(list(map(len, sets)), pa.int64()), pa.array(np.asarray(prints, np.uint64).view(np.int64)),
                    pa.array([x.tobytes() for x in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n", "fp", "tokens"])

    made = keyed.mapInArrow(run, "doc_id long, digest binary, n long, fp long, tokens binary")
    return materialize(made.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _merged(names: DataFrame, links: DataFrame) -> DataFrame:
    """names(node, root) after the links (a, b) between roots; both tables are deleted if another takes their place."""
    if links.isEmpty():
        return names
    moved = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    out = materialize(names.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "names")
    discard(names, links)
    return out


def may_be_near(x: np.ndarray, y: np.ndarray, m: int, n: int) -> bool:
    """Whether the prefixes x, y of sets with m and n elements allow MIN_JACCARD: they hold all common elements up to the
    smaller of their last ones, behind which each set has only so many left."""
    if not len(x) or not len(y) or 5 * min(m, n) < 4 * max(m, n):
        return False
    both, last = np.sort(np.concatenate((x, y))), min(x[-1], y[-1])
    common = int((both[1:] == both[:-1]).sum())
    left = min(m - int(np.searchsorted(x, last, "right")), n - int(np.searchsorted(y, last, "right")))
    return 9 * (common + left) >= 4 * (m + n)


def _with_sets(nodes: DataFrame, pairs: DataFrame, prefix: bool) -> DataFrame:
    """The pairs with their sizes m, n and sets x, y (or the prefixes of these); only sets in use are moved."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sets = filtered(nodes.select("node", "n", "tokens"), bit_map(used), column="node")
    if prefix:
        sets = sets.withColumn("tokens", F.expr("substring(tokens, 1, CAST(8 * (n - (4 * n + 4) DIV 5 + 1) AS INT))"))
    left = apart(pairs).join(sets.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("tokens").alias("x")), "a")
    return apart(left).join(sets.select(F.col("node").alias("b"), "n", F.col("tokens").alias("y")), "b")


def _verified(nodes: DataFrame, names: DataFrame, pairs: DataFrame) -> DataFrame:
    """The different roots (a, b) of the near pairs: first by the bound that the prefixes give, then on the whole sets."""

    def test(of: Callable, *kept: str) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            free_units()
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("x", "y", "m", "n")), strict=True)
                ok = [of(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), m, n) for x, y, m, n in rows]
                yield batch.select(list(kept)).filter(pa.array(ok, pa.bool_()))

        return run

    rooted = pairs.join(names.select(F.col("node").alias("a"), F.col("root").alias("p")), "a").join(names.select(F.col("node").alias("b"), F.col("root").alias("q")), "b")
    tried = materialize(rooted.where("p != q").select("a", "b", "p", "q"), "pairs")
    possible = materialize(_with_sets(nodes, tried, True).mapInArrow(test(may_be_near, "a", "b", "p", "q"), "a long, b long, p long, q long"), "possible")
    near_roots = _with_sets(nodes, possible, False).mapInArrow(test(lambda x, y, m, n: near(x, y), "p", "q"), "p long, q long")
    links = materialize(near_roots.select(F.col("p").alias("a"), F.col("q").alias("b")), "links")
    discard(tried, possible)
    return links


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """The links of the byte-position index, and nodes with the same fingerprint, as pairs of nodes."""
    own = nodes.where("n > 0").select("node", "fp")
    first = materialize(own.groupBy("fp").agg(F.min("node").alias("b")), "prints")
    same = own.join(first, "fp").select(F.col("node").alias("a"), "b")
    links = simhash.links(first.select("fp"))
    apart = links.join(first.select(F.col("fp").alias("a"), F.col("b").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("b").alias("y")), "b")
    return same.union(apart.select("x", "y")).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _lists(nodes: DataFrame, bits: np.ndarray | None = None, with_parities: bool = False) -> DataFrame:
    """token, node, meta: a row for each shingle of a prefix (with its bit set); meta: half of the fingerprint, and the
    set's size in the 32 bits above it. ``with_parities``: the set's parities, too."""
    names, kinds = ["token", "node", "meta"], "token long, node long, meta long"
    if with_parities:
        names, kinds = [*names, "parities"], f"{kinds}, parities binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        for batch in batches:
            sets = [np.frombuffer(x, np.int64) for x in batch.column("tokens").to_pylist()]
            firsts = [x[: prefix_length(len(x))] for x in sets]
            if bits is not None:
                firsts = [x[has_bit(bits, x)] for x in firsts]
            row = pa.array(np.repeat(np.arange(len(firsts)), list(map(len, firsts))))
            meta = batch.column("fp").to_numpy() & _HALF | batch.column("n").to_numpy() << 32
            columns = [pa.array(np.concatenate(firsts)), batch.column("node").take(row), pa.array(meta).take(row)]
            if with_parities:
                columns.append(pa.array([parities(x) if len(own) else None for x, own in zip(sets, firsts, strict=True)], pa.binary()).take(row))
            yield pa.RecordBatch.from_arrays(columns, names)

    return nodes.where("n > 0").select("node", "n", "fp", "tokens").mapInArrow(run, kinds)


def _sizes_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sizes in two metas allow MIN_JACCARD."""
    m, n = x >> 32, y >> 32
    return 5 * np.minimum(m, n) >= 4 * np.maximum(m, n)


def _grouped(names: list[str], of: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]) -> Callable:
    """For rows sorted by the first column: ``of`` on whole groups of rows at a time, each column an array."""

    def values(column: pa.Array) -> np.ndarray:
        if pa.types.is_binary(column.type):  # all of one length: a row of words each
            return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)
        return column.to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        held: list[np.ndarray] = []
        for batch in batches:
            if not len(batch):
                continue
            own = [values(batch.column(c)) for c in names]
            held = [np.concatenate(x) for x in zip(held, own, strict=True)] if held else own
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield from made(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held:
            yield from made(*held)

    def made(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in of(*columns):
            if len(a):
                found = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def _cuts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(keys)])))


def _first_turn(key: np.ndarray, node: np.ndarray, meta: np.ndarray, token: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a short list; links to leaders in a long one, and its token (as a pair with itself)."""
    starts, sizes = _cuts(key)
    fp = meta & _HALF
    for step in range(1, SHORT_LIST):  # members ``step`` apart
        ok = np.flatnonzero(np.repeat((sizes > step) & (sizes <= SHORT_LIST), sizes))
        ok = ok[ok + step < len(key)]
        if not len(ok):
            break
        ok = ok[(key[ok] == key[ok + step]) & _sizes_fit(meta[ok], meta[ok + step])]
        yield node[ok], node[ok + step]
    yield token[starts[sizes > SHORT_LIST]], token[starts[sizes > SHORT_LIST]]
    for k, size in zip(starts[sizes > SHORT_LIST].tolist(), sizes[sizes > SHORT_LIST].tolist(), strict=True):
        own = np.arange(k, k + size)
        own = own[np.argsort(node[own].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))]  # the same leaders in all lists
        while len(own) > 1:
            close = np.bitwise_count(fp[own] ^ fp[own[0]]) <= LEADER_BITS
            linked = own[1:][close[1:] & _sizes_fit(meta[own[1:]], meta[own[0]])]
            yield np.full(len(linked), node[own[0]]), node[linked]
            own = own[~close]


def _all_pairs(key: np.ndarray, node: np.ndarray, meta: np.ndarray, side: np.ndarray, root: np.ndarray, odd: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different roots of both sides (0 and 1), or of all rows (2), of each key, that their parities allow."""
    starts, sizes = _cuts(key)
    size_of = meta >> 32
    for k, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        all_ = slice(k, k + size)
        for at in range(k, k + size, 128):
            own = slice(at, min(at + 128, k + size))
            ok = (root[own, None] != root[None, all_]) & (node[own, None] < node[None, all_]) & _sizes_fit(meta[own, None], meta[None, all_])
            ok &= (side[own, None] != side[None, all_]) | (side[own, None] == 2)
            x, y = np.nonzero(ok)
            x, y = x + at, y + k
            for words in (slice(0, 4), slice(None)):  # a part of the cells leaves out most pairs
                kept = _parities_allow(odd[x, words], odd[y, words], size_of[x], size_of[y])
                x, y = x[kept], y[kept]
            yield node[x], node[y]


def _from_lists(rows: DataFrame, names: list[str], of: Callable) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").select("key", *names).mapInArrow(_grouped(["key", *names], of), "a long, b long").distinct()


def _leader_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: pairs of nodes; a = b: the token of a long list. Lists of frequent shingles are cut into parts."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    rows = _lists(nodes).withColumn("key", F.when(F.col("token") < 0, F.xxhash64("token", salt)).otherwise(F.col("token")))
    return _from_lists(rows, ["node", "meta", "token"], _first_turn)


def _long_lists(nodes: DataFrame, names: DataFrame, tokens: DataFrame, with_parities: bool = False) -> DataFrame:
    """token, node, root of the lists in tokens (and few others, whose pairs are found once more)."""
    return _lists(nodes, bit_map(tokens.select("token")), with_parities).join(names, "node")


def _members(lists: DataFrame) -> DataFrame:
    """token, root, m, node: the groups in a list, with their numbers of members and one of these."""
    return materialize(lists.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"), F.min_by("node", F.xxhash64("token", "node")).alias("node")), "members")


def _open(members: DataFrame) -> DataFrame:
    """token, members: the lists that hold several groups."""
    return materialize(members.groupBy("token").agg(F.sum("m").alias("members"), F.count(F.lit(1)).alias("_r")).where("_r > 1").select("token", "members"), "open")


def _group_pairs(members: DataFrame) -> DataFrame:
    """One member for each root in a list, against that of the root with most members."""
    largest = members.groupBy("token").agg(F.max(F.struct("m", "root", "node")).alias("_l"))
    pairs = members.join(largest, "token").where("root != _l.root").select(F.least("node", "_l.node").alias("a"), F.greatest("node", "_l.node").alias("b"))
    return pairs.distinct()


def _rest(lists: DataFrame, tokens: DataFrame) -> DataFrame:
    """All pairs of different roots: each list in parts of PART members, each two parts a group of their own."""
    rows = lists.join(tokens.select("token", F.ceil(F.col("members") / PART).cast("int").alias("_n")), "token").withColumn("_p", F.pmod(F.xxhash64("node"), "_n").cast("int"))
    rows = rows.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = F.when(F.col("_p") == F.col("_q"), 2).when(F.col("_p") < F.col("_q"), 0).otherwise(1).cast("long")
    rows = rows.withColumn("side", side).withColumn("key", F.xxhash64("token", F.least("_p", "_q"), F.greatest("_p", "_q")))
    return _from_lists(rows, ["node", "meta", "side", "root", "parities"], _all_pairs)


def groups(docs: DataFrame) -> DataFrame:
    """node, doc_id, digest, root: the group (a linked node) of every distinct text."""
    nodes = _nodes(docs)
    least = nodes.groupBy("digest").agg(F.min("node").alias("root"))
    names = materialize(nodes.select("node", "digest").join(least, "digest").select("node", "root"), "names")
    names = _merged(names, _verified(nodes, names, _fingerprint_pairs(nodes)))
    listed = materialize(_leader_pairs(nodes), "found")
    names = _merged(names, _verified(nodes, names, listed.where("a != b")))
    long = listed.where("a = b").select(F.col("a").alias("token"))
    if not long.isEmpty():
        members = _members(_long_lists(nodes, names, long))
        names = _merged(names, _verified(nodes, names, _group_pairs(members)))
        open_ = _open(_members(_long_lists(nodes, names, _open(members))))
        if not open_.isEmpty():
            names = _merged(names, _verified(nodes, names, _rest(_long_lists(nodes, names, open_, True), open_)))
    found = materialize(nodes.select("node", "doc_id", "digest").join(names, "node"), "groups")
    discard(nodes, names, listed)
    return found


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each group the row with the smallest doc_id stays.

    Rows that surely stay are passed on in one pass; those whose doc_id is in a bit map of the others (at any size a
    superset) are joined exactly.
    """
    found = groups(docs)
    kept = materialize(found.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("_k")).select("_k.*"), "kept")
    ids = _keyed(docs).select("doc_id", "digest").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("_n"))
    staying = kept.select("doc_id", "digest", F.lit(True).alias("_there"))
    doubtful = ids.join(staying, ["doc_id", "digest"], "left").where("_n > 1 or _there is null").select("doc_id")
    bits = bit_map(materialize(doubtful, "doubtful"))
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held)
    sure = filtered(rows, bits, with_bit=False).select("row.*")
    digest = F.unhex(F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256))
    other = filtered(rows, bits).withColumn("digest", digest).join(staying, ["doc_id", "digest"])
    one = Window.partitionBy("doc_id", "digest").orderBy(F.lit(1))
    single = other.withColumn("_at", F.row_number().over(one)).where("_at = 1").select("row.*")
    return sure.unionByName(single)
