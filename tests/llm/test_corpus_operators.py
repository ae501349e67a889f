"""Brute-force versions, round trips, held-out accuracy and odd inputs of the corpus operators."""

from __future__ import annotations

import collections
import hashlib
import html
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import cdc, chat, decontam, html_tree, near_copies, packing, qda, queries, ring, rules, simhash, token_output
from tidemark.llm.common import work_path
from tidemark.llm.tokens import UnitEncoder, vocabulary_path

BYTES, WORDS = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a", " a b ", "a  b", "x\n\ny", "tab\tand\x0b", "Ünïcödé ς ΑΣ é", "<|endoftext|> </s>[INST]", "the the the the", "don't 123 !!!", "a\x1cb c"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot int, shard string"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", 0, 1, "x") for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and odd texts, repeated rows, a null doc_id, a long text, columns with clashing names."""
    texts = [*ODD, "the the the the", "lorem ipsum dolor sit amet " * 3000]
    rows = docs_of(spark, [*texts, texts[4], "no id"], [*range(len(texts)), 4, None])
    return rows.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def reference(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize(("path", "keeps"), [(BYTES, True), (WORDS, False)])
def test_units_give_the_texts_ids(path, keeps, small):
    texts = [*ODD, *pd.read_parquet(f"{small}/documents.parquet").text[:60]]
    ids, at = UnitEncoder(path, keeps).encode(pa.array(texts, pa.string()))
    plain = reference(path)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


_CODERS: dict[str, UnitEncoder] = {}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab.', \n\té<|>1\x01\r", max_size=30), max_size=5))
def test_units_on_any_text(texts):
    coder = _CODERS.setdefault("bytes", UnitEncoder(BYTES, True)) if "bytes" not in _CODERS else _CODERS["bytes"]
    ids, at = coder.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == coder.plain.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aBs.,'\u2019\u0301 \n$7\x01É", max_size=30), max_size=5))
def test_units_on_any_text_uncased(texts):
    coder = _CODERS.setdefault("words", UnitEncoder(WORDS, False)) if "words" not in _CODERS else _CODERS["words"]
    ids, at = coder.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == coder.plain.encode(t, add_special_tokens=False).ids


def test_op1_round_trip(spark, odd, empty):
    path = work_path(spark, "t")
    token_output.write_tokens(odd, path, WORDS, end_id=2)
    got = token_output.read_tokens(spark, path, with_ids=True).toPandas().sort_values(["start"]).reset_index(drop=True)
    plain = reference(WORDS)
    rows = sorted(((r.doc_id, plain.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(rows) and got.start.tolist() == np.concatenate(([0], np.cumsum([len(x) for _, x in rows])[:-1])).tolist()
    assert collections.Counter((None if pd.isna(d) else int(d), tuple(i)) for d, i in zip(got.doc_id, got.ids, strict=True)) == collections.Counter((d, tuple(i)) for d, i in rows)
    found = token_output.lookup(spark, path, spark.createDataFrame([(9,), (9,), (999,), (None,)], "doc_id long")).collect()
    assert [(r.doc_id, r.ids) for r in found] == [(9, dict(rows)[9])]
    other = work_path(spark, "t")
    token_output.write_tokens(empty, other, WORDS, end_id=2)
    assert token_output.read_tokens(spark, other).count() == 0


def test_op1_damaged_frame_is_noticed(tmp_path):
    with open(tmp_path / "x", "wb") as f:
        w = token_output.FrameWriter(f)
        w.add(1, np.arange(50, dtype=np.uint32))
        w.add(2, np.arange(9, dtype=np.uint32))
        w.close()
    raw = bytearray((tmp_path / "x").read_bytes())
    import io

    r = token_output.FrameReader(io.BytesIO(raw), len(raw))
    assert r.docs == [1, 2] and r.ids(1).tolist() == list(range(9))
    raw[12] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017
        token_output.FrameReader(io.BytesIO(raw), len(raw)).ids(0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "\\", "s>", "</s>", "[INST]", "[", "/INST]", "<|turn|>", "<|", "end|>", "a", "<<SYS>>"]), max_size=12).map("".join))
def test_op2_escape_is_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


def test_op2_conversations(spark):
    rows = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", "</s>[INST] ok"), (1, 1, "assistant", "again"), (2, 0, None, None), (None, 3, "assistant", "x\ny"), (3, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(turns, BYTES), BYTES).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ties = (["</s>[INST] ok", "again"], ["again", "</s>[INST] ok"])  # ordered by a hash of the text
    assert (got[1].turns_sha256, got[1].loss_sha256, got[1].n_turns) in [(sha("user\nhi <s>\n" + "".join(f"assistant\n{x}\n" for x in t)), sha("".join(t)), 3) for t in ties]
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0
    assert got[None].loss_sha256 == sha("x\ny") and got[3].loss_sha256 == sha("")
    assert chat.digests(chat.format_chats(turns.where("false"), BYTES), BYTES).count() == 0
    ids = chat.format_chats(turns.where("conv_id = 1"), BYTES).first().input_ids
    assert chat.unescape(chat.render(ids, BYTES)).startswith("<|turn|>user<|body|>hi <s><|end|>")


def test_op3_against_all_windows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    local = docs.toPandas().sort_values("doc_id")
    first, want = {}, collections.defaultdict(set)
    for i, t in zip(local.doc_id, local.text, strict=True):
        w = t.split()
        for j in range(len(w) - 49):
            if first.setdefault(" ".join(w[j : j + 50]), i) != i:
                want[i].update(range(j, j + 50))
    found = cdc.repeated_passages(docs)
    texts, got = dict(zip(local.doc_id, local.text, strict=True)), collections.defaultdict(set)
    for r in found.collect():
        at = len(texts[r.doc_id][: r.start_char].split())
        assert len(texts[r.doc_id][r.start_char : r.end_char].split()) == r.n_words >= 50 and r.first_doc_id < r.doc_id
        got[r.doc_id].update(range(at, at + r.n_words))
    assert got == want
    left = dict(cdc.remove_passages(docs, found).select("doc_id", "text").collect())
    assert all(left[i] == t for i, t in texts.items() if i not in got) and all(len(left[i]) < len(texts[i]) for i in got)


def windows_brute(texts):
    first, want = {}, collections.defaultdict(set)
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - 49):
            if first.setdefault(" ".join(w[j : j + 50]), i) != i:
                want[i].update(range(j, j + 50))
    return want


def test_op3_pieces_short_words_and_periods(spark):
    """Passages of 50 to 70 words whose pieces stand in earlier documents, words of 1 to 8 letters, periodic text, edited families."""
    rng = np.random.default_rng(6)
    texts = []
    for length in range(1, 9):
        word = lambda n: ["".join(rng.choice(list("abcdefghijklmnop"), length)) for _ in range(n)]  # noqa: B023, E731
        for _ in range(12):
            p = word(int(rng.integers(50, 70)))
            for _ in range(4):  # pieces, before the passage itself
                a = int(rng.integers(0, len(p) - 30))
                texts.append(word(15) + p[a : a + 30] + word(15))
            texts.append(word(9) + p[:25] + word(1) + p[26:] + word(12))  # a word changed
            texts.append(word(int(rng.integers(0, 30))) + p + word(20))
            texts.append(word(int(rng.integers(0, 30))) + p + word(20))
    for period in (1, 2, 3, 5, 7):
        unit = word(period)
        texts += [unit * (80 // period), word(3) + unit * (130 // period) + word(2)]
    texts += [texts[5] + texts[6], texts[6] + texts[5]]
    texts = [" ".join(t) for t in texts]
    got, want = collections.defaultdict(set), windows_brute(texts)
    for r in cdc.repeated_passages(docs_of(spark, texts)).collect():
        at = len(texts[r.doc_id][: r.start_char].split())
        got[r.doc_id].update(range(at, at + r.n_words))
        own, held = texts[r.doc_id][r.start_char : r.end_char].split(), " ".join(texts[r.first_doc_id].split())
        assert len(own) == r.n_words and all(" ".join(own[k : k + 50]) in held for k in range(len(own) - 49))
    assert got == want


def test_op3_keeps_columns_of_any_name(spark):
    text = " ".join(f"é{k}" for k in range(60))
    rows = [(1, text, 7, 8, 9), (2, f"a {text} b", 1, 2, 3), (None, text, 4, 5, 6), (2, "other text", 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _k int, key int, c0 int")
    out = cdc.remove_passages(docs, cdc.repeated_passages(docs))
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(str(r) for r in docs.withColumn("text", F.when(F.col("_k") == 1, "a  b").otherwise(F.col("text"))).collect())


def test_op3_shift_and_odd_inputs(spark, odd, empty):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage, short = word(60), word(30)
    docs = docs_of(spark, [f"{word(40)} {passage} {word(9)}", f"{word(13)} {passage}", f"{word(20)} {short} {word(7)}", f"{short} {word(50)}"])
    got = cdc.repeated_passages(docs).collect()
    assert [(r.doc_id, r.first_doc_id, r.n_words) for r in got] == [(1, 0, 60)]
    assert cdc.repeated_passages(odd).count() >= 0 and cdc.repeated_passages(empty).count() == 0
    assert sorted(cdc.remove_passages(odd, cdc.repeated_passages(odd)).columns) == sorted(odd.columns)


def test_op4_finds_copies_and_paraphrases(spark, small, empty):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    local = bench.toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    item = local.text[0].split()
    changed = " ".join("zzz" if k % 6 == 2 else w for k, w in enumerate(item[:-8])) + " " + " ".join(item[-8:])
    planted = spark.createDataFrame([(10_000, f"one two three {local.text[1]} four five"), (10_001, f"start here {changed} and so on")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs.unionByName(planted), bench).collect()}
    assert got[10_000, local.item_id[1]].lcs_share == 1.0 and got[10_001, local.item_id[0]].lcs_share < 1.0
    texts = [" ".join(map(decontam.bare, t.split())) for t in docs.toPandas().text]
    exact = {(d, i) for d, t in zip(docs.toPandas().doc_id, texts, strict=True) for i, b in zip(local.item_id, local.text, strict=True) if " ".join(map(decontam.bare, b.split())) in t}
    assert exact <= set(got) and all(r.lcs_share >= decontam.PARAPHRASE for r in got.values())
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(docs, bench.where("false")).count() == 0


def test_op4_odd_inputs(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "the the the the")], "item_id long, text string")
    assert decontam.contaminated(odd, bench).count() >= 0


def random_items(seed, n, words=37):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, 4000, words)) for _ in range(n)]


def test_op4_small_and_hot_tables(spark):
    items = random_items(21, 3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    few = docs_of(spark, [f"one two {items[0]} three", items[1], "nothing here"])
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(few, bench).collect()) == [(0, 0), (1, 1)]
    texts = [f"{f} {items[0] if k % 3 == 0 else items[1] if k == 100 else ''} {f}" for k, f in enumerate(random_items(22, 300, 20))]
    want = {(k, 0) for k in range(0, 300, 3)} | {(100, 1)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(spark, texts), bench).collect()} == want


def test_op4_many_items(spark):
    items = random_items(23, 1500)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    around = random_items(24, 300, 30)
    docs = docs_of(spark, [f"{around[k]} {items[5 * k]} {around[-k]}" for k in range(300)])
    got = {r.doc_id: r for r in decontam.contaminated(docs, bench).collect() if r.lcs_share == 1.0}
    assert {(r.doc_id, r.item_id) for r in got.values()} == {(k, 5 * k) for k in range(300)}
    assert sum(r.cosine is not None for r in got.values()) >= 290


def test_op4_forms_of_words(spark):
    items = [" ".join(w.capitalize() + "X" for w in t.split()) for t in random_items(25, 3)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    forms = ["({})", '"{}."', "*{}*", "[{}],", "{}", "- {}"]
    texts = [" ".join(forms[k % 6].format(w) for k, w in enumerate(items[0].split())), "\xa0".join(items[1].split()), "\u2003\x1c".join(items[2].swapcase().split()), None, "- *"]
    got = {(r.doc_id, r.item_id): r.lcs_share for r in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0}


def components(fps):
    fps = np.asarray(fps, np.uint64)
    near, labels = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, np.arange(len(fps))
    while True:
        least = np.where(near, labels[None, :], len(fps)).min(1)
        if (least == labels).all():
            return labels
        labels = least


def test_op5_against_brute_force(spark, odd, empty):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(list("abcdefghij"), 40)) for _ in range(60)]
    texts = base + [b + " k" for b in base[:20]] + base[:5] + [t for t in ODD]
    got = simhash.near_duplicates(docs_of(spark, texts)).toPandas().set_index("doc_id").sort_index()

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for t in texts]
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps] and got.component_id.tolist() == components(fps).tolist()
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(empty).count() == 0


def test_op5_large_lists_and_chains():
    rng = np.random.default_rng(2)
    fps = np.unique(np.uint64(0xABCDEF0000000000) | rng.integers(0, 1 << 20, 1500, dtype=np.uint64))
    assert (simhash.local_roots(fps) == components(fps)).all()


def test_op5_long_lists_of_four_bytes():
    rng = np.random.default_rng(7)
    base = np.uint64(0x1234567800000000)
    fps = base | rng.integers(0, 1 << 32, 2500, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(32, int(rng.integers(1, 4)), replace=False)) for _ in range(1500)], np.uint64)
    fps = np.unique(np.concatenate((fps, fps[:1500] ^ flips)))
    assert (simhash.local_roots(fps) == components(fps)).all()


def test_near_copies_keep_one(spark, odd):
    rng = np.random.default_rng(4)
    base = [[f"w{rng.integers(0, 5000)}" for _ in range(300)] for _ in range(12)]
    texts, groups = [], []
    for g, b in enumerate(base):
        for k in range(40 if g == 0 else 3):
            w = list(b)
            if k:
                w[int(rng.integers(0, 300))] = f"x{k}"
            texts.append(" ".join(w))
            groups.append(g)
    kept = sorted(r.doc_id for r in near_copies.keep_one(docs_of(spark, texts)).select("doc_id").collect())
    assert kept == [groups.index(g) for g in range(len(base))]
    ids = [r.doc_id for r in near_copies.keep_one(odd).select("doc_id").collect()]
    assert ids.count(4) == 1 and None in ids and 0 in ids and 1 not in ids


def linked_brute(texts):
    """Components of all pairs of texts with a Jaccard similarity of 0.8 or more."""
    sets = [near_copies.shingle_set(t).tolist() for t in texts]
    place = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(texts), len(place)), np.float32)
    for k, own in enumerate(sets):
        m[k, [place[x] for x in own]] = 1
    both, n = m @ m.T, m.sum(1)
    near = 5 * both >= 4 * (n[:, None] + n[None, :] - both)
    labels = np.arange(len(texts))
    while True:
        least = np.where(near, labels[None, :], len(texts)).min(1)
        if (least == labels).all():
            return labels
        labels = least


def edited(rng, words, at, n):
    out = list(words)
    for k in at:
        out[k] = f"x{rng.integers(0, 1 << 40)}"
    assert len(at) == n
    return out


def test_near_copies_of_one_original_edited_apart(spark):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(15):
        base = [f"w{rng.integers(0, 1 << 30)}" for _ in range(300)]
        slots = rng.permutation(np.arange(5, 295, 6))[:32].reshape(8, 4)
        texts += [" ".join(base), *(" ".join(edited(rng, base, s, 4)) for s in slots)]
    kept = sorted(r.doc_id for r in near_copies.keep_one(docs_of(spark, texts)).select("doc_id").collect())
    labels = linked_brute(texts)
    assert kept == sorted(set(labels.tolist())) and len(kept) < 25


def test_near_copies_in_long_lists(spark):
    rng = np.random.default_rng(12)
    base = [f"w{rng.integers(0, 1 << 30)}" for _ in range(120)]
    texts = []
    for _ in range(350):  # related texts (about 0.7), each with one near copy
        own = edited(rng, base, rng.choice(np.arange(5, 115, 6), 2, replace=False), 2)
        texts += [" ".join(own), " ".join([*own[:-2], "y", f"z{rng.integers(0, 1 << 30)}"])]
    kept = sorted(r.doc_id for r in near_copies.keep_one(docs_of(spark, texts)).select("doc_id").collect())
    assert kept == sorted(set(linked_brute(texts).tolist()))


def test_near_copies_pair_no_texts_that_their_parities_exclude(spark, monkeypatch):
    base = [f"w{k}" for k in range(44)]
    texts = [" ".join(base[: 8 + k % 30] + [f"own{k}"] + base[9 + k % 30 :]) for k in range(300)]  # 0.78 between any two, 0.78 to the base
    counts, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda nodes, names, pairs: (counts.append(pairs.count()), verified(nodes, names, pairs))[1])
    kept = near_copies.keep_one(docs_of(spark, texts)).count()
    sets = [near_copies.shingle_set(t) for t in texts]
    assert len(counts) == 4 and counts[3] < 3000, counts  # the last turn; half of the square is 44,850
    labels = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near_copies.near(sets[i], sets[j]) and labels[i] != labels[j]:
                labels = [labels[i] if x == labels[j] else x for x in labels]
    assert kept == len(set(labels))


def test_near_copies_leave_no_table_of_sets_behind(spark):
    from pathlib import Path

    folder = Path(work_path(spark, "x").removeprefix("file:")).parent
    there = set(folder.glob("*")) if folder.exists() else set()
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words[:k] + [f"own{k}"] + words[k:]) for k in range(30)] + ["another text of six words only"]
    assert near_copies.keep_one(docs_of(spark, texts)).count() == 2
    left = collections.Counter(p.name.split("-")[0] for p in set(folder.glob("*")) - there)
    assert left["groups"] == 1 and not left["nodes"] and not left["names"] and left["edges"] <= 3, left  # one table of edges for each merge


def test_components_in_two_shuffles_a_round(spark):
    from tidemark.llm.components import _large_star, _small_star, connected_components

    rng = np.random.default_rng(3)
    edges = [(0, k) for k in range(100, 180)] + [(k, k + 1) for k in range(200, 260)] + [tuple(map(int, rng.integers(300, 500, 2))) for _ in range(120)]
    edges = [*edges, *edges[::-3], *[(b, a) for a, b in edges[::5]], (7, 7)]
    table = spark.createDataFrame(edges, "a long, b long")
    root = {n: n for e in edges for n in e if e != (7, 7)}
    while (least := {n: min([root[n], *[root[b if n == a else a] for a, b in edges if n in (a, b)]]) for n in root}) != root:
        root = least
    linked = {n for e in edges if e[0] != e[1] for n in e}
    assert sorted(map(tuple, connected_components(table).collect())) == sorted((n, r) for n, r in root.items() if n in linked)
    plan = _small_star(_large_star(table.where("a > b")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_bit_map_holds_every_id_in_one_shuffle(spark, monkeypatch):
    ids = spark.range(0, 60000, 7).select("id").union(spark.range(0, 20000).select(F.lit(5).cast("long")))
    bits = cdc.bit_map(ids)
    assert cdc.has_bit(bits, np.arange(0, 60000, 7)).all() and cdc.has_bit(bits, np.array([5])).all()
    assert np.unpackbits(bits).sum() == len(np.unique(cdc._mixed(np.append(np.arange(0, 60000, 7), 5))))
    made = []
    monkeypatch.setattr(type(ids), "collect", lambda self, f=type(ids).collect: (made.append(self), f(self))[1])
    cdc.bit_map(ids)
    assert made[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_decontamination_fits_its_space_to_all_passages(spark):
    word = lambda x: F.concat(F.lit("w"), F.pmod(F.hash("doc_id", x), F.lit(100)))
    docs = spark.range(4000).withColumnRenamed("id", "doc_id").withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1728)), word), " "))
    assert docs.agg(F.sum(F.octet_length("text"))).first()[0] > 16_000_000
    counts, n, passages = decontam._first_pass(docs, decontam.Terms([f"w{k}" for k in range(100)]))
    assert n == passages.count() == 4000 * 27 and counts.min() > 0


def test_decontamination_reads_the_passages_once_for_all_products(spark, monkeypatch):
    items = random_items(41, 600, 12)  # three spaces, of two products each
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    around = random_items(42, 120, 50)
    docs = docs_of(spark, [f"{around[k]} {items[5 * k]} {items[5 * k]} other {around[-k]}" for k in range(120)])
    rows = lambda: {(r.doc_id, r.item_id): (r.cosine, r.lcs_share, r.first_word) for r in decontam.contaminated(docs, bench).collect()}
    passes, times = [], decontam._gram_times
    monkeypatch.setattr(decontam, "_gram_times", lambda *args: passes.append(args) or times(*args))
    found = rows()
    assert not passes and {(k, 5 * k) for k in range(120)} <= set(found)
    monkeypatch.setattr(decontam, "GRAM_TERMS", 0)
    again = rows()
    assert len(passes) == 6 and set(again) == set(found)
    for key, (cosine, *others) in again.items():
        assert others == list(found[key][1:]) and (cosine == found[key][0] or abs(cosine - found[key][0]) < 1e-4)


def test_decontamination_pairs_of_terms_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "GRAM_PASSAGES", 7)
    words = [f"w{k}" for k in range(300)]  # more than the rows of one batch; some stand in no text
    rng = np.random.default_rng(43)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, n) if x < 400) for n in (0, 1, 3, 64, 65, 200, 1000)] + [None, "other words", "w7 " * 70]
    counts, n, passages = decontam._first_pass(docs_of(spark, texts).repartition(5), decontam.Terms(words))
    idf, q = rng.random(300) + 0.5, rng.standard_normal((300, 11)).astype(np.float32)
    rows = [np.array(r.codes) for r in passages.collect()]
    a = np.zeros((len(rows), 300))
    for row, codes in zip(a, rows, strict=True):
        np.add.at(row, codes[codes >= 0], idf[codes[codes >= 0]])
        row /= np.sqrt((np.where(codes >= 0, idf[codes], 1.5) ** 2).sum())
    assert n == len(rows) > 14 and (counts == (a > 0).sum(0)).all()
    want, gram = a.T @ (a @ q), decontam._gram(passages, counts, n, idf, 1.5)
    assert np.abs(decontam._triangle_times(gram, counts, q) - want).max() < 1e-4 * np.abs(want).max()
    assert np.abs(decontam._gram_times(passages, idf, 1.5, q) - want).max() < 1e-4 * np.abs(want).max()


def test_parities_exclude_no_near_pair():
    rng = np.random.default_rng(5)
    for n in (1, 5, 40, 300, 3000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            cut = int(rng.integers(0, n // 4 + 1))
            y = np.unique(np.concatenate((x[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64))))
            words = [np.frombuffer(near_copies.parities(s), np.uint64)[None] for s in (x, y)]
            if near_copies.near(x, y):
                assert near_copies._parities_allow(*words, np.array([len(x)]), np.array([len(y)]))[0]


def test_near_copies_find_every_pair(spark):
    """Pairs at 0.75 to 0.9, families edited apart, a passage in a third of the texts, texts of that passage only, short texts, copies."""
    rng = np.random.default_rng(14)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    common, texts = word(70), []
    for k in range(150):
        own = word(int(rng.integers(60, 200)))
        if k % 3 == 0:
            own = own[:20] + common + own[20:]
        texts.append(" ".join(own))
        n = int(len(own) * rng.uniform(0.015, 0.06))  # a word stands in 5 shingles
        texts.append(" ".join(edited(rng, own, at := rng.choice(len(own), n, replace=False), len(at))))
    for _ in range(120):
        n = int(rng.integers(0, 4))
        texts.append(" ".join(edited(rng, common, rng.choice(70, n, replace=False), n)))
    texts += [" ".join(word(n)) for n in (1, 2, 4, 5, 6)] + ["", " ", "a b", "A B", texts[0], texts[0]]
    rng.shuffle(texts)
    labels = linked_brute([t or "" for t in texts])
    first = {t: k for k, t in reversed(list(enumerate(texts)))}
    want = sorted({min(j for j in range(len(texts)) if labels[j] == labels[k]) if near_copies.shingle_set(t).size else first[t] for k, t in enumerate(texts)})
    kept = near_copies.keep_one(docs_of(spark, texts)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == want


def test_near_copies_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g", 7, 8, "x", 9), (2, "a b c d e f g", 1, 2, "y", 3), (None, "a", 4, 5, "z", 6), (3, None, 0, 0, None, 0), (3, None, 0, 0, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n int, _k int, root string, row int")
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(str(r) for k, r in enumerate(docs.collect()) if k not in (1, 4))


def brute_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\t", max_size=120))
def test_op6_measures(text):
    m = dict(zip(rules.MEASURES, rules.measure(text), strict=True))
    assert tuple(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_measures(text)


def test_op6_ledger_and_ablation(spark, odd, empty, small):
    rows = rules.ledger(spark.read.parquet(f"{small}/documents.parquet")).cache()
    local = rows.toPandas()
    got = {r.rule: r for r in rules.ablation(rows, rules.POLICIES["v1"]).collect()}
    for name, bit in rules.BIT.items():
        if name in got:
            assert got[name].n_failed == ((local.failed & bit) != 0).sum() and got[name].n_only == (local.failed == bit).sum() and got[name].n_kept_without == ((local.failed & ~bit) == 0).sum()
    assert rules.ledger(odd).where("doc_id = 0").first().failed & rules.BIT["too_few_words"] and rules.ledger(empty).count() == 0


def check_packing(pieces, capacity):
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= capacity


def test_op7_packs_everything(spark, odd, empty, small):
    plain = reference(BYTES)
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet").limit(120)):
        got = packing.pack(docs, BYTES, 0, 256).toPandas()
        check_packing(got, 256)
        want = collections.Counter()
        for r in docs.collect():
            ids = np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
            start, end = 0, (len(ids) - 1) % 256 + 1
            while start < len(ids):
                want[(r.doc_id, start, end - start, zlib.crc32(ids[start:end].tobytes()))] += 1
                start, end = end, end + 256
        assert collections.Counter((None if pd.isna(x.doc_id) else int(x.doc_id), x.start, x.length, x.ids_crc32) for x in got.itertuples()) == want
    assert packing.pack(empty, BYTES, 0).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
def test_op7_plan(counts):
    histogram = np.zeros(65, np.int64)
    for n, c in counts.items():
        histogram[n] = c
    used = np.zeros(65, np.int64)
    for lengths, times in packing.plan_patterns(histogram):
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            used[n] += times
    assert (used == histogram).all()


def test_op7_is_near_the_bound():
    rng = np.random.default_rng(0)
    histogram = np.bincount(np.minimum(2048, rng.lognormal(6, 1, 50_000).astype(int) + 1), minlength=2049)
    n = sum(t for _, t in packing.plan_patterns(histogram))
    assert n <= 1.002 * -(-int((histogram * np.arange(2049)).sum()) // 2048)


def test_op8_counts_and_movement(spark, odd, empty, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    placed = {n: ring.assign_shards(docs, n).toPandas() for n in (10, 11)}
    for n, p in placed.items():
        sizes = p.groupby("shard").size()
        assert len(p) == docs.count() and len(sizes) == n and sizes.max() - sizes.min() <= 1
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in p.groupby("shard"))
    a, b = (placed[n].set_index("doc_id").shard for n in (10, 11))
    assert (a != b.loc[a.index]).mean() < 0.5
    texts = docs.toPandas().set_index("doc_id").text
    assert all(zlib.crc32(texts[r.doc_id].encode()) == r.text_crc32 and len(texts[r.doc_id].encode()) + 16 == r.size for r in placed[10].itertuples())
    got = ring.assign_shards(odd, 7).toPandas()
    assert len(got) == odd.count() and got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1 and ring.assign_shards(empty, 7).count() == 0


def ring_brute(ids, n_shards, points):
    """Every row walks clockwise from its place on the ring to the first shard with room; own rows of a shard come first."""
    ring_ = sorted((xxhash.xxh64_intdigest(f"shard {s} point {v}") - (1 << 63), s) for s in range(n_shards) for v in range(points))
    room = [len(ids) // n_shards + (s < len(ids) % n_shards) for s in range(n_shards)]
    at = [next((k for k, (p, _) in enumerate(ring_) if h <= p), 0) for h in ids]
    got, over = collections.Counter(), []
    for k in range(len(ring_)):
        for _ in range(at.count(k)):
            if room[s := ring_[k][1]]:
                room[s] -= 1
                got[k, s] += 1
            else:
                over.append(k)
    for k in over:
        step = k
        while True:
            step = (step + 1) % len(ring_)
            if room[s := ring_[step][1]]:
                room[s] -= 1
                got[k, s] += 1
                break
    return got


def test_op8_against_brute_force(spark):
    docs = docs_of(spark, [f"text {k % 7}" for k in range(300)], [k % 90 for k in range(300)])
    hashes = [r.h for r in docs.select(F.xxhash64("doc_id").alias("h")).collect()]
    got = ring.assign_shards(docs, 7, 16).groupBy("arc", "shard").count().collect()
    assert {(r.arc, r["shard"]): r["count"] for r in got} == dict(ring_brute(hashes, 7, 16))


def test_op8_write_shards(spark, odd):
    docs = docs_of(spark, [f"text {k % 5}" for k in range(400)], [k % 5 for k in range(400)])
    for table, n in ((docs, 10), (odd, 3)):
        path = work_path(spark, "shards")
        column = ring.write_shards(table, path, n, file_rows=8)
        back = spark.read.parquet(path)
        sizes = [r["count"] for r in back.groupBy(column).count().collect()]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == n and sum(sizes) == table.count()
        assert column == "_shard" and sorted(map(str, back.select(*table.columns).collect())) == sorted(map(str, table.collect()))


def test_op9_equals_the_unfactored_discriminant(spark):
    rng = np.random.default_rng(8)
    d = len(qda.STATISTICS)
    x, c = rng.normal(size=(400, d)) * np.linspace(0.5, 2, d), (rng.random(400) < 0.4).astype(int)
    x[c == 1] += 0.7
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "doc_id long, x array<double>")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(c)], "doc_id long, quality int")
    model = qda.fit(rows, labels)
    train = np.array([zlib.crc32(str(k).encode()) % 5 != 0 for k in range(400)])
    covs = [np.cov(x[train & (c == k)].T, bias=True) for k in (0, 1)]
    n = [int((train & (c == k)).sum()) for k in (0, 1)]
    pooled = sum(n[k] * np.diag(covs[k]) for k in (0, 1)) / sum(n)
    logs = []
    for k in (0, 1):
        s = (1 - qda.SHRINKAGE) * covs[k] + qda.SHRINKAGE * np.diag(pooled) * max(np.mean(np.diag(covs[k]) / pooled), qda.FLOOR) + qda.FLOOR * np.diag(pooled)
        away = x - x[train & (c == k)].mean(0)
        logs.append(np.log(n[k] / sum(n)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ni,ij,nj->n", away, np.linalg.inv(s), away))
    want = 1 / (1 + np.exp(-(logs[1] - logs[0]) / qda.TEMPERATURE))
    got = {r.doc_id: r.score for r in qda.scored(rows, model).collect()}
    assert np.allclose([got[k] for k in range(400)], want, atol=1e-9)


def test_op9_held_out(spark, small, odd, empty):
    sf = small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = qda.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    held = got[got.held_out]
    ranks = held.score.rank()
    n1, n0 = (held.quality == 1).sum(), (held.quality == 0).sum()
    assert (ranks[held.quality == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.3)).all()
    assert qda.classify(odd, labels).count() == odd.count() and qda.classify(empty, labels).count() == 0
    assert {r.score for r in qda.classify(odd, labels.where("false")).collect()} == {0.5}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Head</header><nav><ul><li><a href=x>One</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Hi &amp; ho</h1><p>One <b>two</b>  three, and more.<p>Second &lt;para&gt;.<aside>Also read</aside><div class='ad'>Buy now.</div><form>Mail <input></form><script>var x = "</p>";</script></article>
<section class="comments"><p>First comment, which is long, and goes on.</p></section><footer>&copy; c</footer>"""


def test_op10_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(10_000, "u", PAGE), (10_001, None, None), (10_002, "u", ""), (10_003, "u", "<p>" * 3000 + "deep")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_tree.extract(pages.unionByName(more).withColumn("text", F.lit(1))).collect()}
    assert got[10_000].text == "Hi & ho One two three, and more. Second <para>." and got[10_001].text == "" and got[10_002].n_chars == 0
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|li|ul|div|br)[^>]*>", "\0", inner))
        assert got[r.page_id].text == " ".join(x for x in (" ".join(html.unescape(y).split()) for y in inner.split("\0")) if x)
    assert html_tree.extract(pages.where("false")).count() == 0


def test_op10_odd_quotes_and_long_tags(spark):
    import time

    odd = ['<article><p title="5" tall">x > y</p></article>', "<article><p a='1\">z</p></article>", '<article><p x="a>b">q</p></article>']
    pages = spark.createDataFrame([(k, "u", h) for k, h in enumerate(odd)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_tree.extract(pages).collect()}
    assert got[0] == "x > y" and got[2] == "q"
    for piece in ('<p a="', "<p a='x ", "<p '\" ", "<a b=", "<!-- x"):
        began = time.process_time()
        html_tree.parse(0, piece * 20_000, html_tree.Nodes())
        assert time.process_time() - began < 5


def test_op10_messages_equal_enumeration():
    rng = np.random.default_rng(8)
    single, pairs = rng.random((html_tree.N_FEATURES, 2)) + 0.1, rng.random((len(html_tree.TAGS), 2, 2)) + 0.1
    parent, tag = np.array([-1, 0, 0, 1, 1, 2]), np.array([1, 2, 3, 0, 4, 0])
    depth = np.array([0, 1, 1, 2, 2, 2])
    feats = np.full((6, 4), -1)
    feats[:, 0] = tag
    got = html_tree.marginals(parent, depth, tag, feats, single, pairs)
    own, table = single / single.sum(1, keepdims=True), pairs / pairs.sum(2, keepdims=True)
    total = np.zeros((6, 2))
    for states in np.ndindex(*[2] * 6):
        p = np.prod([own[tag[k], s] for k, s in enumerate(states)]) * np.prod([table[tag[k], states[parent[k]], states[k]] for k in range(1, 6)])
        for k, s in enumerate(states):
            total[k, s] += p
    assert np.abs(got - total[:, 1] / total.sum(1)).max() < 1e-9


def test_pipeline_runs(spark, small):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, small).toPandas()
    check_packing(out, 2048)
    assert len(corpus_pipeline.STAGES) == 5 and len(out)


def test_pipeline_stages_take_odd_documents(spark, small, odd, empty):
    import corpus_pipeline

    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, small).columns == docs.columns
        assert corpus_pipeline.packing_stage(spark, docs, small).count() >= 0


def test_all_ten_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_op10_stray_end_tags_and_pages_without_an_article():
    import time

    prose = "Long prose of many words, that goes on and on. " * 20
    pages = [f"<body><div><p>{prose}</p></div><ul><li><a href=x>Home</a></li></ul></body>", f"<div class=nav><p>{prose}</p></div>", "<p>a<p>b</div></p></p>c", "<table><tr><td>x<td>y<tr><td>z</table></td></tr>w"]
    single, pairs = html_tree.with_priors(np.zeros(html_tree.N_FEATURES * 2 + len(html_tree.TAGS) * 4))
    texts = html_tree.main_texts(pa.RecordBatch.from_arrays([pa.array(pages)], ["html"]), single, pairs)
    assert texts[0].startswith(prose.strip()) and texts[1] == ""
    nodes = html_tree.Nodes()
    for k, page in enumerate(pages):
        html_tree.parse(k, page, nodes)
    by_page = collections.defaultdict(list)
    for node, text, _ in nodes.texts:
        by_page[nodes.page[node]].append(text)
    assert by_page[2] == ["a", "b", "c"] and by_page[3] == ["x", "y", "z", "w"]
    began = time.time()
    html_tree.parse(0, "<div>" * 40_000 + "</p>" * 20_000 + "x", html_tree.Nodes())
    assert time.time() - began < 5  # a stray end tag does not walk the open elements
