"""Ranked search, phrase collocations and personal data against brute force, SQL, hand-made graphs and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.llm import ball_tree, collocations, identifiers, queries
from tidemark.llm import quotient_filter as Q

DOCS = "doc_id long, text string, lang string, item_id string, n long, score long"
ODD = [None, "", " ", "\n\n", "a", " a b ", "tab\tand\x0bx", "Ünïcödé ς ΑΣ é Éé", "the the the the", "don't 123 !!!", "\x00\x7f[`{", "a.b;c,d:e!f?g"]


def docs_of(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, t, lang in zip(ids, texts, langs, strict=True)], DOCS)


def sql_rows(small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con.execute(queries.ORACLES[name]).df()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    ours, theirs = queries.QUERIES[name](spark, small).toPandas(), sql_rows(small, name)
    cols = sorted(theirs.columns)
    assert sorted(ours.columns) == cols and len(theirs)
    pd.testing.assert_frame_equal(ours[cols].sort_values(cols).reset_index(drop=True), theirs[cols].sort_values(cols).reset_index(drop=True), check_dtype=False)


# Ranked search.

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k=10):
    texts = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    total, length = len(texts), sum(len(t) for _, t in texts)
    df = collections.Counter(w for _, t in texts for w in set(t))
    out = []
    terms = collections.defaultdict(set)
    for i, t in items:
        terms[i] |= set(TERM.findall((t or "").translate(LOWER)))
    for item, wanted in terms.items():
        found = []
        for i, t in texts:
            tf, m = collections.Counter(t), 10 + 90 * len(t) * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in wanted if tf[w])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_equals_brute_force(spark, small, monkeypatch):
    frame = pd.read_parquet(f"{small}/documents.parquet")
    items = pd.read_parquet(f"{small}/benchmark.parquet")
    docs = docs_of(spark, [*frame.text, *ODD, *frame.text[:30], "word " * 30_000], [*frame.doc_id, *range(10_000, 10_000 + len(ODD)), *frame.doc_id[:30], None])
    asked = [*zip(items.item_id.astype(str), items.text, strict=True), ("empty", ""), (None, "the"), ("none", None), ("twice", "the"), ("twice", "of"), ("long", " ".join(frame.text[:20]))]
    wanted = sorted(ranked([(r.doc_id, r.text) for r in docs.collect()], asked), key=str)
    table = spark.createDataFrame(asked, "item_id string, text string")
    monkeypatch.setattr(ball_tree, "TREE_DOCS", 64)
    assert rows_of(ball_tree.rank(docs.repartition(3), table)) == wanted
    monkeypatch.setattr(ball_tree, "BLOCK_TERMS", 300)  # many blocks of items
    assert rows_of(ball_tree.rank(docs.repartition(2), table)) == wanted


def test_search_of_empty_tables(spark):
    docs, none = docs_of(spark, ["a b"]), spark.createDataFrame([], DOCS)
    assert ball_tree.rank(docs, none).count() == 0 and ball_tree.rank(none, docs).count() == 0
    assert ball_tree.rank(none, docs).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("spread", [100, 10**10])
def test_bounds_hold_and_prune(spread):
    rng = np.random.default_rng(3)
    rows = [np.unique(np.concatenate([g * 20 + np.arange(20), 2000 + rng.integers(0, 30, 2)])) for g in rng.integers(0, 20, 2000)]
    ends, terms = np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows)
    values = 10**9 + rng.integers(0, spread, len(terms))
    tree = ball_tree.BallTree(ends, terms, values, leaf=16)
    item = np.asarray([*range(100, 120), 2001, 2002, 999_999])
    where = np.searchsorted(tree.vocabulary, item[:-1])
    exact = np.asarray([v[np.isin(t, item)].sum() for t, v in zip(np.split(terms, ends[1:-1]), np.split(values, ends[1:-1]), strict=True)])
    bounds = tree._bounds(where)
    for node, (a, b) in enumerate(tree.span):
        assert exact[tree.rows[a:b]].max() <= bounds[node]
    seen = 0
    for found, scores in tree.search(item, 10, int(np.sort(exact)[-10])):
        seen += len(found)
        assert (scores == exact[found]).all()
    assert seen < 1000 or spread > 100  # balls of like documents are passed over


# Phrases.


def test_filters_lose_nothing():
    rng = np.random.default_rng(1)
    for k in (2, 3):
        for n in (0, 1, 5, 3000):
            for lead in (0, 4, 9):
                words = [rng.integers(0, 40 if n > 5 else 2**63, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(k)]
                counts = rng.integers(1, 600, n)
                assert all((a == b).all() for a, b in zip(words, Q.restore(Q.permute(words)), strict=True))
                parts = [Q.decode(f) for _, f in Q.split(*Q.merged(Q.permute(words), counts), lead)]
                found = collections.Counter()
                for key, c in parts:
                    assert (key[0][1:] >= key[0][:-1]).all()
                    found.update(dict(zip(zip(*[w.tolist() for w in Q.restore(key)], strict=True), c.tolist(), strict=True)))
                wanted = collections.Counter()
                for key, c in zip(zip(*[w.tolist() for w in words], strict=True), counts.tolist(), strict=True):
                    wanted[key] += c
                assert found == wanted


def test_filters_of_equal_leading_words():
    words = [np.asarray([7, 7, 7, 7], np.uint64), np.asarray([2, 1, 2, 1], np.uint64)]
    merged, counts = Q.merged(words, np.asarray([1, 10, 100, 1000]))
    assert merged[1].tolist() == [1, 2] and counts.tolist() == [1010, 101]


def phrases(rows, least=10, top=2000):
    one, many, n = collections.Counter(), collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    (one if k == 1 else many)[lang, *w[i : i + k]] += 1
    f = lambda lang, p: (one if len(p) == 1 else many)[lang, *p]
    out = collections.defaultdict(list)
    longer = collections.Counter()
    for (lang, *p), c in many.items():
        if len(p) == 3 and c >= least:
            for part in (p[:2], p[1:]):
                longer[lang, *part] = max(longer[lang, *part], c)
    for (lang, *p), a in many.items():
        if a < least or (len(p) == 2 and longer[lang, *p] and 100 * longer[lang, *p] >= 50 * a):
            continue
        score, k = min((1_000_000 * a * a // (f(lang, p[:k]) * f(lang, p[k:])), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f(lang, p[:k]), f(lang, p[k:])))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


def test_phrases_equal_brute_force(spark, small, monkeypatch):
    frame = pd.read_parquet(f"{small}/documents.parquet")
    rows = [*zip(frame.lang, frame.text, strict=True), *[(None, t) for t in ODD], *[("zz", "New York City. new york\tcity, old York\x0cNew York")] * 12, *[("", "a b a b a b")] * 9, ("one", "x " * 5000), (None, "p q r " * 40)]
    docs = docs_of(spark, [t for _, t in rows], langs=[lang for lang, _ in rows])
    wanted = phrases(rows)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in collocations.mine(docs.repartition(3)).select(names).collect()} == wanted
    monkeypatch.setattr(collocations, "HELD_PHRASES", 500)  # many filters of a task
    assert {tuple(r) for r in collocations.mine(docs.repartition(2), top=50).select(names).collect()} == {w for w in wanted if w[1] <= 50}


def test_phrases_of_very_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abcdefgh"), 4000)) + ". " + " ".join(f"w{i}" for i in range(300)), "a b c. d " * 50, None]
    monkeypatch.setattr(collocations, "_LOCAL", 7)  # as if 128 words were too many for a task's numbers
    got = collocations.mine(docs_of(spark, texts).coalesce(1)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert {tuple(r) for r in got.collect()} == phrases([(None, t) for t in texts])


def test_phrases_of_an_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], DOCS)).count() == 0


# Personal data.

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for k, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text):
            digits = re.sub(r"\D", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


HARD = ["a@b.c@d.e f@g", "@x.y a@@b.c x..y%z@q-r.s.t. u@v._w", "1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256 9.9.9.9.9", "4111 1111 1111 1111-4111-1111", "4111-1111-1111-1111 5 4111111111111112 0000000000000", "+1 (743) 555-3824 +49.30.123456789, +1+23456789012 +12345678 + 123456789", "é +1 743 555 3824é 10.0.0.1é b@é.com", "1" * 5000 + "@" + "2" * 5000, "+1" + " " * 3000 + "(", "a." * 3000 + "@"]


def test_base_spans_equal_the_patterns(small):
    texts = [*HARD, *[t for t in ODD if t], *pd.read_parquet(f"{small}/documents.parquet").text.dropna()]
    rng = np.random.default_rng(5)
    texts += ["".join(rng.choice(list("1290 .-+()@ab%é"), 60)) for _ in range(3000)]
    for t in texts:
        assert identifiers.base_spans(t) == plain_base(t), t


def made(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    said = lambda *parts: " ".join([word() for _ in range(8)] + list(parts) + [word() for _ in range(8)])
    number = lambda: f"{rng.integers(200, 999)} {rng.integers(1000, 9999)}"
    rows = [said("Please call me:", f"+44 {rng.integers(100, 999)} {rng.integers(100, 999)} {rng.integers(1000, 9999)}") for _ in range(12)]
    local = number()
    hidden = [said("please call me:", local), said("please call me:", number()), said("write me:", "ann at home dot org")]
    known = [said("write me:", f"bob{i}@mail{i}.example.com") for i in range(6)]
    plain = [said("order no", f"{rng.integers(200, 999)} {rng.integers(1000, 9999)}") for _ in range(6)] + [said("version", "4.0", "of 2024-01-05"), said(local.replace(" ", "-"))]
    copies = [said("ring the bell", "+44 555 010 9999")] * 50 + [said("ring the bell", "555 0001")]
    return rows, hidden, known, plain, copies


def test_contexts_find_unseen_identifiers(spark):
    rows, hidden, known, plain, copies = made(spark)
    texts = rows + hidden + known + plain + copies + [None, "", "x" * 100_000]
    found = {r.doc_id: r for r in identifiers.identifiers(docs_of(spark, texts).repartition(3)).collect()}
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        base = plain_base(t or "")
        as_text = ",".join(f"{list(FORMS)[kind]}:{a}:{b}" for a, kind, b in base)
        assert found[k].base_sha256 == hashlib.sha256(as_text.encode()).hexdigest()
        assert set(filter(None, as_text.split(","))) <= set(found[k].spans.split(","))
        assert [found[k][f"n_{kind}"] for kind in FORMS] == [sum(i == j for _, i, _ in base) for j in range(4)]
    n = len(rows)
    for k in range(n, n + len(hidden)):
        kind = "email" if "dot" in texts[k] else "phone"
        (span,) = found[k].spans.split(",")
        name, a, b = span.split(":")
        assert name == kind and texts[k][int(a) : int(b)] in (" ".join(texts[k].split()[11:-8]), " ".join(texts[k].split()[10:-8]))
    start = n + len(hidden) + len(known)
    assert all(found[k].n_found == 0 for k in range(start, start + len(plain) - 1)), "numbers in other contexts stay"
    assert all(found[k].n_found == 0 for k in range(start + len(plain), len(texts))), "copies of one text are no evidence"


def test_scores_of_a_small_graph(spark):
    def row(k, *instances):
        return (1, 0, 0, 0, 0, [], [(0, kind, 1, value, sure, [c]) for c, kind, value, sure in instances], k)

    schema = identifiers._READ.format("long") + ", row long"
    rows = [row(k, ("phone: _", 3, k, True)) for k in range(4)] + [row(9, ("phone: _", 3, 100, False), ("tel _", 3, 100, False)), row(10, ("tel _", 3, 1, True), ("tel _", 3, 2, True), ("tel _", -1, 77, False))]
    rows += [row(11 + k, ("weak _", 3, 200 + k, k < 2)) for k in range(3)]
    contexts, known = identifiers.score(spark.createDataFrame(rows, schema), salts=2)
    c = 0.0
    for _ in range(identifiers.TURNS):  # four sure instances, one that is as sure as this context
        wanted = c = (4 + c) / (4 + c + 0.5 * (1 - c) + 1)
    (found,) = contexts.collect()
    assert (found.context, found.kind, found.n_sure) == ("phone: _", 3, 4) and abs(found.score - wanted) < 1e-9
    sure = {r.instance: r.confidence for r in known.collect()}
    assert sure[0] == 1 and 0.5 < sure[100] < 1 and 202 not in sure


def test_identifiers_of_odd_tables(spark):
    empty = identifiers.identifiers(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    odd = identifiers.identifiers(docs_of(spark, [*ODD, *HARD, HARD[0]], [*range(len(ODD) + len(HARD) - 1), None, None]))
    assert odd.count() == len(ODD) + len(HARD) + 1
    assert identifiers._without_overlaps([(0.6, 0, 3, 10), (0.9, 5, 2, 12), (0.6, 12, 3, 20), (0.6, 30, 3, 40), (0.6, 30, 2, 40)]) == [(5, 2, 12), (12, 3, 20), (30, 2, 40)]
