"""Personal data: fixed forms, and bootstrapped contexts that find identifiers whose form is not one of them.

1. One pass over the texts takes the spans of the fixed forms (``base_spans``), looser forms of the same kinds that they
   leave (a number without its country code, an address with ``at`` and ``dot``), and other words with digits. All are
   instances (kind and normalised value) with the contexts that they stand in: the two words before, the word before
   and the word behind, and a word before that ends like a label (``:``, ``=``, ``#``).
2. The graph of contexts and distinct instances is scored in Spark, in turns: instances of the fixed forms are sure; a
   context is as sure as the share of sure instances among all that stand in it (unknown ones count half, words of no
   kind in full, and one more is added against thin evidence), given LEAST_SURE different sure instances; an unknown
   instance is as sure as its contexts together. Copies of a text add nothing, as instances count once in a context.
3. Loose forms in sure contexts, or with a surely known value, become spans beside those of the fixed forms.

Defined results: a null text is empty; rows count one by one, repeated ones too (their evidence counts once); doc_id is
passed on as it is; of overlapping found spans the surer stays, then the earlier, then the kind listed first; spans of
the fixed forms always stay; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, salted_lookup, slices

#: In the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE, OTHER = 0, 1, 2, 3, -1

#: Different sure instances that a context needs, the least score of a context that finds, the score of an instance
#: that is taken wherever its value stands, and the most turns.
LEAST_SURE, SURE_CONTEXT, SURE_INSTANCE, TURNS = 3, 0.5, 0.9, 5
#: Characters beside an instance in which its context is looked for.
REACH = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a later digit of a run finds nothing that its first does not
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_HINT = re.compile(r" dot |[\[(](?:dot|at)[\])]", re.IGNORECASE)

# Looser forms; all repetitions are bounded, so a hostile text costs no more than its length.
_LOOSE = (
    (EMAIL, re.compile(r"(?<![\w.%+@-])[A-Za-z0-9._%+-]{1,64}(?:@[A-Za-z0-9-]{1,63}| ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,4}| at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,4})(?![\w@])", re.IGNORECASE)),
    (IP, re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| dot | \. )[0-9]{1,3}){3})(?![\w:])")),
    (CARD, re.compile(r"(?<![\w.+/-])[0-9](?:[ ./-]{0,2}[0-9]){11,18}(?![\w-])")),
    (PHONE, re.compile(r"(?<![\w.+@/-])\(?[0-9][0-9 ()./-]{4,22}[0-9](?![\w@-])")),
)
_NUMBERED = re.compile(r"\S*[0-9]\S*")
_WORD = re.compile(r"\S+")

_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_INSTANCE = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("base", pa.bool_()), ("contexts", pa.list_(pa.string()))])
_READ = "doc_id {}, n_email long, n_ip long, n_card long, n_phone long, base array<struct<start int, kind int, end int>>, instances array<struct<start int, kind int, end int, instance long, base boolean, contexts array<string>>>"


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, int]]:
    """What the pattern of an address finds from left to right, from its @ signs, so that no long word is read twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, EMAIL, end
        else:
            end = max(end, at)
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, by start, then kind; matches that fail their check are dropped."""
    if not _ANY.search(text):
        return []
    out = list(_emails(text))
    out += [(m.start(), IP, m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), CARD, m.end()))
    out += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser forms of the kinds, and other words with digits (kind OTHER), that touch no span of the fixed forms."""
    if not (_ANY.search(text) or _HINT.search(text)):
        return []
    taken = _Taken(base)
    out = []
    for kind, form in _LOOSE:
        if kind == EMAIL and "@" not in text and not _HINT.search(text):
            continue
        for m in form.finditer(text):
            n = sum(c.isdigit() for c in m.group())
            if taken.free(m.start(), m.end()) and (kind != PHONE or 7 <= n <= 15):
                out.append((m.start(), kind, m.end()))
    taken = _Taken(base + out)
    out += [(m.start(), OTHER, m.end()) for m in _NUMBERED.finditer(text) if taken.free(m.start(), m.end())]
    return out


class _Taken:
    """Places of a text that spans cover."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.ends: list[tuple[int, int]] = []
        for start, _, end in sorted(spans):
            if self.ends and start <= self.ends[-1][1]:
                self.ends[-1] = (self.ends[-1][0], max(end, self.ends[-1][1]))
            else:
                self.ends.append((start, end))

    def free(self, start: int, end: int) -> bool:
        import bisect

        k = bisect.bisect_left(self.ends, (end, -1))
        return k == 0 or self.ends[k - 1][1] <= start


def contexts_of(text: str, start: int, end: int) -> list[str]:
    """The contexts of a span, within its line."""
    low = max(0, start - REACH)
    left = text[low:start]
    line = left.rfind("\n") + 1
    words = [m.group() for m in _WORD.finditer(left, line) if m.start() > 0 or low == 0 or text[low - 1].isspace()]
    right = text[end : end + REACH].split("\n", 1)[0].split()
    before = [w.lower().lstrip("\"'([{<*").rstrip("\"')]}>*,.;!?") for w in words[-2:]]
    behind = right[0].lower().strip("\"'()[]{}<>*,.;:!?") if right else ""
    out = []
    if len(before) == 2 and all(before):
        out.append(f"{before[0]} {before[1]} _")
    if before and before[-1]:
        if behind:
            out.append(f"{before[-1]} _ {behind}")
        if before[-1][-1] in ":=#" and len(before[-1]) > 1:
            out.append(f"{before[-1]} _")
    return out


def _value(kind: int, text: str) -> int:
    """A hash of an instance: its kind and normalised value."""
    if kind in (CARD, PHONE):
        value = "".join(c for c in text if c.isdigit())
    elif kind == OTHER:
        value = text
    else:
        value = re.sub(r" ?[\[(]?\bdot\b[\])]? ?|\[\.\]|\(\.\)| \. ", ".", re.sub(r" ?[\[(]at[\])] ?| at ", "@", text.lower()))
    return xxhash.xxh64_intdigest(f"{kind}:{value}") - (1 << 63)


def read(docs: DataFrame) -> DataFrame:
    """A row per document: counts and spans of the fixed forms, and all instances with their contexts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                base, instances = [], []
                for text in piece.column("text").to_pylist():
                    text = text or ""
                    fixed = base_spans(text)
                    base.append(fixed)
                    found = [(s, True) for s in fixed] + [(s, False) for s in loose_spans(text, fixed)]
                    instances.append([dict(start=a, kind=k, end=b, instance=_value(k, text[a:b]), base=sure, contexts=contexts_of(text, a, b)) for (a, k, b), sure in found])
                counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(len(KINDS))]
                spans = pa.array([[dict(start=a, kind=k, end=b) for a, k, b in one] for one in base], pa.list_(_SPAN))
                yield pa.record_batch([piece.column("doc_id"), *counts, spans, pa.array(instances, pa.list_(_INSTANCE))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "instances"])

    return docs.select("doc_id", "text").mapInArrow(scan, _READ.format(dict(docs.dtypes)["doc_id"])).withColumn("row", F.monotonically_increasing_id())


def _occurrences(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.explode("instances").alias("i")).select("row", "i.*")


def score(rows: DataFrame, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """Tables of the graph of ``rows`` (of ``read``): contexts (context, kind, score, n_sure) and instances
    (instance, confidence), after the turns in which the scores settle."""
    found = _occurrences(rows)
    edges = materialize(found.select(F.explode("contexts").alias("context"), "kind", "instance", "base").groupBy("context", "kind", "instance").agg(F.max("base").alias("base")), "context-edges")
    known = materialize(found.where(F.col("kind") != OTHER).groupBy("instance").agg(F.max(F.col("base").cast("double")).alias("confidence")).where("confidence > 0"), "instances")
    of_kind, others = edges.where(F.col("kind") != OTHER), edges.where(F.col("kind") == OTHER).groupBy("context").agg(F.count(F.lit(1)).alias("n_other"))
    seen = None
    for _ in range(TURNS):
        sure = F.coalesce("confidence", F.lit(0.0))
        each = salted_lookup(of_kind, known, ["instance"], salts, "left").groupBy("context", "kind").agg(F.sum(sure).alias("hit"), F.sum(1 - sure).alias("unknown"), F.count_if(sure >= SURE_INSTANCE).alias("n_sure"))
        total = each.groupBy("context").agg(F.sum("hit").alias("all_hit"))
        each = each.join(total, "context").join(others, "context", "left")
        each = each.withColumn("score", F.col("hit") / (F.col("all_hit") + 0.5 * F.col("unknown") + F.coalesce("n_other", F.lit(0)) + 1))
        contexts = materialize(each.where((F.col("n_sure") >= LEAST_SURE) & (F.col("score") >= SURE_CONTEXT)).select("context", "kind", "score", "n_sure"), "contexts")
        gained = salted_lookup(of_kind.where(~F.col("base")), contexts.drop("n_sure"), ["context", "kind"], salts).groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("confidence"))
        known = materialize(known.where("confidence = 1").union(gained).groupBy("instance").agg(F.max("confidence").alias("confidence")), "instances")
        now = known.agg(F.count(F.lit(1)), F.sum(F.round("confidence", 6).cast("decimal(20,6)"))).first()
        if now == seen:
            break
        seen = now
    discard(edges)
    return contexts, known


def identifiers(docs: DataFrame, salts: int = 16) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the fixed forms), spans (all), n_found (beyond them)."""
    rows = materialize(read(docs), "identifiers")
    contexts, known = score(rows, salts)
    loose = _occurrences(rows).where(~F.col("base") & (F.col("kind") != OTHER)).withColumn("at", F.struct("start", "kind", "end"))
    by_context = salted_lookup(loose.select("row", "at", "kind", F.explode("contexts").alias("context")), contexts.drop("n_sure"), ["context", "kind"], salts)
    by_context = by_context.groupBy("row", "at").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("sure"))
    by_value = salted_lookup(loose.select("row", "at", "instance"), known.where(F.col("confidence") >= SURE_INSTANCE), ["instance"], salts).select("row", "at", F.col("confidence").alias("sure"))
    found = by_context.union(by_value).groupBy("row", "at").agg(F.max("sure").alias("sure"))
    found = found.groupBy("row").agg(F.collect_list(F.struct(F.round("sure", 9).alias("sure"), "at.*")).alias("found"))  # of one text
    joined = rows.drop("instances").join(found, "row", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, spans, n_found = [], [], []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist(), strict=True):
                fixed = [(b["start"], b["kind"], b["end"]) for b in base]
                new = _without_overlaps([(f["sure"], f["start"], f["kind"], f["end"]) for f in more or []])
                digests.append(hashlib.sha256(listed(fixed).encode()).hexdigest())
                spans.append(listed(fixed + new))
                n_found.append(len(new))
            yield pa.record_batch([*[batch.column(c) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(n_found, pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found"])

    return joined.mapInArrow(write, f"doc_id {dict(docs.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_found long")


def _without_overlaps(found: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping spans the surer stays, then the earlier, then the kind listed first."""
    import bisect

    kept: list[tuple[int, int, int]] = []
    for _, start, kind, end in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        k = bisect.bisect_left(kept, (start, -2, 0))
        if (k == 0 or kept[k - 1][2] <= start) and (k == len(kept) or kept[k][0] >= end):
            kept.insert(k, (start, kind, end))
    return kept


def listed(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
