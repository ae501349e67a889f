"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations work on the stored bits.

``ledger`` measures each text in one pass and stores the measurements and one bit per failed rule. ``apply_policy``
keeps the rows whose failed rules are not in a policy's mask, ``ablation`` counts by bit arithmetic what each rule of
a policy removes alone and what would come back without it; neither reads a text again.

Defined results: a null, empty or wordless text has zero words and fails TOO_FEW_WORDS; repeated rows are measured
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, texts_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: The rules: a condition on the measurements that means failure. The place in this list is the rule's bit.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("upper_case", "10 * n_upper > 4 * word_chars"),
    ("no_letters", "2 * n_letters < word_chars"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Versioned policies: the mask of the rules that reject.
POLICIES: dict[str, int] = {
    "base": BIT["too_few_words"] | BIT["repeated_words"],
    "v1": (1 << len(RULES)) - 1,
}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters"]


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur at least twice in the text, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        hashes = hashes * np.uint64(0xD1342543DE82EF95) + mixed[k : k + n]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    upper = sum(map(str.isupper, text)) if text.upper() != text.lower() else 0
    letters = sum(map(str.isalpha, text))
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines),
        len(lines) - len(set(lines)), repeat_words(words), upper, letters,
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``: the bits of the rules that the text fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = np.array([measure(t) for t in texts_of(part)], np.int64).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[:, k]) for k in range(len(MEASURES)))], ["doc_id", *MEASURES])

    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " + ".join(f"CASE WHEN {rule} THEN {BIT[name]}L ELSE 0L END" for name, rule in RULES)
    return measured.withColumn("failed", F.expr(bits))


def apply_policy(rows: DataFrame, mask: int) -> DataFrame:
    """Adds ``kept``: no failed rule is in the policy's mask."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask)) == 0)


def ablation(rows: DataFrame, mask: int) -> DataFrame:
    """rule, n_failed, n_only (rows that only this rule of the policy rejects), n_kept_without: from one aggregation.

    The ledger is counted by its distinct masks first (2 ** rules at most), so nothing of row size is shuffled.
    """
    held = rows.select(F.col("failed").bitwiseAND(F.lit(mask)).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & mask]))
    each = held.select("f", "n", rules.alias("r")).select("f", "n", "r.*")
    has, rest = F.col("f").bitwiseAND(F.col("bit")) != 0, F.col("f").bitwiseAND(F.bitwise_not(F.col("bit")))
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(has & (rest == 0), F.col("n")).otherwise(0)).alias("n_only"), F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without")
    )
