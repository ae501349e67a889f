"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian over the transformed statistics of its labelled texts. The classes' sums, and sums of
products, are one distributed aggregation (2 x (1 + d + d * d) numbers reach the driver); covariances are shrunk
towards a multiple of the pooled variances, their Cholesky factors are kept, and a text's score is the logistic of the
difference of the two log-densities (Mahalanobis distances through the factors) and of the prior odds.

Only the text is measured: labels, lang, source and doc_id are never inputs. All labelled rows outside the held-out
fifth are used, without a bound, as the fit is a sum.

Defined results: null and empty texts have the statistics of zero words and get a score like any other; a null doc_id
is not held out and has no label; repeated rows are scored each; labels other than 0 and 1 and null are ignored;
without rows of one class every score is 1 if only class 1 has rows and 0.5 otherwise; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import apart, free_units, materialize, slices, texts_of

STATISTICS = [
    "log_words", "word_length", "word_length_spread", "vocabulary", "upper", "symbols", "punctuation", "digits",
    "lines", "repeated_lines", "entropy", "commonest_word", "non_ascii",
]
#: Weight of the pooled variances in a class's covariance, and the least variance as a share of the pooled one.
SHRINKAGE, FLOOR = 0.1, 0.02
#: Log-odds are divided by this before the logistic, as the statistics are not independent draws.
TEMPERATURE = 4.0
THRESHOLD = 0.3


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(b"0123456789")
_SYMBOL, _PUNCT = _table(b"#*$%&|<>"), _table(b".,;:!?")


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    log = lambda x: float(np.log(x + 0.01))
    return [
        float(np.log1p(len(words))), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        float(np.log1p(len(seen)) / np.log1p(n)), log(counts[_UPPER].sum() / size), log(counts[_SYMBOL].sum() / n),
        log(counts[_PUNCT].sum() / n), log(counts[_DIGIT].sum() / size), log(len(lines) / n),
        log(1 - len(set(lines)) / max(len(lines), 1)), float(-(share * np.log2(share)).sum()),
        log(max(seen.values(), default=0) / n), log(counts[128:].sum() / size),
    ]


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and the columns in ``keep``) with ``x``: the statistics of each text."""
    columns = ["doc_id", *[c for c in keep or [] if c not in ("doc_id", "text")]]
    sent = docs.select(*columns, "text")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        for batch in batches:
            for part in slices(batch):
                found = np.array([statistics(t) for t in texts_of(part)]).reshape(-1)
                x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) + 1, len(STATISTICS)), pa.int32()), pa.array(found))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), x], [*columns, "x"])

    return sent.mapInArrow(run, ", ".join(kinds) + ", x array<double>")


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray  # class x d
    factors: np.ndarray  # class x d x d: inverses of the Cholesky factors
    offsets: np.ndarray  # class: log prior - log determinant / 2
    only: float | None = None  # the score where a class has no rows

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        logs = [self.offsets[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / TEMPERATURE, -500, 500)))


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """rows(doc_id, x); labels(doc_id, quality): fitted on the labelled rows that are not held out."""
    truth = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("c"))
    train = truth.where(~held_out(F.col("doc_id"))).join(apart(rows.select("doc_id", "x")), "doc_id").select("c", "x")
    d = len(STATISTICS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            c = batch.column("c").to_numpy()
            for k in (0, 1):
                own = x[c == k]
                total[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["c", "total"])

    each = train.mapInArrow(sums, "c int, total array<double>").select("c", F.posexplode("total").alias("k", "v")).groupBy("c", "k").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in each.collect():  # 2 x (1 + d + d * d) rows
        total[r["c"], r["k"]] = r["v"]
    n = total[:, 0]
    if not n.all():
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), 1.0 if n[1] else 0.5)
    means = total[:, 1 : 1 + d] / n[:, None]
    squares = total[:, 1 + d :].reshape(2, d, d) / n[:, None, None]
    within = squares - means[:, :, None] * means[:, None, :]
    pooled = np.maximum(np.einsum("ckk->k", within * (n / n.sum())[:, None, None]), 1e-6)
    factors, offsets = [], []
    for c in (0, 1):
        target = np.diag(pooled) * max(np.mean(np.diag(within[c]) / pooled), FLOOR)
        cholesky = np.linalg.cholesky((1 - SHRINKAGE) * within[c] + SHRINKAGE * target + FLOOR * np.diag(pooled))
        factors.append(np.linalg.inv(cholesky))
        offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(cholesky)).sum())
    return Discriminant(means, np.array(factors), np.array(offsets))


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """Replaces ``x`` by ``score``."""
    columns = [c for c in rows.columns if c != "x"]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        for batch in batches:
            score = model.scores(batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(score)], [*columns, "score"])

    return rows.mapInArrow(run, ", ".join([*kinds, "score double"]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row."""
    rows = materialize(measured(docs.withColumn("doc_id", F.col("doc_id").cast("long"))), "statistics")
    found = scored(rows, fit(rows, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold: one pass, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_units()
        for batch in batches:
            for part in slices(batch):
                x = np.array([statistics(t) for t in texts_of(part)]).reshape(-1, len(STATISTICS))
                yield part.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
