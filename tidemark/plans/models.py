"""Fitted models as a table: one logistic model for each cell of (candidate, fold, state), all cells fitted in one job.

A candidate names its features and, if it has one model per state, the column of a row's state. Training rows are
samples of their cell; a fitted cell is one row (coefficients, training counts), and evaluation rows are routed to the
cell of their own state by a join. Candidates with fewer features share the others' design with zeros, so a grid of
feature groups, regimes or sentiment forms is one set of grouped sums per Newton step.

A cell whose training rows have one class, or fewer rows than ``least``, has no model. A fold that needs the model of
such a cell is skipped for that candidate as a whole (status ``skipped``); it enters no summary.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import shuffled_place
from tidemark.functions.shared import checkpointed
from tidemark.plans import validation as V


@dataclass(frozen=True)
class Candidate:
    """features: of its model(s). state: the column whose value chooses the model of a row (None: one model). cash:
    the rows in which it holds no position, whatever the probability (-1). window: the last rows before a fold's test
    rows that train (None: all). c: the inverse of the penalty's weight."""

    name: str
    features: tuple[str, ...]
    state: str | None = None
    cash: Column | None = None
    window: int | None = None
    c: float = 1.0


def samples(rows: DataFrame, keys: Sequence[str], min_train: int, test: int, step: int, share: float = 0.2) -> DataFrame:
    """rows once per fold that uses them, with ``fold``, ``is_train`` and ``age`` (rows up to the fold's test rows); fold HOLDOUT trains on the whole development part
    and tests on the last ``share``. A fold trains on all rows before its test rows."""
    parts = V.positions(V.split_holdout(rows, share, keys), keys).drop("n_rows")
    ends = parts.groupBy(*keys).agg(F.count_if(F.col("part") == "development").alias("n"), F.count(F.lit(1)).alias("_all"))
    folds = V.walk_forward(ends, min_train, test, step).select(*keys, "fold", F.col("test_start").alias("_a"), F.col("test_end").alias("_b"))
    folds = folds.unionByName(ends.select(*keys, F.lit(V.HOLDOUT).alias("fold"), F.col("n").alias("_a"), F.col("_all").alias("_b")))
    out = parts.join(folds, list(keys)).where("pos < _b")
    return out.withColumn("is_train", (F.col("pos") < F.col("_a")).cast("int")).withColumn("age", F.col("_a") - F.col("pos")).drop("_a", "_b", "part", "pos")


def in_cells(rows: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """rows of ``samples`` once per candidate that uses them, with ``variant``, ``cell`` (null where a row's state is unknown),
    ``in_cash``, ``c`` and features that are 0 where a candidate has not got them."""
    features = sorted({f for c in candidates for f in c.features})
    each = []
    for c in candidates:
        own = [F.lit(c.name).alias("variant"), (F.col(c.state) if c.state else F.lit("all")).alias("cell"), (F.lit(False) if c.cash is None else F.coalesce(c.cash, F.lit(False))).alias("in_cash"), F.lit(c.c).alias("c")]
        used = F.lit(True) if c.window is None else (F.col("is_train") == 0) | (F.col("age") <= c.window)
        each.append(F.when(used, F.struct(*own, *[(F.col(f).cast("double") if f in c.features else F.lit(0.0)).alias(f) for f in features])))
    return rows.withColumn("_c", F.explode(F.array_compact(F.array(*each)))).drop(*features).select("*", "_c.*").drop("_c")


def fit_cells(rows: DataFrame, features: Sequence[str], keys: Sequence[str], target: str = "target", c: float | str = 1.0, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """(cells, scaled): per cell of ``keys`` the training counts, status and beta (null without a model); and all rows
    of known target and cell, imputed and standardised by their cell's training rows."""
    known = rows.where(F.col(target).isNotNull() & F.col(keys[-1]).isNotNull())
    scaled = checkpointed(V.standardize(known, features, keys))
    train = scaled.where("is_train = 1")
    counts = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_train"), F.sum(F.col(target).cast("long")).alias("n_positive"))
    status = F.when(F.col("n_train") < least, "too_few").when((F.col("n_positive") == 0) | (F.col("n_positive") == F.col("n_train")), "one_class").otherwise("ok")
    counts = checkpointed(counts.withColumn("status", status))
    beta = V.fit_logistic(train.join(counts.where("status = 'ok'").select(*keys), list(keys), "left_semi"), features, keys, target, c)
    return counts.join(beta, list(keys), "left"), scaled


def route(cells: DataFrame, scaled: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The evaluation rows with the probability of their own cell's model; rows of folds in which a needed cell has no
    model are left out. ``keys``: what a fold of a candidate is, then the cell."""
    fold = list(keys[:-1])
    tested = scaled.where("is_train = 0").join(cells.select(*keys, "beta"), list(keys), "left")
    skipped = tested.where("beta is null").select(*fold).distinct()
    eta = F.col("beta")[0] + sum((F.col("beta")[i + 1] * F.col(f) for i, f in enumerate(features)), F.lit(0.0))
    p = F.when(F.col("in_cash"), -1.0).otherwise(1 / (1 + F.exp(-eta)))
    return tested.join(skipped, fold, "left_anti").withColumn("probability", p).drop("beta", "c", "is_train", "age", *features)


def fit_and_route(rows: DataFrame, candidates: Sequence[Candidate], keys: Sequence[str], min_train: int, test: int, step: int, share: float = 0.2, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """(scored, cells): the evaluation rows of all candidates and folds with their probabilities, and the fitted cells."""
    features = sorted({f for c in candidates for f in c.features})
    by = [*keys, "variant", "fold", "cell"]
    cells, scaled = fit_cells(in_cells(samples(rows, keys, min_train, test, step, share), candidates), features, by, target, "c")
    cells = checkpointed(cells)
    return route(cells, scaled, features, by), cells


def fold_status(scored: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, variant, fold, status: ok or skipped, one row per fold that has training rows."""
    by = [*keys, "variant", "fold"]
    return cells.select(*by).distinct().join(scored.select(*by).distinct().withColumn("status", F.lit("ok")), by, "left").na.fill("skipped", ["status"])


def permutation_importance(rows: DataFrame, beta: DataFrame, features: Sequence[str], keys: Sequence[str], id: Column, target: str = "target", seed: int = 0) -> DataFrame:
    """keys, feature, importance, accuracy_drop, place: how much the mean log loss grows, and the accuracy falls, when a
    feature's values are dealt anew among the rows of a key. All features are keys of one job.

    rows: scaled features and the target; ``id`` tells the rows of a key apart. The values of a feature are put in the
    order of the MD5 of seed, feature and id, the rows that get them in that of seed and id, and places meet places.
    Rows without a target or a model take no part; equal importances are ordered by the feature's name."""
    x = V._design(features)
    eta = sum((F.col("beta")[i] * F.expr(f) for i, f in enumerate(x)), F.lit(0.0))
    known = rows.where(F.col(target).isNotNull()).join(beta.where("beta is not null"), list(keys)).withColumn("_id", id.cast("string")).withColumn("_eta", eta)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("_x"), F.col("beta")[i + 1].alias("_b")) for i, f in enumerate(features)]))
    long = known.select(*keys, "_id", "_eta", F.col(target).cast("double").alias("_y"), each.alias("_e")).select(*keys, "_id", "_eta", "_y", "_e.*")
    long = checkpointed(long)
    by = [*keys, "feature"]
    givers = shuffled_place(long.select(*by, "_id", F.col("_x").alias("_given")), by, "_place", F.lit(seed), "feature", "_id").drop("_id")
    takers = shuffled_place(long, by, "_place", F.lit(seed), "_id")
    met = takers.join(givers, [*by, "_place"])
    p, q = 1 / (1 + F.exp(-F.col("_eta"))), 1 / (1 + F.exp(-(F.col("_eta") + F.col("_b") * (F.col("_given") - F.col("_x")))))
    loss = lambda p: -F.ln(F.when(F.col("_y") == 1, p).otherwise(1 - p))
    right = lambda p: ((p >= 0.5) == (F.col("_y") == 1)).cast("double")
    found = met.groupBy(*by).agg((F.avg(loss(q)) - F.avg(loss(p))).alias("importance"), (F.avg(right(p)) - F.avg(right(q))).alias("accuracy_drop"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("importance", V.DIGITS).desc(), "feature")))  # one row per feature
