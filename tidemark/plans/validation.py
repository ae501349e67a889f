"""Chronological validation: folds, threshold sweeps, selection, and a logistic model fitted for all cells at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import checkpointed
from tidemark.functions.windows import ordered
from tidemark.operators import ledger


def positions(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """pos (from 0) and n_rows of each row in its series."""
    w = Window.partitionBy(*keys)
    return df.withColumn("pos", F.row_number().over(ordered(keys)) - 1).withColumn("n_rows", F.count(F.lit(1)).over(w))


def split_holdout(df: DataFrame, share: float = 0.2, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """part: development or holdout, the last ceil(n * share) rows (1 at least, n - 1 at most)."""
    n = F.greatest(F.lit(1), F.least(F.col("n_rows") - 1, F.ceil(F.col("n_rows") * share)))
    return positions(df, keys).withColumn("part", F.when(F.col("pos") < F.col("n_rows") - n, "development").otherwise("holdout")).drop("pos", "n_rows")


def walk_forward(sizes: DataFrame, min_train: int, test: int, step: int, window: int | None = None, gap: int = 0, full_only: bool = False) -> DataFrame:
    """sizes(..., n): one row per fold with half-open bounds; ``window`` bounds the training rows, ``gap`` purges."""
    start = F.lit(min_train + gap)
    last = F.col("n") - (test if full_only else 1)
    folds = sizes.where(start <= last).withColumn("test_start", F.explode(F.sequence(start, last, F.lit(step))))
    rows = folds.withColumn("fold", ((F.col("test_start") - start) / step).cast("int")).withColumn("test_end", F.least(F.col("n"), F.col("test_start") + test)).withColumn("train_end", F.col("test_start") - gap)
    return rows.withColumn("train_start", F.greatest(F.lit(0), F.col("train_end") - window) if window else F.lit(0))


def purged_kfold(sizes: DataFrame, k: int, gap: int) -> DataFrame:
    """k test ranges; training rows are those at least ``gap`` away on both sides."""
    rows = sizes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rows = rows.withColumn("test_start", F.floor(F.col("n") * F.col("fold") / k)).withColumn("test_end", F.floor(F.col("n") * (F.col("fold") + 1) / k))
    return rows.withColumn("train_before_end", F.greatest(F.lit(0), F.col("test_start") - gap)).withColumn("train_after_start", F.least(F.col("n"), F.col("test_end") + gap))


def assign_folds(df: DataFrame, folds: DataFrame, keys: Sequence[str] = ("symbol",), part: str = "test") -> DataFrame:
    """df's rows once per fold whose range holds them; the fold table is a few rows per key."""
    spans = folds.select(*keys, "fold", F.col(f"{part}_start").alias("_a"), F.col(f"{part}_end").alias("_b"))
    return positions(df, keys).join(spans, list(keys)).where("pos >= _a and pos < _b").drop("_a", "_b", "n_rows")


def classification_metrics(df: DataFrame, keys: Sequence[str], truth: str = "target", predicted: str = "predicted") -> DataFrame:
    """Accuracy, precision, recall, F1; a division by zero gives 0, no rows no row."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.where(F.col(truth).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.withColumns({"accuracy": share(F.col("tp") + F.col("tn"), F.col("n")), "precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "f1": share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def probability_diagnostics(df: DataFrame, keys: Sequence[str], p: str = "probability") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(p).alias("p_min"), F.max(p).alias("p_max"), F.avg(p).alias("p_mean"), F.stddev_pop(p).alias("p_std"), F.count(p).alias("n"))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Ledger metrics and the cash baseline for every (keys, threshold): the thresholds are a key, the sweep one job.
    With a column target also precision, recall and F1."""
    rows = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("signal", (F.col("probability") >= F.col("threshold")).cast("int"))
    by = [*keys, "threshold"]
    out = ledger.run_metrics(rows, by).withColumn("cash_return", F.lit(0.0))
    if "target" in scored.columns:
        out = out.join(classification_metrics(rows, by, predicted="signal").select(*by, "precision", "recall", "f1"), by, "left")
    return out


def summarize_thresholds(m: DataFrame, keys: Sequence[str], kind: str = "return", most_exposure: float = 0.9, thresholds: Sequence[float] = ()) -> DataFrame:
    """Medians and sums over the folds per threshold, the filters it passes, and whether it is eligible. Those of
    ``thresholds`` that have no rows stand there as well, without folds.

    kind "return": trades, a median return of 0 or more and not below cash; "regime": trades, a return above cash and
    above buy and hold (column buy_hold_return); "interval": that, and an exposure of most_exposure at most."""
    mean = [c for c in ("precision", "recall", "f1") if c in m.columns]
    median = [c for c in ("cash_return", "buy_hold_return") if c in m.columns]
    rows = m.groupBy(*keys, "threshold").agg(
        F.sum("n_trades").alias("n_trades"), F.median("total_return").alias("median_return"), F.median("max_drawdown").alias("median_drawdown"), F.median("turnover").alias("median_turnover"), F.median("exposure").alias("median_exposure"), F.count(F.lit(1)).alias("n_folds"),
        *[F.median(c).alias(f"median_{c}") for c in median], *[F.avg(c).alias(f"mean_{c}") for c in mean],
    )
    if thresholds:
        every = m.select(*keys).distinct().withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
        rows = every.join(rows, [*keys, "threshold"], "left").na.fill(0, ["n_trades", "n_folds"])
    r, cash = F.col("median_return"), F.col("median_cash_return") if "cash_return" in median else F.lit(0.0)
    passes = {"trades": F.col("n_trades") > 0}
    if kind == "return":
        passes |= {"return": r >= 0, "cash": r >= cash}
    else:
        passes |= {"cash": r > cash, "buy_hold": r > F.col("median_buy_hold_return")}
        if kind == "interval":
            passes["exposure"] = F.col("median_exposure") <= most_exposure
    rows = rows.withColumns({f"passes_{n}": F.coalesce(c, F.lit(False)).cast("int") for n, c in passes.items()})
    return rows.withColumn("eligible", F.least(*[F.col(f"passes_{n}") for n in passes]))


def rank_eligible(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """rank among the eligible rows of each key; the others have none."""
    w = Window.partitionBy(*keys, F.col("eligible")).orderBy(*order)
    return df.withColumn("rank", F.when(F.col("eligible") == 1, F.row_number().over(w)))


def select_threshold(summary: DataFrame, keys: Sequence[str], by_exposure: bool = False) -> DataFrame:
    """Highest return, then smallest drawdown, turnover (exposure) and threshold."""
    order = [F.col("median_return").desc(), F.abs(F.col("median_drawdown")), F.col("median_turnover"), *[F.col("median_exposure")] * by_exposure, F.col("threshold")]
    return rank_eligible(summary, keys, order).where("rank = 1")


#: The threshold that every probability reaches: buy and hold, evaluated in the same sweep.
ALWAYS = -1.0
#: The fold number of the holdout rows.
HOLDOUT = -1


def against_holding(tested: DataFrame, keys: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Ledger metrics of every (keys, threshold) of rows that are scored, with buy_hold_return of the same rows."""
    m = threshold_sweep(tested, [ALWAYS, *thresholds], keys)
    held = m.where(F.col("threshold") == ALWAYS).select(*keys, F.col("total_return").alias("buy_hold_return"))
    return m.where(F.col("threshold") != ALWAYS).join(held, list(keys))


def evaluate_grid(scored: DataFrame, keys: Sequence[str], thresholds: Sequence[float], min_train: int, test: int, step: int, share: float = 0.2) -> DataFrame:
    """Ledger metrics of every candidate (keys), fold and threshold, the holdout (fold HOLDOUT) and buy and hold included:
    candidates, folds and thresholds are keys of one sweep. buy_hold_return stands beside each row."""
    rows = split_holdout(scored, share, keys)
    development = rows.where("part = 'development'").drop("part")
    folds = walk_forward(development.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), min_train, test, step)
    tested = assign_folds(development, folds, keys).drop("pos").unionByName(rows.where("part = 'holdout'").drop("part").withColumn("fold", F.lit(HOLDOUT)))
    return against_holding(tested, [*keys, "fold"], thresholds)


#: Medians are compared with so many decimals, so that rounding decides no tie.
DIGITS = 9


def select_and_confirm(m: DataFrame, keys: Sequence[str], kind: str = "interval", most_exposure: float = 0.9, among: Sequence[str] = (), candidate_order: Sequence = ()) -> DataFrame:
    """One row per candidate: the selected threshold with its development medians (null where no threshold is eligible),
    the holdout's metrics at it, the rank among the candidates of the same ``among``, and the decision.

    Ranks go by return, smaller drawdown, turnover, exposure (kind "interval") and the candidates' own order; candidates
    without a threshold have none. Only the first is decided on: confirmed where its holdout is above cash and above buy
    and hold. The holdout ranks nothing."""
    summary = summarize_thresholds(m.where(F.col("fold") != HOLDOUT), keys, kind, most_exposure)
    summary = summary.withColumns({c: F.round(c, DIGITS) for c in ("median_return", "median_drawdown", "median_turnover", "median_exposure")})
    interval = kind == "interval"
    chosen = select_threshold(summary, keys, by_exposure=interval).drop("rank", "eligible")
    names = ["total_return", "max_drawdown", "turnover", "exposure", "n_trades", "buy_hold_return"]
    holdout = m.where(F.col("fold") == HOLDOUT).select(*keys, "threshold", *[F.col(c).alias(f"holdout_{c}") for c in names])
    out = m.select(*keys).distinct().join(chosen, list(keys), "left").join(holdout, [*keys, "threshold"], "left")
    order = [F.col("median_return").desc(), F.abs("median_drawdown"), F.col("median_turnover"), *[F.col("median_exposure")] * interval, *(candidate_order or keys)]
    out = rank_eligible(out.withColumn("eligible", F.col("threshold").isNotNull().cast("int")), among, order)
    good = (F.col("holdout_total_return") > 0) & (F.col("holdout_total_return") > F.col("holdout_buy_hold_return"))
    return out.withColumn("decision", F.when(F.col("rank") == 1, F.when(F.coalesce(good, F.lit(False)), "confirmed").otherwise("not_confirmed")))


def label_grid(df: DataFrame, horizons: Sequence[int], costs: dict[str, float], vols: Sequence[float]) -> DataFrame:
    """Every row once per candidate (horizon, cost, vol multiplier) with its label: one pass, candidates as keys."""
    w = ordered()
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.lead("close", h).over(w) / F.col("close") - 1).alias("next_return")) for h in horizons])
    rows = df.withColumn("_h", ahead).withColumn("_h", F.explode("_h")).select("*", "_h.*").drop("_h")
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("cost"), F.lit(c).alias("_c"), F.lit(float(v)).alias("vol_mult")) for n, c in costs.items() for v in vols]))
    rows = rows.withColumn("_g", grid).select("*", "_g.*").drop("_g")
    band = F.col("_c") + F.col("vol_mult") * F.col("realized_volatility_24h")
    return rows.withColumn("target", (F.col("next_return") > band).cast("byte")).drop("_c")


# A logistic regression per cell, all cells in one job.


def _design(features: Sequence[str]) -> list[str]:
    return ["1.0D", *features]


def standardize(df: DataFrame, features: Sequence[str], keys: Sequence[str], train: str = "is_train") -> DataFrame:
    """Median imputation and standardisation by the cell's training rows (population deviation; constant, or no training
    rows: 0)."""
    fit = df.where(F.col(train) == 1)
    medians = fit.groupBy(*keys).agg(*[F.percentile(f, 0.5).alias(f"_m_{f}") for f in features])
    filled = df.join(medians, list(keys), "left").withColumns({f: F.coalesce(f, f"_m_{f}", F.lit(0.0)) for f in features}).drop(*[f"_m_{f}" for f in features])
    moments = filled.where(F.col(train) == 1).groupBy(*keys).agg(*[F.avg(f).alias(f"_a_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    scaled = {f: F.coalesce(F.try_divide(F.col(f) - F.col(f"_a_{f}"), F.nullif(f"_s_{f}", F.lit(0.0))), F.lit(0.0)) for f in features}
    return filled.join(moments, list(keys), "left").withColumns(scaled).drop(*[f"_a_{f}" for f in features], *[f"_s_{f}" for f in features])


def fit_logistic(df: DataFrame, features: Sequence[str], keys: Sequence[str], target: str = "target", c: float | str = 1.0, steps: int = 12, close: float = 1e-9) -> DataFrame:
    """keys, beta (intercept first): L2 Newton for every cell at once; the intercept is penalised as well. ``c``: the
    inverse of the penalty's weight, or the column that has it, the same in all rows of a cell.

    A step is one grouped aggregation of the k(k+1)/2 + k sums, and a k x k solution per cell; it ends when no
    coefficient of any cell moves by more than ``close``. df is read once a step: hand in a table or a checkpoint.
    """
    x = _design(features)
    k = len(x)
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", beta array<double>, moved double"
    beta = df.select(*keys).distinct().withColumn("beta", F.array(*[F.lit(0.0)] * k))
    names = [f"h{i}_{j}" for i in range(k) for j in range(i, k)] + [f"g{i}" for i in range(k)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(k)
        for rows in batches:
            b, g = np.asarray(rows["beta"].tolist()).reshape(-1, k), rows[[f"g{i}" for i in range(k)]].to_numpy(float)
            h = np.zeros((len(rows), k, k))
            h[:, upper[0], upper[1]] = h[:, upper[1], upper[0]] = rows[names[: len(upper[0])]].to_numpy(float)
            weight = rows["_c"].to_numpy(float)[:, None]
            step = np.linalg.solve(weight[:, :, None] * h + np.eye(k), (weight * g - b)[:, :, None])[:, :, 0] if len(rows) else b
            yield rows[list(keys)].assign(beta=list((b + step).tolist()), moved=np.abs(step).max(axis=1))

    for _ in range(steps):
        joined = df.join(beta.drop("moved"), list(keys))  # one row per cell
        eta = sum((F.col("beta")[i] * F.expr(f) for i, f in enumerate(x)), F.lit(0.0))
        rows = joined.withColumn("_p", 1 / (1 + F.exp(-eta))).withColumn("_w", F.col("_p") * (1 - F.col("_p")))
        sums = [F.sum(F.col("_w") * F.expr(x[i]) * F.expr(x[j])).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum((F.col(target) - F.col("_p")) * F.expr(x[i])).alias(f"g{i}") for i in range(k)]
        cells = rows.groupBy(*keys).agg(F.first("beta").alias("beta"), F.first(c if isinstance(c, str) else F.lit(float(c))).alias("_c"), *sums)
        beta = checkpointed(cells.select(*keys, "beta", "_c", *names).mapInPandas(solve, spec))
        if (beta.agg(F.max("moved")).first()[0] or 0.0) <= close:
            break
    return beta.drop("moved")


def predict(df: DataFrame, beta: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    x = _design(features)
    eta = sum((F.col("beta")[i] * F.expr(f) for i, f in enumerate(x)), F.lit(0.0))
    return df.join(beta, list(keys)).withColumn("probability", 1 / (1 + F.exp(-eta))).drop("beta")
