"""Folds, sweeps, selections and models on the candles of ``events`` and the labels of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shared import checkpointed
from tidemark.functions.windows import ordered
from tidemark.operators import features as X
from tidemark.operators import ledger as L
from tidemark.operators import text as T
from tidemark.plans import experiments as E
from tidemark.plans import validation as V
from tidemark.plans.ledger_queries import SIGNALS, chain, met, signals
from tidemark.plans.market_queries import BARS, RET, VOL, W, bars
from tidemark.plans.base import query, result, scientific

SIZES = "sizes AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)"


def sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BARS}, p AS (SELECT symbol, t, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars {W}) SELECT symbol, t, CASE WHEN pos < n - greatest(1, least(n - 1, ceil(n * 0.2))) THEN 'development' ELSE 'holdout' END AS part FROM p")
def validation_holdout_split(spark, sf_dir):
    return result(V.split_holdout(bars(spark, sf_dir)), "symbol", "timestamp", "part")


def _folds(train: int, test: int, step: int, window: int | None = None, gap: int = 0, full: bool = False) -> str:
    start = f"{train + gap} + fold * {step}"
    last = f"n - {test if full else 1}"
    low = f"greatest(0, {start} - {gap} - {window})" if window else "0"
    return f"SELECT symbol, n, fold::INT AS fold, ({start})::BIGINT AS test_start, least(n, {start} + {test})::BIGINT AS test_end, ({start} - {gap})::BIGINT AS train_end, ({low})::BIGINT AS train_start FROM sizes, range(0, 10000) r(fold) WHERE {start} <= {last}"


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c not in ("symbol", "fold") else F.col(c) for c in df.columns])


@query(f"WITH {BARS}, {SIZES} {_folds(300, 60, 60)}")
def validation_walk_forward(spark, sf_dir):
    return _longs(V.walk_forward(sizes(bars(spark, sf_dir)), 300, 60, 60))


@query(f"WITH {BARS}, {SIZES} {_folds(200, 50, 25, 150, 12, True)}")
def validation_rolling_purged(spark, sf_dir):
    return _longs(V.walk_forward(sizes(bars(spark, sf_dir)), 200, 50, 25, window=150, gap=12, full_only=True))


@query(f"WITH {BARS}, {SIZES} SELECT symbol, n, fold::INT AS fold, (n * fold // 5)::BIGINT AS test_start, (n * (fold + 1) // 5)::BIGINT AS test_end, greatest(0, n * fold // 5 - 24)::BIGINT AS train_before_end, least(n, n * (fold + 1) // 5 + 24)::BIGINT AS train_after_start FROM sizes, range(0, 5) r(fold)")
def validation_purged_kfold(spark, sf_dir):
    return _longs(V.purged_kfold(sizes(bars(spark, sf_dir)), 5, 24))


@query(f"WITH {BARS}, {SIZES}, f AS ({_folds(300, 60, 60)}), p AS (SELECT symbol, t, row_number() OVER w - 1 AS pos FROM bars {W}) SELECT f.symbol, fold, count(*) AS n_rows, min(t) AS first_t, max(t) AS last_t FROM f JOIN p ON p.symbol = f.symbol AND pos >= test_start AND pos < test_end GROUP BY 1, 2")
def validation_fold_rows(spark, sf_dir):
    b = bars(spark, sf_dir)
    rows = V.assign_folds(b, V.walk_forward(sizes(b), 300, 60, 60))
    return rows.groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.unix_seconds("timestamp")).alias("first_t"), F.max(F.unix_seconds("timestamp")).alias("last_t"))


TRUTH = "tru AS (SELECT lang, quality AS target, (d.n_chars > 600)::INT AS predicted FROM labels l JOIN documents d USING (doc_id))"


@query(f"WITH {TRUTH}, c AS (SELECT lang, count(*) AS n, count(*) FILTER (target = 1 AND predicted = 1) AS tp, count(*) FILTER (target != 1 AND predicted = 1) AS fp, count(*) FILTER (target = 1 AND predicted != 1) AS fn, count(*) FILTER (target != 1 AND predicted != 1) AS tn FROM tru GROUP BY lang) SELECT *, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def validation_classification(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = labels.join(docs, "doc_id").select("lang", F.col("quality").alias("target"), (F.col("n_chars") > 600).cast("int").alias("predicted"))
    return result(V.classification_metrics(rows, ["lang"]))


@query(f"WITH {BARS}, {SIGNALS} SELECT symbol, round(min(p), 6) AS p_min, round(max(p), 6) AS p_max, round(avg(p), 6) AS p_mean, round(stddev_pop(p), 6) AS p_std, count(p) AS n FROM sig GROUP BY symbol")
def validation_probabilities(spark, sf_dir):
    return result(V.probability_diagnostics(signals(spark, sf_dir), ["symbol"]))


THRESHOLDS = [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55]
SWEEP = f"fo AS ({_folds(300, 60, 60)}), pp AS (SELECT *, row_number() OVER w - 1 AS pos_ FROM sig {W}), fr AS (SELECT pp.* EXCLUDE (signal), fold FROM fo JOIN pp ON pp.symbol = fo.symbol AND pos_ >= test_start AND pos_ < test_end), th AS (SELECT fr.*, threshold, (p >= threshold)::INT AS signal FROM fr, (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold))"
FKEY = "symbol, fold, threshold"


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).drop("signal")
    rows = V.assign_folds(s, V.walk_forward(sizes(s), 300, 60, 60)).drop("pos")
    return V.threshold_sweep(rows, THRESHOLDS, ["symbol", "fold"])


@query(f"WITH {BARS}, {SIGNALS}, {SIZES}, {SWEEP}, {chain('th', FKEY)}, {met(FKEY)} SELECT symbol, fold, threshold, printf('%.6e', total_return) AS total_return, round(max_drawdown, 6) AS max_drawdown, round(exposure, 6) AS exposure, coalesce(n_trades, 0) AS n_trades FROM met LEFT JOIN mef USING ({FKEY})")
def validation_threshold_sweep(spark, sf_dir):
    rows = sweep(spark, sf_dir).withColumn("total_return", scientific("total_return", 6))
    return result(rows, "symbol", "fold", "threshold", "total_return", "max_drawdown", "exposure", "n_trades")


SUMMARY = f"su AS (SELECT symbol, threshold, sum(coalesce(n_trades, 0))::BIGINT AS n_trades, median(total_return) AS median_return, median(max_drawdown) AS median_drawdown, median(coalesce(notional, 0) / first_equity) AS median_turnover, count(*) AS n_folds FROM met LEFT JOIN mef USING ({FKEY}) GROUP BY 1, 2), el AS (SELECT *, (n_trades > 0 AND median_return >= 0)::INT AS eligible FROM su)"


RISEN = f"ri AS (SELECT symbol, t, (lead(close) OVER w / close - 1 > 0.003)::INT AS target FROM bars {W}), cl AS (SELECT symbol, threshold, fold, count(*) FILTER (target = 1 AND signal = 1) AS tp, count(*) FILTER (target = 0 AND signal = 1) AS fp, count(*) FILTER (target = 1 AND signal = 0) AS fn FROM th JOIN ri USING (symbol, t) WHERE target IS NOT NULL GROUP BY ALL), mn AS (SELECT symbol, threshold, avg(coalesce(tp / nullif(tp + fp, 0), 0)) AS p, avg(coalesce(tp / nullif(tp + fn, 0), 0)) AS c, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f FROM cl GROUP BY ALL)"


@query(f"WITH {BARS}, {SIGNALS}, {SIZES}, {SWEEP}, {chain('th', FKEY)}, {met(FKEY)}, {SUMMARY}, {RISEN} SELECT symbol, threshold, n_trades, printf('%.6e', median_return) AS median_return, round(median_drawdown, 6) AS median_drawdown, n_folds, eligible, round(p, 6) AS mean_precision, round(c, 6) AS mean_recall, round(f, 6) AS mean_f1 FROM el JOIN mn USING (symbol, threshold) UNION ALL SELECT symbol, 0.99, 0, NULL, NULL, 0, 0, NULL, NULL, NULL FROM (SELECT DISTINCT symbol FROM el)")
def validation_threshold_summary(spark, sf_dir):
    """Per threshold the medians and means over the folds; a threshold that was not swept is listed without folds."""
    rose = (F.lead("close").over(ordered()) / F.col("close") - 1 > 0.003).cast("int")
    s = signals(spark, sf_dir).drop("signal").withColumn("target", rose)
    m = V.threshold_sweep(V.assign_folds(s, V.walk_forward(sizes(s), 300, 60, 60)).drop("pos"), THRESHOLDS, ["symbol", "fold"])
    rows = V.summarize_thresholds(m, ["symbol"], thresholds=[*THRESHOLDS, 0.99])
    shown = F.when(F.col("median_return").isNotNull(), scientific("median_return", 6))
    return result(rows.withColumn("median_return", shown), "symbol", "threshold", "n_trades", "median_return", "median_drawdown", "n_folds", "eligible", "mean_precision", "mean_recall", "mean_f1")


@query(f"WITH {BARS}, {SIGNALS}, {SIZES}, {SWEEP}, {chain('th', FKEY)}, {met(FKEY)}, {SUMMARY}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY median_return DESC, abs(median_drawdown), median_turnover, threshold) AS rank FROM el WHERE eligible = 1) SELECT symbol, threshold FROM r WHERE rank = 1")
def validation_threshold_selection(spark, sf_dir):
    return V.select_threshold(V.summarize_thresholds(sweep(spark, sf_dir), ["symbol"]), ["symbol"]).select("symbol", "threshold")


HORIZONS, COSTS, VOLS = (1, 3, 6, 12, 24), {"none": 0.0, "one_way": 0.0015, "round_trip": 0.003}, (0.0, 0.05, 0.1)


@query(f"""WITH {BARS}, {RET}, {VOL}, h AS ({' UNION ALL '.join(f"SELECT symbol, t, realized_volatility_24h AS v, {h} AS horizon, lead(close, {h}) OVER w / close - 1 AS nr FROM vol {W}" for h in HORIZONS)}),
 g AS (SELECT * FROM (VALUES ('none', 0.0::DOUBLE), ('one_way', 0.0015::DOUBLE), ('round_trip', 0.003::DOUBLE)) c(cost, c), (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) m(vol_mult))
 SELECT horizon, cost, vol_mult, count(nr > c + vol_mult * v) AS n_labeled, count(*) FILTER (nr > c + vol_mult * v) AS n_positive FROM h, g GROUP BY 1, 2, 3""")
def experiment_label_grid(spark, sf_dir):
    rows = V.label_grid(X.realized_vol(X.returns(bars(spark, sf_dir), [1])), HORIZONS, COSTS, VOLS)
    return rows.groupBy("horizon", "cost", "vol_mult").agg(F.count("target").alias("n_labeled"), F.count_if(F.col("target") == 1).alias("n_positive"))


MODEL = ["return_1h", "return_3h", "return_6h", "realized_volatility_24h", "volume_ratio_24h"]


@query()
def model_walk_forward_logistic(spark, sf_dir):
    """One logistic model per symbol and fold, all fitted in one job, scored on the fold's test rows."""
    b = X.volume_ratio(X.realized_vol(X.returns(bars(spark, sf_dir))))
    b = X.label(b, 1, 0.003, 0.1)
    folds = V.walk_forward(sizes(b), 300, 60, 60)
    keys = ["symbol", "fold"]
    spans = folds.select("symbol", "fold", "train_start", "train_end", "test_start", "test_end")
    rows = V.positions(b).join(spans, "symbol").where("pos >= train_start and pos < test_end and (pos < train_end or pos >= test_start)")
    rows = rows.withColumn("is_train", (F.col("pos") < F.col("train_end")).cast("int")).where("target is not null")
    scaled = checkpointed(V.standardize(rows.select(*keys, "timestamp", "is_train", F.col("target").cast("double").alias("target"), *MODEL), MODEL, keys))
    beta = V.fit_logistic(scaled.where("is_train = 1"), MODEL, keys)
    tested = V.predict(scaled.where("is_train = 0"), beta, MODEL, keys).withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))
    return result(V.classification_metrics(tested, keys))


@query(f"WITH {BARS}, d AS (SELECT t, percent_rank() OVER (ORDER BY t) AS r FROM (SELECT DISTINCT t FROM bars)) SELECT symbol, bars.t, CASE WHEN r < 0.6 THEN 'train' ELSE 'test' END AS part FROM bars JOIN d ON d.t = bars.t")
def validation_time_cut(spark, sf_dir):
    return result(E.time_cut(bars(spark, sf_dir), 0.6), "symbol", "timestamp", "part")


@query(f"WITH {BARS}, {SIGNALS}, r AS (SELECT *, close / lag(close, 24) OVER w - 1 AS tr FROM sig {W}) SELECT symbol, t, round(CASE WHEN tr < 0 THEN 1 - p WHEN tr >= 0 THEN p END, 6) AS probability, round(CASE WHEN tr < 0 THEN -1 WHEN tr >= 0 THEN p END, 6) AS bull_only FROM r")
def experiment_regime_routing(spark, sf_dir):
    rows = X.regime(signals(spark, sf_dir)).withColumn("up", F.col("probability")).withColumn("down", 1 - F.col("probability"))
    cash = E.route_by_regime(rows, {"bull": "up"}, bull_only=True).withColumnRenamed("probability", "bull_only")
    return result(E.route_by_regime(cash, {"bull": "up", "bear": "down"}), "symbol", "timestamp", "probability", "bull_only")


VARIANTS = f"var AS (SELECT symbol, t, open, high, low, close, signal, 'base' AS variant FROM sig UNION ALL SELECT symbol, t, open, high, low, close, 1 - signal, 'inverse' FROM sig UNION ALL SELECT symbol, t, open, high, low, close, CASE WHEN (t // 3600) % 24 < 12 THEN signal ELSE 0 END, 'mornings' FROM sig)"  # noqa: F541
VKEY = "symbol, variant"


@query(f"""WITH {BARS}, {SIGNALS}, {VARIANTS}, {chain('var', VKEY)}, {met(VKEY)}, tu AS (SELECT met.*, coalesce(notional, 0) / first_equity AS turnover FROM met LEFT JOIN mef USING (symbol, variant)), c AS (SELECT a.symbol, a.variant, a.total_return - b.total_return AS d, a.turnover AS ta, b.turnover AS tb FROM tu a JOIN tu b ON b.symbol = a.symbol AND b.variant = 'base' WHERE a.variant != 'base')
 SELECT variant, count(*) AS n_folds, count(*) FILTER (d > 0) AS n_improved, concat_ws(',', CASE WHEN count(*) FILTER (d > 0) < 0.5 * count(*) THEN 'few_folds_improved' END, CASE WHEN median(d) <= 0 THEN 'no_median_gain' END, CASE WHEN sum(ta) / nullif(sum(tb), 0) > 1.5 THEN 'turnover' END) AS reasons FROM c GROUP BY 1""")
def experiment_gate(spark, sf_dir):
    """Signal variants as a key of one ledger query, each compared with the baseline per symbol."""
    morning = F.when(F.floor(F.unix_seconds("timestamp") / 3600) % 24 < 12, F.col("signal")).otherwise(0)
    rows = E.run_grid(signals(spark, sf_dir), {"base": lambda d: d, "inverse": lambda d: d.withColumn("signal", 1 - F.col("signal")), "mornings": lambda d: d.withColumn("signal", morning)})
    by = ["symbol", "variant"]
    m = L.metrics(L.equity(rows, by), L.trades(rows, by), by)
    return E.gate(E.against_baseline(m, "base", ["symbol"]), ["variant"]).select("variant", "n_folds", "n_improved", "reasons")


@query()
def experiment_model_classes(spark, sf_dir):
    """Logistic regression, forests and boosted trees in small grids: folds, sweep, rank, and whether one may replace the
    logistic model, per symbol."""
    b = X.label(X.volume_ratio(X.realized_vol(X.returns(bars(spark, sf_dir)))), 1, 0.003, 0.1)
    specs = E.model_grid((3,), (20,), (2,))
    scored = E.score_grid(checkpointed(b.select("symbol", "timestamp", "open", "close", "target", *MODEL)), MODEL, specs)
    m = checkpointed(V.against_holding(scored.select("symbol", "variant", "fold", "timestamp", "open", "close", "probability"), ["symbol", "variant", "fold"], THRESHOLDS))
    order = F.element_at(F.create_map(*[x for i, n in enumerate(specs) for x in (F.lit(n), F.lit(i))]), F.col("variant"))
    return E.promote(V.select_and_confirm(m, ["symbol", "variant"], "return", among=["symbol"], candidate_order=[order]), m, "logistic")


FOLD_TEXT = " || ".join(f"length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR" for c in ("fold", "n", "symbol", "test_end", "test_start", "train_end", "train_start"))


@query(f"WITH {BARS}, {SIZES}, f AS ({_folds(300, 60, 60)}), h AS (SELECT sha256({FOLD_TEXT}) AS h FROM f) SELECT count(*) AS n, " + ", ".join(f"sum(('0x' || substr(h, {16 * k + 1}, 16))::UBIGINT)::VARCHAR AS digest_{k}" for k in range(4)) + " FROM h")
def validation_fold_signature(spark, sf_dir):
    """A hash of all folds' bounds, whatever their order: equal folds, equal signature."""
    folds = _longs(V.walk_forward(sizes(bars(spark, sf_dir)), 300, 60, 60))
    return T.content_hash(folds, sorted(folds.columns))


@query(f"WITH {BARS}, {SIGNALS}, v AS (SELECT symbol, t, p, CASE WHEN volume > 1 THEN 1 / (1 + exp(-(close / open - 1))) END AS q FROM sig) SELECT symbol, t, round(CASE WHEN q IS NULL THEN p ELSE (p + q) / 2 END, 6) AS probability FROM v")
def model_soft_vote(spark, sf_dir):
    """The mean of two scores, one of which some bars lack."""
    rows = signals(spark, sf_dir).withColumn("p", F.col("probability")).withColumn("q", F.when(F.col("volume") > 1, 1 / (1 + F.exp(-(F.col("close") / F.col("open") - 1)))))
    return result(E.soft_vote(rows, ["p", "q"]), "symbol", "timestamp", "probability")
