"""Experiments with fitted models: candidates, folds, thresholds and symbols are keys, a whole experiment is one sweep.

The SQL fits the models as well: ten Newton steps as grouped sums, each solved by Gauss-Jordan elimination on lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shared import checkpointed
from tidemark.functions.windows import change, ordered
from tidemark.operators import features as X
from tidemark.operators import text as T
from tidemark.operators.candles import interval_seconds, resample_many
from tidemark.plans import experiments as E
from tidemark.plans import models as M
from tidemark.plans import validation as V
from tidemark.plans.base import query, result, scientific
from tidemark.plans.ledger_queries import SIGNALS, chain, met, signals
from tidemark.plans.market_queries import BARS, RET, VOL, W, bars, win
from tidemark.plans.text_queries import POSTS, scored
from tidemark.plans.validation_queries import THRESHOLDS

INTERVAL_GATE, REGIME_GATE, RETURN_GATE = "r > 0 AND r > b AND e <= 0.9", "r > 0 AND r > b", "r >= 0"
DON = "threshold, n_trades, median_return, median_exposure, holdout_total_return, holdout_buy_hold_return, holdout_n_trades, decision, rank"


def folds_sql(source: str, key: str, train: int, test: int, step: int) -> str:
    """SQL of the scored rows by fold (holdout: -1): ``source`` has key, t, open, high, low, close, p; table fr."""
    pk, start = f"PARTITION BY {key}", f"({train} + fold * {step})"
    return f"""sp AS (SELECT *, row_number() OVER ({pk} ORDER BY t) - 1 AS pos_, count(*) OVER ({pk}) AS n_ FROM {source}), hs AS (SELECT *, n_ - greatest(1, least(n_ - 1, ceil(n_ * 0.2)))::BIGINT AS dev FROM sp),
 fr AS (SELECT {key}, t, open, high, low, close, p, fold::INT AS fold FROM hs, range(0, 500) r(fold) WHERE {start} <= dev - 1 AND pos_ >= {start} AND pos_ < least(dev, {start} + {test}) UNION ALL SELECT {key}, t, open, high, low, close, p, -1 FROM hs WHERE pos_ >= dev)"""


def confirm_sql(key: str, gate: str, among: str = "", order: str = "", exposure: bool = False) -> str:
    """SQL of the sweep, selection, ranking and decision on fr; table don."""
    k, e = f"{key}, fold, threshold", "round(e, 9), " if exposure else ""
    part = f"PARTITION BY {among}, threshold IS NULL" if among else "PARTITION BY threshold IS NULL"
    return f"""th AS (SELECT fr.*, threshold, (p >= threshold)::INT AS signal FROM fr, (SELECT unnest({[V.ALWAYS, *THRESHOLDS]}::DOUBLE[]) AS threshold)), {chain("th", k)}, {met(k)},
 me AS MATERIALIZED (SELECT {k}, total_return, max_drawdown, exposure, coalesce(n_trades, 0) AS n, coalesce(notional, 0) / first_equity AS turnover FROM met LEFT JOIN mef USING ({k})), bh AS (SELECT {key}, fold, total_return AS bh FROM me WHERE threshold = -1),
 su AS (SELECT {key}, threshold, sum(n)::BIGINT AS n, median(total_return) AS r, median(bh) AS b, median(max_drawdown) AS d, median(turnover) AS tu, median(exposure) AS e FROM me JOIN bh USING ({key}, fold) WHERE fold >= 0 AND threshold >= 0 GROUP BY ALL),
 sel AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(r, 9) DESC, abs(round(d, 9)), round(tu, 9), {e}threshold) AS place FROM su WHERE n > 0 AND {gate}),
 fin AS (SELECT {key}, threshold, sel.n, r, d, tu, e, h.total_return AS hr, h.bh AS hb, h.n AS hn, h.max_drawdown AS hd, h.turnover AS ht FROM (SELECT DISTINCT {key} FROM me) LEFT JOIN (SELECT * FROM sel WHERE place = 1) sel USING ({key}) LEFT JOIN (SELECT * FROM me JOIN bh USING ({key}, fold) WHERE fold = -1) h USING ({key}, threshold)),
 ran AS (SELECT *, CASE WHEN threshold IS NOT NULL THEN row_number() OVER ({part} ORDER BY round(r, 9) DESC, abs(round(d, 9)), round(tu, 9), {e}{order or key}) END AS place FROM fin),
 don AS (SELECT {key}, threshold, n AS n_trades, printf('%.5e', round(r, 9)) AS median_return, round(e, 6) AS median_exposure, printf('%.5e', hr) AS holdout_total_return, printf('%.5e', hb) AS holdout_buy_hold_return, hn::BIGINT AS holdout_n_trades, CASE WHEN place = 1 THEN CASE WHEN hr > 0 AND hr > hb THEN 'confirmed' ELSE 'not_confirmed' END END AS decision, place::INT AS rank FROM ran)"""


def confirmed(m: DataFrame, keys: Sequence[str], kind: str, among: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    rows = V.select_and_confirm(m, keys, kind, among=among, candidate_order=order)
    shown = {c: F.when(F.col(c).isNotNull(), scientific(c, 5)) for c in ("median_return", "holdout_total_return", "holdout_buy_hold_return")}
    return result(rows.withColumns(shown), *keys, *DON.split(", "))


@query(f"WITH {BARS}, {SIGNALS}, {folds_sql('sig', 'symbol', 300, 60, 60)}, {confirm_sql('symbol', RETURN_GATE)} SELECT symbol, {DON} FROM don")
def experiment_holdout_evaluation(spark, sf_dir):
    """The threshold selected on the development folds, evaluated on the holdout beside buy and hold."""
    return confirmed(V.evaluate_grid(signals(spark, sf_dir).drop("signal"), ["symbol"], THRESHOLDS, 300, 60, 60), ["symbol"], "return")


# Fitted candidates.


def newton_sql(design: str, cells: str, n: int, steps: int = 10) -> str:
    """SQL of the coefficients of every cell: ``design`` has the cells' columns, target, is_train, pen and x1 .. xn; table fit."""
    xs = ["1.0", *[f"x{i}" for i in range(1, n + 1)]]
    k, parts = len(xs), []
    eta = " + ".join(f"b[{i + 1}] * {x}" for i, x in enumerate(xs))
    entry = lambda i, j: f"pen * sum(w * {xs[min(i, j)]} * {xs[max(i, j)]}) + {int(i == j)}"
    rows = ", ".join("[" + ", ".join([entry(i, j) for j in range(k)] + [f"pen * sum((target - q) * {xs[i]}) - b[{i + 1}]"]) + "]" for i in range(k))
    parts.append(f"ok AS MATERIALIZED (SELECT {cells} FROM {design} WHERE is_train = 1 GROUP BY ALL HAVING count(*) >= 20 AND sum(target) > 0 AND sum(target) < count(*)), b0 AS (SELECT {cells}, {[0.0] * k}::DOUBLE[] AS b FROM ok)")
    for s in range(steps):
        m = f"(SELECT {cells}, b, [{rows}] AS m FROM (SELECT *, q * (1 - q) AS w FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS q FROM {design} JOIN b{s} USING ({cells}) WHERE is_train = 1)) GROUP BY {cells}, b, pen)"
        for j in range(1, k + 1):
            m = f"(SELECT {cells}, b, list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = {j} THEN list_transform(m[{j}], lambda v: v / m[{j}][{j}]) ELSE list_transform(range(1, {k + 2}), lambda c: m[i][c] - m[i][{j}] / m[{j}][{j}] * m[{j}][c]) END) AS m FROM {m})"
        parts.append(f"b{s + 1} AS MATERIALIZED (SELECT {cells}, list_transform(range(1, {k + 1}), lambda i: b[i] + m[i][{k + 1}]) AS b FROM {m})")
    return ", ".join(parts) + f", fit AS (SELECT * FROM b{steps})"


def fitted_sql(source: str, key: str, candidates: list[dict], train: int, test: int, step: int) -> str:
    """SQL of fit_and_route: ``source`` has key, t, open, high, low, close, target and the features; tables fit, fr.
    A candidate: name, features, and SQL of state, cash, window, c."""
    names = sorted({f for c in candidates for f in c["features"]})
    pk, start, cells = f"PARTITION BY {key}", f"({train} + fold * {step})", f"{key}, variant, fold, cell"
    each = " UNION ALL ".join(
        f"SELECT {key}, t, open, high, low, close, target, fold, is_train, '{c['name']}' AS variant, {c.get('state', chr(39) + 'all' + chr(39))} AS cell, {c.get('cash', 'false')} AS in_cash, {c.get('c', 1.0)}::DOUBLE AS pen, {', '.join((f if f in c['features'] else '0.0') + '::DOUBLE AS ' + f for f in names)} FROM sm WHERE target IS NOT NULL AND {c.get('state', 'true')} IS NOT NULL AND (is_train = 0 OR age <= {c.get('window', 10**9)})"
        for c in candidates
    )
    return f"""sp AS (SELECT *, row_number() OVER ({pk} ORDER BY t) - 1 AS pos_, count(*) OVER ({pk}) AS n_ FROM {source}), hs AS (SELECT *, n_ - greatest(1, least(n_ - 1, ceil(n_ * 0.2)))::BIGINT AS dev FROM sp),
 sm AS MATERIALIZED (SELECT hs.*, fold::INT AS fold, (pos_ < {start})::INT AS is_train, {start} - pos_ AS age FROM hs, range(0, 500) r(fold) WHERE {start} <= dev - 1 AND pos_ < least(dev, {start} + {test}) UNION ALL SELECT hs.*, -1, (pos_ < dev)::INT, dev - pos_ FROM hs),
 ca AS MATERIALIZED ({each}),
 md AS (SELECT {cells}, {', '.join(f'median({f}) AS m_{f}' for f in names)} FROM ca WHERE is_train = 1 GROUP BY ALL),
 fi AS MATERIALIZED (SELECT ca.* REPLACE ({', '.join(f'coalesce({f}, m_{f}, 0) AS {f}' for f in names)}) FROM ca LEFT JOIN md USING ({cells})),
 mo AS (SELECT {cells}, {', '.join(f'avg({f}) AS a_{f}, stddev_pop({f}) AS s_{f}' for f in names)} FROM fi WHERE is_train = 1 GROUP BY ALL),
 sc AS MATERIALIZED (SELECT {cells}, t, open, high, low, close, target, is_train, in_cash, pen, {', '.join(f'coalesce(({f} - a_{f}) / nullif(s_{f}, 0), 0) AS x{i}' for i, f in enumerate(names, 1))} FROM fi LEFT JOIN mo USING ({cells})),
 {newton_sql('sc', cells, len(names))},
 ro AS MATERIALIZED (SELECT sc.*, b FROM sc LEFT JOIN fit USING ({cells}) WHERE is_train = 0), sk AS (SELECT DISTINCT {key}, variant, fold FROM ro WHERE b IS NULL),
 fr AS MATERIALIZED (SELECT {key}, variant, fold, t, open, high, low, close, CASE WHEN in_cash THEN -1.0 ELSE 1 / (1 + exp(-(b[1] + {' + '.join(f'b[{i + 1}] * x{i}' for i in range(1, len(names) + 1))}))) END AS p FROM ro ANTI JOIN sk USING ({key}, variant, fold))"""


def compared(rows: DataFrame, candidates: list[M.Candidate], keys: list[str], folds: tuple[int, int, int], kind: str, among: Sequence[str]) -> DataFrame:
    """Fits, routes, sweeps, selects and confirms all candidates; their order is the one that is given."""
    scored_rows, _ = M.fit_and_route(rows, candidates, keys, *folds)
    order = F.element_at(F.create_map(*[x for i, c in enumerate(candidates) for x in (F.lit(c.name), F.lit(i))]), F.col("variant"))
    m = V.against_holding(scored_rows.select(*keys, "variant", "fold", "timestamp", "open", "high", "low", "close", "probability"), [*keys, "variant", "fold"], THRESHOLDS)
    return confirmed(m, [*keys, "variant"], kind, among, [order, *keys])


def _order(candidates: list[dict]) -> str:
    return "CASE variant " + " ".join(f"WHEN '{c['name']}' THEN {i}" for i, c in enumerate(candidates)) + " END"


def labeled(rows: DataFrame) -> DataFrame:
    return X.label(rows, 1, 0.003, 0.1)


LABELED = f"lb AS (SELECT *, CASE WHEN nr IS NOT NULL AND realized_volatility_24h IS NOT NULL THEN (nr > 0.003 + 0.1 * realized_volatility_24h)::INT END AS target FROM (SELECT *, lead(close) OVER w / close - 1 AS nr, close / lag(close, 24) OVER w - 1 AS tr, volume / ({win('avg(volume)', 24)}) AS volume_ratio_24h FROM vol {W}))"
FOLDS = (300, 60, 60)

REGIME_FEATURES = ["return_1h", "return_6h", "volume_ratio_24h"]
_BULL = "CASE WHEN tr >= 0 THEN 'bull' WHEN tr < 0 THEN 'bear' END"
REGIME_SQL = [dict(name="global", features=REGIME_FEATURES), dict(name="cash_in_bear", features=REGIME_FEATURES, cash="tr < 0"), dict(name="specialists", features=REGIME_FEATURES, state=_BULL)]


@query(f"WITH {BARS}, {RET}, {VOL}, {LABELED}, src AS (SELECT * FROM lb WHERE tr IS NOT NULL), {fitted_sql('src', 'symbol', REGIME_SQL, *FOLDS)}, {confirm_sql('symbol, variant', REGIME_GATE, 'symbol', _order(REGIME_SQL))} SELECT symbol, variant, {DON} FROM don")
def experiment_regime_specialists(spark, sf_dir):
    """One model for all bars, the same with cash in falling markets, and one model for each regime."""
    rows = X.regime(labeled(X.volume_ratio(X.realized_vol(X.returns(bars(spark, sf_dir)))))).where("regime is not null")
    features = tuple(REGIME_FEATURES)
    candidates = [M.Candidate("global", features), M.Candidate("cash_in_bear", features, cash=F.col("regime") == "bear"), M.Candidate("specialists", features, state="regime")]
    return compared(rows, candidates, ["symbol"], FOLDS, "regime", ["symbol"])


PROMOTION = """base AS (SELECT symbol, threshold AS bt, round(r, 9) AS br, round(d, 9) AS bd, round(tu, 9) AS btu, hr AS bhr, hd AS bhd FROM ran WHERE variant = 'baseline'),
 better AS (SELECT a.symbol, a.variant, a.threshold, count(*) AS n_improved FROM me a JOIN me b ON b.symbol = a.symbol AND b.fold = a.fold AND b.threshold = a.threshold AND b.variant = 'baseline' WHERE a.fold >= 0 AND round(a.total_return, 9) > round(b.total_return, 9) GROUP BY ALL),
 judged AS (SELECT ran.symbol, ran.variant, ran.threshold, ran.place, coalesce(n_improved, 0) AS n_improved, CASE WHEN bt IS NULL THEN 'baseline_without_threshold' WHEN ran.threshold IS NULL THEN 'no_threshold' ELSE concat_ws(',', CASE WHEN coalesce(n_improved, 0) < 2 THEN 'few_folds_improved' END, CASE WHEN round(r, 9) <= br THEN 'no_median_gain' END, CASE WHEN round(r, 9) <= 0 THEN 'not_above_cash' END,
  CASE WHEN abs(round(d, 9)) > abs(bd) + 0.02 THEN 'drawdown' END, CASE WHEN round(tu, 9) > greatest(btu * 1.5, btu + 2) THEN 'turnover' END, CASE WHEN NOT coalesce(round(hr, 9) > round(bhr, 9), false) THEN 'holdout_return' END, CASE WHEN NOT coalesce(abs(hd) <= abs(bhd) + 0.02, false) THEN 'holdout_drawdown' END, CASE WHEN NOT coalesce(ht <= greatest(btu * 2, btu + 4), false) THEN 'holdout_turnover' END) END AS reasons
  FROM ran LEFT JOIN base USING (symbol) LEFT JOIN better ON better.symbol = ran.symbol AND better.variant = ran.variant AND better.threshold = ran.threshold WHERE ran.variant != 'baseline')"""

GROUPED = {"baseline": ["return_1h"], "momentum_reversal": ["return_1h", "return_3h", "return_12h"], "volatility": ["return_1h", "realized_volatility_24h"], "volume": ["return_1h", "volume_ratio_24h"]}
# fewer features first, then the name
GROUP_SQL = sorted((dict(name=n, features=f) for n, f in GROUPED.items()), key=lambda c: (len(c["features"]), c["name"]))


@query(f"WITH {BARS}, {RET}, {VOL}, {LABELED}, {fitted_sql('lb', 'symbol', GROUP_SQL, *FOLDS)}, {confirm_sql('symbol, variant', RETURN_GATE, 'symbol', _order(GROUP_SQL))} SELECT symbol, variant, {DON} FROM don")
def experiment_feature_groups(spark, sf_dir):
    """The baseline and one more group of features at a time; of equal candidates the one with fewer features is first."""
    rows = labeled(X.volume_ratio(X.realized_vol(X.returns(bars(spark, sf_dir)))))
    return compared(rows, [M.Candidate(c["name"], tuple(c["features"])) for c in GROUP_SQL], ["symbol"], FOLDS, "return", ["symbol"])


@query(f"WITH {BARS}, {RET}, {VOL}, {LABELED}, {fitted_sql('lb', 'symbol', GROUP_SQL, *FOLDS)}, {confirm_sql('symbol, variant', RETURN_GATE, 'symbol', _order(GROUP_SQL))}, {PROMOTION} SELECT symbol, variant, threshold, place::INT AS rank, n_improved, reasons, (reasons = '' AND row_number() OVER (PARTITION BY symbol, reasons ORDER BY place NULLS FIRST) = 1)::INT AS promoted FROM judged")
def experiment_promotion(spark, sf_dir):
    """Whether a candidate with one more group of features may replace the baseline, with the rules that it fails."""
    rows = labeled(X.volume_ratio(X.realized_vol(X.returns(bars(spark, sf_dir)))))
    candidates = [M.Candidate(c["name"], tuple(c["features"])) for c in GROUP_SQL]
    scored_rows, _ = M.fit_and_route(rows, candidates, ["symbol"], *FOLDS)
    m = checkpointed(V.against_holding(scored_rows.select("symbol", "variant", "fold", "timestamp", "open", "high", "low", "close", "probability"), ["symbol", "variant", "fold"], THRESHOLDS))
    order = F.element_at(F.create_map(*[x for i, c in enumerate(candidates) for x in (F.lit(c.name), F.lit(i))]), F.col("variant"))
    return E.promote(V.select_and_confirm(m, ["symbol", "variant"], "return", among=["symbol"], candidate_order=[order]), m, "baseline")


IMPORTANT = ["return_1h", "return_6h", "volume_ratio_24h"]


@query(f"""WITH {BARS}, {RET}, {VOL}, {LABELED}, sp AS (SELECT *, row_number() OVER w - 1 AS pos_, count(*) OVER (PARTITION BY symbol) AS n_ FROM lb {W}), ca AS (SELECT *, (pos_ < 0.6 * n_)::INT AS is_train, 1.0 AS pen FROM sp WHERE target IS NOT NULL),
 md AS (SELECT symbol, {', '.join(f'median({f}) AS m_{f}' for f in IMPORTANT)} FROM ca WHERE is_train = 1 GROUP BY ALL), fi AS (SELECT ca.* REPLACE ({', '.join(f'coalesce({f}, m_{f}, 0) AS {f}' for f in IMPORTANT)}) FROM ca LEFT JOIN md USING (symbol)), mo AS (SELECT symbol, {', '.join(f'avg({f}) AS a_{f}, stddev_pop({f}) AS s_{f}' for f in IMPORTANT)} FROM fi WHERE is_train = 1 GROUP BY ALL),
 sc AS MATERIALIZED (SELECT symbol, t, target, is_train, pen, {', '.join(f'coalesce(({f} - a_{f}) / nullif(s_{f}, 0), 0) AS x{i}' for i, f in enumerate(IMPORTANT, 1))} FROM fi LEFT JOIN mo USING (symbol)), {newton_sql('sc', 'symbol', 3)},
 te AS (SELECT sc.*, b, b[1] + b[2] * x1 + b[3] * x2 + b[4] * x3 AS eta FROM sc JOIN fit USING (symbol) WHERE is_train = 0), lo AS ({' UNION ALL '.join(f"SELECT symbol, t, target, eta, '{f}' AS feature, x{i} AS x, b[{i + 1}] AS bx FROM te" for i, f in enumerate(IMPORTANT, 1))}),
 gi AS (SELECT symbol, feature, x AS given, row_number() OVER (PARTITION BY symbol, feature ORDER BY md5('7:' || feature || ':' || t)) AS place FROM lo), ta AS (SELECT *, row_number() OVER (PARTITION BY symbol, feature ORDER BY md5('7:' || t)) AS place FROM lo),
 pr AS (SELECT symbol, feature, target, 1 / (1 + exp(-eta)) AS p, 1 / (1 + exp(-(eta + bx * (given - x)))) AS q FROM ta JOIN gi USING (symbol, feature, place)),
 im AS (SELECT symbol, feature, avg(-ln(CASE WHEN target = 1 THEN q ELSE 1 - q END)) - avg(-ln(CASE WHEN target = 1 THEN p ELSE 1 - p END)) AS importance, avg(((p >= 0.5) = (target = 1))::INT) - avg(((q >= 0.5) = (target = 1))::INT) AS accuracy_drop FROM pr GROUP BY ALL)
 SELECT symbol, feature, round(importance, 6) AS importance, round(accuracy_drop, 6) AS accuracy_drop, row_number() OVER (PARTITION BY symbol ORDER BY round(importance, 9) DESC, feature)::INT AS place FROM im""")
def model_permutation_importance(spark, sf_dir):
    """What the log loss gains on the last 40 % of the rows when one feature is dealt anew, per symbol and feature."""
    rows = V.positions(labeled(X.volume_ratio(X.realized_vol(X.returns(bars(spark, sf_dir)))))).withColumn("is_train", (F.col("pos") < 0.6 * F.col("n_rows")).cast("int")).where("target is not null")
    scaled = checkpointed(V.standardize(rows.select("symbol", "timestamp", "is_train", F.col("target").cast("double").alias("target"), *IMPORTANT), IMPORTANT, ["symbol"]))
    beta = V.fit_logistic(scaled.where("is_train = 1"), IMPORTANT, ["symbol"])
    return result(M.permutation_importance(scaled.where("is_train = 0"), beta, IMPORTANT, ["symbol"], F.unix_seconds("timestamp"), seed=7))


@query(f"""WITH {BARS}, l AS (SELECT symbol, t, open, high, low, close, CASE WHEN nr > 0.005 THEN 1 WHEN nr < -0.005 THEN -1 WHEN nr IS NOT NULL THEN 0 END AS label3 FROM (SELECT *, lead(close) OVER w / close - 1 AS nr FROM bars {W})), c AS (SELECT symbol, label3, count(*) AS n FROM l WHERE label3 IS NOT NULL GROUP BY ALL), k AS (SELECT symbol, sum(n) AS total, count(*) AS k FROM c GROUP BY 1)
 SELECT l.symbol, l.t, l.label3, round(total / (k * n), 6) AS weight, CASE WHEN close - open > greatest(high - close, open - low) THEN 'BUY' WHEN open - low >= greatest(high - close, close - open) THEN 'SELL' ELSE 'HOLD' END AS action FROM l LEFT JOIN c ON c.symbol = l.symbol AND c.label3 = l.label3 LEFT JOIN k ON k.symbol = c.symbol""")
def model_class_weights(spark, sf_dir):
    """Class weights of the three-way label per symbol, and the action of the greatest of three scores."""
    rows = E.balanced_weights(X.label_ternary(bars(spark, sf_dir)), "label3", ["symbol"])
    rows = rows.withColumns({"up": F.col("close") - F.col("open"), "flat": F.col("high") - F.col("close"), "down": F.col("open") - F.col("low")})
    return result(E.argmax_action(rows, {-1: "down", 0: "flat", 1: "up"}), "symbol", "timestamp", "label3", "weight", "action")


@query()
def model_tree_baseline(spark, sf_dir):
    """A forest on the three-way label with classes of equal weight, on one chronological cut, and its actions."""
    rows = E.time_cut(X.label_ternary(X.volume_ratio(X.realized_vol(X.returns(bars(spark, sf_dir))))), 0.6).select("symbol", "timestamp", "label3", "part", *IMPORTANT)
    scored_rows = E.tree_baseline(rows.where("part = 'train'"), rows.where("part = 'test'"), IMPORTANT, trees=20)
    return scored_rows.groupBy("symbol", "action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label3") == 1).cast("double")), 6).alias("share_up"))


WINDOW_SQL = [dict(name="expanding", features=["return_1h", "return_6h"]), *[dict(name=f"last_{n}", features=["return_1h", "return_6h"], window=n) for n in (240, 120, 60)]]


@query(f"WITH {BARS}, {RET}, {VOL}, {LABELED}, {fitted_sql('lb', 'symbol', WINDOW_SQL, *FOLDS)}, {confirm_sql('symbol, variant', RETURN_GATE, 'symbol', _order(WINDOW_SQL))} SELECT symbol, variant, {DON} FROM don")
def experiment_train_windows(spark, sf_dir):
    """All rows before a fold, or only the latest, as training rows of the same model."""
    rows = labeled(X.volume_ratio(X.realized_vol(X.returns(bars(spark, sf_dir)))))
    return compared(rows, [M.Candidate(c["name"], tuple(c["features"]), window=c.get("window")) for c in WINDOW_SQL], ["symbol"], FOLDS, "return", ["symbol"])


PENALTY_SQL = [dict(name=f"c_{c}", features=["return_1h", "volume_ratio_24h"], c=c) for c in (0.001, 0.01, 0.1, 1.0)]


@query(f"WITH {BARS}, {RET}, {VOL}, {LABELED}, {fitted_sql('lb', 'symbol', PENALTY_SQL, *FOLDS)}, {confirm_sql('symbol, variant', RETURN_GATE, 'symbol', _order(PENALTY_SQL))} SELECT symbol, variant, {DON} FROM don")
def experiment_penalty_grid(spark, sf_dir):
    """A grid over the weight of the penalty, all points fitted at once."""
    rows = labeled(X.volume_ratio(X.realized_vol(X.returns(bars(spark, sf_dir)))))
    return compared(rows, [M.Candidate(c["name"], tuple(c["features"]), c=c["c"]) for c in PENALTY_SQL], ["symbol"], FOLDS, "return", ["symbol"])


GRID_INTERVALS = ["1h", "2h", "3h", "4h", "5h", "6h", "7h", "8h", "9h", "10h", "11h", "12h", "13h", "14h"]
GRID_SQL = [dict(name="logistic", features=["change_1", "change_3"])]


def _intervals() -> str:
    each = " UNION ALL ".join(f"SELECT symbol, '{i}' AS interval, t // {n} * {n} AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close FROM bars GROUP BY 1, 2, 3 HAVING count(*) * 3600 = {n}" for i in GRID_INTERVALS for n in [interval_seconds(i)])
    w = "WINDOW w AS (PARTITION BY symbol, interval ORDER BY t)"
    return f"rs AS ({each}), gs AS (SELECT *, close / lag(close) OVER w - 1 AS change_1, close / lag(close, 3) OVER w - 1 AS change_3, (lead(close) OVER w / close - 1 > 0.003)::INT AS target FROM rs {w})"


@query(f"WITH {BARS}, {_intervals()}, {fitted_sql('gs', 'symbol, interval', GRID_SQL, 40, 20, 20)}, {confirm_sql('symbol, interval, variant', INTERVAL_GATE, 'symbol', 'interval', True)} SELECT symbol, interval, {DON} FROM don")
def experiment_interval_grid(spark, sf_dir):
    """Every symbol at every interval with a model of its own: folds, sweep, exposure gate, ranking and decision as one job."""
    rows, keys = resample_many(bars(spark, sf_dir), GRID_INTERVALS), ["symbol", "interval"]
    w, close = ordered(keys), F.col("close")
    rows = rows.withColumns({"change_1": change(close, 1, w), "change_3": change(close, 3, w), "target": (F.lead("close").over(w) / close - 1 > 0.003).cast("int")})
    scored_rows, _ = M.fit_and_route(rows, [M.Candidate("logistic", ("change_1", "change_3"))], keys, 40, 20, 20)
    m = V.against_holding(scored_rows.select(*keys, "variant", "fold", "timestamp", "open", "high", "low", "close", "probability"), [*keys, "variant", "fold"], THRESHOLDS)
    return confirmed(m, [*keys, "variant"], "interval", ["symbol"], ["interval"]).drop("variant")


#: What each form of sentiment adds to the forms before it.
SENTIMENT_STEPS = {"hourly_mean": ["sentiment_mean"], "counts_missingness": ["sentiment_count", "sentiment_missing"], "reliability_shrunk": ["sentiment_shrunk"], "sentiment_lag_1h": ["sentiment_lag"]}


def sentiment_variants(base: Sequence[str]) -> list[dict]:
    """The market's features alone, then with one more form of sentiment at a time."""
    out, have = [dict(name="market_only", features=list(base))], list(base)
    for name, more in SENTIMENT_STEPS.items():
        have = [*have, *more]
        out.append(dict(name=name, features=have))
    return out


SENTIMENT_SQL = sentiment_variants(["return_1h"])


@query(f"""WITH {BARS}, {RET}, {VOL}, {LABELED}, {POSTS}, a AS (SELECT t // 3600 * 3600 AS t, avg(s) AS m, count(*) AS n FROM posts GROUP BY 1), j AS (SELECT lb.*, coalesce(a.m, 0) AS sentiment_mean, coalesce(a.n, 0) AS sentiment_count, (a.n IS NULL)::INT AS sentiment_missing, coalesce(a.m, 0) * coalesce(a.n, 0) / (coalesce(a.n, 0) + 5) AS sentiment_shrunk FROM lb LEFT JOIN a ON a.t = lb.t),
 src AS (SELECT *, coalesce(lag(sentiment_mean) OVER w, 0) AS sentiment_lag FROM j {W}), {fitted_sql('src', 'symbol', SENTIMENT_SQL, *FOLDS)}, {confirm_sql('symbol, variant', RETURN_GATE, 'symbol', _order(SENTIMENT_SQL))} SELECT symbol, variant, {DON} FROM don""")
def experiment_sentiment_ablation(spark, sf_dir):
    """A model on the market alone and with one more form of sentiment at a time, as a key of one sweep."""
    h = scored(spark, sf_dir).groupBy(F.date_trunc("hour", "timestamp").alias("timestamp")).agg(F.avg("sentiment_score").alias("sentiment_mean"), F.count(F.lit(1)).alias("sentiment_count"))
    rows = T.join_sentiment(labeled(X.realized_vol(X.returns(bars(spark, sf_dir)))), h, ["sentiment_mean", "sentiment_count"])
    n = F.col("sentiment_count")
    rows = rows.withColumns({"sentiment_missing": F.col("sentiment_join_missing"), "sentiment_shrunk": F.col("sentiment_mean") * n / (n + 5), "sentiment_lag": F.coalesce(F.lag("sentiment_mean").over(ordered()), F.lit(0.0))})
    return compared(rows, [M.Candidate(c["name"], tuple(c["features"])) for c in SENTIMENT_SQL], ["symbol"], FOLDS, "return", ["symbol"])
