"""Experiments as tables: variants, gates against a baseline, regime routing, model classes, saved models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import global_place


def run_grid(df: DataFrame, variants: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The union of all variants of a table, each under its name: later stages take ``variant`` as a key."""
    out = None
    for name, make in variants.items():
        one = make(df).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def time_cut(df: DataFrame, share: float) -> DataFrame:
    """part by the order of the distinct timestamps: the first ``share`` of them train."""
    times, n = global_place(df.select("timestamp").distinct(), ["timestamp"], "_r")
    return df.join(times, "timestamp").withColumn("part", F.when(F.col("_r") < share * max(n - 1, 1), "train").otherwise("test")).drop("_r")


def route_by_regime(df: DataFrame, scores: dict[str, str], bull_only: bool = False) -> DataFrame:
    """probability from the score column of the row's regime; bull_only: a bear regime is cash (-1)."""
    p = F.lit(None).cast("double")
    for regime, column in scores.items():
        p = F.when(F.col("regime") == regime, F.col(column)).otherwise(p)
    return df.withColumn("probability", F.when(F.col("regime") == "bear", -1.0).otherwise(p) if bull_only else p)


def soft_vote(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of the members' probabilities that are there."""
    there = F.array_compact(F.array(*columns))
    return df.withColumn("probability", F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there)))


def against_baseline(metrics: DataFrame, baseline: str, keys: Sequence[str] = ("fold", "threshold")) -> DataFrame:
    """Every variant's fold metrics with the baseline's of the same fold and threshold."""
    base = metrics.where(F.col("variant") == baseline).select(*keys, F.col("total_return").alias("base_return"), F.col("max_drawdown").alias("base_drawdown"), F.col("turnover").alias("base_turnover"))
    return metrics.where(F.col("variant") != baseline).join(base, list(keys)).withColumn("delta_return", F.col("total_return") - F.col("base_return"))


def gate(compared: DataFrame, by: Sequence[str] = ("variant", "threshold"), least_share: float = 0.5, most_turnover: float = 1.5) -> DataFrame:
    """Folds improved, turnover multiple and the reasons of a rejection (none: accepted)."""
    rows = compared.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_folds"), F.count_if(F.col("delta_return") > 0).alias("n_improved"), F.median("delta_return").alias("median_delta"), F.try_divide(F.sum("turnover"), F.nullif(F.sum("base_turnover"), F.lit(0.0))).alias("turnover_multiple")
    )
    reasons = F.array_compact(F.array(F.when(F.col("n_improved") < least_share * F.col("n_folds"), F.lit("few_folds_improved")), F.when(F.col("median_delta") <= 0, F.lit("no_median_gain")), F.when(F.col("turnover_multiple") > most_turnover, F.lit("turnover"))))
    return rows.withColumn("reasons", F.concat_ws(",", reasons)).withColumn("accepted", (F.size(reasons) == 0).cast("int"))


def promote(chosen: DataFrame, m: DataFrame, baseline: str, keys: Sequence[str] = ("symbol",), least_folds: int = 2, drawdown: float = 0.02, turnover: tuple[float, float] = (1.5, 2.0), holdout_turnover: tuple[float, float] = (2.0, 4.0)) -> DataFrame:
    """keys, variant, n_improved, reasons, promoted: why each candidate may not replace the baseline (nothing: it may), and
    1 at the first in rank of those that may.

    chosen: of select_and_confirm; m: the fold metrics behind it. A candidate has to gain in ``least_folds`` development
    folds at its threshold, in the median, and over cash; its drawdown may be ``drawdown`` deeper and its turnover a
    multiple or an amount above the baseline's; and its holdout has to confirm all of it."""
    base = chosen.where(F.col("variant") == baseline).select(*keys, *[F.col(c).alias(f"_{c}") for c in ("threshold", "median_return", "median_drawdown", "median_turnover", "holdout_total_return", "holdout_max_drawdown")])
    rows = chosen.where(F.col("variant") != baseline).join(base, list(keys), "left")
    folds = m.where("fold >= 0").select(*keys, "variant", "fold", "threshold", F.round("total_return", 9).alias("_r"))
    better = folds.join(folds.where(F.col("variant") == baseline).select(*keys, "fold", "threshold", F.col("_r").alias("_b")), [*keys, "fold", "threshold"]).where("_r > _b").groupBy(*keys, "variant", "threshold").agg(F.count(F.lit(1)).alias("n_improved"))
    rows = rows.join(better, [*keys, "variant", "threshold"], "left").na.fill(0, ["n_improved"])
    r, most = F.col("median_return"), lambda limits: F.greatest(F.col("_median_turnover") * limits[0], F.col("_median_turnover") + limits[1])
    needs = {
        "few_folds_improved": F.col("n_improved") >= least_folds, "no_median_gain": r > F.col("_median_return"), "not_above_cash": r > F.coalesce("median_cash_return", F.lit(0.0)),
        "drawdown": F.abs("median_drawdown") <= F.abs("_median_drawdown") + drawdown, "turnover": F.col("median_turnover") <= most(turnover),
        "holdout_return": F.round("holdout_total_return", 9) > F.round("_holdout_total_return", 9), "holdout_drawdown": F.abs("holdout_max_drawdown") <= F.abs("_holdout_max_drawdown") + drawdown, "holdout_turnover": F.col("holdout_turnover") <= most(holdout_turnover),
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in needs.items()]))
    reasons = F.when(F.col("_threshold").isNull(), "baseline_without_threshold").when(F.col("threshold").isNull(), "no_threshold").otherwise(F.concat_ws(",", failed))
    first = F.row_number().over(Window.partitionBy(*keys, "reasons").orderBy("rank"))
    return rows.withColumn("reasons", reasons).withColumn("promoted", ((F.col("reasons") == "") & (first == 1)).cast("int")).select(*keys, "variant", "threshold", "rank", "n_improved", "reasons", "promoted")


def balanced_weights(df: DataFrame, target: str, keys: Sequence[str] = (), name: str = "weight") -> DataFrame:
    """A weight for each row with a class: rows / (classes * rows of its class), per ``keys``, so that classes weigh alike."""
    each = df.where(F.col(target).isNotNull()).groupBy(*keys, target).agg(F.count(F.lit(1)).alias("_n"))
    total = each.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k")) if keys else each.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = (each.join(total, list(keys)) if keys else each.crossJoin(total)).select(*keys, target, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias(name))  # one row per class
    return df.join(weights, [*keys, target], "left")


def argmax_action(df: DataFrame, probabilities: dict[int, str]) -> DataFrame:
    """action of the likeliest class (1: BUY, -1: SELL, 0: HOLD); of equal ones the smallest class, as listed order decides
    nothing; HOLD without probabilities."""
    best = F.array_min(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("p"), F.lit(k).alias("k"))) for k, c in probabilities.items()])))
    return df.withColumn("action", F.when(best["k"] == 1, "BUY").when(best["k"] == -1, "SELL").otherwise("HOLD"))


def tree_baseline(train: DataFrame, test: DataFrame, features: Sequence[str], target: str = "label3", trees: int = 100, depth: int = 4, leaf: int = 10, seed: int = 42) -> DataFrame:
    """test with the forest's probabilities p_down, p_flat, p_up and the likeliest class's action; classes weigh alike."""
    rows = balanced_weights(train.where(F.col(target).isNotNull()), target).withColumn("_class", (F.col(target) + 1).cast("double"))
    forest = RandomForestClassifier(featuresCol="features", labelCol="_class", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="0.5", seed=seed)
    scored = pipeline(features, forest).fit(rows).transform(test).withColumn("_p", vector_to_array("probability"))
    named = scored.withColumns({n: F.get("_p", F.lit(k)) for k, n in enumerate(("p_down", "p_flat", "p_up"))})
    return argmax_action(named, {-1: "p_down", 0: "p_flat", 1: "p_up"}).select(*test.columns, "p_down", "p_flat", "p_up", "action")


def summary_rows(selected: DataFrame, holdout: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The selected threshold's development metrics beside those of the holdout."""
    named = holdout.select(*keys, *[F.col(c).alias(f"holdout_{c}") for c in holdout.columns if c not in keys])
    return selected.join(named, list(keys), "left")


def estimators(seed: int = 42) -> dict[str, object]:
    """Small model classes on the column ``features``."""
    base = {"featuresCol": "features", "labelCol": "target"}
    return {
        "logistic": LogisticRegression(**base, regParam=0.001, standardization=False),
        "forest": RandomForestClassifier(**base, numTrees=20, maxDepth=4, seed=seed),
        "boosted": GBTClassifier(**base, maxIter=10, maxDepth=3, stepSize=0.1, seed=seed),
    }


def pipeline(features: Sequence[str], estimator: object) -> Pipeline:
    """Median imputation, standardisation, model: the order of the features is the contract."""
    filled = [f"{f}_filled" for f in features]
    return Pipeline(stages=[Imputer(strategy="median", relativeError=1e-6, inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), estimator])


def compare_models(train: DataFrame, test: DataFrame, features: Sequence[str]) -> DataFrame:
    """Probabilities of every model class on the test rows, under ``model``."""
    out = None
    for name, estimator in estimators().items():
        fitted = pipeline(features, estimator).fit(train.where("target is not null").withColumn("target", F.col("target").cast("double")))
        one = fitted.transform(test).select("symbol", "timestamp", "target", vector_to_array("probability")[1].alias("probability"), F.lit(name).alias("model"))
        out = one if out is None else out.unionByName(one)
    return out


def model_grid(depths: Sequence[int] = (3, 5), leaves: Sequence[int] = (20, 50), boosted_depths: Sequence[int] = (2, 3), trees: int = 10, rounds: int = 5, seed: int = 42) -> dict[str, object]:
    """Small grids of model classes, the baseline first; the order decides between equal candidates."""
    base = {"featuresCol": "features", "labelCol": "target"}
    forests = {f"forest_depth_{d}_leaf_{n}": RandomForestClassifier(**base, numTrees=trees, maxDepth=d, minInstancesPerNode=n, seed=seed) for d in depths for n in leaves}
    boosted = {f"boosted_depth_{d}": GBTClassifier(**base, maxIter=rounds, maxDepth=d, stepSize=0.1, minInstancesPerNode=20, seed=seed) for d in boosted_depths}
    return {"logistic": LogisticRegression(**base, regParam=0.001, standardization=False), **forests, **boosted}


def score_grid(rows: DataFrame, features: Sequence[str], specs: dict[str, object], cuts: Sequence[float] = (0.4, 0.6, 0.8), holdout: int = -1) -> DataFrame:
    """rows of every fold's test part with the probability of every model (``variant``): a fold trains on all rows before
    a cut of the time axis and tests up to the next; behind the last cut is the holdout. One model serves all symbols.

    The number of fits is that of models and folds, each a Spark job over all rows of its part."""
    times, n = global_place(rows.select("timestamp").distinct(), ["timestamp"], "_r")
    placed = rows.join(times, "timestamp").withColumn("_r", F.col("_r") / max(n - 1, 1))
    out = None
    for k, (low, high) in enumerate(zip(cuts, [*cuts[1:], 2.0], strict=True)):
        train = placed.where((F.col("_r") < low) & F.col("target").isNotNull()).withColumn("target", F.col("target").cast("double"))
        test = placed.where((F.col("_r") >= low) & (F.col("_r") < high)).withColumn("fold", F.lit(holdout if high > 1 else k))
        for name, estimator in specs.items():
            scored = pipeline(features, estimator).fit(train).transform(test)
            one = scored.select(*rows.columns, "fold", F.lit(name).alias("variant"), vector_to_array("probability")[1].alias("probability"))
            out = one if out is None else out.unionByName(one)
    return out


def save_model(model: PipelineModel, path: str, features: Sequence[str], spark: SparkSession) -> None:
    model.save(f"{path}/model")
    spark.createDataFrame([(k, f) for k, f in enumerate(features)], "place int, feature string").write.parquet(f"{path}/features")


def load_model(path: str, features: Sequence[str], spark: SparkSession) -> PipelineModel:
    """Refuses other features, or another order, than those that the model was fitted on."""
    kept = [r.feature for r in spark.read.parquet(f"{path}/features").orderBy("place").collect()]
    if kept != list(features):
        raise ValueError(f"the model takes {kept}")
    return PipelineModel.load(f"{path}/model")
