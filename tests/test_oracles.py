"""Every registered query that has SQL against DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries of which the smallest tables leave rows or a whole column empty: compared on the tables ten times as large.
LARGER = {
    "experiment_feature_groups", "experiment_holdout_evaluation", "experiment_interval_grid", "experiment_penalty_grid", "experiment_promotion", "experiment_regime_specialists", "experiment_sentiment_ablation", "experiment_train_windows",
    "feature_dataset", "feature_volatility_percentile", "posts_retain", "resample_4h", "sentiment_cross_symbol", "sentiment_distribution", "stream_resample", "validation_fold_rows", "validation_rolling_purged",
    "validation_threshold_selection", "validation_threshold_summary", "validation_threshold_sweep", "validation_walk_forward",
}


def folder(small: str, name: str) -> str:
    return small.replace("sf0.001", "sf0.01") if name in LARGER else small


@pytest.fixture(scope="session")
def duck(small):
    connections = {}

    def run(name: str) -> pd.DataFrame:
        at = folder(small, name)
        if at not in connections:
            connections[at] = duckdb.connect()
            for t in TABLES:
                connections[at].execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
        return connections[at].execute(registry.ORACLES[name]).df()

    return run


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    ours = ordered(registry.QUERIES[name](spark, folder(small, name)).toPandas())
    theirs = ordered(duck(name))
    assert len(theirs), "an empty table compares nothing"
    assert not [c for c in theirs.columns if theirs[c].isna().all()], "a column without values compares nothing"
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for c in ours.columns:
        a, b = ours[c], theirs[c]
        if a.dtype == object or b.dtype == object:
            assert ((a == b) | (a.isna() & b.isna())).all(), c
        else:
            pd.testing.assert_series_equal(a.astype(float), b.astype(float), check_names=False, rtol=0, atol=2e-6, obj=c)
