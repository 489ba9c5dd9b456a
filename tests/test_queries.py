"""Queries against their SQL on the smallest tables: a choice that covers every operator module."""

import glob
import os

import duckdb
import pytest

from tests.conftest import SMALL
from tidewatch.plans.oracles import ORACLES
from tidewatch.plans.queries import QUERIES

CHOICE = ["series_meta", "raw_union_all", "calendar_all_series", "sticky_target_quarter", "daily_asof_panel", "panel_value_wide", "panel_carry_in", "panel_jagged_edge", "panel_first_release", "features_daily", "bridge_dataset", "bridge_dataset_model_target", "refit_schedule", "train_window_stats", "eligible_refits", "zscore_params", "ols_full", "stage_sigmas", "bridge_oos_predictions", "stage_ols_predict", "ar1_daily", "ar2_quarterly", "ar1_true_horizon", "metrics_by_distance", "model_compare", "quarter_thirds_density", "feature_coverage_decade", "raw_profile", "nowcast_signals", "run_daily", "run_daily_from_state", "panel_as_of", "panels_as_of", "real_time_features", "datasets_as_of", "panel_vintage_modes", "stage_sigmas_full", "stage_ols_full", "ar1_by_nation", "raw_structure", "event_gaps", "event_value_quantiles"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def _norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(float(r[i]), 4) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", CHOICE)
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert _norm(df.columns, df.collect()) == _norm(columns, found.fetchall())
