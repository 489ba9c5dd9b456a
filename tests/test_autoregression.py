"""Many targets at once: every key as if it were alone."""

import time
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import ARConfig
from tidewatch.operators import autoregression

TARGETS = "unit string, ref_period date, release_date date, y double"


def quarters(n):
    return [date(2000 + k // 4, 3 * (k % 4) + 1, 1) for k in range(n)]


@pytest.mark.parametrize("p", [1, 3])
def test_a_thousand_targets(spark, p):
    rng = np.random.default_rng(p)
    values = {f"u{u}": np.cumsum(rng.normal(size=48)) for u in range(1000)}
    values["u7"] = np.full(48, 3.0)
    values["u8"] = values["u8"] * 1e-3 + 1e6
    rows = [(u, q, q + timedelta(days=118), float(v)) for u, y in values.items() for q, v in zip(quarters(48), y, strict=True)]
    rows += [(None, q, q + timedelta(days=118), 1.0 + k % 3) for k, q in enumerate(quarters(48))] + [("short", q, q, 1.0) for q in quarters(48)[-5:]]
    targets = spark.createDataFrame(rows, TARGETS).repartition(4).cache()
    cfg = ARConfig(p=p, window_years=6, min_train_quarters=12, test_start="2009-01-01")
    began = time.perf_counter()
    found = {}
    for r in autoregression.quarterly_forecasts(targets, cfg, keys=["unit"]).collect():
        found.setdefault(r["unit"], {})[r["target_ref_period"]] = r
    assert time.perf_counter() - began < 60
    assert len(found) == 1002 and all(len(f) == 12 for u, f in found.items() if u != "short")
    assert all(r["y_hat"] is None and r["train_end"] is None for r in found["short"].values())
    for u in ("u0", "u7", "u8", "u999"):
        alone = autoregression.quarterly_forecasts(targets.where(F.col("unit") == u).drop("unit"), cfg).collect()
        assert {r["target_ref_period"]: r["y_hat"] for r in alone} == {t: r["y_hat"] for t, r in found[u].items()}
        for t, r in found[u].items():
            own = [v for q, v in zip(quarters(48), values[u], strict=True) if q + timedelta(days=118) < t and q >= t.replace(year=t.year - 6)]
            x = np.column_stack([np.ones(len(own) - p), *[np.array(own)[p - i : len(own) - i] for i in range(1, p + 1)]])
            centre = own[0] if u == "u8" else 0.0
            b = np.linalg.lstsq(x - [0, *[centre] * p], np.array(own[p:]) - centre, rcond=None)[0]
            want = b @ [1, *[own[-i] - centre for i in range(1, p + 1)]] + centre
            assert r["y_hat"] == pytest.approx(want, abs=1e-7)
    daily = autoregression.expand_to_daily(autoregression.quarterly_forecasts(targets, cfg, keys=["unit"]), keys=["unit"])
    assert daily.where("unit = 'u1' and target_ref_period = '2009-01-01'").count() == 90


def test_missing_values_and_repeated_keys(spark):
    rows = [("a", q, q + timedelta(days=100), None if k == 20 else float(k % 5)) for k, q in enumerate(quarters(40))]
    targets = spark.createDataFrame(rows, TARGETS)
    cfg = ARConfig(p=2, window_years=8, min_train_quarters=8, test_start="2006-01-01", test_end="2007-12-31")
    fits = {r["t_eval"]: r for r in autoregression.ar_fits(targets, cfg, keys=["unit"]).collect()}
    assert len(fits) == 8 and all(r["n"] < r["n_train"] for r in fits.values())
    assert autoregression.ar_fits(targets.where("false"), cfg).count() == 0
