"""The autoregressive baseline: one AR(p) for each target quarter, from the quarters released before it begins.

Any number of targets at once: ``keys`` tell them apart. A target's quarters, of which there are as many as the
calendar has, are fitted in one place by least squares (``factors``), every test quarter from its own window, and
come out with their forecasts, so that one shuffle by key is all. Lags are between rows of the window.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import ARConfig
from tidewatch.functions.dates import day_spine, quarter_end
from tidewatch.operators.factors import State
from tidewatch.session import ship


def quarterly_targets(cal: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ref_period, release_date, y): each quarter's first release, of one day's releases the earliest vintage."""
    missing = [c for c in ("ref_period", "release_date", "value") if c not in cal.columns]
    if missing:
        raise ValueError(f"the calendar lacks {missing}; it has {cal.columns}")
    order = ["release_date", *(["vintage_date"] if "vintage_date" in cal.columns else [])]
    solid = cal.where("ref_period is not null and release_date is not null and value is not null")
    first = F.min_by(F.struct("release_date", "value"), F.struct(*order))
    return solid.groupBy(*keys, "ref_period").agg(first.alias("x")).select(*keys, "ref_period", "x.release_date", F.col("x.value").alias("y"))


def ar_solution(y: Sequence[float], p: int, constant: bool = True) -> np.ndarray | None:
    """(intercept, phi_1..phi_p) of a history in order; of least norm if it is flat or its lags are collinear. None if nothing can be fitted."""
    y = np.asarray(y, float)
    lags = np.column_stack([y[p - i : len(y) - i] for i in range(1, p + 1)])
    here = y[p:]
    return State.of(lags[~np.isnan(here)], here[~np.isnan(here)]).solve(standardised=False, constant=constant)


def ahead(b: np.ndarray, newest: Sequence[float], steps: int = 1) -> float:
    """The forecast that many steps after the newest values (newest first)."""
    last = list(newest)
    for _ in range(steps):
        last = [float(b[0] + np.dot(b[1:], last)), *last[:-1]]
    return last[0]


def _years_back(day: date, years: int) -> date:
    try:
        return day.replace(year=day.year - years)
    except ValueError:  # 29 February
        return day.replace(year=day.year - years, day=28)


def _histories(targets: DataFrame, cfg: ARConfig, keys: Sequence[str]) -> DataFrame:
    """keys, ref_period, release_date, y, n_train, train_start, train_end, n, b, newest, y_hat of each test quarter; nulls where its history is too short."""
    ship(targets.sparkSession)
    keys = list(keys)
    grouped = keys or ["__all"]
    targets = targets if keys else targets.withColumn("__all", F.lit(0))
    kinds = dict(targets.dtypes)
    types = {"ref_period": pa.date32(), "release_date": pa.date32(), "y": pa.float64(), "n_train": pa.int64(), "train_start": pa.date32(), "train_end": pa.date32(), "n": pa.int64(), "b": pa.list_(pa.float64()), "newest": pa.list_(pa.float64()), "y_hat": pa.float64()}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in grouped], "ref_period date, release_date date, y double, n_train long, train_start date, train_end date, n long, b array<double>, newest array<double>, y_hat double"])

    def fit(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("ref_period", "release_date", "y")), strict=True), key=lambda r: r[0])
        period, release = [r[0] for r in rows], np.array([r[1] for r in rows], "datetime64[D]")
        starts, y = np.array(period, "datetime64[D]"), np.array([np.nan if r[2] is None else r[2] for r in rows])
        out = []
        for t, at, own in rows:
            if str(t) < cfg.test_start or (cfg.test_end is not None and str(t) > cfg.test_end):
                continue
            inside = np.flatnonzero((release < np.datetime64(t)) & (starts >= np.datetime64(_years_back(t, cfg.window_years))))
            found: dict = {}
            if len(inside) >= cfg.min_train_quarters and len(inside) > cfg.p:
                first, last, history = period[inside[0]], period[inside[-1]], y[inside]
                b, newest = ar_solution(history, cfg.p, cfg.constant), [float(v) for v in history[: -cfg.p - 1 : -1]]
                steps = ((t.year - last.year) * 12 + t.month - last.month) // 3 if cfg.true_horizon else 1
                y_hat = None if b is None or np.isnan(newest).any() else ahead(b, newest, max(1, steps))
                complete = sum(not np.isnan(history[k - cfg.p : k + 1]).any() for k in range(cfg.p, len(history)))
                found = {"n_train": len(inside), "train_start": first, "train_end": last, "n": complete, "b": None if b is None else b.tolist(), "newest": [None if np.isnan(v) else v for v in newest], "y_hat": y_hat}
            out.append({"ref_period": t, "release_date": at, "y": own, **found})
        first = [pa.array([table[c][0].as_py()] * len(out), table.schema.field(c).type) for c in grouped]
        return pa.table([*first, *[pa.array([o.get(c) for o in out], k) for c, k in types.items()]], names=[*grouped, *types])

    found = targets.where("ref_period is not null").select(*grouped, "ref_period", "release_date", F.col("y").cast("double").alias("y")).groupBy(*grouped).applyInArrow(fit, schema)
    return found if keys else found.drop("__all")


def ar_fits(targets: DataFrame, cfg: ARConfig, keys: Sequence[str] = ()) -> DataFrame:
    """keys, t_eval, n_train, train_start, train_end, n, b_0..b_p, y_0..y_{p-1} (newest values first).

    A history that does not vary, or whose lags are collinear, is fitted by least norm.
    """
    found = _histories(targets, cfg, keys).where("n_train is not null")
    return found.select(*keys, F.col("ref_period").alias("t_eval"), "n_train", "train_start", "train_end", "n", *[F.get("b", i).alias(f"b_{i}") for i in range(cfg.p + 1)], *[F.get("newest", i).alias(f"y_{i}") for i in range(cfg.p)])


def quarterly_forecasts(targets: DataFrame, cfg: ARConfig | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """keys, target_ref_period, target_release_date, y, y_hat, train_start, train_end, model_name of each test quarter.

    A quarter with too short a history keeps its row, with nulls. The forecast is one step after the
    last released quarter; with ``true_horizon`` it is carried on to the target quarter itself.
    """
    cfg = cfg or ARConfig()
    found = _histories(targets, cfg, keys)
    return found.select(*keys, F.col("ref_period").alias("target_ref_period"), F.col("release_date").alias("target_release_date"), "y", "y_hat", "train_start", "train_end", F.lit(cfg.model_name).alias("model_name"))


def expand_to_daily(forecasts: DataFrame, start: str | None = None, end: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """A row for each day of the target quarter, inside [start, end] and before the release, with distance_to_release."""
    lo, hi = F.col("target_ref_period"), quarter_end(F.col("target_ref_period"))
    lo = F.greatest(lo, F.lit(start).cast("date")) if start else lo
    hi = F.least(hi, F.lit(end).cast("date")) if end else hi
    hi = F.least(hi, F.date_sub("target_release_date", 1))
    daily = forecasts.withColumn("origin_date", day_spine(lo, hi))
    return daily.select(*keys, "model_name", "origin_date", "target_ref_period", "target_release_date", F.datediff("target_release_date", "origin_date").alias("distance_to_release"), "y", "y_hat", "train_start", "train_end")


class ARModel:
    """The fit of one short series in memory, by ``ar_solution``, for use on the driver."""

    def __init__(self, p: int = 1, constant: bool = True):
        if p < 1:
            raise ValueError("p: 1 at least")
        self.p, self.constant, self._b = p, constant, None

    @property
    def coefficients(self) -> np.ndarray:
        return self._b if self.constant else self._b[1:]

    def fit(self, y: Sequence[float]) -> ARModel:
        self._b = ar_solution(y, self.p, self.constant) if len(y) > self.p else None
        if self._b is None:
            raise ValueError(f"{len(y)} values are too few for p = {self.p}")
        return self

    def predict_next(self, y: Sequence[float]) -> float:
        if self._b is None:
            raise RuntimeError("the model is not fitted")
        if len(y) < self.p:
            raise ValueError(f"{len(y)} values are too few for p = {self.p}")
        return ahead(self._b, [float(v) for v in y[::-1][: self.p]])
