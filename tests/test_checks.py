"""Exact quantiles, structure validators, and the cleaning of work folders."""

import math
import os
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import d
from tidewatch import session
from tidewatch.config import SeriesMeta
from tidewatch.operators import checks, quantiles

PS = [0.0, 0.25, 0.5, 0.9, 1.0]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=4001),
        "wide": rng.normal(size=700) * 10.0 ** rng.integers(-300, 300, 700),
        "ties": rng.integers(-2, 3, 900).astype(float),
        "one": np.array([7.5]),
        "two": np.array([-1.0, 2.0]),
        "close": 1.0 + np.arange(300) * 2.0**-52,
        "extremes": np.array([-math.inf, -0.0, 0.0, 5e-324, -5e-324, 1.7e308, math.inf]),
        None: rng.normal(size=50),
    }
    rows = [(g, float(v), 3) for g, vs in groups.items() for v in vs] + [("ties", None, 3), ("ties", float("nan"), 3), ("nothing", None, 3)]
    df = spark.createDataFrame(rows, "g string, x double, bits int").repartition(6)
    found = {(r["g"], r["p"]): r["quantile"] for r in quantiles.exact_quantiles(df, ["g"], "x", PS).collect()}
    assert len(found) == len(groups) * len(PS)
    for g, vs in groups.items():
        s = np.sort(vs)
        for p in PS:
            at = p * (len(s) - 1)
            lo, hi, share = s[math.floor(at)], s[math.ceil(at)], at - math.floor(at)
            want = lo if share == 0 else lo * (1 - share) + hi * share
            assert found[g, p] == want or found[g, p] == pytest.approx(want, rel=1e-15), (g, p)
    whole = quantiles.exact_quantiles(df.where("g = 'normal'"), [], "x", [0.5]).collect()
    assert [r["quantile"] for r in whole] == [np.median(groups["normal"])]
    assert quantiles.exact_quantiles(df.where("false"), ["g"], "x", PS).count() == 0


def test_quantiles_by_joins_and_profile(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_RANKS", 0)
    df = spark.createDataFrame([("a", d("2000-01-01"), None, float(k * k % 101)) for k in range(400)] + [(None, d("2000-01-01"), None, None)], "series string, ref_period date, vintage_date date, value double")
    want = np.quantile([k * k % 101 for k in range(400)], [0.25, 0.5, 0.75])
    profile = {r["series"]: r for r in checks.raw_profile(df).collect()}
    assert [profile["a"][q] for q in ("q25", "q50", "q75")] == pytest.approx(want.tolist()) and profile[None]["q50"] is None and profile[None]["n_rows"] == 1


def meta(freq, revisions="multi"):
    return SeriesMeta("s", "v", "C", freq, "r", 5, revision_type=revisions)


def test_structure(spark):
    def months(*ms):
        return [date(2000 + (m - 1) // 12, (m - 1) % 12 + 1, 1) for m in ms]

    rows = [("m", p, p + timedelta(days=45), 1.0) for p in months(1, 2, 5, 6, 9)]  # 3, 4, 7, 8 are missing
    rows += [("q", p, p + timedelta(days=100), 1.0) for p in months(1, 4, 10)] + [("q", d("2001-01-01"), d("2001-02-01"), 1.0)]  # one missing, one early
    rows += [("w", d("2000-01-01") + timedelta(days=7 * k), None, 1.0) for k in (0, 1, 4)]
    rows += [("d", d("2000-01-01") + timedelta(days=k), None, 1.0) for k in range(40)]
    rows += [("s", d("2000-01-01"), d("2000-03-01"), 1.0), ("s", d("2000-01-01"), d("2000-04-01"), 1.0), ("s", d("2000-02-01"), d("2000-02-29"), 1.0), ("s", None, None, 1.0)]  # revised, and out of order
    rows += [("unknown", d("2000-01-01"), None, 1.0)]
    raw = spark.createDataFrame(rows, "series string, ref_period date, vintage_date date, value double")
    metas = {"m": meta("M"), "q": meta("Q"), "w": meta("w"), "d": meta("D"), "s": meta("M", "single"), "absent": meta("M")}
    got = {r["series"]: tuple(r)[1:] for r in checks.structure(raw, metas).collect()}
    assert got == {
        "m": (5, 4, d("2000-03-01"), d("2000-08-01"), 0, 0, 0, False),
        "q": (4, 1, d("2000-07-01"), d("2000-07-01"), 1, 0, 0, False),
        "w": (3, 2, d("2000-01-15"), d("2000-01-22"), 0, 0, 0, False),
        "d": (40, 0, None, None, 0, 0, 0, True),
        "s": (2, 0, None, None, 0, 1, 1, False),
    }


def test_clean_leaves_other_folders(spark):
    """Only this application's folder goes, with its checkpoints; a foreign folder and another session's stay."""
    own = session.checkpoint_dir(spark)
    assert os.path.basename(own) == f"tidewatch-{spark.sparkContext.applicationId}" and session.checkpoint_dir(spark) == own
    root = os.path.dirname(own.removeprefix("file:"))
    for other in ("raw-2024-users-own", "pipeline-1", "tidewatch-another-session"):
        os.makedirs(f"{root}/{other}/x", exist_ok=True)
    session.cut(spark.range(10)).count()
    spark.range(3).write.mode("overwrite").parquet(f"{own}/raw-mine")
    inside = sum(len(f) for _, _, f in os.walk(own.removeprefix("file:")))
    assert inside > 4 and "raw-mine" in session.clean(spark)
    assert not any(f for _, _, f in os.walk(own.removeprefix("file:")))
    assert all(os.path.isdir(f"{root}/{x}/x") for x in ("raw-2024-users-own", "pipeline-1", "tidewatch-another-session"))
    assert session.cut(spark.range(10)).agg(F.sum("id")).first()[0] == 45
