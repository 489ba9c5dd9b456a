"""What was known when: as-of panels, features and models never show a vintage dated later."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import d
from tidewatch.config import RollingConfig, SeriesMeta
from tidewatch.operators import bitemporal, panel
from tidewatch.operators.calendar import build_calendar
from tidewatch.plans.engine import Nowcaster

RAW = "series string, ref_period date, vintage_date date, value double"


def meta(**kw):
    return SeriesMeta(**({"name": "s", "vendor": "v", "code": "C", "freq": "M", "release_rule": "r", "release_lag_days": 10} | kw))


METAS = {"g": meta(freq="Q", release_lag_days=27), "a": meta(transform="mom"), "b": meta(transform="diff", release_lag_days=3), "w": meta(freq="W", transform="level", release_lag_days=1)}


def raw_rows(seed=1, months=36):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(months):
        m = date(2000 + k // 12, k % 12 + 1, 1)
        for s in ("a", "b", *(["g"] if k % 3 == 0 else [])):
            at = m + timedelta(days=int(rng.integers(20, 70)))
            for _ in range(int(rng.integers(1, 4))):
                rows.append((s, m, at, None if rng.random() < 0.05 else float(rng.normal() + 5)))
                at += timedelta(days=int(rng.integers(0, 120)))
        if rng.random() < 0.2:
            rows.append(("b", m, m + timedelta(days=1), -1.0))  # dated before its period has ended
    rows += [("w", date(2000, 1, 1) + timedelta(days=7 * k), None, float(rng.normal())) for k in range(months * 4)]
    return rows


def test_a_later_revision_is_not_shown(spark):
    """1.0 was released in 2000 and became 99.0 in 2001."""
    raw = spark.createDataFrame([("a", d("2000-01-01"), d("2000-02-10"), 1.0), ("a", d("2000-01-01"), d("2001-06-01"), 99.0)], RAW)
    cal = build_calendar(raw, METAS)
    for day, want in (("2000-02-09", None), ("2000-03-01", 1.0), ("2001-05-31", 1.0), ("2001-06-01", 99.0)):
        rows = panel.daily_panel(cal, "2000-01-01", "2002-01-01", as_of=day).collect()
        assert {r["value"] for r in rows} <= {None, want} and max(r["as_of_date"] for r in rows) == d(day)
        if want:
            assert {r["value"] for r in bitemporal.panels_as_of(cal, [day], "2000-01-01", "2002-01-01").collect()} == {None, want}
    n = Nowcaster(raw, METAS, "g", "2000-01-01", "2002-01-01")
    assert n.panel("2000-03-01").where("value > 1").count() == 0 and n.panel().where("value = 99").count() > 0
    live = {str(r["as_of_date"]): r["value"] for r in bitemporal.knowledge_features(cal, METAS, "2000-01-01", "2002-01-01").collect()}
    assert len(live) == 732 and [live[x] for x in ("2000-02-09", "2000-02-10", "2001-05-31", "2001-06-01")] == [None, 1.0, 1.0, 99.0]


@pytest.mark.parametrize("strict", [False, True])
def test_many_dates_equal_single_ones(spark, strict):
    cal = build_calendar(spark.createDataFrame(raw_rows(), RAW), METAS, strict).cache()
    days = ["2000-01-20", "2000-07-04", "2001-03-31", "2001-04-01", "2002-12-31"]
    many = bitemporal.panels_as_of(cal, [*days, days[0]], "2000-02-01", "2002-06-30").cache()
    for day in days:
        one = panel.daily_panel(cal, "2000-02-01", "2002-06-30", as_of=day)
        got = many.where(F.col("as_of") == day).drop("as_of")
        assert got.exceptAll(one).count() == 0
        assert one.exceptAll(got).where("value is not null").count() == 0
    assert many.where("as_of_date > as_of").count() == 0


def test_every_day_as_it_was_known(spark):
    cal = build_calendar(spark.createDataFrame(raw_rows(2, 14), RAW), METAS)
    days = [date(2000, 1, 5) + timedelta(days=k) for k in range(300)]
    live = bitemporal.knowledge_features(cal, METAS, "2000-01-05", str(days[-1])).cache()
    assert live.count() == 4 * 300 == live.select("series", "as_of_date").distinct().count()
    daily = bitemporal.features_as_of(cal, METAS, days, "2000-01-05", str(days[-1])).where("as_of_date = as_of").drop("as_of")
    assert daily.select(live.columns).exceptAll(live).count() == 0 and live.where("value is not null").select(daily.columns).exceptAll(daily).count() == 0


def test_history_does_not_change_with_later_vintages(spark):
    """Results up to a date are the same whatever is published after it."""
    rows, day = raw_rows(3), "2002-03-20"
    cfg = RollingConfig(test_start="2002-01-10", window_years=1, min_train_rows=30)
    later = [(s, p, v, x if x is None or v is None or v <= d(day) else x * 1000) for s, p, v, x in rows] + [("a", p, d("2002-03-21"), -1e6) for s, p, *_ in rows if s == "a"]
    found = []
    for r in (rows, later):
        n = Nowcaster(spark.createDataFrame(r, RAW), METAS, "g", "2000-01-01", "2002-12-31", cfg)
        history = {x["origin_date"]: tuple(x)[1:6] for x in n.fit_history(day).collect()}
        assert max(history) == d(day) and len(history) > 50
        daily = n.run_daily(day).collect()
        assert len(daily) == 1 and (daily[0]["point"], daily[0]["std"]) == pytest.approx(history[d(day)][1:3])
        assert n.run_daily("2001-12-31").count() == 0
        found.append(history)
    assert found[0] == found[1]
    changed = Nowcaster(spark.createDataFrame(later, RAW), METAS, "g", "2000-01-01", "2002-12-31", cfg).fit_history("2002-05-01")
    assert {x["origin_date"]: tuple(x)[1:6] for x in changed.where(F.col("origin_date") <= day).collect()} == found[0]


def test_policies_of_the_configuration(spark):
    """Four vintage modes and four missing policies, each series by its own."""
    rows = [(s, d("2000-01-01"), d(v), x) for s in "abcd" for v, x in (("2000-02-10", 1.0), ("2000-03-01", 2.0), ("2000-04-01", 3.0))]
    metas = {s: meta(vintage_mode=m, missing_policy=p) for s, m, p in zip("abcd", ("first_release", "latest", "all_releases", "reference"), ("carry_forward", "carry_forward", "carry_forward", "carry_forward"), strict=True)} | {"g": METAS["g"]}
    raw = spark.createDataFrame([*rows, ("g", d("2000-01-01"), None, 1.0)], RAW)
    n = Nowcaster(raw, metas, "g", "2000-01-01", "2000-05-01", policies=True)
    at = {(r["series"], str(r["as_of_date"])): r["value"] for r in n.panel().collect()}
    days = ("2000-02-09", "2000-02-10", "2000-03-01", "2000-04-30")
    assert [[at[s, x] for x in days] for s in "abcd"] == [[None, 1, 1, 1], [None, 3, 3, 3], [None, 1, 2, 3], [None, 3, 3, 3]]
    early = {(r["series"], str(r["as_of_date"])): r["value"] for r in n.panel("2000-03-15").collect()}
    assert [early[s, "2000-03-15"] for s in "abcd"] == [1, 2, 2, 2]
    numbered = panel.by_vintage_mode(build_calendar(raw, metas), metas)
    assert sorted(r["release_number"] for r in numbered.where("series = 'c'").collect()) == [1, 2, 3]
    metas = {s: meta(missing_policy=p, vintage_mode="reference") for s, p in zip("abcd", ("carry_forward", "skip", "zero", "flag_only"), strict=True)} | {"g": METAS["g"]}
    n = Nowcaster(raw, metas, "g", "2000-01-01", "2000-05-01", policies=True, stale_days=5)
    at = {(r["series"], str(r["as_of_date"])): r["value"] for r in n.panel().collect()}
    assert [[at[s, x] for x in ("2000-02-15", "2000-02-16")] for s in "abcd"] == [[3, 3], [3, None], [3, 0], [3, None]]
    assert n.dataset().where("x_b is not null").count() == 6 and n.real_time_dataset().where("x_b is not null").count() == 6 and n.dataset().where("x_a is not null").count() == 82
    plain = Nowcaster(raw, metas, "g", "2000-01-01", "2000-05-01")
    assert plain.dataset().where("x_b is not null").count() == 82
