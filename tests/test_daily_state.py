"""Daily runs from a state: after every file they equal a run over all rows, and late vintages touch their months only."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import d
from tests.test_bitemporal import METAS, RAW, raw_rows
from tidewatch.config import RollingConfig
from tidewatch.operators.factors import month_of
from tidewatch.plans.daily_state import DailyState
from tidewatch.plans.engine import Nowcaster
from tidewatch.sources.results import fingerprint
from tidewatch.streaming.ingest import stream_observations, update_state


def unique(rows):
    """One value for each vintage: which of several counts is not defined."""
    return list({(s, p, v): (s, p, v, x) for s, p, v, x in rows}.values())


def full(spark, rows, cfg, **kw):
    return Nowcaster(spark.createDataFrame(rows, RAW), METAS, "g", "2000-01-01", "2002-12-31", cfg, **kw)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert tuple(a)[:2] == tuple(b)[:2] and tuple(a)[2:] == pytest.approx(tuple(b)[2:], rel=1e-8)


@pytest.mark.parametrize("strict,start", [(False, "2002-01-01"), (True, "2002-01-10")])
def test_equals_a_full_run_after_every_file(spark, tmp_path, strict, start):
    cfg = RollingConfig(test_start=start, window_years=1, min_train_rows=30)
    rows = unique(raw_rows(5))
    files = [[r for k, r in enumerate(rows) if k % 5 == i] for i in range(2)]  # vintages come in any order
    files.append([r for k, r in enumerate(rows) if k % 5 >= 2])
    files.append([("a", d("2001-10-01"), d("2001-12-20"), 7.5), ("b", d("2001-11-01"), d("2002-12-01"), -3.0), (*rows[0],)])  # late, in the future, known already
    n = full(spark, [], cfg, strict=strict)
    state, seen = DailyState(n, str(tmp_path / "state")), []
    assert state.record() is None and (start != "2002-01-01" or state.run_daily("2002-01-05").count() == 0)
    for file, day in zip(files, ("2002-01-20", "2002-02-11", "2002-05-03", "2002-05-17"), strict=True):
        seen = unique(seen + file)
        state.add(spark.createDataFrame(file, RAW))
        got = state.run_daily(day).collect()
        same(got, full(spark, seen, cfg, strict=strict).run_daily(day).collect())
    assert len(got) == 1 and got[0]["point"] is not None
    assert len(state._versions()) == 2  # the one before stays
    with pytest.raises(ValueError, match="full run"):
        state.run_daily("2002-04-30")


def test_a_late_vintage_touches_its_months(spark, tmp_path):
    cfg = RollingConfig(test_start="2002-01-01", window_years=1, min_train_rows=30)
    rows = unique(raw_rows(6))
    state = DailyState(full(spark, [], cfg), str(tmp_path / "s"))
    state.add(spark.createDataFrame(rows, RAW))
    state.run_daily("2002-05-17")
    before = {(r["month"], r["stage"]): bytes(r["state"]) for r in state.part("states").collect()}
    state.add(spark.createDataFrame([("w", date(2000, 1, 1) + timedelta(days=7 * 80), None, 123.0)], RAW))
    months = state.record()["months"]
    at = date(2000, 1, 1) + timedelta(days=7 * 80)
    assert 1 <= len(months) <= 2 and months[0] == month_of(at)
    after = {(r["month"], r["stage"]): bytes(r["state"]) for r in state.part("states").collect()}
    assert {k[0] for k in before.keys() | after.keys() if before.get(k) != after.get(k)} <= set(months)
    state.add(spark.createDataFrame(rows[:50], RAW))  # nothing new
    assert state.record()["months"] == []
    state.add(spark.createDataFrame([("b", d("2002-04-01"), d("2002-12-30"), 5.0)], RAW))  # not known yet
    assert state.record()["months"] == [] and state.part("pending").where("value = 5").count() == 1


def test_broken_steps_and_other_settings(spark, tmp_path):
    cfg = RollingConfig(test_start="2002-01-01", window_years=1, min_train_rows=30)
    n, at = full(spark, [], cfg), str(tmp_path / "s")
    state = DailyState(n, at)
    state.add(spark.createDataFrame([("a", d("2000-01-01"), d("2000-02-10"), 1.0)], RAW))
    with pytest.raises(Exception, match="without configuration"):
        state.add(spark.createDataFrame([("nobody", d("2000-01-01"), None, 1.0)], RAW))
    spark.range(3).write.parquet(f"{at}/v9/known")  # a step that died before its record
    assert state.record()["version"] == 1 and state.part("known").count() == 1
    odd = spark.createDataFrame([(None, d("2000-01-01"), None, 1.0)], RAW)
    with pytest.raises(Exception, match="without configuration"):
        state.add(odd)
    state.add(spark.createDataFrame([("a", None, None, 1.0), ("a", d("2000-02-01"), None, None)], RAW).withColumn("feature", F.lit(1)))
    assert state.part("known").count() == 2
    with pytest.raises(ValueError, match="other settings"):
        DailyState(full(spark, [], cfg, strict=True), at).record()
    with pytest.raises(ValueError, match="vintage modes"):
        DailyState(full(spark, [], cfg, policies=True), at)


def test_stream_takes_a_batch_once(spark, tmp_path):
    cfg = RollingConfig(test_start="2002-01-01", window_years=1, min_train_rows=30)
    rows = unique(raw_rows(7))
    state = DailyState(full(spark, [], cfg), str(tmp_path / "s"))
    (tmp_path / "in").mkdir()

    def run():
        q = update_state(stream_observations(spark, str(tmp_path / "in")), state, str(tmp_path / "log"))
        assert q.awaitTermination(300) and q.exception() is None

    for i in range(2):
        lines = [f"{s},{p},{v or ''},{'.' if x is None else repr(x)}" for s, p, v, x in rows[i::2]]
        (tmp_path / "in" / f"{i}.csv").write_text("\n".join(["series,ref_period,vintage_date,value", *lines, ""]))
        run()
    version = state.record()["version"]
    assert state.record()["batch"] == 1 and not state.add(spark.createDataFrame([("a", d("2000-01-01"), None, 9e9)], RAW), 1)
    run()
    assert state.record()["version"] == version
    same(state.run_daily("2002-05-17").collect(), full(spark, rows, cfg).run_daily("2002-05-17").collect())


def test_cached_dataset_follows_its_inputs(spark, tmp_path):
    rows, at = unique(raw_rows(8, 6)), str(tmp_path / "ds")
    n = full(spark, rows, RollingConfig())
    first = n.cached_dataset(at).where("x_b is not null").count()
    assert fingerprint(n.raw) == fingerprint(spark.createDataFrame(rows[::-1], RAW)) != fingerprint(spark.createDataFrame([*rows, rows[0]], RAW))
    spark.read.parquet(at).limit(3).write.parquet(f"{at}-small")
    spark.read.parquet(f"{at}-small").write.mode("overwrite").parquet(at)
    assert n.cached_dataset(at).count() == 3  # same inputs: not built again
    assert full(spark, [r for r in rows if r[0] != "b"], RollingConfig()).cached_dataset(at).where("x_b is not null").count() == 0 < first
    assert n.cached_dataset(at).where("x_b is not null").count() == first
