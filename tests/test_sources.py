"""Files, the HTTP client with a stub transport, the data source, and an end-to-end run over files."""

import json
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewatch.__main__ import main
from tidewatch.config import SeriesMeta
from tidewatch.operators import evaluation
from tidewatch.plans.queries import _exported, nowcaster
from tidewatch import session
from tidewatch.sources import http, observations, results
from tidewatch.sources.fixtures import CONFIG, TARGET

BODY = {"observations": [{"date": "2020-02-01", "value": "2.5", "realtime_start": "2020-03-15"}, {"date": "2020-01-01", "value": ".", "realtime_start": "2020-02-15"}, {"date": "2020-01-01", "value": "1.5", "realtime_start": "2020-02-16"}]}


def client(status=200, body=BODY):
    calls = []

    def transport(url, params):
        calls.append((url, params))
        return status, body if isinstance(body, str) else json.dumps(body)

    return http.ObservationClient("key", "http://test", transport), calls


def meta(source="alfred"):
    return SeriesMeta("s", "v", "CODE", "M", "r", 1, vintage_source=source)


def test_client():
    c, calls = client()
    assert c.final_series("CODE", "2020-01-01") == [(date(2020, 1, 1), 1.5), (date(2020, 2, 1), 2.5)]
    assert calls[0] == ("http://test/series/observations", {"series_id": "CODE", "observation_start": "2020-01-01", "api_key": "key", "file_type": "json"})
    assert c.vintage_series("CODE")[0] == (date(2020, 1, 1), date(2020, 2, 16), 1.5)
    assert calls[1][1]["realtime_end"] == "9999-12-31"
    assert client(body={})[0].final_series("CODE") == []


@pytest.mark.parametrize("bad", [(500, "no"), (200, "{"), (200, {"error_code": 400}), (200, {"observations": [{"x": 1}]})])
def test_client_errors(bad):
    with pytest.raises(http.ObservationError):
        client(*bad)[0].final_series("CODE")


def test_client_needs_a_key(monkeypatch):
    monkeypatch.delenv(http.KEY_VARIABLE, raising=False)
    with pytest.raises(RuntimeError):
        http.ObservationClient.from_env()


def test_sync_and_scan(spark, tmp_path):
    metas = {"a": meta(), "b": SeriesMeta("b", "v", "B", "M", "r", 1)}
    paths = http.sync_all(spark, metas, str(tmp_path), client()[0])
    assert [p.rsplit("/", 1)[1] for p in paths.values()] == ["CODE_vintage.csv", "B.csv"]
    raw = observations.load_all_raw_series(spark, metas, str(tmp_path))
    assert raw.columns == ["series", "ref_period", "vintage_date", "value"]
    assert raw.groupBy("series").count().orderBy("series").collect() == [("a", 2), ("b", 2)]
    observations.write_raw(raw, f"{tmp_path}/raw")
    assert observations.read_raw(spark, f"{tmp_path}/raw", ["a"]).count() == 2
    assert observations.structure_problems(spark, metas, str(tmp_path)) == {}
    assert list(http.sync_all(spark, metas, str(tmp_path), client()[0], only=["b"])) == ["b"]
    with pytest.raises(http.ObservationError):
        http.sync_all(spark, metas, str(tmp_path), client(500, "no")[0])


def test_scan_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        observations.load_raw_series(spark, "a", meta(), str(tmp_path))
    (tmp_path / "CODE_vintage.csv").write_text("ref_period,value\n2020-01-01,1\n")
    with pytest.raises(ValueError):
        observations.load_raw_series(spark, "a", meta(), str(tmp_path))
    (tmp_path / "CODE.csv").write_text("value,ref_period,more\nx,2020-01-01,1\n.,2020-02-01,1\n3,2020-03-01,1\n")
    rows = observations.load_raw_series(spark, "a", meta("final"), str(tmp_path)).orderBy("ref_period").collect()
    assert [r["value"] for r in rows] == [None, None, 3.0]
    (tmp_path / "CODE.csv").write_text("ref_period,value\nnot a date,1\n")
    with pytest.raises(Exception, match="not a date"):
        observations.load_raw_series(spark, "a", meta("final"), str(tmp_path)).collect()


def test_all_series_are_one_scan_for_each_header(spark, tmp_path):
    metas = {k: SeriesMeta(k, "v", f"C{k}", "M", "r", 1) for k in "abcd"} | {k: SeriesMeta(k, "v", f"V {k}", "M", "r", 1, vintage_source="alfred") for k in "ef"}
    for k in "abc":
        (tmp_path / f"C{k}.csv").write_text(f"ref_period,value\n2020-01-01,{ord(k)}\n")
    (tmp_path / "Cd.csv").write_text("value,more,ref_period\n100,x,2020-01-01\n")
    for k in "ef":
        (tmp_path / f"V {k}_vintage.csv").write_text(f"ref_period,vintage_date,value\n2020-01-01,2020-02-01,{ord(k)}\n")
    raw = observations.load_all_raw_series(spark, metas, str(tmp_path))
    assert {(r["series"], r["value"], str(r["vintage_date"])) for r in raw.collect()} == {(k, float(ord(k)), "None" if k < "e" else "2020-02-01") for k in "abcdef"}
    assert raw._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 3
    (tmp_path / "Ca.csv").unlink()
    with pytest.raises(FileNotFoundError):
        observations.load_all_raw_series(spark, metas, str(tmp_path))
    (tmp_path / "Ca.csv").write_text("ref_period,x\n")
    with pytest.raises(ValueError, match="lacks columns"):
        observations.load_all_raw_series(spark, metas, str(tmp_path))


def test_work_folders_are_removed(spark):
    path = _exported(spark, SMALL)
    assert observations.path_exists(spark, path)
    assert path.rsplit("/", 1)[1] in session.clean(spark) and not observations.path_exists(spark, path)


def test_data_source(spark, monkeypatch):
    reader = http.ObservationReader(client()[0], ["A", "B"])
    assert len(reader.partitions()) == 2
    found = list(reader.pushFilters([http.GreaterThanOrEqual(("ref_period",), date(2020, 2, 1)), http.EqualTo(("code",), "A")]))
    assert len(found) == 2 and reader.start == "2020-02-01"
    assert [r[0] for r in reader.read(reader.partitions()[0])] == ["A", "A"]

    class Stub(http.ObservationSource):
        transport = staticmethod(lambda url, params: (200, json.dumps(BODY)))

    df = http.read_observations(spark, ["A", "B"], Stub, api_key="k")
    assert df.where(F.col("value") > 2).count() == 2


def test_results(spark, tmp_path):
    assert results.read_csv_if_exists(spark, f"{tmp_path}/none.csv") is None
    with pytest.raises(FileNotFoundError):
        results.read_predictions(spark, f"{tmp_path}/none.csv")
    results.write_csv(spark.range(1), f"{tmp_path}/bad.csv")
    with pytest.raises(ValueError):
        results.read_predictions(spark, f"{tmp_path}/bad.csv")
    built = []
    for rebuild in (False, False, True):
        results.parquet_or_build(spark, f"{tmp_path}/ds", lambda: built.append(1) or spark.range(3), rebuild)
    assert len(built) == 2
    (tmp_path / "config").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert results.find_root(tmp_path / "a" / "b") == tmp_path


def test_run_to_files(spark, tmp_path, capsys):
    """The command line from CSV files to the comparison of all models."""
    main(["run", "--config", str(CONFIG), "--data", _exported(spark, SMALL), "--target", TARGET, "--out", str(tmp_path), "--start", "1995-01-01", "--end", "2001-12-31", "--test-start", "1998-01-01", "--window-years", "3", "--min-quarters", "8"])
    paths = dict(x.split(": ") for x in capsys.readouterr().out.splitlines() if ": " in x)
    assert {"ar_daily", "metrics_by_distance", "simple_predictions", "stage_overall", "nowcast", "model_compare"} <= set(paths)
    rows = results.read_csv_if_exists(spark, paths["model_compare"]).collect()
    assert {r["model_name"] for r in rows} == {"AR_p1_15y", "Bridge_simple_15y", "Bridge_stage_aware_15y"}
    main(["compare", f"{tmp_path}/eval"])
    assert results.read_csv_if_exists(spark, paths["model_compare"]).count() == len(rows)
    main(["evaluate", paths["ar_daily"], f"{tmp_path}/again"])
    assert results.read_csv_if_exists(spark, f"{tmp_path}/again/metrics_overall.csv").count() == 1
    with pytest.raises(RuntimeError):
        evaluation.compare_files(spark, f"{tmp_path}/nothing")


def test_runs_without_rows_or_predictions_say_so(spark, tmp_path):
    n = nowcaster(spark, SMALL)
    with pytest.raises(ValueError, match="no rows"):
        replace(n, rolling=replace(n.rolling, test_start="2010-01-01")).save(str(tmp_path))
