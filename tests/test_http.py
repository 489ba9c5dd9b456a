"""Retries, and final series through the data source."""

import json
from datetime import date

import pytest

from tidewatch.config import SeriesMeta
from tidewatch.sources import http

BODY = json.dumps({"observations": [{"date": "2020-02-01", "value": "2.5", "realtime_start": "2020-03-15"}, {"date": "2020-01-01", "value": "1.5", "realtime_start": "2020-02-16"}]})


def client(answers, **kw):
    calls = []

    def transport(url, params):
        calls.append(params)
        found = answers[min(len(calls), len(answers)) - 1]
        if isinstance(found, Exception):
            raise found
        return found

    return http.ObservationClient("key", "http://test", transport, **kw), calls


def test_refusals_are_tried_again(monkeypatch):
    pauses = []
    monkeypatch.setattr(http.time, "sleep", pauses.append)
    c, calls = client([(429, "slow down"), (503, "busy"), OSError("reset"), (200, BODY)], retries=4)
    assert len(c.final_series("A")) == 2 and len(calls) == 4 and pauses == [0.5, 1.0, 2.0]
    c, calls = client([(429, "slow down")], retries=2)
    with pytest.raises(http.ObservationError, match="429"):
        c.final_series("A")
    assert len(calls) == 3
    c, calls = client([OSError("down")], retries=1)
    with pytest.raises(http.ObservationError, match="no answer"):
        c.final_series("A")
    for answer in ((400, "bad"), (200, "{")):  # these do not pass
        c, calls = client([answer], retries=5)
        with pytest.raises(http.ObservationError):
            c.final_series("A")
        assert len(calls) == 1
    monkeypatch.setenv(http.KEY_VARIABLE, "k")
    assert http.ObservationClient.from_env().retries == http.RETRIES and http.ObservationClient.from_env(retries=0).retries == 0


class Stub(http.ObservationSource):
    @staticmethod
    def transport(url, params):
        return 200, BODY

    @classmethod
    def name(cls):
        return "stub_observations"


def test_configured_series_in_one_scan(spark, monkeypatch):
    monkeypatch.setenv(http.KEY_VARIABLE, "k")
    reader = http.ObservationReader(client([(200, BODY)])[0], ["A"], ["B", "C"])
    assert [(p.code, p.final) for p in reader.partitions()] == [("A", False), ("B", True), ("C", True)]
    assert list(reader.read(reader.partitions()[1])) == [("B", date(2020, 1, 1), None, 1.5), ("B", date(2020, 2, 1), None, 2.5)]
    metas = {k: SeriesMeta(k, "v", code, "M", "r", 1, vintage_source=source) for k, code, source in (("a", "A", "alfred"), ("b", "B", "final"), ("also_a", "A", "final"))}
    rows = http.read_configured(spark, metas, Stub, api_key="k").collect()
    assert sorted((r["series"], str(r["ref_period"]), str(r["vintage_date"]), r["value"]) for r in rows) == sorted((s, p, v if s == "a" else "None", x) for s in ("a", "b", "also_a") for p, v, x in (("2020-01-01", "2020-02-16", 1.5), ("2020-02-01", "2020-03-15", 2.5)))


#: (code, ref_period, realtime_start, value): what the service below knows, each until the next vintage of its period.
KNOWN = [("A", "2020-01-01", "2020-02-16", "1.5"), ("A", "2020-01-01", "2020-03-16", "1.75"), ("A", "2020-02-01", "2020-03-15", "2.5"), ("A", "2020-03-01", "2020-04-15", "."), ("B", "1970-01-01", "1975-01-01", "7"), ("B", "2020-01-01", "2020-03-20", "8")]


def serve(url, params):
    """Vintages that hold at some time between realtime_start and realtime_end, cut off at the former, as the service gives them."""
    lo, hi, out = params["realtime_start"], params["realtime_end"], []
    for code, period, since, value in KNOWN:
        later = [s for c, p, s, _ in KNOWN if (c, p) == (code, period) and s > since]
        if code == params["series_id"] and since <= hi and (not later or min(later) > lo):
            out.append({"date": period, "value": value, "realtime_start": max(since, lo)})
    return 200, json.dumps({"observations": out})


class Server(http.ObservationSource):
    transport = staticmethod(serve)

    @classmethod
    def name(cls):
        return "served_observations"


@pytest.mark.parametrize("window", [1, 10, 3650])
def test_windows_give_every_vintage_once(window):
    reader = http.ObservationStreamReader(http.ObservationClient("k", "http://test", serve), ["B", "A"], "2020-04-20", window)
    end = reader.latestOffset()
    assert reader.initialOffset() == {} and end == {"A": "2020-04-20", "B": "2020-04-20"}
    late = {"A": "2020-02-16", "B": "2020-03-15"}
    parts = [p for a, b in (({}, late), (late, end)) for p in reader.partitions(a, b)]
    days = sorted((p.code, p.first, p.last) for p in parts)
    for code in "AB":
        own = [x for x in days if x[0] == code]
        assert own[0][1] == http.FIRST_REALTIME and own[-1][2] == "2020-04-20"
        assert all(http._day(a[2], 1) == b[1] for a, b in zip(own, own[1:], strict=False))
    if window == 1:
        parts = [p for p in parts if p.first >= "2020-01-01" or p.first == http.FIRST_REALTIME]
    found = sorted((c, str(p), str(v), x) for part in parts for c, p, v, x in reader.read(part))
    # What was known before the first day is dated that day, as in a read of all vintages.
    assert found == [("A", "2020-01-01", "2020-02-16", 1.5), ("A", "2020-01-01", "2020-03-16", 1.75), ("A", "2020-02-01", "2020-03-15", 2.5), ("B", "1970-01-01", http.FIRST_REALTIME, 7.0), ("B", "2020-01-01", "2020-03-20", 8.0)]
    assert reader.partitions(end, end) == [] and reader.partitions(end, late) == []
    with pytest.raises(ValueError, match="window_days"):
        http.ObservationStreamReader(None, [], None, 0)


def test_a_restart_fetches_what_is_new(spark, tmp_path, monkeypatch):
    monkeypatch.setenv(http.KEY_VARIABLE, "k")
    with pytest.raises(ValueError, match="as a batch"):
        Server({"final_codes": "B"}).streamReader(None)
    metas = {k: SeriesMeta(k, "v", code, "M", "r", 1, vintage_source="alfred") for k, code in (("a", "A"), ("b", "B"), ("also_a", "A"))}
    counts = []
    for until, names in (("2020-03-15", ["a"]), ("2020-03-15", ["a"]), ("2020-04-20", ["a", "b", "also_a"])):
        rows = http.stream_configured(spark, {k: metas[k] for k in names}, Server, until=until, api_key="k")
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        counts.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert counts == [2, 2, 6]  # the third run: one more vintage of A, for both its series, and two of B
    got = {(r["series"], str(r["vintage_date"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "2020-02-16"), ("a", "2020-03-15"), ("a", "2020-03-16"), ("also_a", "2020-03-16"), ("b", http.FIRST_REALTIME), ("b", "2020-03-20")}
