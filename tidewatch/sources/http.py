"""Observations from a statistics service over HTTP, and their sync to files.

``ObservationClient`` speaks the JSON protocol of the St. Louis Fed's public data service: an
``observations`` list of date, value and realtime_start, all strings. Its transport is a parameter, so
tests need no network. ``ObservationSource`` offers the same as a Spark data source: one partition for
each series code, of all vintages or of the newest one, date filters become request parameters. Refusals that
pass (too many requests, a busy server, no connection) are tried again after growing pauses.

As a stream the source knows for each code the last day whose vintages it has given. A batch asks for the days since
then only, each code in windows of days that are tasks of their own, so a restart fetches what is new, and a code that
is added later gets its whole history.
"""

from __future__ import annotations

import json
import logging
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from tidewatch.config import SeriesMeta
from tidewatch.session import ship
from tidewatch.sources.observations import file_name, has_vintages

BASE_URL = "https://api.stlouisfed.org/fred"
KEY_VARIABLE = "FRED_API_KEY"
TIMEOUT_S = 30
#: Answers after which a request is made again, how often by default, and the first pause, which doubles.
BUSY, RETRIES, PAUSE_S = (408, 425, 429, 500, 502, 503, 504), 4, 0.5
FIRST_REALTIME, LAST_REALTIME = "1980-01-01", "9999-12-31"

#: (url, parameters) -> (status, body)
Transport = Callable[[str, dict], tuple[int, str]]
log = logging.getLogger(__name__)


class ObservationError(RuntimeError):
    """The service refused, or its answer has not the expected form."""


def _urllib(url: str, params: dict) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=TIMEOUT_S) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


@dataclass(frozen=True)
class ObservationClient:
    api_key: str
    base_url: str = BASE_URL
    transport: Transport = _urllib
    retries: int = 0
    pause_s: float = PAUSE_S

    @classmethod
    def from_env(cls, **kw) -> ObservationClient:
        """The key from the environment, which a .env file may have filled in; with retries unless told otherwise."""
        try:
            from dotenv import load_dotenv

            load_dotenv()
        except ImportError:
            pass
        key = os.environ.get(KEY_VARIABLE)
        if not key:
            raise RuntimeError(f"{KEY_VARIABLE} is not set")
        return cls(key, **{"retries": RETRIES} | kw)

    def get(self, endpoint: str, params: Mapping[str, str]) -> dict:
        status, body = self._answer(f"{self.base_url}/{endpoint}", {**params, "api_key": self.api_key, "file_type": "json"})
        if status != 200:
            raise ObservationError(f"status {status}: {body[:200]}")
        try:
            data = json.loads(body)
        except ValueError as e:
            raise ObservationError(f"no JSON in the answer: {e}") from e
        if "error_code" in data:
            raise ObservationError(f"the service reports an error: {data}")
        return data

    def _answer(self, url: str, params: dict) -> tuple[int, str]:
        """The transport's answer; one that says "not now", and a broken connection, are tried ``retries`` times more."""
        for k in range(self.retries + 1):
            try:
                status, body = self.transport(url, params)
            except OSError as e:  # no connection, or a timeout
                if k == self.retries:
                    raise ObservationError(f"no answer: {e}") from e
            else:
                if status not in BUSY or k == self.retries:
                    return status, body
            time.sleep(self.pause_s * 2**k)
        raise AssertionError("unreachable")

    def _observations(self, code: str, needed: tuple[str, ...], **params: str | None) -> Iterator[dict]:
        for x in self.get("series/observations", {"series_id": code} | {k: v for k, v in params.items() if v}).get("observations", []):
            if any(k not in x for k in needed):
                raise ObservationError(f"unexpected form for series {code}: {sorted(x)}")
            yield x

    def final_series(self, code: str, start: str | None = None, end: str | None = None) -> list[tuple[date, float]]:
        """(ref_period, value) of the newest vintage, without missing values, in order."""
        rows = ((date.fromisoformat(x["date"]), _value(x["value"])) for x in self._observations(code, ("date", "value"), observation_start=start, observation_end=end))
        return sorted((d, v) for d, v in rows if v is not None)

    def vintage_series(self, code: str, start: str | None = None, end: str | None = None, realtime_start: str = FIRST_REALTIME, realtime_end: str = LAST_REALTIME) -> list[tuple[date, date, float]]:
        """(ref_period, vintage_date, value) of all vintages, without missing values, in order."""
        found = self._observations(code, ("date", "value", "realtime_start"), observation_start=start, observation_end=end, realtime_start=realtime_start, realtime_end=realtime_end)
        rows = ((date.fromisoformat(x["date"]), date.fromisoformat(x["realtime_start"]), _value(x["value"])) for x in found)
        return sorted((d, v, x) for d, v, x in rows if x is not None)


def _value(text: str) -> float | None:
    try:
        v = float(text)
    except (TypeError, ValueError):
        return None
    return v if v == v else None


# -- sync -------------------------------------------------------------------------------------------


def sync_series(spark: SparkSession, meta: SeriesMeta, client: ObservationClient, data_dir: str, start: str = "1970-01-01", end: str | None = None) -> str:
    """Fetch one series and overwrite its CSV; returns the path. One series is one answer of the service, so it is small."""
    if has_vintages(meta):
        rows, schema = client.vintage_series(meta.code, start, end), "ref_period date, vintage_date date, value double"
    else:
        rows, schema = client.final_series(meta.code, start, end), "ref_period date, value double"
    path = f"{data_dir}/{file_name(meta)}"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def sync_all(spark: SparkSession, metas: Mapping[str, SeriesMeta], data_dir: str, client: ObservationClient | None = None, start: str = "1970-01-01", end: str | None = None, only: list[str] | None = None) -> dict[str, str]:
    """Sync the configured series, or those named in ``only``; the first failure is raised. Returns {series: path}."""
    client = client or ObservationClient.from_env()
    out = {}
    for series, meta in metas.items():
        if only is not None and series not in only:
            continue
        try:
            out[series] = sync_series(spark, meta, client, data_dir, start, end)
        except (ObservationError, ValueError):
            log.exception("sync of %s failed", series)
            raise
    return out


# -- data source ------------------------------------------------------------------------------------


@dataclass
class _Code(InputPartition):
    code: str
    final: bool = False


class ObservationReader(DataSourceReader):
    def __init__(self, client: ObservationClient, codes: list[str], final: list[str] | None = None):
        self.client, self.codes, self.final, self.start, self.end = client, codes, final or [], None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of ref_period go to the service; they are also returned, as it may answer with more."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)) and f.attribute == ("ref_period",) and isinstance(f.value, date):
                if not isinstance(f, LessThanOrEqual):
                    self.start = max(self.start or "", f.value.isoformat())
                if not isinstance(f, GreaterThanOrEqual):
                    self.end = min(self.end or "9999", f.value.isoformat())
            yield f

    def partitions(self) -> list[InputPartition]:
        return [*[_Code(c) for c in self.codes], *[_Code(c, True) for c in self.final]]

    def read(self, partition: _Code) -> Iterator[tuple]:
        if partition.final:
            for ref_period, value in self.client.final_series(partition.code, self.start, self.end):
                yield partition.code, ref_period, None, value
            return
        for ref_period, vintage_date, value in self.client.vintage_series(partition.code, self.start, self.end):
            yield partition.code, ref_period, vintage_date, value


@dataclass
class _Window(InputPartition):
    """The vintages of a code from one day to another, both included."""

    code: str
    first: str
    last: str


def _day(text: str, plus: int) -> str:
    return (date.fromisoformat(text) + timedelta(days=plus)).isoformat()


class ObservationStreamReader(DataSourceStreamReader):
    """Offsets are {code: last day given}; the days of a batch are cut into windows of at most ``window_days``."""

    def __init__(self, client: ObservationClient, codes: list[str], until: str | None = None, window_days: int = 3650):
        if window_days < 1:
            raise ValueError("window_days is at least 1")
        self.client, self.codes, self.until, self.window_days = client, codes, until, window_days

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Yesterday, as a day's vintages are complete when it is over; or the day of the option ``until``."""
        last = self.until or (date.today() - timedelta(days=1)).isoformat()
        return {c: last for c in sorted(set(self.codes))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for code, last in end.items():
            first = _day(start[code], 1) if code in start else FIRST_REALTIME
            while first <= last:
                to = min(_day(first, self.window_days - 1), last)
                out.append(_Window(code, first, to))
                first = _day(to, 1)
        return out

    def read(self, partition: _Window) -> Iterator[tuple]:
        """Vintages that begin inside the window.

        The service cuts a vintage's time off where the request begins, so what was there already seems to begin on
        that day. The request begins a day earlier, and what begins on that day is left out.
        """
        oldest = partition.first == FIRST_REALTIME
        asked = partition.first if oldest else _day(partition.first, -1)
        for ref_period, vintage_date, value in self.client.vintage_series(partition.code, realtime_start=asked, realtime_end=partition.last):
            if partition.first <= vintage_date.isoformat() <= partition.last:
                yield partition.code, ref_period, vintage_date, value

    def commit(self, end: dict) -> None:
        """Nothing is held between batches."""


class ObservationSource(DataSource):
    """spark.dataSource.register(ObservationSource); spark.read.format("observations").option("codes", "A,B").load()

    Options: codes of series with all vintages and final_codes of series with the newest one only, whose vintage_date
    is null (both separated by commas), base_url, api_key (default: the environment), retries. A stream
    (``readStream``) has the vintages of ``codes``; until: its last day, window_days: days of a request.
    """

    transport: Transport = staticmethod(_urllib)

    @classmethod
    def name(cls) -> str:
        return "observations"

    def schema(self) -> str:
        return "code string, ref_period date, vintage_date date, value double"

    def _client(self) -> ObservationClient:
        key = self.options.get("api_key") or os.environ.get(KEY_VARIABLE)
        if not key:
            raise RuntimeError(f"{KEY_VARIABLE} is not set")
        return ObservationClient(key, self.options.get("base_url", BASE_URL), type(self).transport, int(self.options.get("retries", RETRIES)))

    def _codes(self, option: str) -> list[str]:
        return [c.strip() for c in self.options.get(option, "").split(",") if c.strip()]

    def reader(self, schema) -> DataSourceReader:
        return ObservationReader(self._client(), self._codes("codes"), self._codes("final_codes"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        if self._codes("final_codes"):
            raise ValueError("a series without vintages has no days to go on from: read it as a batch")
        return ObservationStreamReader(self._client(), self._codes("codes"), self.options.get("until"), int(self.options.get("window_days", 3650)))


def read_configured(spark: SparkSession, metas: Mapping[str, SeriesMeta], source: type[ObservationSource] = ObservationSource, **options: str) -> DataFrame:
    """(series, ref_period, vintage_date, value) of all configured series in one scan, a task for each: straight from the service, without files."""
    by = {final: [m.code for m in metas.values() if has_vintages(m) != final] for final in (False, True)}
    found = read_observations(spark, by[False], source, final_codes=",".join(by[True]), **options)
    names = spark.createDataFrame([(m.code, not has_vintages(m), k) for k, m in metas.items()], "code string, final boolean, series string")
    met = found.withColumn("final", F.col("vintage_date").isNull()).join(F.broadcast(names), ["code", "final"])  # a row for each configured series
    return met.select("series", "ref_period", "vintage_date", "value")


def read_observations(spark: SparkSession, codes: list[str], source: type[ObservationSource] = ObservationSource, **options: str) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(codes=",".join(codes), **options).load()


def stream_configured(spark: SparkSession, metas: Mapping[str, SeriesMeta], source: type[ObservationSource] = ObservationSource, **options: str) -> DataFrame:
    """(series, ref_period, vintage_date, value) of the configured series with vintages, as a stream of what the service adds: for ``append_calendar`` or ``update_state``."""
    ship(spark)
    spark.dataSource.register(source)
    names = spark.createDataFrame([(m.code, k) for k, m in metas.items() if has_vintages(m)], "code string, series string")
    codes = ",".join(sorted({m.code for m in metas.values() if has_vintages(m)}))
    found = spark.readStream.format(source.name()).options(codes=codes, **options).load()
    return found.join(F.broadcast(names), "code").select("series", "ref_period", "vintage_date", "value")  # a row for each configured series
