"""Daily runs from a state table: new files touch the months whose rows they change, and nothing else is computed again.

The state holds what a run needs as of its newest refit date, each part a Parquet table:

- known: of each period the newest vintage known by that date, a row however many vintages there were;
- pending: vintages that become known later;
- events: what the panel shows from one release to the next, with its feature;
- states: the regression's mergeable states (``factors``) by month and stage.

New rows, or a later refit date, change the known vintages of some series. Only these series' events are found
again; where they differ from the old ones lie the months whose regression rows change, by a late vintage or
because their days are new, and only these months' rows are built and summed up. ``run_daily`` merges the months
of its window, shows the day's events, and gives what ``Nowcaster.run_daily`` gives over all rows ever added.

A step writes the state as a new version, which counts from the moment its last file, the record, is written: a
run that dies leaves the version before. The one before stays for runs that still read it; older ones go. One
writer at a time. Vintages of the same period and date with different values are, as everywhere, one of them.

Defined results: rows without a period or release never count; repeated rows change nothing; no rows give no
nowcast; other columns of the rows are left out; a series without configuration stops the step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidewatch.functions.labels import trainer_bucket
from tidewatch.operators import bitemporal, factors, rolling, signals
from tidewatch.operators.calendar import CALENDAR_COLUMNS
from tidewatch.operators.dataset import bridge_dataset, feature_columns
from tidewatch.operators.features import event_features
from tidewatch.operators.panel import expand_days, panel_events
from tidewatch.plans.engine import Nowcaster
from tidewatch.session import cut
from tidewatch.sources.observations import path_exists

EVENT = ("series", "at", "value", "ref_period", "seen", "begin", "last", "feature")
#: The record of a version, and the columns of a batch of new rows.
RECORD = "version long, settings string, as_of date, batch long, months array<int>"
RAW = "series string, ref_period date, vintage_date date, value double"


class DailyState:
    """The state of a configured run below ``path``. The run's own ``raw`` is not read: rows come by ``add``."""

    def __init__(self, run: Nowcaster, path: str):
        if run.policies:
            raise ValueError("vintage modes of the configuration need every release; the state keeps the newest")
        self.run, self.path, self.spark = run, path.rstrip("/"), run.raw.sparkSession
        told = repr((sorted(run.metas.items()), run.target, run.start, run.end, run.rolling, run.strict))
        self.settings = hashlib.sha256(told.encode()).hexdigest()

    # -- versions -----------------------------------------------------------------------------------

    def _folder(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder, fs = self._folder()
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and path_exists(self.spark, f"{self.path}/{n}/record/_SUCCESS"))

    def _at(self, version: int, part: str) -> str:
        return f"{self.path}/v{version}/{part}"

    def record(self) -> Row | None:
        """The newest version's record: version, settings, as_of, batch (the last one of a stream), months (those built by its step); None before anything is added."""
        found = self._versions()
        if not found:
            return None
        row = self.spark.read.parquet(self._at(found[-1], "record")).first()
        if row["settings"] != self.settings:
            raise ValueError(f"the state at {self.path} belongs to a run with other settings")
        return row

    def part(self, name: str, version: int | None = None) -> DataFrame:
        """known, pending, events or states."""
        return self.spark.read.parquet(self._at(self._versions()[-1] if version is None else version, name))

    # -- steps --------------------------------------------------------------------------------------

    def add(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Take new rows (series, ref_period, vintage_date, value) in. A stream's batch that was taken before is left out: False."""
        old = self.record()
        if old is not None and batch is not None and old["batch"] is not None and batch <= old["batch"]:
            return False
        as_of = old["as_of"] if old is not None else date.fromisoformat(self.run.rolling.test_start)
        self._step(old, rows, as_of, batch)
        return True

    def _dated(self, rows: DataFrame) -> DataFrame:
        cal = replace(self.run, raw=rows.select("series", "ref_period", "vintage_date", "value")).calendar().select(*CALENDAR_COLUMNS)
        since = F.greatest("available_date", "release_date", "vintage_date")
        return cal.withColumn("known_from", since).where("known_from is not null and available_date is not null and ref_period is not null")

    def _newest(self, pool: DataFrame, as_of: date) -> DataFrame:
        """Of the vintages known by ``as_of`` the newest of each period and available_date."""
        on = ["series", "ref_period", "available_date"]
        rest = [c for c in pool.columns if c not in on]
        newest = F.max_by(F.struct(*rest), F.struct(F.col("vintage_date").isNotNull(), F.col("vintage_date")))
        return pool.where(F.col("known_from") <= F.lit(as_of)).groupBy(*on).agg(newest.alias("x")).select(*on, *[f"x.{c}" for c in rest]).select(*pool.columns)

    def _events(self, known: DataFrame) -> DataFrame:
        """Events until the end of the panel: a date of the state only cuts off days."""
        return event_features(panel_events(known.select(*CALENDAR_COLUMNS), self.run.start, self.run.end), self.run.metas).select(*EVENT)

    def _rows(self, events: DataFrame, months: Sequence[int] | None, until: date) -> DataFrame:
        """The regression rows of some months (None: of all), as of a date."""
        events = events.withColumn("last", F.least("last", F.lit(until))).where("begin <= last")
        if months is not None:
            first = F.trunc("begin", "MONTH")
            starts = F.filter(F.sequence(first, F.trunc("last", "MONTH"), F.expr("interval 1 month")), lambda m: factors.month_number(m).isin(list(months)))
            events = events.withColumn("month", F.explode(starts)).withColumns({"begin": F.greatest("begin", "month"), "last": F.least("last", F.last_day("month"))})
        return bridge_dataset(None, self.run.metas, self.run.target, daily=expand_days(events, "feature"))

    def _summed(self, ds: DataFrame) -> DataFrame:
        stage = trainer_bucket(F.col("model_target_release_date"), F.col("origin_date"))
        rows = ds.where("y is not null").select(factors.month_number(F.col("origin_date")).alias("month"), stage.alias("stage"), F.col("y").cast("double").alias("y"), factors.vector(rolling.features_of(ds)).alias("x"))
        return factors.states(rows, ["month", "stage"])

    def _step(self, old: Row | None, rows: DataFrame | None, as_of: date, batch: int | None) -> None:
        version = 1 if old is None else old["version"] + 1
        rows = self.spark.createDataFrame([], RAW) if rows is None else rows
        new = cut(self._dated(rows))  # read twice, and a stream's rows may come once only
        if old is None:
            base, late = new.limit(0), new
            before = self._events(base).limit(0)
        else:
            base, late = self.part("known", old["version"]), self.part("pending", old["version"]).unionByName(new)
            before = self.part("events", old["version"])

        def put(df: DataFrame, part: str) -> DataFrame:
            df.write.mode("overwrite").parquet(self._at(version, part))
            return self.spark.read.parquet(self._at(version, part))

        put(late.where(F.col("known_from") > F.lit(as_of)), "pending")
        known = put(self._newest(base.unionByName(late), as_of), "known")
        touched = late.where(F.col("known_from") <= F.lit(as_of)).select("series").distinct()
        changed = self._events(known.join(touched, "series", "left_semi"))
        events = put(before.join(touched, "series", "left_anti").unionByName(changed), "events")
        months = self._changed_months(old, before, events, touched, as_of)
        found = self._summed(self._rows(events, months, as_of))
        if old is not None:
            found = found.unionByName(self.part("states", old["version"]).where(~F.col("month").isin(months)))
        put(found, "states")
        last = batch if batch is not None else old["batch"] if old is not None else None
        put(self.spark.createDataFrame([(version, self.settings, as_of, last, months)], RECORD), "record")
        folder, fs = self._folder()
        for v in self._versions()[:-2]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)

    def _changed_months(self, old: Row | None, before: DataFrame, after: DataFrame, touched: DataFrame, as_of: date) -> list[int]:
        """The months in which the touched series' events differ, and those of the days that are new: some of the calendar's, on the driver."""
        both = before.withColumn("side", F.lit(-1)).unionByName(after.withColumn("side", F.lit(1))).join(touched, "series", "left_semi")
        spans = both.groupBy(*EVENT).agg(F.sum("side").alias("side")).where("side <> 0").select("begin", F.least("last", F.lit(as_of)).alias("last")).where("begin <= last")
        months = F.explode(F.sequence(factors.month_number(F.col("begin")), factors.month_number(F.col("last"))))
        found = {r["m"] for r in spans.select(months.alias("m")).distinct().collect()}
        if old is not None and old["as_of"] < as_of:
            found |= set(range(factors.month_of(old["as_of"]), factors.month_of(as_of) + 1))
        return sorted(found)

    # -- runs ---------------------------------------------------------------------------------------

    def run_daily(self, day: str, cfg: signals.SignalConfig | None = None) -> DataFrame:
        """What ``Nowcaster.run_daily`` gives, from the state: one row, or none if there is no model for the day.

        The first run of a month moves the state to the month's refit date. Days before that date's month need a full
        run: the state has forgotten the vintages that were the newest then.
        """
        old, rolled, at = self.record(), self.run.rolling, date.fromisoformat(day)
        refit = max(date.fromisoformat(rolled.test_start), at.replace(day=1))
        if old is None:
            self.add(self.spark.createDataFrame([], RAW))
            old = self.record()
        if old["as_of"] > refit:
            raise ValueError(f"the state is as of {old['as_of']}; {day} needs a full run")
        if old["as_of"] < refit:
            self._step(old, None, refit, None)
            old = self.record()
        version = old["version"]
        shown = self._events(self._newest(self.part("known", version).unionByName(self.part("pending", version)), at))
        here = shown.where(F.lit(at).between(F.col("begin"), F.col("last"))).withColumns({"begin": F.lit(at), "last": F.lit(at)})
        today = bridge_dataset(None, self.run.metas, self.run.target, daily=expand_days(here, "feature"))
        xs = rolling.features_of(today)
        if refit.day == 1:
            found = factors.window_fits(self.part("states", version), [], [refit], 12 * rolled.window_years)
        else:  # the window begins and ends inside months
            ds = self._rows(self.part("events", version), None, refit).withColumn("as_of", F.lit(refit))
            found = bitemporal.fits_as_of(ds, xs, rolled)
        return signals.to_signals(signals.nowcast_results(rolling.predict(today, found, xs, rolled), feature_columns(today)), cfg)
