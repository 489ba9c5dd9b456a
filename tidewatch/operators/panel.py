"""Daily as-of panels: for each series and day, the newest value that could be seen on that day.

The panel is long: (series, as_of_date, value, ref_period, age_days, is_new_release). Observations are
reduced to one event a day before they are shuffled, by series and day, so a series with a large share
of all rows is spread; only events, a row a day at most, then meet by series, where they are carried
forward and expanded into days. There is no join of days with events. Wide forms are made at the edge,
by conditional aggregation.

Semantics: events outside [start, end] play no part, so a panel begins with nulls until the first event
inside (unless ``carry_in``); each column is carried forward on its own, so a null value under a newer
period shows the older value with the newer period; age counts from the newest event.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.config import SeriesMeta
from tidewatch.operators.calendar import build_calendar
from tidewatch.sources.observations import load_all_raw_series

MEASURES = ("value", "ref_period", "age_days", "is_new_release")


def by_vintage_mode(cal: DataFrame, metas: Mapping[str, SeriesMeta], keep_superseded: bool = False) -> DataFrame:
    """Each series by its own configured ``vintage_mode``, in one pass over release numbers within a period; adds release_number.

    first_release and latest keep one release of a period; all_releases keeps every one, each to be seen from its own
    vintage date on; reference keeps every one from the period's release on, so that the newest is shown.
    """
    modes = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, m in metas.items() for x in (k, m.vintage_mode)]), F.col("series")), F.lit("reference"))
    order = Window.partitionBy("series", "ref_period").orderBy(F.asc_nulls_first("vintage_date"), "available_date")
    numbered = cal.withColumns({"release_number": F.row_number().over(order), "__later": F.lead(F.lit(1)).over(order), "__mode": modes})
    kept = numbered.where(F.when(F.col("__mode") == "first_release", F.col("release_number") == 1).when((F.col("__mode") == "latest") & F.lit(not keep_superseded), F.col("__later").isNull()).otherwise(True))
    at = F.when(F.col("__mode") == "all_releases", F.greatest("available_date", "vintage_date")).otherwise(F.col("available_date"))
    return kept.withColumn("available_date", at).drop("__mode", "__later")


def pick_vintages(cal: DataFrame, mode: str = "reference") -> DataFrame:
    """Rows by vintage policy: each period's first or latest vintage, or all of them ("reference", "all_releases")."""
    if mode in ("reference", "all_releases"):
        return cal
    if mode not in ("first_release", "latest"):
        raise ValueError(f"unknown vintage mode {mode!r}")
    rest = [c for c in cal.columns if c not in ("series", "ref_period")]
    pick = F.min_by if mode == "first_release" else F.max_by
    kept = cal.groupBy("series", "ref_period").agg(pick(F.struct(*rest), F.struct("vintage_date", "available_date")).alias("x"))
    return kept.select("series", "ref_period", *[f"x.{c}" for c in rest]).select(*cal.columns)


def headline_events(cal: DataFrame) -> DataFrame:
    """One event for each series and available_date: the newest period, of that the newest vintage."""
    best = F.max_by(F.struct("value", "ref_period"), F.struct("ref_period", "vintage_date"))
    return cal.where("available_date is not null").groupBy("series", "available_date").agg(best.alias("x")).select("series", "available_date", "x.value", "x.ref_period")


def panel_events(cal: DataFrame, start: str, end: str, *, carry_in: bool = False, as_of: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """What the panel shows from one event to the next: (by, series, at, value, ref_period, seen, begin, last, days).

    The days from begin to last show value and ref_period, each carried forward on its own; before ``at`` (the first
    days of a series) nothing is known. ``by``: columns that tell apart calendars of the same series; with "as_of"
    among them each calendar ends on its own date.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    if "as_of" in by:
        hi = F.least(hi, F.col("as_of"))
    if as_of is not None:
        hi = F.least(hi, F.lit(as_of).cast("date"))
    at, group = F.col("available_date"), [*by, "series"]
    inside = F.coalesce((at <= hi) if carry_in else at.between(lo, hi), F.lit(False))
    if as_of is not None:
        inside = inside & (F.col("vintage_date").isNull() | (F.col("vintage_date") <= F.lit(as_of).cast("date")))
    # What lies outside becomes an empty event on the first day, so that its series still has rows.
    keyed = cal.select(*group, F.when(inside, at).otherwise(lo).alias("at"), inside.alias("real"), "value", "ref_period", "vintage_date")
    best = F.max_by(F.struct("value", "ref_period", "real"), F.struct("real", "ref_period", "vintage_date"))
    events = keyed.groupBy(*group, "at").agg(best.alias("x"))
    blank = ~F.col("x.real")
    events = events.select(*group, "at", F.when(~blank, F.col("x.value")).alias("value"), F.when(~blank, F.col("x.ref_period")).alias("ref_period"), F.when(~blank, F.col("at")).alias("seen"))
    nearby = Window.partitionBy(*group).orderBy("at")
    upto = nearby.rowsBetween(Window.unboundedPreceding, 0)
    filled = events.select(*group, "at", *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in ("value", "ref_period", "seen")], F.lag("at").over(nearby).isNull().alias("first"), F.lead("at").over(nearby).alias("next"))
    begin = F.when(F.col("first"), lo).otherwise(F.greatest("at", lo))
    last = F.least(F.coalesce(F.date_sub("next", 1), hi), hi)
    filled = filled.withColumns({"begin": begin, "last": last}).where("begin <= last").drop("first", "next")
    return filled


def expand_days(events: DataFrame, *extra: str, by: Sequence[str] = ()) -> DataFrame:
    """``panel_events`` to a row for each day, with the columns of the long panel and ``extra`` ones of the event."""
    daily = events.withColumn("as_of_date", F.explode(F.sequence("begin", "last", F.expr("interval 1 day"))))
    known = F.col("as_of_date") >= F.col("at")
    seen = F.when(known, F.col("seen"))
    return daily.select(
        *by,
        "series",
        "as_of_date",
        F.when(known, F.col("value")).alias("value"),
        F.when(known, F.col("ref_period")).alias("ref_period"),
        F.datediff("as_of_date", seen).cast("double").alias("age_days"),
        F.coalesce(seen == F.col("as_of_date"), F.lit(False)).cast("tinyint").alias("is_new_release"),
        *[F.when(known, F.col(c)).alias(c) for c in extra],
    )


def daily_panel(cal: DataFrame, start: str, end: str, *, carry_in: bool = False, as_of: str | None = None) -> DataFrame:
    """The long panel of every series in ``cal`` for each day from start to end.

    ``carry_in`` lets the newest event before the start fill the first days. ``as_of`` shows what was known on that
    date: no vintage dated later, no event that becomes available later, no day after it.
    """
    return expand_days(panel_events(cal, start, end, carry_in=carry_in, as_of=as_of))


def vintage_panel(cal: DataFrame, start: str, end: str) -> DataFrame:
    """The panel with a jagged edge: each vintage is seen from its own date, no revision earlier."""
    strict = F.greatest("release_date", "vintage_date")
    return daily_panel(cal.withColumn("available_date", strict), start, end)


def wide_panel(panel: DataFrame, measure: str, names: Sequence[str]) -> DataFrame:
    """as_of_date x series of one measure, columns in the names' code point order."""
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    return panel.groupBy("as_of_date").agg(*[F.first(F.when(F.col("series") == s, F.col(measure)), ignorenulls=True).alias(s) for s in sorted(names)])


def macro_panels(panel: DataFrame, names: Sequence[str]) -> dict[str, DataFrame]:
    """The wide panels of all measures."""
    return {m: wide_panel(panel, m, names) for m in MEASURES}


def panels_from_raw(spark: SparkSession, metas: Mapping[str, SeriesMeta], data_dir: str, start: str = "1980-01-01", end: str | None = None, **kw) -> DataFrame:
    """Files to long panel. ``end``: today if not given."""
    end = end or str(spark.sql("select current_date() d").first()["d"])
    return daily_panel(build_calendar(load_all_raw_series(spark, metas, data_dir), metas), start, end, **kw)


def panel_range(panel: DataFrame) -> DataFrame:
    return panel.agg(F.min("as_of_date").alias("start_date"), F.max("as_of_date").alias("end_date"))


def apply_missing_policy(panel: DataFrame, metas: Mapping[str, SeriesMeta], stale_days: int = 0, columns: Sequence[str] = ("value",)) -> DataFrame:
    """Values (``columns``) by the series' missing policy, and is_missing, of the first of them.

    carry_forward keeps the carried value; skip keeps it only up to ``stale_days`` after its release;
    zero puts 0 and flag_only null where a value is missing or stale. is_missing marks those days.
    """
    by = {k: m.missing_policy for k, m in metas.items()}
    policy = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in by.items() for x in kv]), F.col("series")), F.lit("skip"))

    def missing(c: str) -> Column:
        return F.coalesce(F.col(c).isNull() | (F.col("age_days") > stale_days), F.lit(True))

    kept = {c: F.when(~missing(c) | (policy == "carry_forward"), F.col(c)).when(policy == "zero", F.lit(0.0)) for c in columns}
    return panel.withColumns({**kept, "is_missing": missing(columns[0]).cast("tinyint")})


def derived_features(panel: DataFrame, half_life_days: float = 30.0) -> DataFrame:
    """Age, news and missingness as numbers: freshness decays by half every ``half_life_days``; news is the change on a release day."""
    before = F.lag("value").over(Window.partitionBy("series").orderBy("as_of_date"))
    return panel.withColumns({
        "missing": F.col("value").isNull().cast("tinyint"),
        "freshness": F.coalesce(F.pow(F.lit(0.5), F.col("age_days") / half_life_days), F.lit(0.0)),
        "news": F.when(F.col("is_new_release") == 1, F.col("value") - before),
    })
