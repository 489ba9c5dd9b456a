"""Two times at once: the period a value is about, and the days on which a vintage was the newest known of it.

A vintage of a period is known from its release or its vintage date on, whichever is later, until the next one
is. With these intervals a calendar, its panels, features and datasets can be had as of many dates in one plan:
a row goes to every date inside its interval, and everything that follows is kept apart by ``as_of``. No row of
such a result comes from a vintage dated after its date.

``knowledge_features`` follows time itself: for every day, the features as known on that very day. They change
only when a vintage of their series becomes known, so they are found for those dates and hold until the next.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import RollingConfig, SeriesMeta
from tidewatch.functions.labels import trainer_bucket
from tidewatch.operators import factors
from tidewatch.operators.features import event_features
from tidewatch.operators.panel import expand_days, panel_events

BY = ("as_of",)


def known_intervals(cal: DataFrame) -> DataFrame:
    """The calendar with known_from and known_to (the day on which a newer vintage is known; null if none): a row for each vintage that was ever the newest of its period and available_date.

    Of vintages that become known on the same day the newest counts. A vintage without a date is known from its
    release on; rows without a release are never known.
    """
    since = F.greatest("available_date", "release_date", "vintage_date")
    on = ["series", "ref_period", "available_date"]  # the vintages that one event of a panel may show
    rest = [c for c in cal.columns if c not in on]
    dated = cal.withColumn("known_from", since).where("known_from is not null and available_date is not null")
    one = dated.groupBy(*on, "known_from").agg(F.max_by(F.struct(*rest), "vintage_date").alias("x"), F.first(F.struct(*rest)).alias("undated"))  # max_by knows dated ones only
    one = one.withColumn("x", F.coalesce("x", "undated")).select(*on, "known_from", *[f"x.{c}" for c in rest])
    # A vintage older than one that is known already is never the newest.
    order = Window.partitionBy(*on).orderBy("known_from")
    newest = F.max("vintage_date").over(order.rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("__newest", newest).where("__newest is null or vintage_date > __newest").drop("__newest")
    return one.withColumn("known_to", F.lead("known_from").over(order)).select(*cal.columns, "known_from", "known_to")


def as_known(cal: DataFrame, as_ofs: Sequence[str | date]) -> DataFrame:
    """The calendar as of each of the dates, with ``as_of``: a row for each date on which it was the newest known of its period."""
    dates = F.array(*[F.lit(str(a)).cast("date") for a in sorted({str(a) for a in as_ofs})]).cast("array<date>")
    inside = F.filter(dates, lambda a: (a >= F.col("known_from")) & (F.col("known_to").isNull() | (a < F.col("known_to"))))
    return known_intervals(cal).select(*cal.columns, F.explode(inside).alias("as_of"))


def panels_as_of(cal: DataFrame, as_ofs: Sequence[str | date], start: str, end: str) -> DataFrame:
    """(as_of, series, as_of_date, value, ref_period, age_days, is_new_release): each date's panel up to it, from what was known on it. A series of which nothing was known has no rows."""
    return expand_days(panel_events(as_known(cal, as_ofs), start, end, by=BY), by=BY)


def features_as_of(cal: DataFrame, metas: Mapping[str, SeriesMeta], as_ofs: Sequence[str | date], start: str, end: str) -> DataFrame:
    """(as_of, series, as_of_date, ref_period, value, feature, age_days) as of each of the dates."""
    events = event_features(panel_events(as_known(cal, as_ofs), start, end, by=BY), metas, BY)
    return expand_days(events, "feature", by=BY).select("as_of", "series", "as_of_date", "ref_period", "value", "feature", "age_days")


def knowledge_features(cal: DataFrame, metas: Mapping[str, SeriesMeta], start: str, end: str) -> DataFrame:
    """(series, as_of_date, ref_period, value, feature, age_days): every day as it was known on that day."""
    known = known_intervals(cal)
    changes = known.groupBy("series").agg(F.array_sort(F.collect_set("known_from")).alias("changes"))  # days of one series
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = F.filter("changes", lambda a: (a >= F.col("known_from")) & (F.col("known_to").isNull() | (a < F.col("known_to"))) & a.between(lo, hi))
    met = known.join(changes, "series").select(*cal.columns, F.explode(inside).alias("as_of"))
    events = event_features(panel_events(met, start, end, by=BY), metas, BY)
    newest = events.groupBy("series", "as_of").agg(F.max_by(F.struct("ref_period", "value", "feature", "seen"), "at").alias("x"))
    order = Window.partitionBy("series").orderBy("as_of")
    until = F.coalesce(F.date_sub(F.lead("as_of").over(order), 1), hi)
    held = newest.withColumn("until", until).select("series", F.explode(F.sequence("as_of", "until", F.expr("interval 1 day"))).alias("as_of_date"), "x.*")
    held = held.select("series", "as_of_date", "ref_period", "value", "feature", F.datediff("as_of_date", "seen").cast("double").alias("age_days"))
    # Days before anything is known have rows, too.
    first = held.groupBy("series").agg(F.min("as_of_date").alias("first"))
    rest = cal.select("series").distinct().join(first, "series", "left").withColumn("until", F.coalesce(F.date_sub("first", 1), hi)).where(F.col("until") >= lo)
    none = [F.lit(None).cast(dict(held.dtypes)[c]).alias(c) for c in ("ref_period", "value", "feature", "age_days")]
    return held.unionByName(rest.select("series", F.explode(F.sequence(lo, F.col("until"), F.expr("interval 1 day"))).alias("as_of_date"), *none))


def fits_as_of(datasets: DataFrame, xs: Sequence[str] | str, cfg: RollingConfig) -> DataFrame:
    """``rolling.fits`` where each refit learns from its own dataset: that with ``as_of`` equal to the refit date.

    Rows of a window are summed up in the tasks that make them; states are shuffled, not rows.
    """
    inside = (F.col("origin_date") < F.col("as_of")) & (F.col("origin_date") >= F.add_months("as_of", -12 * cfg.window_years))
    stage = trainer_bucket(F.col("model_target_release_date"), F.col("origin_date"))
    rows = datasets.where(inside & F.col("y").isNotNull()).select(F.col("as_of").alias("refit_date"), stage.alias("stage"), F.col("y").cast("double").alias("y"), factors.vector(xs).alias("x"))
    return factors.single_fits(factors.states(rows, ["refit_date", "stage"]))
