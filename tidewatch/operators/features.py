"""Feature transforms: daily panel -> one value for each reference period -> transform -> back to days.

Differences are between neighbouring rows of a series, whatever gap lies between their periods.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import TRANSFORMS, SeriesMeta


def ref_level(panel: DataFrame) -> DataFrame:
    """(series, ref_period, value): the last value that the panel shows under each period."""
    solid = panel.where("value is not null and ref_period is not null")
    return solid.groupBy("series", "ref_period").agg(F.max_by("value", "as_of_date").alias("value"))


def _before(x: Column, by: Sequence[str]) -> Column:
    return F.lag(x).over(Window.partitionBy(*by, "series").orderBy("ref_period"))


def transformed(value: Column, transform: str, by: Sequence[str] = ()) -> Column:
    """The expression of one transform. Division by zero and logarithms of what is not positive give null."""
    if transform in ("", "level"):
        return value
    if transform == "diff":
        return value - _before(value, by)
    if transform == "mom":
        return F.try_divide(value, _before(value, by)) - 1
    if transform == "log_diff":
        log = F.ln(F.when(value > 0, value))
        return log - _before(log, by)
    raise ValueError(f"unknown transform {transform!r}; there are {TRANSFORMS}")


def transform_levels(levels: DataFrame, metas: Mapping[str, SeriesMeta], by: Sequence[str] = ()) -> DataFrame:
    """(by, series, ref_period, value, feature): each series by its own transform, all in one window pass."""
    out = F.lit(None).cast("double")
    for t in sorted({m.transform for m in metas.values()}):
        names = [k for k, m in metas.items() if m.transform == t]
        out = F.when(F.col("series").isin(names), transformed(F.col("value"), t, by)).otherwise(out)
    return levels.select(*by, "series", "ref_period", "value", out.alias("feature"))


def map_back(panel: DataFrame, features: DataFrame) -> DataFrame:
    """The panel with ``feature``: that of the period it shows on the day; null if the period has none."""
    found = features.select("series", "ref_period", "feature")
    return panel.join(found, ["series", "ref_period"], "left")


def features_daily(panel: DataFrame, metas: Mapping[str, SeriesMeta]) -> DataFrame:
    """(series, as_of_date, ref_period, value, feature) of all configured series.

    The panel is used twice, for the levels and to map them back; the levels have a row for each
    period, so both sides meet with the panel's series partitioning.
    """
    _check(metas)
    met = map_back(panel, transform_levels(ref_level(panel), metas))
    return met.select("series", "as_of_date", "ref_period", "value", "feature")


def _check(metas: Mapping[str, SeriesMeta]) -> None:
    unknown = [m.transform for m in metas.values() if m.transform not in TRANSFORMS]
    if unknown:
        raise ValueError(f"unknown transforms {unknown}; there are {TRANSFORMS}")


def event_features(events: DataFrame, metas: Mapping[str, SeriesMeta], by: Sequence[str] = ()) -> DataFrame:
    """``panel.panel_events`` with ``feature``: what ``features_daily`` gives for their days, found before any day is made.

    An event is shown on a day at least, so the last value shown under a period is that of its last event.
    """
    _check(metas)
    on = [*by, "series", "ref_period"]
    solid = events.where("value is not null and ref_period is not null")
    levels = solid.groupBy(*on).agg(F.max_by("value", "at").alias("value"))
    return events.join(transform_levels(levels, metas, by).select(*on, "feature"), on, "left")
