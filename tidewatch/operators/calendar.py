"""Release calendars: when each observation ends, is released and can be seen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import SeriesMeta, meta_frame
from tidewatch.functions.dates import available_date, period_end, release_date

CALENDAR_COLUMNS = ("series", "ref_period", "vintage_date", "value", "period_end", "release_date", "available_date")


def add_calendar(df: DataFrame, meta: SeriesMeta, strict: bool = False) -> DataFrame:
    """One series' rows with period_end, release_date and available_date."""
    if "ref_period" not in df.columns:
        raise ValueError(f"no ref_period column; there are {df.columns}")
    return _dated(df, F.lit(meta.freq), F.lit(meta.release_lag_days), strict)


def _dated(df: DataFrame, freq, lag, strict: bool) -> DataFrame:
    release = release_date(F.col("ref_period"), freq, lag)
    vintage = F.col("vintage_date") if "vintage_date" in df.columns else F.lit(None).cast("date")
    return df.withColumns({"period_end": period_end(F.col("ref_period"), freq), "release_date": release, "available_date": available_date(release, vintage, strict)})


def build_calendar(raw: DataFrame, metas: Mapping[str, SeriesMeta], strict: bool = False) -> DataFrame:
    """All series at once. A series without configuration raises when the plan runs.

    The configuration has a row for each configured series, so it is broadcast; the raw table is not
    shuffled.
    """
    meta = meta_frame(raw.sparkSession, metas).select("series", F.col("freq").alias("__freq"), F.col("release_lag_days").alias("__lag"))
    unknown = F.raise_error(F.concat(F.lit("series without configuration: "), F.coalesce("series", F.lit("null"))))
    # Both columns raise: a filter on the dates must not let the join drop such series.
    met = raw.join(F.broadcast(meta), "series", "left").withColumns({"__freq": F.coalesce("__freq", unknown.cast("string")), "__lag": F.coalesce("__lag", unknown.cast("int"))})
    return _dated(met, F.col("__freq"), F.col("__lag"), strict).drop("__freq", "__lag")


def unknown_series(raw: DataFrame, metas: Mapping[str, SeriesMeta]) -> DataFrame:
    """The series of ``raw`` that are not configured."""
    meta = meta_frame(raw.sparkSession, metas).select("series")
    return raw.select("series").distinct().join(F.broadcast(meta), "series", "left_anti")
