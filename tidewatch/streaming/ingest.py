"""Vintages as a stream: files of new observations are dated and appended to the calendar table exactly once.

The as-of panel is then a batch query over that table; a late vintage is a new row with its own date.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.config import SeriesMeta
from tidewatch.operators.calendar import build_calendar
from tidewatch.plans.daily_state import DailyState
from tidewatch.sources.observations import number

FILE_SCHEMA = "series string, ref_period string, vintage_date string, value string"


def stream_observations(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files (series, ref_period, vintage_date, value) as they arrive; dates that do not parse stop the stream."""
    rows = spark.readStream.schema(FILE_SCHEMA).option("header", True).csv(folder)
    return rows.select("series", F.col("ref_period").cast("date").alias("ref_period"), F.col("vintage_date").cast("date").alias("vintage_date"), number(F.col("value")).alias("value"))


def append_calendar(stream: DataFrame, metas: Mapping[str, SeriesMeta], path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Dates the stream's rows and appends them to a Parquet table, a folder for each series. The file sink's log makes it exactly once."""
    out = build_calendar(stream, metas).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("series").outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()


def update_state(stream: DataFrame, state: DailyState, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Takes the stream's rows into the state of daily runs, a step for each micro-batch. A batch that is given again after a failure is taken once, by its number."""
    out = stream.writeStream.foreachBatch(lambda rows, batch: state.add(rows, batch)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
