"""Nowcasts as results and as trading signals.

The thresholds are this library's own defaults: growth above ``high`` is +1, below ``low`` is -1,
otherwise 0. Confidence is how far the nowcast lies from the nearer threshold in units of its own
spread, as 1 - exp(-distance / sigma); without a spread it is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT_COLUMNS = ("origin_date", "target_quarter", "point", "std", "stage", "info_coverage", "meta")


@dataclass(frozen=True)
class SignalConfig:
    low: float = 0.0
    high: float = 2.5


def nowcast_results(preds: DataFrame, xs: list[str]) -> DataFrame:
    """Predictions in the common result form; info_coverage is the share of known features."""
    known = F.lit(0.0)
    for x in xs:
        known = known + F.col(x).isNotNull().cast("double")
    return preds.select("origin_date", F.col("model_target_ref_period").alias("target_quarter"), F.col("y_hat").alias("point"), F.col("nowcast_sigma").alias("std"), F.col("distance_bucket").alias("stage"), (known / max(1, len(xs))).alias("info_coverage"), F.create_map(F.lit("model_name"), F.col("model_name")).alias("meta"))


def to_signals(results: DataFrame, cfg: SignalConfig | None = None) -> DataFrame:
    """(origin_date, target_quarter, point, std, signal int, confidence double)."""
    cfg = cfg or SignalConfig()
    p = F.col("point")
    signal = F.when(p > cfg.high, 1).when(p < cfg.low, -1).when(p.isNotNull(), 0)
    distance = F.least(F.abs(p - cfg.high), F.abs(p - cfg.low))
    confidence = F.when(F.col("std") > 0, 1 - F.exp(-distance / F.col("std"))).otherwise(0.0)
    return results.select("origin_date", "target_quarter", "point", "std", signal.alias("signal"), F.when(p.isNotNull(), confidence).alias("confidence"))


def append_history(signals: DataFrame, path: str) -> None:
    """Adds signals to the history, a Parquet folder for each origin year."""
    signals.withColumn("origin_year", F.year("origin_date")).write.mode("append").partitionBy("origin_year").parquet(path)
