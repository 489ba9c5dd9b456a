"""Files between the steps of a run: optional scans, checked scans, the dataset cache and result sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.observations import number, path_exists

PREDICTION_COLUMNS = ("model_name", "origin_date", "target_ref_period", "target_release_date", "distance_to_release", "y", "y_hat")


def find_root(start: str | Path, markers: tuple[str, ...] = ("config", "data", ".git")) -> Path:
    """The nearest folder at or above ``start`` that holds one of the markers; ``start`` itself if none does."""
    start = Path(start).resolve()
    start = start if start.is_dir() else start.parent
    return next((p for p in (start, *start.parents) if any((p / m).exists() for m in markers)), start)


def read_csv_if_exists(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first of the paths that exists, all columns as strings; None if none does."""
    for p in paths:
        if path_exists(spark, p):
            return spark.read.option("header", True).csv(p)
    return None


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A result table as CSV with a header: a folder of files, or with ``one_file``, for tables of metrics, a single one."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Daily predictions written by ``write_csv``, with dates and numbers typed and required columns checked."""
    df = read_csv_if_exists(spark, path)
    if df is None:
        raise FileNotFoundError(f"{path} is missing: run the autoregressive baseline first")
    missing = [c for c in PREDICTION_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"predictions lack columns {missing}; they have {df.columns}")
    dates = [c for c in ("origin_date", "target_ref_period", "target_release_date", "train_start", "train_end") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("date") for c in dates} | {"distance_to_release": F.col("distance_to_release").try_cast("int"), "y": number(F.col("y")), "y_hat": number(F.col("y_hat"))})


def fingerprint(df: DataFrame, *settings: object) -> str:
    """A key of a table's rows, in any order, and of what is done with them: one pass, no sort."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`").isNull() for c in df.columns])
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("mixed"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("again")).first()
    return hashlib.sha256(repr((df.dtypes, tuple(row), settings)).encode()).hexdigest()


def parquet_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False, key: str | None = None) -> DataFrame:
    """The table at ``path``; it is built and written first if it does not exist or ``rebuild`` is set. Dates that do not parse become null.

    key: also if the table was built under another one, which is kept beside it at ``{path}.key``.
    """
    at = f"{path}.key"
    stale = key is not None and not (path_exists(spark, f"{at}/_SUCCESS") and [r[0] for r in spark.read.text(at).collect()] == [key])
    if rebuild or stale or not path_exists(spark, path):
        if path_exists(spark, at):  # the old key must not outlive its table
            spark.createDataFrame([("",)], "value string").write.mode("overwrite").text(at)
        build().write.mode("overwrite").parquet(path)
        if key is not None:
            spark.createDataFrame([(key,)], "value string").coalesce(1).write.mode("overwrite").text(at)
    df = spark.read.parquet(path)
    return df.withColumns({c: F.col(c).try_cast("date") for c in df.columns if c.endswith(("_date", "_ref_period"))})
