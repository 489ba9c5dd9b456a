"""Raw observations: (series, ref_period DATE, vintage_date DATE or null, value DOUBLE or null), all series in one long table.

Files are one CSV for each series code: ``{code}_vintage.csv`` (ref_period, vintage_date, value) or
``{code}.csv`` (ref_period, value). Dates that do not parse raise; values that do not become null.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import SeriesMeta

RAW_SCHEMA = "series string, ref_period date, vintage_date date, value double"
#: Files of a series, at most.
SALTS = 8
VINTAGE_COLUMNS, FINAL_COLUMNS = ("ref_period", "vintage_date", "value"), ("ref_period", "value")


def file_name(meta: SeriesMeta) -> str:
    return f"{meta.code}_vintage.csv" if has_vintages(meta) else f"{meta.code}.csv"


def has_vintages(meta: SeriesMeta) -> bool:
    return meta.vintage_source.lower() == "alfred"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def number(text):
    """A double, null where the text is no finite number ('.' is a missing value)."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x), x)


def scan_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """The named columns of a CSV file as strings, whatever others it has and in whatever order."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: sync the series first")
    found = spark.read.option("header", True).csv(path)
    missing = [c for c in columns if c not in found.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}; it has {found.columns}")
    return found.select(*columns)


def load_raw_series(spark: SparkSession, series: str, meta: SeriesMeta, data_dir: str) -> DataFrame:
    """One series in the long form. Rows have no order; consumers order by (ref_period, vintage_date)."""
    columns = VINTAGE_COLUMNS if has_vintages(meta) else FINAL_COLUMNS
    rows = scan_csv(spark, f"{data_dir}/{file_name(meta)}", columns)
    vintage = F.col("vintage_date").cast("date") if has_vintages(meta) else F.lit(None).cast("date")
    return rows.select(F.lit(series).alias("series"), F.col("ref_period").cast("date").alias("ref_period"), vintage.alias("vintage_date"), number(F.col("value")).alias("value"))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV file, or of the files of a folder; none if there is nothing."""
    hadoop, lines = spark._jvm.org.apache.hadoop.fs, spark._jvm.java
    at = hadoop.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        raise FileNotFoundError(f"{path} is missing: sync the series first")
    for f in files.listStatus(at):
        if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")):
            reader = lines.io.BufferedReader(lines.io.InputStreamReader(files.open(f.getPath()), "UTF-8"))
            try:
                return next(csv.reader([reader.readLine()]))
            finally:
                reader.close()
    return []


def load_all_raw_series(spark: SparkSession, metas: Mapping[str, SeriesMeta], data_dir: str) -> DataFrame:
    """All configured series: one scan for all files with the same columns, the series by the file's name.

    The driver reads the files' first lines only; the plan has as many scans as there are different headers.
    """
    groups: dict[tuple[str, ...], dict[str, list[str]]] = {}
    for series, meta in metas.items():
        path, columns = f"{data_dir}/{file_name(meta)}", VINTAGE_COLUMNS if has_vintages(meta) else FINAL_COLUMNS
        found = header_of(spark, path)
        missing = [c for c in columns if c not in found]
        if missing:
            raise ValueError(f"{path} lacks columns {missing}; it has {found}")
        groups.setdefault((str(has_vintages(meta)), *found), {}).setdefault(file_name(meta), []).append(series)
    out = spark.createDataFrame([], RAW_SCHEMA)
    for (vintages, *names), files in groups.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        rows = spark.read.schema(schema).option("header", True).csv([f"{data_dir}/{f}" for f in files])
        known = spark.createDataFrame([(quote(f), s) for f, of in files.items() for s in of], "file string, series string")  # a row for each series
        vintage = F.col("vintage_date").cast("date") if vintages == "True" else F.lit(None).cast("date")
        file = F.regexp_extract(F.input_file_name(), r"([^/]+\.csv)(?:/[^/]*)?$", 1)
        rows = rows.select(file.alias("file"), F.col("ref_period").cast("date").alias("ref_period"), vintage.alias("vintage_date"), number(F.col("value")).alias("value"))
        out = out.unionByName(rows.join(F.broadcast(known), "file").drop("file"))
    return out


def select_series(raw: DataFrame, names: Iterable[str] | None) -> DataFrame:
    """The rows of the named series; all rows if no names are given."""
    return raw if names is None else raw.where(F.col("series").isin(list(names)))


def write_raw(raw: DataFrame, path: str) -> None:
    """The long table as Parquet, a folder for each series: later scans of some series read only those.

    A series is dealt to ``SALTS`` tasks, so one with most of the rows is not written by a single one.
    """
    raw.repartition("series", F.pmod(F.xxhash64("ref_period", "vintage_date"), F.lit(SALTS))).write.mode("overwrite").partitionBy("series").parquet(path)


def read_raw(spark: SparkSession, path: str, names: Iterable[str] | None = None) -> DataFrame:
    return select_series(spark.read.parquet(path), names).select("series", "ref_period", "vintage_date", "value")


def structure_problems(spark: SparkSession, metas: Mapping[str, SeriesMeta], data_dir: str) -> dict[str, str]:
    """What is wrong with the files of the configured series: missing, without a required column, or empty."""
    found = {}
    for series, meta in metas.items():
        columns = VINTAGE_COLUMNS if has_vintages(meta) else FINAL_COLUMNS
        try:
            if scan_csv(spark, f"{data_dir}/{file_name(meta)}", columns).isEmpty():
                found[series] = "no rows"
        except (FileNotFoundError, ValueError) as e:
            found[series] = str(e)
    return found
