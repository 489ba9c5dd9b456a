"""Diagnostics: profiles, coverage, ordering checks and integrity validators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import SeriesMeta, meta_frame
from tidewatch.functions.dates import period_end
from tidewatch.operators.dataset import feature_columns, non_null_features
from tidewatch.operators.quantiles import exact_quantiles


def available_range(cal: DataFrame, margin_days: int = 30) -> DataFrame:
    """First and last available date of all series, with a margin on both sides."""
    return cal.agg(F.date_sub(F.min("available_date"), margin_days).alias("start_date"), F.date_add(F.max("available_date"), margin_days).alias("end_date"))


def samples_per_quarter(ds: DataFrame) -> DataFrame:
    return ds.groupBy("target_ref_period").agg(F.count(F.lit(1)).alias("samples"))


def quarter_thirds(ds: DataFrame) -> DataFrame:
    """By target quarter and third of its rows (in order of origin): rows, mean and median number of known features."""
    rows = ds.where("target_ref_period is not null").select("target_ref_period", "origin_date", non_null_features(feature_columns(ds)).alias("known"))
    ordered, whole = Window.partitionBy("target_ref_period").orderBy("origin_date"), Window.partitionBy("target_ref_period")
    pos, n = F.row_number().over(ordered) - 1, F.count(F.lit(1)).over(whole)
    placed = rows.select("target_ref_period", "known", pos.alias("pos"), n.alias("n"))
    third = F.when(F.col("pos") < F.floor(F.col("n") / 3), "early").when(F.col("pos") < F.floor(F.col("n") * 2 / 3), "mid").otherwise("late")
    return placed.groupBy("target_ref_period", third.alias("segment")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("known").alias("mean_known"), F.percentile("known", F.lit(0.5)).alias("median_known"))


def date_slice(ds: DataFrame, start: str, days: int = 10) -> DataFrame:
    first = F.lit(start).cast("date")
    return ds.where((F.col("origin_date") >= first) & (F.col("origin_date") <= F.date_add(first, days - 1)))


def decade_coverage(ds: DataFrame, decades: Sequence[int] = (1980, 1990, 2000, 2010, 2020)) -> DataFrame:
    """By feature and decade: known, all, and their ratio. A decade without rows has ratio null and counts 0."""
    xs = feature_columns(ds)
    decade = F.floor(F.year("origin_date") / 10) * 10
    per = ds.groupBy(decade.cast("int").alias("d")).agg(F.count(F.lit(1)).alias("total_count"), *[F.count(x).alias(x) for x in xs])
    long = per.unpivot(["d", "total_count"], xs, "feature", "known")
    spark = ds.sparkSession
    spine = spark.createDataFrame([(x, d) for x in xs for d in decades], "feature string, d int")
    met = spine.join(long, ["feature", "d"], "left")
    known, total = F.coalesce("known", F.lit(0)).cast("long"), F.coalesce("total_count", F.lit(0)).cast("long")
    return met.select("feature", F.concat(F.col("d").cast("string"), F.lit("s")).alias("decade"), (known / F.nullif(total, F.lit(0))).alias("coverage_ratio"), known.alias("non_missing_count"), total.alias("total_count"))


def calendar_violations(cal: DataFrame) -> DataFrame:
    """By series: rows, how often a date order is broken (available before release, before vintage, release before the period's end), and the range of availability."""
    return cal.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("available_date") < F.col("release_date")).alias("before_release"),
        F.count_if(F.col("available_date") < F.col("vintage_date")).alias("before_vintage"),
        F.count_if(F.col("release_date") < F.col("period_end")).alias("before_period_end"),
        F.min("available_date").alias("first_available"),
        F.max("available_date").alias("last_available"),
    )


def raw_profile(raw: DataFrame) -> DataFrame:
    """By series: rows, range of periods, and the values' count, mean, deviation, extremes and quartiles.

    Quartiles are exact for series of any size (``quantiles``): nothing grows with a series' values.
    """
    per = raw.groupBy("series").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ref_period").alias("first_ref"), F.max("ref_period").alias("last_ref"), F.count("value").alias("n_values"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    found = exact_quantiles(raw, ["series"], "value", list(names)).groupBy("series").agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for p, n in names.items()])
    met = per.alias("a").join(found.alias("b"), F.col("a.series").eqNullSafe(F.col("b.series")), "left")
    return met.select("a.series", "n_rows", "first_ref", "last_ref", "n_values", "mean", "sd", "lowest", *names.values(), "highest")


def integrity(raw: DataFrame, metas: Mapping[str, SeriesMeta]) -> DataFrame:
    """By series: rows with null periods or values, repeated (period, vintage), unconfigured series, and whether any is found."""
    keys = raw.groupBy("series", "ref_period", "vintage_date").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("v"))
    per = keys.groupBy("series").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("ref_period").isNull(), F.col("n")).otherwise(0)).alias("null_periods"),
        F.sum(F.col("n") - F.col("v")).alias("null_values"),
        F.sum(F.col("n") - 1).alias("repeats"),
    )
    known = F.col("series").isin(list(metas))
    ok = (F.col("null_periods") == 0) & (F.col("null_values") == 0) & (F.col("repeats") == 0) & known
    return per.select("*", F.coalesce(known, F.lit(False)).alias("configured"), F.coalesce(ok, F.lit(False)).alias("ok"))


def structure(raw: DataFrame, metas: Mapping[str, SeriesMeta]) -> DataFrame:
    """By configured series, whether its periods and vintages have the order that its frequency and revision type ask for.

    n_periods; missing_periods, first_missing, last_missing: periods of the frequency's calendar between the first and
    the last one that have no row; early_vintages: rows dated before their period has ended; unordered_periods: periods
    whose first vintage is older than that of the period before; unexpected_revisions: periods with several vintages
    in a series of single ones; ok: none of these. Weeks count from the series' first period on. Rows without a period
    are left out (``integrity`` counts them). Periods, a row each, are compared by series after vintages are reduced.
    """
    meta = meta_frame(raw.sparkSession, metas).select("series", F.col("freq").alias("__freq"), F.col("revision_type").alias("__revisions"))
    rows = raw.where("ref_period is not null").join(F.broadcast(meta), "series")  # a row for each configured series
    early = F.col("vintage_date") < period_end(F.col("ref_period"), F.col("__freq"))
    per = rows.groupBy("series", "ref_period", "__freq", "__revisions").agg(F.min("vintage_date").alias("first_vintage"), F.count_distinct("vintage_date").alias("vintages"), F.count_if(early).alias("early"))
    order = Window.partitionBy("series").orderBy("ref_period")
    months = (F.year("ref_period") * 12 + F.month("ref_period")).cast("int")
    days = F.datediff("ref_period", F.first("ref_period").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.when(F.col("__freq") == "Q", F.floor((months - 1) / 3)).when(F.col("__freq") == "M", months).when(F.col("__freq") == "W", F.floor(days / 7)).otherwise(days).cast("long")
    placed = per.withColumn("place", place)
    placed = placed.withColumns({"before": F.lag("place").over(order), "previous": F.lag("ref_period").over(order), "older": F.max("first_vintage").over(order.rowsBetween(-1, -1))})
    gap = F.greatest(F.coalesce(F.col("place") - F.col("before") - 1, F.lit(0)), F.lit(0))

    def moved(day: str, by: int):
        """The period before or after."""
        return F.when(F.col("__freq") == "Q", F.add_months(day, 3 * by)).when(F.col("__freq") == "M", F.add_months(day, by)).when(F.col("__freq") == "W", F.date_add(day, 7 * by)).otherwise(F.date_add(day, by))

    out = placed.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.sum(gap).alias("missing_periods"),
        F.min(F.when(gap > 0, moved("previous", 1))).alias("first_missing"),
        F.max(F.when(gap > 0, moved("ref_period", -1))).alias("last_missing"),
        F.sum("early").alias("early_vintages"),
        F.count_if(F.col("first_vintage") < F.col("older")).alias("unordered_periods"),
        F.count_if((F.col("vintages") > 1) & (F.col("__revisions") == "single")).alias("unexpected_revisions"),
    )
    return out.withColumn("ok", (F.col("missing_periods") == 0) & (F.col("early_vintages") == 0) & (F.col("unordered_periods") == 0) & (F.col("unexpected_revisions") == 0))
