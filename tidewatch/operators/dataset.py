"""Regression rows: one for each origin date, with the target and all features, from one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import SeriesMeta
from tidewatch.functions.dates import quarter_release, quarter_start, sticky_target
from tidewatch.operators.features import features_daily

#: The array column of a packed dataset.
PACKED = "features"
LABEL_MODES, TARGET_MODES = ("visible", "model_target"), ("sticky", "calendar")


def feature_columns(ds: DataFrame) -> list[str]:
    return [c for c in ds.columns if c.startswith("x_")]


def bridge_dataset(panel: DataFrame | None, metas: Mapping[str, SeriesMeta], target: str, features: Sequence[str] | None = None, *, label_mode: str = "visible", target_mode: str = "sticky", targets: DataFrame | None = None, exclude: Sequence[str] = (), min_features: int = 0, before_release: bool = False, packed: bool = False, daily: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """target_ref_period, target_release_date, model_target_ref_period, model_target_release_date, y, origin_date, x_*.

    features: all series but the target if not given; ``exclude`` takes some out. label_mode: y is the
    target's value seen on the origin date, or the model target's own (from ``targets``: ref_period,
    y). target_mode: the previous quarter until it is released, or always the running one.
    min_features: least non-null features of a row. before_release: only rows with y before the model
    target's release. packed: the features are one array ``features``, in the order of the names, so that the plan
    has one expression for all of them. daily: rows as ``features_daily`` gives them, in place of a panel. by:
    columns of ``daily`` that tell datasets apart, as "as_of".
    """
    if target not in metas:
        raise KeyError(target)
    if label_mode not in LABEL_MODES or target_mode not in TARGET_MODES:
        raise ValueError(f"label_mode in {LABEL_MODES}, target_mode in {TARGET_MODES}")
    names = [k for k in (features if features is not None else metas) if k != target and k not in exclude]
    missing = [k for k in names if k not in metas]
    if missing:
        raise KeyError(f"features without configuration: {missing}")
    lag = metas[target].release_lag_days
    if daily is None:
        daily = features_daily(panel.where(F.col("series").isin([target, *names])), metas)
    else:
        daily = daily.where(F.col("series").isin([target, *names]))

    def of(series: str, column: str):
        return F.max(F.when(F.col("series") == series, F.col(column)))

    if packed:
        own = F.map_from_entries(F.collect_list(F.when(F.col("series") != target, F.struct("series", "feature"))))  # a series has a row a day
        found = [F.transform(F.lit(names) if names else F.array().cast("array<string>"), lambda k: F.try_element_at(F.col(PACKED), k)).alias(PACKED)]
        gathered, xs = [own.alias(PACKED)], [PACKED]
    else:
        gathered, xs = [of(k, "feature").alias(f"x_{k}") for k in names], [f"x_{k}" for k in names]
        found = xs
    wide = daily.groupBy(*by, F.col("as_of_date").alias("origin_date")).agg(of(target, "ref_period").alias("target_ref_period"), of(target, "value").alias("y"), *gathered)
    wide = wide.select(*by, "origin_date", "target_ref_period", "y", *found)
    origin = F.col("origin_date")
    model_target = sticky_target(origin, lag) if target_mode == "sticky" else quarter_start(origin)
    out = wide.withColumn("model_target_ref_period", model_target)
    out = out.withColumns({"target_release_date": quarter_release(F.col("target_ref_period"), lag), "model_target_release_date": quarter_release(F.col("model_target_ref_period"), lag)})
    if label_mode == "model_target":
        if targets is None:
            raise ValueError("label_mode model_target needs targets")
        own = targets.select(F.col("ref_period").alias("model_target_ref_period"), F.col("y").alias("__own"))
        out = out.join(own, "model_target_ref_period", "left").withColumn("y", F.col("__own")).drop("__own")
    if min_features:
        out = out.where((F.size(F.array_compact(PACKED)) if packed else non_null_features(xs)) >= min_features)
    if before_release:
        out = out.where("y is not null and origin_date < model_target_release_date")
    return out.select(*by, "target_ref_period", "target_release_date", "model_target_ref_period", "model_target_release_date", "y", "origin_date", *xs)


def non_null_features(xs: Sequence[str]):
    total = F.lit(0)
    for x in xs:
        total = total + F.col(x).isNotNull().cast("int")
    return total


def non_null_ratio(ds: DataFrame) -> DataFrame:
    """(feature, ratio): share of the rows in which each feature is known."""
    xs = feature_columns(ds)
    wide = ds.agg(*[F.avg(F.col(x).isNotNull().cast("double")).alias(x) for x in xs])
    return wide.unpivot([], xs, "feature", "ratio")
