"""Accuracy of predictions by model and slice, and the comparison of models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import EvaluationConfig
from tidewatch.functions.labels import bucket, bucket_order, trainer_time_slice
from tidewatch.functions.metrics import METRICS, metrics
from tidewatch.sources.observations import number
from tidewatch.sources.results import read_csv_if_exists, read_predictions, write_csv

LONG_COLUMNS = ("model_name", "slice_type", "slice", *METRICS)


def metrics_by(preds: DataFrame, keys: Sequence[str], r2: bool = False) -> DataFrame:
    """n_obs, rmse, mae, bias, hit_rate for each value of the keys; null is a value."""
    return preds.groupBy(*keys).agg(*metrics(r2=r2))


def metrics_by_distance(preds: DataFrame, cfg: EvaluationConfig | None = None) -> DataFrame:
    """By model and bucket of distance_to_release, in the buckets' order."""
    spec = (cfg or EvaluationConfig()).buckets
    labelled = preds.withColumn("distance_bucket", bucket(F.col("distance_to_release"), spec))
    return metrics_by(labelled, ["model_name", "distance_bucket"]).orderBy("model_name", bucket_order(F.col("distance_bucket"), spec), "distance_bucket")


def metrics_by_time_slice(preds: DataFrame, cfg: EvaluationConfig | None = None) -> DataFrame:
    """By model and span of origin dates, both ends included. A row counts in every span that holds it, or in none."""
    found = []
    for name, first, last in (cfg or EvaluationConfig()).time_slices:
        inside = F.col("origin_date") >= F.lit(first).cast("date")
        if last is not None:
            inside = inside & (F.col("origin_date") <= F.lit(last).cast("date"))
        found.append(F.when(inside, name))
    labelled = preds.withColumn("time_slice", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return metrics_by(labelled, ["model_name", "time_slice"])


def slice_metrics(preds: DataFrame) -> DataFrame:
    """model_name, slice_type, slice and metrics: overall, by the trainer's time slices and by distance_bucket, in one pass."""
    labelled = preds.withColumn("time_slice", trainer_time_slice(F.col("origin_date")))
    keys = ["model_name", "time_slice", "distance_bucket"]
    sets = labelled.groupingSets([["model_name"], ["model_name", "time_slice"], ["model_name", "distance_bucket"]], *keys)
    out = sets.agg(F.grouping("time_slice").alias("no_time"), F.grouping("distance_bucket").alias("no_bucket"), *metrics())
    kind = F.when(F.col("no_time") == 0, "time_slice").when(F.col("no_bucket") == 0, "distance_bucket").otherwise("overall")
    name = F.when(F.col("no_time") == 0, F.col("time_slice")).when(F.col("no_bucket") == 0, F.col("distance_bucket")).otherwise("overall")
    return out.select("model_name", kind.alias("slice_type"), name.alias("slice"), *METRICS)


def evaluate_to_files(preds: DataFrame, out_dir: str, cfg: EvaluationConfig | None = None) -> dict[str, str]:
    """Overall, distance and time-slice metrics as CSV; returns their paths."""
    preds = preds.persist()  # three aggregations read it
    try:
        out = {"metrics_overall": metrics_by(preds, ["model_name"]), "metrics_by_distance": metrics_by_distance(preds, cfg), "metrics_by_time_slice": metrics_by_time_slice(preds, cfg)}
        for name, df in out.items():
            write_csv(df, f"{out_dir}/{name}.csv", one_file=True)
    finally:
        preds.unpersist()
    return {name: f"{out_dir}/{name}.csv" for name in out}


def evaluate_files(spark: SparkSession, predictions: str, out_dir: str, cfg: EvaluationConfig | None = None) -> dict[str, str]:
    return evaluate_to_files(read_predictions(spark, predictions), out_dir, cfg)


# -- comparison ---------------------------------------------------------------------------------------

COUNT_NAMES = ("n", "obs", "num_obs", "N")
SLICE_NAMES = ("time_slice", "distance_bucket", "bucket", "slice")


def standardise(df: DataFrame) -> DataFrame:
    """A metrics table with model_name and all metrics: counts under other names renamed, what is absent null."""
    for name in COUNT_NAMES:
        if name in df.columns and "n_obs" not in df.columns:
            df = df.withColumnRenamed(name, "n_obs")
    if "model_name" not in df.columns:
        df = df.withColumn("model_name", F.lit("UNKNOWN"))
    return df.withColumns({c: F.lit(None).cast("double") for c in METRICS if c not in df.columns})


def to_long(df: DataFrame, slice_type: str, slice_col: str | None = None, model_name: str | None = None) -> DataFrame:
    """The long form. Without slice_col the table is overall; one that is absent is inferred from usual names."""
    df = standardise(df.withColumn("model_name", F.lit(model_name)) if model_name is not None else df)
    if slice_col is None:
        slice_type, value = "overall", F.lit("overall")
    else:
        if slice_col not in df.columns:
            slice_col = next((c for c in SLICE_NAMES if c in df.columns), None)
            if slice_col is None:
                raise ValueError(f"no slice column for {slice_type}; there are {df.columns}")
        value = F.col(slice_col).cast("string")
    typed = [F.col(c).cast("string").try_cast("double").cast("long").alias(c) if c == "n_obs" else number(F.col(c).cast("string")).alias(c) for c in METRICS]
    return df.select(F.col("model_name").cast("string").alias("model_name"), F.lit(slice_type).alias("slice_type"), value.alias("slice"), *typed)


def compare(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of long tables, ordered by slice_type, slice, model_name."""
    if not tables:
        raise RuntimeError("nothing to compare")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.orderBy("slice_type", "slice", "model_name")


#: file stem -> (slice_type, slice column, model name): what a folder of evaluations may hold.
AR_FILES = {"metrics_by_distance": ("distance_bucket", "distance_bucket"), "metrics_by_time_slice": ("time_slice", "time_slice"), "metrics_overall": ("overall", None)}
BRIDGE_MODELS: Mapping[str, str] = {"simple": "Bridge_simple_15y", "stage": "Bridge_stage_aware_15y"}


def compare_files(spark: SparkSession, eval_dir: str, save: bool = True) -> DataFrame:
    """Compares all evaluations found below a folder: the baseline's (outputs/ar, or the folder itself) and both bridge models'."""
    found = []
    for stem, (kind, column) in AR_FILES.items():
        df = read_csv_if_exists(spark, f"{eval_dir}/outputs/ar/{stem}.csv", f"{eval_dir}/{stem}.csv")
        if df is not None:
            found.append(to_long(df, kind, column, "AR_p1_15y"))
    for short, model in BRIDGE_MODELS.items():
        for stem, kind, column in ((f"bridge_distance_bucket_{short}", "distance_bucket", "distance_bucket"), (f"bridge_time_slice_{short}", "time_slice", "time_slice"), (f"bridge_overall_{short}", "overall", None)):
            df = read_csv_if_exists(spark, f"{eval_dir}/{stem}.csv")
            if df is not None:
                found.append(to_long(df, kind, column, model))
    if not found:
        raise RuntimeError(f"no evaluation files below {eval_dir}")
    out = compare(found)
    if save:
        write_csv(out, f"{eval_dir}/model_compare.csv", one_file=True)
    return out
