"""Walk-forward regression: at each refit date a model is fitted on the years before it and predicts up to the next.

No loop over refits, and no row is copied for the refits that see it: rows become mergeable least-squares states by
month and stage (``factors``), each window is a merge of months, and one pass gives every refit's model, its residual
spreads by stage, its z-score parameters and the stages' own models (``fits``). Refits are the month starts from
test_start on, and test_start itself. Windows are half-open, [refit - years, refit).

Several models at once: ``keys`` (for instance an entity) fit a model for each value. Features are columns, or one
array column (``xs`` is its name), with which plans do not grow with their number.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import RollingConfig
from tidewatch.functions.labels import trainer_bucket
from tidewatch.operators import factors
from tidewatch.operators.dataset import PACKED, feature_columns
from tidewatch.operators.linalg import moment_names, moments

MONTH = "interval 1 month"


def _mid_month(cfg: RollingConfig) -> bool:
    return date.fromisoformat(cfg.test_start).day != 1


def refit_schedule(ds: DataFrame, cfg: RollingConfig) -> DataFrame:
    """(refit_date, next_refit): the last next_refit is the day after the newest origin. One row a month."""
    start = F.lit(cfg.test_start).cast("date")
    first = F.add_months(F.trunc(start, "MONTH"), 1) if _mid_month(cfg) else start
    end = F.col("end")
    months = F.when(first <= end, F.sequence(first, end, F.expr(MONTH))).otherwise(F.array().cast("array<date>"))
    dates = ds.agg(F.max("origin_date").alias("end")).where(end >= start).select("end", F.explode(F.array_union(F.array(start), months)).alias("refit_date"))
    following = F.lead("refit_date").over(Window.orderBy("refit_date"))
    return dates.select("refit_date", F.coalesce(following, F.date_add("end", 1)).alias("next_refit"))


def refit_of(origin: Column, cfg: RollingConfig) -> Column:
    """The refit whose model predicts an origin date (on or after test_start)."""
    return F.greatest(F.trunc(origin, "MONTH"), F.lit(cfg.test_start).cast("date"))


def refit_dates(ds: DataFrame, cfg: RollingConfig) -> list[date]:
    """The dates of ``refit_schedule`` on the driver, which reads one value of ``ds`` for them: its newest origin date."""
    end, first = ds.agg(F.max("origin_date")).first()[0], date.fromisoformat(cfg.test_start)
    if end is None or end < first:
        return []
    months = range(factors.month_of(first) + (first.day != 1), factors.month_of(end) + 1)
    return [*([first] if first.day != 1 else []), *[date(1900 + m // 12, m % 12 + 1, 1) for m in months]]


def window_moments(ds: DataFrame, xs: Sequence[str], cfg: RollingConfig, keys: Sequence[str] = ()) -> DataFrame:
    """refit_date, keys, n_rows (with a y) and the moments of complete rows of each training window."""
    out = window_sums(ds, ["n_rows", *moment_names(len(xs))], [F.count("y").alias("n_rows"), *moments(xs, "y")], cfg, keys)
    return out.withColumns({"n_rows": F.coalesce("n_rows", F.lit(0)), "n": F.coalesce("n", F.lit(0))})


def window_sums(ds: DataFrame, names: Sequence[str], sums: Sequence[Column], cfg: RollingConfig, keys: Sequence[str] = ()) -> DataFrame:
    """refit_date, keys and sums over each training window: rows are added up by month once, and a window runs over the months."""
    month = F.months_between(F.trunc("origin_date", "MONTH"), F.lit("1900-01-01").cast("date")).cast("int")
    monthly = ds.groupBy(*keys, month.alias("month")).agg(*sums)
    start = F.lit(cfg.test_start).cast("date")
    refits = refit_schedule(ds, cfg).where(F.trunc("refit_date", "MONTH") == F.col("refit_date"))
    refits = refits.select("refit_date", F.months_between("refit_date", F.lit("1900-01-01").cast("date")).cast("int").alias("month"))
    if keys:
        refits = refits.crossJoin(ds.select(*keys).distinct())  # a row for each fit: months x models
    both = monthly.withColumn("refit_date", F.lit(None).cast("date")).unionByName(refits, allowMissingColumns=True)
    window = Window.partitionBy(*keys).orderBy("month").rangeBetween(-12 * cfg.window_years, -1)
    out = both.select("refit_date", *keys, *[F.sum(c).over(window).alias(c) for c in names]).where("refit_date is not null")
    if _mid_month(cfg):
        rows = ds.where((F.col("origin_date") >= F.add_months(start, -12 * cfg.window_years)) & (F.col("origin_date") < start))
        out = out.unionByName(rows.groupBy(*keys).agg(*sums).withColumn("refit_date", start))
    return out


def _stage(ds: DataFrame) -> Column:
    return trainer_bucket(F.col("model_target_release_date"), F.col("origin_date")) if "model_target_release_date" in ds.columns else F.lit("unknown")


def monthly_states(ds: DataFrame, xs: Sequence[str] | str, cfg: RollingConfig, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, month, stage, state) of the rows with a y. A window from inside a month has its rows once more, as a month of its own."""
    month = factors.month_number(F.col("origin_date"))
    own = [month]
    if _mid_month(cfg):
        start = F.lit(cfg.test_start).cast("date")
        inside = (F.col("origin_date") >= F.add_months(start, -12 * cfg.window_years)) & (F.col("origin_date") < start)
        own.append(F.when(inside, F.lit(factors.MID)))
    rows = ds.where("y is not null").select(*keys, F.explode(F.array_compact(F.array(*own))).alias("month"), _stage(ds).alias("stage"), F.col("y").cast("double").alias("y"), factors.vector(xs).alias("x"))
    return factors.states(rows, [*keys, "month", "stage"])


def fits(ds: DataFrame, xs: Sequence[str] | str, cfg: RollingConfig, keys: Sequence[str] = ()) -> DataFrame:
    """keys and ``factors.FIT``: everything that is known of each training window, in one pass.

    coef: intercept and coefficients on the features as they are, by least squares; of least norm among standardised
    features where they are collinear; null without complete rows or if a feature does not vary.
    """
    return factors.window_fits(monthly_states(ds, xs, cfg, keys), keys, refit_dates(ds, cfg), 12 * cfg.window_years)


def _count(ds: DataFrame, xs: Sequence[str] | str) -> int:
    """The number of features; of an array column, that of one row."""
    if not isinstance(xs, str):
        return len(xs)
    row = ds.where(F.col(xs).isNotNull()).select(F.size(xs)).first()
    return 0 if row is None else row[0]


def coefficients(ds: DataFrame, xs: Sequence[str], cfg: RollingConfig, keys: Sequence[str] = ()) -> DataFrame:
    """refit_date, keys, n_rows, n, b_0..b_k. Windows with fewer rows with a y than min_train_rows are left out, unless there are keys."""
    found = fits(ds, xs, cfg, keys)
    if not keys:
        found = found.where(F.col("n_rows") >= cfg.min_train_rows)
    return found.select("refit_date", *keys, "n_rows", "n", *[F.get("coef", i).alias(f"b_{i}") for i in range(_count(ds, xs) + 1)])


def eligibility(ds: DataFrame, xs: Sequence[str], cfg: RollingConfig) -> DataFrame:
    """(refit_date, next_refit, n_rows, n_complete, reason): why a refit gives no predictions, or "ok"."""
    met = refit_schedule(ds, cfg).join(fits(ds, xs, cfg), "refit_date", "left").withColumns({"n_rows": F.coalesce("n_rows", F.lit(0).cast("long")), "n": F.coalesce("n", F.lit(0).cast("long"))})
    reason = F.when(F.col("n_rows") < cfg.min_train_rows, "too few rows").when(F.col("n") == 0, "no complete rows").when(F.col("coef").isNull(), "a feature does not vary").otherwise("ok")
    return met.select("refit_date", "next_refit", "n_rows", F.col("n").alias("n_complete"), reason.alias("reason"))


def zscore_params(ds: DataFrame, xs: Sequence[str], cfg: RollingConfig) -> DataFrame:
    """refit_date, n_rows, mu_{x}, sd_{x}: mean and population deviation of known values in rows with a y; sd null if it is zero."""
    found = fits(ds, xs, cfg).where(F.col("n_rows") >= cfg.min_train_rows)
    return found.select("refit_date", "n_rows", *[F.get(c, i).alias(f"{c}_{x}") for i, x in enumerate(xs) for c in ("mu", "sd")])


def zscore_apply(ds: DataFrame, params: DataFrame, xs: Sequence[str], cfg: RollingConfig) -> DataFrame:
    """Rows from test_start on with z_{x}, by their refit's parameters."""
    met = out_of_sample(ds, cfg).join(F.broadcast(params), "refit_date")  # one row a refit
    return met.select("origin_date", "refit_date", *[((F.col(x) - F.col(f"mu_{x}")) / F.col(f"sd_{x}")).alias(f"z_{x}") for x in xs])


def out_of_sample(ds: DataFrame, cfg: RollingConfig) -> DataFrame:
    return ds.where(F.col("origin_date") >= F.lit(cfg.test_start).cast("date")).withColumn("refit_date", refit_of(F.col("origin_date"), cfg))


def stage_sigmas(ds: DataFrame, xs: Sequence[str] | str, cfg: RollingConfig) -> DataFrame:
    """(refit_date, distance_bucket, overall, sigma): spread of in-sample residuals, by bucket and (null bucket) over all."""
    found = fits(ds, xs, cfg).where((F.col("n_rows") >= cfg.min_train_rows) & F.col("coef").isNotNull())
    out = found.select("refit_date", F.lit(None).cast("string").alias("distance_bucket"), F.lit(1).cast("tinyint").alias("overall"), "sigma")
    if "model_target_release_date" in ds.columns:
        own = found.select("refit_date", F.explode("stages").alias("x")).where("x.sigma > 0")
        out = out.unionByName(own.select("refit_date", F.col("x.stage").alias("distance_bucket"), F.lit(0).cast("tinyint").alias("overall"), "x.sigma"))
    return out


def predict(ds: DataFrame, found: DataFrame, xs: Sequence[str] | str, cfg: RollingConfig) -> DataFrame:
    """Out-of-sample rows of refits that have a model (``fits``), with y_hat, model_name, distance_bucket, nowcast_sigma (the bucket's, else the refit's) and the interval y_hat -+ z sigma."""
    usable = found.where((F.col("n_rows") >= cfg.min_train_rows) & F.col("coef").isNotNull())
    by = F.map_from_entries(F.transform(F.filter("stages", lambda s: s["sigma"] > 0), lambda s: F.struct(s["stage"], s["sigma"])))
    sigma = F.col("sigma") if "model_target_release_date" not in ds.columns else F.coalesce(F.element_at(by, _stage(ds)), F.col("sigma"))
    usable = usable.select("refit_date", F.col("coef").alias("__coef"), F.col("stages").alias("__stages"), F.col("sigma").alias("__sigma"))
    met = out_of_sample(ds, cfg).join(F.broadcast(usable), "refit_date")  # one row a refit
    met = met.select(*ds.columns, "refit_date", factors.predicted(F.col("__coef"), factors.vector(xs)).alias("y_hat"), F.lit(cfg.model_name).alias("model_name"), _stage(ds).alias("distance_bucket"), F.col("__stages").alias("stages"), F.col("__sigma").alias("sigma"))
    met = met.withColumn("nowcast_sigma", sigma).drop("stages", "sigma")
    return met.withColumns({"ci_low_95": F.col("y_hat") - cfg.z * F.col("nowcast_sigma"), "ci_high_95": F.col("y_hat") + cfg.z * F.col("nowcast_sigma")})


def run_rolling(ds: DataFrame, cfg: RollingConfig | None = None, xs: Sequence[str] | str | None = None) -> DataFrame:
    """The dataset's out-of-sample rows with y_hat, model_name, distance_bucket, nowcast_sigma, ci_low_95, ci_high_95."""
    cfg, xs = cfg or RollingConfig(), features_of(ds) if xs is None else xs
    if not xs:
        raise ValueError("the dataset has no x_ columns")
    return predict(ds, fits(ds, xs, cfg), xs, cfg).drop("refit_date")


def features_of(ds: DataFrame) -> list[str] | str:
    """The array column of a packed dataset, else the x_ columns."""
    return PACKED if PACKED in ds.columns else feature_columns(ds)


# -- stage-aware ------------------------------------------------------------------------------------


def _stage_models(found: DataFrame, cfg: RollingConfig) -> DataFrame:
    """(refit_date, stage, n, coef): the model over all rows (stage null), and one for each stage with enough complete rows."""
    found = found.where(F.col("n_rows") >= cfg.min_train_rows)
    own = found.select("refit_date", F.explode("stages").alias("x")).select("refit_date", "x.stage", "x.n", "x.coef")
    own = own.where((F.col("n") >= cfg.min_stage_rows) & F.col("stage").isin(list(cfg.stages)) & F.col("coef").isNotNull())
    return found.select("refit_date", F.lit(None).cast("string").alias("stage"), "n", "coef").unionByName(own)


def stage_coefficients(ds: DataFrame, xs: Sequence[str] | str, cfg: RollingConfig) -> DataFrame:
    """refit_date, stage, n, b_0..b_k: the model over all rows (stage null), and one for each stage with enough complete rows."""
    return _stage_models(fits(ds, xs, cfg), cfg).select("refit_date", "stage", "n", *[F.get("coef", i).alias(f"b_{i}") for i in range(_count(ds, xs) + 1)])


def stage_predict(ds: DataFrame, xs: Sequence[str] | str, cfg: RollingConfig, model_name: str = "Bridge_stage_aware_15y") -> DataFrame:
    """Out-of-sample rows predicted by their stage's model where there is one, else by the overall one."""
    found = fits(ds, xs, cfg).where((F.col("n_rows") >= cfg.min_train_rows) & F.col("coef").isNotNull())
    own = F.filter("stages", lambda s: (s["n"] >= cfg.min_stage_rows) & s["stage"].isin(list(cfg.stages)) & s["coef"].isNotNull())
    models = found.select("refit_date", F.col("coef").alias("__all"), F.map_from_entries(F.transform(own, lambda s: F.struct(s["stage"], s["coef"]))).alias("__by"))
    rows = out_of_sample(ds, cfg).withColumn("distance_bucket", _stage(ds))
    met = rows.join(F.broadcast(models), "refit_date").withColumn("__own", F.element_at("__by", F.col("distance_bucket")))  # one row a refit
    y_hat = factors.predicted(F.coalesce("__own", "__all"), factors.vector(xs))
    return met.select(*ds.columns, "refit_date", y_hat.alias("y_hat"), F.lit(model_name).alias("model_name"), "distance_bucket", F.col("__own").isNotNull().alias("stage_model"))


def clean_nowcast(preds: DataFrame) -> DataFrame:
    """The published columns, those that are there: origin_date, nowcast_gdp_growth, target and interval."""
    optional = [c for c in ("model_target_ref_period", "nowcast_sigma", "ci_low_95", "ci_high_95") if c in preds.columns]
    return preds.select("origin_date", F.col("y_hat").alias("nowcast_gdp_growth"), *optional)


# -- single models ----------------------------------------------------------------------------------


def _rows(df: DataFrame, xs: Sequence[str], y: str, *keys: str) -> DataFrame:
    return df.where(F.col(y).isNotNull()).select(*keys, F.col(y).cast("double").alias("y"), factors.vector(xs).alias("x"))


class LinearModel:
    """One fit on all rows of a DataFrame, which Spark merges to one state; the fitted state is k + 1 numbers.

    Where features are collinear or do not vary, it is the solution of least norm.
    """

    def __init__(self):
        self.features: list[str] | None = None
        self.coefficients: list[float] | None = None

    def fit(self, df: DataFrame, xs: Sequence[str], y: str = "y") -> LinearModel:
        row = factors.states(_rows(df, xs, y), []).first()
        return self._take(None if row is None else row["state"], xs)

    def _take(self, state: bytes | None, xs: Sequence[str]) -> LinearModel:
        b = None if state is None else factors.State.unpack(state).solve(standardised=False)
        if b is None:
            raise ValueError("no complete rows")
        self.features, self.coefficients = list(xs), b.tolist()
        return self

    def predict(self, df: DataFrame, out: str = "y_hat") -> DataFrame:
        if self.coefficients is None:
            raise RuntimeError("the model is not fitted")
        y_hat = F.lit(self.coefficients[0])
        for b, x in zip(self.coefficients[1:], self.features, strict=True):
            y_hat = y_hat + b * F.col(x)
        return df.withColumn(out, y_hat)


class StageModel:
    """A model over all rows and one for each stage with enough complete rows."""

    def __init__(self, min_stage_rows: int = 80, stages: Sequence[str] = ("early", "mid", "late")):
        self.min_stage_rows, self.stages = min_stage_rows, tuple(stages)
        self.overall, self.by_stage = LinearModel(), {}

    def fit(self, df: DataFrame, xs: Sequence[str], y: str = "y", stage: str = "distance_bucket") -> StageModel:
        self.overall.fit(df, xs, y)
        rows = factors.states(_rows(df.where(F.col(stage).isin(list(self.stages))), xs, y, stage), [stage]).collect()  # one row a stage
        self.by_stage = {r[stage]: LinearModel()._take(r["state"], xs) for r in rows if factors.State.unpack(r["state"]).n >= max(1, self.min_stage_rows)}
        return self

    def predict(self, df: DataFrame, stage: str = "distance_bucket", out: str = "y_hat") -> DataFrame:
        df = self.overall.predict(df, out)
        for name, m in self.by_stage.items():
            df = m.predict(df, "__own").withColumn(out, F.when(F.col(stage) == name, F.col("__own")).otherwise(F.col(out))).drop("__own")
        return df
