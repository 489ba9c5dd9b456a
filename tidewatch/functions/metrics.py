"""Forecast accuracy as aggregate expressions. Pairs with a null side do not count; no pairs give nulls and n_obs 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("n_obs", "rmse", "mae", "bias", "hit_rate")


def metrics(y: str = "y", y_hat: str = "y_hat", r2: bool = False) -> list[Column]:
    a, b = F.col(y), F.col(y_hat)
    e = b - a
    hit = F.when(e.isNotNull(), F.when(F.signum(a) == F.signum(b), 1.0).otherwise(0.0).cast("double"))
    out = [F.count(e).alias("n_obs"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.avg(hit).alias("hit_rate")]
    if r2:
        both = F.when(e.isNotNull(), a)
        out.append((1 - F.sum(e * e) / F.nullif(F.var_pop(both) * F.count(e), F.lit(0.0))).alias("r2"))
    return out
