"""Labels of evaluation slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.config import EVALUATION_BUCKETS, TRAINER_BUCKETS


def bucket(days: Column, spec: tuple = EVALUATION_BUCKETS) -> Column:
    """The first bucket (name, least, most) that holds the number of days; "unknown" if none does or it is null."""
    out = F.lit("unknown")
    for name, least, most in reversed(spec):
        inside = days.isNotNull()
        if least is not None:
            inside = inside & (days >= least)
        if most is not None:
            inside = inside & (days <= most)
        out = F.when(inside, name).otherwise(out)
    return out


def trainer_bucket(release: Column, origin: Column) -> Column:
    return bucket(F.datediff(release, origin), TRAINER_BUCKETS)


def trainer_time_slice(d: Column) -> Column:
    """Three spans of years; every other year, earlier ones too, belongs to the last label."""
    y = F.year(d)
    return F.when(y.between(2010, 2014), "2010_2014").when(y.between(2015, 2019), "2015_2019").when(y.between(2020, 2022), "2020_2022").otherwise("2023_plus")


def bucket_order(name: Column, spec: tuple = EVALUATION_BUCKETS) -> Column:
    out = F.lit(999)
    for k, (label, _, _) in enumerate(spec):
        out = F.when(name == label, k).otherwise(out)
    return out
