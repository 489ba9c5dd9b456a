"""Configuration: what is known about each series, and the parameters of training and evaluation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FREQUENCIES = ("Q", "M", "W", "D")
TRANSFORMS = ("", "level", "diff", "mom", "log_diff")
VINTAGE_MODES = ("reference", "first_release", "latest", "all_releases")
MISSING_POLICIES = ("skip", "carry_forward", "zero", "flag_only")


@dataclass(frozen=True)
class SeriesMeta:
    name: str
    vendor: str
    code: str
    freq: str
    release_rule: str
    release_lag_days: int
    transform: str = ""
    revision_type: str = "single"
    vintage_source: str = "final"
    vintage_mode: str = "latest"
    missing_policy: str = "skip"

    def problems(self) -> list[str]:
        """What is wrong with the record; empty if nothing is."""
        found = []
        if self.freq.upper() not in FREQUENCIES:
            found.append(f"freq {self.freq!r}")
        if self.transform not in TRANSFORMS:
            found.append(f"transform {self.transform!r}")
        if not isinstance(self.release_lag_days, int) or self.release_lag_days < 0:
            found.append(f"release_lag_days {self.release_lag_days!r}")
        if self.vintage_mode not in VINTAGE_MODES:
            found.append(f"vintage_mode {self.vintage_mode!r}")
        if self.missing_policy not in MISSING_POLICIES:
            found.append(f"missing_policy {self.missing_policy!r}")
        return found


def parse_series_meta(records: Mapping[str, Mapping]) -> dict[str, SeriesMeta]:
    """Records by series name, in their order. A missing required field raises KeyError."""
    out = {}
    for series, r in records.items():
        optional = {k: str(r[k]) for k in ("transform", "revision_type", "vintage_source", "vintage_mode", "missing_policy") if k in r}
        out[series] = SeriesMeta(name=r.get("name", series), vendor=r["vendor"], code=r["code"], freq=r["freq"], release_rule=r["release_rule"], release_lag_days=int(r["release_lag_days"]), **optional)
    return out


def load_series_meta(path: str | Path) -> dict[str, SeriesMeta]:
    """Series of a YAML file, in file order."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package; parse_series_meta takes plain dictionaries") from e
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no series configuration at {path}")
    return parse_series_meta(yaml.safe_load(path.read_text(encoding="utf-8")) or {})


META_SCHEMA = "series string, name string, code string, freq string, transform string, release_lag_days int, revision_type string, vintage_source string, vintage_mode string, missing_policy string"


def meta_frame(spark: SparkSession, metas: Mapping[str, SeriesMeta]) -> DataFrame:
    """One row for each configured series: as many rows as the configuration file has."""
    rows = [(k, m.name, m.code, m.freq.upper(), m.transform, m.release_lag_days, m.revision_type, m.vintage_source, m.vintage_mode, m.missing_policy) for k, m in metas.items()]
    return spark.createDataFrame(rows, META_SCHEMA)


@dataclass(frozen=True)
class RollingConfig:
    """Walk-forward training. A window covers [refit - window_years, refit)."""

    test_start: str = "1990-01-01"
    window_years: int = 15
    min_train_rows: int = 200
    z: float = 1.96
    model_name: str = "Bridge_simple_15y"
    #: Least complete rows of a stage for a model of its own, and the stages that may have one.
    min_stage_rows: int = 80
    stages: tuple[str, ...] = ("early", "mid", "late")


@dataclass(frozen=True)
class ARConfig:
    p: int = 1
    window_years: int = 15
    min_train_quarters: int = 40
    test_start: str = "2010-01-01"
    test_end: str | None = None
    model_name: str = "AR_p1_15y"
    #: False reports the forecast one quarter after the last released one, as published; True steps on to the target itself.
    true_horizon: bool = False
    #: Whether the regression has an intercept.
    constant: bool = True


#: (name, least days, most days or None); days outside every bucket, or null, are "unknown".
EVALUATION_BUCKETS = (("early", 60, None), ("mid", 30, 59), ("late", 10, 29), ("final", 0, 9))
#: The trainer's cut-offs: everything below 21 days is late.
TRAINER_BUCKETS = (("early", 61, None), ("mid", 21, 60), ("late", None, 20))


@dataclass(frozen=True)
class EvaluationConfig:
    buckets: tuple = EVALUATION_BUCKETS
    #: (name, first day, last day or None), both ends included.
    time_slices: tuple = field(default=(("2010_2014", "2010-01-01", "2014-12-31"), ("2015_2019", "2015-01-01", "2019-12-31"), ("2020_2022", "2020-01-01", "2022-12-31"), ("2023_plus", "2023-01-01", None)))
