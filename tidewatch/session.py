"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Each application's work folder.
_WORK: dict[str, str] = {}


def get_session(app: str = "tidewatch", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that the plans rely on (UTC, AQE). Cluster settings win over these."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    The zip is served by the driver, so no folder needs to be shared.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # not when this module itself was imported from the zip
        path = os.path.join(tempfile.mkdtemp(prefix="tidewatch-"), "tidewatch_pkg.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """This application's folder, ``tidewatch-{application id}``, below that of ``spark.checkpoint.dir``; below a local one only where the session names none and all runs on one machine, as in tests.

    Work tables and checkpoints are written there and stay until ``clean`` removes them, as results may be read later on.
    """
    sc = spark.sparkContext
    app, named, current = sc.applicationId, spark.conf.get("spark.checkpoint.dir", None), sc.getCheckpointDir()
    if app not in _WORK:
        if not named and current is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _WORK[app] = f"{(named or current or tempfile.mkdtemp(prefix='tidewatch-ckpt-')).rstrip('/')}/tidewatch-{app}"
        if named or current is None:  # a folder that the caller has set stays Spark's
            sc.setCheckpointDir(_WORK[app])
    return _WORK[app]


def clean(spark: SparkSession) -> list[str]:
    """Remove this application's folder with its work tables and checkpoints; returns what was in it. Call it when no result is needed any more.

    Other folders, those of other running sessions among them, are left alone.
    """
    fs, own = spark._jvm.org.apache.hadoop.fs, checkpoint_dir(spark)
    folder = fs.Path(own)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    removed = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    files.delete(folder, True)
    if (spark.sparkContext.getCheckpointDir() or "").find(f"tidewatch-{spark.sparkContext.applicationId}") >= 0:
        spark.sparkContext.setCheckpointDir(own)  # a new one for what is still to come
    return removed


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
