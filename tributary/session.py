"""Session defaults and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: dict[str, str] = {}
_scratch: list[tuple[SparkSession, str]] = []


def get_session(app: str = "tributary", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC timestamps, adaptive execution and Arrow exchange switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once a context, so that they need no installation of it."""
    context = spark.sparkContext
    if _shipped.get("application") != context.applicationId:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="tributary-ship-")) / "tributary.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, Path(package.name) / source.relative_to(package))
        context.addPyFile(str(archive))
        _shipped["application"] = context.applicationId
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only where that setting is absent and the master is local (tests, a laptop) a temporary folder of the machine
    stands in; on a cluster its absence is an error, as executors could not read each other's tables.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found and not context.getCheckpointDir() and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = context.getCheckpointDir() or tempfile.mkdtemp(prefix="tributary-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str = "part") -> str:
    """A fresh folder below the shared one; removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tributary-{os.getpid()}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_sweep)
    _scratch.append((spark, path))
    return path


def _sweep() -> None:
    for spark, path in _scratch:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone; what is left is scratch
            return


def durable(df: DataFrame, name: str = "part") -> DataFrame:
    """Cut the lineage with a table written to the shared folder, so that a lost executor costs no recomputation.

    Parquet keeps it compressed and lets later steps read only the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session is tuned for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
