"""Session settings, module shipping and lineage cuts shared by all operators."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def get_session(app: str = "casetrail", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew handling; settings of the caller win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per context, so that executors on
    machines without the repository can import it."""
    context = spark.sparkContext
    if getattr(context, "_casetrail_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, str(path.relative_to(PACKAGE.parent)))
    folder = tempfile.mkdtemp(prefix="casetrail-")
    target = os.path.join(folder, "casetrail_modules.zip")
    Path(target).write_bytes(buffer.getvalue())
    context.addPyFile(target)
    context._casetrail_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Where it names none, a local master (one
    machine, as in tests) gets one of its own; on a cluster that is an error, as no machine sees another's."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="casetrail-ckpt-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the cluster's checkpoint folder and read them back, so that work
    above is done once and a lost executor does not bring it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many tasks as there are cores, where the scan gives fewer: a table of one row group would
    otherwise be one task. A scan of many splits stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
