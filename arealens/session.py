"""Session helpers: tables staged in shared storage, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

FOLDER_CONF = "spark.checkpoint.dir"

_staged: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder named by the cluster in ``spark.checkpoint.dir``, which all executors share."""
    folder = spark.conf.get(FOLDER_CONF, None)
    if not folder:
        raise RuntimeError(f"set {FOLDER_CONF} to a folder that the driver and all executors share")
    return folder


def ensure_shared_folder(spark: SparkSession) -> SparkSession:
    """For entry points: a local session that names no folder gets one of its own; on a cluster it is required."""
    if not spark.conf.get(FOLDER_CONF, None):
        if not spark.sparkContext.master.startswith("local["):
            shared_folder(spark)
        spark.conf.set(FOLDER_CONF, tempfile.mkdtemp(prefix="arealens-"))
    return spark


def ship_package(spark: SparkSession) -> SparkSession:
    """For entry points: sends this package to the Python workers once per session, whatever folder they start in."""
    context = spark.sparkContext
    if getattr(context, "_arealens_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="arealens-zip-"), "arealens.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._arealens_shipped = True
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder, never reused; deleted by ``release`` or when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_release_all)
    _staged.append((spark, path))
    return path


def release(spark: SparkSession) -> None:
    """Deletes what this driver has staged; call it once the results that read it are consumed."""
    for owner, path in [x for x in _staged if x[0] is spark]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _staged.remove((owner, path))


def _release_all() -> None:
    for spark in {id(s): s for s, _ in _staged}.values():
        if spark.sparkContext._jsc is not None:
            release(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
