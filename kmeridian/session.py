"""Session helpers shared by every operator: code shipping, cluster scratch space and saved tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Bytes of rows handed to a Python worker at once: Spark's own default is held on both sides of the pipe by every task.
BATCH_BYTES, SPARK_BATCH_BYTES = "4m", "67108864b"
#: By application: the scratch folder for a single machine, and the folder of its saved tables.
_local: dict[str, str] = {}
_saved: dict[str, str] = {}
_shipped: set[str] = set()


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the driver was started, and keeps their batches small. On a cluster
    executors get it as an archive, through Spark; they need no path of the driver's."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, SPARK_BATCH_BYTES) == SPARK_BATCH_BYTES:
        spark.conf.set(limit, BATCH_BYTES)
    context = spark.sparkContext
    if on_one_machine(spark):
        env, root = context.environment, str(PACKAGE.parent)
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    elif context.applicationId not in _shipped:
        archive = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}.zip"  # read by the driver alone, which serves it
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(PACKAGE.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def scratch(spark: SparkSession) -> str:
    """The shared folder for saved tables: spark.checkpoint.dir. Where that is unset, a folder of this machine, if Spark
    runs on it alone; on a cluster executors and driver would each see their own, so there it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not on_one_machine(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _local.setdefault(spark.sparkContext.applicationId, "")
        if not named:
            named = _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="kmeridian-")
    return named.rstrip("/")


def saved_folder(spark: SparkSession) -> str:
    """A folder of this application's own for its saved tables, which sweep deletes."""
    app = spark.sparkContext.applicationId
    if app not in _saved:
        _saved[app] = f"{scratch(spark)}/kmeridian-{uuid.uuid4().hex}"
        atexit.register(sweep, spark)
    return _saved[app]


def saved(df: DataFrame) -> DataFrame:
    """Writes df as a compressed table in the shared folder and reads it back: lineage ends there,
    a lost executor costs nothing, and each reader takes only the columns it needs."""
    path = f"{saved_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that this application saved, to be called when results that read them are written. It is called
    at the driver's end as well."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    path = _saved.pop(context.applicationId, None)
    if path is not None:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
