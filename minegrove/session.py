"""Session construction and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that every plan of this package relies on. Sizes of partitions are left to the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g", app: str = "minegrove") -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the cluster's shared folder.

    The folder is read from ``spark.checkpoint.dir``. Only where that is unset and
    the master is local (tests) is a temporary folder of this machine used; a
    cluster without the setting is an error, because executors share no local disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="minegrove-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    context.setCheckpointDir(shared)


def clear_checkpoints(spark: SparkSession) -> None:
    """Delete all that this application has checkpointed, when its results are written and it is about to end.

    Spark itself does so only where ``spark.cleaner.referenceTracking.cleanCheckpoints`` was
    set before it started. Other applications have other folders below the shared one.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.delete(path, True)
    files.mkdirs(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder; a lost executor does not lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
