"""Results that are computed once: kept in the folder that the cluster shares, so that a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that lets its cleaner delete a checkpoint's files once nothing refers to it; it is read when a result is first kept.
CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``checkpoint()`` writes to: the session's own, or on a local master a temporary one where none is set.

    Checkpoints are deleted when the driver has dropped what read them, unless the
    application's own settings say otherwise.
    """
    sc = spark.sparkContext
    conf = sc._jsc.sc().conf()
    if not conf.contains(CLEAN):
        conf.set(CLEAN, "true")
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="quirelake-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder, for a table that the caller writes and :func:`discard` deletes."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> bool:
    """Deletes a table; False if it wasn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
