"""Session settings the engine relies on, and the shared folder for its files."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on; sizing stays with the cluster."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tidewire-")


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Have the file system remove a folder that exists when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Without that setting only a local session may go on, in a temporary folder:
    on a cluster a machine's own disk is not seen by the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_folder()
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")
