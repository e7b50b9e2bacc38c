"""Tables of the shared folder: small ones that later steps join with all rows, and passing ones."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.lineage import stored
from tidewire.session import remove_at_exit, shared_folder

#: Rows up to which a stored table is broadcast; beyond, Spark shuffles both sides.
MOST_ROWS = 500_000


def checked_broadcast(df: DataFrame, purpose: str, most: int = MOST_ROWS) -> DataFrame:
    """``df`` (rows of a few numbers) written to the shared folder, to be broadcast if it is small."""
    table = stored(df, purpose)
    return F.broadcast(table) if table.count() <= most else table


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes an execution's shuffle files when it has ended; the setting is then as before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Passing:
    """A stored table that can be removed as soon as what was made of it is stored."""

    def __init__(self, df: DataFrame, purpose: str) -> None:
        self.spark = df.sparkSession
        self.folder = shared_folder(self.spark, purpose)
        with shuffles_freed(self.spark):
            df.write.parquet(self.folder)
        remove_at_exit(self.spark, self.folder)
        self.rows = self.spark.read.schema(df.schema).parquet(self.folder)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
