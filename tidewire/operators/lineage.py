"""Storing an intermediate table that several later steps read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewire.session import remove_at_exit, shared_folder


def stored(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    For small results of large scans (period rows, histograms) that are read more
    than once: the messages behind them are then scanned once, and a lost executor
    costs a re-read of the stored rows, not a re-run of the scan. The folder is removed
    when the driver ends, as what is returned reads it until then.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    remove_at_exit(df.sparkSession, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
