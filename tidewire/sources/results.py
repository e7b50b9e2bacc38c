"""Result documents: writing one per run, reading many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.naming import chart_label, run_name
from tidewire.schemas import RESULT


def write_results(results: DataFrame, path: str, started: Column | None = None) -> None:
    """One JSON document per row, in a folder for each run.

    A run is known by workload, driver and, if ``started`` tells it, its time. Writing
    a run again replaces its folder and no other. The folder columns are copies, so each document
    still names its workload and driver and readers can prune by folder.
    """
    label = chart_label(F.col("workload"))
    run = F.concat_ws("-", label, "driver") if started is None else run_name(label, F.col("driver"), started)
    foldered = results.withColumns({"run_workload": label, "run_driver": F.col("driver"), "run": run})
    (
        foldered.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_workload", "run_driver", "run")
        .json(path)
    )


def read_results(
    spark: SparkSession, paths: str | list[str], *, one_per_file: bool = True
) -> DataFrame:
    """One row per run, with the file it came from.

    ``one_per_file`` reads indented documents, one in each file; without it each
    line is a document, as ``write_results`` leaves them.
    """
    documents = spark.read.schema(RESULT).option("multiLine", one_per_file).json(paths)
    return documents.withColumn("file", F.col("_metadata.file_path"))
