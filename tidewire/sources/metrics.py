"""Metric samples from tables and from text exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.schemas import METRIC_SAMPLES

_LINE = r"^([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$"
_LABEL = r'(\w+)="((?:[^"\\]|\\.)*)"'


def read_metric_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SAMPLES).parquet(path)


def parse_exposition(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, labels, ts_ms, value) of ``name{label="value",...} number time`` lines.

    Comments and lines of another form give no row.
    """
    text = F.col(line)
    keys = F.regexp_extract_all(F.regexp_extract(text, _LINE, 2), F.lit(_LABEL), F.lit(1))
    values = F.regexp_extract_all(F.regexp_extract(text, _LINE, 2), F.lit(_LABEL), F.lit(2))
    number = F.regexp_replace(F.regexp_extract(text, _LINE, 3), r"^\+", "")
    return lines.where(text.rlike(_LINE) & ~text.startswith("#")).select(
        F.regexp_extract(text, _LINE, 1).alias("name"),
        F.map_from_arrays(keys, values).alias("labels"),
        F.nullif(F.regexp_extract(text, _LINE, 4), F.lit("")).try_cast("bigint").alias("ts_ms"),
        number.try_cast("double").alias("value"),
    )


def read_exposition(spark: SparkSession, path: str) -> DataFrame:
    return parse_exposition(spark.read.text(path), "value")
