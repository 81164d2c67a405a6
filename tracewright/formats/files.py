"""Model files in any store that Spark knows."""

from __future__ import annotations

from pyspark.sql import SparkSession


def write_model(spark: SparkSession, text: str, path: str) -> None:
    """The text of a model as one file below ``path``."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\0").text(path)


def read_model(spark: SparkSession, path: str) -> str:
    """The text of the one file at or below ``path``."""
    rows = spark.read.text(path, wholetext=True).take(2)
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} files at {path}, one is needed")
    return rows[0][0].removesuffix("\0")
