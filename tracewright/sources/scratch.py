"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: with it, Spark removes a query's shuffle files once the query has ended
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent, a run on one machine (tests) uses its warehouse folder; on a cluster that's an error, as
    the warehouse may be a folder that other machines don't see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/tracewright/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into a scratch folder and read it back: lineage ends here, and lost executors lose nothing.

    The shuffles before the table aren't needed any more then, so their files go.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialise` that nothing reads any more: all that came from them is written itself."""
    for df in tables:
        if df is not None and (path := df.__dict__.get("scratch_path")):  # not by getattr, which columns answer too
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with a column ``name``, 0, 1, .. in the given order: sorted in parts, and each part's rows follow those before it."""
    parts = materialise(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "sorted")
    counts = parts.groupBy("_part").agg(F.count("*").alias("n"))  # as many rows as the sort has partitions
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    place = F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1)
    return parts.join(F.broadcast(before), "_part").select(*df.columns, place.alias(name))
