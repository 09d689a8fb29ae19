"""Streams of arriving rows: counts in windows of event time, and degrees of a growing graph."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, tempfile.TemporaryDirectory] = {}


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the cluster's shared one; a temporary one only where none is set, as in tests."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not said:
        if "dir" not in _own:
            _own["dir"] = tempfile.TemporaryDirectory(prefix="graphloom-stream-")
            atexit.register(_own["dir"].cleanup)
        said = "file://" + _own["dir"].name
    return f"{said.rstrip('/')}/graphloom/{tag}-{uuid.uuid4().hex}"


def arriving(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream, in the order in which they came."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}*.parquet")


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events (ts, event_type, value) counted and summed in windows; rows later than ``late`` may be left out."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "total")


def degrees(edges: DataFrame) -> DataFrame:
    """In-degree of every target so far."""
    return edges.groupBy(F.col("tgt").alias("id")).agg(F.count("*").alias("degree"))


def drained(stream: DataFrame, tag: str) -> DataFrame:
    """Run an aggregation over all that has arrived, and give its last state as a table."""
    spark = stream.sparkSession
    out, state = folder(spark, tag), folder(spark, tag + "-state")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
