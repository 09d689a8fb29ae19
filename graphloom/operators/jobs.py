"""Jobs that are each done once: a list of them against what has been committed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as X

RESULT = "job string, result string, error string, check long"


def _seal(job: str, result: str):
    return F.xxhash64(job, result)


def _waves(spark: SparkSession, folder: str) -> list[str]:
    return [f"{folder}/{n}" for n in X.children(spark, folder) if n.startswith("wave-") and "-attempt-" not in n and X.whole(spark, f"{folder}/{n}")]


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(job, result) of the jobs that are done: of whole waves, with a result that is what was written; of repeats the least."""
    waves = _waves(spark, folder)
    if not waves:
        return spark.createDataFrame([], "job string, result string")
    rows = spark.read.schema(RESULT).option("ignoreCorruptFiles", True).parquet(*waves)
    return rows.where((F.col("check") == _seal("job", "result")) & F.col("error").isNull()).groupBy("job").agg(F.min("result").alias("result"))


def failed(spark: SparkSession, folder: str) -> DataFrame:
    """(job, error) of jobs that have raised in a committed wave and have no result."""
    waves = _waves(spark, folder)
    if not waves:
        return spark.createDataFrame([], "job string, error string")
    rows = spark.read.schema(RESULT).option("ignoreCorruptFiles", True).parquet(*waves).where("error is not null")
    return rows.groupBy("job").agg(F.max("error").alias("error")).join(committed(spark, folder), "job", "left_anti")


def run_jobs(jobs: DataFrame, work: Callable[[dict], dict], folder: str, wave: int = 10_000) -> DataFrame:
    """Do the jobs (job, config as JSON) that have no committed result, and give (job, result as JSON) of all that have.

    A wave of jobs is one Spark job, a task for each; its results are written aside and committed by one rename.
    A job that raises leaves its error there and is tried again by the next call, as are those of a wave that died,
    of damaged files, or whose result isn't what was sealed. Jobs of one name are one job.
    """
    spark = jobs.sparkSession
    held = X.Scratch(spark)
    waiting = held.keep(jobs.groupBy("job").agg(F.min("config").alias("config")).join(committed(spark, folder), "job", "left_anti"), "jobs")
    number = waiting.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for job, config in zip(b.column("job").to_pylist(), b.column("config").to_pylist(), strict=True):
                result = error = None
                try:
                    result = json.dumps(work(json.loads(config)), sort_keys=True)
                except Exception as e:  # noqa: BLE001  another job's result must not be lost with this one
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (job, result, error)], ["job", "result", "error"])

    waves = -(-number // wave)
    for k in range(waves):
        part = waiting.where(F.pmod(F.xxhash64("job"), F.lit(waves)) == k) if waves > 1 else waiting
        done = part.repartition(max(1, min(number, wave)), "job").mapInArrow(run, "job string, result string, error string")
        X.commit(done.withColumn("check", _seal("job", "result")), f"{folder}/wave-{uuid.uuid4().hex}")
    held.clear()
    return committed(spark, folder)
