"""Shared scratch tables, size-checked filters and fixed-size membership bitmaps.

Lineage is cut by writing a Parquet table into the folder that the cluster names in
``spark.checkpoint.dir``: it outlives any executor, and a lost task re-reads it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many rows of one key column are broadcast; beyond it, a shuffle join does the same.
BROADCAST_ROWS = 500_000
#: Bits of a membership bitmap: a constant 4 MB, however many keys go in.
BITMAP_BITS = 1 << 25

#: Whole texts that go to a Python worker together, and the setting that says so: its default of 10,000 rows takes tens of MB of texts, twice, in each task.
ROWS, ROWS_OF = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"

_own: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the session began without its path, and get texts in smaller batches where the session leaves the default."""
    if spark.conf.get(ROWS_OF) == "10000":
        spark.conf.set(ROWS_OF, str(ROWS))
    here, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (here, env.get("PYTHONPATH", "")) if x)


def root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set, as in tests."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        held = tempfile.TemporaryDirectory(prefix="graphloom-")
        _own["dir"] = "file://" + held.name
        atexit.register(held.cleanup)
    return _own["dir"]


def folder(spark: SparkSession, tag: str) -> str:
    ship(spark)
    return f"{root(spark)}/graphloom/{tag}-{uuid.uuid4().hex}"


def numbers(df: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a table of a constant size, by Arrow."""
    table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in df.columns}


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch that no result reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to scratch; give the table read back, and its path."""
    spark = df.sparkSession
    df.write.parquet(path := folder(spark, tag))
    return spark.read.schema(df.schema).parquet(path), path


def bitmap_slot(key: Column, bits: int = BITMAP_BITS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap(keys: DataFrame, col: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of hashed keys, put together by executors; its size doesn't depend on the data.

    It serves only to pass over rows before an exact join: a full bitmap passes everything.
    """
    slot = bitmap_slot(F.col(col), bits)
    parts = keys.where(F.col(col).isNotNull()).select(slot.alias("s")).groupBy(F.bitmap_bucket_number(F.col("s") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("s") + 1)).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for b, m in parts:
        out[(b - 1) * len(m) : b * len(m)] = np.frombuffer(bytes(m), np.uint8)
    return out


def has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 != 0


def without(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """``rows`` whose ``col`` isn't in ``keys``: broadcast after a check of the size, else shuffled."""
    few = keys.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys, col, "left_anti")
