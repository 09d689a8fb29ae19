"""Tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. One of this machine serves only where master is local, as in tests."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        held = tempfile.TemporaryDirectory(prefix="graphloom-")
        _own["dir"] = "file://" + held.name
        atexit.register(held.cleanup)
    return _own["dir"]


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables that are deleted together when no result reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, tag: str = "step") -> DataFrame:
        """``df`` written and read again: its lineage ends here, and a lost task reads it anew."""
        path = f"{shared_folder(self.spark)}/graphloom/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def apart(self, df: DataFrame, by: str, spread: Column, tag: str = "step") -> DataFrame:
        """``df`` written in a folder for each value of the column ``by``, in files dealt by ``spread``: a condition on it reads that folder alone."""
        path = f"{shared_folder(self.spark)}/graphloom/{tag}-{uuid.uuid4().hex}"
        df.repartition(by, spread).write.partitionBy(by).parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()


def _at(spark: SparkSession, path: str):
    """A path, and the file system that has it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a table's write to ``path`` has ended."""
    at, fs = _at(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    at, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def commit(df: DataFrame, path: str, replace: bool = False) -> None:
    """Write ``df`` aside and rename it to ``path``: others see the whole table or none. Of two that write one path at once the first stays."""
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}-attempt-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    (a, fs), (b, _) = _at(spark, aside), _at(spark, path)
    if replace and fs.exists(b):
        fs.delete(b, True)
    fs.mkdirs(b.getParent())
    if fs.exists(b) or not fs.rename(a, b):
        fs.delete(a, True)
