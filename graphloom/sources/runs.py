"""Records of runs, one JSON document a file, in the shapes that they have had."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGE = "struct<mrr:double,`hits@10`:double,`hits@100`:double,sources:int,positives:int,candidates_mean:double>"
_FLOOR = "struct<mrr:double,test:struct<mrr:double>>"
RECORD = f"dataset string, model string, registry_model string, recipe string, seed int, grid_id string, val {_STAGE}, test {_STAGE}, floor {_FLOOR}, frozen_floor_test double, seconds double, train_seconds double, param_count long, best_epoch int, broken string"
#: Other names of the same models.
ALIASES = {"rcgat_sym": "ragat_sym", "rcgat_time": "ragat_time", "rcgat_asym": "ragat_asym"}


def run_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of ``path`` (a glob): dataset, model, seed, grid_id, metrics of both stages, floor, cost and file.

    A floor may be flat or nested by stage, or stand as frozen_floor_test; a model may have an alias, a registry
    name, or be a recipe. Files that are no JSON have a null dataset and their text in ``broken``.
    """
    raw = spark.read.schema(RECORD).option("multiLine", True).option("columnNameOfCorruptRecord", "broken").json(path)
    model = F.coalesce("registry_model", "model", "recipe")
    for alias, name in ALIASES.items():
        model = F.when(model == alias, name).otherwise(model)
    floor = F.coalesce(F.col("floor.test.mrr"), F.col("floor.mrr"), F.col("frozen_floor_test"))
    stage = lambda s: [F.col(f"{s}.mrr").alias(f"{s}_mrr"), F.col(f"{s}.`hits@10`").alias(f"{s}_hits_10"), F.col(f"{s}.`hits@100`").alias(f"{s}_hits_100")]
    return raw.select("dataset", model.alias("model"), "seed", "grid_id", *stage("val"), *stage("test"), F.col("test.sources").alias("sources"), F.col("test.positives").alias("positives"), floor.alias("floor"), F.coalesce("train_seconds", "seconds").alias("seconds"), "param_count", "best_epoch", "broken", F.input_file_name().alias("file"))


def latest(runs: DataFrame) -> DataFrame:
    """Of files of one (dataset, model, seed, grid_id) the last by name; broken ones go."""
    key = ["dataset", "model", "seed", "grid_id"]
    rest = [c for c in runs.columns if c not in (*key, "file", "broken")]
    best = runs.where("broken is null and dataset is not null").groupBy(*key).agg(F.max(F.struct("file", *rest)).alias("r"))
    return best.select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))
