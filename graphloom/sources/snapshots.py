"""Graphs as snapshots that carry a hash of their content, and tables kept by the recipe that makes them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables as X

#: A graph as one document: nodes by their place, edges as pairs of places.
DOCUMENT = "dataset string, built_at string, nodes array<struct<name:string,date:string,date_latest:string,text:string>>, edges array<array<long>>, stats string"


def content_hash(df: DataFrame) -> str:
    """A hash of the rows of ``df`` as a bag, with their columns: the same in any order and partitioning, another after any change of a row.

    Each row gives two hashes of 64 bits that tell a null from every value; their sums are an aggregate, so two
    numbers and a count leave each task.
    """
    cells = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    one = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)"))
    n, a, b = df.agg(F.count("*"), one(1), one(2)).first()
    return hashlib.sha256(json.dumps([df.schema.json(), n, str(a), str(b)]).encode()).hexdigest()


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, **said: str) -> dict[str, str]:
    """Write nodes (name, date, ...) and edges (src, tgt) with a summary of their hashes and what else is ``said``; the summary, written last, makes it whole."""
    spark = nodes.sparkSession
    X.commit(nodes, f"{folder}/nodes", replace=True)
    X.commit(edges, f"{folder}/edges", replace=True)
    summary = said | {name: content_hash(spark.read.parquet(f"{folder}/{name}")) for name in ("nodes", "edges")}
    X.commit(spark.createDataFrame(sorted(summary.items()), "name string, value string").coalesce(1), f"{folder}/summary", replace=True)
    return summary


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(nodes, edges, summary) of a snapshot; a missing one, or a part that isn't what the summary says, is an error."""
    if not X.whole(spark, f"{folder}/summary"):
        raise FileNotFoundError(f"no whole snapshot in {folder}")
    summary = {r.name: r.value for r in spark.read.parquet(f"{folder}/summary").collect()}  # a row for each entry
    nodes, edges = (spark.read.parquet(f"{folder}/{name}") for name in ("nodes", "edges"))
    for name, df in (("nodes", nodes), ("edges", edges)):
        if content_hash(df) != summary[name]:
            raise ValueError(f"{name} of {folder} changed since its summary was written")
    return nodes, edges, summary


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, name, date, text; edges: src, tgt) of a graph that is one JSON document, gzipped or not. One task reads it, as the format asks."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    nodes = raw.select(F.posexplode("nodes").alias("id", "n")).select(F.col("id").cast("long").alias("id"), "n.name", F.to_date("n.date").alias("date"), F.coalesce("n.text", F.lit("")).alias("text"))
    return nodes, raw.select(F.explode("edges").alias("e")).select(F.col("e")[0].alias("src"), F.col("e")[1].alias("tgt"))


def graph_stats(nodes: DataFrame, edges: DataFrame, key: str = "id", date: str = "date") -> DataFrame:
    """One row of counts of a graph: what a snapshot's statistics state."""
    size = nodes.agg(F.count("*").alias("n_nodes"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    out, into = (edges.groupBy(c).agg(F.count("*").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)).alias(n), F.count("*").alias(f"{n}_nodes")) for c, n in (("src", "max_out"), ("tgt", "max_in")))
    met = edges.select(F.col("src").alias(key)).union(edges.select("tgt"))
    alone = nodes.join(met, key, "left_anti").agg(F.count("*").alias("isolated"))
    mutual = edges.join(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")), ["src", "tgt"], "left_semi").agg(F.count("*").alias("mutual"))
    out, into = out.withColumnRenamed("max_out_nodes", "with_out"), into.drop("max_in_nodes")
    rows = size.crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(out).crossJoin(into).crossJoin(alone).crossJoin(mutual)  # one row each
    return rows.withColumn("reciprocity", F.coalesce(F.col("mutual") / F.nullif(F.col("n_edges"), F.lit(0)), F.lit(0.0))).drop("mutual")


def cached(spark: SparkSession, folder: str, recipe: dict, inputs: list[DataFrame], build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(table, whether it was at hand) kept under a key of the recipe and the content of its inputs.

    A table whose content isn't what was kept, as after a partial copy, is built anew and replaced.
    """
    key = hashlib.sha256(json.dumps([recipe, *map(content_hash, inputs)], sort_keys=True).encode()).hexdigest()[:12]
    data, note = f"{folder}/{key}/table", f"{folder}/{key}/hash"
    if X.whole(spark, data) and X.whole(spark, note):
        try:
            df = spark.read.parquet(data)
            if spark.read.parquet(note).first()["value"] == content_hash(df):
                return df, True
        except Exception as e:  # a damaged file, which Spark reports in many ways
            if "parquet" not in str(e).lower() and "FAILED_READ_FILE" not in str(e):
                raise
    X.commit(build(), data, replace=True)
    df = spark.read.parquet(data)
    X.commit(spark.createDataFrame([(content_hash(df),)], "value string").coalesce(1), note, replace=True)
    return df, False
