"""Parts of a graph that no edge leaves, each packed in one row of bounded size.

A walk, or a power of the adjacency, never leaves a part, so all its steps are worked out where the part's row meets
some of the vectors, and arrays don't move along edges from task to task. A graph with a part over the bounds has
no such table; the operators then go step by step over its edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import symmetric
from .tables import Scratch

#: Bounds of a part: nodes, and entries of the symmetric adjacency (4 bytes each when packed). Rounds after which labels must be settled.
NODES, ENTRIES, ROUNDS = 131_072, 4_000_000, 16
#: Columns of a product that go together, so that they stay in a core's cache.
COLUMNS = 16


def components(both: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame | None:
    """(id, part): the least id that a node of symmetric edges (src, tgt) reaches; None where that isn't settled after ``rounds``."""
    now = scratch.keep(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("tgt"), F.first("src")).alias("part")), "label")
    for _ in range(rounds):
        near = both.join(now.select(F.col("id").alias("tgt"), "part"), "tgt").groupBy(F.col("src").alias("id")).agg(F.min("part").alias("low"))
        low = now.join(near, "id").select("id", "part", F.least("part", "low").alias("low"))
        far = now.select(F.col("id").alias("low"), F.col("part").alias("jump"))  # the label of a node's label
        new = scratch.keep(low.join(far, "low").select("id", F.least("low", "jump").alias("part"), (F.col("part") > F.least("low", "jump")).alias("moved")), "label")
        if not new.where("moved").limit(1).count():
            return new.select("id", "part")
        now = new.select("id", "part")
    return None


def packed(edges: DataFrame, scratch: Scratch, nodes: int | None = None, entries: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(members: id, part; parts: part, ids, deg, idx) of the symmetric form of ``edges``; None where a component is over the bounds.

    ids are those of a part by falling degree (then id), deg their degrees. idx has the places of the neighbours: of every node its first, then
    its second of those that have one, and so on. Small components share a part.
    """
    nodes, entries = nodes or NODES, entries or ENTRIES
    both = scratch.keep(symmetric(edges.where("src <> tgt")), "both")
    labels = components(both, scratch)
    if labels is None:
        return None
    sizes = both.join(labels.withColumnRenamed("id", "src"), "src").groupBy("part").agg(F.count_distinct("src").alias("n"), F.count("*").alias("m"))
    sizes = scratch.keep(sizes, "sizes")
    small = (F.col("n") * 8 < nodes) & (F.col("m") * 8 < entries)
    most_n, most_m, few_n, few_m = sizes.agg(F.max("n"), F.max("m"), F.sum(F.when(small, F.col("n"))), F.sum(F.when(small, F.col("m")))).first()
    if most_n is None or most_n > nodes or most_m > entries:
        return None
    bins = 1 + max((few_n or 0) * 4 // nodes, (few_m or 0) * 4 // entries)
    shared = F.min("part").over(Window.partitionBy("bin"))
    named = sizes.where(~small).select("part", F.col("part").alias("into")).union(sizes.where(small).withColumn("bin", F.pmod(F.xxhash64("part"), F.lit(bins))).select("part", shared.alias("into")))
    members = scratch.keep(labels.join(named, "part").select("id", F.col("into").alias("part")), "members")
    rows = both.join(members.withColumnRenamed("id", "src"), "src").select("part", "src", "tgt")

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        src, tgt = (t.column(c).to_numpy() for c in ("src", "tgt"))
        ids, at, deg = np.unique(src, return_inverse=True, return_counts=True)
        order = np.lexsort((ids, -deg))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        a, b = place[at], place[np.searchsorted(ids, tgt)]
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
        turn = np.arange(len(a)) - np.searchsorted(a, a)  # of a node's neighbours the first, second, ...
        idx = b[np.lexsort((a, turn))].astype(np.int32)
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "ids": one(ids[order], pa.int64()), "deg": one(deg[order].astype(np.int32), pa.int32()), "idx": one(idx, pa.int32())})

    return members, scratch.keep(rows.groupBy("part").applyInArrow(pack, "part long, ids array<long>, deg array<int>, idx array<int>"), "parts")


class Adjacency:
    """The symmetric 0/1 matrix of a part's row."""

    def __init__(self, deg: np.ndarray, idx: np.ndarray):
        self.deg, idx = deg.astype(float), idx.astype(np.intp)
        counts = len(deg) - np.searchsorted(deg[::-1], np.arange(1, (deg[0] if len(deg) else 0) + 1))  # nodes with a first, second, ... neighbour
        self.turns = [idx[e - m : e] for m, e in zip(counts, np.cumsum(counts), strict=True)]

    def times(self, x: np.ndarray) -> np.ndarray:
        """The matrix times ``x`` (nodes, COLUMNS at most)."""
        out, held = np.zeros_like(x), np.empty_like(x)
        for own in self.turns:
            m = len(own)
            np.take(x, own, axis=0, out=held[:m], mode="clip")
            out[:m] += held[:m]
        return out
