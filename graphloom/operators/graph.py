"""Dated graphs from tables, their windows, and rankings of candidates without a cross join."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Scratch

F_TEST, F_VAL, JITTER, HALF_BAND_MIN = 0.07, 0.08, 0.05, 12


@dataclass(frozen=True)
class Graph:
    """nodes: id, d (date); edges: src, tgt, distinct and without loops."""

    nodes: DataFrame
    edges: DataFrame


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts as nodes, dated by first shipment; an edge from a part to the part of the next line of its order."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    nodes = line.groupBy(F.col("l_partkey").alias("id")).agg(F.min(F.to_date("l_shipdate")).alias("d"))
    a = line.select("l_orderkey", F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("src"))
    b = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("k"), F.col("l_partkey").alias("tgt"))
    return Graph(nodes, a.join(b, ["l_orderkey", "k"]).where("src <> tgt").select("src", "tgt").distinct())


def placed(nodes: DataFrame, more: Callable[[Column], dict[str, Column]] = lambda n: {}) -> DataFrame:
    """``nodes`` with rn (1 for the first by date, then id) and n, without gathering them in one task.

    more: further columns that follow from n, worked out once a day rather than once a node.
    """
    days = nodes.groupBy("d").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("d", before.alias("before"), F.sum("k").over(Window.partitionBy()).alias("n"))  # a row for each day
    own = more(F.col("n"))
    days = days.withColumns(own) if own else days
    inside = F.row_number().over(Window.partitionBy("d").orderBy("id"))
    return nodes.withColumn("i", inside).join(F.broadcast(days), "d").select("id", "d", (F.col("before") + F.col("i")).alias("rn"), "n", *own)


def split_sizes(n: Column, seed: Column) -> tuple[Column, Column]:
    """Sizes of the test and validation windows of n nodes: the affine jitter rule, no random draws."""
    half_even = lambda x: F.bround(x, 0).cast("bigint")
    test = half_even(F.lit(F_TEST) * n)
    v = F.greatest(half_even(F.lit(F_VAL) * F.lit(JITTER) * n), F.lit(HALF_BAND_MIN).cast("bigint"))
    span = 2 * v + 1
    step = F.filter(F.sequence(F.lit(5), F.lit(64)), lambda a: ~F.exists(F.sequence(F.lit(2), F.lit(64)), lambda p: (a % p == 0) & (span % p == 0)))[0]
    off = (step * (seed % span)) % span - v
    val = F.least(F.greatest(half_even(F.lit(F_VAL) * n) + off, F.lit(1)), n - test - 1)
    return test, val


def offset(n: int, seed: int) -> tuple[int, int]:
    """The same rule on the driver: (n_test, n_val)."""
    test, v = round(F_TEST * n), max(round(F_VAL * JITTER * n), HALF_BAND_MIN)
    span = 2 * v + 1
    step = next(a for a in range(5, 5 + span) if gcd(a, span) == 1)
    return test, min(max(round(F_VAL * n) + (step * (seed % span)) % span - v, 1), n - test - 1)


def windows(graph: Graph, seed: int = 101) -> DataFrame:
    """id, d, rn, n and win: 'test' for the newest nodes, 'val' for those before, else 'fit'."""
    p = placed(graph.nodes, lambda n: dict(zip(("test", "val"), split_sizes(n, F.lit(seed).cast("bigint")), strict=True)))
    test, val = F.col("test"), F.col("val")
    win = F.when(F.col("rn") > F.col("n") - test, "test").when(F.col("rn") > F.col("n") - test - val, "val").otherwise("fit")
    return p.select("id", "d", F.col("rn").cast("bigint").alias("rn"), F.col("n").cast("bigint").alias("n"), win.alias("win"))


#: The views of the last graph that was asked for, by application, folder and seed.
_views: dict[tuple[str, str, int], tuple[DataFrame, ...]] = {}


def register(spark: SparkSession, sf_dir: str, seed: int = 101) -> None:
    """Views of the part graph (nodes, edges, win) and of the tables, for queries in SQL.

    The graph is worked out once, where a query reads it, and let go when another one is asked for.
    """
    for t in ("lineitem", "orders", "part", "events", "documents", "pages", "embeddings", "customer", "nation", "region", "supplier", "benchmark", "conversations"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    key = (spark.sparkContext.applicationId, sf_dir, seed)
    if key not in _views:
        for old, dfs in _views.items():
            for df in dfs if old[0] == key[0] else ():
                df.unpersist()
        _views.clear()
        g = part_graph(spark, sf_dir)
        _views[key] = (g.nodes, g.edges, windows(g, seed))
    for name, df in zip(("nodes", "edges", "win"), _views[key], strict=True):
        df.persist().createOrReplaceTempView(name)


def rank_sparse(pool: DataFrame, positives: DataFrame, scores: DataFrame, own: bool = False) -> DataFrame:
    """Rank of each positive (src, tgt) among the pool, by score descending and then id.

    pool: id; scores: src, id, score > 0 of the pairs that have any; every other pair scores 0.
    A pair with a score is ranked among its source's scored pairs; one without comes after all
    of them, in the order of ids. So the work follows the scored pairs, not sources x pool.
    own: sources are in the pool themselves; a source is no candidate of its own.
    """
    by = Window.partitionBy("src")
    scored = scores.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "id"))).withColumn("below", F.row_number().over(by.orderBy("id")))
    number = scored.groupBy("src").agg(F.count("*").alias("scored"))
    place = numbered(pool)
    hit = positives.join(place.withColumnRenamed("id", "tgt"), "tgt").join(number, "src", "left")
    hit = hit.join(scored.select("src", F.col("id").alias("tgt"), "rank"), ["src", "tgt"], "left")
    # for those without a score: scored pairs of the source with a smaller id
    less = hit.where("rank is null").select("src", "tgt", "at", "scored").join(scored.select("src", "id", "below"), "src", "left").where("id < tgt or id is null")
    less = less.groupBy("src", "tgt").agg(F.max("below").alias("less"))
    hit = hit.join(less, ["src", "tgt"], "left")
    rest = F.coalesce("scored", F.lit(0)) + F.col("at") - F.coalesce("less", F.lit(0)) - (F.col("src") < F.col("tgt")).cast("int") * int(own)
    return hit.select("src", "tgt", F.coalesce("rank", rest).cast("bigint").alias("rank"))


def numbered(pool: DataFrame, slices: int = 256) -> DataFrame:
    """``pool`` with at: the place of each id from 1, numbered within slices of the id range."""
    low, high = pool.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return pool.withColumn("at", F.lit(0).cast("bigint"))
    width = (high - low) // slices + 1
    cut = pool.withColumn("s", F.floor((F.col("id") - low) / width))
    first = cut.groupBy("s").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("s").orderBy("id"))
    return cut.withColumn("i", inside).join(F.broadcast(first.select("s", "before")), "s").select("id", (F.col("before") + F.col("i")).alias("at"))


def in_order(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with at: the place of each from 1 in ``order``, which must tell all rows apart.

    Rows are dealt by sampled borders of the whole key and sorted where they arrive, so neither equal
    scores nor one order over all rows meet in one task; only a count for each part is added up.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the number of a row in its part
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "i": inside + 1})
    dealt = scratch.keep(dealt, "order")
    first = dealt.groupBy("part").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(first.select("part", "before"), "part").withColumn("at", F.col("before") + F.col("i")).drop("part", "i", "before")


def rank_global(pool: DataFrame, positives: DataFrame) -> DataFrame:
    """Ranks where the score depends on the candidate alone (pool: id, score): one order serves all sources."""
    with Scratch(pool.sparkSession) as scratch:
        ranked = in_order(pool.select("id", "score"), [F.desc("score"), F.asc("id")], scratch)
        hit = positives.join(ranked.select(F.col("id").alias("tgt"), F.col("at").alias("rank")), "tgt").select("src", "tgt", "rank")
        return Scratch(pool.sparkSession).keep(hit, "ranks")


def per_source(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("src").agg(F.min("rank").alias("best"), F.count("*").alias("n_reachable")).select(F.col("src").alias("source"), F.col("best").alias("best_rank"), F.round(1.0 / F.col("best"), 9).alias("rr"), "n_reachable")


def metrics(sources: DataFrame) -> DataFrame:
    mean = lambda x, a: F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6).alias(a)
    hit = lambda k: (F.col("best_rank") <= k).cast("double")
    return sources.agg(mean(1.0 / F.col("best_rank"), "mrr"), mean(hit(10), "hits_10"), mean(hit(100), "hits_100"), F.count("*").alias("sources"), F.coalesce(F.sum("n_reachable"), F.lit(0)).alias("positives"))


def observed(graph: Graph, win: DataFrame, seed_win: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pool of ids, positives of the window's sources, edges of the other sources)."""
    w = graph.edges.join(win.select(F.col("id").alias("src"), "win"), "src")
    pool = win.where(F.col("win") != "test").select("id")
    return pool, w.where(F.col("win") == seed_win).select("src", "tgt"), w.where("win <> 'test'").select("src", "tgt")


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct()


def paths(kind: str, edges: DataFrame, sources: DataFrame, pool: DataFrame) -> DataFrame:
    """(src, id, w, by): what the score of a source and a candidate is the sum of, w, and what it is divided by, on the symmetric form of ``edges``.

    adj is the adjacency bit; common_neighbors, adamic_adar and resource_allocation sum over the
    shared neighbours, with weights 1, 1/ln(degree) and 1/degree; normalised_neighbors is common_neighbors over the root of
    both ends' degrees' product (1 at least). The forms over the bit, bit_adamic_adar and bit_resource, have the source's
    own weight for each neighbour, and bit_normalized 1 over that root.
    """
    both = symmetric(edges).persist()
    deg = both.groupBy("src").agg(F.count("*").alias("deg"))
    share = {"adamic_adar": F.when(F.col("deg") > 1, 1 / F.ln(F.greatest("deg", F.lit(2)))).otherwise(0.0), "resource_allocation": 1 / F.col("deg")}
    near = both.join(pool.withColumnRenamed("id", "tgt"), "tgt", "left_semi")  # candidates alone are worth a second step
    root = lambda a, b: F.greatest(F.sqrt((F.col(a) * F.col(b)).cast("double")), F.lit(1.0))
    of = lambda n, d: deg.select(F.col("src").alias(n), F.col("deg").alias(d))
    one = F.lit(1.0)
    if kind == "adj":
        return near.join(sources, "src").where("tgt <> src").select("src", F.col("tgt").alias("id"), one.alias("w"), one.alias("by"))
    if kind.startswith("bit_"):
        rows = near.join(sources, "src").where("tgt <> src").join(deg, "src")
        if kind == "bit_normalized":
            rows = rows.join(of("tgt", "other"), "tgt")
            score = 1 / F.greatest(F.sqrt(F.col("deg") * F.col("other").cast("double")), F.lit(1.0))
        else:
            score = share["adamic_adar" if kind == "bit_adamic_adar" else "resource_allocation"]
        return rows.select("src", F.col("tgt").alias("id"), F.round(score, 9).alias("w"), one.alias("by"))
    first, last = both.join(sources, "src").select("src", F.col("tgt").alias("mid")), near.select(F.col("src").alias("mid"), F.col("tgt").alias("id"))
    by = one
    if kind == "normalised_neighbors":  # degrees join the steps, which are edges, and not the pairs
        first, last, by = first.join(of("src", "x"), "src"), last.join(of("id", "y"), "id"), root("x", "y")
    if kind in share:
        first = first.join(deg.select(F.col("src").alias("mid"), share[kind].alias("w")), "mid")
    else:
        first = first.withColumn("w", one)
    return first.join(last, "mid").where("id <> src").select("src", "id", "w", by.alias("by"))


def best_sparse(pool: DataFrame, positives: DataFrame, scores: DataFrame) -> DataFrame:
    """(source, best_rank, rr, n_reachable) where a pair's score is the sum of its rows' w over ``by``, to 9 digits, and every other pair scores 0.

    The ranks are those of ``rank_sparse``, of which a source's best needs no order: it is one more than the scored pairs
    before the first positive. Rows and positives are dealt by source once, and all that follows stays there.
    """
    place = numbered(pool)
    rows = scores.select("src", "id", F.col("w").cast("double").alias("w"), F.col("by").cast("double").alias("by"), F.lit(0).alias("pos"))
    reach = positives.join(pool.withColumnRenamed("id", "tgt"), "tgt", "left_semi")
    rows = rows.union(reach.select("src", F.col("tgt").alias("id"), F.lit(0.0), F.lit(None).cast("double"), F.lit(1)))
    pairs = rows.repartition("src").groupBy("src", "id").agg(F.sum("w").alias("w"), F.max("by").alias("by"), F.max("pos").alias("pos"))
    pairs = pairs.select("src", "id", F.round(F.col("w") / F.coalesce("by", F.lit(1.0)), 9).alias("score"), "pos")
    own, scored = Window.partitionBy("src"), F.col("score") > 0
    pairs = pairs.withColumns({"top": F.min(F.when((F.col("pos") == 1) & scored, F.struct((-F.col("score")).alias("less"), "id"))).over(own), "low": F.min(F.when(F.col("pos") == 1, F.col("id"))).over(own)})
    before = F.struct((-F.col("score")).alias("less"), "id") < F.col("top")
    found = pairs.groupBy("src", "low").agg(F.max(F.col("top").isNotNull()).alias("hit"), F.count_if(scored & before).alias("ahead"), F.count_if(scored).alias("scored"), F.count_if(scored & (F.col("id") < F.col("low"))).alias("less"), F.sum("pos").alias("n_reachable")).where("low is not null")
    rest = found.join(place.withColumnRenamed("id", "low"), "low").withColumn("best_rank", F.when(F.col("hit"), F.col("ahead") + 1).otherwise(F.col("scored") + F.col("at") - F.col("less")).cast("bigint"))
    return rest.select(F.col("src").alias("source"), "best_rank", F.round(1.0 / F.col("best_rank"), 9).alias("rr"), "n_reachable")


#: Paths of a task, about.
PATHS = 1_500_000


def two_hop(edges: DataFrame, most: int = PATHS) -> DataFrame:
    """(src, tgt, paths): how many paths of two ``edges`` (src, tgt) lead from one node to another.

    Their number is worked out from the degrees first, and paths are dealt by both ends to as many tasks as hold about ``most``
    each, so no task's table of counts follows the size of the graph.
    """
    outs = edges.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("o"))
    ins = edges.groupBy(F.col("tgt").alias("mid")).agg(F.count("*").alias("i"))
    number = ins.join(outs, "mid").agg(F.coalesce(F.sum(F.col("i").cast("double") * F.col("o")), F.lit(0.0))).first()[0]
    parts = int(min(20_000, max(edges.sparkSession.sparkContext.defaultParallelism, -(-number // most))))
    steps = edges.select("src", F.col("tgt").alias("mid")).join(edges.select(F.col("src").alias("mid"), "tgt"), "mid").select("src", "tgt")
    return steps.repartition(parts, "src", "tgt").groupBy("src", "tgt").agg(F.count("*").alias("paths"))


#: Positives from which a source's draws are rows, and not an array of its own; draws of a task, about.
HUB, DRAWS = 10_000, 500_000


def _hashes(head: bytes, start: int, stop: int) -> np.ndarray:
    """The first 15 hexadecimal digits of md5 of ``head`` and each number from ``start`` to ``stop`` - 1."""
    raw = b"".join([hashlib.md5(head + b"%d" % j, usedforsecurity=False).digest()[:8] for j in range(start, stop)])
    return (np.frombuffer(raw, ">u8") >> np.uint64(4)).astype(np.int64)


def _places(src: object, mark: str, k: int, n: int, held: np.ndarray) -> np.ndarray:
    """The first 10 k places in the order of a source's draws that are new and not in ``held``."""
    head = f"{src}{mark}".encode()
    if 40 * k >= n:
        order = np.argsort(_hashes(head, 1, n + 1), kind="stable") + 1
        return order[~np.isin(order, held)][: 10 * k]
    drawn, most = np.zeros(0, np.int64), 10 * k + 120 * k * k // n + 10  # repeats and positives among 10 k draws are 60 k^2 / n about
    for stop in (min(most, 40 * k), 40 * k):
        drawn = np.concatenate([drawn, _hashes(head, len(drawn) + 1, stop + 1) % n + 1])
        new = drawn[np.sort(np.unique(drawn, return_index=True)[1])]
        new = new[~np.isin(new, held)][: 10 * k]
        if len(new) == 10 * k:
            break
    return new


def negatives(edges: DataFrame, win: DataFrame, mark: str = ":", hub: int = HUB) -> DataFrame:
    """(src, id): 10 k nodes of the fit window that are no targets of src, for each source of that window with k edges, or all there are.

    Fit nodes have the places 1 to n. Where 40 k < n, places are drawn by a hash of src, ``mark`` and the number of the draw, and the first
    10 k that are new and no positive's are taken, of 40 k draws at most; else all places are taken in the order of that hash. Draws are
    an array of their source, and of 40 k only the first are worked out where they are enough, so rows are as many as the result's. Sources
    are dealt to as many tasks as their draws need. Those of a source with more than ``hub`` edges are rows, put in order by a window.
    """
    fit = win.where("win = 'fit'").select("id", F.col("rn").alias("place"))
    of = lambda n, *c: fit.select(F.col("id").alias(n), *c)
    own = edges.join(of("src"), "src")
    number, most = own.groupBy("src").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
    parts = int(min(20_000, max(edges.sparkSession.sparkContext.defaultParallelism, -(-10 * number // DRAWS))))
    held = own.join(of("tgt", "place"), "tgt", "left")
    asks = held.repartition(parts, "src").groupBy("src").agg(F.count("*").alias("k"), F.collect_list("place").alias("held")).crossJoin(F.broadcast(fit.agg(F.count("*").alias("n"))))  # one row

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, k, n = (b.column(c).to_pylist() for c in ("src", "k", "n"))
            for at in range(0, len(src), 64):  # sources of a batch of the result
                found = [_places(src[i], mark, k[i], n[i], b.column("held")[i].values.to_numpy()) for i in range(at, min(at + 64, len(src)))]
                rows = pa.array(np.repeat(np.arange(at, at + len(found)), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([b.column("src").take(rows), pa.array(np.concatenate(found), pa.int64())], ["src", "place"])

    usual = asks.where(F.col("k") <= hub).mapInArrow(drawn, f"src {edges.schema['src'].dataType.simpleString()}, place long")
    if most <= hub:
        return usual.join(fit, "place").select("src", "id")
    few = 40 * F.col("k") < F.col("n")
    hashed = F.conv(F.substring(F.md5(F.concat(F.col("src").cast("string"), F.lit(mark), F.col("j").cast("string"))), 1, 15), 16, 10).cast("bigint")
    rows = asks.where(F.col("k") > hub).select("src", "k", "n", few.alias("few"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(40 * F.col("k"), "n"))).alias("j")).withColumn("h", hashed)
    rows = rows.groupBy("src", "k", F.when(F.col("few"), F.pmod("h", "n") + 1).otherwise(F.col("j")).alias("place")).agg(F.min(F.when(F.col("few"), F.col("j")).otherwise(F.col("h"))).alias("o"))
    rows = rows.join(held.select("src", "place"), ["src", "place"], "left_anti")
    hubs = rows.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("o", "place"))).where("r <= 10 * k").select("src", "place")
    return usual.union(hubs).join(fit, "place").select("src", "id")
