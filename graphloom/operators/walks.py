"""Personalised walks, and leading singular vectors, by joins over sparse matrices.

A matrix is a table (i, j, w). A block of vectors is a table with an id and an array; it stays
distributed, and only k x k matrices come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import numbered, symmetric
from .parts import COLUMNS, Adjacency, packed
from .tables import Scratch


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the cluster's checkpoint folder, or persisted where none is set."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()


#: Sources whose walks go together, as one array a node; least number that a part meets in a task.
WALKS = 64


def personal_rank(edges: DataFrame, sources: DataFrame, alpha: float = 0.15, steps: int = 20) -> DataFrame:
    """(src, id, score) of truncated personalised PageRank on the symmetric form of ``edges``, where the score isn't 0.

    score = (1 - alpha) * sum over k <= steps of alpha^k P^k, P row-stochastic; a node without neighbours
    passes nothing on. A walk stays in the part of the graph that its source is in: each part meets some sources, WALKS at least,
    and takes all steps there. Where a part is over the bounds of ``parts``, the steps are joins over the edges.
    """
    found = packed(edges, held := Scratch(edges.sparkSession))  # read by the result
    if found is None:
        held.clear()
        return stepped(edges, sources, alpha, steps)

    def rows(ids: np.ndarray, src: np.ndarray, asked: list, score: np.ndarray, pool: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(len(src)):
            own = score[:, k]
            to = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), src[k])), pa.array(ids[to]), pa.array(own[to])], ["src", "id", "score"])

    own = sources.select("src").distinct()
    inside, outside = _asked(own, found[0], held)
    alone = outside.select("src", F.col("src").alias("id"), F.lit(1.0 - alpha).alias("score"))
    return _walked(found[1], inside.withColumn("asked", F.lit(None).cast("array<long>")), rows, "src long, id long, score double", alpha, steps).union(alone)


def _asked(own: DataFrame, members: DataFrame, held: Scratch) -> tuple[DataFrame, DataFrame]:
    """``own`` (src, ...) with the part of each, and those that are in none."""
    placed = held.keep(own.join(members.withColumnRenamed("id", "src"), "src", "left"), "asks")
    return placed.where("part is not null"), placed.where("part is null").drop("part")


def _walked(parts: DataFrame, asks: DataFrame, give: Callable, kind: str, alpha: float, steps: int) -> DataFrame:
    """What ``give`` makes of (ids, sources, what each asked, scores: a row for each of ids, a column for each source, pool: ids where ``parts`` says so), over tiles of ``asks`` (src, part, asked), of WALKS at least."""
    each = max(WALKS, -(-asks.count() // (4 * asks.sparkSession.sparkContext.defaultParallelism)))  # a part goes to each of its tiles
    number = asks.groupBy("part").agg(F.ceil(F.count("*") / F.lit(each)).alias("tiles"))
    tiles = asks.join(number, "part").withColumn("tile", F.pmod(F.xxhash64("src"), F.col("tiles")))
    tiles = tiles.groupBy("part", "tile").agg(F.collect_list(F.struct("src", "asked")).alias("asks"))  # some ``each`` rows
    some = min(10_000, 2 * tiles.count() + 1)
    copies = parts.join(number, "part").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    met = tiles.repartition(some, "part", "tile").join(copies.repartition(some, "part", "tile"), ["part", "tile"]).select("asks", *parts.columns)
    has_pool = "pool" in parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, deg, idx = (b.column(c)[k].values.to_numpy() for c in ("ids", "deg", "idx"))
                a, asks = Adjacency(deg, idx), b.column("asks")[k].as_py()
                src = np.array([x["src"] for x in asks], np.int64)
                pool = b.column("pool")[k].values.to_numpy() if has_pool and b.column("pool")[k].is_valid else ids[:0]
                order = np.argsort(ids)
                at = order[np.searchsorted(ids, src, sorter=order)]
                for c in range(0, len(src), COLUMNS):
                    now = np.zeros((len(ids), len(at[c : c + COLUMNS])))
                    now[at[c : c + COLUMNS], np.arange(now.shape[1])] = 1.0 - alpha
                    total, by = now.copy(), (alpha / a.deg)[:, None]
                    for _ in range(steps):
                        now = a.times(now * by)
                        total += now
                    yield from give(ids, src[c : c + COLUMNS], [x["asked"] for x in asks[c : c + COLUMNS]], total, pool)

    return met.mapInArrow(run, kind)


def walk_ranks(pool: DataFrame, positives: DataFrame, edges: DataFrame, alpha: float = 0.15, steps: int = 20) -> DataFrame | None:
    """(source, best_rank, rr, n_reachable) of ``positives`` (src, tgt) in the pool by ``personal_rank``, to 9 digits; as ``graph.best_sparse`` gives them from its rows.

    A source's scores are counted where they were worked out and never become rows. None where a part of the graph is over the bounds.
    """
    held = Scratch(edges.sparkSession)  # read by the result
    found = packed(edges, held)
    if found is None:
        held.clear()
        return None
    members, parts = found
    in_pool = members.join(pool, "id", "left_semi").groupBy("part").agg(F.collect_list("id").alias("pool"))  # a part's ids, which are bounded
    parts = held.keep(parts.join(in_pool, "part", "left"), "parts")
    reach = positives.join(pool.withColumnRenamed("id", "tgt"), "tgt", "left_semi")
    own = held.keep(reach.groupBy("src").agg(F.min("tgt").alias("low"), F.count("*").alias("n_reachable")), "lows")
    near = reach.join(members.select(F.col("id").alias("tgt"), F.col("part").alias("of")), "tgt").join(members.withColumnRenamed("id", "src"), "src").where("part = of")
    near = near.groupBy("src").agg(F.collect_list("tgt").alias("near"))  # other positives have the score 0
    asks = own.join(near, "src", "left").select("src", F.concat(F.array("low"), F.coalesce("near", F.array().cast("array<long>"))).alias("asked"))
    inside, _ = _asked(asks, members, held)

    def counted(ids: np.ndarray, src: np.ndarray, asked: list, score: np.ndarray, pool: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids)
        is_in = np.isin(ids, pool)
        out = []
        for k, (s, (low, *near)) in enumerate(zip(src, asked, strict=True)):
            w = np.where(is_in & (ids != s), np.round(score[:, k] + 1.3e-12, DIGITS), 0.0)
            at = order[np.searchsorted(ids, near, sorter=order)] if near else np.zeros(0, np.int64)
            at = at[w[at] > 0]
            ahead = -1
            if len(at):
                first = at[np.lexsort((ids[at], -w[at]))[0]]
                ahead = int(((w > w[first]) | ((w == w[first]) & (ids < ids[first]))).sum())
            out.append((s, ahead, int((w > 0).sum()), int(((w > 0) & (ids < low)).sum())))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["src", "ahead", "scored", "less"])

    counts = _walked(parts, inside, counted, "src long, ahead long, scored long, less long", alpha, steps)
    rows = own.join(held.keep(counts, "counts"), "src", "left").join(numbered(pool).withColumnRenamed("id", "low"), "low")
    zero = lambda c: F.coalesce(c, F.lit(0))
    best = F.when(F.col("ahead") >= 0, F.col("ahead") + 1).otherwise(zero("scored") + F.col("at") - zero("less")).cast("bigint")
    return rows.select(F.col("src").alias("source"), best.alias("best_rank"), F.round(1.0 / best, 9).alias("rr"), "n_reachable")


def stepped(edges: DataFrame, sources: DataFrame, alpha: float = 0.15, steps: int = 20) -> DataFrame:
    """``personal_rank`` by joins over the edges, for parts of any size.

    The walks of WALKS sources are one array for each node that any of them has reached,
    so a step moves arrays along edges and adds them up in batches before the shuffle.
    """
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        both = symmetric(edges)
        go = both.join(both.groupBy("src").agg(F.count("*").alias("deg")), "src").select(F.col("src").alias("mid"), F.col("tgt").alias("to"), (F.lit(alpha) / F.col("deg")).alias("p"))
        go = scratch.keep(go, "go")
        own = sources.select("src").distinct()
        tile = F.pmod(F.xxhash64("src"), F.lit(max(1, -(-own.count() // WALKS)))).cast("int")
        asks = scratch.keep(own.withColumn("tile", tile).withColumn("slot", F.row_number().over(Window.partitionBy("tile").orderBy("src")) - 1), "asks")
        width = (asks.agg(F.max("slot")).first()[0] or 0) + 1
        one = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(k == F.col("slot"), 1.0 - alpha).otherwise(0.0))
        now = scratch.keep(asks.select("tile", F.col("src").alias("id"), one.alias("x")), "walk")
        total = now
        for _ in range(steps):
            moved = now.withColumnRenamed("id", "mid").join(go, "mid").select("tile", F.col("to").alias("id"), F.col("p").alias("w"), "x")
            now = scratch.keep(added(moved, ["tile", "id"]), "walk")
            total = total.union(now)
        total = added(total.withColumn("w", F.lit(1.0)), ["tile", "id"])
        scores = total.select("tile", "id", F.posexplode("x").alias("slot", "score")).where("score <> 0").join(asks, ["tile", "slot"])
        return Scratch(spark).keep(scores.select("src", "id", "score"), "scores")


def normalized_adjacency(edges: DataFrame) -> DataFrame:
    """(i, j, w) of D^-1/2 A D^-1/2 for the symmetric form of ``edges``."""
    both = symmetric(edges)
    deg = both.groupBy("src").agg(F.count("*").cast("double").alias("deg"))
    rows = both.join(deg.withColumnRenamed("deg", "a"), "src").join(deg.select(F.col("src").alias("tgt"), F.col("deg").alias("b")), "tgt")
    return rows.select(F.col("src").alias("i"), F.col("tgt").alias("j"), (1 / F.sqrt(F.col("a") * F.col("b"))).alias("w"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    x = np.ascontiguousarray(x, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _by(keys: list[str]):
    """Rows (keys, w, x) as the sum of w x for each run of equal keys of a batch; of sorted rows, for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last key of a batch, which may go on in the next
        give = lambda k, x: pa.RecordBatch.from_arrays([*k.columns, _lists(x)], [*keys, "x"])
        for b in batches:
            if not b.num_rows:
                continue
            own, x = b.select(keys), _matrix(b.column("x")) * b.column("w").to_numpy()[:, None]
            order = pc.sort_indices(own, sort_keys=[(k, "ascending") for k in keys])
            own, x = own.take(order), x[order.to_numpy()]
            new = np.zeros(len(x), bool)
            new[0] = True
            for c in own.columns:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            own, x = own.take(pa.array(first)), np.add.reduceat(x, first, axis=0)
            if held is not None and held[0].equals(own.slice(0, 1)):
                x[0] += held[1][0]
            elif held is not None:
                yield give(*held)
            held = own.slice(len(x) - 1), x[-1:].copy()
            if len(x) > 1:
                yield give(own.slice(0, len(x) - 1), x[:-1])
        if held is not None:
            yield give(*held)

    return run


def added(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, x): the sum of w x over ``rows`` (keys, w, x) of each key (id), added up in batches before the shuffle."""
    keys = keys or ["id"]
    kind = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "x array<double>"])
    some = rows.select(*keys, "w", "x").mapInArrow(_by(keys), kind)
    return some.repartition(*keys).sortWithinPartitions(*keys).withColumn("w", F.lit(1.0)).mapInArrow(_by(keys), kind)


def _weighted(matrix: DataFrame, block: DataFrame, turned: bool = False) -> DataFrame:
    """(id, w, x): what each entry of the matrix, or of its transpose, makes of a block."""
    a, b = ("j", "i") if turned else ("i", "j")
    return matrix.join(block.withColumnRenamed("id", b), b).select(F.col(a).alias("id"), "w", "x")


def _times(matrix: DataFrame, block: DataFrame, turned: bool = False) -> DataFrame:
    return added(_weighted(matrix, block, turned))


def _gram(block: DataFrame, k: int) -> np.ndarray:
    """The k x k matrix of a block's inner products, from one such matrix a task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for p in parts:
            if len(p):
                x = np.stack(p["x"].to_numpy())
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange(k * k), "v": total.ravel()})

    rows = block.select("x").mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # k * k rows
    out = np.zeros(k * k)
    out[rows.column("at").to_numpy()] = rows.column("v").to_numpy()
    return out.reshape(k, k)


def _turned(block: DataFrame, by: np.ndarray) -> DataFrame:
    """A block times a small matrix."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield pd.DataFrame({"id": p["id"], "x": list(np.stack(p["x"].to_numpy()) @ by)})

    return block.mapInPandas(run, f"id {block.schema['id'].dataType.simpleString()}, x array<double>")


def _orthonormal(block: DataFrame, k: int) -> DataFrame:
    """A basis of a block's span; directions that have vanished become zero columns."""
    gram = _gram(block, k)
    size = np.diag(gram).copy()
    size = np.where(size > 0, 1 / np.sqrt(np.maximum(size, 1e-300)), 0.0)  # columns of one length first: the rest is then well conditioned
    values, vectors = np.linalg.eigh(gram * size[:, None] * size)
    scale = np.where(values > max(values.max(), 0) * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return _turned(block, size[:, None] * vectors * scale)


def _drawn(ids: DataFrame, k: int, seed: int) -> DataFrame:
    """A block of hashed numbers in (-1, 1): the same in every evaluation."""
    one = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(c), "id"), F.lit(2000003)) / 1000001.0 - 1.0
    return ids.select("id", F.array(*map(one, range(k))).alias("x"))


def _squared(matrix: DataFrame, block: DataFrame, scratch: Scratch, factor: float = 1.0, *more: tuple[DataFrame, float], gram: bool = False) -> DataFrame:
    """factor * M^T M block, with multiples of other blocks added; ``matrix`` is M, or M^T M where ``gram``."""
    image = block if gram else scratch.keep(_times(matrix, block))
    rows = _weighted(matrix, image, True).withColumn("w", F.col("w") * factor)
    for other, by in more:
        rows = rows.union(other.select("id", F.lit(by).alias("w"), "x"))
    return scratch.keep(added(rows))


def _gram_of(matrix: DataFrame) -> DataFrame:
    """(i, j, w) of M^T M: products of the entries of a row, added up before the shuffle."""
    other = matrix.select("i", F.col("j").alias("k"), F.col("w").alias("y"))
    return matrix.join(other, "i").groupBy("j", "k").agg(F.sum(F.col("w") * F.col("y")).alias("w")).select(F.col("j").alias("i"), F.col("k").alias("j"), "w")


def singular(matrix: DataFrame, k: int, seed: int = 42, rounds: int = 30, spare: int | None = None, tol: float = 1e-3, degree: int = 8, most: float | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """(rows: id, x = U S; columns: id, x = V; S) of the k leading singular triplets of (i, j, w).

    Subspace iteration from a hashed start with spare vectors. A round damps what lies under the least
    value of the block by a Chebyshev polynomial of M^T M of the ``degree``, and turns the block to its
    Ritz vectors. It ends when |M^T M v - s^2 v| <= tol * s_1^2 for all k, which bounds the error of each
    s^2 by that much and, of those set apart by a gap, by its square over the gap; 'rounds' without that
    are an error, so no unsettled value is given out. Fewer than k come back where the rank is smaller.
    Where M has no fewer entries than M^T M can have, as with few terms of many texts, M^T M is worked out once,
    and no step passes over the rows of M or writes a block of them.
    most: what no s^2 is over, where that is known; else a round's polynomial has the degree 1 while the largest value still doubles.
    """
    spark, before = matrix.sparkSession, 0.0
    with Scratch(spark) as scratch:
        matrix = scratch.keep(matrix.select("i", "j", "w"), "matrix")
        ids = matrix.select(F.col("j").alias("id")).distinct()
        b = min(k + (max(8, k // 4) if spare is None else spare), ids.count())
        if not b:
            nothing = matrix.select(F.col("j").alias("id"), F.array("w").alias("x"))
            return matrix.select(F.col("i").alias("id"), F.array("w").alias("x")), nothing, []
        own, narrow = matrix, ids.count() ** 2 <= matrix.count()
        if narrow:
            own = scratch.keep(_gram_of(matrix), "gram")
        held = Scratch(spark)
        v = held.keep(_orthonormal(_drawn(ids, b, seed), b))
        for turn in range(rounds):
            with Scratch(spark) as step:
                image = _squared(own, v, step, gram=narrow)
                both = v.withColumnRenamed("x", "y").join(image, "id").select("id", F.concat("y", "x").alias("x"))
                gram = _gram(both, 2 * b)  # of v and its image: all that Rayleigh and Ritz need
                values, by = np.linalg.eigh((gram[:b, b:] + gram[b:, :b]) / 2)
                values, by = values[::-1], by[:, ::-1]
                left = np.sqrt(np.maximum(np.diag(by.T @ gram[b:, b:] @ by) - values**2, 0))
                rank = min(k, int((values > max(values[0], 0) * 1e-12).sum()))
                done = (left[:rank] <= tol * values[0] + 1e-12).all()
                if not done and turn == rounds - 1:
                    raise ValueError(f"singular vectors not settled after {rounds} rounds")
                new = Scratch(spark)
                v = new.keep(_turned(v, by[:, :rank] if done else by))
                if not done:
                    v = new.keep(_orthonormal(_damped(own, v, _turned(image, by), values, degree if most is not None or values[0] < 2 * before else 1, step, narrow, most or 0.0), b))
                before = values[0]
                held.clear()
                held = new
            if done:
                break
        out = Scratch(spark)  # these two are the result
        columns, rows = out.keep(v, "columns"), out.keep(_times(matrix, v), "rows")
        held.clear()
    return rows, columns, [float(np.sqrt(x)) for x in values[:rank]]


#: A round enlarges the leading vector over what it damps by so much at most, that the block keeps its rank in double precision.
GROWTH = 1e4


def damping(values: np.ndarray, degree: int, most: float) -> tuple[float, float, int]:
    """(half of what is damped, where the largest value lies, the degree that GROWTH allows). most: what no eigenvalue is over; a start in a large space has far smaller values."""
    half = max(values[-1], values[0] * 1e-9) / 2
    far = max(values[0], most) / half - 1
    return half, values[0] / half - 1, min(degree, max(1, int(np.log(2 * GROWTH) / np.arccosh(max(far, 1 + 1e-9)))))


def _damped(matrix: DataFrame, v: DataFrame, image: DataFrame, values: np.ndarray, degree: int, step: Scratch, gram: bool = False, most: float = 0.0) -> DataFrame:
    """A Chebyshev polynomial of M^T M times ``v``, of which ``image`` is M^T M v: under 1 up to the least of ``values``, 1 at the largest."""
    half, top, degree = damping(values, degree, most)
    first = image.select("id", F.lit(1 / (half * top)).alias("w"), "x").union(v.select("id", F.lit(-1 / top).alias("w"), "x"))
    before, now, ratio = v, step.keep(added(first)), top
    for _ in range(degree - 1):
        grown = 2 * top - 1 / ratio
        before, now = now, _squared(matrix, now, step, 2 / (half * grown), (now, -2 / grown), (before, -1 / (grown * ratio)), gram=gram)
        ratio = grown
    return now


def projected(matrix: DataFrame, columns: DataFrame) -> DataFrame:
    """(id, x): rows (i, j, w), seen or unseen, times the columns V that ``singular`` gave; rows without a known j have none."""
    return _times(matrix, columns)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(x: Column | str, least: float = 1e-8) -> Column:
    """A vector over its length, which counts as ``least`` at least."""
    x = F.col(x) if isinstance(x, str) else x
    return F.transform(x, lambda v: v / F.greatest(F.sqrt(dot(x, x)), F.lit(least)))


#: Sources and candidates that are scored at a time; digits of a score that count, so that a tie is the same however it was summed.
SOURCES, CANDIDATES, DIGITS = 512, 8192, 9
#: Pairs of a task: as many at least, unless there are fewer, and at most; numbers of one side's vectors in a task at most.
FEW, MANY, HELD = 1 << 20, 1 << 28, 1 << 22


def best_ranks(pool: DataFrame, positives: DataFrame, vectors: DataFrame, held: Scratch | None = None) -> DataFrame:
    """(source, best_rank, n_reachable) by dot products of dense vectors, without sorting candidates and without a row for a pair.

    A source's best rank is one more than the candidates that come before its first positive: those with a
    larger score, to DIGITS digits, or an equal one and a smaller id. Sources, a stated query set, and candidates
    are dealt in a grid of blocks; a task has a block of both, of whose matrix products only counts by source leave it.
    A source is no candidate of its own; NaN counts as the worst; a positive out of the pool or without a vector
    isn't reachable, and a source without a reachable one has no row. Candidates without a vector don't count.
    held: has the tables that the result reads; they stay where none is given.
    """
    held = held or Scratch(pool.sparkSession)
    known = vectors.select("id", "x")
    candidates = pool.select("id").join(known, "id")
    positives = positives.select("src", "tgt").distinct().where("src <> tgt")
    first = positives.join(candidates.withColumnsRenamed({"id": "tgt", "x": "y"}), "tgt").join(known.withColumnsRenamed({"id": "src"}), "src")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _score(_matrix(b.column("x")), _matrix(b.column("y")), True)
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("tgt"), pa.array(-s)], ["src", "tgt", "less"])

    tops = first.select("src", "tgt", "x", "y").mapInArrow(scored, "src long, tgt long, less double")
    tops = tops.groupBy("src").agg(F.min(F.struct("less", "tgt")).alias("top"), F.count("*").alias("n_reachable"))
    tops = held.keep(tops.select("src", (-F.col("top.less")).alias("top"), F.col("top.tgt").alias("tgt"), "n_reachable"), "tops")
    found = ahead(tops, candidates, known, _score)
    return found.join(tops, "src").select(F.col("src").alias("source"), (F.col("ahead") + 1).alias("best_rank"), "n_reachable")


def ahead(tops: DataFrame, candidates: DataFrame, vectors: DataFrame, score: Callable[[np.ndarray, np.ndarray, bool], np.ndarray]) -> DataFrame:
    """(src, ahead): how many candidates (id, x) come before the place (top, tgt) of each source of ``tops``: by ``score`` of both vectors, of equals by id, the source itself apart."""
    asks = tops.join(vectors.withColumnRenamed("id", "src"), "src").select("src", "top", "tgt", "x")
    candidates = candidates.select(F.col("id").alias("to"), F.col("x").alias("y"))
    number, pool = asks.count(), candidates.count()
    wide = (candidates.agg(F.max(F.size("y"))).first()[0] or 0) + 1
    rows, columns = dealt(number, pool, wide, tops.sparkSession.sparkContext.defaultParallelism)
    place = lambda seed, c, n: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asks.withColumn("i", place(1, "src", rows)).withColumn("j", each(columns)).repartition(rows * columns, "i", "j")
    c = candidates.withColumn("j", place(2, "to", columns)).withColumn("i", each(rows)).repartition(rows * columns, "i", "j")

    def counted(key: tuple[pa.Scalar, ...], own: pa.Table, others: pa.Table) -> pa.Table:
        src, tgt, top = (own.column(n).to_numpy() for n in ("src", "tgt", "top"))
        found = np.zeros(len(src), np.int64)
        if len(src) and others.num_rows:
            ids, x, y = others.column("to").to_numpy(), _matrix(own.column("x").combine_chunks()), _matrix(others.column("y").combine_chunks())
            for k in range(0, len(ids), CANDIDATES):
                to, block = ids[k : k + CANDIDATES], y[k : k + CANDIDATES]
                for m in range(0, len(src), SOURCES):
                    few = slice(m, m + SOURCES)
                    s, best = score(x[few], block, False), top[few, None]
                    found[few] += (s > best).sum(1)
                    at, of = np.nonzero(s == best)  # few, but for scores that most pairs have
                    found[few] += np.bincount(at[to[of] < tgt[few][at]], minlength=len(best))
                    at, of = _same(src[few], to)  # a source itself, where it was counted
                    own_score = s[at, of]
                    found[few][at] -= (own_score > best[at, 0]) | ((own_score == best[at, 0]) & (to[of] < tgt[few][at]))
        return pa.table({"src": pa.array(src, pa.int64()), "ahead": pa.array(found)})

    found = a.groupBy("i", "j").cogroup(c.groupBy("i", "j")).applyInArrow(counted, "src long, ahead long")
    return found.groupBy("src").agg(F.sum("ahead").alias("ahead"))


def dealt(number: int, pool: int, wide: int, cores: int) -> tuple[int, int]:
    """(rows, columns) of a grid of tasks over ``number`` sources and ``pool`` candidates of ``wide`` numbers: each source goes to all columns and each candidate
    to all rows, so blocks are as square as their bounds allow, and as few as keep the cores at work."""
    number, pool = max(number, 1), max(pool, 1)
    tasks = max(number * pool // MANY, min(number * pool // FEW, 4 * cores), 1)
    rows = max(min(round((tasks * number / pool) ** 0.5), tasks), -(-number * wide // HELD), 1)
    return rows, max(-(-tasks // rows), -(-pool * wide // HELD), 1)


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the numbers that ``a`` and ``b``, each without repeats, share."""
    _, at, of = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return at, of


def _score(x: np.ndarray, y: np.ndarray, pairwise: bool) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        s = (x * y).sum(1) if pairwise else x @ y.T
        np.round(s, DIGITS, out=s)
        s += 0.0
    if s.size and np.isnan(s.min()):
        s[np.isnan(s)] = -np.inf
    return s


def sparse_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """(src, id, score) of rows (src, term, x) and (id, term, x) with unit rows: shared terms alone are met."""
    return left.join(right.withColumnRenamed("x", "y"), "term").where("src <> id").groupBy("src", "id").agg(F.sum(F.col("x") * F.col("y")).alias("score"))


def quartiles(rows: DataFrame, by: list[str], col: str) -> DataFrame:
    """``rows`` with stratum 0 to 3 by the quartiles of ``col`` in each group; a value on a border goes up."""
    at = Window.partitionBy(*by) if by else None
    q = rows.groupBy(*by).agg(F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    joined = rows.join(F.broadcast(q), by) if at is not None else rows.crossJoin(F.broadcast(q))  # a row for each seed, or one
    return joined.withColumn("stratum", F.size(F.filter("q", lambda b: b <= F.col(col)))).drop("q")
