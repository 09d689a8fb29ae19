"""A learned scorer of pairs: a small network over structural features, fitted to rank observed edges before sampled pairs.

Most pairs of a source and a candidate are more than two steps apart and differ only in what each end has by itself. So
candidates are ranked by the network over tiles of both ends, and the pairs within two steps, which are rows, correct the count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import walks
from .encoders import Adam
from .graph import symmetric
from .tables import Scratch

#: Features of a pair: adjacency, paths of two steps, the adjacency weighted by 1/ln(degree) and 1/degree of the source, and the walk's first two steps; then those of the ends.
NEAR = ("adjacent", "paths", "adamic_adar", "resource", "walk")
ALPHA, HIDDEN, NEGATIVES = 0.15, 64, 4
Weights = list[np.ndarray]


def near_pairs(edges: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """(src, tgt, near) of the pairs within two steps on the symmetric form of ``edges``, among those asked for by ``by``: sources, or pairs."""
    both = symmetric(edges)
    deg = both.groupBy("src").agg(F.count("*").cast("double").alias("deg"))
    own = both.join(deg, "src")
    weigh = F.when(F.col("deg") > 1, 1 / F.ln(F.greatest("deg", F.lit(2.0)))).otherwise(0.0)
    zero = F.lit(0.0)
    one = own.join(asked.select(*by).distinct(), by, "left_semi").select("src", "tgt", *(x.alias(n) for n, x in zip(NEAR, (F.lit(1.0), zero, weigh, 1 / F.col("deg"), ALPHA / F.col("deg")), strict=True)))
    go = own.join(asked.select("src").distinct(), "src", "left_semi") if by == ["src"] else own.join(asked.select("src", F.col("tgt").alias("to")).distinct(), "src")
    step = go.withColumnsRenamed({"tgt": "mid", "deg": "a"}).join(own.withColumnsRenamed({"src": "mid", "deg": "b"}), "mid")
    if by != ["src"]:
        step = step.where("to = tgt")
    two = step.select("src", "tgt", *(x.alias(n) for n, x in zip(NEAR, (zero, F.lit(1.0), zero, zero, ALPHA**2 / (F.col("a") * F.col("b"))), strict=True)))
    sums = one.union(two).where("src <> tgt").groupBy("src", "tgt").agg(*(F.sum(n).alias(n) for n in NEAR))
    return sums.select("src", "tgt", F.array(*NEAR).alias("near"))


def inputs(near: np.ndarray | None, x: np.ndarray, y: np.ndarray, full: bool) -> np.ndarray:
    """Features of pairs of ends (dot-product vectors, then ln(1 + degree)) and what is near; of a grid of ends where ``near`` is None."""
    if near is None:
        dots, a, b = x[:, :-1] @ y[:, :-1].T, x[:, -1:], y[None, :, -1]
        grid = np.broadcast_arrays(np.zeros_like(dots), a, b)
        rest = [grid[0]] * (len(NEAR) if full else 1)
        return np.stack([*rest, *([dots] if full else []), grid[1], grid[2]], axis=-1)
    own = [(x[:, :-1] * y[:, :-1]).sum(1)] if full else []
    return np.column_stack([*(near if full else near[:, :1]).T, *own, x[:, -1], y[:, -1]])


def initial(width: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    sizes = [(width, HIDDEN), (HIDDEN, HIDDEN), (HIDDEN, 1)]
    return [w for a, b in sizes for w in (rng.uniform(-1, 1, (a, b)) / np.sqrt(a), np.zeros(b))]


def network(w: Weights, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scores of rows, and the layers' inputs."""
    kept = [x]
    for k in range(0, len(w), 2):
        x = x @ w[k] + w[k + 1]
        if k < len(w) - 2:
            x = np.maximum(x, 0)
        kept.append(x)
    return x[..., 0], kept


def network_back(w: Weights, kept: list[np.ndarray], d: np.ndarray) -> Weights:
    out, d = [], d[:, None]
    for k in range(len(w) - 2, -1, -2):
        out = [kept[k // 2].T @ d, d.sum(0), *out]
        d = (d @ w[k].T) * (kept[k // 2] > 0) if k else d
    return out


def _flat(w: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w])


def _like(x: np.ndarray, w: Weights) -> Weights:
    out, at = [], 0
    for y in w:
        out.append(x[at : at + y.size].reshape(y.shape))
        at += y.size
    return out


def margin_loss(w: Weights, pos: np.ndarray, neg: np.ndarray) -> tuple[float, Weights]:
    """Sum of -ln sigmoid(score of a positive - score of a negative) over rows (n, width) and (n, k, width), and its gradient."""
    n, k, width = neg.shape
    s, kept = network(w, np.concatenate([pos, neg.reshape(-1, width)]))
    gap = s[:n, None] - s[n:].reshape(n, k)
    d = -1 / (1 + np.exp(np.clip(gap, -500, 500)))
    return float(np.logaddexp(0, -gap).sum()), network_back(w, kept, np.concatenate([d.sum(1), -d.ravel()]))


class Scorer:
    """Weights, and the mean and deviation of the features that they take."""

    def __init__(self, w: Weights, mean: np.ndarray, dev: np.ndarray, full: bool):
        self.w, self.mean, self.dev, self.full = w, mean, dev, full

    def near(self, near: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.round(network(self.w, (inputs(near, x, y, self.full) - self.mean) / self.dev)[0], walks.DIGITS) + 0.0

    def grid(self, x: np.ndarray, y: np.ndarray, pairwise: bool) -> np.ndarray:
        """Scores of all pairs of two tiles that are far apart, some rows at a time; of ends that are the same once."""
        (x, a), (y, b) = _kinds(x), _kinds(y)
        step, rows = max(1, 20_000 // max(1, len(y))), []
        scale = 1 / self.dev
        w, shift = self.w[0] * scale[:, None], self.w[1] - (self.mean * scale) @ self.w[0]
        left, right = np.outer(x[:, -1], w[-2]) + shift, np.outer(y[:, -1], w[-1])
        for k in range(0, len(x), step):
            h = left[k : k + step, None] + right[None]
            if self.full:
                h += (x[k : k + step, :-1] @ y[:, :-1].T)[..., None] * w[-3]
            np.maximum(h, 0, out=h)
            h = h.reshape(-1, h.shape[-1]) @ self.w[2]
            h += self.w[3]
            np.maximum(h, 0, out=h)
            rows.append((h @ self.w[4] + self.w[5]).reshape(-1, len(y)))
        return (np.round(np.concatenate(rows), walks.DIGITS) + 0.0)[a][:, b]


def _with_ends(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    return pairs.join(ends.withColumnsRenamed({"id": "src", "x": "xs"}), "src").join(ends.withColumnsRenamed({"id": "tgt", "x": "xt"}), "tgt")


def _near_or_zero() -> Column:
    return F.coalesce("near", F.array(*([F.lit(0.0)] * len(NEAR))))


def fit(edges: DataFrame, ends: DataFrame, numbered: DataFrame, full: bool, seed: int, epochs: int = 40, rate: float = 1e-2, decay: float = 1e-5, batch: int = 4096) -> tuple[Scorer, list[float]]:
    """(scorer, losses) over ``edges`` (src, tgt) and sampled pairs that are no edges.

    ends: id, x (dot-product vectors, then ln(1 + degree)); numbered: id, at (1 to n), from which NEGATIVES targets an edge are
    drawn by hash. Batches are parts of the edges by hash; gradients are summed over tasks, and the weights, whose
    size doesn't follow the graph, are on the driver.
    """
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        both = scratch.keep(symmetric(edges), "both")
        n = numbered.count()
        draws = F.transform(F.sequence(F.lit(1), F.lit(NEGATIVES)), lambda j: F.pmod(F.xxhash64("src", "tgt", j, F.lit(seed)), F.lit(n)) + 1)
        drawn = edges.select("src", F.col("tgt").alias("of"), F.explode(draws).alias("at")).join(numbered.select("at", F.col("id").alias("tgt")), "at").drop("at").where("src <> tgt")
        drawn = drawn.join(both, ["src", "tgt"], "left_anti")
        rows = scratch.keep(edges.select("src", F.col("tgt").alias("of"), "tgt", F.lit(1).alias("y")).union(drawn.select("src", "of", "tgt", F.lit(0))), "drawn")
        near = scratch.keep(near_pairs(edges, rows, ["src", "tgt"]), "near")
        rows = _with_ends(rows.join(near, ["src", "tgt"], "left").withColumn("near", _near_or_zero()), ends)

        def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = [walks._matrix(b.column(c)) for c in ("near", "xs", "xt")]
                yield pa.RecordBatch.from_arrays([b.column("src"), b.column("of"), b.column("y"), walks._lists(inputs(*m, full))], ["src", "of", "y", "f"])

        rows = scratch.keep(rows.select("src", "of", "y", "near", "xs", "xt").mapInArrow(featured, "src long, of long, y int, f array<double>"), "features")
        width = len(rows.first()["f"])
        moments = rows.agg(*(g(F.col("f")[c]) for c in range(width) for g in (F.avg, F.stddev_pop))).first()
        mean, dev = np.array(moments[::2]), np.array(moments[1::2]) + 1e-6
        groups = rows.groupBy("src", "of").agg(F.max(F.when(F.col("y") == 1, F.col("f"))).alias("pos"), F.collect_list(F.when(F.col("y") == 0, F.col("f"))).alias("neg")).where(F.size("neg") > 0)
        groups = scratch.keep(groups.withColumn("u", F.pmod(F.xxhash64(F.lit(seed + 1), "src", "of"), F.lit(1 << 30))), "groups")
        number = groups.count()
        parts = max(1, -(-number // batch))
        w, losses = trained(groups, initial(width, seed), mean, dev, epochs, parts, Adam(rate, decay))
    return Scorer(w, mean, dev, full), losses


def _kinds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows, and which of them each row is; rows as they are where copies are few."""
    some = rows[:: max(1, len(rows) // 512)]
    if len(rows) < 256 or 2 * len(np.unique(some, axis=0)) > len(some):
        return rows, np.arange(len(rows))
    seen = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, first, which = np.unique(seen, return_index=True, return_inverse=True)
    return rows[first], which


def grouped_loss(w: Weights, kinds: np.ndarray, which: np.ndarray) -> tuple[float, Weights]:
    """``margin_loss`` of groups (a positive, then its negatives) of numbered rows ``kinds``."""
    s, kept = network(w, kinds)
    gap = s[which[:, :1]] - s[which[:, 1:]]
    d = -1 / (1 + np.exp(np.clip(gap, -500, 500)))
    each = np.hstack([d.sum(1, keepdims=True), -d])
    return float(np.logaddexp(0, -gap).sum()), network_back(w, kept, np.bincount(which.ravel(), each.ravel(), len(kinds)))


#: Files that a batch is dealt to, each read by a task.
FILES = 8


def trained(groups: DataFrame, w: Weights, mean: np.ndarray, dev: np.ndarray, epochs: int, parts: int, adam: Adam) -> tuple[Weights, list[float]]:
    """(weights, losses by epoch) after ``parts`` steps an epoch over ``groups`` (pos, neg, u), dealt by a hash of the epoch and u.

    An epoch's batches are written apart once, so that a step reads its own and not all groups.
    """
    losses = []
    for epoch in range(epochs):
        total = 0.0
        with Scratch(groups.sparkSession) as scratch:
            dealt = scratch.apart(groups.withColumn("k", F.pmod(F.xxhash64(F.lit(epoch), "u"), F.lit(parts)).cast("int")), "k", F.pmod("u", F.lit(FILES))) if parts > 1 else groups
            for k in range(parts):
                loss, pairs, g = _gradient(dealt.where(F.col("k") == k) if parts > 1 else dealt, w, mean, dev)
                total += loss
                w = _like(adam.next(_flat(w), g / max(1, pairs)), w)
        losses.append(total)
    return w, losses


def _gradient(groups: DataFrame, w: Weights, mean: np.ndarray, dev: np.ndarray) -> tuple[float, int, np.ndarray]:
    """Loss, pairs and gradient over groups of a positive and its negatives, as one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + sum(x.size for x in w))
        for b in batches:
            pos = (walks._matrix(b.column("pos")) - mean) / dev
            counts = np.diff(b.column("neg").offsets.to_numpy())
            neg = (walks._matrix(b.column("neg").flatten()) - mean) / dev if counts.sum() else np.zeros((0, len(mean)))
            starts = np.cumsum(counts) - counts
            for k in set(counts.tolist()) - {0}:  # groups of one size together
                own = np.flatnonzero(counts == k)
                rows = np.concatenate([pos[own, None], neg[starts[own][:, None] + np.arange(k)]], axis=1)
                kinds, which = _kinds(rows.reshape(-1, rows.shape[2]))
                loss, g = grouped_loss(w, kinds, which.reshape(-1, k + 1))
                total += np.concatenate([[loss, k * len(own)], _flat(g)])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([1.0]), walks._lists(total[None])], ["id", "w", "x"])

    x = np.array(walks.added(groups.select("pos", "neg").mapInArrow(run, "id long, w double, x array<double>")).first()["x"])  # of the size of the weights
    return float(x[0]), int(x[1]), x[2:]


def best_ranks(scorer: Scorer, edges: DataFrame, ends: DataFrame, pool: DataFrame, positives: DataFrame) -> DataFrame:
    """(source, best_rank, n_reachable) of ``positives`` among ``pool`` by the scorer over the observed ``edges``; ties go by id, a source is no candidate of its own."""
    spark = edges.sparkSession
    held = Scratch(spark)  # read by the result
    positives = positives.select("src", "tgt").distinct().where("src <> tgt").join(pool.withColumnRenamed("id", "tgt"), "tgt", "left_semi")
    near = near_pairs(edges, positives, ["src"]).join(pool.withColumnRenamed("id", "tgt"), "tgt", "left_semi")
    near = held.keep(near, "near")

    def scored(make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list[np.ndarray]], kept: list[str], out: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (walks._matrix(b.column(c)) for c in ("xs", "xt"))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, make(b, x, y))], [*kept, *out])

        return run

    true = lambda b, x, y: scorer.near(walks._matrix(b.column("near")), x, y)
    rows = _with_ends(positives.join(near, ["src", "tgt"], "left").withColumn("near", _near_or_zero()), ends)
    tops = rows.select("src", "tgt", "near", "xs", "xt").mapInArrow(scored(lambda b, x, y: [-true(b, x, y)], ["src", "tgt"], ["less"]), "src long, tgt long, less double")
    tops = tops.groupBy("src").agg(F.min(F.struct("less", "tgt")).alias("t"), F.count("*").alias("n_reachable"))
    tops = held.keep(tops.select("src", (-F.col("t.less")).alias("top"), F.col("t.tgt").alias("tgt"), "n_reachable"), "tops")
    far = walks.ahead(tops, pool.join(ends, "id"), ends, scorer.grid)

    def moved(b: pa.RecordBatch, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        top, first, ids = (b.column(c).to_numpy() for c in ("top", "first", "tgt"))
        is_ahead = lambda s: ((s > top) | ((s == top) & (ids < first))).astype(np.int64)
        return [is_ahead(true(b, x, y)) - is_ahead(scorer.near(np.zeros((len(x), len(NEAR))), x, y))]

    close = _with_ends(near.join(tops.select("src", "top", F.col("tgt").alias("first")), "src"), ends)
    close = close.select("src", "tgt", "near", "xs", "xt", "top", "first").mapInArrow(scored(moved, ["src"], ["more"]), "src long, more long").groupBy("src").agg(F.sum("more").alias("more"))
    out = tops.join(far, "src").join(close, "src", "left")
    return out.select(F.col("src").alias("source"), (1 + F.col("ahead") + F.coalesce("more", F.lit(0))).alias("best_rank"), "n_reachable")
