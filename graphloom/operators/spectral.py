"""Leading singular triplets of a graph's normalised adjacency, worked out within its parts.

The iteration is that of ``walks.singular``: the same start, polynomial and end. The block of vectors is in slices of nodes; a
product meets a part with some columns of its vectors, so all products of a round are done there and only slices are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import walks
from .parts import COLUMNS, Adjacency, packed
from .tables import Scratch

#: Nodes of a slice of the block.
SLICE = 512
SLICES, PIECES = "part long, slice int, x array<double>", "part long, slice int, c int, x array<double>"
Step = Callable[[Callable[[np.ndarray], np.ndarray], list[np.ndarray]], list[np.ndarray]]


def _ragged(xs: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([x.size for x in xs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x.ravel() for x in xs]) if xs else np.zeros(0)))


def _values(column: pa.ChunkedArray | pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy()


def _start(parts: DataFrame, b: int, seed: int) -> DataFrame:
    """The hashed start of ``walks.singular`` in slices."""
    nodes = parts.select("part", F.posexplode("ids").alias("at", "id"))
    drawn = nodes.select("part", "at", "id").join(walks._drawn(nodes.select("id"), b, seed), "id")
    rows = drawn.groupBy("part", F.floor(F.col("at") / SLICE).cast("int").alias("slice")).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("rows"))
    return rows.select("part", "slice", F.flatten(F.transform("rows", lambda r: r["x"])).alias("x"))


def _stepped(table: DataFrame, parts: DataFrame, turns: list[np.ndarray], step: Step, blocks: int = 1) -> DataFrame:
    """``step`` on blocks that lie side by side in ``table``, each first turned by its matrix: the ``blocks`` that it gives, again side by side.

    step: takes the product with the normalised adjacency, and some columns of each block, over all nodes of a part.
    """
    width, starts = turns[0].shape[1], np.cumsum([0, *(len(t) for t in turns)])
    groups = range(0, width, COLUMNS)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = _values(b.column("x"), k).reshape(-1, starts[-1])
                x = [x[:, a : a + len(t)] @ t for a, t in zip(starts, turns, strict=False)]
                part, at = (pa.array([b.column(n)[k].as_py()] * len(groups), t) for n, t in (("part", pa.int64()), ("slice", pa.int32())))
                yield pa.RecordBatch.from_arrays([part, at, pa.array(range(len(groups)), pa.int32()), _ragged([np.hstack([y[:, c : c + COLUMNS] for y in x]) for c in groups])], ["part", "slice", "c", "x"])

    def run(key: tuple[pa.Scalar, ...], own: pa.Table, part: pa.Table) -> pa.Table:
        part_id, c = (k.as_py() for k in key)
        w = min(COLUMNS, width - c * COLUMNS)
        order = np.argsort(own.column("slice").to_numpy())
        x = np.concatenate([_values(own.column("x"), int(k)).reshape(-1, w * len(turns)) for k in order])
        deg, idx = (_values(part.column(n), 0) for n in ("deg", "idx"))
        a, root = Adjacency(deg, idx), 1 / np.sqrt(deg.astype(float))[:, None]
        out = np.hstack(step(lambda y: root * a.times(root * y), [np.ascontiguousarray(x[:, k * w : (k + 1) * w]) for k in range(len(turns))]))
        cut = [out[k : k + SLICE] for k in range(0, len(out), SLICE)]
        return pa.table({"part": pa.array([part_id] * len(cut), pa.int64()), "slice": pa.array(range(len(cut)), pa.int32()), "c": pa.array([c] * len(cut), pa.int32()), "x": _ragged(cut)})

    def joined(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        part, at = (k.as_py() for k in key)
        order = np.argsort(t.column("c").to_numpy())
        flat = [_values(t.column("x"), int(k)) for k in order]
        x = np.concatenate([x.reshape(-1, blocks, min(COLUMNS, width - c)) for x, c in zip(flat, groups, strict=True)], axis=2)
        return pa.table({"part": pa.array([part], pa.int64()), "slice": pa.array([at], pa.int32()), "x": _ragged([x])})

    copies = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))).alias("c"), "deg", "idx")
    pieces = table.mapInArrow(split, PIECES).groupBy("part", "c").cogroup(copies.groupBy("part", "c")).applyInArrow(run, PIECES)
    return pieces.groupBy("part", "slice").applyInArrow(joined, SLICES)


def _gram(table: DataFrame, width: int) -> np.ndarray:
    """The width x width matrix of inner products, from one such matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            for k in range(b.num_rows):
                x = _values(b.column("x"), k).reshape(-1, width)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([1.0]), walks._lists(total.reshape(1, -1))], ["id", "w", "x"])

    return np.array(walks.added(table.mapInArrow(run, "id long, w double, x array<double>")).first()["x"]).reshape(width, width)


def _image(m: Callable, x: list[np.ndarray]) -> list[np.ndarray]:
    return [x[0], m(m(x[0]))]


def _once(m: Callable, x: list[np.ndarray]) -> list[np.ndarray]:
    return [m(x[0])]


def _damped(values: np.ndarray, degree: int) -> Step:
    """The polynomial of ``walks._damped``, of a block and its image."""
    half, top, degree = walks.damping(values, degree, 1.0)

    def step(m: Callable, x: list[np.ndarray]) -> list[np.ndarray]:
        before, now, ratio = x[0], x[1] / (half * top) - x[0] / top, top
        for _ in range(degree - 1):
            grown = 2 * top - 1 / ratio
            before, now = now, m(m(now)) * (2 / (half * grown)) - now * (2 / grown) - before / (grown * ratio)
            ratio = grown
        return [now]

    return step


def _base(gram: np.ndarray) -> np.ndarray:
    """The matrix that turns a block with these inner products to a basis of its span; directions that have vanished become zero columns."""
    size = np.diag(gram).copy()
    size = np.where(size > 0, 1 / np.sqrt(np.maximum(size, 1e-300)), 0.0)
    values, vectors = np.linalg.eigh(gram * size[:, None] * size)
    return size[:, None] * vectors * np.where(values > max(values.max(), 0) * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)


def spectral(edges: DataFrame, k: int, seed: int = 42, rounds: int = 30, tol: float = 1e-3, degree: int = 8) -> tuple[DataFrame, list[float]]:
    """(rows: id, x = U S; S) of the k leading singular triplets of ``walks.normalized_adjacency(edges)``, as ``walks.singular`` defines and ends them.

    A graph with a part over the bounds of ``parts`` is left to ``walks.singular``.
    """
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        found = packed(edges, scratch)
        if found is None:
            rows, _, values = walks.singular(walks.normalized_adjacency(edges), k, seed, rounds, tol=tol, degree=degree, most=1.0)
            return rows, values
        parts = found[1]
        b = min(k + max(8, k // 4), found[0].count())
        held = Scratch(spark)
        v = held.keep(_start(parts, b, seed), "block")
        turn = _base(_gram(v, b))
        for at in range(rounds):
            with Scratch(spark) as step:
                both = step.keep(_stepped(v, parts, [turn], _image, 2), "image")
                gram = _gram(both, 2 * b)  # of the block and its image: all that Rayleigh and Ritz need
                values, by = np.linalg.eigh((gram[:b, b:] + gram[b:, :b]) / 2)
                values, by = values[::-1], by[:, ::-1]
                left = np.sqrt(np.maximum(np.diag(by.T @ gram[b:, b:] @ by) - values**2, 0))
                rank = min(k, int((values > max(values[0], 0) * 1e-12).sum()))
                if (left[:rank] <= tol * values[0] + 1e-12).all():
                    v = Scratch(spark).keep(_named(_stepped(both.select("part", "slice", "x"), parts, [np.vstack([by[:, :rank], np.zeros((b, rank))])], _once), parts, rank), "rows")  # the result
                    held.clear()
                    return v, [float(np.sqrt(x)) for x in values[:rank]]
                if at == rounds - 1:
                    raise ValueError(f"singular vectors not settled after {rounds} rounds")
                held.clear()
                v = held.keep(_stepped(both, parts, [by, by], _damped(values, degree)), "block")
                turn = _base(_gram(v, b))
    raise AssertionError


def _named(table: DataFrame, parts: DataFrame, width: int) -> DataFrame:
    """(id, x) of the nodes of all slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(_values(b.column("own"), k)), walks._lists(_values(b.column("x"), k).reshape(-1, width))], ["id", "x"])

    own = parts.select("part", F.explode(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / SLICE).cast("int"))).alias("slice"), "ids")
    own = own.select("part", "slice", F.slice("ids", F.col("slice") * SLICE + 1, SLICE).alias("own"))
    return table.join(own, ["part", "slice"]).select("own", "x").mapInArrow(run, "id long, x array<double>")
