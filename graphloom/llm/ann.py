"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, shifted and put in Hilbert order, several times over
with other projections and shifts. Each order is range-partitioned into tiles; a query meets
the vectors of its own tile and of the tiles next to it, keeps the nearest by exact cosine, and
the tiles' results are merged. Equal vectors are one point, carrying its least ids.

How many tiles on either side are taken is measured: the true neighbours of PROBES vectors, none of
them a query where enough others are at hand, are found by brute force, and the windows are made as
wide as it takes to hold TARGET of them. Tiles carry vectors in half precision, which choose twice
as many candidates as are asked for; scores come from the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, ship

CURVES, DIMS, DEPTH, SEED = 48, 8, 7, 11
#: Rows of a range of keys at most, and ranges of a curve at least; vectors probed, and the share of their neighbours to be held.
TILE, TILES, PROBES, TARGET = 16_384, 4, 256, 0.95
#: Tiles that a range is cut into at most, and rows of such a tile at least; tiles of a block, which one call handles; scores nearer than TIED are ties when candidates are chosen.
FINE, LEAST, BLOCK, TIED = 96, 16, 32, 1e-6


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of integer coordinates below 2**bits (after Skilling's transform)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(on, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _frames(dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Orthogonal projections and shifts of the curves, the same everywhere."""
    rng = np.random.default_rng(SEED)
    return [(np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : min(DIMS, dim)], rng.uniform(0, 0.5, min(DIMS, dim))) for _ in range(CURVES)]


def _points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Usable vectors as float64 bytes; of equal ones in a batch, the least ids."""
    for b in batches:
        rows: dict[bytes, list[int]] = {}
        for i, v in zip(b["vec_id"], b["v"], strict=True):
            if v is None or pd.isna(i):
                continue
            v = np.asarray([np.nan if y is None else y for y in v] if v.dtype == object else v, np.float64) + 0.0
            if len(v) and np.isfinite(v).all() and v.any():
                rows.setdefault(v.tobytes(), []).append(int(i))
        yield pd.DataFrame({"v": list(rows), "ids": [sorted(set(x)) for x in rows.values()]}, columns=["v", "ids"])


def _unit(vs: list[bytes]) -> np.ndarray:
    m = np.stack([np.frombuffer(v, np.float64) for v in vs])
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings the largest component under 1: no square overflows or vanishes, and no digit changes."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(-1, keepdims=True))[1])


def cosine(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    q, m = _scaled(q), _scaled(m)
    return (m @ q) / (np.sqrt((m * m).sum(1)) * np.sqrt(q @ q))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for dim in sorted(set(b.column("dim").to_pylist())):
            part = b.filter(pa.array([d == dim for d in b.column("dim").to_pylist()]))
            u = _unit(part.column("v").to_pylist())
            for c, (p, shift) in enumerate(_frames(dim)):
                x = np.clip((u @ p) * np.sqrt(dim) / 8 + 0.25 + shift, 0, 1 - 1e-9)
                key = hilbert((x * (1 << DEPTH)).astype(np.int64), DEPTH)
                n = len(key)
                yield pa.RecordBatch.from_arrays([part.column("p"), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, c, np.int32)), pa.array(key), pa.array([x.tobytes() for x in u.astype(np.float16)], pa.binary()), part.column("asks")], ["p", "dim", "curve", "key", "v", "asks"])


def _finer(tiles: int):
    """Rows of a sorted range of keys, with the tile of each: ``tiles`` stretches of equal size, numbered over all ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]  # TILE rows or so
        n, at, first = sum(b.num_rows for b in whole), 0, TaskContext.get().partitionId() * tiles
        for b in whole:
            tile = first + (at + np.arange(b.num_rows)) * tiles // n
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tile, pa.int64())], [*b.schema.names, "tile"])

    return run


def _near(k: int, wide: int):
    """Of a block of tiles: the 2 k + 2 nearest points to each query, by the point's own curve, among tiles ``wide`` away at most."""

    keep = 2 * k + 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.sort_values(["tile", "p"]).groupby(["dim", "curve"]):
            data, ask = g[~g["query"]], g[g["query"]]
            if not len(data) or not len(ask):
                continue
            d, a = (np.stack([np.frombuffer(v, np.float16).astype(np.float32) for v in x["v"]]) for x in (data, ask))
            ids, at, own, tile = data["p"].to_numpy(), data["tile"].to_numpy(), ask["p"].to_numpy(), ask["tile"].to_numpy()
            for t in np.unique(tile):
                low, high = np.searchsorted(at, [t - wide, t + wide + 1])
                some = np.flatnonzero(tile == t)
                if low == high:
                    continue
                s, last = a[some] @ d[low:high].T, min(keep, high - low) - 1
                worst = -np.partition(-s, last, axis=1)[:, last]
                for r, q in enumerate(own[some]):
                    more, tied = np.flatnonzero(s[r] >= worst[r] + TIED), np.flatnonzero(np.abs(s[r] - worst[r]) < TIED)
                    tied = tied[np.argsort(ids[low + tied], kind="stable")[:keep]]
                    for c in (more, tied):
                        out.append((np.full(len(c), q), ids[low + c], s[r, c].astype(float)))
        if not out:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "p": pd.Series(dtype="int64"), "s": pd.Series(dtype="float64")})
        return pd.DataFrame({"q": np.concatenate([x[0] for x in out]), "p": np.concatenate([x[1] for x in out]), "s": np.concatenate([x[2] for x in out])})

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = [float(cosine(np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)[None])[0]) for x, y in zip(b.column("qv").to_pylist(), b.column("pv").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("p"), pa.array(s, pa.float64())], ["q", "p", "score"])


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` nearest vectors, by cosine, to each whose vec_id is divisible by ``every``.

    vectors: vec_id and embedding; others are not read. Gives query_id, rank, vec_id, score,
    nearest first and ties to the smaller vec_id. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do null ids; vectors of other lengths aren't compared.
    An id that repeats with the same vector counts once.
    """
    spark = vectors.sparkSession
    ship(spark)
    raw = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    local = raw.mapInPandas(_points, "v binary, ids array<long>").select("v", F.explode("ids").alias("id"), F.sha1("v").alias("h"))
    # salted: the least ids of parts of a point first, then of the point
    order = lambda *by: F.row_number().over(Window.partitionBy("h", *by).orderBy("id"))
    ids = cut(local.distinct(), "ids")[0]
    least = ids.select("h", "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("r", order("salt")).where(f"r <= {k + 1}").withColumn("r", order()).where(f"r <= {k + 1}").select("h", "id")
    asks = ids.where(F.col("id") % every == 0)
    one = ids.groupBy("h").agg(F.first("v").alias("v"), F.min("id").alias("p"), F.max((F.col("id") % every == 0).cast("int")).alias("asks"))
    points = cut(one.select("p", "h", "v", "asks", (F.length("v") / 8).cast("int").alias("dim")), "points")[0]
    n = points.count()
    tiles = max(TILES, -(-n // TILE))
    keyed = points.mapInArrow(_keys, "p long, dim int, curve int, key long, v binary, asks int")
    ranges = keyed.repartitionByRange(tiles * CURVES, "dim", "curve", "key", "p").sortWithinPartitions("dim", "curve", "key", "p")
    tiled = cut(ranges.mapInArrow(_finer(min(FINE, max(1, n // (tiles * LEAST)))), "p long, dim int, curve int, key long, v binary, asks int, tile long"), "tiles")[0]

    probes = points.orderBy("asks", F.xxhash64("p"), "p").limit(PROBES).select("p", "v").collect()
    wide = _width(points, tiled, [r.p for r in probes], [r.v for r in probes], k)
    block = lambda tile: F.floor(tile / BLOCK)
    data = tiled.select(block(F.col("tile")).alias("block"), "tile", "p", "dim", "curve", "v", F.lit(False).alias("query"))
    blocks = F.sequence(block(F.col("tile") - wide), block(F.col("tile") + wide))
    query = tiled.where("asks = 1").select(F.explode(blocks).alias("block"), "tile", "p", "dim", "curve", "v", F.lit(True).alias("query"))
    near = data.union(query).groupBy("block").applyInPandas(_near(k, wide), "q long, p long, s double")
    best = near.groupBy("q", "p").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "p"))).where(f"r <= {2 * k + 2}")
    pairs = best.select("q", "p").join(points.select(F.col("p").alias("q"), F.col("v").alias("qv")), "q").join(points.select("p", F.col("v").alias("pv")), "p")
    scored = pairs.select("q", "p", "qv", "pv").mapInArrow(_exact, "q long, p long, score double")
    scored = cut(scored, "scores")[0]

    member = points.select("p", "h").join(least, "h").select("p", F.col("id").alias("vec_id"))
    asking = points.select(F.col("p").alias("q"), "h").join(asks.select("h", F.col("id").alias("query_id")), "h").select("q", "query_id")
    own = scored.join(asking, "q").join(member, "p").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def _width(points: DataFrame, tiled: DataFrame, ids: list[int], vs: list[bytes], k: int) -> int:
    """Tiles to take on either side, from the true neighbours of the probes."""
    spark = points.sparkSession
    if not ids:
        return 0
    ask = spark.sparkContext.broadcast((ids, vs))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, vs_ = b.column("p").to_numpy(), b.column("v").to_pylist()
            for dim in {len(v) for v in vs_}:
                at = [i for i, v in enumerate(vs_) if len(v) == dim]
                some = [i for i, v in enumerate(ask.value[1]) if len(v) == dim]
                if not some:
                    continue
                s = _unit([ask.value[1][i] for i in some]) @ _unit([vs_[i] for i in at]).T
                top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, : k + 1]
                for r, t in enumerate(top):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), ask.value[0][some[r]])), pa.array(own[[at[i] for i in t]]), pa.array(s[r, t])], ["q", "p", "s"])

    w = Window.partitionBy("q").orderBy(F.desc("s"), "p")
    true = points.select("p", "v").mapInArrow(brute, "q long, p long, s double").where("p <> q").withColumn("r", F.row_number().over(w)).where(f"r <= {k}").select("q", "p")
    true = cut(true, "true")[0]
    at = tiled.select("p", "curve", "tile")
    gap = true.join(at.withColumnsRenamed({"p": "q", "tile": "from"}), "q").join(at, ["p", "curve"]).groupBy("q", "p").agg(F.min(F.abs(F.col("from") - F.col("tile"))).alias("gap"))
    gaps = sorted(r.gap for r in gap.collect())  # at most PROBES * k
    return int(gaps[min(len(gaps) - 1, int(np.ceil(TARGET * len(gaps))) - 1)]) if gaps else 0
