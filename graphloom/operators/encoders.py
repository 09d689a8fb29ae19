"""Graph encoders over distributed tables: message passing, edge softmax, and reverse mode by transposed joins.

Everything that a node has is a row (b, id, what, v): a block of nodes, the node, a name, and numbers. An
edge pass deals messages (frm, to, view, w) in tiles, which meet the rows of two blocks, and gives a tile's sums
by node. A node pass meets the rows of a block of nodes, a few thousand, and
does dense algebra on them. Parameters, a few matrices whose size doesn't follow the graph, are broadcast;
their gradients are summed over tasks. No task holds more of the graph than a block or a tile.

A softmax over the edges of a target is kept as (max, sum of exponentials, weighted sum) of some of its
edges; such triples merge in any order, so a hub's edges may lie in any number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch

ROWS = "b int, id long, what string, v array<double>"
#: Nodes of a block, entries of a row of gradients, least length of a vector, slope of the leaky part.
BLOCK, CHUNK, EPS, SLOPE = 2048, 4096, 1e-8, 0.2
VIEWS = ("in", "out")
#: Names of models, the convolution of each, whether it has gates and a time branch, and whether its scores have a decoder.
MODELS = {
    "gat_dir": ("gat", False, False, False),
    "gcn_dir": ("gcn", False, False, False),
    "sage_dir": ("sage", False, False, False),
    "gatv2_dir": ("gatv2", False, False, False),
    "ragat_sym": ("gat", True, False, False),
    "gat_time": ("gat", False, True, False),
    "ragat_time": ("gat", True, True, False),
    "gat_asym": ("gat", False, False, True),
    "ragat_asym": ("gat", True, False, True),
}
#: Other spellings of the same models.
ALIASES = {"rcgat_sym": "ragat_sym", "rcgat_time": "ragat_time", "rcgat_asym": "ragat_asym"}


@dataclass(frozen=True)
class Shape:
    """What a model is made of; dim: of the content vectors, desc: of the descriptors, decoder: hidden units of the pair scorer (0: none)."""

    conv: str
    dim: int
    hidden: int
    heads: int = 4
    desc: int = 13
    gated: bool = False
    timed: bool = False
    decoder: int = 0
    dropout: float = 0.0

    @property
    def attends(self) -> bool:
        return self.conv in ("gat", "gatv2")


def shape(model: str, dim: int, hidden: int, **more: object) -> Shape:
    conv, gated, timed, decoder = MODELS[ALIASES.get(model, model)]
    return replace(Shape(conv, dim, hidden, gated=gated, timed=timed, decoder=64 if decoder else 0), **more)


def sizes(s: Shape) -> dict[str, tuple[int, ...]]:
    """Names and sizes of the parameters."""
    h, k = s.hidden, s.heads
    conv = {
        "gcn": {"w": (h, h), "b": (h,)},
        "sage": {"w": (h, h), "b": (h,), "root": (h, h)},
        "gat": {"w": (h, k * h), "from": (k, h), "to": (k, h), "b": (h,)},
        "gatv2": {"wl": (h, k * h), "bl": (k * h,), "wr": (h, k * h), "br": (k * h,), "att": (k, h), "b": (h,)},
    }[s.conv]
    gate = {"gate": (s.desc,), "gate0": (1,)} if s.gated else {}
    out: dict[str, tuple[int, ...]] = {"down": (s.dim, h)}
    for layer in "12":
        for view in VIEWS:
            out |= {f"{n}{layer}.{view}": size for n, size in (conv | gate).items()}
        out |= {f"mix{layer}": (2 * h, h), f"mix0{layer}": (h,)} | ({f"time{layer}": (h,)} if s.timed else {})
    out |= {"gain": (h,), "shift": (h,), "up": (h, s.dim), "scale": (1,)}
    return out | ({"dec1": (4 * s.dim, s.decoder), "dec10": (s.decoder,), "dec2": (s.decoder,), "dec20": (1,)} if s.decoder else {})


def parameter_count(s: Shape) -> int:
    return sum(math.prod(x) for x in sizes(s).values())


Params = dict[str, np.ndarray]


def initial(s: Shape, seed: int) -> Params:
    """Orthogonal ``down``, zero ``up``, gates, time branch and decoder, so that an untrained model gives the content vectors back."""
    rng, out = np.random.default_rng(seed), {}
    for name, size in sizes(s).items():
        if name == "down":
            q = np.linalg.qr(rng.standard_normal((max(size), min(size))))[0]
            out[name] = q if size[0] >= size[1] else q.T
        elif name == "scale":
            out[name] = np.array([math.log(10.0)])
        elif name == "gain":
            out[name] = np.ones(size)
        elif len(size) == 1 or name.startswith(("up", "gate", "time", "dec")):
            out[name] = np.zeros(size)
        else:
            out[name] = rng.uniform(-1, 1, size) * math.sqrt(6 / sum(size))
    return out


def flat(p: Params, s: Shape) -> np.ndarray:
    return np.concatenate([np.asarray(p[n], float).ravel() for n in sizes(s)])


def unflat(x: np.ndarray, s: Shape) -> Params:
    out, at = {}, 0
    for n, size in sizes(s).items():
        k = math.prod(size)
        out[n], at = x[at : at + k].reshape(size), at + k
    return out


# --- dense algebra of a block of nodes or a batch of edges ---


def _kept(s: Shape, key: np.ndarray, width: int, salt: int) -> np.ndarray | float:
    """Dropout by a hash of the key, so that a task run again drops the same."""
    if not s.dropout or not salt:
        return 1.0
    u = np.uint64
    x = key.astype(u)[:, None] * u(0x9E3779B97F4A7C15) + np.arange(1, width + 1, dtype=u) * u(0xD1B54A32D192ED03) + u(salt)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> u(shift))) * u(by)
    return ((x >> u(11)).astype(float) / (1 << 53) >= s.dropout) / (1 - s.dropout)


def _leaky(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, SLOPE * x)


def _slope(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, 1.0, SLOPE)


def _heads(s: Shape, w: np.ndarray) -> np.ndarray:
    """(h, k * h) as (k, h, h)."""
    return w.reshape(s.hidden, s.heads, s.hidden).transpose(1, 0, 2)


def ends(s: Shape, p: Params, at: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """What a node sends along a message, and what a message's target needs."""
    if s.conv == "gat":
        w = _heads(s, p[f"w{at}"])
        return np.hstack([h, *(h @ (w[k] @ p[f"from{at}"][k])[:, None] for k in range(s.heads))]), np.hstack([h @ (w[k] @ p[f"to{at}"][k])[:, None] for k in range(s.heads)])
    if s.conv == "gatv2":
        return h @ p[f"wl{at}"] + p[f"bl{at}"], h @ p[f"wr{at}"] + p[f"br{at}"]
    return h, None


def ends_back(s: Shape, p: Params, at: str, h: np.ndarray, dl: np.ndarray, dr: np.ndarray | None, g: Params) -> np.ndarray:
    """The gradient for ``h`` by way of ``ends``; those of parameters are added to ``g``."""
    if s.conv == "gat":
        w, dw, dh = _heads(s, p[f"w{at}"]), np.zeros((s.heads, s.hidden, s.hidden)), dl[:, : s.hidden].copy()
        for name, ds in (("from", dl[:, s.hidden :]), ("to", dr)):
            for k in range(s.heads):
                q, dq = w[k] @ p[f"{name}{at}"][k], h.T @ ds[:, k]
                dh += ds[:, k : k + 1] * q
                dw[k] += np.outer(dq, p[f"{name}{at}"][k])
                g[f"{name}{at}"][k] += w[k].T @ dq
        g[f"w{at}"] += dw.transpose(1, 0, 2).reshape(s.hidden, -1)
        return dh
    if s.conv == "gatv2":
        r, att = dr[:, : s.heads * s.hidden], dr[:, s.heads * s.hidden :]
        for n, d in (("l", dl), ("r", r)):
            g[f"w{n}{at}"] += h.T @ d
            g[f"b{n}{at}"] += d.sum(0)
        g[f"att{at}"] += att.sum(0).reshape(s.heads, s.hidden)
        return dl @ p[f"wl{at}"].T + r @ p[f"wr{at}"].T
    return dl


def gathered(s: Shape, p: Params, at: str, a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A convolution's result from the sums of its messages; of attention, ``a`` is (n, heads * hidden)."""
    if s.conv == "gat":
        return np.einsum("nkh,kho->no", a.reshape(-1, s.heads, s.hidden), _heads(s, p[f"w{at}"])) / s.heads + p[f"b{at}"]
    if s.conv == "gatv2":
        return a.reshape(-1, s.heads, s.hidden).mean(1) + p[f"b{at}"]
    return a @ p[f"w{at}"] + p[f"b{at}"] + (h @ p[f"root{at}"] if s.conv == "sage" else 0)


def gathered_back(s: Shape, p: Params, at: str, a: np.ndarray, h: np.ndarray, du: np.ndarray, g: Params) -> tuple[np.ndarray, np.ndarray]:
    """Gradients for ``a`` and ``h``."""
    g[f"b{at}"] += du.sum(0)
    if s.conv == "gat":
        w, x = _heads(s, p[f"w{at}"]), a.reshape(-1, s.heads, s.hidden)
        g[f"w{at}"] += np.einsum("nkh,no->hko", x, du).reshape(s.hidden, -1) / s.heads
        return np.einsum("no,kho->nkh", du, w).reshape(len(a), -1) / s.heads, np.zeros_like(h)
    if s.conv == "gatv2":
        return np.tile(du / s.heads, (1, s.heads)), np.zeros_like(h)
    g[f"w{at}"] += a.T @ du
    if s.conv == "sage":
        g[f"root{at}"] += h.T @ du
        return du @ p[f"w{at}"].T, du @ p[f"root{at}"].T
    return du @ p[f"w{at}"].T, np.zeros_like(h)


@dataclass
class Nodes:
    """The rows of a block: ids in order, fixed numbers (content, descriptors, mean times of both views), and what passes have given."""

    ids: np.ndarray
    fixed: np.ndarray
    rows: dict[str, np.ndarray] = field(default_factory=dict)
    triples: dict[str, np.ndarray] = field(default_factory=dict)


def _layer(s: Shape, p: Params, n: Nodes, layer: str, h: np.ndarray, salt: int) -> tuple[np.ndarray, dict]:
    cache: dict = {}
    parts = []
    for k, view in enumerate(VIEWS):
        at = f"{layer}.{view}"
        u = gathered(s, p, at, n.rows[f"a{at}"], h)
        if s.timed:
            u = u + n.fixed[:, s.dim + s.desc + k, None] * p[f"time{layer}"]
        gate = 1 + np.tanh(n.fixed[:, s.dim : s.dim + s.desc] @ p[f"gate{at}"] + p[f"gate0{at}"])[:, None] if s.gated else 1.0
        cache[view] = (u, gate)
        parts.append(u * gate)
    cache["o"], cache["mask"] = np.hstack(parts), _kept(s, n.ids, s.hidden, salt and 2 * salt + int(layer))
    return (cache["o"] @ p[f"mix{layer}"] + p[f"mix0{layer}"]) * cache["mask"], cache


def _layer_back(s: Shape, p: Params, n: Nodes, layer: str, h: np.ndarray, cache: dict, d: np.ndarray, g: Params) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients for the sums of each view, and for ``h``."""
    d = d * cache["mask"]
    g[f"mix{layer}"] += cache["o"].T @ d
    g[f"mix0{layer}"] += d.sum(0)
    do, da, dh = d @ p[f"mix{layer}"].T, {}, np.zeros_like(h)
    for k, view in enumerate(VIEWS):
        at, (u, gate) = f"{layer}.{view}", cache[view]
        dv = do[:, k * s.hidden : (k + 1) * s.hidden]
        if s.gated:
            dt = (dv * u).sum(1) * (1 - (gate[:, 0] - 1) ** 2)
            g[f"gate{at}"] += n.fixed[:, s.dim : s.dim + s.desc].T @ dt
            g[f"gate0{at}"] += dt.sum()
            dv = dv * gate
        if s.timed:
            g[f"time{layer}"] += n.fixed[:, s.dim + s.desc + k] @ dv
        da[view], more = gathered_back(s, p, at, n.rows[f"a{at}"], h, dv, g)
        dh += more
    return da, dh


def _normal(p: Params, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Layer norm of ELU: the result, the normalised numbers and their deviation."""
    e = np.where(x > 0, x, np.expm1(np.minimum(x, 0)))
    dev = np.sqrt(e.var(1, keepdims=True) + 1e-5)
    unit = (e - e.mean(1, keepdims=True)) / dev
    return unit * p["gain"] + p["shift"], unit, dev


def _content(s: Shape, n: Nodes) -> np.ndarray:
    return n.fixed[:, : s.dim]


def _unit(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), EPS)
    return y / size, size


def begin(s: Shape, p: Params, n: Nodes, salt: int, g: Params) -> dict[str, np.ndarray]:
    return _sent(s, p, "1", _content(s, n) @ p["down"])


def _sent(s: Shape, p: Params, layer: str, h: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    for view in VIEWS:
        left, right = ends(s, p, f"{layer}.{view}", h)
        out |= {f"l{layer}.{view}": left} | ({f"r{layer}.{view}": right} if right is not None else {})
    return out


def _saved(s: Shape, n: Nodes, layer: str) -> dict[str, np.ndarray]:
    """The sums of a layer, of attention as triples again."""
    if not s.attends:
        return {f"a{layer}.{v}": n.rows[f"a{layer}.{v}"] for v in VIEWS}
    whole = lambda at: np.hstack([n.triples[at], n.rows[at] * np.repeat(n.triples[at][:, s.heads :], s.hidden, axis=1)])
    return {f"a{layer}.{v}": whole(f"a{layer}.{v}") for v in VIEWS}


def middle(s: Shape, p: Params, n: Nodes, salt: int, g: Params) -> dict[str, np.ndarray]:
    o, _ = _layer(s, p, n, "1", _content(s, n) @ p["down"], salt)
    return _sent(s, p, "2", _normal(p, o)[0]) | _saved(s, n, "1")


def finish(s: Shape, p: Params, n: Nodes, salt: int, g: Params) -> dict[str, np.ndarray]:
    h = _normal(p, _layer(s, p, n, "1", _content(s, n) @ p["down"], salt)[0])[0]
    o, _ = _layer(s, p, n, "2", h, salt)
    return {"z": _unit(_content(s, n) + o @ p["up"])[0]} | _saved(s, n, "2")


def _towards(s: Shape, p: Params, n: Nodes, layer: str, h: np.ndarray, da: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What the edges need to carry gradients back: of attention, also the target's own numbers."""
    if not s.attends:
        return {f"d{layer}.{v}": x for v, x in da.items()}
    out = {}
    for v, x in da.items():
        at = f"{layer}.{v}"
        along = (x * n.rows[f"a{at}"]).reshape(-1, s.heads, s.hidden).sum(2)
        out[f"d{at}"] = np.hstack([ends(s, p, at, h)[1], n.triples[f"a{at}"], x, along])
    return out


def finish_back(s: Shape, p: Params, n: Nodes, salt: int, g: Params) -> dict[str, np.ndarray]:
    h = _normal(p, _layer(s, p, n, "1", _content(s, n) @ p["down"], salt)[0])[0]
    o, cache = _layer(s, p, n, "2", h, salt)
    z, size = _unit(_content(s, n) + o @ p["up"])
    dz = n.rows["dz"]
    dy = (dz - z * (z * dz).sum(1, keepdims=True)) / size
    g["up"] += o.T @ dy
    da, dh = _layer_back(s, p, n, "2", h, cache, dy @ p["up"].T, g)
    return _towards(s, p, n, "2", h, da) | {"h2": dh}


def _received(s: Shape, p: Params, n: Nodes, layer: str, h: np.ndarray, g: Params) -> np.ndarray:
    dh = n.rows[f"h{layer}"].copy()
    for v in VIEWS:
        at = f"{layer}.{v}"
        dh += ends_back(s, p, at, h, n.rows[f"bl{at}"], n.rows.get(f"br{at}"), g)
    return dh


def middle_back(s: Shape, p: Params, n: Nodes, salt: int, g: Params) -> dict[str, np.ndarray]:
    h0 = _content(s, n) @ p["down"]
    o, cache = _layer(s, p, n, "1", h0, salt)
    h, unit, dev = _normal(p, o)
    dh = _received(s, p, n, "2", h, g)
    g["gain"] += (dh * unit).sum(0)
    g["shift"] += dh.sum(0)
    du = dh * p["gain"]
    de = (du - du.mean(1, keepdims=True) - unit * (du * unit).mean(1, keepdims=True)) / dev
    da, dh0 = _layer_back(s, p, n, "1", h0, cache, de * np.where(o > 0, 1.0, np.exp(np.minimum(o, 0))), g)
    return _towards(s, p, n, "1", h0, da) | {"h1": dh0}


def begin_back(s: Shape, p: Params, n: Nodes, salt: int, g: Params) -> dict[str, np.ndarray]:
    g["down"] += _content(s, n).T @ _received(s, p, n, "1", _content(s, n) @ p["down"], g)
    return {}


# --- passes of Spark ---


def _matrix(v: pa.ListArray) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _rows(ids: np.ndarray, what: str, v: np.ndarray, blocks: int | None = None) -> pa.RecordBatch:
    v = np.ascontiguousarray(v, float)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1] or 1, dtype=np.int32)), pa.array(v.ravel()))
    names = pa.array([what], pa.string()).take(pa.array(np.zeros(len(ids), np.int64)))
    b = pa.array(np.full(len(ids), -1, np.int32)) if blocks is None else pa.array(_block(ids, blocks))
    return pa.RecordBatch.from_arrays([b, pa.array(ids), names, lists], ["b", "id", "what", "v"])


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(blocks)).astype(np.int32)


def _in_order(keys: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if (keys[1:] >= keys[:-1]).all():
        return keys, v
    order = np.argsort(keys, kind="stable")
    return keys[order], v[order]


def _summed(keys: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, v = _in_order(keys, v)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(v, first, axis=0)


def _merged(keys: np.ndarray, v: np.ndarray, heads: int) -> tuple[np.ndarray, np.ndarray]:
    """Triples (max, sum, weighted sum) of each key put together."""
    keys, v = _in_order(keys, v)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    top = np.maximum.reduceat(v[:, :heads], first, axis=0)
    by = np.exp(v[:, :heads] - np.repeat(top, np.diff(first, append=len(keys)), axis=0))
    width = (v.shape[1] - 2 * heads) // heads
    parts = np.hstack([v[:, heads : 2 * heads] * by, v[:, 2 * heads :] * np.repeat(by, width, axis=1)])
    return keys[first], np.hstack([top, np.add.reduceat(parts, first, axis=0)])


@dataclass(frozen=True)
class Tables:
    """A graph to encode: fixed (b, id, v) of every node, messages (frm, to, view, w) of both views, and the number of blocks."""

    fixed: DataFrame
    messages: DataFrame
    blocks: int


def _logits(s: Shape, p: Params, at: str, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of edges: scores by head before the leaky slope is taken off, what is summed, and the slope's argument."""
    if s.conv == "gat":
        x = left[:, s.hidden :] + right
        return _leaky(x), np.tile(left[:, : s.hidden], (1, s.heads)), x
    x = (left + right).reshape(-1, s.heads, s.hidden)
    return np.einsum("nkh,kh->nk", _leaky(x), p[f"att{at}"]), left, x


def _edge_salt(s: Shape, frm: np.ndarray, to: np.ndarray, at: str, salt: int) -> np.ndarray | float:
    return _kept(s, frm * 1_000_003 + to, s.heads, salt and salt * 16 + 4 + 2 * int(at[0]) + (at[2:] == "in"))


def _forward(s: Shape, p: Params, at: str, e: dict[str, np.ndarray], salt: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    if not s.attends:
        return [(f"a{at}", *_summed(e["to"], e["left"] * e["w"][:, None]))]
    score, value, _ = _logits(s, p, at, e["left"], e["right"])
    kept = _edge_salt(s, e["frm"], e["to"], at, salt) * np.ones_like(score)
    return [(f"a{at}", *_merged(e["to"], np.hstack([score, np.ones_like(score), value * np.repeat(kept, s.hidden, axis=1)]), s.heads))]


def _backward(s: Shape, p: Params, at: str, e: dict[str, np.ndarray], salt: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    if not s.attends:
        return [(f"bl{at}", *_summed(e["frm"], e["right"] * e["w"][:, None]))]
    k, h = s.heads, s.hidden
    width = k if s.conv == "gat" else k * h
    right, top, total, da, along = np.split(e["right"], np.cumsum([width, k, k, k * h]), axis=1)
    score, value, x = _logits(s, p, at, e["left"], right)
    share, kept = np.exp(score - top) / total, _edge_salt(s, e["frm"], e["to"], at, salt)
    dshare = np.einsum("nkh,nkh->nk", da.reshape(-1, k, h), value.reshape(-1, k, h)) * kept
    dscore = share * (dshare - along)
    dvalue = np.repeat(share * kept, h, axis=1) * da
    if s.conv == "gat":
        dx = dscore * _slope(x)
        return [(f"bl{at}", *_summed(e["frm"], np.hstack([dvalue.reshape(-1, k, h).sum(1), dx]))), (f"br{at}", *_summed(e["to"], dx))]
    dx = (dscore[:, :, None] * p[f"att{at}"] * _slope(x)).reshape(len(x), -1)
    datt = (dscore[:, :, None] * _leaky(x)).reshape(len(x), -1)
    return [(f"bl{at}", *_summed(e["frm"], dvalue + dx)), (f"br{at}", *_summed(e["to"], np.hstack([dx, datt])))]


#: Blocks of nodes up to which messages go in tiles; blocks of origins and of targets of small graphs, and blocks of nodes that are one of larger graphs; messages that a step takes.
TILED, SIDES, WIDE, TAKEN = 640, {"frm": 4, "to": 8}, 32, 8192


def _met(ends: pa.Table, end: str, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a tile's rows (end, id, v): ids in order, their numbers, the place of each of ``of`` among them, and whether it is there; None without any."""
    part = ends.filter(pa.array(ends.column("end").to_numpy(zero_copy_only=False) == end))
    if not part.num_rows or not len(of):
        return None
    ids, v = part.column("id").to_numpy(), _matrix(part.column("v").combine_chunks())
    order = np.argsort(ids)
    ids = ids[order]
    place = np.minimum(np.searchsorted(ids, of), len(ids) - 1)
    return ids, v[order], place, ids[place] == of


def _edge_pass(t: Tables, rows: DataFrame, layer: str, left: str, right: str, step: Callable, s: Shape, params, salt: int) -> DataFrame:
    """Messages with the rows named ``left`` of their origin and ``right`` of their target, where named, summed by ``step``.

    Messages are dealt in tiles by view and by blocks of both ends. A tile meets each row of its two blocks once, however many messages
    it is in, and gives one sum for it; a hub's messages lie in as many tiles as there are blocks of the other end.
    """
    if t.blocks > TILED:
        return _joined_pass(t, rows, layer, left, right, step, s, params, salt)
    over = {key: max(min(t.blocks, side), t.blocks // WIDE) for key, side in SIDES.items()}
    at = lambda c, key: F.pmod(F.xxhash64(F.lit(4), c), F.lit(over[key])).cast("int")
    each = lambda key: F.explode(F.sequence(F.lit(0), F.lit(over[key] - 1)))
    tile, needed = ["view", "i", "j"], [(end, key, name) for end, key, name in (("left", "frm", left), ("right", "to", right)) if name]
    dealt = t.messages.select("view", at("frm", "frm").alias("i"), at("to", "to").alias("j"), "frm", "to", "w")
    ends = []
    for end, key, name in needed:
        own = rows.where(F.col("what").isin(*(f"{name}{layer}.{v}" for v in VIEWS))).select(F.substring_index("what", ".", -1).alias("view"), at("id", key).alias("at"), F.lit(end).alias("end"), "id", "v")
        i, j = (F.col("at"), each("to")) if key == "frm" else (each("frm"), F.col("at"))
        ends.append(own.select("view", i.alias("i"), j.alias("j"), "end", "id", "v"))
    blocks = t.blocks

    def run(key, e: pa.Table, ends: pa.Table) -> pa.Table:
        cols = {c: e.column(c).to_numpy() for c in ("frm", "to", "w")}
        met = {end: _met(ends, end, cols[key]) for end, key, _ in needed}
        if None in met.values():
            return _SCHEMA.empty_table()
        by = np.lexsort((cols["frm"], cols["to"]))
        for *_, there in met.values():
            by = by[there[by]]
        p, found = unflat(params.value, s), {}
        for k in range(0, len(by), TAKEN):
            some = by[k : k + TAKEN]
            for what, *sums in step(s, p, f"{layer}.{key[0].as_py()}", {c: x[some] for c, x in cols.items()} | {end: v[place[some]] for end, (_, v, place, _) in met.items()}, salt):
                found.setdefault(what, []).append(sums)
        out = []
        for what, sums in found.items():
            ids, v = (np.concatenate(x) for x in zip(*sums, strict=True))
            out.append(_rows(*((ids, what, v) if len(sums) == 1 else _again(s, what, ids, v)), blocks))
        return pa.Table.from_batches(out, _SCHEMA)

    return dealt.groupBy(tile).cogroup(reduce(DataFrame.union, ends).groupBy(tile)).applyInArrow(run, ROWS)


def _again(s: Shape, what: str, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, str, np.ndarray]:
    """Sums of several steps added up, those of attention merged."""
    ids, v = _merged(ids, v, s.heads) if s.attends and what.startswith("a") else _summed(ids, v)
    return ids, what, v


def _joined_pass(t: Tables, rows: DataFrame, layer: str, left: str, right: str, step: Callable, s: Shape, params, salt: int) -> DataFrame:
    """``_edge_pass`` by joins of messages with rows, summed within Arrow batches, for graphs of any size."""
    e = t.messages
    for side, key, name in (("left", "frm", left), ("right", "to", right)):
        if name:
            own = rows.where(F.col("what").isin(*(f"{name}{layer}.{v}" for v in VIEWS))).select(F.col("id").alias(key), F.substring_index("what", ".", -1).alias("view"), F.col("v").alias(side))
            e = e.join(own, [key, "view"])
    blocks = t.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unflat(params.value, s)
        for b in batches:
            views = b.column("view").to_numpy(zero_copy_only=False)
            for view in VIEWS:
                part = b.filter(pa.array(views == view))
                if part.num_rows:
                    e = {c: part.column(c).to_numpy() for c in ("frm", "to", "w")} | {c: _matrix(part.column(c)) for c in ("left", "right") if c in part.schema.names}
                    for what, ids, v in step(s, p, f"{layer}.{view}", e, salt):
                        yield _rows(ids, what, v, blocks)

    return e.mapInArrow(run, ROWS)


def _node_pass(t: Tables, rows: DataFrame | None, step: Callable, s: Shape, params, salt: int, widths: dict[str, int]) -> DataFrame:
    """``step`` on each block: rows of one name are added up, those of attention merged; a node without any has zeros."""
    blocks = t.blocks
    found = t.fixed.sparkSession.createDataFrame([], ROWS) if rows is None else rows.where(F.col("what").isin(*widths))

    def run(key, own: pa.Table, more: pa.Table) -> pa.Table:
        p = unflat(params.value, s)
        ids = own.column("id").to_numpy()
        order = np.argsort(ids)
        n = Nodes(ids[order], _matrix(own.column("v").combine_chunks())[order])
        names = more.column("what").to_numpy(zero_copy_only=False)
        for what, width in widths.items():
            part = more.filter(pa.array(names == what)).combine_chunks()
            attends = s.attends and what.startswith("a")
            value = np.zeros((len(ids), width))
            if part.num_rows:
                keys, v = part.column("id").to_numpy(), _matrix(part.column("v").combine_chunks())
                keys, v = _merged(keys, v, s.heads) if attends else _summed(keys, v)
                value[np.searchsorted(n.ids, keys)] = v
            if attends:
                k = s.heads
                n.triples[what] = np.hstack([value[:, :k], np.where(value[:, k : 2 * k] > 0, value[:, k : 2 * k], 1.0)])
                n.rows[what] = value[:, 2 * k :] / np.repeat(n.triples[what][:, k:], s.hidden, axis=1)
            else:
                n.rows[what] = value
        g = {name: np.zeros(size) for name, size in sizes(s).items()}
        out = [_rows(n.ids, what, v, blocks) for what, v in step(s, p, n, salt, g).items()]
        return pa.Table.from_batches([*out, *_gradients(flat(g, s))], _SCHEMA)

    return t.fixed.groupBy("b").cogroup(found.groupBy("b")).applyInArrow(run, ROWS)


_SCHEMA = _rows(np.zeros(0, np.int64), "", np.zeros((0, 1))).schema


def _gradients(x: np.ndarray) -> list[pa.RecordBatch]:
    """A vector of gradients in rows of CHUNK entries; none for those that are all zero."""
    return [_rows(np.array([k // CHUNK]), "g", x[None, k : k + CHUNK]) for k in range(0, len(x), CHUNK) if x[k : k + CHUNK].any()]


def _total(rows: DataFrame, what: str) -> dict[int, np.ndarray]:
    """Rows named ``what`` added up by id: gradients and losses, whose number follows the parameters and not the graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v"), strict=True):
                sums[i] = sums.get(i, 0) + v.values.to_numpy()
        for i, v in sums.items():
            yield _rows(np.array([i]), what, v[None])

    some = rows.where(F.col("what") == what).mapInArrow(run, ROWS)
    found = some.repartition("id").mapInArrow(run, ROWS).select("id", "v").toArrow()
    return {i: np.array(v) for i, v in zip(found.column("id").to_pylist(), found.column("v").to_pylist(), strict=True)}


def _widths(s: Shape, *names: str) -> dict[str, int]:
    h, k = s.hidden, s.heads
    a, left = (k * h + 2 * k if s.attends else h), {"gat": h + k, "gatv2": k * h}.get(s.conv, h)
    right = {"gat": k, "gatv2": 2 * k * h}.get(s.conv)
    each = {"a": a, "bl": left} | ({"br": right} if right else {})
    out = {}
    for name in names:
        if name in ("h1", "h2", "dz"):
            out[name] = s.dim if name == "dz" else h
        elif name[:-1] in each:
            out |= {f"{name}.{v}": each[name[:-1]] for v in VIEWS}
    return out


def _encoded(t: Tables, s: Shape, p, salt: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows with what = 'z', all rows that a gradient needs)."""
    right = "r" if s.attends else ""
    first = scratch.keep(_node_pass(t, None, begin, s, p, salt, {}))
    one = scratch.keep(_node_pass(t, _edge_pass(t, first, "1", "l", right, _forward, s, p, salt), middle, s, p, salt, _widths(s, "a1")))
    two = _edge_pass(t, one, "2", "l", right, _forward, s, p, salt).union(one.where(F.col("what").startswith("a1")))
    last = scratch.keep(_node_pass(t, two, finish, s, p, salt, _widths(s, "a1", "a2")))
    return last.where("what = 'z'"), first.union(one).union(last)


def encode(t: Tables, s: Shape, params: Params, scratch: Scratch, salt: int = 0) -> DataFrame:
    """(id, x): the encoded vector of every node, of length 1. salt: of dropout, 0 for none."""
    return _encoded(t, s, t.fixed.sparkSession.sparkContext.broadcast(flat(params, s)), salt, scratch)[0].select("id", F.col("v").alias("x"))


def pair_scores(s: Shape, p: Params, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scores of pairs of encoded vectors: a scaled cosine, and what a decoder adds."""
    out = np.exp(p["scale"][0]) * (u * v).sum(1)
    if s.decoder:
        a = np.hstack([u, v, u * v, u - v]) @ p["dec1"] + p["dec10"]
        out = out + np.where(a > 0, a, np.expm1(np.minimum(a, 0))) @ p["dec2"] + p["dec20"][0]
    return out


def _pair_back(s: Shape, p: Params, u: np.ndarray, v: np.ndarray, d: np.ndarray, g: Params) -> tuple[np.ndarray, np.ndarray]:
    scale, d = np.exp(p["scale"][0]), d[:, None]
    g["scale"] += (d[:, 0] * (u * v).sum(1)).sum() * scale
    du, dv = scale * d * v, scale * d * u
    if s.decoder:
        f = np.hstack([u, v, u * v, u - v])
        a = f @ p["dec1"] + p["dec10"]
        e = np.where(a > 0, a, np.expm1(np.minimum(a, 0)))
        g["dec2"] += (e * d).sum(0)
        g["dec20"] += d.sum()
        da = d * p["dec2"] * np.where(a > 0, 1.0, np.exp(np.minimum(a, 0)))
        g["dec1"] += f.T @ da
        g["dec10"] += da.sum(0)
        one, two, both, less = np.split(da @ p["dec1"].T, 4, axis=1)
        du, dv = du + one + both * v + less, dv + two + both * u - less
    return du, dv


#: Pairs of a tile: as many at least, unless there are fewer, and at most; pairs that are scored together.
FEW, MANY, SCORED = 65_536, 1 << 20, 8192


def _pair_pass(t: Tables, z: DataFrame, pairs: DataFrame, n: int, s: Shape, params) -> DataFrame:
    """Loss of pairs (src, tgt, y), its gradients for both ends, and for the scorer.

    Pairs are dealt in tiles by blocks of both ends. A tile meets each vector of its two blocks once, however many pairs it is in,
    and gives one row of gradients for it.
    """
    tiles = max(n // MANY, min(n // FEW, 4 * z.sparkSession.sparkContext.defaultParallelism), 1)
    side = math.isqrt(tiles - 1) + 1
    at = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.lit(side)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    dealt = pairs.select(at("src").alias("i"), at("tgt").alias("j"), "src", "tgt", "y")
    own = z.select(at("id").alias("at"), "id", "v")
    ends = own.select(F.col("at").alias("i"), each.alias("j"), F.lit("src").alias("end"), "id", "v").union(own.select(each.alias("i"), F.col("at").alias("j"), F.lit("tgt"), "id", "v"))
    blocks = t.blocks

    def run(key, e: pa.Table, ends: pa.Table) -> pa.Table:
        sides = [_met(ends, end, e.column(end).to_numpy()) for end in ("src", "tgt")]
        if None in sides:
            return _SCHEMA.empty_table()
        (src, left, a, has_a), (tgt, right, b, has_b) = sides
        y = e.column("y").to_numpy().astype(float)
        by = np.lexsort((y, b, a))
        by = by[(has_a & has_b)[by]]  # a pair with an end that has no vector counts for nothing
        p, loss = unflat(params.value, s), 0.0
        g = {name: np.zeros(size) for name, size in sizes(s).items()}
        dl, dr = np.zeros_like(left), np.zeros_like(right)
        for k in range(0, len(by), SCORED):
            some = by[k : k + SCORED]
            u, v = left[a[some]], right[b[some]]
            x = pair_scores(s, p, u, v)
            loss += (np.logaddexp(0, x) - y[some] * x).sum() / n
            for d, place, more in zip((dl, dr), (a, b), _pair_back(s, p, u, v, (1 / (1 + np.exp(-x)) - y[some]) / n, g), strict=True):
                rows, sums = _summed(place[some], more)
                d[rows] += sums
        out = [_rows(ids[met], "dz", d[met], blocks) for ids, d, place in ((src, dl, a), (tgt, dr, b)) for met in [np.unique(place[by])]]
        return pa.Table.from_batches([*out, _rows(np.array([0]), "loss", np.array([[loss]])), *_gradients(flat(g, s))], _SCHEMA)

    return dealt.groupBy("i", "j").cogroup(ends.groupBy("i", "j")).applyInArrow(run, ROWS)


def gradient(t: Tables, s: Shape, params: Params, pairs: DataFrame, salt: int = 0) -> tuple[float, np.ndarray]:
    """Mean logistic loss over ``pairs`` (src, tgt, y), and its gradient for all parameters."""
    spark = t.fixed.sparkSession
    p = spark.sparkContext.broadcast(flat(params, s))
    with Scratch(spark) as scratch:
        pairs = scratch.keep(pairs.select("src", "tgt", F.col("y").cast("double").alias("y")), "pairs")
        n = pairs.count()
        if not n:
            return 0.0, np.zeros(parameter_count(s))
        z, rows = _encoded(t, s, p, salt, scratch)
        end = scratch.keep(_pair_pass(t, z, pairs, n, s, p))
        saved, left = rows.where(F.col("what").startswith("a")), "l" if s.attends else ""
        first = rows.where(F.col("what").startswith("a1"))
        after = scratch.keep(_node_pass(t, saved.union(end), finish_back, s, p, salt, _widths(s, "a1", "a2", "dz")))
        back = _edge_pass(t, rows.union(after), "2", left, "d", _backward, s, p, salt)
        mid = scratch.keep(_node_pass(t, back.union(first).union(after.where("what = 'h2'")), middle_back, s, p, salt, _widths(s, "a1", "h2", "bl2", "br2")))
        back = _edge_pass(t, rows.union(mid), "1", left, "d", _backward, s, p, salt)
        ahead = _node_pass(t, back.union(mid.where("what = 'h1'")), begin_back, s, p, salt, _widths(s, "h1", "bl1", "br1"))
        every = end.union(after).union(mid).where("what in ('g', 'loss')").union(ahead)
        every = scratch.keep(every)
        loss = sum(float(v[0]) for v in _total(every, "loss").values())
        parts, out = _total(every, "g"), np.zeros(parameter_count(s))
        for k, v in parts.items():
            out[k * CHUNK : k * CHUNK + len(v)] += v
    p.destroy()
    return loss, out


@dataclass
class Adam:
    """The optimiser's state: of the size of the parameters."""

    rate: float = 1e-3
    decay: float = 1e-5
    m: np.ndarray | None = None
    v: np.ndarray | None = None
    step: int = 0

    def next(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g + self.decay * x
        if self.m is None or self.v is None:
            self.m, self.v = np.zeros_like(x), np.zeros_like(x)
        self.step += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return x - self.rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)


#: Epochs that each rule keeps the parameters of.
RULES = ("best_val", "last", "first", "best_val_with_init")


def train(t: Tables, s: Shape, pairs: Callable[[int], DataFrame], seed: int, epochs: int, value: Callable[[Params], float], rule: str = "best_val", patience: int = 20, every: int = 2, rate: float = 1e-3, decay: float = 1e-5) -> tuple[Params, int, list[dict]]:
    """(parameters, epoch they are of, history) of full-batch training with ``pairs`` drawn anew for each epoch.

    value: what a validation gives for parameters; it is asked at the first and each ``every``-th epoch, and
    training ends when it hasn't grown for ``patience`` times. rule: 'best_val' keeps the epoch of the
    largest value, 'best_val_with_init' lets the untrained model compete, 'first' and 'last' say themselves.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    x, adam = flat(initial(s, seed), s), Adam(rate, decay)
    start = value(unflat(x, s))
    history: list[dict] = [{"epoch": 0, "loss": None, "val": start, "scale": 10.0}]
    best, top, idle, first = (0, x.copy()), start if rule == "best_val_with_init" else -1.0, 0, x
    for epoch in range(1, epochs + 1):
        loss, g = gradient(t, s, unflat(x, s), pairs(epoch), seed * 1000 + epoch)
        x = adam.next(x, g)
        first = x.copy() if epoch == 1 else first
        row = {"epoch": epoch, "loss": loss, "val": None, "scale": float(np.exp(unflat(x, s)["scale"][0]))}
        history.append(row)
        if epoch == 1 or epoch % every == 0:
            row["val"] = value(unflat(x, s))
            if row["val"] > top + 1e-6:
                best, top, idle = (epoch, x.copy()), row["val"], 0
            else:
                idle += 1
                if idle >= patience:
                    break
    last = history[-1]["epoch"]
    epoch, kept = {"last": (last, x), "first": (min(1, last), first)}.get(rule, best)
    return unflat(kept, s), epoch, history


def tables(nodes: DataFrame, edges: DataFrame, s: Shape, count: int, times: DataFrame | None = None) -> Tables:
    """The tables of a graph for ``encode``.

    nodes: id, x (content), and desc where the shape has gates; edges: src, tgt, distinct; times: src, tgt, time,
    the number of each edge that the time branch takes the mean of. count: of nodes, for the number of blocks.
    """
    blocks = max(1, -(-count // BLOCK))
    both = edges.select(F.col("src").alias("frm"), F.col("tgt").alias("to"), F.lit("in").alias("view")).union(edges.select(F.col("tgt").alias("frm"), F.col("src").alias("to"), F.lit("out").alias("view")))
    if s.conv != "sage":
        loops = nodes.select(F.col("id").alias("frm"), F.col("id").alias("to")).crossJoin(edges.sparkSession.createDataFrame([(v,) for v in VIEWS], "view string"))
        both = both.where("frm <> to").union(loops)
    size = both.groupBy("to", "view").agg(F.count("*").cast("double").alias("k"))
    if s.conv == "gcn":
        both = both.join(size, ["to", "view"]).join(size.withColumnsRenamed({"to": "frm", "k": "j"}), ["frm", "view"])
        w = 1 / F.sqrt(F.col("k") * F.col("j"))
    elif s.conv == "sage":
        both, w = both.join(size, ["to", "view"]), 1 / F.col("k")
    else:
        w = F.lit(1.0)
    desc = F.col("desc") if s.gated else F.array_repeat(F.lit(0.0), s.desc)
    fixed = nodes.withColumn("means", F.array(F.lit(0.0), F.lit(0.0)))
    if s.timed and times is not None:
        mean = lambda end: times.groupBy(F.col(end).alias("id")).agg(F.avg("time").alias(end))
        fixed = nodes.join(mean("tgt"), "id", "left").join(mean("src"), "id", "left").withColumn("means", F.array(F.coalesce("tgt", F.lit(0.0)), F.coalesce("src", F.lit(0.0))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _rows(b.column("id").to_numpy(), "x", _matrix(b.column("v")), blocks)

    fixed = fixed.select("id", F.concat("x", desc, "means").alias("v")).mapInArrow(placed, ROWS).select("b", "id", "v")
    return Tables(fixed, both.select("frm", "to", "view", w.alias("w")), blocks)
