"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment.

Texts are reduced to their letters and digits in lower case, so that spacing and punctuation
don't count. An item is cut into windows of at most WINDOW characters that overlap by half, which
find it as a whole with its edits, and into windows of PASSAGE characters every STRIDE, so that every
copied passage of PASSAGE + STRIDE - 1 of its letters holds a whole window. A
region within e edits of a window of m characters shares at least m + 1 - q (e + 1) of its
q-grams with it, on diagonals that lie within e of each other, so shared q-grams are counted in
overlapping bands of diagonals; bands that reach the bound are aligned within the band, and
kept if the distance is within the budget. A diagonal that holds all q-grams of a window needs no alignment.

Items of fewer than Q letters are found where they stand as they are between other characters than letters.
Texts are looked at in stretches that share at most HITS q-grams with the benchmark, so that memory is bounded.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, ship, without
from .textops import U, mix, slices

Q, WINDOW, RATE = 12, 160, 0.05
#: Letters of the short windows, and between their starts: a passage of 79 letters of an item is always found.
PASSAGE, STRIDE = 60, 20
#: Characters of benchmark text held at a time; a larger benchmark takes more passes over the documents.
BLOCK = 4_000_000
#: Characters of documents looked at together.
PIECE = 1 << 20
#: Shared q-grams that are counted together, and letters by which stretches overlap: more than any region has.
HITS, OVERLAP = 1 << 20, 2 * WINDOW
BITS = 22
_table: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code of each character: 0 for no letter or digit, else its lower-case form."""
    if not _table:
        t = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(0x20000):
            x = chr(c)
            if unicodedata.category(x)[0] in "LMN":
                t[c] = ord(low) if len(low := x.lower()) == 1 else c
        t[0x20000:] = np.arange(0x20000, sys.maxunicode + 1)
        _table.append(t)
    return _table[0]


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters and digits of ``text``, and where they stand in it."""
    c = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    at = np.flatnonzero(c)
    return c[at], at


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    if len(c) < q:
        return np.zeros(0, U)
    h, n = np.zeros(len(c) - q + 1, U), len(c) - q + 1
    for j in range(q):
        h = h * U(0x2545F4914F6CDD1D) + c[j : j + n]
    return h * U(0x9E3779B97F4A7C15)


class Index:
    """Windows of items and the sorted table of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.codes, self.budget, self.short = [], [], [], {}
        g, w, p, known = [], [], [], {}
        for item, text in items:
            c, _ = letters(text or "")
            if 0 < len(c) < Q:
                self.short.setdefault(len(c), {}).setdefault(c.tobytes(), []).append(item)
                continue
            places = {(start, min(len(c), start + size)) for size, step in ((WINDOW, WINDOW // 2), (PASSAGE, STRIDE)) for start in [*range(0, len(c) - size, step), max(0, len(c) - size)]}
            for start, end in sorted(places):
                part = c[start:end]
                if len(part) < Q:
                    continue
                same = known.setdefault(part.tobytes(), len(self.items))
                if same < len(self.items):  # equal windows are one
                    if self.items[same][-1] != item:
                        self.items[same].append(item)
                    continue
                e = int(RATE * len(part))
                while e and len(part) + 1 - Q * (e + 1) < 1:
                    e -= 1
                k = grams(part)
                g.append(k)
                w.append(np.full(len(k), len(self.items)))
                p.append(np.arange(len(k)))
                self.items.append([item])
                self.codes.append(part)
                self.budget.append(e)
        empty = [np.zeros(0, np.int64)]
        g = np.concatenate(g or [np.zeros(0, U)])
        order = np.argsort(g, kind="stable")
        self.grams, self.window, self.at = g[order], np.concatenate(w or empty)[order], np.concatenate(p or empty)[order]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.grams >> U(64 - BITS)).astype(np.int64)] = True
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array(self.budget, np.int64)
        self.need = np.maximum(1, self.length + 1 - Q * (self.edits + 1))

    def postings(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``g`` of q-grams that the windows have, and where their rows begin and how many there are."""
        at = np.flatnonzero(self.seen[(g >> U(64 - BITS)).astype(np.int64)])
        lo = np.searchsorted(self.grams, g[at], "left")
        n = np.searchsorted(self.grams, g[at], "right") - lo
        return at[n > 0], lo[n > 0], n[n > 0]

    def find(self, c: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(window, start, end, edits) of the verified regions of ``c``; those of one window don't overlap."""
        place, lo, n = self.postings(grams(c))
        total, out, best, i = np.concatenate(([0], np.cumsum(n))), [], {}, 0
        while i < len(place):
            k = int(np.searchsorted(total, total[i] + HITS, "right"))
            k = max(min(k, len(place)), int(np.searchsorted(place, place[i] + 2 * OVERLAP)))
            self._stretch(c, place[i:k], lo[i:k], n[i:k], best, out)
            i = k if k == len(place) else int(np.searchsorted(place, place[k] - OVERLAP))
        return out

    def _stretch(self, c: np.ndarray, place: np.ndarray, lo: np.ndarray, n: np.ndarray, best: dict[int, int], out: list[tuple[int, int, int, int]]) -> None:
        """Regions by the q-grams at ``place``; best: where the last region of each window ends."""
        k = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        win = self.window[k]
        diagonal = np.repeat(place, n) - self.at[k] + self.length[win]  # not below zero
        whole, count = np.unique(win << 40 | diagonal, return_counts=True)
        whole = whole[count == self.length[whole >> 40] - Q + 1]  # on these diagonals the window stands as it is
        base = diagonal // (self.edits[win] + 1)  # bands of twice this width, each half overlapping the next
        bands, count = np.unique(np.concatenate((win << 40 | base, (win << 40 | base)[base > 0] - 1)), return_counts=True)
        own = bands >> 40
        good = count >= self.need[own]
        for w, b in zip(own[good].tolist(), (bands[good] & (1 << 40) - 1).tolist(), strict=True):
            size, e = int(self.length[w]), int(self.edits[w])
            d = b * (e + 1) - size
            if best.get(w, -(1 << 60)) > d + e:  # inside a region found already
                continue
            j = int(np.searchsorted(whole, w << 40 | d + size))
            if j < len(whole) and whole[j] < (w << 40 | d + size + 2 * (e + 1)):
                start = int(whole[j] & (1 << 40) - 1) - size
                got = (start, start + size, 0)
            else:
                at, reach = max(0, d), size + 2 * e + 2
                got = align(self.codes[w], c[at : at + reach], e, d - at)
                got = got and (at + got[0], at + got[1], got[2])
            if got and got[0] >= best.get(w, 0) - e:
                out.append((w, *got))
                best[w] = got[1]

    def small(self, c: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of the items of fewer than Q letters, between characters that are none."""
        out = []
        opens = np.concatenate(([True], at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool)
        for q, held in self.short.items():
            known = np.array([grams(np.frombuffer(x, c.dtype), q)[0] for x in held], U)
            for i in np.flatnonzero(np.isin(grams(c, q), known)).tolist():
                if opens[i] and (i + q == len(c) or opens[i + q]):
                    out += [(item, i, i + q) for item in held.get(c[i : i + q].tobytes(), ())]
        return out


def align(a: np.ndarray, b: np.ndarray, e: int, shift: int = 0) -> tuple[int, int, int] | None:
    """Best place (start, end, edits) of the whole of ``a`` in ``b`` within ``e`` edits, or None.

    Starts are the diagonals from ``shift`` to ``shift + 2 e + 2``; cells further than e from them aren't computed.
    """
    n, m, lo = len(a), len(b), shift - e
    span = 4 * e + 4
    far = n + m + 1
    j = lo + np.arange(span)  # column in b of each cell of a row of the band
    cost = np.where((j >= 0) & (j <= m), 0, far)
    start = j.copy()
    step = np.arange(span)
    for i in range(n):
        col = lo + i + 1 + step  # the cell's end in b after taking a[i]
        ok = (col >= 1) & (col <= m)
        same = np.zeros(span, bool)
        same[ok] = b[col[ok] - 1] == a[i]
        diag = np.where(ok, cost + ~same, far)
        up = np.append(cost[1:] + 1, far)  # a[i] left out
        up[(col < 0) | (col > m)] = far
        new, from_ = np.where(up < diag, up, diag), np.where(up < diag, np.append(start[1:], 0), start)
        run = np.minimum.accumulate(new - step)  # characters of b left out
        src = np.maximum.accumulate(np.where(new - step == run, step, 0))
        cost = np.where(col <= m, run + step, far)
        start = from_[src]
    k = int(np.argmin(cost))
    return (int(start[k]), int(lo + n + k), int(cost[k])) if cost[k] <= e else None


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for b in slices(batches):
            rows = []
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            k = 0
            while k < len(texts):
                start, size = k, 0
                while k < len(texts) and (k == start or size + len(texts[k] or "") <= PIECE):
                    size += len(texts[k] or "")
                    k += 1
                part = [letters(t or "") for t in texts[start:k]]
                ends = np.cumsum([len(c) for c, _ in part])
                place, _, n = x.postings(grams(np.concatenate([c for c, _ in part])))
                touched = np.bincount(np.searchsorted(ends, place, "right"), n, len(part))[: len(part)] if len(place) else np.zeros(len(part))
                for i in np.flatnonzero(touched >= (x.need.min() if len(x.need) else 1)).tolist():
                    c, at = part[i]
                    rows += [(ids[start + i], item, int(at[s]), int(at[max(s, e - 1)]) + 1, d) for w, s, e, d in x.find(c) if e > s for item in x.items[w]]
                if x.short:
                    rows += [(ids[start + i], item, int(at[s]), int(at[e - 1]) + 1, 0) for i, (c, at) in enumerate(part) for item, s, e in x.small(c, at)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in cols], ["doc_id", "item_id", "start", "end", "edits"])

    return run


def benchmark_regions(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Regions of ``docs`` (doc_id, text) that hold windows of ``benchmark`` (item_id, text) within RATE edits.

    Gives doc_id, item_id, start, end (code points of the text) and edits, a row for each region
    and window, or item of fewer than Q letters. Null or empty texts hold nothing, nor does an
    empty benchmark find anything; null ids stay null; repeated rows repeat their regions.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, out = total // BLOCK + 1, None
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        index = spark.sparkContext.broadcast(Index(sorted(((r.item_id, r.text) for r in some), key=str)))
        found = docs.mapInArrow(_search(index), "doc_id long, item_id long, start long, end long, edits long")
        out = found if out is None else out.union(found)
    return out


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item: windows found, the span they cover and the least edits."""
    g = benchmark_regions(docs, benchmark).groupBy("doc_id", "item_id")
    return g.agg(F.count("*").alias("n_regions"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    bad = cut(benchmark_regions(docs, benchmark).where("doc_id is not null").select("doc_id").distinct(), "leaks")[0]
    return without(docs, bad, "doc_id")
