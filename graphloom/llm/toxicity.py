"""Toxic passages by maximum-scoring segments over token log-odds.

Each token backs off through its byte prefixes: the rate of a longer form has a Dirichlet prior
centred on the rate of the shorter one, down to the rate of the class. A token scores its
log-odds less Z standard errors where that is at least FLOOR, and a constant below zero elsewhere.
A linear scan finds all maximal segments (Ruzzo and Tompa); their scores are made comparable by
a fitted extreme-value tail, summed over the text, and turned into a probability by isotonic
regression on labelled documents, each scored without its own part in the counts. That is for the curve alone:
what is given out is scored by one model that sees the text and nothing else, so equal texts score the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut, numbers, ship, without
from .textops import ALNUM, U, chunks, mix, slices, words

#: Buckets of hashed features, and labelled rows that are learnt from at most (the least by CRC-32).
BUCKETS, SAMPLE = 1 << 20, 200_000
#: Lengths in bytes of the prefixes, the weight of the prior, standard errors, least score, score of other tokens.
PREFIXES, ALPHA, Z, FLOOR, OTHER = (3, 4, 6), 3.0, 2.0, 0.75, -0.5
#: Scores that count in the tail; width and number of the bins of the document statistic.
TAIL, WIDTH, BINS = FLOOR, 0.5, 80
THRESHOLD = 0.7
_SEED = (mix(np.arange(1, 2 + len(PREFIXES), dtype=U)) | U(1)).tolist()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _features(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document index of each token, and its buckets from the shortest prefix to the whole."""
    b = b" ".join(part)
    s, e, h = words(b)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in part]), s, "right")
    a, out = np.frombuffer(b + bytes(max(PREFIXES)), np.uint8), []
    code, at = np.zeros(len(s), U), 0
    for k, n in enumerate(PREFIXES):
        for j in range(at, n):
            code = code * U(257) + np.where(s + j < e, a[s + j], 0).astype(U)
        at = n
        out.append((mix(code * U(_SEED[k])) % U(BUCKETS)).astype(np.int64))
    out.append((mix(h * U(_SEED[-1])) % U(BUCKETS)).astype(np.int64))
    return doc, np.stack(out)


def _norm(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or b"").translate(ALNUM) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a feature, by bucket; bucket -1 has the documents."""
    total = np.zeros((2, BUCKETS), np.int64)
    docs = [0, 0]
    for b in slices(batches):
        toxic = b.column("toxic").to_numpy(zero_copy_only=False)
        for at, part in chunks(_norm(b)):
            doc, feats = _features(part)
            for row in feats:
                pair = np.unique(doc.astype(np.int64) * BUCKETS + row)
                y = toxic[at + pair // BUCKETS]
                for c in (0, 1):
                    np.add.at(total[c], pair[y == c] % BUCKETS, 1)
            for c in (0, 1):
                docs[c] += int((toxic[at : at + len(part)] == c).sum())
    at = np.flatnonzero(total.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[0, at], docs[0])), pa.array(np.append(total[1, at], docs[1]))], ["bucket", "clean", "toxic"])


def token_scores(feats: np.ndarray, clean: np.ndarray, toxic: np.ndarray, base: float, own: np.ndarray | None = None) -> np.ndarray:
    """Scores of tokens; own: for the curve's fit, 1 or 0 as the token's document was counted as toxic or clean, to be left out."""
    p = np.full(feats.shape[1], base)
    for row in feats:
        t, c = toxic[row], clean[row]
        if own is not None:
            t, c = np.maximum(t - (own == 1), 0), np.maximum(c - (own == 0), 0)
        p = (t + ALPHA * p) / (t + c + ALPHA)
    odds = np.log(p / (1 - p)) - np.log(base / (1 - base))
    err = np.sqrt(1 / (t + ALPHA * base) + 1 / (c + ALPHA * (1 - base)))  # pseudo-counts of the class rate: a form that one class alone has keeps a finite error
    s = odds - Z * err
    return np.where(s >= FLOOR, s, OTHER)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score); only positive scores are visited one by one."""
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    held: list[tuple[int, int, float, float]] = []  # start, end, sums before and after
    for i in np.flatnonzero(scores > 0).tolist():
        start, left, right = i, sums[i], sums[i + 1]
        k = len(held) - 1
        while True:
            while k >= 0 and held[k][2] >= left:
                k -= 1
            if k < 0 or held[k][3] >= right:
                held.append((start, i + 1, left, right))
                break
            start, left = held[k][0], held[k][2]
            del held[k:]
            k -= 1
    return [(a, b, float(r - x)) for a, b, x, r in held]


def _scan(model, fit: bool):
    """Segments of texts; with ``fit`` each without its own part in the counts, and with its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, toxic, base = model.value
        for b in slices(batches):
            n, found = [], []
            label = b.column("toxic").to_numpy() if fit else None
            for first, part in chunks(_norm(b)):
                doc, feats = _features(part)
                score = token_scores(feats, clean, toxic, base, label[first + doc] if fit else None)
                ends = np.searchsorted(doc, np.arange(1, len(part) + 1))
                at = 0
                for e in ends.tolist():
                    n.append(e - at)
                    found.append([{"start": x, "end": y, "score": s} for x, y, s in segments(score[at:e])])
                    at = e
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            name = "toxic" if fit else "doc_id"
            yield pa.RecordBatch.from_arrays([b.column(name), pa.array(n, pa.int64()), pa.array(found, kind)], [name, "n_tokens", "segments"])

    return run


def isotonic(rows: list[tuple[int, int, int]], base: float) -> list[float]:
    """Probability by bin from (bin, clean, toxic): never falling, smoothed by one prior document a bin."""
    c, t = np.zeros(BINS), np.zeros(BINS)
    for k, x, y in rows:
        c[k], t[k] = x, y
    pools: list[list[float]] = []
    for k in range(BINS):
        pools.append([t[k], t[k] + c[k], 1])
        while len(pools) > 1 and (pools[-1][1] == 0 or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return [(x + base) / (n + 1) for x, n, w in pools for _ in range(int(w))]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score the whole text of each row of ``docs`` (doc_id, text) by labels (doc_id, toxic 0/1).

    Only labels of documents that aren't held out are read. Gives doc_id, held_out, score, predicted, n_tokens and
    the segments (token positions and scores). A null or empty text has no segments, and its score
    is that of documents without any. A null doc_id isn't held out. With no labels, or none of
    a class, scores stay near the smoothed base rate. Rows are scored one by one, so repeated
    rows stay; of a document's conflicting labels the larger counts.
    """
    spark = docs.sparkSession
    ship(spark)
    key = F.col("doc_id").cast("long")
    docs = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(key.alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    sample = known.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(SAMPLE)
    sample = F.broadcast(cut(sample, "labels")[0])  # at most SAMPLE rows of two numbers
    counted = docs.join(sample, "doc_id").select("text", "toxic").mapInArrow(_count, "bucket long, clean long, toxic long")
    rows = numbers(counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))  # BUCKETS + 1 rows at most
    clean, toxic = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    own = rows["bucket"] >= 0
    number = {c: float(rows[c][~own].sum()) for c in ("clean", "toxic")}
    base = (number["toxic"] + 1) / (number["toxic"] + number["clean"] + 2)
    at = rows["bucket"][own].astype(np.int64)
    clean[at], toxic[at] = rows["clean"][own], rows["toxic"][own]
    model = spark.sparkContext.broadcast((clean, toxic, base))
    kind = "n_tokens long, segments array<struct<start:long,end:long,score:double>>"
    fit = cut(docs.join(sample, "doc_id").select("text", "toxic").mapInArrow(_scan(model, True), f"toxic int, {kind}"), "fit")[0]

    calm = fit.where("toxic = 0")
    tail = calm.select("n_tokens", F.filter("segments", lambda s: s["score"] >= TAIL).alias("s")).select(F.sum("n_tokens"), F.sum(F.size("s")), F.sum(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["score"] - TAIL))).first()
    tokens, number, over = (float(x or 0) for x in tail)
    rate = (number + 1) / (over + 1)  # of the exponential tail
    often = np.log((number + 1) / (tokens + 1000)) + rate * TAIL  # log of Karlin's K
    worth = lambda x: F.greatest(F.lit(0.0), rate * x["score"] - often - F.log(F.col("n_tokens")))
    stat = F.aggregate("segments", F.lit(0.0), lambda a, x: a + worth(x))
    bin_ = F.least(F.lit(BINS - 1), F.when(F.size("segments") == 0, 0).otherwise(1 + F.floor(stat / WIDTH)).cast("int"))
    bins = fit.groupBy(bin_.alias("bin")).agg(F.sum(1 - F.col("toxic")), F.sum("toxic")).collect()
    curve = F.array(*(F.lit(float(p)) for p in isotonic([tuple(r) for r in bins], base)))
    found = docs.mapInArrow(_scan(model, False), f"doc_id long, {kind}")
    out = found.withColumn("bin", bin_).withColumn("score", F.get(curve, F.col("bin")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_tokens", "segments")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted toxic."""
    bad = cut(toxicity(docs, labels).where("predicted = 1 and doc_id is not null").select("doc_id").distinct(), "toxic")[0]
    return without(docs, bad, "doc_id")
