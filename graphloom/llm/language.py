"""Language of a text by multinomial naive Bayes over hashed character n-grams.

A text is lowered, everything but letters becomes one space, and each of its 1- to 3-grams falls
into a bucket. Counts of buckets by language are summed by Spark over all documents to learn from;
the matrix of their log-probabilities is broadcast, and a batch of texts is scored at once: the
rows of the n-grams that occur are gathered and summed by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import ship
from .textops import U, mix, slices

#: Buckets of n-grams, longest n-gram, weight of the prior of a bucket.
BUCKETS, LONGEST, ALPHA = 1 << 15, 3, 0.1
#: Languages that the matrix may have: 128 kB each. More raise an error; none is dropped.
LANGUAGES = 1_000
#: Characters that are taken together, and cells that are gathered at a time.
PIECE, CELLS = 1 << 19, 1 << 21
UNKNOWN = "und"
#: Parts of a log-probability of 1: sums in whole numbers don't depend on how texts are batched.
UNITS = 1 << 20
_SALT = mix(np.arange(1, LONGEST + 1, dtype=U)) | U(1)
_letter: dict[str, np.ndarray] = {}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if "of" not in _letter:
        _letter["of"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letter["of"]


def _grams(some: list[tuple[int, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the n-grams of lowered texts, in the order of rows for each n. Inside an n-gram stand letters alone; a space may stand at either end."""
    code = np.frombuffer("".join([" ", *(t + " " for _, t in some)]).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.array([-1, *(k for k, _ in some)]), [1, *(len(t) + 1 for _, t in some)])
    letter = _letters()[code]
    kept = letter | np.concatenate(([True], letter[:-1]))  # the first of a run of others stays, as a space
    letter, row = letter[kept], row[kept]
    code = np.where(letter, code[kept], 32).astype(U)
    yield row[letter], (mix(code[letter] * _SALT[0]) % U(BUCKETS)).astype(np.int64)
    h, inside = code * _SALT[0], np.ones(len(code), bool)
    for n in range(2, LONGEST + 1):
        h = h[:-1] + code[n - 1 :] * _SALT[n - 1]
        at = letter[: len(h)] | letter[n - 1 :] if n == 2 else inside[: len(h)]
        yield np.where(letter[: len(h)], row[: len(h)], row[1 : len(h) + 1])[at], (mix(h + U(n)) % U(BUCKETS)).astype(np.int64)[at]
        inside = letter[1 : len(h)] if n == 2 else inside[: len(h) - 1] & letter[n - 1 : n - 2 + len(h)]


def _parts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``texts``, bucket) of every n-gram, in parts of about PIECE characters; a long text comes in several, cut before a character that is no letter."""
    some, size = [], 0
    for k, t in enumerate(texts):
        t = (t or "").lower()
        while len(t) > PIECE:
            to = next((c for c in range(PIECE, 0, -1) if not t[c].isalpha()), PIECE)
            yield from _grams([(k, t[:to])])
            t = t[to:]
        some.append((k, t))
        size += len(t)
        if size > PIECE:
            yield from _grams(some)
            some, size = [], 0
    if some:
        yield from _grams(some)


def _count(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: k for k, x in enumerate(names)}
        total = np.zeros(len(names) * BUCKETS, np.int64)
        for b in slices(batches):
            lang = np.array([place[x] for x in b.column("lang").to_pylist()], np.int64)
            for row, bucket in _parts(b.column("text").to_pylist()):
                np.add.at(total, lang[row] * BUCKETS + bucket, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return run


def log_likelihoods(texts: list[str | None], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the log-probabilities (buckets x languages, in whole UNITS) of each text's n-grams, and how many it has."""
    sums, number = np.zeros((len(texts), matrix.shape[1]), np.int64), np.zeros(len(texts), np.int64)
    step = max(1, CELLS // matrix.shape[1])
    for row, bucket in _parts(texts):
        for at in range(0, len(row), step):
            r = row[at : at + step]
            first = np.flatnonzero(np.diff(r, prepend=-1))
            sums[r[first]] += np.add.reduceat(matrix[bucket[at : at + step]], first, dtype=np.int64)
            number[r[first]] += np.diff(first, append=len(r))
    return sums, number


def _score(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, prior = model.value
        for b in slices(batches):
            sums, number = log_likelihoods(b.column("text").to_pylist(), matrix)
            sums += prior
            best = sums.argmax(1)  # of equals the least name
            score = 1 / np.exp((sums - sums.max(1, keepdims=True)) / UNITS).sum(1)
            known = number > 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([names[k] if x else UNKNOWN for k, x in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], ["doc_id", "lang_pred", "score"])

    return run


def language(docs: DataFrame) -> DataFrame:
    """Predict the language of the whole text of each row of ``docs`` (doc_id, text, lang; others are not read).

    Every row with a language that isn't held out is learnt from. Gives doc_id, held_out, lang_pred
    and score, the posterior of the prediction. A text that is null or has no letter is 'und' with a
    score of 0, and so is every text where there is nothing to learn from; of languages that score
    the same the least name is taken. A null doc_id isn't held out. Rows are scored one by one, so
    repeated rows stay; an empty table gives an empty result. More than LANGUAGES names are an error.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    known = rows.where(~out & F.col("lang").isNotNull())
    sizes = sorted((r[0], r[1]) for r in known.groupBy("lang").agg(F.count("*")).limit(LANGUAGES + 1).collect())
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages to learn: the matrix would not fit a worker")
    if not sizes:
        return rows.select("doc_id", out.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = [x for x, _ in sizes]
    counted = known.select("text", "lang").mapInArrow(_count(names), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows a language at most
    n = np.zeros(len(names) * BUCKETS)
    n[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    n = n.reshape(len(names), BUCKETS) + ALPHA
    size = np.array([k for _, k in sizes], float)
    fixed = lambda x, kind: np.ascontiguousarray(np.rint(x * UNITS).astype(kind))
    model = spark.sparkContext.broadcast((fixed((np.log(n) - np.log(n.sum(1, keepdims=True))).T, np.int32), fixed(np.log(size / size.sum()), np.int64)))
    found = rows.select("doc_id", "text").mapInArrow(_score(model, names), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
