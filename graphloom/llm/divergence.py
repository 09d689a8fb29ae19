"""How the sources of a language differ in their terms, by distinct count vectors.

A term's sparse vector has its count in each source of the language. Terms with the same vector
add the same to every pair of sources, so a pair is evaluated once for each distinct vector and
multiplied by the number of its terms. What a source without the term adds is one constant of the
source, so only vectors that touch a pair of blocks of sources are met there. Terms themselves
come back for the ranking of what marks a source.

Texts are counted by Arrow in parts of a bounded size; the sums, vectors and ranks are joins and
aggregates of Spark. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, ship
from .textops import slices

#: Parts of a probability of 1; the count that every term has beforehand; documents a kept term is in; terms a group reports.
SCALE, PRIOR, LEAST_DOCS, TOP = 1_000_000_000, 5, 30, 50
#: Sources of a block; entries that a worker holds before it gives them out; bytes of a text split at a time; cells met at a time.
BLOCK, HELD, PIECE, CELLS = 64, 200_000, 1 << 22, 1 << 20
#: ASCII letters in lower case, bytes of other characters as they are, all else a space.
_TERMS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in parts that end at a space."""
    at = 0
    while len(text) - at > PIECE:
        to = text.find(b" ", at + PIECE)
        if to < 0:
            break
        yield text[at:to].split()
        at = to
    yield text[at:].split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the rows of a task, combined as far as HELD goes."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [*n]
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(part), np.int64)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array([t.decode() for t in part], pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for b in slices(batches):
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for tokens in _tokens(text.as_buffer().to_pybytes().translate(_TERMS)):
                n.update(tokens)
                own.update(tokens)
            docs.update(own)
            size += len(n) - before
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), in decimals, so that no count overflows."""
    wide = lambda c: c.cast("decimal(19,0)")
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + F.lit(PRIOR).cast("decimal(2,0)")), wide(total + PRIOR * kept))


def _dense(rows: pa.ListArray, zero: np.ndarray, first: int) -> np.ndarray:
    """Rows of shares of one block: those of ``rows`` (s, p) in their places, else what an absent term has."""
    out = np.tile(zero, (len(rows), 1))
    flat, ends = rows.flatten(), np.diff(rows.offsets.to_numpy())
    out[np.repeat(np.arange(len(rows)), ends), flat.field("s").to_numpy() - first] = flat.field("p").to_numpy()
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, s, t, more): what the vectors of a task add to each pair of sources beyond what an absent term would."""
    sums: dict[tuple[str, int, int], np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, i, j), m in sums.items():
            s, t = np.nonzero(m)
            names = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(s), np.int64)))
            yield pa.RecordBatch.from_arrays([names, pa.array(s + i * BLOCK), pa.array(t + j * BLOCK), pa.array(m[s, t])], ["lang", "s", "t", "more"])
        sums.clear()

    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in ("lang", "i", "j")), strict=True))
        order = sorted(range(len(keys)), key=keys.__getitem__)
        b, keys, at = b.take(pa.array(order)), [keys[k] for k in order], 0
        while at < len(keys):
            to = at
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            lang, i, j = keys[at]
            part = b.slice(at, to - at)
            zi, zj = (np.array(part.column(c)[0].as_py(), np.int64) for c in ("zi", "zj"))
            total = sums.setdefault(keys[at], np.zeros((len(zi), len(zj)), np.int64))
            rest = np.abs(zi[:, None] - zj[None, :])
            step = max(1, CELLS // rest.size)
            for k in range(0, len(part), step):
                some = part.slice(k, step)
                x, y, m = _dense(some.column("vi"), zi, i * BLOCK), _dense(some.column("vj"), zj, j * BLOCK), some.column("m").to_numpy()
                total += np.einsum("nst,n->st", np.abs(x[:, :, None] - y[:, None, :]) - rest, m)
            at = to
        if len(sums) > 500:  # of 32 kB at most
            yield from out()
    yield from out()


def counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, vector) of the terms in at least ``least`` documents of a language; vector: source, n of each source that has it."""
    ship(docs.sparkSession)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name("lang").alias("lang"), name("source").alias("source"), name("text").cast("binary").alias("text"))
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("vector"))
    return kept.where(F.col("docs") >= least).select("lang", "term", "total", "vector")


def vectors(entries: DataFrame) -> DataFrame:
    """(lang, sources, vector, m): the distinct vectors (s, p) of the terms of ``entries``, and how many terms have each."""
    rows = entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("s", "p"))).alias("vector"), F.first("sources").alias("sources"))
    return rows.groupBy("lang", "sources", "vector").agg(F.count("*").alias("m"))


def pair_sums(distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, s, t, more) with s < t: each vector meets the pairs of blocks that it touches, once."""
    block = lambda x: F.floor(x / F.lit(BLOCK)).cast("int")
    own = F.array_distinct(F.transform("vector", lambda x: block(x["s"])))
    every = F.sequence(F.lit(0), block(F.col("sources") - 1))
    pairs = F.array_distinct(F.flatten(F.transform(own, lambda i: F.transform(every, lambda j: F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))))))
    part = lambda c: F.filter("vector", lambda x: block(x["s"]) == F.col(c))
    rows = distinct.select("lang", "vector", "m", F.explode(pairs).alias("at")).select("lang", "m", "vector", "at.i", "at.j").select("lang", "i", "j", "m", part("i").alias("vi"), part("j").alias("vj"))
    zero = groups.groupBy("lang", block(F.col("s")).alias("b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "zero"))), lambda x: x["zero"]).alias("z"))
    rows = rows.join(zero.withColumnsRenamed({"b": "i", "z": "zi"}), ["lang", "i"]).join(zero.withColumnsRenamed({"b": "j", "z": "zj"}), ["lang", "j"])
    found = rows.select("lang", "i", "j", "m", "vi", "vj", "zi", "zj").mapInArrow(_compared, "lang string, s long, t long, more long")
    return found.where("s < t").groupBy("lang", "s", "t").agg(F.sum("more").alias("more"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Distances between the sources of each language of ``docs`` (text, lang, source; others are not read), and the terms that mark each.

    Null text, lang and source count as ''. Gives lang, source, part, item, value and rank: for part
    'pair' every other source of the language, by the summed differences of shares over all kept
    terms; for part 'term' the ``top`` terms whose share exceeds that of the language. Ties go by
    item in UTF-8. A group without terms still has its pairs; with no kept term all values are 0; a
    language of one source has no pair; an empty table gives an empty result. Repeated rows count each.
    The pairs of sources are the result itself, so its size is the square of the number of sources.
    """
    spark = docs.sparkSession
    kept = cut(counts(docs, least), "terms")[0]
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    exploded = kept.select("lang", "term", "total", F.explode("vector").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    sizes = exploded.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("whole"))
    groups = docs.select(name("lang"), name("source")).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "kept", "whole"])
    of = Window.partitionBy("lang")
    groups = groups.withColumn("s", F.row_number().over(of.orderBy("source")) - 1).withColumn("sources", F.count("*").over(of))
    zero = F.when(F.col("kept") > 0, share(F.lit(0), F.col("size"), F.col("kept"))).otherwise(0)
    groups = cut(groups.withColumn("zero", zero.cast("long")), "groups")[0]

    entries = exploded.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("size"), F.col("kept"))).withColumn("q", share(F.col("total"), F.col("whole"), F.col("kept")))
    entries = cut(entries.select("lang", "source", "term", "p", "q", "s", "sources"), "entries")[0]
    more = cut(pair_sums(vectors(entries), groups), "pairs")[0]
    both = more.union(more.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), "more"))
    left = groups.select("lang", "source", "s", "kept", "zero")
    right = groups.select("lang", F.col("source").alias("item"), F.col("s").alias("t"), F.col("zero").alias("other"))
    pairs = left.join(right, "lang").where("s <> t").join(both, ["lang", "s", "t"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("kept") * F.abs(F.col("zero") - F.col("other")) + F.coalesce("more", F.lit(0))).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marks = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    marks = marks.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(best)).union(marks)


#: The definition, over dense counts.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, source, sum(n) AS size FROM n GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, k.total, coalesce(size.size, 0) AS size, l.v, l.whole
          FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang
          LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
          LEFT JOIN size ON size.lang = g.lang AND size.source = g.source),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (size + 5 * v) AS BIGINT) AS p,
             CAST(1 + (1000000000 * CAST(total + 5 AS HUGEINT)) // (whole + 5 * v) AS BIGINT) AS q FROM dense),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found
QUALIFY part = 'pair' OR rank <= 50"""
