"""Term weights of texts by a recipe, fitted on a window of them, and rankings by their cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G
from . import walks
from .tables import Scratch

#: Function words that a recipe leaves out unless it says otherwise.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with")


@dataclass(frozen=True)
class Recipe:
    """How texts become vectors: words by a pattern, or the 3 to 5 letters of padded words where ``letters`` is set.

    top: terms kept, by count in the fitted texts and then by name; min_df: texts that must have a
    term; sublinear: 1 + ln(count) for count; smooth: idf as if one more text had every term.
    """

    pattern: str = "[a-z][a-z0-9_+#.-]*"
    stop: tuple[str, ...] = STOP
    top: int = 20_000
    min_df: int = 1
    sublinear: bool = True
    smooth: bool = True
    letters: bool = False


def _grams(word: Column) -> Column:
    """Substrings of 3 to 5 characters of a word with a blank on either side, which has 3 at least."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.char_length(padded)
    of = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
    return F.concat(of(3), *(F.when(size >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in (4, 5)))


def terms(texts: DataFrame, recipe: Recipe) -> DataFrame:
    """(id, term, k) of ``texts`` (id, text); a text that is null or has no term has no row."""
    low = F.lower("text")
    if recipe.letters:
        words = F.filter(F.split(F.trim(F.regexp_replace(low, r"\s+", " ")), " "), lambda w: w != "")
        found = F.flatten(F.transform(words, _grams))
    else:
        found = F.regexp_extract_all(low, F.lit(recipe.pattern), F.lit(0))
        found = F.filter(found, lambda w: ~w.isin(*recipe.stop)) if recipe.stop else found
    return texts.select("id", F.explode(found).alias("term")).groupBy("id", "term").agg(F.count("*").alias("k"))


def by_text(texts: DataFrame, fit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(text, copy: its first id, n: how many texts of ``fit`` (id) are equal to it), and (id, copy) of ``texts`` (id, text): equal texts have equal terms."""
    held = texts.select("id", "text").withColumn("n", F.lit(0)) if fit is None else texts.select("id", "text").join(fit.select("id", F.lit(1).alias("n")), "id", "left").fillna(0, ["n"])
    copies = held.groupBy("text").agg(F.min("id").alias("copy"), F.sum("n").alias("n"))
    return copies, texts.select("id", "text").join(copies.select("text", "copy"), "text").select("id", "copy")


def counted(texts: DataFrame, recipe: Recipe) -> DataFrame:
    """``terms`` of ``texts`` (id, text) whose ids are all different: counted once for each distinct text, whose terms then go to its ids."""
    copies, members = by_text(texts)
    own = terms(copies.select(F.col("copy").alias("id"), "text"), recipe).groupBy(F.col("id").alias("copy")).agg(F.collect_list(F.struct("term", "k")).alias("t"))
    return members.join(own, "copy").select("id", F.inline("t"))


def fitted(texts: DataFrame, recipe: Recipe) -> DataFrame:
    """(id, term, x), rows of length 1, of ``texts`` (id, text, n), of which the fit window has n copies."""
    tf = terms(texts, recipe)
    n = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"))  # one row
    seen = tf.join(texts.where("n > 0").select("id", "n"), "id")
    vocabulary = seen.groupBy("term").agg(F.sum(F.col("k") * F.col("n")).alias("total"), F.sum("n").alias("df")).where(F.col("df") >= recipe.min_df)
    vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(recipe.top).crossJoin(F.broadcast(n))
    idf = F.ln((1 + F.col("texts")) / (1 + F.col("df"))) + 1 if recipe.smooth else F.ln(F.col("texts") / F.col("df")) + 1
    weight = (1 + F.ln("k") if recipe.sublinear else F.col("k")) * F.col("idf")
    rows = tf.join(vocabulary.select("term", idf.alias("idf")), "term").select("id", "term", weight.alias("x"))
    norm = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return rows.join(norm, "id").select("id", "term", (F.col("x") / F.col("norm")).alias("x"))


def tfidf(texts: DataFrame, fit: DataFrame, recipe: Recipe) -> DataFrame:
    """(id, term, x), rows of length 1. Vocabulary and idf come from the texts of ``fit`` (id) alone; other terms go before the norm."""
    copies, members = by_text(texts, fit)
    rows = fitted(copies.select(F.col("copy").alias("id"), "text", "n"), recipe).withColumnRenamed("id", "copy")
    return members.join(rows.groupBy("copy").agg(F.collect_list(F.struct("term", "x")).alias("t")), "copy").select("id", F.inline("t"))


def stacked(texts: DataFrame, recipes: tuple[Recipe, ...]) -> DataFrame:
    """Vectors of several recipes side by side, of ``texts`` (id, text, n): each block has length 1, and its terms a prefix of their own."""
    return reduce(DataFrame.union, (fitted(texts, r).withColumn("term", F.concat(F.lit(f"{i}:"), "term")) for i, r in enumerate(recipes)))


#: Terms whose idf goes to all tasks.
COMMON = 100_000


def document_weights(docs: DataFrame, pattern: str, common: int = COMMON) -> DataFrame:
    """(doc_id, term, x), rows of length 1, of all terms of ``docs`` (doc_id, text): 1 + ln(count) by a smoothed idf.

    Texts are dealt by document once, and counts, weights and norms stay there. The idf of the ``common`` most frequent terms
    goes to every task; rows of the others, which are few for each term, meet theirs by an exchange.
    """
    held = Scratch(docs.sparkSession)  # read by the result
    n = docs.count()
    dealt = docs.select("doc_id", "text").repartition("doc_id")
    tf = dealt.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("term")).groupBy("doc_id", "term").agg((1 + F.ln(F.count("*"))).alias("tf"))
    df = held.keep(tf.groupBy("term").agg(F.count("*").alias("df")), "df")
    idf = (F.ln(F.lit(1 + n) / (1 + F.col("df"))) + 1).alias("idf")
    if df.count() <= common:
        rows = tf.join(F.broadcast(df.select("term", idf)), "term")
    else:
        first = held.keep(df.orderBy(F.desc("df"), "term").limit(common).select("term", idf), "common")
        rest = df.join(first, "term", "left_anti").select("term", idf)
        rows = tf.join(F.broadcast(first), "term")
        rows = rows.unionByName(tf.join(F.broadcast(first.select("term")), "term", "left_anti").join(rest, "term"))
    x = rows.select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("x"))
    return x.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id"))))


#: Ids of one text that go together; texts of a tile; terms that are dense at a time.
IDS, TILE, WIDE = 1024, 1024, 2048


def content_best(graph: G.Graph, win: DataFrame, texts: DataFrame, recipes: tuple[Recipe, ...], stage: str = "test", whole: bool = False) -> DataFrame:
    """(source, best_rank, rr, n_reachable) of a stage's edges by the cosine of texts, among nodes outside the test window (whole: among all) but the source.

    Sources are a stated query set. A source's edges that the fit window has are no positives. A best rank is one more than the
    candidates before the first positive. Equal texts have equal scores, so distinct texts are compared, in tiles, and what is
    counted are their copies; ids matter where a score equals that of the positive. Nodes without terms score 0.
    """
    pool = (win if whole else win.where("win <> 'test'")).select("id")
    held = graph.edges.join(win.select(F.col("id").alias("src"), "win"), "src")
    positives = held.where(F.col("win") == stage).select("src", "tgt").join(held.where("win = 'fit'"), ["src", "tgt"], "left_anti")
    spark = win.sparkSession
    with Scratch(spark) as scratch:
        copies, members = by_text(texts, win.where("win = 'fit'").select("id"))
        rows = scratch.keep(stacked(scratch.keep(copies.select(F.col("copy").alias("id"), "text", "n"), "copies"), recipes), "weights")
        codes = rows.select("term").distinct().withColumn("code", F.row_number().over(Window.orderBy("term")))  # recipe.top terms of each recipe at most
        vector = F.array_sort(F.collect_list(F.struct("code", "x")))
        vectors = rows.join(F.broadcast(codes), "term").groupBy(F.col("id").alias("copy")).agg(vector.alias("v"))
        vectors = scratch.keep(vectors.select("copy", F.col("v.code").alias("codes"), F.col("v.x").alias("x")), "vectors")
        members = scratch.keep(win.select("id").join(members, "id", "left").join(vectors.select("copy", F.lit(True).alias("known")), "copy", "left").select("id", F.when(F.col("known"), F.col("copy")).alias("copy")), "members")
        candidates = scratch.keep(pool.join(members, "id").select("id", "copy"), "candidates")
        # the first positive of each source
        of = lambda n, copy: members.select(F.col("id").alias(n), F.col("copy").alias(copy))
        pos = scratch.keep(positives.where("src <> tgt").join(pool.withColumnRenamed("id", "tgt"), "tgt", "left_semi").join(of("src", "a"), "src").join(of("tgt", "c"), "tgt").select("src", "tgt", "a", "c"), "positives")
        side = lambda n: vectors.select(F.col("copy").alias(n), F.col("codes").alias(f"{n}_codes"), F.col("x").alias(f"{n}_x"))
        scores = pos.select("a", "c").distinct().join(side("a"), "a").join(side("c"), "c").mapInArrow(_scored, "a long, c long, score double")
        tops = pos.join(scores, ["a", "c"], "left").withColumn("less", -F.coalesce("score", F.lit(0.0)))
        tops = tops.groupBy("src", "a").agg(F.min(F.struct("less", "tgt")).alias("top"), F.count("*").alias("n_reachable"))
        tops = scratch.keep(tops.select("src", F.col("a").alias("copy"), (-F.col("top.less")).alias("top"), F.col("top.tgt").alias("tgt"), "n_reachable"), "tops")
        a, c = (_tiles(rows, vectors, n, row, scratch) for n, rows, row in (("a", tops, F.struct("src", "top", "tgt")), ("c", candidates.withColumnRenamed("id", "src"), F.struct("src"))))
        pairs = a.crossJoin(c).repartition(max(1, min(10_000, a.count() * c.count())), F.xxhash64("a_tile", "c_tile"))  # of tiles: a query set against all, in blocks
        ahead = pairs.select("a", "c").mapInArrow(_ahead, "src long, ahead long").groupBy("src").agg(F.sum("ahead").alias("ahead"))
        # a source is no candidate of its own
        own = F.round(F.coalesce(walks.dot("x", "x"), F.lit(0.0)), walks.DIGITS)
        first = (own > F.col("top")) | ((own == F.col("top")) & (F.col("src") < F.col("tgt")))
        best = tops.join(ahead, "src").join(vectors.select("copy", "x"), "copy", "left").join(pool.select(F.col("id").alias("src"), F.lit(True).alias("own")), "src", "left")
        best = best.select(F.col("src").alias("source"), (F.col("ahead") + 1 - (F.coalesce("own", F.lit(False)) & first).cast("long")).alias("best_rank"), "n_reachable")
        return Scratch(spark).keep(best.select("source", "best_rank", F.round(1.0 / F.col("best_rank"), 9).alias("rr"), "n_reachable"), "floor")


def _tiles(rows: DataFrame, vectors: DataFrame, name: str, row: Column, scratch: Scratch) -> DataFrame:
    """(name_tile, name: texts as codes, x and at most about IDS of the rows (src, copy, ...) that have them), TILE texts or parts of such in a tile."""
    bins = rows.groupBy(F.col("copy").alias("of")).agg(F.ceil(F.count("*") / IDS).alias("bins"))
    binned = rows.join(bins, F.col("copy").eqNullSafe(F.col("of"))).select("copy", F.pmod(F.xxhash64("src"), "bins").alias("bin"), row.alias("row"))
    items = binned.groupBy("copy", "bin").agg(F.sort_array(F.collect_list("row")).alias("rows")).join(vectors, "copy", "left")
    items = scratch.keep(items.select("copy", "bin", F.struct(F.coalesce("codes", F.array().cast("array<int>")).alias("codes"), F.coalesce("x", F.array().cast("array<double>")).alias("x"), "rows").alias("item")), "items")
    tile = F.pmod(F.xxhash64("copy", "bin"), F.lit(max(1, -(-items.count() // TILE))))
    return scratch.keep(items.groupBy(tile.alias(f"{name}_tile")).agg(F.collect_list("item").alias(name)), "tiles")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists, and the number of the list that each is from."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The score of each pair (a, c) of sparse vectors: entries meet by row and code."""
    for b in batches:
        (ca, ra), (cc, rc) = _flat(b.column("a_codes")), _flat(b.column("c_codes"))
        ka, kc = ra << 32 | ca, rc << 32 | cc
        _, i, j = np.intersect1d(ka, kc, assume_unique=True, return_indices=True)
        product = b.column("a_x").flatten().to_numpy()[i] * b.column("c_x").flatten().to_numpy()[j]
        score = np.round(np.bincount(ra[i], product, b.num_rows), walks.DIGITS) + 0.0
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("c"), pa.array(score)], ["a", "c", "score"])


def _product(a: pa.StructArray, c: pa.StructArray) -> np.ndarray:
    """Scores of the texts of two tiles, some terms at a time."""
    (ca, ra), (cc, rc) = _flat(a.field("codes")), _flat(c.field("codes"))
    xa, xc = (t.field("x").flatten().to_numpy() for t in (a, c))
    out, both = np.zeros((len(a), len(c))), np.intersect1d(ca, cc)
    for k in range(0, len(both), WIDE):
        some, dense = both[k : k + WIDE], []
        for codes, rows, x, n in ((ca, ra, xa, len(a)), (cc, rc, xc, len(c))):
            at = np.minimum(np.searchsorted(some, codes), len(some) - 1)
            on = some[at] == codes
            dense.append(np.zeros((n, len(some))))
            dense[-1][rows[on], at[on]] = x[on]
        out += dense[0] @ dense[1].T
    return np.round(out, walks.DIGITS) + 0.0


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, ahead): candidates of a tile that come before the first positive of each source of another."""
    for b in batches:
        for k in range(b.num_rows):
            a, c = b.column("a")[k].values, b.column("c")[k].values
            score, lists = _product(a, c), c.field("rows")
            ids, sizes = lists.flatten().field("src").to_numpy(), lists.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            sources = a.field("rows").flatten()
            src, top, tgt = (sources.field(n).to_numpy() for n in ("src", "top", "tgt"))
            found = np.zeros(len(src), np.int64)
            by_id = np.argsort(ids, kind="stable")
            sorted_ids, text_of = ids[by_id], np.repeat(np.arange(len(sizes)), sizes)[by_id]
            starts = np.concatenate(([0], np.cumsum(a.field("rows").value_lengths().to_numpy())))
            for i in range(len(a)):
                own = slice(starts[i], starts[i + 1])
                order = np.argsort(-score[i], kind="stable")
                down, before = -score[i][order], np.concatenate(([0], np.cumsum(sizes[order])))
                first, last = np.searchsorted(down, -top[own], "left"), np.searchsorted(down, -top[own], "right")
                found[own] = before[first]
                for s in np.flatnonzero(last > first):
                    equal, t = order[first[s] : last[s]], tgt[own][s]
                    if len(equal) > 8:
                        on = np.zeros(len(sizes), bool)
                        on[equal] = True
                        found[starts[i] + s] += on[text_of[: np.searchsorted(sorted_ids, t)]].sum()
                    else:
                        found[starts[i] + s] += sum(np.searchsorted(ids[ends[e] - sizes[e] : ends[e]], t) for e in equal)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(found)], ["src", "ahead"])
