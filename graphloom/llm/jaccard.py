"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles are put into bands of nearly equal size, in which similar sets differ in k
elements at most. The hash domain is divided into n1 ranges and each of these into n2 parts. Some
ranges have at most k2 of the differences, and there n2 - k2 parts agree wholly: what a set has in such a
subset of the parts of a range, hashed, is a signature, and all these subsets are enumerated. A set
signs for its own band and for a larger one in which it can have a partner. n1 is larger by ``spare`` than it
need be, so similar sets have more than ``spare`` ranges with at most k2 differences.

Signatures of no elements aren't emitted, and those that more than GROUP sets share (of common lines, or of
large groups of copies) are taken as hot. A set with no more than ``spare`` ranges with such a signature
meets each partner in a group that isn't hot, and there each is compared with the few before it.
Pairs of two sets that both have more are left: hot groups link each set to the one before it and
to the smallest partner allowed, which joins up groups of copies. What can still be linked beyond that shares
one of its rarest shingles (prefix filtering); sets of like sizes that hang together by these are a family. The sets of
a family that aren't in its largest component are compared with those of like sizes, in blocks, so no rows of pairs are made.

Pairs are ruled out by counts of elements in parts of the hash domain before their sets are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import bitmap, bitmap_slot, cut, has, numbers, remove, ship, without
from .textops import U, mix, shingles, slices

#: Ratio of the largest to the smallest size of a band; differences in a range, parts of a range; ranges to spare, as a share.
BAND, K2, N2, SPARE = 1.5, 1, 3, 0.2
#: Differences up to which a band has a single range.
SINGLE = 3
#: Sets that share a signature which isn't hot, at most; sets of a family and of about one size that one task holds.
GROUP, BLOCK = 8, 1024
#: Counters of shingles by their hash; they only set the order in which prefixes are taken.
COUNTERS = 1 << 18
#: Fewest counts by which pairs are passed over before their sets are compared, and elements to a count.
SKETCH, PER_COUNT = 32, 8
_BITS = 9


class Bands:
    """The bands for similarity num/den, with each one's ranges and subsets of parts, made on demand."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.tops, self.plans = num, den, [1], {}

    def _grow(self) -> None:
        self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * BAND)))

    def of(self, n: int) -> int:
        while self.tops[-1] < n:
            self._grow()
        return int(np.searchsorted(self.tops, n))

    def plan(self, band: int) -> tuple[int, int, int, np.ndarray, np.ndarray]:
        """Differences allowed in a range, ranges to spare, parts of a range, borders of all parts, subsets of parts."""
        if band not in self.plans:
            while len(self.tops) <= band:
                self._grow()
            k = 2 * self.tops[band] * (self.den - self.num) // (self.den + self.num)
            k2, n2 = (k, k + 2) if k <= SINGLE else (K2, N2)
            need = k // (k2 + 1) + 1
            spare = math.ceil(SPARE * need) if need > 1 else 0
            parts = (need + spare) * n2
            self.plans[band] = k2, spare, n2, np.array([(i << 64) // parts for i in range(1, parts)], U), np.array([*combinations(range(n2), n2 - k2)])
        return self.plans[band]

    def signatures(self, s: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """For each band of a sorted set of hashes: its signatures, and how many hot ranges it may have besides.

        The second is negative if it has too many ranges in which a signature has no elements.
        """
        n, c = len(s), self.num
        sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(s + U(0x632BE59BD9B4E019)))))
        band = self.of(n)
        while True:
            k2, spare, n2, edges, subsets = self.plan(band)
            most = (n + min(self.tops[band], n * self.den // c)) * (self.den - c) // (self.den + c)
            if most:  # else equal sets alone are similar
                ranges = most // (k2 + 1) + 1 + spare
                at = np.concatenate(([0], np.searchsorted(s, edges[: ranges * n2]), [n]))[: ranges * n2 + 1]
                place = np.arange(ranges * n2, dtype=U)
                parts = mix((sums[at[1:]] - sums[at[:-1]]) * U(0x9FB21C651E98DF25) + place * U(0xD6E8FEB86659FD93) + U(band + 1) * np.full(1, 0xA0761D6478BD642F, U)).reshape(ranges, n2)
                signs = mix(parts[:, subsets].sum(2, dtype=U) + np.arange(len(subsets), dtype=U) * U(0x9E3779B97F4A7C15))
                strong = np.diff(at).reshape(ranges, n2)[:, subsets].sum(2) > 0
                yield signs[strong], spare - int((~strong.all(1)).sum())
            if c * (self.tops[band] + 1) > self.den * n:
                return
            band += 1


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def _summary(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, h1, h2 = [], [], []
            for s in shingles(_texts(b), k):
                n.append(len(s))
                h1.append(int(np.sum(mix(s), dtype=U).astype(np.int64)))
                h2.append(int(np.bitwise_xor.reduce(mix(s ^ U(0xC2B2AE3D27D4EB4F))).astype(np.int64)) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "n", "h1", "h2"])

    return run


def _of(k: int, bits, make):
    """For documents in the bitmap: what ``make`` gives for their ids and sets, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep = np.flatnonzero(has(bits.value, b.column("slot").to_numpy()))
            b = b.take(pa.array(keep))
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            who, held, size = [], [], 0
            for i, s in enumerate(shingles(_texts(b), k)):
                if len(s):
                    who.append(ids[i])
                    held.append(s)
                    size += len(s)
                if size > 1 << 20 or i == len(ids) - 1 and who:
                    yield make(who, held)
                    who, held, size = [], [], 0

    return run


def _signed(bands: Bands):
    """(sig, doc, m): m has the size, whether the band is the set's own, and the hot ranges it may have.

    A set that has too many weak ranges has a row of its own with a negative m.
    """

    def make(who: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        sig, doc, m = [], [], []
        for d, s in zip(who, held, strict=True):
            for k, (signs, room) in enumerate(bands.signatures(s)):
                if room < 0:
                    signs = np.append(signs, mix(s[:1] + U(int(d) & (1 << 63) - 1)))
                sig.append(signs)
                doc.append(np.full(len(signs), d, np.int64))
                m.append(np.full(len(signs), len(s) << _BITS | (k > 0) << _BITS - 1 | min(max(room, 0), (1 << _BITS - 1) - 1), np.int64))
                if room < 0:
                    m[-1][-1] = -len(s)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.RecordBatch.from_arrays([pa.array(cat(sig, U).view(np.int64)), pa.array(cat(doc, np.int64)), pa.array(cat(m, np.int64))], ["sig", "doc", "m"])

    return make


def _light(who: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array([len(s) for s in held], pa.int64()), pa.array([_sketch(s) for s in held], pa.binary())], ["doc", "n", "sketch"])


def _whole(who: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array([len(s) for s in held], pa.int64()), pa.array([s.tobytes() for s in held], pa.binary())], ["doc", "n", "hashes"])


def _sketch(s: np.ndarray) -> bytes:
    """How many elements of a set fall in each equal part of the hash domain, 255 at most.

    Larger sets have more parts, a power of two, so that there are few elements to each.
    """
    bits = max(SKETCH.bit_length() - 1, (len(s) // PER_COUNT).bit_length())
    return np.minimum(np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _near(num: int, den: int):
    """Pairs whose sketches leave room for the similarity: sets differ in no fewer elements than their counts do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.array(b.column(c).to_pylist(), object) for c in "xy")
            n = b.column("nx").to_numpy() + b.column("ny").to_numpy()
            wide = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
            ok = np.zeros(b.num_rows, bool)
            for p, q in np.unique(wide, axis=0):
                rows, m = np.flatnonzero((wide == (p, q)).all(1)), min(p, q)
                step = max(1, (4 << 20) // int(p + q))
                for at in (rows[i : i + step] for i in range(0, len(rows), step)):
                    u, v = (np.frombuffer(b"".join(z[at]), np.uint8).reshape(len(at), m, -1) for z in (x, y))
                    full = (u == 255).any((1, 2)) | (v == 255).any((1, 2))
                    differ = np.abs(u.sum(2, dtype=np.int64) - v.sum(2, dtype=np.int64)).sum(1)
                    ok[at] = full | (differ * (den + num) <= (den - num) * n[at])
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

    return run


def _similar(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(den * shared >= num * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for b in batches:
        for s in b.column("hashes").to_pylist():
            total += np.bincount((np.frombuffer(s, U) % U(COUNTERS)).astype(np.int64), minlength=COUNTERS) if len(s) > COUNTERS else 0
            if len(s) <= COUNTERS:
                np.add.at(total, (np.frombuffer(s, U) % U(COUNTERS)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])


def _prefix(s: np.ndarray, often: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of a set the rarest shingles, of which any similar set must share one."""
    return s[np.lexsort((s, often[(s % U(COUNTERS)).astype(np.int64)]))[: len(s) + (-len(s) * num) // den + 1]]


def _prefixes(counts, num: int, den: int):
    """Keys by which components of like sizes hang together: rare shingles, in two bands of sizes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_prefix(np.frombuffer(s, U), counts.value, num, den) for s in b.column("hashes").to_pylist()]
            if rows:
                own = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
                flat, band = np.concatenate(rows), b.column("band").to_numpy()[own].astype(U)
                keys = [mix(flat + (band + U(k)) * U(0xD6E8FEB86659FD93)).view(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column("component").take(pa.array(np.concatenate((own, own)))), pa.array(np.concatenate(keys))], ["component", "key"])

    return run


class _Postings:
    """Which of some sets hold an element."""

    def __init__(self, sets: list[np.ndarray]):
        flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.flat, self.own = flat[order], own[order]

    def of(self, s: np.ndarray) -> np.ndarray:
        lo = np.searchsorted(self.flat, s, "left")
        n = np.searchsorted(self.flat, s, "right") - lo
        return self.own[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]


def _within(counts, num: int, den: int):
    """Links between components, of each set that asks to those of a block; one for each two components that it joins up."""

    def run(block: pa.Table) -> pa.Table:
        out, asks = [], block.column("asks").to_numpy()
        if asks.any() and not asks.all():
            sets = [np.frombuffer(x, U) for x in block.column("hashes").to_pylist()]
            heads = [_prefix(s, counts.value, num, den) for s in sets]
            doc, comp = (block.column(c).to_numpy() for c in ("doc", "component"))
            held = np.flatnonzero(~asks)
            size, rare = np.array([len(sets[j]) for j in held]), _Postings([heads[j] for j in held])
            whole, part = _Postings([sets[j] for j in held]), {int(c): int(c) for c in comp}

            def top(c: int) -> int:
                while part[c] != c:
                    part[c] = c = part[part[c]]
                return c

            for i in np.flatnonzero(asks).tolist():
                n, some = len(sets[i]), np.unique(rare.of(heads[i]))
                some = some[(size[some] * den >= n * num) & (n * den >= size[some] * num) & (comp[held[some]] != comp[i])]
                some = some[[top(int(c)) != top(int(comp[i])) for c in comp[held[some]]]] if len(some) else some
                if not len(some):
                    continue
                shared = np.bincount(whole.of(sets[i]), minlength=len(held))[some]
                for j in held[some[den * shared >= num * (n + size[some] - shared)]].tolist():
                    x, y = top(int(comp[i])), top(int(comp[j]))
                    if x != y:
                        part[max(x, y)] = min(x, y)
                        out.append((int(doc[i]), int(doc[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of the documents whose sets of ``k``-word shingles have Jaccard >= num/den.

    docs: doc_id and text; other columns are not looked at. Returns a row for each row of docs:
    doc_id, n_shingles, component_id. A null or blank text has an empty set and is linked with
    nothing. A null doc_id takes no part and has a null component. Rows with one doc_id are one
    node. An empty table gives an empty result.
    """
    spark, gone = docs.sparkSession, []
    ship(spark)

    def kept(df: DataFrame, tag: str) -> DataFrame:
        df, path = cut(df, tag)
        gone.append(path)
        return df

    def at(share: DataFrame, col: str, make, schema: str) -> DataFrame:
        bits = spark.sparkContext.broadcast(bitmap(share, col))
        rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), bitmap_slot(F.col("doc_id").cast("long")).alias("slot"))
        return rows.mapInArrow(_of(k, bits, make), schema)

    own, _ = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_summary(k), "doc_id long, n long, h1 long, h2 long"), "sets")
    known = own.where("n > 0 and doc_id is not null")
    reps = known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    of, _ = cut(known.join(reps, ["h1", "h2", "n"]).select("doc_id", "h1", "h2", "n", "rep"), "reps")
    first = of.select("rep").distinct()
    twice = of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").drop("z")
    same = of.join(twice, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))

    # signatures that are shared; a cold group's sets have those before them, which are GROUP - 1 at most
    by = Window.partitionBy("sig").orderBy("m", "doc")
    number = F.count("*").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.array(*(F.lag(F.struct("doc", "m"), i).over(by) for i in range(1, GROUP)))
    signed = at(first, "rep", _signed(Bands(num, den)), "sig long, doc long, m long")
    near = lambda p, m: (p["doc"] != F.col("doc")) & ((F.shiftright(p["m"], _BITS)) * den >= F.shiftright(m, _BITS) * num)
    shared = signed.withColumn("c", number).withColumn("before", before).where("c > 1 or m < 0")
    cold = F.transform(F.filter("before", lambda p: p.isNotNull() & near(p, F.col("m"))), lambda p: p["doc"])
    shared = kept(shared.select("sig", "doc", "m", "c", F.when((F.col("c") <= GROUP) & (F.col("m") > 0), cold).alias("before")), "shared")
    spark.sparkContext._jvm.System.gc()  # the signatures' shuffle isn't read any more: its files go as soon as it is collected

    rows = shared.where("m > 0")
    hot = rows.where(f"c > {GROUP}").groupBy("doc", F.shiftright("m", _BITS - 1).alias("set")).agg(F.count("*").alias("hot"), F.min(F.col("m").bitwiseAND((1 << _BITS - 1) - 1)).alias("room"))
    hot = kept(hot.where("hot > room").select("doc").union(shared.where("m < 0").select("doc")).distinct(), "hot")
    order = Window.partitionBy("sig").orderBy((F.log(F.shiftright("m", _BITS).cast("double")) * 1e9).cast("long"))
    span = math.ceil(-math.log(num / den) * 1e9) + 1
    stars = rows.where(f"c > {GROUP}").join(hot, "doc", "left_semi").select("doc", "m", F.lag(F.struct("doc", "m")).over(order).alias("p"), F.first("doc").over(order.rangeBetween(-span, 0)).alias("q"))
    stars = stars.select("doc", F.explode(F.array(F.when(near(F.col("p"), F.col("m")), F.col("p.doc")), F.col("q"))).alias("o"))
    pairs = rows.select("doc", F.explode("before").alias("o")).union(stars).where("o <> doc")
    pairs = kept(pairs.select(F.least("doc", "o").alias("a"), F.greatest("doc", "o").alias("b")).distinct(), "pairs")

    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    light = kept(at(ends(pairs), "doc", _light, "doc long, n long, sketch binary"), "sketches")
    each = [light.select(F.col("doc").alias(e), F.col("n").alias("n" + s), F.col("sketch").alias(s)) for e, s in (("a", "x"), ("b", "y"))]
    pairs = kept(pairs.join(each[1], "b").join(each[0], "a").select("a", "b", "nx", "ny", "x", "y").mapInArrow(_near(num, den), "a long, b long").distinct(), "near")
    involved = kept(ends(pairs).union(hot).distinct(), "involved")
    sets = kept(at(involved, "doc", _whole, "doc long, n long, hashes binary").join(involved, "doc", "left_semi"), "hashes")
    both = pairs.join(sets.select(F.col("doc").alias("b"), F.col("hashes").alias("y")), "b").join(sets.select(F.col("doc").alias("a"), F.col("hashes").alias("x")), "a")
    links = kept(both.select("a", "b", "x", "y").mapInArrow(_similar(num, den), "a long, b long").distinct().union(same), "links")
    found = kept(components(links), "components")

    # sizes of two similar sets are in one band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / (-math.log(num / den) * 1.000001) if num < den else F.col("n")).cast("int")
    left = kept(sets.join(hot, "doc", "left_semi").join(found.withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.coalesce("component", "doc").alias("component"), band.alias("band"), "hashes"), "left")
    often = np.zeros(COUNTERS, np.int32)
    slots = numbers(left.select("hashes").mapInArrow(_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")))  # COUNTERS rows at most
    often[slots["slot"]] = np.minimum(slots["n"], (1 << 31) - 1)
    often = spark.sparkContext.broadcast(often)
    prefixes = left.select("component", "band", "hashes").mapInArrow(_prefixes(often, num, den), "component long, key long").distinct()
    ties = prefixes.withColumn("least", F.min("component").over(Window.partitionBy("key"))).where("least < component").select("component", "least").distinct()
    families = kept(components(ties, "component", "least").toDF("component", "family"), "families")
    if not families.isEmpty():
        mine = left.join(families, "component")
        number = mine.groupBy("family", "component", "band").agg(F.count("*").alias("n"))
        main = number.groupBy("family", "component").agg(F.sum("n").alias("n")).groupBy("family").agg(F.max_by("component", "n").alias("main"))
        blocks = number.groupBy("family", "band").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
        held = mine.join(blocks, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("asks", F.lit(False))
        asks = mine.join(main, "family").where("component <> main").withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
        asks = asks.join(blocks, ["family", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
        cols = ["family", "band", "block", "doc", "component", "hashes", "asks"]
        new = kept(held.select(cols).union(asks.select(cols)).groupBy("family", "band", "block").applyInArrow(_within(often, num, den), "a long, b long"), "links")
        if not new.isEmpty():
            found = kept(components(links.union(new)), "components")
    out = of.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    final, _ = cut(out.distinct(), "final")
    remove(spark, *gone)
    return own.join(final, ["doc_id", "h1", "h2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the documents that aren't the least of their group."""
    lost = ngram_jaccard_join(docs, k, num, den).where("component_id <> doc_id").select("doc_id").distinct()
    lost, _ = cut(lost, "lost")
    return without(docs, lost, "doc_id")
