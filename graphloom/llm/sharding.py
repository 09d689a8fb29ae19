"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled within each source by a seeded MD5, ranked, and put in order of their
fractional rank (rank - 1/2) / size of the source. Any run of that order holds each source in
proportion, so cutting it into equal runs gives shards that all match the mixture.

Neither ranking gathers a source, or equal keys, in one task: rows are dealt by sampled borders of the
whole key, whose last column tells any two rows apart, and sorted where they arrive. A row's place is its
number there plus the rows of the parts before, a table of one row a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, remove

#: Bits of a row's number within its part, as monotonically_increasing_id() has them.
INSIDE = 33


def _placed(rows: DataFrame, order: list[Column], tag: str) -> tuple[DataFrame, str]:
    """``rows`` with ``at``, the place of each from 0 in ``order``, which must tell all rows apart; and the path of its scratch."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    dealt, path = cut(dealt.select(*rows.columns, F.shiftright("_m", INSIDE).alias("_part"), F.col("_m").bitwiseAND(F.lit((1 << INSIDE) - 1)).alias("_at")), tag)
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    return dealt.join(starts, "_part").withColumn("at", F.col("_from") + F.col("_at")).drop("_part", "_at", "_from"), path


def stratified_interleave(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text, source; others are not read) into a shard.

    Gives doc_id, size (UTF-8 bytes of the text and 8), text_crc32, law ('rows': the counts of
    shards are at most one apart), shard, slot (from 0 without gaps) and grown_shard (null under
    this law). A null text counts as empty, null sources are one source of their own, and a null
    doc_id is shuffled as the empty string. Equal fractional ranks go by the MD5. Rows with all of
    these equal get different slots. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("h"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows, at_rows = cut(rows, "rows")
    ties = [F.col(c) for c in ("h", "doc_id", "size", "text_crc32", "row")]
    ranked, at_ranked = _placed(rows, [F.col("source"), *ties], "ranked")
    sources = ranked.groupBy("source").agg(F.min("at").alias("first"), F.count("*").alias("number"))
    ranked = ranked.join(sources, "source")
    frac = (2 * (F.col("at") - F.col("first")) + 1).cast("double") / (2 * F.col("number")).cast("double")
    placed, _ = _placed(ranked.select("doc_id", "source", "size", "text_crc32", "h", "row", frac.alias("frac")), [F.col("frac"), F.col("h"), F.col("source"), *ties[1:]], "placed")
    remove(docs.sparkSession, at_rows, at_ranked)
    n = placed.count()
    shard = F.expr(f"cast((at * {shards}) div {n} as int)") if n else F.lit(0)
    start = F.expr(f"((at * {shards}) div {n} * {n} + {shards - 1}) div {shards}") if n else F.lit(0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), (F.col("at") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
