"""Checks of tables: the same plan over two versions, balance of delimiters, overlaps of boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a stretch of text that is summed up at a time.
STRETCH = 65_536
PAIRS = ("()", "[]", "{}", "<>")


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """(gone, new): rows of one version that the other hasn't, repeats counted; both versions are dealt by their rows once."""
    more = F.sum("side").alias("more")
    rows = before.withColumn("side", F.lit(-1)).union(after.withColumn("side", F.lit(1))).groupBy(*before.columns).agg(more)
    one = lambda sign, n: F.coalesce(F.sum(F.greatest(sign * F.col("more"), F.lit(0))), F.lit(0)).cast("bigint").alias(n)
    return rows.agg(one(-1, "gone"), one(1, "new"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, part, text in zip(b.column("id").to_pylist(), b.column("part").to_pylist(), b.column("text"), strict=True):
            a = np.frombuffer(text.as_buffer(), np.uint8)
            for pair in PAIRS:
                step = (a == ord(pair[0])).astype(np.int32) - (a == ord(pair[1]))
                run = np.cumsum(step)
                if step.any():
                    out.append((i, part, pair, int(np.abs(step).sum()), int(run[-1]), min(0, int(run.min()))))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (b.schema.field("id").type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "part", "pair", "marks", "total", "low"])


def unbalanced(texts: DataFrame) -> DataFrame:
    """(id, pair, marks, closes, opens) of ``texts`` (id, text): delimiters of each kind, and those that have no partner, each kind by itself.

    A stretch of text is summed up by what it adds and how far it falls; stretches of one text add up in any
    number of tasks, so a text of any length is no single one's work. A text without a kind has no row for it.
    """
    stretches = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    parts = texts.select("id", F.posexplode(stretches).alias("part", "text")).select("id", "part", F.col("text").cast("binary").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    sums = parts.mapInArrow(_sums, f"id {kind}, part int, pair string, marks long, total long, low long")
    ahead = F.coalesce(F.sum("total").over(Window.partitionBy("id", "pair").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = sums.withColumn("low", ahead + F.col("low")).groupBy("id", "pair").agg(F.sum("marks").alias("marks"), F.greatest(F.lit(0), -F.min("low")).alias("closes"), F.sum("total").alias("total"))
    return whole.select("id", "pair", "marks", "closes", (F.col("total") + F.col("closes")).alias("opens"))


def overlapping(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """(a, b) with a < b: boxes (id, x0, x1, y0, y1) that share more than a border.

    Each box lies in the cells of a grid that it touches, and a pair is found in the cell of the corner where its
    common part begins, so once. Work follows the boxes of a cell: width and height should be those of usual boxes.
    A segment or point overlaps nothing.
    """
    cells = lambda a, b, w: F.sequence(F.floor(F.col(a) / w), F.floor(F.col(b) / w))
    placed = boxes.where("x0 < x1 AND y0 < y1").withColumn("cx", F.explode(cells("x0", "x1", width))).withColumn("cy", F.explode(cells("y0", "y1", height)))
    a, b = (placed.select("cx", "cy", *(F.col(c).alias(f"{n}_{c}") for c in ("id", "x0", "x1", "y0", "y1"))) for n in "ab")
    both = a.join(b, ["cx", "cy"]).where("a_id < b_id AND a_x0 < b_x1 AND b_x0 < a_x1 AND a_y0 < b_y1 AND b_y0 < a_y1")
    first = (F.floor(F.greatest("a_x0", "b_x0") / width) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / height) == F.col("cy"))
    return both.where(first).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
