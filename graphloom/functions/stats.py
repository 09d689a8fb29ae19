"""Tests over seeds and sources as column expressions: no Python runs in them.

Degrees of freedom and counts are whole numbers here, so the t distribution has a finite series,
the sign test a finite sum, and the rank test an exact count for few differences.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Differences up to which the signed-rank test counts every arrangement.
EXACT_RANKS = 50


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with a whole number of degrees of freedom; 1 for t null."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c, s = F.cos(angle), F.sin(angle)
    odd = df % 2 == 1
    # each term is the one before times (2k - 1) / 2k c^2, or 2k / (2k + 1) c^2 if df is odd
    count = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    start = F.struct(F.when(odd, c).otherwise(F.lit(1.0)).alias("term"), F.when(odd & (df == 1), F.lit(0.0)).when(odd, c).otherwise(F.lit(1.0)).alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * F.when(odd, 2.0 * k / (2 * k + 1)).otherwise((2.0 * k - 1) / (2 * k)) * c * c
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, add)["sum"]
    inside = F.when(odd, 2 / math.pi * (angle + s * total)).otherwise(s * total)
    return F.coalesce(F.greatest(1 - inside, F.lit(0.0)), F.lit(1.0))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal, by the series of its integral; 0 beyond 8."""
    a = F.abs(z)
    start = F.struct(a.alias("term"), a.alias("sum"))
    grow = lambda acc, k: F.struct((acc["term"] * a * a / (2 * k + 1)).alias("term"), (acc["sum"] + acc["term"] * a * a / (2 * k + 1)).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, grow)["sum"]
    return F.when(a > 8, F.lit(0.0)).otherwise(F.greatest(1 - 2 * total * F.exp(-a * a / 2) / math.sqrt(2 * math.pi), F.lit(0.0)))


def sign_two_sided(positive: Column, n: Column) -> Column:
    """Exact two-sided binomial p of ``positive`` among n at one half; 1 for no n."""
    low = F.least(positive, n - positive)
    start = F.struct((-n * math.log(2.0)).alias("term"), F.exp(-n * math.log(2.0)).alias("sum"))
    grow = lambda acc, k: F.struct((acc["term"] + F.ln((n - k + 1) / k)).alias("term"), (acc["sum"] + F.exp(acc["term"] + F.ln((n - k + 1) / k))).alias("sum"))
    steps = F.when(low >= 1, F.sequence(F.lit(1).cast("bigint"), F.greatest(low, F.lit(1)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(2 * F.aggregate(steps, start, grow)["sum"], F.lit(1.0)))


def _exact_ranks(w: Column, n: Column) -> Column:
    """P of a rank sum at most w or as far on the other side, over all 2^n signs of ranks 1 to n."""
    size = (n * (n + 1) / 2).cast("int")
    one = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size))
    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), one, lambda c, k: F.transform(c, lambda x, i: (x + F.when(i >= k, F.get(c, i - k)).otherwise(0.0)) / 2))
    return F.least(2 * F.aggregate(F.slice(ways, 1, w.cast("int") + 1), F.lit(0.0), lambda a, x: a + x), F.lit(1.0))


def signed_ranks(rows: DataFrame, by: list[str], diff: str = "diff") -> DataFrame:
    """Wilcoxon's signed-rank test of each group: n (zeros left out), w_plus, w_minus, p.

    Exact for up to EXACT_RANKS differences without ties or zeros, else normal with a tie term.
    A group of zeros alone has no row. Tied magnitudes share their mean rank; ranks come from counts
    of equal magnitudes.
    """
    held = rows.where(F.col(diff).isNotNull()).withColumn("_m", F.abs(diff))
    zeros = held.groupBy(*by).agg(F.max((F.col("_m") == 0).cast("int")).alias("zeros"))
    level = held.where("_m > 0").groupBy(*by, "_m").agg(F.count("*").alias("k"), F.count_if(F.col(diff) > 0).alias("up"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = level.withColumn("rank", before + (F.col("k") + 1) / 2)
    k = F.col("k").cast("double")
    s = level.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("k") - F.col("up"))).alias("w_minus"), F.sum(k * k * k - k).alias("ties"))
    n, w = F.col("n").cast("double"), F.least("w_plus", "w_minus")
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    p = F.when((F.col("n") <= EXACT_RANKS) & (F.col("ties") == 0) & (F.col("zeros") == 0), _exact_ranks(w, F.least("n", F.lit(EXACT_RANKS)))).otherwise(normal_two_sided(z))
    return s.join(zeros, by).select(*by, "n", "w_plus", "w_minus", p.alias("p"))


def paired(rows: DataFrame, by: list[str], critical: DataFrame | None = None, diff: str = "diff") -> DataFrame:
    """Paired summary of each group's differences over seeds.

    n, mean, sd (0 for one seed), p of t (1 where all are zero), positive and negative counts,
    significant (p < 0.05), nearly_all (all but one seed agree, either way), and with ``critical``
    (df, t) the ends of the interval; null for one seed.
    """
    d = F.col(diff)
    g = rows.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"), F.count_if(d > 0).alias("positive"), F.count_if(d < 0).alias("negative"))
    error = F.col("sd") / F.sqrt("n")
    p = F.when((F.col("n") < 2) | (F.col("sd") == 0), F.when((F.col("n") > 1) & (F.col("mean") != 0), F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(t_two_sided(F.col("mean") / F.nullif(error, F.lit(0.0)), F.greatest(F.col("n") - 1, F.lit(1))))
    g = g.withColumn("p", p).withColumn("significant", F.col("p") < 0.05).withColumn("nearly_all", F.abs(F.col("positive") - F.col("n") / 2) >= F.col("n") / 2 - 1)
    if critical is not None:
        g = g.join(F.broadcast(critical.select((F.col("df") + 1).alias("n"), "t")), "n", "left")  # a row for each df in the caller's literal table
        g = g.withColumn("ci_low", F.col("mean") - F.col("t") * error).withColumn("ci_high", F.col("mean") + F.col("t") * error).drop("t")
    return g.select(*by, *(c for c in g.columns if c not in by))


def detectable(sd: Column, n: Column, t_level: float, t_power: float) -> Column:
    """Least effect that n seeds of this deviation would show."""
    return (t_level + t_power) * sd / F.sqrt(n)
