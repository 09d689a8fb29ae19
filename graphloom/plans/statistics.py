"""Reports over runs and sources as DataFrame plans; their SQL is written from the definitions, apart from the plans.

Runs are those of the registry: order months as seeds, priorities as models, two datasets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import graph as G
from ..operators import text as T
from . import floors
from . import registry as R

#: Named contrasts: model, and the model it is held against, or the floor.
CONTRASTS = (
    ("urgent_vs_floor", "1-URGENT", None), ("high_vs_floor", "2-HIGH", None), ("medium_vs_floor", "3-MEDIUM", None), ("open_vs_floor", "4-NOT SPECIFIED", None), ("low_vs_floor", "5-LOW", None),
    ("urgent_vs_high", "1-URGENT", "2-HIGH"), ("high_vs_medium", "2-HIGH", "3-MEDIUM"), ("medium_vs_open", "3-MEDIUM", "4-NOT SPECIFIED"), ("open_vs_low", "4-NOT SPECIFIED", "5-LOW"),
    ("urgent_vs_low", "1-URGENT", "5-LOW"), ("high_vs_low", "2-HIGH", "5-LOW"), ("urgent_vs_medium", "1-URGENT", "3-MEDIUM"),
)
#: Two-sided 5 % points of Student's t by degrees of freedom.
T95 = ((9, 2.262157), (10, 2.228139), (11, 2.200985))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R._spark(R.RUNS + " SELECT dataset, model, seed, mrr, floor, diff FROM delta")(spark, sf_dir)


def _r(c: Column | str, name: str, digits: int = 9) -> Column:
    return (F.round(c, digits) + 0.0).alias(name)


def named_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve named paired contrasts of each dataset, over the seeds that both sides have."""
    runs = _runs(spark, sf_dir)
    names = F.broadcast(spark.createDataFrame(CONTRASTS, "name string, model string, base string"))  # twelve rows
    own = runs.join(names, "model")
    other = runs.select("dataset", "seed", F.col("model").alias("base"), F.col("mrr").alias("other"))
    diffs = own.join(other, ["dataset", "seed", "base"], "left").withColumn("diff", F.col("mrr") - F.when(F.col("base").isNull(), F.col("floor")).otherwise(F.col("other")))
    t = spark.createDataFrame(T95, "df int, t double")
    p = stats.paired(diffs.where("diff IS NOT NULL"), ["dataset", "name"], t)
    return p.select("dataset", "name", "n", _r("mean", "mean"), _r("sd", "sd"), "positive", "negative", _r("ci_low", "ci_low"), _r("ci_high", "ci_high"))


def anova_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced two-way analysis of variance with seeds as repeats: squares, degrees of freedom, components and shares. No rows where cells differ in size."""
    x = _runs(spark, sf_dir).select("dataset", "model", "mrr")
    cells = x.groupBy("dataset", "model").agg(F.count("*").alias("n"), F.avg("mrr").alias("cell"), F.var_pop("mrr").alias("spread"))
    cells = cells.withColumns({"row": F.avg("cell").over(Window.partitionBy("dataset")), "col": F.avg("cell").over(Window.partitionBy("model")), "grand": F.avg("cell").over(Window.partitionBy())})  # a row a cell
    sq = lambda c: c * c
    c = {n: F.col(n) for n in ("n", "cell", "row", "col", "grand", "spread")}
    s = cells.agg(F.count_distinct("dataset").alias("a"), F.count_distinct("model").alias("b"), F.min("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("k"), F.sum(c["n"] * sq(c["row"] - c["grand"])).alias("ss_dataset"), F.sum(c["n"] * sq(c["col"] - c["grand"])).alias("ss_model"), F.sum(c["n"] * sq(c["cell"] - c["row"] - c["col"] + c["grand"])).alias("ss_interaction"), F.sum(c["n"] * c["spread"]).alias("ss_split"))
    s = s.where("n = most AND k = a * b")
    a, b, n = (F.col(k).cast("double") for k in "abn")
    df = {"dataset": a - 1, "model": b - 1, "interaction": (a - 1) * (b - 1), "split": a * b * (n - 1)}
    ms = {k: F.when(d > 0, F.col(f"ss_{k}") / d).otherwise(0.0) for k, d in df.items()}
    zero = F.lit(0.0)
    part = {"split": ms["split"], "interaction": F.greatest((ms["interaction"] - ms["split"]) / n, zero), "model": F.greatest((ms["model"] - ms["interaction"]) / (a * n), zero), "dataset": F.greatest((ms["dataset"] - ms["interaction"]) / (b * n), zero)}
    whole, of = (reduce(lambda x, y: x + y, v) for v in ([F.col(f"ss_{k}") for k in df], [*part.values()]))
    rows = [F.struct(F.lit(k).alias("term"), _r(F.col(f"ss_{k}"), "ss"), _r(F.col(f"ss_{k}") / whole, "ss_share", 6), df[k].cast("long").alias("df"), _r(ms[k], "ms"), _r(part[k], "component", 12), _r(F.when(of > 0, part[k] / of).otherwise(0.0), "share", 6)) for k in df]
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def stability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the order of models moves over seeds: the best overall, how often it is a seed's best, correlations of ranks with the pooled ones and between seeds, and of models over seeds."""
    runs = _runs(spark, sf_dir)
    pooled = runs.groupBy("dataset", "model").agg(F.avg("mrr").alias("mean"))
    place = lambda df, by, v: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(v), "model")))
    over, each = place(pooled, ["dataset"], "mean"), place(runs, ["dataset", "seed"], "mrr")
    best = over.where("rank = 1").select("dataset", F.col("model").alias("best"))
    agree = each.where("rank = 1").join(best, "dataset").groupBy("dataset", "best").agg(F.avg((F.col("model") == F.col("best")).cast("double")).alias("agree"))
    with_pool = each.select("dataset", "seed", "model", "rank").join(over.select("dataset", "model", F.col("rank").alias("pool")), ["dataset", "model"]).groupBy("dataset", "seed").agg(F.corr("rank", "pool").alias("c"))
    with_pool = with_pool.groupBy("dataset").agg(F.avg("c").alias("pool_mean"), F.min("c").alias("pool_low"))
    left, right = (each.select("dataset", "model", F.col("seed").alias(f"s{n}"), F.col("rank").alias(f"r{n}")) for n in "ab")
    seeds = left.join(right, ["dataset", "model"]).where("sa < sb").groupBy("dataset", "sa", "sb").agg(F.corr("ra", "rb").alias("c")).groupBy("dataset").agg(F.avg("c").alias("seed_mean"))
    left, right = (runs.select("dataset", "seed", F.col("model").alias(f"m{n}"), F.col("mrr").alias(f"v{n}")) for n in "ab")
    models = left.join(right, ["dataset", "seed"]).where("ma < mb").groupBy("dataset", "ma", "mb").agg(F.corr("va", "vb").alias("c")).groupBy("dataset").agg(F.avg("c").alias("model_mean"), F.min("c").alias("model_low"), F.max("c").alias("model_high"))
    out = reduce(lambda x, y: x.join(y, "dataset"), (agree, with_pool, seeds, models))
    return out.select("dataset", "best", *(_r(c, c, 6) for c in ("agree", "pool_mean", "pool_low", "seed_mean", "model_mean", "model_low", "model_high")))


def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates 1 + 10 (difference from the floor) of a dataset: moments, ends, percentiles of their distance from 1 and the share outside 0.99 to 1.01."""
    g = _runs(spark, sf_dir).withColumn("g", 1 + 10 * F.col("diff")).withColumn("a", F.abs(10 * F.col("diff")))
    out = F.avg(((F.col("g") < 0.99) | (F.col("g") > 1.01)).cast("double"))
    return g.groupBy("dataset").agg(_r(F.avg("g"), "mean"), _r(F.stddev_pop("g"), "sd"), _r(F.min("g"), "low"), _r(F.max("g"), "high"), _r(F.percentile("a", 0.5), "p50"), _r(F.percentile("a", 0.95), "p95"), _r(out, "outside"))


def leave_one_out_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each cell without one seed: the least, the mean and the most."""
    own = Window.partitionBy("dataset", "model")
    loo = _runs(spark, sf_dir).withColumn("n", F.count("*").over(own)).where("n > 1").withColumn("loo", (F.sum("mrr").over(own) - F.col("mrr")) / (F.col("n") - 1))
    return loo.groupBy("dataset", "model").agg(_r(F.min("loo"), "low"), _r(F.avg("mrr"), "mean"), _r(F.max("loo"), "high"))


def per_source_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of every source with how many positives it has, and how many of them can be ranked."""
    sources = R._sources(spark, sf_dir, "degree")
    test = spark.table("edges").join(spark.table("win").where("win = 'test'").select(F.col("id").alias("src")), "src")
    return test.groupBy(F.col("src").alias("source")).agg(F.count("*").alias("n_positives")).join(sources, "source").select("source", "best_rank", "n_reachable", "n_positives")


def _increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every test source: reciprocal ranks by content and by common neighbours, length of its text, its positives and its group."""
    model = R._sources(spark, sf_dir, "common_neighbors").select("source", F.col("rr").alias("model"))
    floor = floors._floor(spark, sf_dir, (floors.BASE,)).select("source", F.col("rr").alias("floor"))
    texts = floors.texts(spark, sf_dir).select(F.col("id").alias("source"), F.char_length("text").alias("length"), F.substring_index("text", " ", 1).alias("grp"))
    n = spark.table("edges").groupBy(F.col("src").alias("source")).agg(F.count("*").alias("n_positives"))
    return model.join(floor, "source").join(texts, "source").join(n, "source")


def stratified_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increment over the content floor by quartile of text length, by quartile of positives and by the most frequent groups; a value on a border goes up."""
    rows = _increments(spark, sf_dir).persist()
    q = rows.agg(*(F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"q_{c}") for c in ("length", "n_positives")))
    at = rows.crossJoin(F.broadcast(q))  # one row
    place = lambda c: F.concat(F.lit(f"{c} q"), (1 + F.size(F.filter(f"q_{c}", lambda b: b <= F.col(c)))).cast("string"))
    top = rows.groupBy("grp").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "grp").limit(6).select("grp", F.lit(True).alias("kept"))
    strata = F.explode(F.array(place("length"), place("n_positives"), F.concat(F.lit("group "), F.when(F.col("kept"), F.col("grp")).otherwise("other"))))
    rows = at.join(F.broadcast(top), "grp", "left").select(strata.alias("stratum"), (F.col("model") - F.col("floor")).alias("diff"), "floor")
    return rows.groupBy("stratum").agg(F.count("*").alias("n"), _r(F.avg("diff"), "mean"), _r(F.coalesce(F.stddev_samp("diff"), F.lit(0.0)), "sd"), F.count_if(F.col("diff") > 0).alias("positive"), _r(F.avg("floor"), "floor"))


def rule_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rules of which epoch of a curve (months) is kept, with stopping after 3 epochs without a gain: the kept value against the floor, over the curves of a dataset.

    'best_val_with_init' starts from the floor of the first epoch, which stays where nothing is better.
    """
    curve = _runs(spark, sf_dir).groupBy("dataset", "model").agg(F.array_sort(F.collect_list(F.struct("seed", "mrr", "floor"))).alias("c"))

    def kept(start: Column) -> Column:
        state = F.struct(start.alias("top"), F.lit(0).alias("best"), F.lit(0).alias("idle"), F.lit(0).alias("last"), F.lit(0.0).alias("end"))

        def step(s: Column, x: Column) -> Column:
            gain, on = x["mrr"] > s["top"] + 1e-6, s["idle"] < 3
            pick = lambda yes, a, b: F.when(yes, a).otherwise(b)
            return F.struct(pick(on & gain, x["mrr"], s["top"]).alias("top"), pick(on & gain, x["seed"], s["best"]).alias("best"), F.when(on & gain, 0).when(on, s["idle"] + 1).otherwise(s["idle"]).alias("idle"), pick(on, x["seed"], s["last"]).alias("last"), pick(on, x["mrr"], s["end"]).alias("end"))

        return F.aggregate("c", state, step)

    first = F.col("c")[0]
    rows = curve.withColumns({"s": kept(F.lit(-1.0)), "i": kept(first["floor"])})
    rule = lambda name, epoch, value: F.struct(F.lit(name).alias("rule"), epoch.cast("int").alias("epoch"), value.alias("value"), F.col("s.best").alias("best"))
    rules = F.array(rule("best_val", F.col("s.best"), F.col("s.top")), rule("last", F.col("s.last"), F.col("s.end")), rule("first", first["seed"], first["mrr"]), rule("best_val_with_init", F.col("i.best"), F.col("i.top")))
    rows = rows.select("dataset", "model", first["floor"].alias("floor"), F.explode(rules).alias("r")).select("dataset", "model", "floor", "r.*").withColumn("diff", F.col("value") - F.col("floor"))
    return rows.groupBy("dataset", "rule").agg(F.count("*").alias("curves"), _r(F.avg("value"), "mean"), _r(F.stddev_samp("value"), "sd"), _r(F.avg("floor"), "floor"), _r(F.avg("diff"), "diff"), F.count_if(F.col("diff") < 0).alias("below"), F.count_if(F.col("epoch") < F.col("best")).alias("before_best"))


def protocol_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's ranks among one pool against the content floor among the same or the other: matched and mixed readings, source by source and on the whole."""
    a, b = (floors._floor(spark, sf_dir, (floors.BASE,), whole=w).select("source", F.col("rr").alias(n)) for n, w in (("floor_a", False), ("floor_b", True)))
    model = R._sources(spark, sf_dir, "common_neighbors").select("source", F.col("rr").alias("model"))
    rows = model.join(a, "source").join(b, "source")
    d = lambda n: F.col("model") - F.col(n)
    reading = F.explode(F.array(*(F.struct(F.lit(n).alias("reading"), F.col(c).alias("floor"), d(c).alias("diff")) for n, c in (("matched", "floor_a"), ("mixed", "floor_b")))))
    return rows.select(reading.alias("r")).select("r.*").groupBy("reading").agg(F.count("*").alias("sources"), _r(F.avg("floor"), "floor", 6), _r(F.avg("diff"), "diff", 6), F.count_if(F.col("diff") > 0).alias("gains"), F.count_if(F.col("diff") < 0).alias("losses"))


def date_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part graph dated by first shipment, commitment or receipt: span, shares near its end, and the windows' edges under each."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    G.register(spark, sf_dir, R.SEED)
    out = []
    for name in ("l_shipdate", "l_shipdate + 30 days of odd orders", "last l_shipdate"):
        day = F.to_date("l_shipdate")
        day = F.when(F.col("l_orderkey") % 2 == 1, F.date_add(day, 30)).otherwise(day) if "odd" in name else day
        nodes = line.groupBy(F.col("l_partkey").alias("id")).agg((F.max(day) if name.startswith("last") else F.min(day)).alias("d"))
        g = G.Graph(nodes, spark.table("edges"))
        win = G.windows(g, R.SEED).persist()
        x = F.unix_date("d")
        end = win.agg(F.max(x).alias("m"), F.min(x).alias("f"))
        span = win.crossJoin(F.broadcast(end)).agg(F.first(F.col("m") - F.col("f")).cast("long").alias("span_days"), _r(F.avg((x >= F.col("m") - 91).cast("double")), "share_91"), _r(F.avg((x >= F.col("m") - 365).cast("double")), "share_365"))  # one row
        test = g.edges.join(win.where("win = 'test'").select(F.col("id").alias("src")), "src").join(win.where("win <> 'test'").select(F.col("id").alias("tgt")), "tgt")
        out.append(span.crossJoin(test.agg(F.count_distinct("src").alias("sources"), F.count("*").alias("positives"))).withColumn("convention", F.lit(name)))
    return reduce(DataFrame.union, out)


QUERIES = {f.__name__: f for f in (named_contrasts, anova_table, stability_summary, gate_summary, leave_one_out_band, per_source_positives, stratified_increments, rule_comparison, protocol_accounting, date_conventions)}

_NAMED = ", ".join(f"('{n}', '{a}', {repr(b) if b else 'NULL'})" for n, a, b in CONTRASTS)
_SUMMARY = "count(*) AS n, round(avg(diff), 9) + 0.0 AS mean"
_FLOORS = lambda whole: f"SELECT src AS source, round(1.0 / CAST(best AS DOUBLE), 9) AS rr FROM ({floors._ranked((floors.BASE,), 'SELECT * FROM best', whole=whole)}) q"
_MODEL = f"SELECT src AS source, round(1.0 / CAST(best AS DOUBLE), 9) AS rr FROM ({R._ranked('common_neighbors', 'SELECT * FROM best')}) q"
_WINDOWS = R.BASE.replace("{seed}", str(R.SEED)).split("edges AS")[1]
ORACLES = {
    "named_contrasts": "WITH " + R.RUNS + f""", c AS (SELECT * FROM (VALUES {_NAMED}) t(name, model, base)),
d AS (SELECT x.dataset, c.name, x.mrr - CASE WHEN c.base IS NULL THEN x.floor ELSE y.mrr END AS diff FROM c JOIN delta x ON x.model = c.model LEFT JOIN delta y ON y.model = c.base AND y.dataset = x.dataset AND y.seed = x.seed WHERE c.base IS NULL OR y.mrr IS NOT NULL),
s AS (SELECT dataset, name, count(*) AS n, avg(diff) AS mean, coalesce(stddev_samp(diff), 0) AS sd, count(*) FILTER (diff > 0) AS positive, count(*) FILTER (diff < 0) AS negative FROM d GROUP BY 1, 2)
SELECT dataset, name, n, round(mean, 9) + 0.0 AS mean, round(sd, 9) + 0.0 AS sd, positive, negative, round(mean - t * sd / sqrt(n), 9) + 0.0 AS ci_low, round(mean + t * sd / sqrt(n), 9) + 0.0 AS ci_high
FROM s LEFT JOIN (VALUES {", ".join(f"({d + 1}, CAST({t} AS DOUBLE))" for d, t in T95)}) q(m, t) ON m = n""",
    "anova_table": "WITH " + R.RUNS + """, g AS (SELECT avg(mrr) AS g, count(*) AS t FROM runs), a AS (SELECT dataset, avg(mrr) AS m FROM runs GROUP BY 1), b AS (SELECT model, avg(mrr) AS m FROM runs GROUP BY 1), c AS (SELECT dataset, model, avg(mrr) AS m, count(*) AS k FROM runs GROUP BY 1, 2),
k AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT min(k) FROM c) AS each),
ss AS (SELECT 'dataset' AS term, sum(pow(a.m - g.g, 2)) AS ss, na - 1 AS df FROM runs JOIN a USING (dataset), g, k GROUP BY na
UNION ALL SELECT 'model', sum(pow(b.m - g.g, 2)), nb - 1 FROM runs JOIN b USING (model), g, k GROUP BY nb
UNION ALL SELECT 'interaction', sum(pow(c.m - a.m - b.m + g.g, 2)), (na - 1) * (nb - 1) FROM runs JOIN a USING (dataset) JOIN b USING (model) JOIN c USING (dataset, model), g, k GROUP BY na, nb
UNION ALL SELECT 'split', sum(pow(mrr - c.m, 2)), na * nb * (each - 1) FROM runs JOIN c USING (dataset, model), k GROUP BY na, nb, each),
ms AS (SELECT *, ss / df AS ms FROM ss), m AS (SELECT max(ms) FILTER (term = 'dataset') AS d, max(ms) FILTER (term = 'model') AS mo, max(ms) FILTER (term = 'interaction') AS i, max(ms) FILTER (term = 'split') AS s, sum(ss) AS whole FROM ms),
v AS (SELECT ms.*, whole, CASE term WHEN 'split' THEN s WHEN 'interaction' THEN greatest((i - s) / each, 0) WHEN 'model' THEN greatest((mo - i) / (na * each), 0) ELSE greatest((d - i) / (nb * each), 0) END AS component FROM ms, m, k)
SELECT term, round(ss, 9) + 0.0 AS ss, round(ss / whole, 6) + 0.0 AS ss_share, CAST(df AS BIGINT) AS df, round(ms, 9) + 0.0 AS ms, round(component, 12) + 0.0 AS component, round(component / sum(component) OVER (), 6) + 0.0 AS share FROM v
WHERE (SELECT max(k) FROM c) = (SELECT each FROM k) AND (SELECT count(*) FROM c) = (SELECT na * nb FROM k)""",
    "stability_summary": "WITH " + R.RUNS + """, e AS (SELECT dataset, seed, model, mrr, row_number() OVER (PARTITION BY dataset, seed ORDER BY mrr DESC, model) AS r FROM runs),
p AS (SELECT dataset, model, row_number() OVER (PARTITION BY dataset ORDER BY avg(mrr) DESC, model) AS r FROM runs GROUP BY 1, 2),
x AS (SELECT p.dataset, p.model AS best, avg(CAST(e.r = 1 AS INT)) AS agree FROM p JOIN e ON e.dataset = p.dataset AND e.model = p.model WHERE p.r = 1 GROUP BY 1, 2),
y AS (SELECT dataset, avg(c) AS m, min(c) AS l FROM (SELECT e.dataset, e.seed, corr(e.r, p.r) AS c FROM e JOIN p ON p.dataset = e.dataset AND p.model = e.model GROUP BY 1, 2) q GROUP BY 1),
z AS (SELECT dataset, avg(c) AS m FROM (SELECT a.dataset, corr(a.r, b.r) AS c FROM e a JOIN e b ON a.dataset = b.dataset AND a.model = b.model AND a.seed < b.seed GROUP BY a.dataset, a.seed, b.seed) q GROUP BY 1),
w AS (SELECT dataset, avg(c) AS m, min(c) AS l, max(c) AS h FROM (SELECT a.dataset, corr(a.mrr, b.mrr) AS c FROM e a JOIN e b ON a.dataset = b.dataset AND a.seed = b.seed AND a.model < b.model GROUP BY a.dataset, a.model, b.model) q GROUP BY 1)
SELECT x.dataset, best, round(agree, 6) + 0.0 AS agree, round(y.m, 6) + 0.0 AS pool_mean, round(y.l, 6) + 0.0 AS pool_low, round(z.m, 6) + 0.0 AS seed_mean, round(w.m, 6) + 0.0 AS model_mean, round(w.l, 6) + 0.0 AS model_low, round(w.h, 6) + 0.0 AS model_high
FROM x JOIN y USING (dataset) JOIN z USING (dataset) JOIN w USING (dataset)""",
    "gate_summary": "WITH " + R.RUNS + """, g AS (SELECT dataset, 1 + 10 * (mrr - floor) AS g FROM delta)
SELECT dataset, round(avg(g), 9) AS mean, round(stddev_pop(g), 9) AS sd, round(min(g), 9) AS low, round(max(g), 9) AS high, round(quantile_cont(abs(g - 1), 0.5), 9) AS p50, round(quantile_cont(abs(g - 1), 0.95), 9) AS p95, round(avg(CAST(NOT g BETWEEN 0.99 AND 1.01 AS INT)), 9) AS outside FROM g GROUP BY 1""",
    "leave_one_out_band": "WITH " + R.RUNS + """, l AS (SELECT a.dataset, a.model, a.seed, avg(b.mrr) AS loo, max(a.mrr) AS own FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.model = b.model AND a.seed <> b.seed GROUP BY 1, 2, 3)
SELECT dataset, model, round(min(loo), 9) AS low, round(avg(own), 9) AS mean, round(max(loo), 9) AS high FROM l GROUP BY 1, 2""",
    "per_source_positives": R._ranked("degree", "SELECT b.src AS source, b.best AS best_rank, b.k AS n_reachable, count(*) AS n_positives FROM best b JOIN edges e ON e.src = b.src GROUP BY 1, 2, 3"),
    "stratified_increments": f"""WITH m AS ({_MODEL}), f AS ({_FLOORS(False)}), n AS (SELECT src, count(*) AS k FROM (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS tgt FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey) q GROUP BY 1),
r AS (SELECT m.rr - f.rr AS diff, f.rr AS floor, length(concat_ws(' ', p_name, p_brand, p_type)) AS len_, n.k, split_part(p_name, ' ', 1) AS grp FROM m JOIN f USING (source) JOIN part ON p_partkey = source JOIN n ON n.src = source),
q AS (SELECT quantile_cont(len_, [0.25, 0.5, 0.75]) AS ql, quantile_cont(k, [0.25, 0.5, 0.75]) AS qk FROM r), t AS (SELECT grp FROM r GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6),
s AS (SELECT 'length q' || (1 + CAST(len_ >= ql[1] AS INT) + CAST(len_ >= ql[2] AS INT) + CAST(len_ >= ql[3] AS INT)) AS stratum, diff, floor FROM r, q
UNION ALL SELECT 'n_positives q' || (1 + CAST(k >= qk[1] AS INT) + CAST(k >= qk[2] AS INT) + CAST(k >= qk[3] AS INT)), diff, floor FROM r, q UNION ALL SELECT 'group ' || CASE WHEN grp IN (SELECT grp FROM t) THEN grp ELSE 'other' END, diff, floor FROM r)
SELECT stratum, {_SUMMARY}, round(coalesce(stddev_samp(diff), 0), 9) + 0.0 AS sd, count(*) FILTER (diff > 0) AS positive, round(avg(floor), 9) + 0.0 AS floor FROM s GROUP BY 1""",
    "rule_comparison": "WITH RECURSIVE " + R.RUNS + """, curve AS (SELECT *, row_number() OVER (PARTITION BY dataset, model ORDER BY seed) AS i, first_value(floor) OVER (PARTITION BY dataset, model ORDER BY seed) AS f0 FROM delta),
go AS (SELECT dataset, model, w, 0 AS i, CASE WHEN w THEN f0 ELSE -1 END AS top, 0 AS best, 0 AS idle, 0 AS last, CAST(0 AS DOUBLE) AS fin FROM curve, (VALUES (true), (false)) v(w) WHERE i = 1
UNION ALL SELECT g.dataset, g.model, w, c.i, CASE WHEN c.mrr > top + 1e-6 THEN c.mrr ELSE top END, CASE WHEN c.mrr > top + 1e-6 THEN c.seed ELSE best END, CASE WHEN c.mrr > top + 1e-6 THEN 0 ELSE idle + 1 END, c.seed, c.mrr FROM go g JOIN curve c ON c.dataset = g.dataset AND c.model = g.model AND c.i = g.i + 1 WHERE idle < 3),
e AS (SELECT * FROM go QUALIFY i = max(i) OVER (PARTITION BY dataset, model, w)), s AS (SELECT * FROM e WHERE NOT w), o AS (SELECT * FROM curve WHERE i = 1),
r AS (SELECT dataset, model, 'best_val' AS rule, best AS epoch, top AS value FROM s UNION ALL SELECT dataset, model, 'last', last, fin FROM s UNION ALL SELECT dataset, model, 'first', seed, mrr FROM o UNION ALL SELECT dataset, model, 'best_val_with_init', best, top FROM e WHERE w)
SELECT r.dataset, rule, count(*) AS curves, round(avg(value), 9) + 0.0 AS mean, round(stddev_samp(value), 9) + 0.0 AS sd, round(avg(f0), 9) + 0.0 AS floor, round(avg(value - f0), 9) + 0.0 AS diff, count(*) FILTER (value - f0 < 0) AS below, count(*) FILTER (r.epoch < s.best) AS before_best
FROM r JOIN s ON s.dataset = r.dataset AND s.model = r.model JOIN o ON o.dataset = r.dataset AND o.model = r.model GROUP BY 1, 2""",
    "protocol_accounting": f"""WITH m AS ({_MODEL}), a AS ({_FLOORS(False)}), b AS ({_FLOORS(True)}), r AS (SELECT 'matched' AS reading, a.rr AS floor, m.rr - a.rr AS diff FROM m JOIN a USING (source) JOIN b USING (source) UNION ALL SELECT 'mixed', b.rr, m.rr - b.rr FROM m JOIN a USING (source) JOIN b USING (source))
SELECT reading, count(*) AS sources, round(avg(floor), 6) + 0.0 AS floor, round(avg(diff), 6) + 0.0 AS diff, count(*) FILTER (diff > 0) AS gains, count(*) FILTER (diff < 0) AS losses FROM r GROUP BY 1""",
    "date_conventions": " UNION ALL ".join(
        f"SELECT * FROM (WITH nodes AS (SELECT l_partkey AS id, {agg} AS d FROM lineitem GROUP BY 1), edges AS{_WINDOWS}, m AS (SELECT max(date_diff('day', DATE '1970-01-01', d)) AS m, min(date_diff('day', DATE '1970-01-01', d)) AS f FROM win), p AS (SELECT e.src FROM edges e JOIN win a ON a.id = e.src JOIN win b ON b.id = e.tgt WHERE a.win = 'test' AND b.win <> 'test') SELECT CAST(max(m - f) AS BIGINT) AS span_days, round(avg(CAST(date_diff('day', DATE '1970-01-01', d) >= m - 91 AS INT)), 9) AS share_91, round(avg(CAST(date_diff('day', DATE '1970-01-01', d) >= m - 365 AS INT)), 9) AS share_365, (SELECT count(DISTINCT src) FROM p) AS sources, (SELECT count(*) FROM p) AS positives, '{name}' AS convention FROM win, m) q"
        for name, agg in (("l_shipdate", "min(CAST(l_shipdate AS DATE))"), ("l_shipdate + 30 days of odd orders", "min(CAST(l_shipdate AS DATE) + CASE WHEN l_orderkey % 2 = 1 THEN 30 ELSE 0 END)"), ("last l_shipdate", "max(CAST(l_shipdate AS DATE))"))
    ),
}
