"""Audits as counts of what is wrong: over the tables as they are, and over copies with planted faults, so that every check can be seen to count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from . import registry as R

#: Ids beyond those of nodes.
FAR = 1_000_000_000
SEEDS = tuple(range(101, 111))


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("wrong")).select(F.lit(name).alias("check"), "wrong")


def _node_faults(nodes: DataFrame, win: DataFrame) -> list[DataFrame]:
    """(check, wrong) of nodes and their windows."""
    dated = win.select("id", "win").join(nodes, "id")
    ends = dated.groupBy("win").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    end = lambda w, c: ends.where(F.col("win") == w).select(F.col(c).alias(f"{w}_{c}"))
    borders = end("val", "low").crossJoin(end("test", "low"))  # one row
    early = dated.join(F.broadcast(borders)).where("(win = 'fit' AND d > val_low) OR (win IN ('fit', 'val') AND d > test_low)")
    return [
        _count(nodes.select("id").join(win, "id", "left_anti"), "nodes without a window"),
        _count(win.groupBy("id").agg(F.count_distinct("win").alias("k")).where("k > 1"), "nodes of two windows"),
        _count(early, "nodes before their window"),
    ]


def _edge_faults(nodes: DataFrame, edges: DataFrame, wins: list[DataFrame]) -> DataFrame:
    """(at, check, wrong) of versions of a graph: of version 0 the ``edges`` (src, tgt, since) with since 0, of version 1 all, each with its windows.

    An edge meets what is known of its source, then of its target, where equal edges are together: two
    exchanges serve all checks of all versions.
    """
    known = nodes.select("id", F.lit(1).alias("node"), *(F.lit(0).alias(f"{w}{v}") for v in range(len(wins)) for w in ("fit", "test")))
    for v, win in enumerate(wins):
        on = lambda w, at, v=v: ((F.col("win") == w).cast("int") if at == v else F.lit(0)).alias(f"{w}{at}")
        known = known.union(win.select("id", F.lit(0), *(on(w, at) for at in range(len(wins)) for w in ("fit", "test"))))
    known = known.groupBy("id").agg(*(F.sum(c).alias(c) for c in known.columns[1:]))
    of = lambda end: known.select(*(F.col(c).alias(end if c == "id" else f"{end}_{c}") for c in known.columns))
    rows = edges.join(of("src"), "src", "left").join(of("tgt"), "tgt", "left")
    rows = rows.groupBy("src", "tgt").agg(*(F.count_if(F.col("since") <= v).alias(f"k{v}") for v in range(len(wins))), *(F.max(F.coalesce(f"{end}_{c}", F.lit(0))).alias(f"{end}_{c}") for end in ("src", "tgt") for c in known.columns[1:]))
    wrong = {}
    for v in range(len(wins)):
        k = F.col(f"k{v}")
        wrong |= {
            (v, "loops"): F.when(F.col("src") == F.col("tgt"), k),
            (v, "repeated edges"): (k > 1).cast("int"),
            (v, "targets without a node"): F.when(F.col("tgt_node") == 0, k),
            (v, "sources without a node"): F.when(F.col("src_node") == 0, k),
            (v, "fit edges into the test window"): F.when(F.col(f"tgt_test{v}") > 0, k * F.col(f"src_fit{v}")),
        }
    one = rows.agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(f"c{i}") for i, x in enumerate(wrong.values())))  # one row
    return one.select(F.inline(F.array(*(F.struct(F.lit(v).alias("at"), F.lit(name).alias("check"), F.col(f"c{i}").alias("wrong")) for i, (v, name) in enumerate(wrong)))))


def audit_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the part graph, and of a copy with loops, repeats, ends without nodes and moved windows."""
    G.register(spark, sf_dir, R.SEED)
    nodes, edges, win = (spark.table(t) for t in ("nodes", "edges", "win"))
    win = win.select("id", "win")
    more = lambda where, tgt: F.when(where, tgt)
    planted = F.array_compact(F.array(more(F.col("src") % 97 == 0, F.col("src")), more(F.col("src") % 89 == 0, F.col("tgt")), more(F.col("src") % 83 == 0, F.col("tgt") + FAR)))
    marked = F.concat(F.array(F.struct("tgt", F.lit(0).alias("since"))), F.transform(planted, lambda t: F.struct(t.alias("tgt"), F.lit(1).alias("since"))))
    edges = edges.select("src", F.inline(marked))
    moved = win.withColumn("win", F.when((F.col("win") == "test") & (F.col("id") % 7 == 0), "fit").otherwise(F.col("win"))).where("id % 79 <> 0").union(win.where("id % 73 = 0").select("id", F.lit("val")))
    names = ("as it is", "planted")
    parts = [p.withColumn("of", F.lit(name)) for name, w in zip(names, (win, moved), strict=True) for p in _node_faults(nodes, w)]
    of = F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1)
    return reduce(DataFrame.union, parts, _edge_faults(nodes, edges, [win, moved]).select("check", "wrong", of.alias("of")))


def audit_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over ten seeds: how many different fit windows there are, whether the test window stays, and the band of the validation window."""
    g = G.part_graph(spark, sf_dir)
    nodes = G.Graph(g.nodes.persist(), g.edges)
    h = lambda w: F.sum(F.when(F.col("win") == w, F.xxhash64("id").cast("decimal(38,0)")))
    rows = [G.windows(nodes, s).agg(h("fit").alias("fit"), h("test").alias("test"), F.count_if(F.col("win") == "val").alias("val")) for s in SEEDS]
    every = reduce(DataFrame.union, rows)
    return every.agg(F.count_distinct("fit").alias("fit_windows"), F.count_distinct("test").alias("test_windows"), F.min("val").alias("val_low"), F.max("val").alias("val_high"))


def _run_faults(runs: DataFrame, recorded: DataFrame) -> DataFrame:
    """(check, wrong) of runs (dataset, model, seed, grid, mrr, floor, init) and of recorded means of contrasts."""
    cell = runs.groupBy("dataset", "model")
    twelve = cell.agg(F.count_distinct("seed").alias("k"), F.count("*").alias("n"), F.count_distinct("grid").alias("grids"))
    by_seed = runs.groupBy("dataset", "seed").agg((F.max("floor") - F.min("floor")).alias("gap"))
    now = runs.groupBy("dataset", "model").agg(F.avg(F.col("mrr") - F.col("floor")).alias("mean"))
    first = Window.partitionBy("dataset", "seed").orderBy(F.desc("mrr"), "model")
    picked = runs.withColumn("r", F.row_number().over(first)).where("r = 1").select("dataset", "seed", F.col("model").alias("best"))
    said = recorded.select("dataset", "seed", F.col("pick").alias("said")).where("said IS NOT NULL")
    wide: Column = F.abs(F.col("mean") - F.col("recorded")) > 1e-9
    parts = [
        _count(twelve.where("k <> 12 OR n <> 12"), "cells without a run for each seed"),
        _count(twelve.where("grids > 1"), "cells of several configurations"),
        _count(by_seed.where("gap > 1e-9"), "seeds whose models have different floors"),
        _count(runs.where("abs(init - floor) > 1e-9"), "runs that don't start at their floor"),
        _count(now.join(recorded.where("pick IS NULL").select("dataset", "model", "recorded"), ["dataset", "model"]).where(wide), "recorded means that aren't those of the runs"),
        _count(picked.join(said, ["dataset", "seed"]).where("best <> said"), "selections that aren't the best"),
    ]
    return reduce(DataFrame.union, parts)


def audit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of runs and of what was recorded of them: as they are, and with missing and repeated runs, moved floors and changed records."""
    runs = R._spark(R.RUNS + " SELECT dataset, model, seed, mrr, floor FROM delta")(spark, sf_dir).withColumns({"grid": F.lit("a"), "init": F.col("floor")})
    means = runs.groupBy("dataset", "model").agg(F.avg(F.col("mrr") - F.col("floor")).alias("recorded")).select("dataset", "model", F.lit(None).cast("int").alias("seed"), "recorded", F.lit(None).cast("string").alias("pick"))
    best = runs.groupBy("dataset", "seed").agg(F.max(F.struct("mrr", F.col("model").alias("m"))).alias("b")).select("dataset", F.lit(None).cast("string").alias("model"), F.col("seed").cast("int").alias("seed"), F.lit(None).cast("double").alias("recorded"), F.col("b.m").alias("pick"))
    said = means.union(best)
    low = F.substring("model", 1, 1)
    bad = runs.where(~((low == "1") & (F.col("seed") == 3)))
    bad = bad.union(bad.where((low == "2") & (F.col("seed") == 4)).withColumn("grid", F.lit("b")))
    bad = bad.withColumn("floor", F.col("floor") + F.when((low == "3") & (F.col("seed") == 5), 0.01).otherwise(0.0)).withColumn("init", F.col("init") + F.when((low == "4") & (F.col("seed") < 3), 0.1).otherwise(0.0))
    wrong = said.withColumn("pick", F.when(F.col("seed") % 5 == 0, "none").otherwise(F.col("pick"))).withColumn("recorded", F.col("recorded") + F.when(low == "5", 1e-3).otherwise(0.0))
    return _run_faults(runs, said).withColumn("of", F.lit("as it is")).union(_run_faults(bad, wrong).withColumn("of", F.lit("planted")))


QUERIES = {f.__name__: f for f in (audit_graph, audit_seeds, audit_runs)}

_CHECKS = """SELECT 'loops' AS check, count(*) AS wrong, '{of}' AS of FROM {e} WHERE src = tgt
UNION ALL SELECT 'repeated edges', count(*), '{of}' FROM (SELECT src, tgt FROM {e} GROUP BY 1, 2 HAVING count(*) > 1) q
UNION ALL SELECT 'targets without a node', count(*), '{of}' FROM {e} WHERE tgt NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'sources without a node', count(*), '{of}' FROM {e} WHERE src NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'nodes without a window', count(*), '{of}' FROM nodes WHERE id NOT IN (SELECT id FROM {w})
UNION ALL SELECT 'nodes of two windows', count(*), '{of}' FROM (SELECT id FROM {w} GROUP BY 1 HAVING min(win) <> max(win)) q
UNION ALL SELECT 'nodes before their window', count(*), '{of}' FROM {w} w JOIN nodes n ON n.id = w.id WHERE (w.win = 'fit' AND n.d > (SELECT min(y.d) FROM {w} x JOIN nodes y ON y.id = x.id WHERE x.win = 'val')) OR (w.win <> 'test' AND n.d > (SELECT min(y.d) FROM {w} x JOIN nodes y ON y.id = x.id WHERE x.win = 'test'))
UNION ALL SELECT 'fit edges into the test window', count(*), '{of}' FROM {e} e JOIN {w} a ON a.id = e.src AND a.win = 'fit' WHERE e.tgt IN (SELECT id FROM {w} WHERE win = 'test')"""
_BAD = f""", bad AS (SELECT src, tgt FROM edges UNION ALL SELECT src, src FROM edges WHERE src % 97 = 0 UNION ALL SELECT src, tgt FROM edges WHERE src % 89 = 0 UNION ALL SELECT src, tgt + {FAR} FROM edges WHERE src % 83 = 0),
moved AS (SELECT id, CASE WHEN win = 'test' AND id % 7 = 0 THEN 'fit' ELSE win END AS win FROM win WHERE id % 79 <> 0 UNION ALL SELECT id, 'val' FROM win WHERE id % 73 = 0) """
_RUN_CHECKS = """SELECT 'cells without a run for each seed' AS check, count(*) AS wrong, '{of}' AS of FROM (SELECT 1 FROM {r} GROUP BY dataset, model HAVING count(DISTINCT seed) <> 12 OR count(*) <> 12) q
UNION ALL SELECT 'cells of several configurations', count(*), '{of}' FROM (SELECT 1 FROM {r} GROUP BY dataset, model HAVING min(grid) <> max(grid)) q
UNION ALL SELECT 'seeds whose models have different floors', count(*), '{of}' FROM (SELECT 1 FROM {r} GROUP BY dataset, seed HAVING max(floor) - min(floor) > 1e-9) q
UNION ALL SELECT 'runs that don''t start at their floor', count(*), '{of}' FROM {r} WHERE abs(init - floor) > 1e-9
UNION ALL SELECT 'recorded means that aren''t those of the runs', count(*), '{of}' FROM (SELECT dataset, model, avg(mrr - floor) AS mean FROM {r} GROUP BY 1, 2) n JOIN {m} m ON m.dataset = n.dataset AND m.model = n.model WHERE abs(n.mean - m.recorded) > 1e-9
UNION ALL SELECT 'selections that aren''t the best', count(*), '{of}' FROM (SELECT dataset, seed, model FROM {r} QUALIFY row_number() OVER (PARTITION BY dataset, seed ORDER BY mrr DESC, model) = 1) n JOIN {b} b ON b.dataset = n.dataset AND b.seed = n.seed WHERE b.pick <> n.model"""
ORACLES = {
    "audit_graph": R._duck("x AS (SELECT 1)" + _BAD + _CHECKS.format(of="as it is", e="edges", w="win") + " UNION ALL " + _CHECKS.format(of="planted", e="bad", w="moved")),
    "audit_seeds": "SELECT count(DISTINCT fit) AS fit_windows, count(DISTINCT test) AS test_windows, min(val) AS val_low, max(val) AS val_high FROM ("
    + " UNION ALL ".join(f"SELECT * FROM (WITH {R.BASE.replace('{seed}', str(s))} SELECT count(*) FILTER (win = 'fit') AS fit, count(*) FILTER (win = 'test') AS test, count(*) FILTER (win = 'val') AS val FROM win) q" for s in SEEDS)
    + ") q",
    "audit_runs": "WITH " + R.RUNS + """, good AS (SELECT dataset, model, seed, mrr, floor, 'a' AS grid, floor AS init FROM delta), means AS (SELECT dataset, model, avg(mrr - floor) AS recorded FROM delta GROUP BY 1, 2),
best AS (SELECT dataset, seed, model AS pick FROM delta QUALIFY row_number() OVER (PARTITION BY dataset, seed ORDER BY mrr DESC, model) = 1),
b0 AS (SELECT * FROM good WHERE NOT (model LIKE '1%' AND seed = 3)), b1 AS (SELECT * FROM b0 UNION ALL SELECT dataset, model, seed, mrr, floor, 'b', init FROM b0 WHERE model LIKE '2%' AND seed = 4),
bad AS (SELECT dataset, model, seed, mrr, floor + CASE WHEN model LIKE '3%' AND seed = 5 THEN 0.01 ELSE 0 END AS floor, grid, init + CASE WHEN model LIKE '4%' AND seed < 3 THEN 0.1 ELSE 0 END AS init FROM b1),
means2 AS (SELECT dataset, model, recorded + CASE WHEN model LIKE '5%' THEN 1e-3 ELSE 0 END AS recorded FROM means), best2 AS (SELECT dataset, seed, CASE WHEN seed % 5 = 0 THEN 'none' ELSE pick END AS pick FROM best) """
    + _RUN_CHECKS.format(of="as it is", r="good", m="means", b="best") + " UNION ALL " + _RUN_CHECKS.format(of="planted", r="bad", m="means2", b="best2"),
}
