"""Reports over runs, sources and windows: tables, joins and checks, each written once for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from . import registry as R

#: Values of sources (customers in 97 groups) by seed (month) and model (priority).
SOURCES = """per AS (SELECT o_custkey % 97 AS source, CAST(extract(month FROM o_orderdate) AS INT) AS seed, o_orderpriority AS model, avg(o_totalprice) / 1e6 AS rr FROM orders GROUP BY 1, 2, 3),
flo AS (SELECT source, seed, avg(rr) AS rr FROM per GROUP BY 1, 2)"""
#: Encoders, width, gates and time columns whose numbers of parameters are published.
SQL = {
    "graph_density": """SELECT n AS n_nodes, m AS n_edges, round(m / (CAST(n AS DOUBLE) * (n - 1)), 9) AS density, round(m / CAST(n AS DOUBLE), 6) AS avg_degree
        FROM (SELECT count(*) AS n FROM nodes) a CROSS JOIN (SELECT count(*) AS m FROM edges) b""",
    "scatter_mean": "SELECT e.src, round(avg(DAYS(n.d)), 6) AS mean_day, count(*) AS k FROM edges e JOIN nodes n ON n.id = e.tgt GROUP BY 1",
    "window_checks": """SELECT (SELECT count(*) FROM win) = (SELECT count(*) FROM nodes) AS sizes_sum,
        (SELECT count(*) FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.tgt) = (SELECT count(*) FROM edges) AS one_time_an_edge""",
    "pool_readings": """SELECT w.id AS src, f.n AS pool_a, a.n - 1 AS pool_b, (SELECT count(*) FROM win WHERE win = 'test') - 1 AS only_b
        FROM win w CROSS JOIN (SELECT count(*) AS n FROM win WHERE win <> 'test') f CROSS JOIN (SELECT count(*) AS n FROM win) a WHERE w.win = 'test'""",
    "final_seeds": R.RUNS + """ SELECT dataset, model, count(*) AS seeds, round(avg(mrr), 9) AS mean FROM runs
        WHERE seed IN (SELECT seed FROM runs GROUP BY 1 HAVING seed <> 12) GROUP BY 1, 2""",
    "missing_runs": R.RUNS + """, want AS (SELECT d.dataset, d.model, s.seed FROM (SELECT DISTINCT dataset, model FROM runs) d CROSS JOIN (SELECT DISTINCT seed FROM runs UNION SELECT 13) s)
        SELECT w.dataset, w.model, w.seed FROM want w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.dataset = w.dataset AND r.model = w.model AND r.seed = w.seed)""",
    "recorded_contrasts": R.RUNS + """, now AS (SELECT dataset, model, avg(diff) AS mean FROM delta GROUP BY 1, 2),
        recorded AS (SELECT dataset, model, round(mean, 4) + CASE WHEN model LIKE '5%' THEN 1e-3 ELSE 0 END AS mean FROM now)
        SELECT n.dataset, n.model, round(n.mean, 9) AS mean, abs(n.mean - r.mean) <= 6e-5 AS agrees FROM now n LEFT JOIN recorded r ON r.dataset = n.dataset AND r.model = n.model""",
    "within_config": R.RUNS + """ SELECT a.dataset, a.seed AS grid_id, round(a.mrr - b.mrr, 9) AS diff, a.mrr > b.mrr AS gate_wins
        FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.seed = b.seed AND a.model LIKE '1%' AND b.model LIKE '2%'""",
    "tuning_table": R.RUNS + " SELECT dataset, model, row_number() OVER (PARTITION BY dataset, model ORDER BY seed) AS place, seed AS grid_id, round(mrr, 9) AS mrr FROM runs",
    "floor_rows": R.RUNS + """ SELECT dataset, count(*) AS seeds, round(avg(floor), 9) AS mean, round(coalesce(stddev_samp(floor), 0), 9) AS sd, round(min(floor), 9) AS low, round(max(floor), 9) AS high
        FROM base GROUP BY 1""",
    "shared_config": R.RUNS + """, g AS (SELECT model, seed AS grid_id, count(*) AS cells, avg(mrr) AS mean FROM runs GROUP BY 1, 2)
        SELECT model, grid_id, round(mean, 9) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean DESC, grid_id) AS r FROM g WHERE cells = (SELECT count(DISTINCT dataset) FROM runs)) x WHERE r = 1""",
    "epoch_curve": R.RUNS + " SELECT seed AS epoch, round(PCT(mrr, 5e-1), 9) AS median, round(max(mrr), 9) AS best, max_by(concat(dataset, ' ', model), mrr) AS best_run FROM runs GROUP BY 1",
    "seed_index": R.RUNS + " SELECT dataset, seed, row_number() OVER (PARTITION BY dataset ORDER BY seed) AS seed_index FROM base",
    "top_responses": R.RUNS + """, c AS (SELECT dataset, model, corr(mrr, floor) AS r FROM delta GROUP BY 1, 2)
        SELECT dataset, model, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY abs(r) DESC, model) AS k FROM c) x WHERE k <= 5""",
    "best_by_mean": R.RUNS + """, m AS (SELECT dataset, model, avg(mrr) AS mean, stddev_samp(mrr) AS sd, avg(diff) AS gain, count(*) AS n FROM delta GROUP BY 1, 2)
        SELECT m.dataset, model, round(mean, 9) AS mean, round(sd, 9) AS sd, round(gain, 9) AS gain, mean = top AS best FROM m JOIN (SELECT dataset, max(mean) AS top FROM m GROUP BY 1) t ON t.dataset = m.dataset""",
    "detectable_effects": R.RUNS + """ SELECT dataset, model, round((2262e-3 + 883e-3) * stddev_samp(diff) / sqrt(count(*)), 9) AS mde,
        round(abs(avg(diff)) / ((2262e-3 + 883e-3) * stddev_samp(diff) / sqrt(count(*))), 6) AS ratio FROM delta GROUP BY 1, 2""",
    "published_values": R.RUNS + """, said AS (SELECT * FROM (VALUES ('even', 150e-3), ('odd', 100e-3), ('none', 1e-1)) t(dataset, mrr)), m AS (SELECT dataset, avg(mrr) AS mrr FROM runs GROUP BY 1)
        SELECT s.dataset, s.mrr AS published, round(m.mrr, 9) AS ours, round(m.mrr - s.mrr, 9) AS diff, coalesce(abs(m.mrr - s.mrr) <= 5e-2, false) AS near FROM said s LEFT JOIN m ON m.dataset = s.dataset""",
    "source_floor_join": SOURCES + """ SELECT p.model, p.source, count(*) AS seeds, round(avg(p.rr - f.rr), 9) AS diff FROM per p JOIN flo f ON f.source = p.source AND f.seed = p.seed
        GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT seed) FROM per)""",
    "common_sources": SOURCES + """ SELECT source FROM per GROUP BY 1
        HAVING count(DISTINCT concat(CAST(seed AS VARCHAR(5)), model)) = (SELECT count(DISTINCT concat(CAST(seed AS VARCHAR(5)), model)) FROM per)""",
    "mass_shares": SOURCES + """, o AS (SELECT p.model, p.rr - f.rr AS diff, row_number() OVER (PARTITION BY p.model ORDER BY p.rr - f.rr DESC, p.source, p.seed) AS r, count(*) OVER (PARTITION BY p.model) AS n
        FROM per p JOIN flo f ON f.source = p.source AND f.seed = p.seed)
        SELECT model, round(sum(CASE WHEN r <= greatest(1, floor(n / 100)) THEN diff ELSE 0 END) / greatest(sum(CASE WHEN diff > 0 THEN diff ELSE 0 END), 1e-12), 9) AS top_1_percent,
        round(sum(CASE WHEN r <= greatest(1, floor(n / 20)) THEN diff ELSE 0 END) / greatest(sum(CASE WHEN diff > 0 THEN diff ELSE 0 END), 1e-12), 9) AS top_5_percent FROM o GROUP BY 1""",
    "stale_numbers": """pats AS (SELECT * FROM (VALUES ('brushed'), ('^small'), ('copper$')) t(pat)), said AS (SELECT p_partkey, lower(p_type) AS line FROM part WHERE p_type NOT LIKE '#%' AND p_size <> 1)
        SELECT pat, count(*) AS hits FROM said CROSS JOIN pats WHERE MATCHES(line, pat) GROUP BY 1""",
}
#: Scores on the symmetric graph of observed edges; those of a pair's common neighbours are in ``registry``.
SCORES = {
    "symmetric_degree": "SELECT a.src, g.src AS id, g.deg AS score FROM asks a CROSS JOIN und_deg g",
    "preferential": "SELECT a.src, g.src AS id, g.deg * own.deg AS score FROM asks a JOIN und_deg own ON own.src = a.src CROSS JOIN und_deg g",
    "normalised_neighbors": "SELECT a.src, b.tgt AS id, round(count(*) / greatest(sqrt(CAST(x.deg * y.deg AS DOUBLE)), 1), 9) AS score FROM und a JOIN und b ON a.tgt = b.src JOIN asks q ON q.src = a.src JOIN und_deg x ON x.src = a.src JOIN und_deg y ON y.src = b.tgt WHERE a.src <> b.tgt GROUP BY a.src, b.tgt, x.deg, y.deg",
}


def _sources(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    g = G.part_graph(spark, sf_dir)
    pool, pos, obs = G.observed(g, G.windows(g, R.SEED))
    if kind == "normalised_neighbors":
        return G.best_sparse(pool, pos, G.paths(kind, obs, pos.select("src").distinct(), pool))
    deg = G.symmetric(obs).groupBy("src").agg(F.count("*").alias("deg"))
    scored = pool.join(deg.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("score"))
    if kind == "symmetric_degree":
        return G.per_source(G.rank_global(scored, pos))
    # a source's own degree scales all its scores alike, and without neighbours they are all 0
    known = pos.join(deg, "src", "left_semi")
    return G.per_source(G.rank_global(scored, known).union(G.rank_global(pool.withColumn("score", F.lit(0)), pos.join(deg, "src", "left_anti"))))


def _rank(kind: str) -> R.Query:
    return lambda spark, sf_dir: G.metrics(_sources(spark, sf_dir, kind))


QUERIES: dict[str, R.Query] = {k: R._spark(v) for k, v in SQL.items()} | {f"rank_{k}": _rank(k) for k in SCORES}
ORACLES: dict[str, str] = {k: R._duck(v) for k, v in SQL.items()} | {f"rank_{k}": R._duck(R.RANKED.replace("{scores}", v) + " " + R.METRICS) for k, v in SCORES.items()}
