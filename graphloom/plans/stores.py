"""Queries that write tables, documents and arrays, and read them by the library's own sources; and checks over two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import encoders as E
from ..operators import graph as G
from ..operators import jobs as J
from ..operators import text as T
from ..operators.tables import Scratch
from ..sources import runs as N
from ..sources import snapshots as S
from ..sources.arrays import Arrays
from ..streaming import arrivals
from . import floors
from . import registry as R


def graph_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the part graph from its snapshot; whether its hash holds when rows are dealt anew, and differs when one row does."""
    g = G.part_graph(spark, sf_dir)
    at = arrivals.folder(spark, "snapshot")
    S.write_graph(g.nodes, g.edges, at, dataset="parts")
    nodes, edges, summary = S.read_graph(spark, at)
    first = edges.agg(F.min(F.struct("src", "tgt")).alias("e"))
    changed = edges.join(F.broadcast(first)).select("src", F.when(F.struct("src", "tgt") == F.col("e"), -1).otherwise(F.col("tgt")).alias("tgt"))  # one row
    same, other = S.content_hash(edges.repartition(5)) == summary["edges"], S.content_hash(changed) != summary["edges"]
    stats = S.graph_stats(nodes, edges, date="d")
    return stats.withColumn("reciprocity", F.round("reciprocity", 9)).withColumns({"same_hash": F.lit(same), "other_hash": F.lit(other)})


def bundle_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text weights kept under a key of recipe and input: the second call finds them."""
    at = arrivals.folder(spark, "bundles")
    texts, win = floors.texts(spark, sf_dir), G.windows(G.part_graph(spark, sf_dir), R.SEED)
    for turn in range(2):
        df, had = S.cached(spark, at, {"recipe": repr(floors.BASE), "seed": R.SEED}, [texts], lambda: T.tfidf(texts, win.where("win = 'fit'").select("id"), floors.BASE))
        if had != bool(turn):
            raise ValueError("the cache doesn't follow its key")
    return df.select("id", "term", F.round("x", 6).alias("x"))


def _scored(config: dict) -> dict:
    return {"gain": config["mrr"] - config["floor"], "cell": f"{config['dataset']}/{config['model']}"}


def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each run: those of even seeds first, then all; every one has one result."""
    runs = R._spark(R.RUNS + " SELECT dataset, model, seed, mrr, floor FROM delta")(spark, sf_dir)
    jobs = runs.select("seed", F.concat_ws("/", "dataset", "model", "seed").alias("job"), F.to_json(F.struct("dataset", "model", "seed", "mrr", "floor")).alias("config"))
    at = arrivals.folder(spark, "jobs")
    J.run_jobs(jobs.where("seed % 2 = 0").select("job", "config"), _scored, at)
    done = J.run_jobs(jobs.select("job", "config"), _scored, at)
    return done.select("job", F.get_json_object("result", "$.cell").alias("cell"), F.round(F.get_json_object("result", "$.gain").cast("double"), 9).alias("gain"))


def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as one document each, with floors in the three shapes that they have had and models by name or alias, read as one table."""
    runs = R._spark(R.RUNS + " SELECT dataset, model, seed, mrr, floor FROM delta")(spark, sf_dir)
    low = F.substring("model", 1, 1)
    shape = lambda on, x: F.when(low.isin(*on), x)
    doc = F.to_json(F.struct("dataset", F.when(low == "1", "rcgat_sym").otherwise(F.col("model")).alias("model"), "seed", F.struct("mrr").alias("test"), F.coalesce(shape("12", F.struct(F.col("floor").alias("mrr"), F.lit(None).cast("struct<mrr:double>").alias("test"))), shape("34", F.struct(F.lit(None).cast("double").alias("mrr"), F.struct(F.col("floor").alias("mrr")).alias("test")))).alias("floor"), shape("5", F.col("floor")).alias("frozen_floor_test")))
    at = arrivals.folder(spark, "runs")
    runs.select(F.concat_ws("-", "dataset", low, "seed").alias("job"), doc.alias("value")).write.partitionBy("job").text(at)
    return N.latest(N.run_files(spark, f"{at}/*/*.txt")).select("dataset", "model", "seed", F.round("test_mrr", 9).alias("mrr"), F.round("floor", 9).alias("floor"))


def per_source_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ranks of every source written as arrays, of which two are read back."""
    spark.dataSource.register(Arrays)
    at = arrivals.folder(spark, "arrays")
    R.per_source(spark, sf_dir).write.format("arrays").mode("append").save(at)
    return spark.read.format("arrays").schema("source long, best_rank long").load(at)


_FEAT = "SELECT px.id, term, x / norm AS x FROM px JOIN pn ON pn.id = px.id"
#: Nodes whose content reaches no descriptor, and one whose content does.
_WHO = "free AS (SELECT id FROM win WHERE win <> 'fit' AND id NOT IN (SELECT tgt FROM fe)), planted AS (SELECT min(tgt) AS id FROM fe)"


def _described(who: str = "") -> str:
    sql = R.DESCRIPTORS
    if who:
        noise = f"SELECT px.id, term, CASE WHEN px.id IN (SELECT id FROM {who}) THEN 1 - x / norm ELSE x / norm END AS x FROM px JOIN pn ON pn.id = px.id"
        sql = sql.replace(_FEAT, noise).replace("feat AS", _WHO + ", feat AS")
    return sql + " SELECT id, " + ", ".join(f"round({c}, 6) AS {c}" for c in R.COLUMNS) + " FROM raw WHERE win = 'fit'"


#: What Spark's text has in place of the SQL's. NOT IN brings all of its list to the driver, and here no target is null; tables of a row for each node or edge are merged,
#: as copies of those under a broadcast's bound would be on the driver too, ten at a time.
_MERGED = (
    ("id NOT IN (SELECT tgt FROM fe)", "NOT EXISTS (SELECT 1 FROM fe WHERE fe.tgt = win.id)"),
    ("fe AS (SELECT e.src", "fe AS (SELECT /*+ MERGE(w) */ e.src"),
    ("SELECT px.id, term, ", "SELECT /*+ MERGE(pn) */ px.id, term, "),
    ("sim AS (SELECT f.src", "sim AS (SELECT /*+ MERGE(a, b) */ f.src"),
    ("aged AS (SELECT e.src", "aged AS (SELECT /*+ MERGE(a, b) */ e.src"),
    ("nin AS (SELECT e.tgt", "nin AS (SELECT /*+ MERGE(o) */ e.tgt"),
    ("nout AS (SELECT e.src", "nout AS (SELECT /*+ MERGE(i) */ e.src"),
    ("rec AS (SELECT a.src", "rec AS (SELECT /*+ MERGE(b) */ a.src"),
    ("raw AS (SELECT w.id", "raw AS (SELECT /*+ MERGE(cin, cout, din, dout, nin, nout, rec, rin, rout, cit) */ w.id"),
)


def _version(spark: SparkSession, sf_dir: str, who: str) -> DataFrame:
    """The descriptors of one version of the content."""
    sql = _described(who)
    for old, new in _MERGED:
        sql = sql.replace(old, new)
    return R._spark(sql)(spark, sf_dir)


def descriptor_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of fit nodes over two versions of the content: nothing moves with nodes out of the fit graph, something does with one in it.

    Each version is worked out and written by itself, so the driver holds one version's plan at a time.
    """
    with Scratch(spark) as scratch:
        described = lambda who: scratch.keep(_version(spark, sf_dir, who), "described")
        before = described("")
        rows = [C.differing(before, described(who)).withColumn("changed", F.lit(who)) for who in ("free", "planted")]
        return Scratch(spark).keep(rows[0].union(rows[1]), "invariance")


def delimiter_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiters in documents and pages, and those without a partner."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return C.unbalanced(docs.union(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p"), "page_id"), "html")))


_BOXES = "SELECT concat('c', CAST(c_custkey AS VARCHAR(20))) AS id, CAST(c_acctbal AS DOUBLE) AS x0, CAST(c_acctbal AS DOUBLE) + 40 AS x1, CAST(c_custkey AS DOUBLE) AS y0, CAST(c_custkey AS DOUBLE) + 25 AS y1 FROM customer UNION ALL SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))), CAST(s_acctbal AS DOUBLE), CAST(s_acctbal AS DOUBLE) + 40, CAST(s_suppkey AS DOUBLE), CAST(s_suppkey AS DOUBLE) + 25 FROM supplier"


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' and suppliers' boxes, of balance and number, that overlap."""
    return C.overlapping(R._spark(_BOXES)(spark, sf_dir), 40.0, 25.0)


def parameter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of every model for the content of the parts at hand: as many dimensions as their terms allow, 300 at most."""
    terms = T.terms(floors.texts(spark, sf_dir), floors.BASE).agg(F.count_distinct("term")).first()[0]
    rows = [(m, h, E.parameter_count(E.shape(m, min(300, terms - 1), h))) for m in E.MODELS for h in (64, 128)]
    return spark.createDataFrame(rows, "model string, hidden int, parameters long")


QUERIES = {f.__name__: f for f in (graph_snapshot, bundle_cache, job_results, run_documents, per_source_arrays, descriptor_invariance, delimiter_lint, box_overlaps, parameter_counts)}

_GRAPH = "SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT min(d) FROM nodes) AS first_date, (SELECT max(d) FROM nodes) AS last_date, (SELECT max(k) FROM (SELECT count(*) AS k FROM edges GROUP BY src) x) AS max_out, (SELECT count(DISTINCT src) FROM edges) AS with_out, (SELECT max(k) FROM (SELECT count(*) AS k FROM edges GROUP BY tgt) x) AS max_in, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT tgt FROM edges)) AS isolated, round((SELECT count(*) FROM edges a JOIN edges b ON a.src = b.tgt AND a.tgt = b.src) / (SELECT count(*) FROM edges), 9) AS reciprocity, true AS same_hash, true AS other_hash"
_COUNTED = """, m AS (SELECT * FROM (VALUES ('gat_dir', 'gat', 0, 0, 0), ('gcn_dir', 'gcn', 0, 0, 0), ('sage_dir', 'sage', 0, 0, 0), ('gatv2_dir', 'gatv2', 0, 0, 0), ('ragat_sym', 'gat', 1, 0, 0), ('gat_time', 'gat', 0, 1, 0), ('ragat_time', 'gat', 1, 1, 0), ('gat_asym', 'gat', 0, 0, 1), ('ragat_asym', 'gat', 1, 0, 1)) t(model, conv, gates, times, asym)),
 d AS (SELECT least(300, count(DISTINCT term) - 1) AS d FROM v_tf), w AS (SELECT *, CASE conv WHEN 'gat' THEN 4 * h * h + 9 * h WHEN 'gcn' THEN h * h + h WHEN 'sage' THEN 2 * h * h + h ELSE 8 * h * h + 13 * h END AS c FROM m, d, (VALUES (64), (128)) s(h))
 SELECT model, h AS hidden, CAST(2 * d * h + 2 * (2 * c + 2 * h * h + h) + 2 * h + 1 + 56 * gates + 2 * h * times + asym * (4 * d * 64 + 64 + 64 + 1) AS BIGINT) AS parameters FROM w"""


def _invariance() -> str:
    tables = ", ".join(f"t{k} AS ({R._duck(_described(who))})" for k, who in enumerate(("", "free", "planted")))
    count = lambda a, b: f"(SELECT count(*) FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}) q)"
    return f"WITH {tables} " + " UNION ALL ".join(f"SELECT {count('t0', f't{k}')} AS gone, {count(f't{k}', 't0')} AS new, '{who}' AS changed" for k, who in ((1, "free"), (2, "planted")))


_LINT = """WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages),
b AS (SELECT id, regexp_extract_all(text, '[()\\[\\]{}<>]') AS s FROM t), c AS (SELECT id, unnest(s) AS c, generate_subscripts(s, 1) AS i FROM b),
k AS (SELECT id, i, CASE WHEN c IN ('(', ')') THEN '()' WHEN c IN ('[', ']') THEN '[]' WHEN c IN ('<', '>') THEN '<>' ELSE '{}' END AS pair, CASE WHEN c IN ('(', '[', '{', '<') THEN 1 ELSE -1 END AS step FROM c),
r AS (SELECT *, sum(step) OVER (PARTITION BY id, pair ORDER BY i) AS run FROM k),
w AS (SELECT id, pair, count(*) AS marks, CAST(greatest(0, -min(run)) AS BIGINT) AS closes, CAST(sum(step) AS BIGINT) AS total FROM r GROUP BY 1, 2)
SELECT id, pair, marks, closes, total + closes AS opens FROM w"""
ORACLES = {
    "graph_snapshot": R._duck(_GRAPH),
    "bundle_cache": floors.ORACLES["fitted_weights"],
    "job_results": "WITH " + R.RUNS + " SELECT concat_ws('/', dataset, model, seed) AS job, concat_ws('/', dataset, model) AS cell, round(mrr - floor, 9) AS gain FROM delta",
    "run_documents": "WITH " + R.RUNS + " SELECT dataset, CASE WHEN model LIKE '1%' THEN 'ragat_sym' ELSE model END AS model, seed, round(mrr, 9) AS mrr, round(floor, 9) AS floor FROM delta",
    "per_source_arrays": f"SELECT source, best_rank FROM ({R.ORACLES['per_source']}) q",
    "descriptor_invariance": _invariance(),
    "delimiter_lint": _LINT,
    "box_overlaps": f"WITH b AS ({_BOXES}) SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON p.id < q.id AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1",
    "parameter_counts": R._duck(floors._TEXTS + ", fits AS (SELECT id FROM win WHERE win = 'fit'), " + floors._weights("v", floors.BASE) + _COUNTED),
}
