"""Queries over records that the tables are first written as: JSON, XML, listings, edge lists and streams.

Each query writes rows of a table in the format of a source, reads them by the library's scan, and
must give what its SQL takes from the table itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import graph as G
from ..operators import walks
from ..operators.spectral import spectral
from ..sources import packages as P
from ..streaming import arrivals
from . import registry as R


def _part(c: str) -> Column:
    return F.concat(F.lit("p"), F.col(c).cast("string"))


def packuments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part graph as npm records; every fifth has no tag, all have a dependency on a runtime module and on a stranger."""
    g = G.part_graph(spark, sf_dir)
    none = F.from_json(F.lit("{}"), "map<string,string>")
    deps = g.edges.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct(_part("tgt"), F.lit("^1")))).alias("deps"))
    rows = g.nodes.join(deps, F.col("id") == F.col("src"), "left").join(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), "p_name", "p_type", "p_brand"), "id", "left")
    held = F.map_concat(F.coalesce("deps", none), F.create_map(F.lit("node:fs"), F.lit("*"), F.lit("stranger"), F.lit("*")))
    day = F.date_format("d", "yyyy-MM-dd'T'00:00:00'Z'")
    doc = F.struct(
        _part("id").alias("name"),
        F.col("p_name").alias("description"),
        F.array("p_type", "p_brand").alias("keywords"),
        F.concat(F.lit("<b>"), "p_brand", F.lit("</b> \n\t read  me ")).alias("readme"),
        F.create_map(F.lit("created"), day, F.lit("1.0.0"), day, F.lit("2.0.0"), F.lit("2030-01-01T00:00:00Z")).alias("time"),
        F.when(F.col("id") % 5 != 0, F.create_map(F.lit("latest"), F.lit("1.0.0"))).alias("dist-tags"),
        F.create_map(F.lit("1.0.0"), F.struct(held.alias("dependencies")), F.lit("2.0.0"), F.struct(none.alias("dependencies"))).alias("versions"),
    )
    return rows.select(F.from_json(F.to_json(doc), P.NPM).alias("r")).select("r.*")


def npm_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.induce(P.npm_records(packuments(spark, sf_dir)))[1]


def npm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.npm_records(packuments(spark, sf_dir)).select("name", "date", "text")


def npm_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.npm_frontier(packuments(spark, sf_dir)).select("name", F.size("deps").alias("deps"))


def maven_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    doc = F.struct(F.concat(F.lit("g.h:p"), "p_partkey").alias("ga"), F.concat(F.lit("p"), "p_partkey").alias("artifact"), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("").alias("name"), F.concat(F.lit("<i>"), "p_type", F.lit("</i>")).alias("description"), F.when(F.col("p_size") > 2, F.lit("2020-01-01")).alias("first_date"), F.lit("2021-02-03").alias("latest_date"))
    return P.maven_records(part.select(F.from_json(F.to_json(doc), P.MAVEN).alias("r")).select("r.*")).select("name", "date", "text", P.maven_file(F.col("name")).alias("file"), P.maven_path(F.col("name")).alias("path"))


def pom_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as POMs, their lines as dependencies: returned ones are of scope test, fulfilled ones optional if the quantity is over 45."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    dep = F.concat(F.lit("<dependency><groupId>g</groupId><artifactId>p"), "l_partkey", F.lit("</artifactId><version>"), F.col("l_linenumber").cast("string"), F.lit("</version><scope>"), F.when(F.col("l_returnflag") == "R", "test").otherwise("compile"), F.lit("</scope><optional>"), F.when(F.col("l_quantity") > 45, "true").otherwise("false"), F.lit("</optional></dependency>"))
    poms = line.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", dep.alias("dep")))), lambda x: x["dep"]), "").alias("deps"))
    return P.pom_dependencies(poms.select("key", F.concat(F.lit('<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>g</groupId></parent><artifactId>o</artifactId><dependencies>'), "deps", F.lit("</dependencies></project>")).alias("pom")))


def listing_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    row = F.concat(F.lit('<a href="'), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", "-SNAPSHOT").otherwise(""), F.lit('/" title="x">x/</a>      '), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 10:00   -"))
    pages = orders.groupBy(F.col("o_custkey").alias("key")).agg(F.concat(F.lit('<a href="../">../</a>\n'), F.array_join(F.collect_list(row), "\n")).alias("html"))
    return P.listing_versions(pages)


def atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    entry = F.concat(F.lit("<entry><id>http://arxiv.org/abs/"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("v1</id><title> "), "p_type", F.lit("\n  x</title><summary>"), "p_brand", F.lit("</summary>"), F.when(F.col("p_size") > 5, "<published>2001-02-03T00:00:00Z</published>").otherwise(""), F.lit("</entry>"))
    batch = part.groupBy(F.floor(F.col("p_partkey") / 150).alias("b")).agg(F.array_join(F.collect_list(entry), "").alias("e"))
    rows = P.atom_entries(batch.select(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "e", F.lit("</feed>")).alias("xml")))
    return rows.select("id", "title", "summary", "published", P.id_year(F.col("id")).alias("year"))


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.part_graph(spark, sf_dir).edges
    return P.edge_lines(e.select(F.explode(F.array(F.concat_ws("\t", "src", "tgt"), F.concat(F.lit("# "), "src"), F.lit(" "))).alias("value")))


def more_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("name"), "p_size")
    return P.more_seeds(part.where("p_size < 5").groupBy("grp").agg(F.count("*").alias("k")), part.where("p_size >= 5").groupBy("grp").agg(F.count("*").alias("k")), part.select("grp", "name"), 7, 20, 100)


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the parts of the first day, until no part is new."""
    g = G.part_graph(spark, sf_dir)
    first = g.nodes.agg(F.min("d").alias("d"))
    seeds = g.nodes.join(F.broadcast(first), "d").select(F.col("id").alias("name"))
    return P.crawl(seeds, g.edges.select(F.col("src").alias("name"), F.col("tgt").alias("dep")))


def personal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the walk from all sources of the test window."""
    g = G.part_graph(spark, sf_dir)
    sources = G.observed(g, G.windows(g, R.SEED))[1].select("src").distinct()
    return walks.personal_rank(g.edges, sources).select("src", "id", F.round(F.col("score") + 1.3e-12, 9).alias("score"))


def singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 128 leading singular values of the normalised part graph."""
    s = spectral(G.part_graph(spark, sf_dir).edges, 128)[1]
    return spark.createDataFrame([(k, round(x, 3)) for k, x in enumerate(s)], "k int, value double")


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    runs = o.groupBy(F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("dataset"), F.col("o_orderpriority").alias("model"), F.month("o_orderdate").alias("seed")).agg((F.avg("o_totalprice") / 1e6).alias("mrr"))
    floor = runs.groupBy("dataset", "seed").agg(F.avg("mrr").alias("floor"))
    return runs.join(floor, ["dataset", "seed"]).select("dataset", "model", "seed", (F.col("mrr") - F.col("floor")).alias("diff"))


def paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.paired(_diffs(spark, sf_dir), ["dataset", "model"])
    return p.select("dataset", "model", "n", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), F.round("p", 6).alias("p"), "positive", "negative", "nearly_all", F.round(stats.sign_two_sided(F.col("positive"), F.col("n")), 6).alias("p_sign"))


def signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.signed_ranks(_diffs(spark, sf_dir), ["dataset", "model"])


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals.drained(arrivals.windowed(arrivals.arriving(spark, sf_dir, "events")), "windows")


def stream_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals.drained(arrivals.degrees(arrivals.arriving(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("tgt"))), "degrees")


QUERIES = {f.__name__: f for f in (npm_edges, npm_text, npm_frontier, maven_text, pom_dependencies, listing_versions, atom_entries, edge_lines, more_seeds, crawl, personal_rank, singular_values, paired_tests, signed_ranks, event_windows, stream_degrees)}
_base = lambda sql: R._duck(sql)
_DEGREES = "und AS (SELECT src, tgt FROM edges UNION SELECT tgt, src FROM edges), deg AS (SELECT src, count(*) AS k FROM und GROUP BY 1), step AS (SELECT u.src AS a, u.tgt AS b, CAST(0.15 AS DOUBLE) / k AS p FROM und u JOIN deg d ON d.src = u.src)"
ORACLES = {
    "npm_edges": _base("n AS (SELECT id, row_number() OVER (ORDER BY 'p' || id) - 1 AS at FROM nodes) SELECT a.at AS src, b.at AS tgt FROM edges e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.tgt"),
    "npm_text": _base("SELECT 'p' || id AS name, d AS date, 'p' || id || ' ' || p_name || ' ' || p_type || ' ' || p_brand || ' <b>' || p_brand || '</b> read me' AS text FROM nodes JOIN part ON p_partkey = id"),
    "npm_frontier": _base("SELECT 'p' || id AS name, CAST(CASE WHEN id % 5 = 0 THEN 0 ELSE 1 + (SELECT count(*) FROM edges WHERE src = id) END AS INT) AS deps FROM nodes"),
    "maven_text": "SELECT 'g.h:p' || p_partkey AS name, DATE '2021-02-03' AS date, CASE WHEN p_size > 10 THEN p_name ELSE 'p' || p_partkey END || ' ' || p_type AS text, 'g.h__p' || p_partkey || '.json' AS file, 'g/h/p' || p_partkey AS path FROM part WHERE p_size > 2",
    "pom_dependencies": "SELECT l_orderkey AS key, 'g:p' || l_partkey AS ga, CAST(max(l_linenumber) AS VARCHAR) AS version FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity <= 45 GROUP BY 1, 2",
    "listing_versions": "SELECT o_custkey AS key, CAST(o_orderkey AS VARCHAR) AS version, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus <> 'P'",
    "atom_entries": "SELECT id, title, summary, published, CAST(CASE WHEN y >= 90 THEN 1900 + y ELSE 2000 + y END AS INT) AS year FROM (SELECT lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS id, p_type || ' x' AS title, p_brand AS summary, DATE '2001-02-03' AS published, CAST(substring(lpad(CAST(p_partkey AS VARCHAR), 7, '0'), 1, 2) AS INT) AS y FROM part WHERE p_size > 5) x",
    "edge_lines": _base("SELECT lpad(CAST(src AS VARCHAR), 7, '0') AS src, lpad(CAST(tgt AS VARCHAR), 7, '0') AS tgt FROM edges"),
    "more_seeds": "WITH s AS (SELECT p_brand AS grp, sum(CAST(p_size < 5 AS INT)) + least(sum(CAST(p_size >= 5 AS INT)), 40) AS score FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7), o AS (SELECT s.grp, score, p_partkey AS name, row_number() OVER (PARTITION BY s.grp ORDER BY p_partkey) AS r FROM s JOIN part ON p_brand = s.grp) SELECT grp, name FROM (SELECT *, row_number() OVER (ORDER BY score DESC, grp, name) AS k FROM o WHERE r <= 20) x WHERE k <= 100",
    "crawl": "WITH RECURSIVE " + R.BASE.replace("{seed}", str(R.SEED)) + ", walk AS (SELECT id AS name, 0 AS level FROM nodes WHERE d = (SELECT min(d) FROM nodes) UNION SELECT e.tgt, level + 1 FROM walk JOIN edges e ON e.src = walk.name WHERE level < 30) SELECT name, min(level) AS level FROM walk GROUP BY 1",
    "personal_rank": _base(_DEGREES + ", w0 AS (SELECT DISTINCT e.src, e.src AS id, CAST(0.85 AS DOUBLE) AS s FROM edges e JOIN win w ON w.id = e.src WHERE w.win = 'test'), " + ", ".join(f"w{k} AS MATERIALIZED (SELECT w.src, b AS id, sum(s * p) AS s FROM w{k - 1} w JOIN step ON a = w.id GROUP BY 1, 2)" for k in range(1, 21)) + " SELECT src, id, round(sum(s) + 13e-13, 9) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(21)) + ") x GROUP BY 1, 2"),
    "paired_tests": R._duck(R.RUNS + ", g AS (SELECT dataset, model, count(*) AS n, avg(diff) AS mean, stddev_samp(diff) AS sd, CAST(sum(CAST(diff > 0 AS INT)) AS BIGINT) AS positive, CAST(sum(CAST(diff < 0 AS INT)) AS BIGINT) AS negative FROM delta GROUP BY 1, 2), a AS (SELECT *, n - 1 AS df, atan(abs(mean / (sd / sqrt(n))) / sqrt(n - 1)) AS q FROM g), s AS (SELECT dataset, model, sum(CASE WHEN df % 2 = 1 THEN exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(cos(q), 2 * k + 1) ELSE exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * ln(2)) * pow(cos(q), 2 * k) END) AS t FROM a, range(0, 500) r(k) WHERE k <= CASE WHEN df % 2 = 1 THEN (df - 3) // 2 ELSE (df - 2) // 2 END GROUP BY 1, 2), b AS (SELECT dataset, model, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) AS t FROM g, range(0, 500) r(k) WHERE k <= least(positive, n - positive) GROUP BY 1, 2) SELECT a.dataset, a.model, n, round(mean, 9) AS mean, round(sd, 9) AS sd, round(CASE WHEN df % 2 = 1 THEN 1 - 2 / pi() * (q + sin(q) * s.t) ELSE 1 - sin(q) * s.t END, 6) AS p, positive, negative, abs(positive - n / 2) >= n / 2 - 1 AS nearly_all, round(least(2 * b.t, 1), 6) AS p_sign FROM a JOIN s ON a.dataset = s.dataset AND a.model = s.model JOIN b ON a.dataset = b.dataset AND a.model = b.model", False),
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_degrees": "SELECT l_partkey AS id, count(*) AS degree FROM lineitem GROUP BY 1",
}
