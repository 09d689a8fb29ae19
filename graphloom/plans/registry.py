"""The library's queries: DataFrame plans for the graph core, Spark SQL over its views for the rest.

Queries in SQL are written once. What the two dialects call differently has a name here, and
the oracle gets the graph's views as common table expressions of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import text as T
from ..operators import walks
from ..operators.tables import Scratch

Query = Callable[[SparkSession, str], DataFrame]
#: What Spark and DuckDB call the same thing.
DIALECT = {"ROUND_EVEN(": ("bround(", "round_even("), "DAYS(": ("unix_date(", "date_diff('day', DATE '1970-01-01', "), "PCT(": ("percentile(", "quantile_cont("), "UNNEST(": ("LATERAL explode(", "unnest("), "LIST_SIZE(": ("size(", "len("), "RANGE1(": ("sequence(1, ", "generate_series(1, "), "MATCHES(": ("regexp_like(", "regexp_matches("), "JSONK(": ("get_json_object(", "json_extract_string("), "HEX(": ("conv(", "concat('0x', "), "HEXEND": (", 16, 10)", ")")}
BASE = """nodes AS (SELECT l_partkey AS id, min(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY 1),
edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS tgt FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
placed AS (SELECT id, d, row_number() OVER (ORDER BY d, id) AS rn, count(*) OVER () AS n FROM nodes),
sized AS (SELECT *, CAST(round_even(CAST(0.07 AS DOUBLE) * n, 0) AS BIGINT) AS nt, greatest(CAST(round_even(CAST(0.08 AS DOUBLE) * CAST(0.05 AS DOUBLE) * n, 0) AS BIGINT), 12) AS v, CAST(round_even(CAST(0.08 AS DOUBLE) * n, 0) AS BIGINT) AS nv0 FROM placed),
stepped AS (SELECT *, 2 * v + 1 AS span, (SELECT min(a) FROM range(5, 65) t(a) WHERE gcd(a, 2 * v + 1) = 1) AS step FROM sized),
win AS (SELECT id, d, rn, n, CASE WHEN rn > n - nt THEN 'test' WHEN rn > n - nt - least(greatest(nv0 + (step * ({seed} % span)) % span - v, 1), n - nt - 1) THEN 'val' ELSE 'fit' END AS win FROM stepped)"""
#: Ranks of every source and candidate by their definition: what the plans must equal.
RANKED = """pool AS (SELECT id FROM win WHERE win <> 'test'),
pos AS (SELECT e.src, e.tgt FROM edges e JOIN win w ON e.src = w.id WHERE w.win = 'test'),
obs AS (SELECT e.src, e.tgt FROM edges e JOIN win w ON e.src = w.id WHERE w.win <> 'test'),
asks AS (SELECT DISTINCT src FROM pos),
und AS (SELECT src, tgt FROM obs UNION SELECT tgt, src FROM obs),
und_deg AS (SELECT src, count(*) AS deg FROM und GROUP BY 1),
scores AS ({scores}),
cand AS (SELECT a.src, p.id, coalesce(s.score, 0) AS score FROM asks a CROSS JOIN pool p LEFT JOIN scores s ON s.src = a.src AND s.id = p.id WHERE p.id <> a.src),
ranked AS (SELECT src, id, row_number() OVER (PARTITION BY src ORDER BY score DESC, id) AS rank FROM cand),
best AS (SELECT r.src, min(rank) AS best, count(*) AS k FROM ranked r JOIN pos p ON p.src = r.src AND p.tgt = r.id GROUP BY 1)"""
METRICS = "SELECT round(coalesce(avg(1.0 / CAST(best AS DOUBLE)), 0), 6) AS mrr, round(coalesce(avg(CAST(best <= 10 AS DOUBLE)), 0), 6) AS hits_10, round(coalesce(avg(CAST(best <= 100 AS DOUBLE)), 0), 6) AS hits_100, count(*) AS sources, CAST(coalesce(sum(k), 0) AS BIGINT) AS positives FROM best"
SCORES = {
    "degree": "SELECT a.src, d.id, d.score FROM asks a CROSS JOIN (SELECT tgt AS id, count(*) AS score FROM obs GROUP BY 1) d",
    "random": "SELECT a.src, p.id, CAST(0 AS DOUBLE) + ((p.id * 7919 + 104729) % 1000003) AS score FROM asks a CROSS JOIN pool p",
    "adj": "SELECT src, tgt AS id, 1.0 AS score FROM und",
    **{k: f"SELECT a.src, b.tgt AS id, round(sum({w}), 9) AS score FROM und a JOIN und b ON a.tgt = b.src JOIN und_deg g ON g.src = a.tgt JOIN asks q ON q.src = a.src WHERE a.src <> b.tgt GROUP BY 1, 2" for k, w in {"common_neighbors": "CAST(1 AS DOUBLE)", "adamic_adar": "CASE WHEN deg > 1 THEN 1 / ln(deg) ELSE 0 END", "resource_allocation": "CAST(1 AS DOUBLE) / deg"}.items()},
    "bit_adamic_adar": "SELECT u.src, u.tgt AS id, round(CASE WHEN deg > 1 THEN 1 / ln(deg) ELSE 0 END, 9) AS score FROM und u JOIN und_deg g ON g.src = u.src",
    "bit_resource": "SELECT u.src, u.tgt AS id, round(CAST(1 AS DOUBLE) / deg, 9) AS score FROM und u JOIN und_deg g ON g.src = u.src",
    "bit_normalized": "SELECT u.src, u.tgt AS id, round(1 / greatest(sqrt(CAST(a.deg AS DOUBLE) * b.deg), 1), 9) AS score FROM und u JOIN und_deg a ON a.src = u.src JOIN und_deg b ON b.src = u.tgt",
}
SEED = 101
#: From edges of the fit window's sources alone; features of a part are the TF-IDF terms of its name, brand and type.
DESCRIPTORS = """fe AS (SELECT e.src, e.tgt FROM edges e JOIN win w ON w.id = e.src WHERE w.win = 'fit'),
ptok AS (SELECT p_partkey AS id, t.w AS term FROM part, UNNEST(regexp_extract_all(lower(concat(p_name, ' ', p_brand, ' ', p_type)), '[a-z][a-z0-9_+#.-]*', 0)) AS t(w)),
ptf AS (SELECT id, term, 1 + ln(count(*)) AS tf FROM ptok GROUP BY 1, 2), pdf AS (SELECT term, ln((1 + (SELECT count(*) FROM part)) / (1 + count(*))) + 1 AS idf FROM ptf GROUP BY 1),
px AS (SELECT id, ptf.term, tf * idf AS x FROM ptf JOIN pdf ON pdf.term = ptf.term), pn AS (SELECT id, sqrt(sum(x * x)) + 1e-8 AS norm FROM px GROUP BY 1), feat AS (SELECT px.id, term, x / norm AS x FROM px JOIN pn ON pn.id = px.id),
sim AS (SELECT f.src, f.tgt, sum(a.x * b.x) AS c FROM fe f JOIN feat a ON a.id = f.src JOIN feat b ON b.id = f.tgt AND b.term = a.term GROUP BY 1, 2),
cin AS (SELECT tgt AS id, sum(c) AS c FROM sim GROUP BY 1), cout AS (SELECT src AS id, sum(c) AS c FROM sim GROUP BY 1),
dout AS (SELECT src AS id, count(*) AS k FROM fe GROUP BY 1), din AS (SELECT tgt AS id, count(*) AS k FROM fe GROUP BY 1),
cutoff AS (SELECT min(DAYS(d)) AS c FROM win WHERE id = (SELECT min(id) FROM win WHERE win = 'test')),
aged AS (SELECT e.src, e.tgt, DAYS(a.d) AS ds, ln(1 + greatest(DAYS(a.d) - DAYS(b.d), 0)) AS age FROM fe e JOIN win a ON a.id = e.src JOIN win b ON b.id = e.tgt),
nin AS (SELECT e.tgt AS id, avg(coalesce(o.k, 0)) AS x FROM fe e LEFT JOIN dout o ON o.id = e.src GROUP BY 1),
nout AS (SELECT e.src AS id, avg(coalesce(i.k, 0)) AS x FROM fe e LEFT JOIN din i ON i.id = e.tgt GROUP BY 1),
rec AS (SELECT a.src AS id, count(*) AS k FROM fe a JOIN fe b ON a.src = b.tgt AND a.tgt = b.src GROUP BY 1),
rin AS (SELECT tgt AS id, count(*) AS k FROM aged, cutoff WHERE ds >= c - 730 GROUP BY 1), rout AS (SELECT src AS id, count(*) AS k FROM aged, cutoff WHERE ds >= c - 730 GROUP BY 1),
cit AS (SELECT src AS id, avg(age) AS x FROM aged GROUP BY 1),
raw AS (SELECT w.id, w.win, ln(1 + coalesce(din.k, 0)) AS in_degree, ln(1 + coalesce(dout.k, 0)) AS out_degree, ln(1 + coalesce(nin.x, 0)) AS nn_in, ln(1 + coalesce(nout.x, 0)) AS nn_out, coalesce(cin.c, 0) / greatest(coalesce(din.k, 0), 1) AS cos_in, coalesce(cout.c, 0) / greatest(coalesce(dout.k, 0), 1) AS cos_out, coalesce(rec.k, 0) / greatest(coalesce(dout.k, 0), 1) AS recip_out, CAST(coalesce(din.k, 0) + coalesce(dout.k, 0) > 0 AS INT) AS has_edge, ln(1 + coalesce(rin.k, 0)) AS recent_in, ln(1 + coalesce(rout.k, 0)) AS recent_out, coalesce(rin.k, 0) / greatest(coalesce(din.k, 0), 1) AS recent_in_share, coalesce(cit.x, 0) AS cit_age, ln(1 + greatest(cutoff.c - DAYS(w.d), 0)) AS node_recency
 FROM win w CROSS JOIN cutoff LEFT JOIN cin ON cin.id = w.id LEFT JOIN cout ON cout.id = w.id LEFT JOIN din ON din.id = w.id LEFT JOIN dout ON dout.id = w.id LEFT JOIN nin ON nin.id = w.id LEFT JOIN nout ON nout.id = w.id LEFT JOIN rec ON rec.id = w.id LEFT JOIN rin ON rin.id = w.id LEFT JOIN rout ON rout.id = w.id LEFT JOIN cit ON cit.id = w.id)"""
COLUMNS = "in_degree out_degree nn_in nn_out cos_in cos_out recip_out has_edge recent_in recent_out recent_in_share cit_age node_recency".split()
TOKENS = "tok AS (SELECT doc_id, t.w AS term FROM documents, UNNEST(regexp_extract_all(lower(text), '[a-z][a-z0-9_+#.-]*', 0)) AS t(w))"
#: Draws of fit nodes for every fit source with k positives, of which the first 10 k that aren't positives are its negatives. Fit nodes have
#: the places 1 to n. Where 40 k < n, places are drawn by hash and repeats dropped, else all places are put in the order of a hash: a source
#: costs 40 k draws at most. That fewer than 11 k of 40 k draws differ has a chance below 1e-8 for k = 1, and less for more.
NEGATIVES = """pos AS (SELECT e.src, count(*) AS k FROM edges e JOIN win w ON w.id = e.src WHERE w.win = 'fit' GROUP BY 1), fits AS (SELECT count(*) AS n FROM win WHERE win = 'fit'),
asks AS (SELECT src, k, n, 40 * k < n AS few, least(40 * k, n) AS draws FROM pos CROSS JOIN fits),
drawn AS (SELECT a.src, a.k, a.n, a.few, t.j, CAST(HEX(substr(md5(concat(CAST(a.src AS VARCHAR(20)), ':', CAST(t.j AS VARCHAR(20)))), 1, 15)HEXEND AS BIGINT) AS h FROM asks a, UNNEST(RANGE1(a.draws)) AS t(j)),
held AS (SELECT src, k, CASE WHEN few THEN h % n + 1 ELSE j END AS place, min(CASE WHEN few THEN j ELSE h END) AS o FROM drawn GROUP BY 1, 2, 3)"""
#: Runs of models over seeds, made from orders so that every statistic has rows: group = dataset, month = seed, status and priority = model.
RUNS = """runs AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, o_orderpriority AS model, CAST(extract(month FROM o_orderdate) AS INT) AS seed, avg(o_totalprice) / 1e6 AS mrr, count(*) AS n FROM orders GROUP BY 1, 2, 3),
base AS (SELECT dataset, seed, avg(mrr) AS floor FROM runs GROUP BY 1, 2), delta AS (SELECT r.*, b.floor, r.mrr - b.floor AS diff FROM runs r JOIN base b ON r.dataset = b.dataset AND r.seed = b.seed)"""
SQL = {
    "graph_stats": "SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, round((SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes), 6) AS avg_degree, round((SELECT count(*) FROM edges a JOIN edges b ON a.src = b.tgt AND a.tgt = b.src) / (SELECT count(*) FROM edges), 6) AS reciprocity, (SELECT max(k) FROM (SELECT count(*) AS k FROM edges GROUP BY src) x) AS max_out, (SELECT max(k) FROM (SELECT count(*) AS k FROM edges GROUP BY tgt) y) AS max_in, (SELECT min(d) FROM nodes) AS first_date, (SELECT max(d) FROM nodes) AS last_date, (SELECT count(DISTINCT src) FROM edges) AS nodes_with_out",
    "degree_distribution": "SELECT k AS degree, count(*) AS nodes FROM (SELECT n.id, count(e.src) AS k FROM nodes n LEFT JOIN edges e ON e.src = n.id GROUP BY 1) x GROUP BY 1",
    "degree_ccdf": "SELECT k AS degree, round(sum(c) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(c) OVER (), 9) AS ccdf FROM (SELECT k, count(*) AS c FROM (SELECT count(*) AS k FROM edges GROUP BY tgt) x GROUP BY 1) y",
    "arrival_curve": "SELECT d, round(sum(c) OVER (ORDER BY d) / sum(c) OVER (), 9) AS share FROM (SELECT d, count(*) AS c FROM nodes GROUP BY 1) x",
    "date_profile": "SELECT CAST(max(DAYS(d)) - min(DAYS(d)) AS BIGINT) AS span_days, round(avg(CAST(DAYS(d) >= m - 91 AS INT)), 9) AS share_91, round(avg(CAST(DAYS(d) >= m - 365 AS INT)), 9) AS share_365, round(avg(CAST(DAYS(d) <= f + 25e-2 * (m - f) AS INT)), 9) AS share_first_quarter FROM nodes CROSS JOIN (SELECT max(DAYS(d)) AS m, min(DAYS(d)) AS f FROM nodes) x",
    "isolated_nodes": "SELECT count(*) AS isolated FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = n.id) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.tgt = n.id)",
    "mutual_edges": "SELECT a.src, a.tgt FROM edges a JOIN edges b ON a.src = b.tgt AND a.tgt = b.src WHERE a.src < a.tgt",
    "induced_edges": "SELECT e.src, e.tgt FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.tgt WHERE a.d >= DATE '1995-01-01' AND b.d >= DATE '1995-01-01'",
    "min_edges_nodes": "SELECT id FROM nodes WHERE id IN (SELECT src FROM edges UNION SELECT tgt FROM edges)",
    "node_windows": "SELECT id, d, rn, win FROM win",
    "split_sizes": "SELECT win, count(*) AS nodes, min(d) AS first_date, max(d) AS last_date FROM win GROUP BY 1",
    "edges_by_window": "SELECT w.win, count(*) AS edges, count(DISTINCT e.src) AS sources FROM edges e JOIN win w ON w.id = e.src GROUP BY 1",
    "edge_time": "SELECT e.src, e.tgt, round(ln(1 + greatest(DAYS(a.d) - DAYS(b.d), 0)), 6) AS edge_time FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.tgt",
    "split_scale": "SELECT a.win AS src_win, b.win AS tgt_win, count(*) AS edges, count(DISTINCT e.src) AS sources FROM edges e JOIN win a ON a.id = e.src JOIN win b ON b.id = e.tgt GROUP BY 1, 2",
    "leakage_antijoin": "SELECT count(*) AS blocked FROM edges p JOIN win w ON w.id = p.src WHERE w.win = 'test' AND EXISTS (SELECT 1 FROM edges f JOIN win x ON x.id = f.src WHERE x.win = 'fit' AND f.src = p.src AND f.tgt = p.tgt)",
    "two_hop": "SELECT a.src, b.tgt, count(*) AS paths FROM edges a JOIN edges b ON a.tgt = b.src GROUP BY 1, 2",
    "symmetrize": "SELECT src, tgt FROM edges UNION SELECT tgt AS src, src AS tgt FROM edges",
    "negatives": NEGATIVES + " SELECT src, id FROM (SELECT h.src, f.id, h.k, row_number() OVER (PARTITION BY h.src ORDER BY h.o, f.rn) AS r FROM held h JOIN win f ON f.rn = h.place WHERE NOT EXISTS (SELECT 1 FROM edges p WHERE p.src = h.src AND p.tgt = f.id)) x WHERE r <= 10 * k",
    "df_idf": TOKENS + " SELECT term, count(DISTINCT doc_id) AS df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(DISTINCT doc_id))) + 1, 6) AS idf FROM tok GROUP BY 1",
    "vocab_topk": TOKENS + " SELECT term, count(*) AS tf FROM tok GROUP BY 1 ORDER BY tf DESC, term LIMIT 20000",
    "tfidf_weights": TOKENS + ", tf AS (SELECT doc_id, term, 1 + ln(count(*)) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1), w AS (SELECT doc_id, tf.term, tf * idf AS x FROM tf JOIN df ON df.term = tf.term) SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM w",
    "text_clean": "SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' '{g}), '[ \t\n]+', ' '{g}))) AS clean_chars FROM pages",
    "html_links": "SELECT page_id, count(*) AS links FROM pages, UNNEST(regexp_extract_all(html, 'href=\"[^\"]+\"', 0)) AS t(x) GROUP BY 1",
    "namespace_groups": "SELECT CASE WHEN p_name LIKE '@%' THEN split_part(p_name, '/', 1) ELSE split_part(p_name, ' ', 1) END AS grp, count(*) AS parts FROM part GROUP BY 1",
    "event_props_json": "SELECT event_type, CAST(sum(CAST(JSONK(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS events FROM events GROUP BY 1",
    "cell_table": RUNS + " SELECT dataset, model, count(*) AS seeds, round(avg(mrr), 9) AS mean, round(coalesce(stddev_samp(mrr), 0), 9) AS sd, round(avg(diff), 9) AS delta_floor FROM delta GROUP BY 1, 2",
    "contrasts": RUNS + " SELECT a.dataset, a.model AS model_a, b.model AS model_b, count(*) AS n, round(avg(a.mrr - b.mrr), 9) AS mean, round(stddev_samp(a.mrr - b.mrr), 9) AS sd, CAST(sum(CAST(a.mrr > b.mrr AS INT)) AS BIGINT) AS positive, CAST(sum(CAST(a.mrr < b.mrr AS INT)) AS BIGINT) AS negative, round(avg(a.mrr - b.mrr) - 2201e-3 * stddev_samp(a.mrr - b.mrr) / sqrt(count(*)), 9) AS ci_low, round(avg(a.mrr - b.mrr) + 2201e-3 * stddev_samp(a.mrr - b.mrr) / sqrt(count(*)), 9) AS ci_high, (sum(CAST(a.mrr > b.mrr AS INT)) >= count(*) - 1 OR sum(CAST(a.mrr > b.mrr AS INT)) <= 1) AS rule_nearly_all, round(abs(avg(a.mrr - b.mrr)) / ((2201e-3 + 876e-3) * stddev_samp(a.mrr - b.mrr) / sqrt(count(*))), 6) AS mde_ratio FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.seed = b.seed AND a.model < b.model GROUP BY 1, 2, 3",
    "anova_two_way": RUNS + ", m AS (SELECT *, avg(mrr) OVER (PARTITION BY dataset) AS g, avg(mrr) OVER (PARTITION BY dataset, model) AS r, avg(mrr) OVER (PARTITION BY dataset, seed) AS c FROM runs) SELECT dataset, round(sum((r - g) * (r - g)), 9) AS ss_model, round(sum((c - g) * (c - g)), 9) AS ss_seed, round(sum((mrr - r - c + g) * (mrr - r - c + g)), 9) AS ss_rest, count(DISTINCT model) AS models, count(DISTINCT seed) AS seeds FROM m GROUP BY 1",
    "rank_stability": RUNS + ", k AS (SELECT dataset, seed, model, row_number() OVER (PARTITION BY dataset, seed ORDER BY mrr DESC, model) AS r FROM runs) SELECT a.dataset, a.seed AS seed_a, b.seed AS seed_b, round(corr(a.r, b.r), 6) AS spearman FROM k a JOIN k b ON a.dataset = b.dataset AND a.model = b.model AND a.seed < b.seed GROUP BY 1, 2, 3",
    "model_seed_corr": RUNS + " SELECT a.dataset, a.model AS model_a, b.model AS model_b, round(corr(a.mrr, b.mrr), 6) AS r FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.seed = b.seed AND a.model < b.model GROUP BY 1, 2, 3",
    "leave_one_out": RUNS + " SELECT dataset, model, seed, round((sum(mrr) OVER (PARTITION BY dataset, model) - mrr) / (count(*) OVER (PARTITION BY dataset, model) - 1), 9) AS loo FROM runs",
    "select_per_cell": RUNS + " SELECT dataset, seed, model FROM (SELECT *, row_number() OVER (PARTITION BY dataset, seed ORDER BY mrr DESC, model) AS r FROM runs) x WHERE r = 1",
    "select_shared": RUNS + " SELECT dataset, model FROM (SELECT dataset, model, row_number() OVER (PARTITION BY dataset ORDER BY avg(mrr) DESC, model) AS r FROM runs GROUP BY 1, 2) x WHERE r = 1",
    "trimmed_mean": RUNS + ", o AS (SELECT dataset, diff, row_number() OVER (PARTITION BY dataset ORDER BY diff, model, seed) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM delta) SELECT dataset, round(avg(diff), 9) AS trimmed, count(*) AS kept FROM o WHERE r > floor(n * 1e-1) AND r <= n - floor(n * 1e-1) GROUP BY 1",
    "mass_concentration": RUNS + ", o AS (SELECT dataset, diff, row_number() OVER (PARTITION BY dataset ORDER BY diff DESC, model, seed) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM delta) SELECT dataset, round(sum(CASE WHEN r <= greatest(1, floor(n / 20)) THEN diff ELSE 0 END) / greatest(sum(CASE WHEN diff > 0 THEN diff ELSE 0 END), 1e-12), 9) AS top_5_percent FROM o GROUP BY 1",
    "sign_counts": RUNS + " SELECT dataset, model, round(avg(CAST(diff > 0 AS INT)), 9) AS positive, round(avg(CAST(diff < 0 AS INT)), 9) AS negative, round(avg(CAST(diff = 0 AS INT)), 9) AS tied FROM delta GROUP BY 1, 2",
    "wilcoxon_stat": RUNS + ", o AS (SELECT dataset, model, diff, rank() OVER (PARTITION BY dataset, model ORDER BY abs(diff)) AS r, count(*) OVER (PARTITION BY dataset, model, abs(diff)) AS ties FROM delta WHERE diff <> 0) SELECT dataset, model, round(sum(CASE WHEN diff > 0 THEN r + (ties - 1) / 2 ELSE 0 END), 3) AS w_plus, round(sum(CASE WHEN diff < 0 THEN r + (ties - 1) / 2 ELSE 0 END), 3) AS w_minus FROM o GROUP BY 1, 2",
    "gate_distribution": RUNS + " SELECT dataset, round(avg(diff), 9) AS mean, round(stddev_pop(diff), 9) AS sd, round(PCT(abs(diff), 5e-1), 9) AS p50, round(PCT(abs(diff), 95e-2), 9) AS p95, round(avg(CAST(abs(diff) > 1e-3 AS INT)), 9) AS outside FROM delta GROUP BY 1",
    "strata_length": "SELECT s AS stratum, count(*) AS docs, round(avg(len_), 6) AS mean_chars FROM (SELECT len_, CASE WHEN len_ < q1 THEN 0 WHEN len_ < q2 THEN 1 WHEN len_ < q3 THEN 2 ELSE 3 END AS s FROM (SELECT length(text) AS len_ FROM documents) d CROSS JOIN (SELECT PCT(length(text), 25e-2) AS q1, PCT(length(text), 5e-1) AS q2, PCT(length(text), 75e-2) AS q3 FROM documents) q) x GROUP BY 1",
    "strata_group": "SELECT coalesce(t.source, 'other') AS grp, count(*) AS docs FROM documents d LEFT JOIN (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY 1) x WHERE r <= 6) t ON t.source = d.source GROUP BY 1",
    "prerelease_filter": "SELECT item, regexp_replace(item, '[^a-z]', '{e}'{g}) AS letters FROM (SELECT DISTINCT lower(p_type) AS item FROM part) x WHERE NOT MATCHES(item, '(alpha|beta|rc|snapshot|promo)')",
    "descriptors_raw": DESCRIPTORS + " SELECT id, " + ", ".join(f"round({c}, 6) AS {c}" for c in COLUMNS) + " FROM raw",
    "descriptors_z": DESCRIPTORS + ", m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) < 1e-6 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in COLUMNS) + " FROM raw WHERE win = 'fit') SELECT id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 5) AS {c}" for c in COLUMNS) + " FROM raw CROSS JOIN m",
    "audit_checks": "SELECT 'no_self_loops' AS check_id, (SELECT count(*) FROM edges WHERE src = tgt) = 0 AS ok UNION ALL SELECT 'no_duplicate_edges', (SELECT count(*) FROM edges) = (SELECT count(*) FROM (SELECT DISTINCT src, tgt FROM edges) x) UNION ALL SELECT 'windows_exhaustive', (SELECT count(*) FROM win) = (SELECT count(*) FROM nodes) UNION ALL SELECT 'fit_before_val', (SELECT max(d) FROM win WHERE win = 'fit') <= (SELECT min(d) FROM win WHERE win = 'val') UNION ALL SELECT 'val_before_test', (SELECT max(d) FROM win WHERE win = 'val') <= (SELECT min(d) FROM win WHERE win = 'test') UNION ALL SELECT 'ends_are_nodes', (SELECT count(*) FROM edges e LEFT JOIN nodes n ON n.id = e.tgt WHERE n.id IS NULL) = 0",
    "bootstrap_ci": RUNS + ", o AS (SELECT diff, row_number() OVER (ORDER BY dataset, model, seed) - 1 AS i, count(*) OVER () AS n FROM delta), b AS (SELECT r.b, o.i, o.n FROM o, UNNEST(RANGE1(10000)) AS r(b)), x AS (SELECT b.b, avg(p.diff) AS m FROM b JOIN o p ON p.i = CAST(HEX(substr(md5(concat(CAST(b.b AS VARCHAR(20)), ':', CAST(b.i AS VARCHAR(20)))), 1, 15)HEXEND AS BIGINT) % b.n GROUP BY 1) SELECT round(PCT(m, 25e-3), 9) + 0e0 AS low, round(PCT(m, 975e-3), 9) + 0e0 AS high FROM x",
}


def _dialect(sql: str, which: int) -> str:
    for name, forms in DIALECT.items():
        sql = sql.replace(name, forms[which])
    return sql.replace("{g}", ("", ", 'g'")[which]).replace("{e}", "")


def _split(sql: str) -> tuple[str, str]:
    """Leading common table expressions, and the query."""
    depth = 0
    for k, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if not depth and sql[k : k + 7] == "SELECT ":
            return sql[:k].strip(), sql[k:]
    raise ValueError(sql)


def _spark(sql: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        G.register(spark, sf_dir, SEED)
        head, body = _split(_dialect(sql, 0))
        return spark.sql(f"WITH {head} {body}" if head else body)

    return run


def _duck(sql: str, base: bool = True) -> str:
    head, body = _split(_dialect(sql, 1))
    return "WITH " + ", ".join(x for x in (BASE.replace("{seed}", str(SEED)) if base else "", head) if x) + " " + body


def _sources(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(source, best_rank, rr, n_reachable) of the test window's sources."""
    G.register(spark, sf_dir, SEED)
    pool, pos, obs = G.observed(G.Graph(spark.table("nodes"), spark.table("edges")), spark.table("win"))
    if kind == "degree":
        deg = obs.groupBy(F.col("tgt").alias("id")).agg(F.count("*").alias("score"))
        return G.per_source(G.rank_global(pool.join(deg, "id", "left").fillna(0, ["score"]), pos))
    if kind == "random":
        return G.per_source(G.rank_global(pool.withColumn("score", (F.col("id") * 7919 + 104729) % 1000003), pos))
    return G.best_sparse(pool, pos, G.paths(kind, obs, pos.select("src").distinct(), pool))


def _rank(kind: str) -> Query:
    return lambda spark, sf_dir: G.metrics(_sources(spark, sf_dir, kind))


def per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir, "degree")


def descriptors_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw descriptors, kept once, less their mean in the fit window and over their deviation there."""
    raw = Scratch(spark).keep(_spark(DESCRIPTORS + " SELECT * FROM raw")(spark, sf_dir), "descriptors")  # read by the result
    spread = lambda c: F.when(F.stddev_pop(c) < 1e-6, 1.0).otherwise(F.stddev_pop(c)).alias(f"s_{c}")
    m = raw.where("win = 'fit'").agg(*(F.avg(c).alias(f"m_{c}") for c in COLUMNS), *map(spread, COLUMNS))
    return raw.crossJoin(F.broadcast(m)).select("id", *(F.round((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), 5).alias(c) for c in COLUMNS))


def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    G.register(spark, sf_dir, SEED)
    return G.two_hop(spark.table("edges"))


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return T.document_weights(docs, "[a-z][a-z0-9_+#.-]*").select("doc_id", "term", F.round("x", 6).alias("weight"))


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    G.register(spark, sf_dir, SEED)
    return G.negatives(spark.table("edges"), spark.table("win"))


def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of every node that can be reached from the nodes of the first day; one frontier join a level, until none is new."""
    g = G.part_graph(spark, sf_dir)
    edges, nodes = g.edges.persist(), g.nodes.persist()
    first = nodes.agg(F.min("d").alias("d"))
    seen = walks.settled(nodes.join(F.broadcast(first), "d").select("id", F.lit(0).alias("level")))
    front, k = seen, 0
    while not front.isEmpty():
        k += 1
        step = front.select("id").join(edges, front.id == edges.src).select(F.col("tgt").alias("id")).distinct()
        front = walks.settled(step.join(seen, "id", "left_anti").withColumn("level", F.lit(k)))
        seen = seen.union(front)
    return seen


QUERIES: dict[str, Query] = {f"rank_{k}": _rank(k) for k in SCORES} | {"per_source": per_source, "bfs_levels": bfs_levels} | {k: _spark(v) for k, v in SQL.items()} | {f.__name__: f for f in (negatives, two_hop, tfidf_weights, descriptors_z)}
_ranked = lambda kind, tail: _duck(RANKED.replace("{scores}", SCORES[kind]) + " " + tail)
ORACLES: dict[str, str] = {f"rank_{k}": _ranked(k, METRICS) for k in SCORES} | {k: _duck(v) for k, v in SQL.items()}
ORACLES["per_source"] = _ranked("degree", "SELECT src AS source, best AS best_rank, round(1.0 / CAST(best AS DOUBLE), 9) AS rr, k AS n_reachable FROM best")
ORACLES["bfs_levels"] = "WITH RECURSIVE " + BASE.replace("{seed}", str(SEED)) + ", walk AS (SELECT id, 0 AS level FROM nodes WHERE d = (SELECT min(d) FROM nodes) UNION SELECT e.tgt, level + 1 FROM walk JOIN edges e ON e.src = walk.id WHERE level < 30) SELECT id, min(level) AS level FROM walk GROUP BY 1"
