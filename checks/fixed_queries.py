"""Models with fixed parameters, which SQL can follow: a forest of three trees, centres for each k,
principal components by their closed form, and a stored model read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import stages as s
from checks.ctes import Z, item_list, lof_tables
from checks.registry import query, table_folder
from shelfmark.operators import anomalies as a
from shelfmark.operators import iforest, kmeans, shapley
from shelfmark.operators.silhouette import silhouette
from shelfmark.plans import anomalies as jobs
from shelfmark.sources import sinks

# (tree, node, feature, threshold, left, right, samples); paths follow from depth and samples
SPLITS = [
    (0, 0, 4, 0.4, 1, 2, 256), (0, 1, 2, -0.3, 3, 4, 190), (0, 2, 0, 0.2, 5, 6, 66),
    (0, 3, -1, 0.0, -1, -1, 70), (0, 4, -1, 0.0, -1, -1, 120), (0, 5, -1, 0.0, -1, -1, 40), (0, 6, -1, 0.0, -1, -1, 26),
    (1, 0, 2, 1.5, 1, 2, 256), (1, 1, 6, 0.0, 3, 4, 240), (1, 2, -1, 0.0, -1, -1, 16),
    (1, 3, -1, 0.0, -1, -1, 150), (1, 4, -1, 0.0, -1, -1, 90),
    (2, 0, 1, -0.8, 1, 2, 256), (2, 1, -1, 0.0, -1, -1, 50), (2, 2, 5, 1.1, 3, 4, 206),
    (2, 3, -1, 0.0, -1, -1, 180), (2, 4, -1, 0.0, -1, -1, 26),
]
DEPTH = {(t, n): (0 if n == 0 else 1 if n < 3 else 2) for t, n, *_ in SPLITS}
COLUMNS = "tree int, node int, feature int, threshold double, `left` int, `right` int, samples int, path double"


def forest(spark, d):
    """The three trees for every cluster."""
    rows = [
        (*x, 0.0 if x[2] >= 0 else DEPTH[x[0], x[1]] + float(iforest.mean_path(x[6]))) for x in SPLITS
    ]
    nodes = spark.createDataFrame(rows, COLUMNS)
    return s.prepared(spark, d).select("Cluster").distinct().crossJoin(F.broadcast(nodes))


def mean_path_sql(n: str) -> str:
    return f"(2 * (ln({n} - 1) + 0.5772156649015329::DOUBLE) - 2 * ({n} - 1)::DOUBLE / {n})"


_VALUES = ", ".join(f"({t}, {n}, {f}, {x}::DOUBLE, {l}, {r}, {m}, {DEPTH[t, n]})" for t, n, f, x, l, r, m in SPLITS)
X = "[" + ", ".join(Z) + "]"
FOREST = {
    "nodes": f"SELECT * FROM (VALUES {_VALUES}) v(tree, node, feature, threshold, l, r, samples, depth)",
    "leaves": """
SELECT a.tree, a.feature AS f1, a.threshold AS t1, b.node = a.l AS left1, b.samples::DOUBLE / a.samples AS share1,
       b.feature AS f2, b.threshold AS t2, c.node = b.l AS left2, coalesce(c.samples::DOUBLE / b.samples, 1) AS share2,
       coalesce(c.depth, b.depth) + """ + mean_path_sql("coalesce(c.samples, b.samples)") + """ AS path
FROM nodes a JOIN nodes b ON b.tree = a.tree AND b.node IN (a.l, a.r)
LEFT JOIN nodes c ON c.tree = b.tree AND b.feature >= 0 AND c.node IN (b.l, b.r) WHERE a.node = 0""",
    "walked": f"""
SELECT p."Cluster", p.rule_id, avg(path) AS depth FROM (SELECT *, {X} AS x FROM prepared) p JOIN leaves l
ON (p.x[l.f1 + 1] <= l.t1) = l.left1 AND (l.f2 < 0 OR (p.x[l.f2 + 1] <= l.t2) = l.left2) GROUP BY ALL""",
    "scored": f"""
SELECT p.*, -power(2, -depth / {mean_path_sql("256")}) AS score
FROM prepared p JOIN walked w ON w."Cluster" = p."Cluster" AND w.rule_id = p.rule_id""",
    "counted": 'SELECT "Cluster", count(*) AS rules FROM prepared GROUP BY 1',
    "masks": "SELECT unnest(range(128)) AS mask",
    "games": f"""
SELECT p."Cluster", p.rule_id, mask, sum(path / 3
  * CASE WHEN (mask >> f1) & 1 = 0 THEN share1 WHEN (p.x[f1 + 1] <= t1) = left1 THEN 1 ELSE 0 END
  * CASE WHEN f2 < 0 THEN 1 WHEN (mask >> f2) & 1 = 0 THEN share2 WHEN (p.x[f2 + 1] <= t2) = left2 THEN 1 ELSE 0 END) AS v
FROM (SELECT *, {X} AS x FROM flagged WHERE iso = 1) p JOIN masks ON true JOIN leaves ON true GROUP BY ALL""",
    "shapley": """
SELECT g."Cluster", g.rule_id, f.i, sum((h.v - g.v) * gamma(bit_count(g.mask) + 1) * gamma(7 - bit_count(g.mask)) / gamma(8)) AS phi
FROM games g JOIN (SELECT unnest(range(7)) AS i) f ON (g.mask >> f.i) & 1 = 0
JOIN games h ON h."Cluster" = g."Cluster" AND h.rule_id = g.rule_id AND h.mask = g.mask | (1 << f.i) GROUP BY ALL""",
}


@query("isolation_forest_score_fixed", "Cluster; rule_id; iforest_score:6<score", "FROM scored", tables=FOREST)
def _(spark, d):
    return iforest.score_forest(s.prepared(spark, d), forest(spark, d), a.FEATURES)


@query("detect_anomalies_fixed", "Cluster; rule_id; isolation_forest_anomaly<CASE WHEN rules < 10 THEN 0 ELSE iso END; "
       "lof_anomaly<CASE WHEN rules < 10 THEN 0 ELSE lof END; combined_anomaly<CASE WHEN rules < 10 THEN 0 ELSE both_flags END; "
       "anomaly_score:6<CASE WHEN rules < 10 THEN 0 ELSE anomaly_score END",
       'FROM flagged JOIN counted USING ("Cluster")', tables=FOREST)
def _(spark, d):
    rules = s.prepared(spark, d)
    params = rules.select("Cluster").distinct().withColumns({"contamination": F.lit(0.07), "n_neighbors": F.lit(20)})
    return a.detect_anomalies(rules, params, forest=forest(spark, d)).rules


@query("predict_anomalies_fixed", "Cluster; rule_id; isolation_forest_anomaly<iso; anomaly_score:6", "FROM flagged", tables=FOREST)
def _(spark, d):
    trained = iforest.score_forest(s.prepared(spark, d), forest(spark, d), a.FEATURES)
    offsets = iforest.score_thresholds(trained, [0.07]).select("Cluster", F.col("threshold").alias("offset"))
    return a.predict_anomalies(s.rules(spark, d), forest(spark, d), offsets)


_NAMES = "[" + ", ".join(f"'{f}'" for f in a.FEATURES) + "]"


@query("explain_anomalies_fixed", f'Cluster; feature<{_NAMES}[i + 1]; importance:6<avg(abs(phi))',
       'FROM shapley GROUP BY "Cluster", i', tables=FOREST)
def _(spark, d):
    rates = s.prepared(spark, d).select("Cluster").distinct().withColumn("contamination", F.lit(0.07))
    scored = iforest.flag_forest(iforest.score_forest(s.prepared(spark, d), forest(spark, d), a.FEATURES), rates)
    return shapley.feature_importance(scored, forest(spark, d), a.FEATURES)


@query("dashboard_anomalies_fixed", "Cluster; rules; flagged; lowest:6",
       sql="""SELECT "Cluster", count(*) AS rules, sum(iso)::BIGINT AS flagged, round(min(anomaly_score), 6) AS lowest
FROM flagged GROUP BY 1""", tables=FOREST)
def _(spark, d):
    trained = iforest.score_forest(s.prepared(spark, d), forest(spark, d), a.FEATURES)
    offsets = iforest.score_thresholds(trained, [0.07]).select("Cluster", F.col("threshold").alias("offset"))
    found = iforest.with_decision(trained, offsets, "Cluster", "iforest_score")
    return found.groupBy("Cluster").agg(
        F.count("*").alias("rules"), F.sum(F.col("isolation_forest_anomaly").cast("bigint")).alias("flagged"),
        F.min("anomaly_score").alias("lowest"))


@query("dashboard_cluster_fixed", "Cluster; Rule; support; confidence; lift; anomaly_score",
       sql=f"""SELECT "Cluster", {item_list("a")} || ' → ' || {item_list("c")} AS "Rule",
 round_even(support, 4) AS support, round_even(confidence, 4) AS confidence,
 round_even(lift, 4) AS lift, round_even(anomaly_score, 4) AS anomaly_score
FROM flagged JOIN counted USING ("Cluster") WHERE iso = 1 AND rules >= 10 AND "Cluster" = 0""", tables=FOREST)
def _(spark, d):
    return a.anomalous_only(jobs.detect_in_cluster(s.rules(spark, d), 0, forest(spark, d)).rules)


def _by_cluster(i: int, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {c} THEN {v[i]}" for c, v in jobs.WORKFLOW.items()) + " END"


# the workflow's own rate and number of neighbours in each cluster
WORKFLOW = {
    **FOREST, **lof_tables(_by_cluster(1, "grp")),
    "thresholds": "SELECT \"Cluster\", CASE " + " ".join(
        f'WHEN "Cluster" = {c} THEN quantile_cont(score, {v[0]})' for c, v in jobs.WORKFLOW.items()) + " END AS thr FROM scored GROUP BY 1",
    "flagged": """
SELECT s.*, CASE WHEN n.rules < 10 THEN 0 ELSE score - thr END AS anomaly_score,
       (n.rules >= 10 AND score - thr < 0)::INTEGER AS iso, (n.rules >= 10 AND f.factor > 1.5)::INTEGER AS lof,
       (n.rules >= 10 AND score - thr < 0 AND f.factor > 1.5)::INTEGER AS both_flags
FROM scored s JOIN thresholds USING ("Cluster") JOIN counted n USING ("Cluster")
JOIN factors f ON f.grp = s."Cluster" AND f.id = s.rule_id""",
}


def workflow(spark, d):
    from checks.registry import once

    return once(spark, d, "workflow_fixed", lambda: jobs.anomaly_workflow(s.rules(spark, d), forest=forest(spark, d)))


@query("workflow_fixed_rules", "Cluster; rule_id; isolation_forest_anomaly<iso; lof_anomaly<lof; combined_anomaly<both_flags; anomaly_score:6",
       "FROM flagged", tables=WORKFLOW)
def _(spark, d):
    return workflow(spark, d).rules


@query("workflow_fixed_importance", f"Cluster; feature<{_NAMES}[i + 1]; importance:6<avg(abs(phi))",
       'FROM shapley GROUP BY "Cluster", i', tables=WORKFLOW)
def _(spark, d):
    return workflow(spark, d).importance


@query("isolation_forest_fit_consistent", "Cluster; trees<100; root_samples<least(256, count(*)); consistent<true",
       'FROM prepared GROUP BY "Cluster"')
def _(spark, d):
    """Of every tree: the sample's size, children that split their parent's sample, paths by depth."""
    nodes = s.forest(spark, d)
    root = nodes.where("node = 0").groupBy("Cluster").agg(
        F.count("*").cast("int").alias("trees"), F.max("samples").alias("root_samples"), F.min("samples").alias("least"))
    inner = nodes.where("feature >= 0")
    child = nodes.select("Cluster", "tree", F.col("node").alias("child"), F.col("samples").alias("part"))
    parts = inner.select("Cluster", "tree", "node", "samples", F.explode(F.array("left", "right")).alias("child"))
    split = parts.join(child, ["Cluster", "tree", "child"]).groupBy("Cluster", "tree", "node", "samples").agg(
        F.sum("part").alias("parts"), F.min("part").alias("fewest"))
    whole = split.groupBy("Cluster").agg(F.bool_and((F.col("parts") == F.col("samples")) & (F.col("fewest") > 0)).alias("split"))
    return root.join(whole, "Cluster").select(
        "Cluster", "trees", "root_samples", (F.col("split") & (F.col("least") == F.col("root_samples"))).alias("consistent"))


@query("model_store_read_back", "Cluster; tree; node; feature; threshold:6; samples",
       'FROM (SELECT DISTINCT "Cluster" FROM prepared) JOIN nodes ON true', tables=FOREST)
def _(spark, d):
    path = table_folder(spark, "fixed-forest")
    sinks.save_table(forest(spark, d), path)
    return sinks.load_table(spark, path)


# ---- segments ----
AXES = ("recency_z", "frequency_z", "monetary_z")


def _nearest_of(centres: list[list[float]]) -> str:
    away = [" + ".join(f"({z} - ({x!r}::DOUBLE)) * ({z} - ({x!r}::DOUBLE))" for z, x in zip(AXES, c)) for c in centres]
    listed = f"[{', '.join(away)}]"
    return f"list_position({listed}, list_min({listed})) - 1"


CENTRES = [[0.0, -0.5, -0.4], [1.6, -0.6, -0.5], [-0.7, 3.0, 2.5], [-0.8, 1.0, 6.0], [-0.6, 0.8, 0.7]]


@query("segmentation_fixed", "Cluster_Name; customers; guests; recency:4; monetary:4",
       sql="""SELECT CASE c WHEN 0 THEN 'Casual Buyers' WHEN 1 THEN 'Inactive Customers' WHEN 2 THEN 'Loyal High-Value Customers'
 WHEN 3 THEN 'VIP/Wholesale Customers' ELSE 'Frequent Mid-to-High Value Customers' END AS "Cluster_Name", count(*) AS customers,
 sum("IsGuest"::INTEGER)::BIGINT AS guests, round(avg("Recency"), 4) AS recency, round(avg("Monetary"), 4) AS monetary
FROM (SELECT *, """ + _nearest_of(CENTRES) + """ AS c FROM scaled) GROUP BY 1""")
def _(spark, d):
    """The segmentation job with a stored model: scaling is fitted, centres are given."""
    from shelfmark.operators.rfm import cluster_name

    customers = s.customers(spark, d)
    model = kmeans.SegmentModel(kmeans.fit_scaler(customers, kmeans.RFM), CENTRES, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])
    named = model.predict_cluster(customers).withColumn("Cluster_Name", cluster_name(F.col("Cluster")))
    return named.groupBy("Cluster_Name").agg(
        F.count("*").alias("customers"), F.sum(F.col("IsGuest").cast("bigint")).alias("guests"),
        F.avg("Recency").alias("recency"), F.avg("Monetary").alias("monetary"))


def grid(k: int) -> list[list[float]]:
    """Fixed centres: the first k of a scattered list."""
    return [[-0.9 + 0.45 * (i * 3 % 7), -0.4 + 0.8 * (i * 5 % 4), -0.3 + 0.9 * (i * 2 % 5)] for i in range(k)]


KS = range(2, 11)


def _nearest(k: int) -> str:
    return _nearest_of(grid(k))


GRID = {
    "placed": f"""SELECT "CustomerID", {", ".join(AXES)}, {", ".join(f"{_nearest(k)} AS k{k}" for k in KS)} FROM scaled""",
    "apart": f"""SELECT p."CustomerID", o."CustomerID" AS other, sqrt({" + ".join(f"(p.{z} - o.{z}) * (p.{z} - o.{z})" for z in AXES)}) AS d
FROM placed p JOIN placed o ON true""",
    "labels": " UNION ALL ".join(f'SELECT "CustomerID", {k} AS k, k{k} AS label FROM placed' for k in KS),
    "sums": """SELECT a."CustomerID", l.k, l.label, count(*) AS n, sum(a.d) AS total
FROM apart a JOIN labels l ON l."CustomerID" = a.other GROUP BY ALL""",
    "sides": """SELECT s."CustomerID", s.k, max(CASE WHEN s.label = m.label THEN n END) AS size,
 max(CASE WHEN s.label = m.label AND n > 1 THEN total / (n - 1) END) AS inner_d,
 min(CASE WHEN s.label <> m.label THEN total / n END) AS outer_d
FROM sums s JOIN labels m ON m."CustomerID" = s."CustomerID" AND m.k = s.k GROUP BY ALL""",
    "kscores": """SELECT k, avg(CASE WHEN size = 1 OR outer_d IS NULL THEN 0
 ELSE (outer_d - inner_d) / greatest(outer_d, inner_d) END) AS silhouette FROM sides GROUP BY 1""",
}


def k_scores(spark, d):
    rows = s.scaled(spark, d)
    for k in KS:
        rows = kmeans.assign_nearest(rows, s.SCALED, grid(k), f"k{k}")
    found = silhouette(rows, s.SCALED, [f"k{k}" for k in KS], "CustomerID")
    return found.select(F.substring("label", 2, 9).cast("int").alias("k"), "silhouette")


@query("select_k_fixed", "k; silhouette:6", "FROM kscores", tables=GRID)
def _(spark, d):
    return k_scores(spark, d)


@query("argmax_k_fixed", "k<arg_max(k, (silhouette, -k))", "FROM kscores", tables=GRID)
def _(spark, d):
    return spark.createDataFrame([(kmeans.argmax_k(k_scores(spark, d)),)], "k int")


@query("kmeans_centres_are_means", sql='SELECT 5 AS clusters, count(*) AS customers, true AS centred FROM scaled')
def _(spark, d):
    """A fit ends where each centre is the mean of the customers nearest to it, within its tolerance."""
    base = s.scaled(spark, d)
    centres = kmeans.fit_centres(base, s.SCALED, 5)
    means = kmeans.assign_nearest(base, s.SCALED, centres).groupBy("Cluster").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(s.SCALED)])
    held = spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], "Cluster int, c0 double, c1 double, c2 double")
    near = [F.abs(F.col(f"m{i}") - F.col(f"c{i}")) < 0.01 for i in range(3)]
    return means.join(F.broadcast(held), "Cluster").agg(
        F.count("*").cast("int").alias("clusters"), F.sum("n").alias("customers"), F.bool_and(near[0] & near[1] & near[2]).alias("centred"))


_COV = {f"{p[0]}{q[0]}": f"covar_pop({p}, {q})" for i, p in enumerate(AXES) for q in AXES[i:]}


@query("pca_2d_variances", "PC1_variance:6; PC2_variance:6; covariance:6",
       sql=f"""SELECT round(q + 2 * p * cos(phi), 6) AS "PC1_variance",
 round(3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)), 6) AS "PC2_variance", 0.0::DOUBLE AS covariance
FROM (SELECT q, p, acos(greatest(-1, least(1, ((rr - q) * ((ff - q) * (mm - q) - fm * fm) - rf * (rf * (mm - q) - fm * rm)
   + rm * (rf * fm - (ff - q) * rm)) / (2 * p * p * p)))) / 3 AS phi
 FROM (SELECT *, sqrt(((rr - q) ** 2 + (ff - q) ** 2 + (mm - q) ** 2 + 2 * (rf * rf + rm * rm + fm * fm)) / 6) AS p
  FROM (SELECT *, (rr + ff + mm) / 3 AS q FROM (SELECT {", ".join(f"{v} AS {k}" for k, v in _COV.items())} FROM scaled))))""")
def _(spark, d):
    found = kmeans.pca_2d(s.scaled(spark, d), s.SCALED)
    covariance = F.round(F.covar_pop("PC1", "PC2"), 6)
    return found.agg(
        F.var_pop("PC1").alias("PC1_variance"), F.var_pop("PC2").alias("PC2_variance"),
        F.when(covariance == 0, 0.0).otherwise(covariance).alias("covariance"))
