"""Queries on outliers among rules, their explanation and strategies."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import functions as F

from checks import stages as s
from checks.ctes import METRIC, Z, item_list, lof_tables
from checks.registry import query, table_folder
from checks.rule_queries import KEY
from shelfmark.functions.numeric import infinity, mean_of
from shelfmark.operators import anomalies as a
from shelfmark.operators import contamination as ct
from shelfmark.operators import iforest, lof, neighbours, shapley, strategy
from shelfmark.operators.scaling import median_impute
from shelfmark.plans import anomalies as jobs
from shelfmark.sources import sinks
from shelfmark.sources.retail import RULE_METRICS
from shelfmark.sources.star import table

NORM = "; ".join(f"{m}_normalized:6<{m}_z" for m in METRIC.values())
FLAGS = {"isolation_forest_anomaly": "iso", "lof_anomaly": "lof", "combined_anomaly": "both_flags"}
FLAG_SPEC = "; ".join(f"{f}<{c}" for f, c in FLAGS.items())


def snake(df):
    """Normalised metric columns without blanks in their names."""
    return df.withColumnsRenamed({f"{m}_normalized": f"{v}_normalized" for m, v in METRIC.items()})


# ---- preparation ----
@query("preprocess_rules", f"Cluster; rule_id; {NORM}", "FROM prepared")
def _(spark, d):
    return snake(a.preprocess_rules(s.rules(spark, d)))


@query("row_align", f"Cluster; rule_id; lift:6; {NORM}", "FROM prepared")
def _(spark, d):
    return snake(s.prepared(spark, d))


@query("sort_by_rule_id", "Cluster; rule_id", "FROM prepared ORDER BY rule_id")
def _(spark, d):
    return a.sort_by_rule_id(s.prepared(spark, d))


@query("feature_select", f"Cluster; rule_id; {NORM}", "FROM prepared")
def _(spark, d):
    return snake(a.feature_rows(s.prepared(spark, d)))


@query("median_impute_rules", "Cluster; rule_id; conviction:6",
       sql="""SELECT "Cluster", rule_id, round(coalesce(v, median(v) OVER (PARTITION BY "Cluster")), 6)
 AS conviction FROM (SELECT *, CASE WHEN confidence < 0.5 THEN conviction END AS v FROM prepared)""")
def _(spark, d):
    holed = s.prepared(spark, d).withColumn(
        "conviction", F.when(F.col("confidence") < 0.5, F.col("conviction")).otherwise(infinity())
    )
    return median_impute(holed, ["conviction"], ["Cluster"])


@query("small_group_guard", "Cluster",
       'FROM (SELECT "Cluster" FROM prepared GROUP BY 1 HAVING count(*) < 30)')
def _(spark, d):
    return a.small_groups(s.prepared(spark, d), least=30)


# ---- local outlier factor ----
@query("knn_self_join", "Cluster<grp; point; near; d:6; times", "FROM near")
def _(spark, d):
    points, _ = neighbours.distinct_points(s.prepared(spark, d), "Cluster", "rule_id", a.FEATURES)
    sizes = points.groupBy("Cluster").agg(F.sum("copies").alias("n"))
    found = neighbours.nearest_neighbours(points, "Cluster", 20).join(sizes, "Cluster")
    k = F.least(F.lit(20), F.col("n") - 1)
    return found.withColumn("times", F.least(F.col("copies"), k - F.col("before"))).where(
        F.col("times") > 0
    )


@query("lof", "Cluster<grp; rule_id<id; lof_score:6<-factor; lof_anomaly<(factor > 1.5)::INTEGER",
       "FROM factors")
def _(spark, d):
    return lof.lof(s.prepared(spark, d), a.FEATURES, 20)


EMBEDDED = {
    "vectors": "SELECT label AS grp, vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings",
    **lof_tables("10"),
}


def embedded(spark, d):
    names = [f"e{i}" for i in range(64)]
    return names, table(spark, d, "embeddings").select(
        "vec_id", "label",
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
    )


@query("lof_embeddings", "label<grp; vec_id<id; lof_score:6<-factor; "
       "lof_anomaly<(factor > 1.5)::INTEGER", "FROM factors", tables=EMBEDDED)
def _(spark, d):
    names, vectors = embedded(spark, d)
    return lof.lof(vectors, names, 10, "label", "vec_id")


CUSTOMER_LOF = {
    "vectors": 'SELECT "Cluster" AS grp, "CustomerID" AS id, '
    "[recency_z, frequency_z, monetary_z] AS x FROM seg",
    **lof_tables("15"),
}


@query("lof_customers", "Cluster<grp; CustomerID<id; lof_score:5<-factor", "FROM factors",
       tables=CUSTOMER_LOF)
def _(spark, d):
    rows = s.scaled(spark, d).join(s.segments(spark, d).select("CustomerID", "Cluster"), "CustomerID")
    return lof.lof(rows, s.SCALED, 15, "Cluster", "CustomerID")


def k_tables() -> dict[str, str]:
    """Factors for every analysed k, as one table."""
    out, parts = {}, []
    for k in lof.K_VALUES:
        renamed = lof_tables(str(k))
        for name, sql in renamed.items():
            for other in renamed:
                sql = sql.replace(f"FROM {other} ", f"FROM {other}{k} ")
                sql = sql.replace(f"FROM {other}\n", f"FROM {other}{k}\n")
                sql = sql.replace(f"JOIN {other} ", f"JOIN {other}{k} ")
            out[f"{name}{k}"] = sql
        parts.append(f"SELECT grp, id, {k} AS k, round(factor, 9) AS factor FROM factors{k} ")
    out["manyfactors"] = " UNION ALL ".join(parts)
    out["ranked"] = """SELECT *, rank() OVER (PARTITION BY grp, k ORDER BY factor)
 + (count(*) OVER (PARTITION BY grp, k, factor) - 1) / 2 AS r,
 dense_rank() OVER (PARTITION BY grp, id ORDER BY k) AS step FROM manyfactors"""
    return out


@query("lof_parameter_analysis", "Cluster<grp; rule_id<id; k; factor:6", "FROM manyfactors",
       tables=k_tables())
def _(spark, d):
    return s.many_factors(spark, d).withColumn("factor", F.round("factor", 9))


@query("score_stats", "Cluster<grp; k; mean:6<avg(-factor); std:5<stddev_pop(-factor); "
       "min:6<min(-factor); max:6<max(-factor); "
       "outliers_percent:4<avg((-factor < -1)::INTEGER) * 100",
       "FROM manyfactors GROUP BY grp, k", tables=k_tables())
def _(spark, d):
    return lof.score_stats(s.many_factors(spark, d).withColumn("factor", F.round("factor", 9)))


@query("consecutive_pairs", "Cluster<x.grp; k<x.k; next<y.k; spearman:6<corr(x.r, y.r)",
       "FROM ranked x JOIN ranked y ON x.grp = y.grp AND x.id = y.id AND y.step = x.step + 1 "
       "GROUP BY x.grp, x.k, y.k", tables=k_tables())
def _(spark, d):
    scores = s.many_factors(spark, d).withColumn("factor", F.round("factor", 9))
    return lof.spearman_of_neighbours(scores, "Cluster", "rule_id", "k", "factor")


# ---- scores, thresholds, flags ----
RATE_TABLES = {
    "thresholds": " UNION ALL ".join(
        f'SELECT "Cluster", {r}::DOUBLE AS rate, {i} AS step, quantile_cont(score, {r}) AS threshold '
        "FROM scored GROUP BY 1" for i, r in enumerate(ct.RATES)
    ),
    "rateflags": """SELECT s."Cluster", s.rule_id, t.rate, t.step, t.threshold,
 (round(s.score, 9) <= round(t.threshold, 9))::INTEGER AS flag FROM scored s JOIN thresholds t USING ("Cluster")""",
}


@query("score_thresholds", "Cluster; rate:2; threshold:6", "FROM thresholds", tables=RATE_TABLES)
def _(spark, d):
    return iforest.score_thresholds(s.plain_scores(s.prepared(spark, d)), ct.RATES, score="score")


def rate_flags(spark, d):
    scored = s.plain_scores(s.prepared(spark, d)).withColumn("score", F.round("score", 9))
    return ct.flags_at_rates(scored, score="score")


@query("contamination_analysis", "Cluster; rate:2; threshold:6<max(threshold); anomalies<sum(flag)::BIGINT",
       'FROM rateflags GROUP BY "Cluster", rate', tables=RATE_TABLES)
def _(spark, d):
    return ct.contamination_analysis(rate_flags(spark, d))


@query("jaccard", 'Cluster<x."Cluster"; rate:2<x.rate; next:2<y.rate; '
       "jaccard:6<CASE WHEN sum(greatest(x.flag, y.flag)) > 0 "
       "THEN sum(x.flag * y.flag) / sum(greatest(x.flag, y.flag)) ELSE 1 END",
       'FROM rateflags x JOIN rateflags y ON x."Cluster" = y."Cluster" AND x.rule_id = y.rule_id '
       'AND y.step = x.step + 1 GROUP BY x."Cluster", x.rate, y.rate', tables=RATE_TABLES)
def _(spark, d):
    return ct.jaccard_of_neighbours(rate_flags(spark, d))


@query("combined_flag", f"Cluster; rule_id; anomaly_score:6; {FLAG_SPEC}", "FROM flagged")
def _(spark, d):
    return s.flagged(spark, d)


@query("either_anomaly", f"Cluster; rule_id; {FLAG_SPEC}", "FROM flagged WHERE iso = 1 OR lof = 1")
def _(spark, d):
    return a.either_anomaly(s.flagged(spark, d))


@query("anomaly_quadrant", "Cluster; quadrant; rules",
       sql="""SELECT "Cluster", CASE WHEN iso = 1 AND lof = 1 THEN 'both' WHEN iso = 1 THEN 'iso_only'
 WHEN lof = 1 THEN 'lof_only' ELSE 'normal' END AS quadrant, count(*) AS rules FROM flagged GROUP BY 1, 2""")
def _(spark, d):
    return a.anomaly_quadrant(s.flagged(spark, d))


@query("anomaly_counts", "Cluster; total_rules<count(*); "
       + "; ".join(f"{f}<sum({c})::BIGINT" for f, c in FLAGS.items()),
       'FROM flagged GROUP BY "Cluster"')
def _(spark, d):
    return a.anomaly_counts(s.flagged(spark, d))


@query("anomalous_only", "Cluster; Rule; support; confidence; lift; anomaly_score",
       sql=f"""SELECT "Cluster", {item_list("a")} || ' → ' || {item_list("c")} AS "Rule",
 round_even(support, 4) AS support, round_even(confidence, 4) AS confidence,
 round_even(lift, 4) AS lift, round_even(anomaly_score, 4) AS anomaly_score
FROM flagged WHERE iso = 1""")
def _(spark, d):
    return a.anomalous_only(s.flagged(spark, d))


@query("high_norm_support", "Cluster; rule_id; support:6; support_normalized:6<support_z",
       "FROM prepared WHERE support_z > 1.5")
def _(spark, d):
    return a.high_norm_support(s.prepared(spark, d), 1.5)


@query("threshold_filter", "Cluster; rule_id; support:6; confidence:6",
       "FROM flagged WHERE support >= 0.04::DOUBLE AND confidence >= 0.5::DOUBLE")
def _(spark, d):
    return a.threshold_filter(s.flagged(spark, d), 0.04, 0.5)


@query("features_of_anomalies", f"Cluster; rule_id; {NORM}", "FROM flagged WHERE iso = 1")
def _(spark, d):
    features = a.feature_rows(s.prepared(spark, d))
    return snake(a.features_of_anomalies(features, s.flagged(spark, d)))


RATIO_TABLES = {
    "flagitems": " UNION ALL ".join(
        f"""SELECT "Cluster", '{f}' AS flag, item, sum({c}) AS hit, sum(1 - {c}) AS miss
FROM (SELECT *, unnest(list_concat(a, c)) AS item FROM flagged) GROUP BY 1, 3"""
        for f, c in FLAGS.items()
    ),
    "flagtotals": " UNION ALL ".join(
        f"""SELECT "Cluster", '{f}' AS flag, sum({c}) AS n_hit, sum(1 - {c}) AS n_miss
FROM flagged GROUP BY 1""" for f, c in FLAGS.items()
    ),
    "ratios": """SELECT "Cluster", flag, item, CASE WHEN n_hit > 0 THEN hit / n_hit ELSE 0 END AS af,
 CASE WHEN n_miss > 0 THEN miss / n_miss ELSE 0 END AS nf
FROM flagitems JOIN flagtotals USING ("Cluster", flag)""",
}


@query("item_anomaly_ratio", "Cluster; flag; item; anomalous_freq:6<af; normal_freq:6<nf; "
       "ratio:6<CASE WHEN nf > 0 THEN af / nf ELSE 'inf'::DOUBLE END", "FROM ratios",
       tables=RATIO_TABLES)
def _(spark, d):
    return a.item_anomaly_ratio(s.flagged(spark, d))


@query("item_count_full_join", "Cluster; flag; item; anomalous_freq:6<af; normal_freq:6<nf",
       "FROM ratios WHERE af = 0 OR nf = 0", tables=RATIO_TABLES)
def _(spark, d):
    return a.item_anomaly_ratio(s.flagged(spark, d)).where(
        (F.col("anomalous_freq") == 0) | (F.col("normal_freq") == 0)
    )


@query("union_items", "Cluster; item",
       """FROM (SELECT DISTINCT "Cluster", unnest(list_concat(a, c)) AS item FROM flagged)""")
def _(spark, d):
    return a.item_anomaly_ratio(s.flagged(spark, d)).select("Cluster", "item").distinct()


# ---- strategies ----
CHOICES = {
    "choices": "SELECT * FROM (VALUES " + ", ".join(
        f"({k}, '{name}', '{metric}', '{strategy_}', '{text}')"
        for k, name, rows in (
            (0, "Casual Buyers", {
                "support": ("bundling", "Create affordable bundles"),
                "leverage confidence lift": ("cross_selling", "Offer complementary souvenirs")}),
            (1, "Inactive Customers", {
                "support": ("promotions", "Use time-limited offers"),
                "conviction": ("reactivation", "Re-engage with targeted offers"),
                "leverage confidence lift": ("cross_selling", "Offer complementary products")}),
            (2, "Loyal High-Value Customers", {
                "conviction": ("upselling", "Offer premium products"),
                "support leverage confidence lift": (
                    "cross_selling", "Offer complementary products")}),
            (3, "VIP/Wholesale Customers", {
                "support leverage": ("wholesale", "Offer bulk purchase deals"),
                "confidence lift": ("cross_selling", "Offer complementary products")}),
            (4, "Frequent Mid-to-High Value Customers", {
                "support": ("personalization", "Offer tailored recommendations"),
                "conviction": ("upselling", "Offer premium products"),
                "leverage confidence lift": ("cross_selling", "Offer complementary products")}),
        )
        for metrics, (strategy_, text) in rows.items()
        for metric in metrics.split()
    ) + ') v("Cluster", cluster_name, metric, strategy, text)',
    "keyed": """SELECT *, greatest(support_z, confidence_z, lift_z) AS key_value,
 CASE greatest(support_z, confidence_z, lift_z) WHEN support_z THEN 'support'
  WHEN confidence_z THEN 'confidence' ELSE 'lift' END AS metric,
 (support_z + confidence_z + lift_z) / 3 AS composite FROM flagged""",
    "best5": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Cluster"
 ORDER BY composite DESC, rule_id) AS place FROM keyed) WHERE place <= 5""",
    "leadfeatures": """SELECT "Cluster", feature, row_number() OVER (PARTITION BY "Cluster"
 ORDER BY importance DESC, feature) AS place FROM importance""",
    "valued": " UNION ALL ".join(
        f"""SELECT "Cluster", rule_id, '{m}_normalized' AS feature, {z} AS v FROM flagged"""
        for m, z in zip(RULE_METRICS, Z)
    ),
    "explained": """SELECT f.*, replace(x.feature, '_normalized', '') AS metric, vx.v AS key_value,
 (vx.v + vy.v) / 2 AS composite
FROM flagged f JOIN leadfeatures x ON x."Cluster" = f."Cluster" AND x.place = 1
JOIN leadfeatures y ON y."Cluster" = f."Cluster" AND y.place = 2
JOIN valued vx ON vx."Cluster" = f."Cluster" AND vx.rule_id = f.rule_id AND vx.feature = x.feature
JOIN valued vy ON vy."Cluster" = f."Cluster" AND vy.rule_id = f.rule_id AND vy.feature = y.feature
WHERE iso = 1 OR lof = 1""",
    "explained5": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Cluster"
 ORDER BY composite DESC, rule_id) AS place FROM explained) WHERE place <= 5""",
}
BUSINESS = (
    "Cluster; Cluster_Name<cluster_name; Antecedents:a<a; Consequents:a<c; Support:6<support; "
    "Confidence:6<confidence; Lift:6<lift; Leverage:6<leverage; Conviction:6<conviction; "
    "Key_Metric<metric || '_normalized'; Key_Metric_Value:6<key_value; "
    "Anomaly_Score:6<anomaly_score; Recommended_Strategy<strategy; Strategy_Description<text"
)


@query("key_metric", "Cluster; rule_id; key_metric<metric || '_normalized'; key_value:6",
       "FROM keyed", tables=CHOICES)
def _(spark, d):
    return strategy.key_metric(s.flagged(spark, d))


@query("composite_score", "Cluster; rule_id; score:6",
       sql="""SELECT "Cluster", rule_id, round((coalesce(a1, 0) + lift_z) / (1 + (a1 IS NOT NULL)::INTEGER), 6)
 AS score FROM (SELECT *, CASE WHEN confidence_z > 0 THEN confidence_z END AS a1 FROM prepared)""")
def _(spark, d):
    positive = F.when(F.col("confidence_normalized") > 0, F.col("confidence_normalized"))
    return s.prepared(spark, d).select(
        "Cluster", "rule_id", mean_of([positive, F.col("lift_normalized")]).alias("score")
    )


@query("top_n_per_cluster", "Cluster; rule_id; composite_score:6<composite", "FROM best5",
       tables=CHOICES)
def _(spark, d):
    return strategy.top_per_cluster(strategy.composite_score(s.flagged(spark, d)))


@query("strategy_lookup", "Cluster; rule_id; Recommended_Strategy<strategy",
       'FROM keyed JOIN choices USING ("Cluster", metric)', tables=CHOICES)
def _(spark, d):
    keyed = strategy.key_metric(s.flagged(spark, d)).withColumn(
        "metric", F.regexp_replace("key_metric", "_normalized$", "")
    )
    return keyed.join(F.broadcast(strategy.strategy_lookup(spark)), ["Cluster", "metric"])


@query("business_rules", BUSINESS, 'FROM best5 JOIN choices USING ("Cluster", metric)',
       tables=CHOICES)
def _(spark, d):
    return strategy.sort_business_rules(strategy.business_rules(s.flagged(spark, d)))


@query("business_rules_of_anomalies", BUSINESS,
       'FROM explained5 JOIN choices USING ("Cluster", metric)', tables=CHOICES)
def _(spark, d):
    return strategy.business_rules(s.flagged(spark, d), s.importance(spark, d))


@query("sort_business_rules", "Cluster; Rule; Key_Metric_Value:6",
       sql=f"""SELECT "Cluster", {item_list("a")} || ' -> ' || {item_list("c")} AS "Rule",
 round(key_value, 6) AS "Key_Metric_Value" FROM best5 JOIN choices USING ("Cluster", metric)
 WHERE support >= 0.04::DOUBLE AND confidence >= 0.3::DOUBLE
 ORDER BY "Cluster", key_value DESC""".replace(
           "FROM best5", """FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Cluster"
 ORDER BY composite DESC, rule_id) AS place FROM keyed WHERE support >= 0.04::DOUBLE
 AND confidence >= 0.3::DOUBLE) WHERE place <= 5)"""), tables=CHOICES)
def _(spark, d):
    return strategy.sort_business_rules(
        strategy.business_rules(s.flagged(spark, d), min_support=0.04, min_confidence=0.3)
    )


@query("business_rules_without_anomalies", BUSINESS,
       """FROM (SELECT * FROM explained5 WHERE "Cluster" <> 0 UNION ALL BY NAME
 SELECT * FROM best5 WHERE "Cluster" = 0) JOIN choices USING ("Cluster", metric)""",
       tables=CHOICES)
def _(spark, d):
    return strategy.business_rules(s.flagged(spark, d), s.importance(spark, d).where("Cluster <> 0"))


@query("rank_features", "Cluster; feature; place", "FROM leadfeatures WHERE place <= 2", tables=CHOICES)
def _(spark, d):
    from pyspark.sql.window import Window

    best = shapley.rank_features(s.importance(spark, d), n=2)
    by = Window.partitionBy("Cluster").orderBy(F.desc("importance"), "feature")
    return best.withColumn("place", F.row_number().over(by))


# ---- forest, explanation, whole workflow: no SQL counterpart ----
@query("isolation_forest_fit")
def _(spark, d):
    return iforest.fit_forest(s.prepared(spark, d), a.FEATURES)


@query("isolation_forest_score")
def _(spark, d):
    return s.forest_scores(spark, d).select("Cluster", "rule_id", "iforest_score")


@query("isolation_forest_customers")
def _(spark, d):
    rows = s.scaled(spark, d).withColumn("Cluster", F.lit(0))
    forest = iforest.fit_forest(rows, s.SCALED, row_id="CustomerID")
    return iforest.score_forest(rows, forest, s.SCALED).select("CustomerID", "iforest_score")


@query("isolation_forest_embeddings")
def _(spark, d):
    names, vectors = embedded(spark, d)
    forest = iforest.fit_forest(vectors, names, "label", "vec_id")
    return iforest.score_forest(vectors, forest, names, "label").select(
        "label", "vec_id", "iforest_score"
    )


@query("model_store")
def _(spark, d):
    path = table_folder(spark, "forest")
    sinks.save_table(s.forest(spark, d), path)
    return sinks.load_table(spark, path)


@query("detect_anomalies")
def _(spark, d):
    prepared = s.prepared(spark, d)
    found = a.detect_anomalies(prepared, jobs.workflow_params(spark)).rules
    return found.select("Cluster", "rule_id", *a.FLAGS, "anomaly_score")


@query("explain_anomalies")
def _(spark, d):
    rates = s.prepared(spark, d).select("Cluster").distinct().withColumn(
        "contamination", F.lit(0.07)
    )
    scored = iforest.flag_forest(s.forest_scores(spark, d), rates)
    return shapley.feature_importance(scored, s.forest(spark, d), a.FEATURES)


@query("predict_anomalies")
def _(spark, d):
    trained = iforest.score_forest(s.prepared(spark, d), s.forest(spark, d), a.FEATURES)
    offsets = iforest.score_thresholds(trained, [0.07]).select(
        "Cluster", F.col("threshold").alias("offset")
    )
    found = a.predict_anomalies(s.rules(spark, d), s.forest(spark, d), offsets)
    return found.select("Cluster", "rule_id", "isolation_forest_anomaly", "anomaly_score")


@query("anomaly_workflow")
def _(spark, d):
    return s.workflow(spark, d).anomalous_rules.drop("Antecedents", "Consequents")


def workflow_result(name: str) -> None:
    @query(f"anomaly_workflow_{name}")
    def _(spark, d):
        found = getattr(s.workflow(spark, d), name)
        return found.drop("Antecedents", "Consequents")


for _field in fields(jobs.Workflow):
    if _field.name != "anomalous_rules":
        workflow_result(_field.name)


@query("dashboard_anomalies")
def _(spark, d):
    found = jobs.detect_in_cluster(s.rules(spark, d), 0).rules
    return a.anomalous_only(found)
