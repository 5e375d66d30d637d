"""Business strategies for rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.numeric import largest_name, mean_of
from shelfmark.functions.rules import rule_string
from shelfmark.operators.anomalies import FEATURES, either_anomaly, threshold_filter
from shelfmark.operators.groups import join_groups
from shelfmark.operators.ordering import top_n
from shelfmark.operators.rfm import SEGMENT_NAMES
from shelfmark.sources.retail import RULE_METRICS

# ---- fixed values: strategies by cluster, in order of preference ----
PRIMARY = {
    0: [
        ("cross_selling", "Offer complementary souvenirs"),
        ("bundling", "Create affordable bundles"),
        ("promotions", "Use time-limited offers for popular items"),
    ],
    1: [
        ("reactivation", "Re-engage with targeted offers"),
        ("cross_selling", "Offer complementary products"),
        ("discounts", "Provide special discounts"),
    ],
    2: [
        ("upselling", "Offer premium products"),
        ("personalization", "Offer tailored recommendations"),
        ("loyalty_program", "Enroll in loyalty rewards"),
    ],
    3: [
        ("wholesale", "Offer bulk purchase deals"),
        ("cross_selling", "Offer complementary products"),
        ("special_services", "Provide dedicated account management"),
    ],
    4: [
        ("cross_selling", "Offer complementary products"),
        ("upselling", "Offer premium products"),
        ("seasonal_promotions", "Offer seasonal deals"),
    ],
}
FALLBACK = {
    0: [("personalization", "Offer tailored recommendations")],
    1: [("promotions", "Use time-limited offers")],
    2: [
        ("cross_selling", "Offer complementary products"),
        ("promotions", "Exclusive offers for loyal customers"),
    ],
    3: [("promotions", "Exclusive bulk offers")],
    4: [("personalization", "Offer tailored recommendations")],
}
# strategies that answer a key metric: (primary, fallback)
ANSWERS = {
    "support": (
        ["bundling", "promotions", "wholesale"],
        ["personalization", "cross_selling", "promotions"],
    ),
    "leverage": (["cross_selling", "wholesale"], ["cross_selling", "promotions"]),
    "conviction": (["personalization", "reactivation", "upselling"], []),
    "confidence": (["cross_selling", "promotions"], ["cross_selling", "promotions"]),
    "lift": (["cross_selling", "promotions"], ["cross_selling", "promotions"]),
}
# ---- end of fixed values ----

# ranking metrics in order of preference; the first three there are count
DEFAULT_METRICS = [
    "support_normalized", "confidence_normalized", "lift_normalized", "support", "confidence", "lift",
]
KINDS = {"primary": PRIMARY, "fallback": FALLBACK}


def strategy_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (cluster, SEGMENT_NAMES[cluster], kind, place, i, strategy, description)
        for place, (kind, table) in enumerate(KINDS.items())
        for cluster, listed in table.items()
        for i, (strategy, description) in enumerate(listed)
    ]
    return spark.createDataFrame(
        rows,
        "Cluster int, Cluster_Name string, kind string, kind_ord int, ord int, strategy string, "
        "description string",
    )


def strategy_lookup(spark: SparkSession) -> DataFrame:
    """(Cluster, metric) to its strategy: the first of the cluster's own list that answers
    the metric, primary before fallback. Metrics without an answer have no row."""
    answers = spark.createDataFrame(
        [
            (metric, kind, strategy)
            for metric, lists in ANSWERS.items()
            for kind, listed in zip(KINDS, lists)
            for strategy in listed
        ],
        "metric string, kind string, strategy string",
    )
    first = F.struct("kind_ord", "ord")
    return (
        strategy_dim(spark)
        .join(F.broadcast(answers), ["kind", "strategy"])
        .groupBy("Cluster", "Cluster_Name", "metric")
        .agg(
            F.min_by("strategy", first).alias("Recommended_Strategy"),
            F.min_by("description", first).alias("Strategy_Description"),
        )
    )


def default_metrics(rules: DataFrame) -> list[str]:
    """Scaled metrics, or the plain ones where they were not scaled."""
    found = [m for m in DEFAULT_METRICS if m in rules.columns][:3]
    if not found:
        raise ValueError("the rules have none of the metrics " + ", ".join(DEFAULT_METRICS))
    return found


def composite_score(rules: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    metrics = metrics or default_metrics(rules)
    return rules.withColumn("composite_score", mean_of([F.col(m) for m in metrics]))


def key_metric(rules: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Name and value of each rule's largest metric."""
    metrics = metrics or default_metrics(rules)
    columns = {m: F.col(m) for m in metrics}
    return rules.withColumn("key_metric", largest_name(columns)).withColumn(
        "key_value", F.greatest(*columns.values())
    )


def top_per_cluster(rules: DataFrame, n: int = 5) -> DataFrame:
    return top_n(rules, ["Cluster"], [F.desc("composite_score"), F.asc("rule_id")], n)


def _by_importance(rules: DataFrame, importance: DataFrame) -> DataFrame:
    """Score by the cluster's two most important features; the first is the key metric. A
    feature named without ``_normalized`` is taken scaled where the rules hold it so."""
    scaled = F.concat("feature", F.lit("_normalized"))
    there = [c for c in rules.columns if c in FEATURES or c in RULE_METRICS]
    importance = importance.withColumn(
        "feature", F.when(scaled.isin(there), scaled).otherwise(F.col("feature"))
    )
    two = top_n(importance, ["Cluster"], [F.desc("importance"), F.asc("feature")], 2)
    # both places from one order, so equal importances name two features
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("less"), "feature")))
    names = two.groupBy("Cluster").agg(ordered.alias("__two")).select(
        "Cluster",
        F.get("__two", F.lit(0))["feature"].alias("__first"),
        F.coalesce(F.get("__two", F.lit(1)), F.get("__two", F.lit(0)))["feature"].alias("__second"),
    )
    values = F.map_from_arrays(
        F.array(*map(F.lit, there)), F.array(*[F.col(f"`{f}`") for f in there])
    )
    first = F.element_at(values, F.col("__first"))
    second = F.element_at(values, F.col("__second"))
    return (
        join_groups(rules, names, ["Cluster"])
        .withColumn("composite_score", mean_of([first, second]))
        .withColumn("key_metric", F.col("__first"))
        .withColumn("key_value", first)
        .drop("__first", "__second")
    )


def business_rules(
    rules: DataFrame, importance: DataFrame | None = None, top: int = 5,
    min_support: float | None = None, min_confidence: float | None = None,
) -> DataFrame:
    """The best rules of each cluster with a recommended strategy. With importances only
    anomalous rules are considered; a cluster that has none, as none of its rules is flagged by
    the forest, keeps its general ranking. Metrics that were not scaled count as they are; rules
    never scored have no anomaly score. Rules whose key metric has no answer are left out."""
    if min_support is not None and min_confidence is not None:
        rules = threshold_filter(rules, min_support, min_confidence)
    if importance is None:
        scored = key_metric(composite_score(rules))
    else:
        explained = importance.select("Cluster").distinct()
        general = join_groups(rules, explained, ["Cluster"], "left_anti")
        scored = _by_importance(either_anomaly(rules), importance).unionByName(
            key_metric(composite_score(general))
        )
    best = top_per_cluster(scored, top).withColumn(
        "metric", F.regexp_replace("key_metric", "_normalized$", "")
    )
    # the look-up holds 5 clusters × 5 metrics whatever the data
    chosen = best.join(F.broadcast(strategy_lookup(rules.sparkSession)), ["Cluster", "metric"])
    return chosen.select(
        "Cluster", "Cluster_Name",
        rule_string(F.col("antecedents"), F.col("consequents")).alias("Rule"),
        F.col("antecedents").alias("Antecedents"), F.col("consequents").alias("Consequents"),
        F.col("support").alias("Support"), F.col("confidence").alias("Confidence"),
        F.col("lift").alias("Lift"), F.col("leverage").alias("Leverage"),
        F.col("conviction").alias("Conviction"), F.col("key_metric").alias("Key_Metric"),
        F.col("key_value").alias("Key_Metric_Value"),
        (F.col("anomaly_score") if "anomaly_score" in chosen.columns else F.lit(None).cast("double"))
        .alias("Anomaly_Score"),
        "Recommended_Strategy", "Strategy_Description",
    )


def sort_business_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.asc("Cluster"), F.desc("Key_Metric_Value"), F.asc("Rule"))
