"""Job 4: anomalous rules, their explanation, and what to do about them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import anomalies as a
from shelfmark.operators import contamination as c
from shelfmark.operators import lof, shapley, strategy
from shelfmark.operators.groups import join_groups
from shelfmark.session import materialise

# ---- fixed values: settings of the full workflow by cluster ----
# cluster: (contamination, neighbours, neighbour counts analysed, rates analysed)
WORKFLOW = {
    0: (0.07, 20, [5, 10, 20, 30, 50], False),
    1: (0.07, 30, [5, 10, 20, 30, 50], True),
    2: (0.07, 20, [5, 10, 20, 30, 50], True),
    3: (0.07, 250, [150, 200, 250, 300, 350], True),
    4: (0.1, 30, [5, 10, 20, 30, 50], True),
}
HIGH_SUPPORT_CLUSTER = 2
# settings of the dashboard's one-cluster run
DASHBOARD = (0.07, 20)
# ---- end of fixed values ----


@dataclass
class Workflow:
    rules: DataFrame
    forest: DataFrame
    offsets: DataFrame
    importance: DataFrame
    general_rules: DataFrame
    anomalous_rules: DataFrame
    item_ratios: DataFrame
    high_support: DataFrame
    rate_flags: DataFrame
    lof_scores: DataFrame


def workflow_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(cluster, v[0], v[1]) for cluster, v in WORKFLOW.items()],
        "Cluster int, contamination double, n_neighbors int",
    )


def uniform_params(rules: DataFrame, contamination: float, n_neighbors: int) -> DataFrame:
    return rules.select("Cluster").distinct().select(
        "Cluster", F.lit(contamination).alias("contamination"),
        F.lit(n_neighbors).alias("n_neighbors"),
    )


def lof_k_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(cluster, k) for cluster, v in WORKFLOW.items() for k in v[2]], "Cluster int, k int"
    )


def rate_analysis(spark: SparkSession, detected: DataFrame) -> DataFrame:
    """Flags at every analysed rate, for the clusters the workflow analyses."""
    wanted = [cluster for cluster, v in WORKFLOW.items() if v[3]]
    scored = detected.where(F.col("Cluster").isin(wanted) & F.col("iforest_score").isNotNull())
    return c.flags_at_rates(scored)


def detect_in_cluster(
    rules: DataFrame, cluster: int, forest: DataFrame | None = None
) -> a.Detected:
    """The dashboard's run: one cluster, fixed settings; a stored ``forest`` instead of a new
    one where given."""
    mine = a.preprocess_rules(rules.where(F.col("Cluster") == cluster))
    return a.detect_anomalies(mine, uniform_params(mine, *DASHBOARD), forest=forest)


def anomaly_workflow(rules: DataFrame, seed: int = 42, forest: DataFrame | None = None) -> Workflow:
    """All clusters in one code path: what differs between them is a parameter table. With a
    stored ``forest`` none is grown."""
    spark = rules.sparkSession
    prepared = materialise(
        a.preprocess_rules(rules.where(F.col("Cluster").isin(list(WORKFLOW))))
    )
    detected = a.detect_anomalies(prepared, workflow_params(spark), seed=seed, forest=forest)
    scored = materialise(detected.rules)
    importance = materialise(
        shapley.feature_importance(scored, detected.forest, a.FEATURES)
    )
    features = a.feature_rows(prepared)
    enough = join_groups(features, a.small_groups(prepared), ["Cluster"], "left_anti")
    largest = max(k for v in WORKFLOW.values() for k in v[2])
    return Workflow(
        rules=scored,
        forest=detected.forest,
        offsets=detected.offsets,
        importance=importance,
        general_rules=strategy.business_rules(scored),
        anomalous_rules=strategy.business_rules(scored, importance),
        item_ratios=a.item_anomaly_ratio(scored),
        high_support=a.high_norm_support(scored.where(F.col("Cluster") == HIGH_SUPPORT_CLUSTER)),
        rate_flags=rate_analysis(spark, scored),
        lof_scores=lof.lof_scores(enough, a.FEATURES, lof_k_table(spark), largest),
    )


__all__ = [
    "DASHBOARD", "WORKFLOW", "Workflow", "anomaly_workflow", "detect_in_cluster",
    "lof_k_table", "rate_analysis", "uniform_params", "workflow_params",
]
