"""Tables that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.ctes import CENTRES
from checks.registry import once, stage
from shelfmark.operators import anomalies as a
from shelfmark.operators import iforest, kmeans, lof
from shelfmark.operators import rules as r
from shelfmark.operators.baskets import (
    first_invoices, frequent_itemsets, lines_with_cluster, prepare_baskets,
)
from shelfmark.operators.rfm import cluster_name, rfm
from shelfmark.operators.scaling import apply_scaler, fit_scaler
from shelfmark.plans import anomalies as jobs
from shelfmark.plans.preprocess import preprocess
from shelfmark.sources.star import retail_raw

SCALED = list(kmeans.SCALED.values())


@stage
def clean(spark: SparkSession, d: str) -> DataFrame:
    return preprocess(retail_raw(spark, d))


@stage
def customers(spark: SparkSession, d: str) -> DataFrame:
    return rfm(clean(spark, d))


@stage
def scaled(spark: SparkSession, d: str) -> DataFrame:
    base = customers(spark, d)
    return apply_scaler(base, fit_scaler(base, kmeans.RFM), kmeans.RFM, kmeans.SCALED)


@stage
def segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments by fixed centres: the same clusters in every engine."""
    return kmeans.assign_nearest(scaled(spark, d), SCALED, CENTRES).withColumn(
        "Cluster_Name", cluster_name(F.col("Cluster"))
    ).drop(*SCALED)


@stage
def clustered(spark: SparkSession, d: str) -> DataFrame:
    return lines_with_cluster(clean(spark, d), segments(spark, d))


@stage
def used(spark: SparkSession, d: str) -> DataFrame:
    """The sample of the large clusters, for the queries on sampling alone."""
    return first_invoices(clustered(spark, d), ["Cluster"])


@stage
def baskets(spark: SparkSession, d: str) -> DataFrame:
    return prepare_baskets(clustered(spark, d))


@stage
def itemsets(spark: SparkSession, d: str) -> DataFrame:
    return frequent_itemsets(baskets(spark, d), min(r.GRID_SUPPORT))


@stage
def points(spark: SparkSession, d: str) -> DataFrame:
    mined = r.association_rules(itemsets(spark, d), min(r.GRID_CONFIDENCE))
    return r.rules_at_points(mined, r.GRID_SUPPORT, r.GRID_CONFIDENCE)


@stage
def rules(spark: SparkSession, d: str) -> DataFrame:
    at = points(spark, d)
    return r.tuned_rules(at, r.best_params(r.tuning_results(at), itemsets(spark, d)))


@stage
def prepared(spark: SparkSession, d: str) -> DataFrame:
    return a.preprocess_rules(rules(spark, d))


def plain_scores(df: DataFrame) -> DataFrame:
    """Minus the squared distance from the centre: a score every engine computes alike."""
    return df.withColumn("score", -sum((F.col(f) * F.col(f) for f in a.FEATURES), F.lit(0.0)))


@stage
def factors(spark: SparkSession, d: str) -> DataFrame:
    base = prepared(spark, d)
    return lof.lof_scores(base, a.FEATURES, lof.k_table(base, [20]), 20).drop("k")


@stage
def flagged(spark: SparkSession, d: str) -> DataFrame:
    scored = plain_scores(prepared(spark, d))
    rates = scored.select("Cluster").distinct().withColumn("contamination", F.lit(0.07))
    decided = iforest.flag_forest(scored, rates, score="score").drop("offset")
    return a.combined_flag(lof.flag_lof(decided, factors(spark, d), "Cluster", "rule_id"))


@stage
def importance(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute scaled metric of the flagged rules, shaped like the real importance."""
    hit = flagged(spark, d).where(F.col("isolation_forest_anomaly") == 1)
    cells = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.abs(F.col(f)).alias("v")) for f in a.FEATURES]
    )
    return hit.select("Cluster", F.explode(cells).alias("c")).groupBy("Cluster", "c.feature").agg(
        F.avg("c.v").alias("importance")
    )


@stage
def forest(spark: SparkSession, d: str) -> DataFrame:
    return iforest.fit_forest(prepared(spark, d), a.FEATURES)


@stage
def forest_scores(spark: SparkSession, d: str) -> DataFrame:
    return iforest.score_forest(prepared(spark, d), forest(spark, d), a.FEATURES)


@stage
def many_factors(spark: SparkSession, d: str) -> DataFrame:
    base = prepared(spark, d)
    return lof.lof_scores(base, a.FEATURES, lof.k_table(base, lof.K_VALUES), max(lof.K_VALUES))


def workflow(spark: SparkSession, d: str) -> jobs.Workflow:
    """All results of the whole workflow, planned once per session and input folder."""
    return once(spark, d, "workflow", lambda: jobs.anomaly_workflow(rules(spark, d)))
