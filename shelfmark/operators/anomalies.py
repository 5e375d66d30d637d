"""Preparation of rules for outlier detection, flags, and what the flags say."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.numeric import divide, infinity, round_half_even
from shelfmark.functions.rules import ARROW, rule_id, rule_string
from shelfmark.operators import iforest, lof
from shelfmark.operators.groups import join_groups, with_row_key
from shelfmark.operators.scaling import apply_scaler, fit_scaler, median_impute
from shelfmark.session import materialise
from shelfmark.sources.retail import RULE_METRICS

NORMALIZED = {m: f"{m}_normalized" for m in RULE_METRICS}
FEATURES = list(NORMALIZED.values())
ROW = "__row"
FLAGS = ["isolation_forest_anomaly", "lof_anomaly", "combined_anomaly"]
MIN_RULES = 10


def preprocess_rules(
    rules: DataFrame, scaler: DataFrame | None = None, by: str = "Cluster",
    features: Sequence[str] = RULE_METRICS,
) -> DataFrame:
    """Add ``<metric>_normalized`` for each of ``features`` (by default the seven metrics) and
    the rule id. Infinite and missing metrics count as the cluster's median. Scaling is fitted
    on the given rules, or taken from ``scaler``."""
    _check_columns(rules, features)
    filled = {m: f"__{m}" for m in features}
    ready = median_impute(rules, list(features), [by], filled)
    columns = list(filled.values())
    if scaler is None:
        scaler = fit_scaler(ready, columns, [by])
    names = {filled[m]: f"{m}_normalized" for m in features}
    scaled = apply_scaler(ready, scaler, columns, names, [by]).drop(*columns)
    return scaled.withColumn("rule_id", rule_id(F.col("antecedents"), F.col("consequents")))


def _check_columns(rules: DataFrame, features: Sequence[str]) -> None:
    missing = [c for c in features if c not in rules.columns]
    if missing:
        raise ValueError(f"the rules have no columns {missing}")


def fit_rule_scaler(
    rules: DataFrame, by: str = "Cluster", features: Sequence[str] = RULE_METRICS
) -> DataFrame:
    filled = {m: f"__{m}" for m in features}
    ready = median_impute(rules, list(features), [by], filled)
    return fit_scaler(ready, list(filled.values()), [by])


def feature_rows(
    rules: DataFrame, by: str = "Cluster", row_id: str = "rule_id",
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """The scaled features by rule, gaps filled with the cluster's median."""
    return median_impute(rules.select(by, row_id, *features), list(features), [by])


def sort_by_rule_id(rules: DataFrame) -> DataFrame:
    return rules.orderBy("rule_id")


def small_groups(rules: DataFrame, by: str = "Cluster", least: int = MIN_RULES) -> DataFrame:
    """Groups with too few rules for outlier detection."""
    counts = rules.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") < least).select(by)


def combined_flag(rules: DataFrame) -> DataFrame:
    both = F.col("isolation_forest_anomaly") + F.col("lof_anomaly") > 1
    return rules.withColumn("combined_anomaly", both.cast("int"))


@dataclass
class Detected:
    """Flagged rules with the fitted forest (node table) and its per-group offsets."""

    rules: DataFrame
    forest: DataFrame
    offsets: DataFrame


def detect_anomalies(
    rules: DataFrame, params: DataFrame, by: str = "Cluster", seed: int = 42,
    features: Sequence[str] = FEATURES, forest: DataFrame | None = None,
) -> Detected:
    """Flag prepared rules by forest and local outlier factor, all groups at once.

    ``features`` are the scaled columns to look at; a stored ``forest`` is used instead of a
    new one where given.

    ``params`` is ``(by, contamination, n_neighbors)``. Groups under ten rules get zeros.
    A rule that is given several times counts, and comes back, as often.
    """
    rules = materialise(with_row_key(materialise(rules), [by, "rule_id"], ROW))
    found = feature_rows(rules, by, ROW, features)
    enough = materialise(join_groups(found, small_groups(rules, by), [by], "left_anti"))
    if forest is None:
        forest = iforest.fit_forest(enough, features, by, ROW, seed=seed)
    scored = materialise(
        iforest.score_forest(enough, forest, features, by).select(by, ROW, "iforest_score")
    )
    flagged = materialise(iforest.flag_forest(scored, params.select(by, "contamination"), by))
    neighbours = params.select(by, F.col("n_neighbors").alias("k"))
    top_k = params.agg(F.max("n_neighbors").alias("k")).first()["k"] or 1
    factors = lof.lof_scores(enough, features, neighbours, top_k, by, ROW).drop("k")
    joined = rules.join(flagged, [by, ROW], "left").drop("offset")
    joined = lof.flag_lof(joined, factors, by, ROW).drop(ROW).fillna(
        {"isolation_forest_anomaly": 0, "anomaly_score": 0.0}
    )
    offsets = flagged.groupBy(by).agg(F.max("offset").alias("offset"))
    return Detected(combined_flag(joined), forest, offsets)


def predict_anomalies(
    rules: DataFrame, forest: DataFrame, offsets: DataFrame, scaler: DataFrame | None = None,
    by: str = "Cluster", metrics: Sequence[str] = RULE_METRICS,
) -> DataFrame:
    """Score new rules with a stored forest, grown from the scaled ``metrics`` in this order. Scaling is refitted on the new rules unless a
    fitted ``scaler`` is given. A cluster without a forest is an error."""
    missing = rules.select(by).distinct().join(forest.select(by).distinct(), by, "left_anti")
    unknown = [r[by] for r in missing.limit(10).collect()]
    if unknown:
        raise ValueError(f"no trained forest for cluster {unknown}")
    prepared = materialise(preprocess_rules(rules, scaler, by, metrics))
    prepared = materialise(with_row_key(prepared, [by, "rule_id"], ROW))
    scaled = [f"{m}_normalized" for m in metrics]
    found = feature_rows(prepared, by, ROW, scaled)
    scored = iforest.score_forest(found, forest, scaled, by).select(by, ROW, "iforest_score")
    decided = iforest.with_decision(scored, offsets, by, "iforest_score").drop("offset")
    return prepared.join(decided, [by, ROW]).drop(ROW)


def either_anomaly(rules: DataFrame) -> DataFrame:
    return rules.where((F.col("isolation_forest_anomaly") == 1) | (F.col("lof_anomaly") == 1))


def threshold_filter(rules: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    return rules.where(
        (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)
    )


def anomaly_quadrant(rules: DataFrame, by: str = "Cluster") -> DataFrame:
    iso, local = F.col("isolation_forest_anomaly") == 1, F.col("lof_anomaly") == 1
    kind = (
        F.when(iso & local, "both").when(iso, "iso_only").when(local, "lof_only").otherwise("normal")
    )
    return rules.groupBy(by, kind.alias("quadrant")).agg(F.count(F.lit(1)).alias("rules"))


def anomaly_counts(rules: DataFrame, by: str = "Cluster") -> DataFrame:
    return rules.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_rules"), *[F.sum(f).alias(f) for f in FLAGS]
    )


def anomalous_only(rules: DataFrame) -> DataFrame:
    """The flagged rules as shown to a reader: rule text and four-digit numbers."""
    shown = ["support", "confidence", "lift", "anomaly_score"]
    return rules.where(F.col("isolation_forest_anomaly") == 1).select(
        "Cluster",
        rule_string(F.col("antecedents"), F.col("consequents"), ARROW).alias("Rule"),
        *[round_half_even(F.col(c), 4).alias(c) for c in shown],
    )


def high_norm_support(rules: DataFrame, above: float = 5.0) -> DataFrame:
    return rules.where(F.col("support_normalized") > above)


def features_of_anomalies(features: DataFrame, rules: DataFrame, by: str = "Cluster") -> DataFrame:
    flagged = rules.where(F.col("isolation_forest_anomaly") == 1).select(by, "rule_id")
    return features.join(flagged, [by, "rule_id"], "left_semi")


def item_anomaly_ratio(
    rules: DataFrame, flags: list[str] = FLAGS, by: str = "Cluster"
) -> DataFrame:
    """Share of the flagged and of the other rules that hold each item, per flag, and the
    ratio; +infinity where no other rule holds it, 0 shares for an empty side."""
    per_flag = rules.select(
        by, F.concat("antecedents", "consequents").alias("items"),
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("value")) for f in flags])
        ).alias("f"),
    ).select(by, "items", "f.*")
    hit, miss = F.sum(F.col("value")), F.sum(1 - F.col("value"))
    totals = per_flag.groupBy(by, "flag").agg(hit.alias("n_hit"), miss.alias("n_miss"))
    items = (
        per_flag.withColumn("item", F.explode("items"))
        .groupBy(by, "flag", "item")
        .agg(hit.alias("hit"), miss.alias("miss"))
    )
    shares = join_groups(items, totals, [by, "flag"]).select(
        by, "flag", "item",
        divide(F.col("hit"), F.col("n_hit"), 0.0).alias("anomalous_freq"),
        divide(F.col("miss"), F.col("n_miss"), 0.0).alias("normal_freq"),
    )
    return shares.withColumn(
        "ratio", divide(F.col("anomalous_freq"), F.col("normal_freq"), infinity())
    )


def sorted_item_ratios(ratios: DataFrame, by: str = "Cluster") -> DataFrame:
    return ratios.orderBy(by, "flag", F.desc("ratio"), "item")


