"""Local outlier factor and its sensitivity to k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.operators.groups import join_groups, join_uneven
from shelfmark.operators.neighbours import distinct_points, nearest_neighbours
from shelfmark.operators.ordering import average_rank, quantiles
from shelfmark.session import stored

# The flag threshold and the guard against a zero reach.
OUTLIER_FACTOR = 1.5
REACH_GUARD = 1e-10
K_VALUES = [5, 10, 20, 30, 50]


def lof_scores(
    rows: DataFrame, features: Sequence[str], ks: DataFrame, max_k: int, by: str = "Cluster",
    row_id: str = "rule_id",
) -> DataFrame:
    """Factor of every row for every k: ``(by, row_id, k, factor)``.

    ``ks`` holds ``(by, k)``. A k beyond
    the group's size is taken as the size less one, and computed once for all such k.
    Neighbours are searched up to each group's own largest k, at most ``max_k``.
    """
    points, members = distinct_points(rows, by, row_id, features)
    sizes = points.groupBy(by).agg(F.sum("copies").alias("__rows"))
    clamped = ks.join(sizes, by).select(
        by, "k", F.least(F.col("k").cast("bigint"), F.col("__rows") - 1).alias("kk")
    )
    wanted = clamped.select(by, "kk").distinct()
    own = wanted.select(by, F.least(F.greatest("kk", F.lit(1)), F.lit(max_k)).alias("k"))
    # k rows per point and more: by column, not as checkpoints
    neighbours = stored(nearest_neighbours(points, by, own).drop("k"))
    counted = (
        join_groups(neighbours, wanted, [by])
        .withColumn("times", F.least(F.col("copies"), F.col("kk") - F.col("before")))
        .where(F.col("times") > 0)
    )
    reach = counted.groupBy(by, "kk", "point").agg(F.max("d").alias("k_distance"))
    k_distance = reach.select(
        by, "kk", F.col("point").alias("near"), F.col("k_distance").alias("near_distance")
    )
    density = (
        counted.join(k_distance, [by, "kk", "near"])
        .groupBy(by, "kk", "point")
        .agg(
            (
                F.sum(F.col("times") * F.greatest("near_distance", "d")) / F.col("kk")
            ).alias("mean_reach")
        )
        .select(by, "kk", "point", (F.lit(1.0) / (F.col("mean_reach") + REACH_GUARD)).alias("density"))
    )
    density = stored(density)
    near_density = density.select(
        by, "kk", F.col("point").alias("near"), F.col("density").alias("near_density")
    )
    factors = (
        counted.join(near_density, [by, "kk", "near"])
        .join(density, [by, "kk", "point"])
        .groupBy(by, "kk", "point")
        .agg(
            (
                F.sum(F.col("times") * F.col("near_density") / F.col("density")) / F.col("kk")
            ).alias("factor")
        )
    )
    copies = points.select(by, "point", F.col("copies").alias("__n"))
    per_k = join_groups(factors, clamped, [by, "kk"]).groupBy(by, "point").agg(
        F.collect_list(F.struct("k", "factor")).alias("f")
    )
    return (
        join_uneven(members, per_k, [by, "point"], counts=copies)
        .select(by, F.col("id").alias(row_id), F.explode("f").alias("f"))
        .select(by, row_id, "f.*")
    )


def k_table(rows: DataFrame, ks: Sequence[int], by: str = "Cluster") -> DataFrame:
    """The same values of k for every group."""
    return rows.select(by).distinct().withColumn("k", F.explode(F.array(*map(F.lit, ks))))


def lof(rows: DataFrame, features: Sequence[str], k: int = 20, by: str = "Cluster",
        row_id: str = "rule_id") -> DataFrame:
    """Add the factor and the flag (1 when the factor exceeds 1.5)."""
    scores = lof_scores(rows, features, k_table(rows, [k], by), k, by, row_id).drop("k")
    return flag_lof(rows, scores, by, row_id)


def flag_lof(rows: DataFrame, scores: DataFrame, by: str, row_id: str) -> DataFrame:
    return rows.join(scores, [by, row_id], "left").withColumns(
        {
            "lof_anomaly": F.coalesce(
                (F.col("factor") > OUTLIER_FACTOR).cast("int"), F.lit(0)
            ),
            "lof_score": -F.col("factor"),
        }
    ).drop("factor")


def score_stats(scores: DataFrame, by: str = "Cluster") -> DataFrame:
    """Spread of the negative factors per k, and the share below −1 in percent."""
    score = -F.col("factor")
    return scores.groupBy(by, "k").agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"),
        F.max(score).alias("max"),
        (F.avg((score < -1).cast("int")) * 100).alias("outliers_percent"),
    )


def box_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    q = quantiles(df, list(by), [value], [0.25, 0.5, 0.75])
    return q.select(
        *by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
        (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
    )


def spearman_of_neighbours(
    scores: DataFrame, by: str, row_id: str, step: str, value: str
) -> DataFrame:
    """Rank correlation between each step and the next of the same group."""
    ranked = average_rank(scores.select(by, row_id, step, value), [by, step], value, "r")
    # a handful of parameter values per group
    following = scores.select(by, step).distinct().withColumn(
        "next", F.lead(step).over(Window.partitionBy(by).orderBy(step))
    ).where(F.col("next").isNotNull())
    left = ranked.select(by, row_id, step, "r").join(following, [by, step])
    right = ranked.select(by, row_id, F.col(step).alias("next"), F.col("r").alias("r_next"))
    return (
        left.join(right, [by, row_id, "next"])
        .groupBy(by, step, "next")
        .agg(F.corr("r", "r_next").alias("spearman"))
    )
