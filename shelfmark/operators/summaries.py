"""The small tables behind the dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.numeric import round_half_even
from shelfmark.functions.rules import ARROW, rule_string
from shelfmark.operators.groups import join_groups
from shelfmark.operators.ordering import quantiles
from shelfmark.operators.rfm import RFM

# The rule explorer's defaults and the number of histogram bins.
EXPLORER = {"min_confidence": 0.5, "min_lift": 1.5, "min_support": 0.01}
BINS = 30


def kpi_totals(lines: DataFrame, segments: DataFrame, rules: DataFrame) -> DataFrame:
    """Customers, lines, rules and revenue as (kpi, value)."""
    def row(df: DataFrame, kpi: str, value) -> DataFrame:
        return df.agg(value.cast("double").alias("value")).select(F.lit(kpi).alias("kpi"), "value")

    return (
        row(segments, "customers", F.count(F.lit(1)))
        .unionByName(row(lines, "transactions", F.count(F.lit(1))))
        .unionByName(row(rules, "rules", F.count(F.lit(1))))
        .unionByName(row(lines, "revenue", F.sum("TotalPrice")))
    )


def daily_revenue(lines: DataFrame) -> DataFrame:
    dated = lines.where(F.col("InvoiceDate").isNotNull())
    return dated.groupBy(F.to_date("InvoiceDate").alias("day")).agg(
        F.sum("TotalPrice").alias("revenue")
    )


def cluster_counts(df: DataFrame, by: str = "Cluster") -> DataFrame:
    """Rows per cluster and their share in percent."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("rows") * 100.0 / total)


def rfm_mean_by_cluster(segments: DataFrame) -> DataFrame:
    return segments.groupBy("Cluster").agg(*[F.avg(c).alias(c) for c in RFM])


def cluster_card(segments: DataFrame, cluster: int) -> DataFrame:
    return segments.where(F.col("Cluster") == cluster).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("Monetary").alias("avg_value"),
        F.avg("Frequency").alias("avg_frequency"),
    )


def head_n(df: DataFrame, order_by: Sequence, n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation (n−1), minimum, exact quartiles and maximum per column."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    moments = (
        df.select(F.explode(cells).alias("c"))
        .groupBy("c.column")
        .agg(
            F.count("c.value").alias("count"), F.avg("c.value").alias("mean"),
            F.stddev_samp("c.value").alias("std"), F.min("c.value").alias("min"),
            F.max("c.value").alias("max"),
        )
    )
    q = quantiles(df, [], list(columns), [0.25, 0.5, 0.75])
    return moments.join(q, "column", "left").select(
        "column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max",
    )


def rule_kpis(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count(F.lit(1)).alias("total_rules"), F.avg("confidence").alias("avg_confidence"),
        F.avg("lift").alias("avg_lift"), F.avg("support").alias("avg_support"),
    )


def explorer_bounds(rules: DataFrame) -> DataFrame:
    return rules.agg(F.max("lift").alias("max_lift"), F.max("support").alias("max_support"))


def rule_explorer(
    rules: DataFrame, clusters: Sequence[int] | None = None,
    min_confidence: float = EXPLORER["min_confidence"], min_lift: float = EXPLORER["min_lift"],
    min_support: float = EXPLORER["min_support"],
) -> DataFrame:
    if clusters is not None:
        rules = rules.where(F.col("Cluster").isin(list(clusters)))
    return rules.where(
        (F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)
        & (F.col("support") >= min_support)
    )


def explorer_table(rules: DataFrame) -> DataFrame:
    """Rules as a reader sees them: rule text and four-digit numbers."""
    shown = ["support", "confidence", "lift", "leverage", "conviction"]
    return rules.select(
        rule_string(F.col("antecedents"), F.col("consequents"), ARROW).alias("Rule"), "Cluster",
        *[round_half_even(F.col(c), 4).alias(c) for c in shown],
    )


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """Equal-width bins between the group's smallest and largest value, with densities;
    the last bin includes its upper edge. Empty bins have no row."""
    by = list(by)
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    limits = known.groupBy(*by).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("total")
    )
    # a constant column is spread half a unit to either side
    flat = F.col("lo") == F.col("hi")
    limits = limits.select(
        *by, "total", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(
        F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)
    )
    if by:
        placed = join_groups(known, limits, by)
    else:
        placed = known.withColumn("l", limits.select(F.struct("*")).scalar()).select("v", "l.*")
    return (
        placed.groupBy(*by, "lo", "hi", "total", place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            *by, "bin", (F.col("lo") + width * F.col("bin")).alias("left_edge"), "rows",
            (F.col("rows") / (F.col("total") * width)).alias("density"),
        )
    )
