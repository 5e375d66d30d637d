"""Recency, frequency, monetary value per customer, and segment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.numeric import round_half_even
from shelfmark.functions.text import whole_days
from shelfmark.operators.ordering import dense_index, medians

RFM = ["Recency", "Frequency", "Monetary"]

# Segment names by cluster id.
SEGMENT_NAMES = {
    0: "Casual Buyers",
    1: "Inactive Customers",
    2: "Loyal High-Value Customers",
    3: "VIP/Wholesale Customers",
    4: "Frequent Mid-to-High Value Customers",
}


def is_guest(customer: Column) -> Column:
    return customer.isNull() | customer.startswith("Guest_")


def fill_guest_ids(lines: DataFrame) -> DataFrame:
    """Lines without customer get ``Guest_`` and the 0-based place of their invoice among
    all distinct invoices. Lines cleaned by this engine never need it."""
    indexed = dense_index(lines, "InvoiceNo", "__place")
    numbered = F.concat(F.lit("Guest_"), F.col("__place").cast("string"))
    return indexed.withColumn("CustomerID", F.coalesce("CustomerID", numbered)).drop("__place")


def rfm(lines: DataFrame, fill_guests: bool = False) -> DataFrame:
    """One row per customer; customers with a missing value are left out."""
    lines = lines.select("CustomerID", "InvoiceNo", "InvoiceDate", "TotalPrice").withColumn(
        "IsGuest", is_guest(F.col("CustomerID"))
    )
    if fill_guests:
        lines = fill_guest_ids(lines)
    horizon = lines.agg(F.max("InvoiceDate") + F.expr("INTERVAL 1 DAY")).scalar()
    return (
        lines.where(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID")
        .agg(
            F.max("InvoiceDate").alias("__last"),
            F.count_distinct("InvoiceNo").alias("Frequency"),
            F.sum("TotalPrice").alias("Monetary"),
            F.bool_or("IsGuest").alias("IsGuest"),
        )
        .select(
            "CustomerID",
            whole_days(F.col("__last"), horizon).alias("Recency"),
            "Frequency", "Monetary", "IsGuest",
        )
        .dropna()
    )


def cluster_name(cluster: Column) -> Column:
    chain = None
    for key, name in SEGMENT_NAMES.items():
        chain = F.when(cluster == key, name) if chain is None else chain.when(cluster == key, name)
    return chain.otherwise(F.concat(F.lit("Cluster_"), cluster.cast("string")))


def guest_percentage(guests: Column, customers: Column) -> Column:
    share = F.when(customers > 0, guests / customers * F.lit(100.0))
    return round_half_even(share, 2)


def segment_summary(segments: DataFrame) -> DataFrame:
    """Mean and exact median of recency, frequency and value, guests, per segment name."""
    by = ["Cluster_Name"]
    means = segments.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in RFM],
        F.count("IsGuest").alias("IsGuest_count"),
        F.sum(F.col("IsGuest").cast("bigint")).alias("IsGuest_sum"),
    )
    middle = medians(segments, by, RFM)
    middle = middle.select(*by, *[F.col(c).alias(f"{c}_median") for c in RFM])
    joined = means.join(middle, by)
    columns = []
    for c in RFM:
        for part in ("mean", "median"):
            name = f"{c}_{part}"
            columns.append(round_half_even(F.col(name), 2).alias(name))
    return joined.select(
        *by, *columns, "IsGuest_count", "IsGuest_sum",
        guest_percentage(F.col("IsGuest_sum"), F.col("IsGuest_count")).alias("Guest_Percentage"),
    )
