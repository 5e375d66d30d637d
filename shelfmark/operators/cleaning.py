"""Raw invoice lines to cleaned, categorised lines."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.functions.categories import with_category
from shelfmark.operators.groups import HeavyKeys, join_uneven


def drop_missing_description(lines: DataFrame) -> DataFrame:
    return lines.dropna(subset=["Description"])


def customer_type(lines: DataFrame) -> DataFrame:
    return lines.withColumn(
        "CustomerType",
        F.when(F.col("CustomerID").isNull(), "Guest").otherwise("Registered"),
    )


def guest_id(lines: DataFrame) -> DataFrame:
    """A line without customer gets an id of its invoice."""
    return lines.withColumn(
        "CustomerID",
        F.coalesce("CustomerID", F.concat(F.lit("Guest_"), F.col("InvoiceNo"))),
    )


def merge_duplicates(lines: DataFrame, order_by: str = "seq") -> DataFrame:
    """One line per (InvoiceNo, StockCode, UnitPrice text): quantities add up, every other
    column takes its first non-null value in line order. Lines with a null key go.

    Partial aggregation runs before the shuffle, so a key repeated over a third of the
    table still sends one row per map task. Lines without a gap compete as one, which carries
    their place in the order once; the columns of the other lines each carry their own.
    """
    keys, values = ["InvoiceNo", "StockCode", "UnitPrice"], ["InvoiceDate", "CustomerID", "Country", "Description"]
    at = F.col(order_by).alias("at")
    whole = reduce(and_, [F.col(v).isNotNull() for v in values])
    placed = F.col(order_by).isNotNull()

    def first(name: str) -> Column:
        alone, line = F.col(f"__{name}"), F.col("__line")
        of_line = alone.isNull() | (line["at"] <= alone["at"])
        return F.when(of_line, line[name]).otherwise(alone["value"]).alias(name)

    candidates = {
        "__line": F.when(placed & whole, F.struct(at, *values)),
        **{
            f"__{v}": F.when(placed & ~whole & F.col(v).isNotNull(), F.struct(at, F.col(v).alias("value")))
            for v in values
        },
    }
    return (
        lines.dropna(subset=keys)
        .select(*keys, "Quantity", *[c.alias(name) for name, c in candidates.items()])
        .groupBy(*keys)
        .agg(F.sum("Quantity").alias("Quantity"), *[F.min(c).alias(c) for c in candidates])
        .select(*keys, "Quantity", *[first(v) for v in values])
    )


def cast_types(lines: DataFrame) -> DataFrame:
    return lines.withColumns(
        {
            "CustomerID": F.col("CustomerID").cast("string"),
            "UnitPrice": text.parse_decimal_comma(F.col("UnitPrice")),
        }
    )


def parse_invoice_date(lines: DataFrame, formats: tuple[str, ...] = ("M/d/yyyy H:mm",)) -> DataFrame:
    return lines.withColumn("InvoiceDate", text.parse_timestamp(F.col("InvoiceDate"), formats))


def filter_country(lines: DataFrame) -> DataFrame:
    """Drop 'Unspecified'; a missing country stays."""
    return lines.filter(~F.col("Country").eqNullSafe(F.lit("Unspecified")))


def filter_cancelled(lines: DataFrame) -> DataFrame:
    """Drop refunds (C…) and bad-debt adjustments (A…)."""
    invoice = F.col("InvoiceNo")
    return lines.filter(~(invoice.startswith("C") | invoice.startswith("A")))


def filter_positive(lines: DataFrame) -> DataFrame:
    return lines.filter((F.col("Quantity") > 0) & (F.col("UnitPrice") > 0))


def normalise_text(lines: DataFrame) -> DataFrame:
    return lines.withColumns(
        {
            "Description": F.upper(text.strip(F.col("Description"))),
            "Country": text.strip(F.col("Country")),
        }
    )


def total_price(lines: DataFrame) -> DataFrame:
    return lines.withColumn("TotalPrice", F.col("Quantity") * F.col("UnitPrice"))


def time_features(lines: DataFrame) -> DataFrame:
    return lines.withColumns(
        {
            "DayOfWeek": text.weekday_name(F.col("InvoiceDate")),
            "Hour": F.hour("InvoiceDate"),
        }
    )


def customer_frequency(lines: DataFrame, heavy: HeavyKeys | None = None) -> DataFrame:
    """Distinct invoices of the line's customer, on every line.

    Counted over (customer, invoice) pairs first, so a customer with a third of all lines
    is spread over the cluster; the join back slices such a customer.
    """
    per_customer = lines.groupBy("CustomerID").agg(
        F.count_distinct("InvoiceNo").alias("Frequency")
    )
    return join_uneven(lines, per_customer, ["CustomerID"], "left", heavy)


def with_category_of_texts(
    lines: DataFrame, description: str = "Description", output: str = "CategoryExtraction",
    heavy: HeavyKeys | None = None,
) -> DataFrame:
    """The category column, worked out once per distinct description and joined back, however
    many there are: a frequent description is dealt to slices, and where the descriptions turn
    out few the join becomes a broadcast by itself. ``lines`` should be a written table, whose
    distinct texts are a pass of their own."""
    texts = lines.select(description).where(F.col(description).isNotNull()).distinct()
    known = with_category(texts, description, output)
    joined = join_uneven(lines, known, [description], "left", heavy)
    return joined.withColumn(output, text.null_to_unknown(F.col(output)))


def row_recency(lines: DataFrame) -> DataFrame:
    """Completed days from the line's date to the latest date of the whole table."""
    latest = lines.agg(F.max("InvoiceDate")).scalar()
    return lines.withColumn("Recency", text.whole_days(F.col("InvoiceDate"), latest))


__all__ = [
    "cast_types", "customer_frequency", "customer_type", "drop_missing_description",
    "filter_cancelled", "filter_country", "filter_positive", "guest_id", "merge_duplicates",
    "normalise_text", "parse_invoice_date", "row_recency", "time_features", "total_price",
    "with_category", "with_category_of_texts",
]
