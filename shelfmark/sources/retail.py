"""Readers of the engine's tables, and their schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import blank_to_null

RAW_COLUMNS = [
    "InvoiceNo", "StockCode", "Description", "Quantity",
    "InvoiceDate", "UnitPrice", "CustomerID", "Country",
]
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])

CLEANED_SCHEMA = (
    "InvoiceNo STRING, StockCode STRING, UnitPrice DOUBLE, Quantity BIGINT, "
    "InvoiceDate TIMESTAMP_NTZ, CustomerID STRING, Country STRING, Description STRING, "
    "CategoryExtraction STRING, TotalPrice DOUBLE, DayOfWeek STRING, Hour INT, "
    "Frequency BIGINT, Recency INT"
)
SEGMENTS_SCHEMA = (
    "CustomerID STRING, Recency INT, Frequency BIGINT, Monetary DOUBLE, IsGuest BOOLEAN, "
    "Cluster INT, Cluster_Name STRING, PC1 DOUBLE, PC2 DOUBLE"
)
SUMMARY_SCHEMA = (
    "Cluster_Name STRING, Recency_mean DOUBLE, Recency_median DOUBLE, Frequency_mean DOUBLE, "
    "Frequency_median DOUBLE, Monetary_mean DOUBLE, Monetary_median DOUBLE, "
    "IsGuest_count BIGINT, IsGuest_sum BIGINT, Guest_Percentage DOUBLE"
)
RULE_METRICS = [
    "antecedent support", "consequent support", "support", "confidence", "lift",
    "leverage", "conviction",
]
RULES_CSV_SCHEMA = (
    "antecedents STRING, consequents STRING, "
    + ", ".join(f"`{m}` DOUBLE" for m in RULE_METRICS)
    + ", Cluster INT"
)


def _read(spark: SparkSession, path: str, schema: str | T.StructType, format: str) -> DataFrame:
    if format == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).format(format).load(path)


def scan_raw(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Invoice lines from CSV, all text, missing-value texts as NULL.

    ``multi_line=True`` takes quoted texts with line breaks inside; a file is then read by one
    task, so leave it off where no text holds any.

    ``seq`` is the line's place in the input: file, block, then the running number
    inside the scan, so that 'first line' means the same however the scan is split.
    """
    lines = (
        spark.read.schema(RAW_SCHEMA).option("header", True).option("escape", '"')
        .option("multiLine", multi_line).csv(path)
    )
    return lines.select(
        *[blank_to_null(F.col(name)).alias(name) for name in RAW_COLUMNS if name != "Quantity"],
        blank_to_null(F.col("Quantity")).cast("bigint").alias("Quantity"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
    )


def scan_cleaned(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, path, CLEANED_SCHEMA, format)


def scan_segments(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Customer to cluster: two columns reach the scan."""
    return _read(spark, path, SEGMENTS_SCHEMA, format).select("CustomerID", "Cluster")


def scan_summary(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    return _read(spark, path, SUMMARY_SCHEMA, format)


def items_from_text(text: Column) -> Column:
    """``frozenset({'a', 'b'})`` to a sorted array; the text is never evaluated as code.

    Items may be in single or, when they hold an apostrophe, in double quotes.
    """
    found = F.regexp_extract_all(text, F.lit(r"""'((?:[^'\\]|\\.)*)'|"([^"]*)\""""), F.lit(0))
    inner = F.transform(found, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    plain = F.transform(inner, lambda x: F.replace(x, F.lit("\\'"), F.lit("'")))
    return F.array_sort(F.array_distinct(plain))


def scan_rules(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Association rules; set-valued columns arrive as sorted arrays from either format."""
    if format != "csv":
        return spark.read.format(format).load(path)
    # a rule set's text holds commas and is quoted; quotes inside it are doubled
    rules = (
        spark.read.schema(RULES_CSV_SCHEMA)
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )
    return rules.withColumns(
        {name: items_from_text(F.col(name)) for name in ("antecedents", "consequents")}
    )
