"""Job 1: raw invoice lines to the cleaned table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfmark.operators import cleaning as c
from shelfmark.operators.groups import stored_with_heavy

OUTPUT = [
    "InvoiceNo", "StockCode", "UnitPrice", "Quantity", "InvoiceDate", "CustomerID", "Country",
    "Description", "CategoryExtraction", "TotalPrice", "DayOfWeek", "Hour", "Frequency", "Recency",
]


def merged_lines(raw: DataFrame, date_formats: tuple[str, ...] = ("M/d/yyyy H:mm",)) -> DataFrame:
    """Merged, typed, filtered lines with normalised texts: one shuffle, for the merge.

    The Quantity and Country filters read merged values and stay behind the merge; the
    InvoiceNo and price tests are on its keys, so the optimiser may run them before it.
    """
    lines = c.guest_id(c.drop_missing_description(raw))
    lines = c.parse_invoice_date(c.cast_types(c.merge_duplicates(lines)), date_formats)
    lines = c.filter_positive(c.filter_cancelled(c.filter_country(lines)))
    return c.normalise_text(lines)


def preprocess(raw: DataFrame, date_formats: tuple[str, ...] = ("M/d/yyyy H:mm",)) -> DataFrame:
    """The cleaned table. The merged lines are written once, since the customer frequency,
    the latest date and the distinct descriptions are further passes over them."""
    lines, (customers, texts) = stored_with_heavy(
        merged_lines(raw, date_formats), ["CustomerID"], ["Description"]
    )
    lines = c.with_category_of_texts(lines, heavy=texts)
    lines = c.row_recency(c.customer_frequency(lines, customers))
    return c.time_features(c.total_price(lines)).select(*OUTPUT)
