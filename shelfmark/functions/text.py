"""Text and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, plus the four separators Java leaves out of that property.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"

# Texts a CSV reader takes for a missing value. Fixed values.
MISSING_TOKENS = [
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def strip(col: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(col: Column) -> Column:
    return F.when(~col.isin(MISSING_TOKENS), col)


def null_to_unknown(col: Column) -> Column:
    return F.coalesce(col, F.lit("unknown"))


def parse_timestamp(col: Column, formats: tuple[str, ...] = ("M/d/yyyy H:mm",)) -> Column:
    """First format that fits, NULL when none does; without time zone."""
    return F.coalesce(
        *[F.try_to_timestamp(col, F.lit(fmt)).cast("timestamp_ntz") for fmt in formats]
    )


def parse_decimal_comma(col: Column) -> Column:
    """Text with ``,`` or ``.`` as decimal mark to DOUBLE; bad text is an error."""
    return F.regexp_replace(col, ",", ".").cast("double")


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def whole_days(start: Column, end: Column) -> Column:
    """Completed 24-hour periods from ``start`` to ``end``."""
    return F.timestamp_diff("DAY", start, end).cast("int")


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
