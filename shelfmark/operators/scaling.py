"""Median fill and standard scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.numeric import infinite_to_null
from shelfmark.operators.groups import join_groups
from shelfmark.operators.ordering import medians


def scaled(value: Column, mean: Column, std: Column) -> Column:
    """(x − mean) / std, 0 for a column without spread."""
    return F.when(std > 0, F.try_divide(value - mean, std)).when(value.isNotNull(), F.lit(0.0))


def scale_statistics(columns: list[str]) -> list[Column]:
    """Mean and population standard deviation; exactly 0 for a constant column."""
    out = []
    for c in columns:
        value = F.col(c).cast("double")
        out += [
            F.avg(value).alias(f"{c}__mean"),
            F.when(F.min(value) == F.max(value), F.lit(0.0))
            .otherwise(F.stddev_pop(value)).alias(f"{c}__std"),
        ]
    return out


def fit_scaler(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """One row of means and deviations per group, or one row in all."""
    stats = scale_statistics(columns)
    return df.groupBy(*by).agg(*stats) if by else df.agg(*stats)


def apply_scaler(
    df: DataFrame, scaler: DataFrame, columns: list[str], names: dict[str, str],
    by: list[str] | None = None,
) -> DataFrame:
    """Add the scaled columns with the given statistics. Without groups the statistics are
    one row and enter as a scalar subquery; with groups they are joined."""
    stats = [f"{c}__{part}" for c in columns for part in ("mean", "std")]
    if by:
        joined = join_groups(df, scaler.select(*by, *stats), by, "left")
    else:
        one = scaler.select(F.struct(*stats)).scalar()
        joined = df.withColumn("__scaler", one)
        for s in stats:
            joined = joined.withColumn(s, F.col("__scaler").getField(s))
        joined = joined.drop("__scaler")
    return joined.withColumns(
        {
            names[c]: scaled(F.col(c).cast("double"), F.col(f"{c}__mean"), F.col(f"{c}__std"))
            for c in columns
        }
    ).drop(*stats)


def standard_scale(
    df: DataFrame, columns: list[str], by: list[str] | None = None, suffix: str = "_scaled"
) -> DataFrame:
    names = {c: f"{c}{suffix}" for c in columns}
    return apply_scaler(df, fit_scaler(df, columns, by), columns, names, by)


def median_impute(
    df: DataFrame, columns: list[str], by: list[str], outputs: dict[str, str] | None = None
) -> DataFrame:
    """Fill NULL, NaN and ±infinity with the group's exact median of the finite values."""
    outputs = outputs or {c: c for c in columns}
    finite = {c: infinite_to_null(F.col(c)) for c in columns}
    middle = medians(df.select(*by, *[finite[c].alias(c) for c in columns]), by, columns)
    middle = middle.select(*by, *[F.col(c).alias(f"{c}__median") for c in columns])
    filled = join_groups(df, middle, by, "left").withColumns(
        {outputs[c]: F.coalesce(finite[c], F.col(f"{c}__median")) for c in columns}
    )
    return filled.drop(*[f"{c}__median" for c in columns])
