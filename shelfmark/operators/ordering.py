"""Ranks, exact quantiles and top-n without ever putting one group into one task.

Every operator here orders *values*, not rows: equal values are counted before the
shuffle, the distinct values are cut into ranges by boundaries taken from the data, each
range is ordered on its own, and the ranges' sizes (a few numbers) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.operators.groups import join_uneven
from shelfmark.session import stored

MAX_RANGES = 512


def range_count(spark: SparkSession) -> int:
    """As many ranges as there are shuffle partitions, between 8 and 512."""
    return max(8, min(MAX_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))


def _range_of(bounds: Column, value: Column) -> Column:
    """Number of boundaries below the value."""
    return F.size(F.filter(bounds, lambda b: b < value))


def _with_ranges(values: DataFrame, key: str) -> DataFrame:
    """Add ``__range`` for a frame whose ``key`` is orderable (text or number).

    The boundaries are the keys with the smallest hashes: a uniform sample of the
    distinct keys that is the same on every run, at most 512 values in one array.
    """
    n = range_count(values.sparkSession)
    sample = (
        values.select(F.col(key).alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(n - 1)
    )
    bounds = sample.agg(F.array_sort(F.collect_list("k"))).scalar()
    return (
        values.withColumn("__bounds", bounds)
        .withColumn("__range", _range_of(F.col("__bounds"), F.col(key)))
        .drop("__bounds")
    )


def _with_offsets(ranged: DataFrame, by: list[str], key: str, weight: str) -> DataFrame:
    """Add ``__below``: the weight of all smaller keys of the same group."""
    totals = ranged.groupBy(*by, "__range").agg(F.sum(weight).alias("__in_range"))
    across = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and group: at most 512 per window partition
    totals = totals.withColumn(
        "__offset", F.coalesce(F.sum("__in_range").over(across), F.lit(0))
    ).drop("__in_range")
    within = (
        Window.partitionBy(*by, "__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum(weight).over(within), F.lit(0))
    return (
        ranged.withColumn("__inside", inside)
        .join(totals, [*by, "__range"])
        .withColumn("__below", F.col("__offset") + F.col("__inside"))
        .drop("__offset", "__inside", "__range")
    )


def dense_index(df: DataFrame, key: str, output: str) -> DataFrame:
    """0-based place of ``key`` among the distinct keys in order, on every row. The keys are
    counted and written once: boundaries, offsets and hot keys come from that one column."""
    counts = stored(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")))
    values = counts.select(key, F.lit(1).alias("__one")).where(F.col(key).isNotNull())
    # the window of offsets has no group of its own: a constant one holds the ≤ 512 ranges
    ranged = _with_ranges(values, key).withColumn("__all", F.lit(0))
    places = _with_offsets(ranged, ["__all"], key, "__one").select(
        key, F.col("__below").cast("bigint").alias(output)
    )
    return join_uneven(df, places, [key], "left", counts=counts)


def average_rank(df: DataFrame, by: list[str], value: str, output: str) -> DataFrame:
    """1-based rank of ``value`` in its group; equal values share their mean rank. Rows are
    counted by value and written once; all further passes read the counts."""
    counts = stored(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")))
    ranks = _with_offsets(_with_ranges(counts, value), by, value, "__n").select(
        *by, value, (F.col("__below") + (F.col("__n") + 1) / F.lit(2.0)).alias(output)
    )
    return join_uneven(df, ranks, [*by, value], counts=counts)


def quantiles(
    df: DataFrame, by: list[str], columns: list[str], probabilities: list[float]
) -> DataFrame:
    """Exact linearly interpolated quantiles, NULLs left out, one row per group and column:
    ``(*by, column, q)`` with ``q`` an array in the order of ``probabilities``.

    Only the ranges that hold a wanted position are ordered at all.
    """
    n = range_count(df.sparkSession)
    long = df.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                    for c in columns
                ]
            )
        ).alias("__cell"),
    ).select(*by, "__cell.*")
    counts = (
        long.where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*by, "column", "value")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    cuts = [i / n for i in range(1, n)]
    # one row per column, at most 511 numbers each: small enough to broadcast by construction
    bounds = counts.groupBy("column").agg(
        F.percentile_approx("value", cuts, F.lit(20 * n)).alias("__bounds")
    )
    keys = [*by, "column"]
    ranged = (
        counts.join(F.broadcast(bounds), "column")
        .withColumn("__range", _range_of(F.col("__bounds"), F.col("value")))
        .drop("__bounds")
    )
    totals = ranged.groupBy(*keys, "__range").agg(F.sum("__n").alias("__in_range"))
    group = Window.partitionBy(*keys)
    totals = totals.withColumn("__rows", F.sum("__in_range").over(group)).withColumn(
        "__offset",
        F.coalesce(
            F.sum("__in_range").over(
                group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )
    places = {}
    for i, p in enumerate(probabilities):
        at = (F.col("__rows") - 1) * F.lit(float(p))
        places[i] = (F.floor(at), F.ceil(at), at - F.floor(at))
    wanted = F.lit(False)
    for low, high, _ in places.values():
        for at in (low, high):
            wanted = wanted | (
                (at >= F.col("__offset")) & (at < F.col("__offset") + F.col("__in_range"))
            )
    within = Window.partitionBy(*keys, "__range").orderBy("value")
    ordered = (
        ranged.join(totals.where(wanted).drop("__in_range"), [*keys, "__range"])
        .withColumn("__upto", F.col("__offset") + F.sum("__n").over(
            within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("__below", F.col("__upto") - F.col("__n"))
    )

    def value_at(place: Column) -> Column:
        return F.max(
            F.when((F.col("__below") <= place) & (place < F.col("__upto")), F.col("value"))
        )

    picks = []
    for i, (low, high, share) in places.items():
        picks += [
            value_at(low).alias(f"__lo{i}"), value_at(high).alias(f"__hi{i}"),
            F.max(share).alias(f"__share{i}"),
        ]
    picked = ordered.groupBy(*keys).agg(*picks)
    values = [
        F.when(F.col(f"__lo{i}") == F.col(f"__hi{i}"), F.col(f"__lo{i}")).otherwise(
            F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__share{i}")
        )
        for i in places
    ]
    return picked.select(*keys, F.array(*values).alias("q"))


def medians(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row per group with the exact median of each column, under the column's name."""
    q = quantiles(df, by, columns, [0.5])
    return q.groupBy(*by).agg(
        *[F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(c) for c in columns]
    )


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group under ``order`` (which must be a total order).

    Up to Spark's group-limit threshold a row_number filter is already cut to n rows per
    group inside each map task. Above it the same is done in two steps: the first n of
    every (group, hash) slice, then the first n of what is left.
    """
    spark = df.sparkSession
    threshold = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        slices = range_count(spark)
        df = df.withColumn("__slice", F.pmod(F.xxhash64(*df.columns), F.lit(slices)))
        first = Window.partitionBy(*by, "__slice").orderBy(*order)
        df = df.withColumn("__place", F.row_number().over(first))
        df = df.where(F.col("__place") <= n).drop("__slice", "__place")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")
