"""Joins that an uneven key cannot slow down.

Groups such as customer segments are few: their rows go to the data (``join_groups``).
Keys such as customers or items are many, and one of them may hold a third of the table:
the rows of such a key are dealt to several slices (``join_uneven``). Which keys those are
comes from a frequent-items sketch that rides on the pass writing the table
(``stored_with_heavy``), or from a count inside the join's own plan. Building a join runs
nothing over its input.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, IntegralType, StringType

from shelfmark.session import stored

# a table of groups is broadcast up to this size, beyond it joined as the optimiser chooses
MAX_GROUPS, MAX_GROUP_BYTES = 10_000, 8 << 20
# items a sketch tells apart; counts are wrong by less than 2 / SKETCH_ITEMS of the rows
SKETCH_ITEMS = 16_384
MOST_HEAVY = 1_000


def join_groups(
    rows: DataFrame, per_group: DataFrame, by: list[str], how: str = "inner"
) -> DataFrame:
    """Join ``rows`` with a table of one (or a few) rows per group.

    The table is read up to ``MAX_GROUPS`` rows. If that is all of it and its bytes are few,
    it is broadcast with its size known. A larger one is joined as the optimiser chooses;
    adaptive skew handling then splits an uneven group.
    """
    found = per_group.limit(MAX_GROUPS + 1).toArrow()
    if found.num_rows > MAX_GROUPS or found.nbytes > MAX_GROUP_BYTES:
        return rows.join(per_group, by, how)
    known = rows.sparkSession.createDataFrame(found, schema=per_group.schema)
    return rows.join(F.broadcast(known), by, how)


def with_row_key(rows: DataFrame, on: list[str], into: str) -> DataFrame:
    """Add a key that no two rows share: the last column of ``on`` as text, with a number
    behind it where ``on`` repeats. The number follows the partitions, so write the result
    before joining on it. Only repeated keys are looked up, after counting in the map tasks."""
    keys = [F.col(c).alias(f"__on{i}") for i, c in enumerate(on)]
    repeated = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__times")).where(F.col("__times") > 1)
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__on{i}")) for i, c in enumerate(on)])
    own = F.col(on[-1]).cast("string")
    numbered = F.concat_ws("#", own, F.monotonically_increasing_id().cast("string"))
    key = F.when(F.col("__times").isNull(), own).otherwise(numbered)
    return rows.join(repeated, same, "left").select(*[f"`{c}`" for c in rows.columns], key.alias(into))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _slices(n: Column, total: Column, partitions: int) -> Column:
    return F.ceil(n * F.lit(float(partitions)) / total).cast("int")


def hot_keys(rows: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Keys with more rows than an average shuffle partition, with the number of slices that
    brings them back to that size. There cannot be more of them than partitions, so the table
    may be broadcast whatever the data. Nothing runs until a plan that holds it does.
    ``counts`` ``(*on, __n)`` are the rows by key where they are known already."""
    partitions = _partitions(rows)
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    slices = _slices(F.col("__n"), total, partitions).alias("__slices")
    return counts.where(F.col("__n") * F.lit(partitions) > total).select(*on, slices)


@dataclass(frozen=True)
class HeavyKeys:
    """Keys of a written table with more rows than an average partition: hashes and slices,
    at most ``MOST_HEAVY``."""

    on: tuple[str, ...]
    slices: tuple[tuple[int, int], ...]


def stored_with_heavy(df: DataFrame, *keys: list[str]) -> tuple[DataFrame, list[HeavyKeys | None]]:
    """``stored(df)``, and the heavy keys of each list of columns in ``keys``.

    The counts come from mergeable frequent-items sketches filled while the table is written:
    no pass of its own. Sketches tell hashes of keys, so they serve texts, whole numbers and
    dates; other keys give None, and a join on them counts for itself.
    """
    plain = (StringType, IntegralType, DateType, BinaryType)
    partitions = _partitions(df)
    sketches = [
        F.expr(f"approx_top_k(xxhash64({', '.join(f'`{c}`' for c in on)}), {MOST_HEAVY}, {SKETCH_ITEMS})")
        if all(isinstance(df.schema[c].dataType, plain) for c in on) else F.count(F.lit(None))
        for on in keys
    ]
    seen = Observation()
    watched = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), *[s.alias(f"top{i}") for i, s in enumerate(sketches)]
    )
    out = stored(watched)
    counted = seen.get
    found = []
    for i, on in enumerate(keys):
        if counted[f"top{i}"] == 0:
            found.append(None)
            continue
        heavy = [
            (x["item"], -(-x["count"] * partitions // counted["rows"]))
            for x in counted[f"top{i}"] or [] if x["count"] * partitions > counted["rows"]
        ]
        found.append(HeavyKeys(tuple(on), tuple(heavy)))
    return out, found


def join_uneven(
    rows: DataFrame, per_key: DataFrame, on: list[str], how: str = "inner",
    heavy: HeavyKeys | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of ``rows`` with at most one row per key, hot keys sliced.

    Adaptive skew handling does not reach a side that is itself an aggregate on the key,
    which is the usual case here. ``heavy`` names the hot keys of ``rows`` (or of the table it
    was cut from), ``counts`` their rows by key; without either they are counted within the
    plan. Rows with a NULL in the key
    match nothing and are dealt freely. The slice comes from the row and its input partition:
    it is the same when a lost task is run again.
    """
    # a hash sees the value's type, a join does not: hashes are taken of equal types only
    same_types = all(rows.schema[c].dataType == per_key.schema[c].dataType for c in on)
    if heavy is not None and same_types:
        key, link = [F.xxhash64(*[f"`{c}`" for c in on]).alias("__key")], ["__key"]
        known = [(h, n) for h, n in heavy.slices] or [(0, 1)]
        hot = rows.sparkSession.createDataFrame(known, "__key bigint, __slices int")
    else:
        key, link, hot = [], list(on), hot_keys(rows, on, counts)
    row = F.xxhash64(*[f"`{c}`" for c in rows.columns]) + F.spark_partition_id()
    unmatched = reduce(or_, [F.col(c).isNull() for c in on])
    slices = F.when(unmatched, F.lit(_partitions(rows))).otherwise(F.coalesce("__slices", F.lit(1)))
    left = rows.select("*", *key, row.alias("__row")).join(F.broadcast(hot), link, "left").withColumn(
        "__slice", F.pmod("__row", slices).cast("int")
    )
    copies = F.sequence(F.lit(0), F.coalesce(F.col("__slices"), F.lit(1)) - 1)
    right = per_key.select("*", *key).join(F.broadcast(hot), link, "left").withColumn(
        "__slice", F.explode(copies)
    )
    joined = left.drop("__key", "__row", "__slices").join(
        right.drop("__key", "__slices"), [*on, "__slice"], how
    )
    return joined.drop("__slice")
