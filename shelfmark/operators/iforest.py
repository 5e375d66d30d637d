"""Isolation forest (Liu, Ting and Zhou 2008), one forest per group.

A tree is grown from at most 256 rows, so a forest's growth is bounded whatever the size
of the table: the rows of each tree are those with the smallest hash of (seed, tree, row),
which no partitioning can change, and only rows below a hash threshold are replicated to
trees at all. A forest is a table of nodes; scoring brings slices of a group's rows and the
group's trees together, so that neither is ever held whole by the driver or a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.groups import join_groups
from shelfmark.operators.ordering import quantiles, top_n
from shelfmark.session import materialise

TREES = 100
SAMPLE = 256
HASH_RANGE = 2**53
# rows of a group that are scored together with one copy of its trees
SLICE_ROWS = 16_384
EULER = 0.5772156649015329

NODE_COLUMNS = (
    "tree int, node int, feature int, threshold double, `left` int, `right` int, "
    "samples int, path double"
)


def mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out = np.where(n == 2, 1.0, out)
    big = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(big - 1) + EULER) - 2 * (big - 1) / big, out)


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree: (node, feature or −1, threshold, left, right, samples, path)."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        node = len(nodes)
        if parent >= 0:
            nodes[parent][4 if is_right else 3] = node
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        splittable = np.nonzero(high > low)[0]
        if depth >= limit or len(rows) <= 1 or len(splittable) == 0:
            nodes.append([node, -1, 0.0, -1, -1, len(rows), depth + float(mean_path(len(rows)))])
            continue
        feature = int(rng.choice(splittable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= threshold
        if goes_left.all():  # the draw rounded up to the largest value
            threshold = float(np.nextafter(high[feature], low[feature]))
            goes_left = part[:, feature] <= threshold
        nodes.append([node, feature, threshold, -1, -1, len(rows), 0.0])
        todo.append((rows[~goes_left], depth + 1, node, True))
        todo.append((rows[goes_left], depth + 1, node, False))
    return nodes


def tree_samples(
    rows: DataFrame, features: Sequence[str], by: str, row_id: str, trees: int, sample: int,
    seed: int,
) -> DataFrame:
    """The rows of each tree: ``(by, tree, id, x)``, at most ``sample`` per tree.

    The threshold lets four times the sample through on average; a tree then takes the
    smallest hashes among those.
    """
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    hashed = f"pmod(xxhash64({seed}L, t, __id), {HASH_RANGE}L)"
    share = f"cast({4 * sample} as double) / __n"
    chosen = f"filter(sequence(0, {trees - 1}), t -> {hashed} < {share} * {HASH_RANGE}L)"
    vectors = rows.select(
        by, F.col(row_id).alias("__id"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
    )
    picked = (
        join_groups(vectors, sizes, [by])
        .withColumn("t", F.explode(F.expr(chosen)))
        .withColumn("__h", F.expr(hashed))
        .drop("__n")
    )
    return top_n(picked, [by, "t"], [F.col("__h"), F.col("__id")], sample)


def fit_forest(
    rows: DataFrame, features: Sequence[str], by: str = "Cluster", row_id: str = "rule_id",
    trees: int = TREES, sample: int = SAMPLE, seed: int = 42,
) -> DataFrame:
    """The forest as a node table keyed by group and tree, written once."""
    key_type = rows.schema[by].dataType.simpleString()

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__id")
        group, tree = part[by].iloc[0], int(part["t"].iloc[0])
        rng = np.random.default_rng([seed, zlib.crc32(str(group).encode()), tree])
        nodes = grow_tree(np.array(part["x"].tolist(), dtype=float), rng)
        out = pd.DataFrame(
            nodes, columns=["node", "feature", "threshold", "left", "right", "samples", "path"]
        )
        out.insert(0, "tree", tree)
        out.insert(0, by, group)
        return out

    samples = tree_samples(rows, features, by, row_id, trees, sample, seed)
    # the samples are small, so adaptive execution would grow all trees in one task; an
    # explicit number of partitions is kept, and the grouping reuses it
    tasks = min(trees, rows.sparkSession.sparkContext.defaultParallelism * 2)
    samples = samples.repartition(tasks, by, "t")
    return materialise(
        samples.groupBy(by, "t").applyInPandas(grow, f"`{by}` {key_type}, {NODE_COLUMNS}")
    )


def packed(forest: DataFrame, by: str = "Cluster") -> DataFrame:
    """One row per tree: ``(by, tree, nodes)``, nodes in order. A tree has at most 511."""
    columns = ["node", "feature", "threshold", "left", "right", "samples", "path"]
    return forest.groupBy(by, "tree").agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("nodes")
    )


def trees_of(table: pa.Table) -> list[dict]:
    """Node arrays of each tree of a ``packed`` table, in order of the trees."""
    lists = table.sort_by("tree").column("nodes").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    ends = np.cumsum([len(x) for x in lists])
    nodes = lists.flatten()
    fields = {
        c: nodes.field(c).to_numpy(zero_copy_only=False)
        for c in ("feature", "threshold", "left", "right", "samples", "path")
    }
    return [
        {c: v[end - len(x):end] for c, v in fields.items()} for x, end in zip(lists, ends)
    ]


def with_trees(
    rows: DataFrame, forest: DataFrame, features: Sequence[str], by: str, slice_rows: int,
    run: Callable[[pa.Table, np.ndarray, list[dict]], pa.Table], schema,
) -> DataFrame:
    """``run(rows, x, trees)`` for slices of about ``slice_rows`` rows of a group and the trees
    of that group, brought together by (group, slice).

    The forest stays a table: each slice gets a copy of its group's trees, so neither the
    number of groups nor that of rows is limited, and no task holds more than one slice.
    """
    slices = rows.groupBy(by).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(slice_rows)).cast("int").alias("__slices")
    )
    vector = F.array(*[F.col(f).cast("double") for f in features])
    # the slice comes from the row and its partition: the same when a lost task runs again
    dealt = F.pmod(F.xxhash64(*[f"`{c}`" for c in rows.columns]) + F.spark_partition_id(), F.col("__slices"))
    sliced = (
        join_groups(rows, slices, [by], "left").withColumn("__x", vector)
        .withColumn("__slice", F.coalesce(dealt.cast("int"), F.lit(0))).drop("__slices")
    )
    copies = F.sequence(F.lit(0), F.col("__slices") - 1)
    trees = join_groups(packed(forest, by), slices, [by]).withColumn("__slice", F.explode(copies))
    width = len(features)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        x = left.column("__x").combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        return run(left.drop_columns(["__x", "__slice"]), x, trees_of(right) if right.num_rows else [])

    # new names, since both sides may come from the same table
    trees = trees.select(*[F.col(c).alias(c) for c in (by, "__slice", "tree", "nodes")])
    left = sliced.groupBy(by, "__slice")
    return left.cogroup(trees.groupBy(by, "__slice")).applyInArrow(work, schema)


def mean_depth(trees: list[dict], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in trees:
        at = np.zeros(len(x), dtype=int)
        while True:
            feature = t["feature"][at]
            inner = feature >= 0
            if not inner.any():
                break
            left = x[rows, np.maximum(feature, 0)] <= t["threshold"][at]
            at = np.where(inner, np.where(left, t["left"][at], t["right"][at]), at)
        total += t["path"][at]
    return total / len(trees)


def score_forest(
    rows: DataFrame, forest: DataFrame, features: Sequence[str], by: str = "Cluster",
    output: str = "iforest_score",
) -> DataFrame:
    """Add −2^(−E[h]/c(ψ)): near −1 for rows that are easily set apart. Rows of a group
    without a forest get NULL."""
    schema = rows.withColumn(output, F.lit(0.0).cast("double")).schema
    schema[output].nullable = True

    def score(mine: pa.Table, x: np.ndarray, trees: list[dict]) -> pa.Table:
        if trees:
            unit = float(mean_path(trees[0]["samples"][0]))
            values = pa.array(-np.power(2.0, -mean_depth(trees, x) / unit), pa.float64())
        else:
            values = pa.nulls(len(x), pa.float64())
        return mine.append_column(output, values)

    return with_trees(rows, forest, features, by, SLICE_ROWS, score, schema)


def score_thresholds(
    scores: DataFrame, rates: Sequence[float], by: str = "Cluster", score: str = "iforest_score"
) -> DataFrame:
    """Exact score quantile at each rate: ``(by, rate, threshold)``."""
    q = quantiles(scores, [by], [score], list(rates))
    pairs = F.arrays_zip(F.array(*map(F.lit, map(float, rates))).alias("rate"), F.col("q"))
    return q.select(by, F.explode(pairs).alias("p")).select(
        by, F.col("p.rate").alias("rate"), F.col("p.q").alias("threshold")
    )


def flag_forest(
    scored: DataFrame, rates: DataFrame, by: str = "Cluster", score: str = "iforest_score"
) -> DataFrame:
    """Add the decision value (score − threshold) and the flag, at each group's own rate
    in ``rates`` ``(by, contamination)``."""
    wanted = [r["contamination"] for r in rates.select("contamination").distinct().collect()]
    thresholds = score_thresholds(scored, sorted(wanted), by, score)
    offsets = rates.join(
        thresholds, (rates[by] == thresholds[by]) & (rates["contamination"] == thresholds["rate"])
    ).select(rates[by].alias(by), F.col("threshold").alias("offset"))
    return with_decision(scored, offsets, by, score)


def with_decision(scored: DataFrame, offsets: DataFrame, by: str, score: str) -> DataFrame:
    decision = F.col(score) - F.col("offset")
    return (
        join_groups(scored, offsets, [by], "left")
        .withColumn("anomaly_score", F.coalesce(decision, F.lit(0.0)))
        .withColumn(
            "isolation_forest_anomaly", (F.col("anomaly_score") < 0).cast("int")
        )
    )
