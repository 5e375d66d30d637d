"""Exact k nearest neighbours inside each group, without forming all pairs.

1. Equal vectors are one point with a multiplicity, so any number of copies costs one.
2. A metric tree of two levels: pivots are a hash sample of the points, one in ``CELL_POINTS``;
   chief pivots are a sample of the pivots, about the square root of their number. A point goes
   to its nearest chief, then to the nearest pivot under that chief: its cell.
3. Each point searches its own cell, which bounds its k-th distance from above.
4. It then goes down the tree once more: chiefs, and pivots below them, whose balls or whose
   borders (the triangle inequality, twice) can't hold anything nearer are left out, exactly.

Pivots, radii and sizes are tables; nothing of them reaches the driver, and a block of points
meets only the chiefs of its group and the pivots of one chief. Searches are joins of blocks on
the cell, computed with numpy per pair of blocks; the blocks of a cell are dealt in tiles, so a
dense cell is no single key. A block pair emits at most k+1 rows per searching point.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.operators.groups import join_groups, join_uneven
from shelfmark.operators.silhouette import pairwise
from shelfmark.session import materialise, stored

CELL_POINTS = 1024
BLOCK_POINTS = 1024
# points that one task takes down the tree at a time
SLICE_POINTS = 8192
HASH_RANGE = 2**53
BLOCK = 1024
# distances closer than this count as equal and are ordered by id
DIGITS = 9


def distinct_points(
    rows: DataFrame, by: str, row_id: str, features: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """``(by, point, x, copies)`` for the distinct vectors, and ``(by, id, point)``."""
    vectors = rows.select(
        by, F.col(row_id).alias("id"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
    )
    points = materialise(
        vectors.groupBy(by, "x").agg(F.min("id").alias("point"), F.count(F.lit(1)).alias("copies"))
    )
    copies = points.select(by, "x", F.col("copies").alias("__n"))
    members = join_uneven(vectors, points.select(by, "x", "point"), [by, "x"], counts=copies)
    members = members.select(by, "id", "point")
    return points, members


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def _top_k(query: np.ndarray, data: np.ndarray, names, limit: np.ndarray, keep: int):
    """For every query row the ``keep`` nearest data rows not beyond its limit."""
    distance = pairwise(query, data)
    rounded = np.round(distance, DIGITS)
    if keep < len(data):
        edge = np.partition(rounded, keep - 1, axis=1)[:, keep - 1]
    else:
        edge = np.full(len(query), np.inf)
    rows, cols = np.nonzero((rounded <= edge[:, None]) & (distance <= limit[:, None]))
    order = np.lexsort((names[cols], rounded[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    # ties at the edge may leave more than wanted: keep the first of each row
    first = np.searchsorted(rows, np.arange(len(query)))
    kept = np.arange(len(rows)) - first[rows] < keep
    return rows[kept], cols[kept], distance[rows[kept], cols[kept]]


def _search(pairs: DataFrame, by: str) -> DataFrame:
    """Nearest of each pair of a query block (``q_…``) and a data block of one cell."""
    key_type = pairs.schema[by].dataType.simpleString()
    id_type = pairs.schema["points"].dataType.elementType.simpleString()
    schema = f"`{by}` {key_type}, point {id_type}, near {id_type}, d double, copies bigint, k int"

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False, name=None):
                row = dict(zip(batch.columns, r))
                names = np.array(list(row["points"]))
                ranks = np.argsort(np.argsort(names))
                q = np.array(row["q_points"])
                rows, cols, d = _top_k(
                    np.asarray(row["q_x"], dtype=float).reshape(len(q), -1),
                    np.asarray(row["x"], dtype=float).reshape(len(names), -1),
                    ranks, np.asarray(row["q_limit"], dtype=float), row["k"] + 1,
                )
                yield pd.DataFrame(
                    {
                        by: row[by], "point": q[rows], "near": names[cols], "d": d,
                        "copies": np.asarray(row["copies"])[cols], "k": row["k"],
                    }
                )

    # a joined row is two blocks; Spark closes an Arrow batch at 64 MB
    return pairs.mapInPandas(nearest, schema)


def _placed(candidates: DataFrame, by: str) -> DataFrame:
    """Candidates in order with the number of neighbours before each, self left out.

    ``near = point`` stands for the point's other copies."""
    others = F.col("copies") - (F.col("near") == F.col("point")).cast("int")
    order = Window.partitionBy(by, "point").orderBy(F.round("d", DIGITS), "near")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        candidates.withColumn("copies", others)
        .where(F.col("copies") > 0)
        .withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0)))
        .where(F.col("before") < F.col("k"))
    )


def _numbered(pivots: DataFrame, by: list[str], number: str) -> DataFrame:
    """Pivots as ``(*by, number, p)``; there are about the square root of all in a group."""
    order = Window.partitionBy(*by).orderBy("point")
    place = (F.row_number().over(order) - 1).cast("int").alias(number)
    return pivots.select(*by, F.col("x").alias("p"), place)


def _nearest_pivot(points: DataFrame, pivots: DataFrame, by: list[str], number: str, away: str) -> DataFrame:
    """Add the number of the nearest pivot of the same ``by`` and the distance to it."""
    schema = points.withColumn(number, F.lit(0)).withColumn(away, F.lit(0.0)).schema
    sizes = points.groupBy(*by).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(SLICE_POINTS)).cast("int").alias("__slices")
    )
    sliced = join_groups(points, sizes, by).withColumn(
        "__slice", F.pmod(F.xxhash64("point"), F.col("__slices")).cast("int")
    ).drop("__slices")
    copies = join_groups(pivots, sizes, by).withColumn(
        "__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))
    ).drop("__slices")
    copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])  # may share its source with the left

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(number)
        centres, x = _matrix(right["p"]), _matrix(left["x"])
        at, far = np.zeros(len(x), np.int32), np.zeros(len(x))
        for start in range(0, len(x), BLOCK):
            distance = pairwise(x[start:start + BLOCK], centres)
            at[start:start + BLOCK] = distance.argmin(axis=1)
            far[start:start + BLOCK] = distance.min(axis=1)
        numbers = right[number].to_numpy()
        return left.drop(columns="__slice").assign(**{number: numbers[at], away: far})

    left = sliced.groupBy(*by, "__slice")
    return left.cogroup(copies.groupBy(*by, "__slice")).applyInPandas(place, schema)


def _balls(cells: DataFrame, pivots: DataFrame, by: list[str], number: str, away: str) -> DataFrame:
    """``(*by, balls)``: number, centre, radius, rows and blocks of each pivot that has points."""
    held = cells.groupBy(*by, number).agg(
        F.sum("copies").alias("rows"), F.max(away).alias("radius"),
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_POINTS)).cast("int").alias("blocks"),
    )
    ball = F.struct(F.col(number).alias("number"), "p", "radius", "rows", "blocks")
    return held.join(pivots, [*by, number]).groupBy(*by).agg(F.collect_list(ball).alias("balls"))


def _visits(queries: DataFrame, by: str, own: str, number: str) -> DataFrame:
    """Send the points of each query block to the balls that may hold something nearer.

    A row of ``queries`` is a block with the ``balls`` to choose from. The limit of a point
    falls to where the nearest balls together hold more than k rows. Balls of another parent
    are all open; among its own parent's (``own``) the block's own ball is left out.
    """
    keep = [c for c in queries.columns if c not in ("balls", "q_points", "q_x", "q_limit")]
    kinds = dict(queries.dtypes)
    points = ", ".join(f"{c} {kinds[c]}" for c in ("q_points", "q_x", "q_limit"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", {points}, {number} int, blocks int"

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False, name=None):
                row = dict(zip(batch.columns, r))
                balls = list(row["balls"])
                names = np.array(row["q_points"])
                x = np.asarray(row["q_x"], dtype=float).reshape(len(names), -1)
                distance = pairwise(x, np.array([list(b["p"]) for b in balls], dtype=float))
                radius = np.array([b["radius"] for b in balls])
                whole = distance + radius
                order = np.argsort(whole, axis=1)
                reached = np.array([b["rows"] for b in balls])[order].cumsum(axis=1) > row["k"]
                cap = np.where(reached, np.take_along_axis(whole, order, 1), np.inf).min(axis=1)
                limit = np.minimum(np.asarray(row["q_limit"], dtype=float), cap * (1 + 1e-9) + 1e-8)
                nearest = distance.min(axis=1)
                least = np.maximum(distance - radius, (distance - nearest[:, None]) / 2)
                opened = least <= limit[:, None]
                for j in np.nonzero(opened.any(axis=0))[0]:
                    if own and row[own] and balls[j]["number"] == row[f"q_{number}"]:
                        continue
                    some = np.nonzero(opened[:, j])[0]
                    yield pd.DataFrame(
                        {
                            **{c: [row[c]] for c in keep},
                            "q_points": [names[some].tolist()], "q_x": [x[some].ravel().tolist()],
                            "q_limit": [limit[some].tolist()], number: [int(balls[j]["number"])],
                            "blocks": [int(balls[j]["blocks"])],
                        }
                    )

    return queries.mapInPandas(choose, schema)


def nearest_neighbours(points: DataFrame, by: str, k: int | DataFrame) -> DataFrame:
    """``(by, point, near, d, copies, k, before)``: the nearest points of each point in order,
    each with its copies and the number of neighbours before it, until k are covered.

    ``k`` is one number, or a table ``(by, k)`` with each group's own. Neighbour ``near``
    counts ``min(copies, k − before)`` times among the k nearest.
    """
    draw = (F.pmod(F.xxhash64("point"), F.lit(HASH_RANGE)) / HASH_RANGE).alias("draw")
    drawn = points.select(by, "point", "x", "copies", draw)
    groups = drawn.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("first"))
    if isinstance(k, DataFrame):
        groups = groups.join(k.groupBy(by).agg(F.max("k").cast("int").alias("k")), by)
    else:
        groups = groups.withColumn("k", F.lit(k))
    groups = materialise(groups)
    # chiefs are a sample of the pivots, the point with the smallest hash is always one
    first = F.col("draw") <= F.col("first")
    pivot, cells_wanted = F.lit(1 / CELL_POINTS), F.greatest(F.col("n") / CELL_POINTS, F.lit(1.0))
    tagged = join_groups(drawn, groups, [by]).select(
        by, "point", "x", "copies", (first | (F.col("draw") < pivot)).alias("pivot"),
        (first | (F.col("draw") < pivot / F.sqrt(cells_wanted))).alias("chief_pivot"),
    )
    tagged = materialise(tagged)
    chiefs = materialise(_numbered(tagged.where("chief_pivot"), [by], "chief"))
    placed = materialise(_nearest_pivot(tagged.drop("chief_pivot"), chiefs, [by], "chief", "chief_away"))
    pivots = materialise(_numbered(placed.where("pivot"), [by, "chief"], "cell"))
    cells = materialise(
        _nearest_pivot(placed.drop("pivot"), pivots, [by, "chief"], "cell", "away")
    )

    place = [by, "chief", "cell"]
    sizes = cells.groupBy(*place).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_POINTS)).cast("int").alias("blocks")
    )
    chunk = F.pmod(F.xxhash64("point", F.lit("block")), F.col("blocks")).cast("int")
    chunked = join_groups(cells, sizes, place).withColumn("chunk", chunk)
    packed = chunked.groupBy(*place, "blocks", "chunk")
    blocks = packed.agg(F.collect_list(F.struct("point", "x", "copies")).alias("p")).select(
        *place, "blocks", "chunk", F.col("p.point").alias("points"),
        F.flatten("p.x").alias("x"), F.col("p.copies").alias("copies"),
    )
    blocks = stored(blocks)
    queries = join_groups(blocks, groups.select(by, "k"), [by]).select(
        *place, "k", "blocks", "chunk", F.col("points").alias("q_points"), F.col("x").alias("q_x"),
        F.transform("points", lambda p: F.lit(float("inf"))).alias("q_limit"),
    )
    # every block of a cell meets every other: both sides are dealt to tiles
    side = F.ceil(F.sqrt(F.col("blocks"))).cast("int")
    tiled_queries = queries.withColumn("tile", F.col("chunk") % side).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).drop("chunk", "blocks")
    tiled_blocks = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0), side - 1))).withColumn(
        "other", F.col("chunk")
    ).drop("chunk", "blocks")
    inside = _search(tiled_queries.join(tiled_blocks, [*place, "tile", "other"]), by)
    several = sizes.groupBy(by).agg(F.count(F.lit(1)).alias("cells")).where(F.col("cells") > 1)
    if several.isEmpty():
        return _placed(inside, by)

    inside = stored(inside)
    reached = _placed(inside, by).groupBy(by, "point").agg(
        F.max("d").alias("d"), F.max(F.col("before") + F.col("copies")).alias("found"),
        F.first("k").alias("k"),
    )
    limit = F.when(F.col("found") >= F.col("k"), F.col("d") * (1 + 1e-9) + 1e-8)
    bounded = chunked.join(reached, [by, "point"], "left").withColumn(
        "limit", F.coalesce(limit, F.lit(float("inf")))
    )
    again = bounded.groupBy(*place, "chunk").agg(F.collect_list(F.struct("point", "x", "limit")).alias("p"))
    again = join_groups(again, groups.select(by, "k"), [by]).select(
        by, F.col("chief").alias("q_chief"), F.col("cell").alias("q_cell"), "k",
        F.col("p.point").alias("q_points"), F.flatten("p.x").alias("q_x"), F.col("p.limit").alias("q_limit"),
    )
    to_chiefs = join_groups(again, _balls(cells, chiefs, [by], "chief", "chief_away"), [by])
    at_chiefs = _visits(to_chiefs, by, "", "chief").drop("blocks")
    below = _balls(cells, pivots, [by, "chief"], "cell", "away")
    to_cells = at_chiefs.join(below, [by, "chief"]).withColumn("home", F.col("chief") == F.col("q_chief"))
    at_cells = _visits(to_cells, by, "home", "cell").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).drop("blocks")
    visits = at_cells.join(blocks.drop("blocks"), [*place, "chunk"])
    return _placed(inside.unionByName(_search(visits, by)), by)
