"""Exact Euclidean silhouette.

It needs the sum of every point's distances to the points of each label. In up to three
dimensions the sums come from a tree of cells (``operators/distance_sums.py``): near points one by
one, far ones through a few nodes of their cell, each interpolation right to 1e-9 of the distance,
with work that grows as n log n. Equal points are one with a weight. Subtrees are the tasks: one pass packs their
leaves and works out their cells' weights, another brings to each what its leaves need, which the
boxes of the cells tell beforehand.

In more dimensions a cell would need too many nodes, and the work is quadratic; what is kept
small is everything else. Points are packed into blocks of about a thousand and the blocks
dealt to ``g`` bands. A tile is a pair of bands, and each pair of blocks is computed once,
in its tile, for both sides: a block is sent to g tiles, where g² / 2 of them keep the
cluster busy. From a tile come the distance sums of its blocks by label; added up by block
they give the scores. No pair of points is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from shelfmark.operators import distance_sums as ds
from shelfmark.operators.distance_sums import pairwise
from shelfmark.session import stored

# points of a block or of a leaf of the tree
BLOCK_ROWS = 1024
# points of one band, two of which a task holds
MOST_BAND_ROWS = 250_000
TILES_PER_TASK = 4
# the tree is grown from a sample: so many points of each leaf, and at most so many in all
SAMPLE_OF_LEAF, MOST_SAMPLED = 64, 1_000_000
LEAST_LEAVES = 4


def _scores(own: np.ndarray, sums: np.ndarray, sizes: np.ndarray, times: np.ndarray | float = 1.0) -> float:
    """Sum of the points' silhouettes: own labels, distance sums and sizes per label; a point
    counts ``times``."""
    rows = np.arange(len(own))
    n_own = sizes[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = sums[rows, own] / (n_own - 1)
        means = np.where(sizes > 0, sums / sizes, np.inf)
        means[rows, own] = np.inf
        outer = means.min(axis=1)
        value = (outer - inner) / np.maximum(inner, outer)
    value[(n_own <= 1) | ~np.isfinite(value)] = 0.0
    return float((value * times).sum())


def silhouette(
    points: DataFrame, features: Sequence[str], labels: Sequence[str], row_id: str
) -> DataFrame:
    """Mean silhouette of each labelling: ``(label, silhouette)``. Several labellings of
    the same points share one pass over the distances."""
    numbers = [F.col(f).cast("double") for f in features]
    plain = [F.abs(x) < F.lit(float("inf")) for x in numbers] + [F.col(c).cast("int") >= 0 for c in labels]
    size = points.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.coalesce(reduce(and_, plain), F.lit(False))).alias("plain"),
        *[F.max(c).alias(f"__{i}") for i, c in enumerate(labels)],
    ).first()
    if size["plain"] and len(features) <= ds.MOST_DIMENSIONS:
        widths = [int(size[f"__{i}"]) + 1 for i in range(len(labels))]
        totals = _by_cells(points, features, labels, widths)
    else:
        totals = _by_tiles(points, features, labels, row_id, size)
    names = F.array(*map(F.lit, labels))
    return (
        totals.groupBy("i")
        .agg((F.sum("total") / F.sum("n")).alias("silhouette"))
        .select(F.element_at(names, F.col("i") + 1).alias("label"), "silhouette")
    )


def _sizes(points: DataFrame, labels: Sequence[str], widths: list[int], times: Column) -> list[np.ndarray]:
    """Rows by label, a few numbers."""
    sizes = [np.zeros(w) for w in widths]
    labelled = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("int").alias("l")) for i, c in enumerate(labels)]))
    for r in points.select(labelled.alias("c"), times.alias("n")).groupBy("c.i", "c.l").agg(F.sum("n").alias("n")).collect():
        sizes[r["i"]][r["l"]] = r["n"]
    return sizes


TOTALS = "i int, total double, n bigint"


def _totals(scores: list[float], n: int) -> pa.Table:
    return pa.table({
        "i": pa.array(range(len(scores)), pa.int32()), "total": pa.array(scores, pa.float64()),
        "n": pa.array([n] * len(scores), pa.int64()),
    })


def _by_cells(
    points: DataFrame, features: Sequence[str], labels: Sequence[str], widths: list[int]
) -> DataFrame:
    """Sums of the scores and counts by labelling and subtree: ``(i, total, n)``."""
    spark = points.sparkSession
    d, n_labels = len(features), len(labels)
    xs, ls = [f"x{j}" for j in range(d)], [f"l{i}" for i in range(n_labels)]
    distinct = stored(
        points.select(
            *[F.col(f).cast("double").alias(x) for f, x in zip(features, xs)],
            *[F.col(c).cast("int").alias(l) for c, l in zip(labels, ls)],
        )
        .groupBy(*xs, *ls).agg(F.count(F.lit(1)).alias("times"))
    )
    sizes = _sizes(distinct, ls, widths, F.col("times"))
    n = distinct.count()
    wanted = min(SAMPLE_OF_LEAF * n / BLOCK_ROWS, MOST_SAMPLED)
    share = min(1.0, max(wanted, 4.0 * BLOCK_ROWS) / n)
    sample = distinct.select(*xs).where(F.pmod(F.xxhash64(*xs), F.lit(1 << 30)) < F.lit(share * (1 << 30)))
    sample = np.column_stack([np.asarray(c) for c in sample.toArrow().columns] or [np.zeros(0)])
    tree = ds.grow_tree(sample, max(1, round(len(sample) * max(BLOCK_ROWS / n, 1 / 2 ** 14))))
    regions = tree.regions(max(LEAST_LEAVES, round(len(tree.leaves()) ** 0.5 / 2)))
    region_of = np.zeros(len(tree.axis), dtype=np.int32)
    for root, leaves in regions.items():
        region_of[leaves] = root

    def matrix(table: pa.Table | pa.RecordBatch, names: list[str], kind: type) -> np.ndarray:
        return np.column_stack([np.asarray(table.column(c)) for c in names]).astype(kind)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of(matrix(batch, xs, float))
            held = {"region": pa.array(region_of[leaf]), "leaf": pa.array(leaf)}
            yield pa.RecordBatch.from_arrays([*held.values(), *batch.columns], [*held, *xs, *ls, "times"])

    def packed(table: pa.Table) -> pa.Table:
        """A row per leaf with its points, and a row per cell with its weights."""
        root, leaf = table.column("region")[0].as_py(), np.asarray(table.column("leaf"))
        x, l, times = matrix(table, xs, float), matrix(table, ls, int), np.asarray(table.column("times"))
        mine = {c: np.flatnonzero(leaf == c) for c in np.unique(leaf).tolist()}
        cells = ds.Cells.of(tree, {c: (x[at].min(axis=0), x[at].max(axis=0), len(at)) for c, at in mine.items()})
        rows, weights = [], {}
        for c in reversed([*tree.below(root)]):
            if not cells.size[c]:
                continue
            common = {"region": root, "cell": c, "low": cells.low[c], "high": cells.high[c], "size": cells.size[c]}
            if c in mine:
                at = mine[c]
                codes, held = ds.coded(l[at], times[at].astype(float), widths)
                weights[c] = codes, cells.basis(c, 0, x[at]).T @ held
                rows.append(common | {"leaf": True, "values": x[at].ravel(), "codes": l[at].ravel(), "times": times[at]})
            else:
                children = [k for k in (tree.left[c], tree.right[c]) if cells.size[k]]
                moved = [(weights[k][0], cells.moved(weights[k][1], (k, 0), (c, 0))) for k in children]
                weights[c] = ds.added(moved, widths)
            codes, held = weights[c]
            rows.append(common | {"leaf": False, "values": held.ravel(), "codes": codes.ravel(), "times": []})
        kinds = {
            "region": pa.int32(), "cell": pa.int32(), "low": pa.list_(pa.float64()), "high": pa.list_(pa.float64()),
            "size": pa.int64(), "leaf": pa.bool_(), "values": pa.list_(pa.float64()),
            "codes": pa.list_(pa.int32()), "times": pa.list_(pa.int64()),
        }
        return pa.table({c: pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()})

    columns = ", ".join([*[f"{x} double" for x in xs], *[f"{l} int" for l in ls]])
    cells = stored(
        distinct.mapInArrow(placed, f"region int, leaf int, {columns}, times bigint")
        .groupBy("region")
        .applyInArrow(
            packed, "region int, cell int, low array<double>, high array<double>, size bigint, leaf boolean, "
            "values array<double>, codes array<int>, times array<bigint>",
        )
    )
    # boxes of the leaves: a few numbers for about a thousand points
    boxes = cells.where("leaf").select("cell", "low", "high", "size").toArrow().to_pylist()
    known = ds.Cells.of(tree, {b["cell"]: (b["low"], b["high"], b["size"]) for b in boxes})
    needs = {}
    for root, leaves in regions.items():
        used = {(c, grid < 0) for _, c, _, grid in known.pairs(tree, [*regions], leaves)}
        for c, leaf in used | {(c, True) for c in leaves}:
            needs.setdefault((c, leaf), []).append(root)
    needed = spark.createDataFrame(
        [Row(cell=c, leaf=leaf, target=to) for (c, leaf), to in needs.items()], "cell int, leaf boolean, target array<int>"
    )

    def scored(table: pa.Table) -> pa.Table:
        root = table.column("target")[0].as_py()
        return _totals(*_region_scores(tree, known, [*regions], regions[root], table, d, widths, sizes))

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), len(regions))
    sent = cells.select("cell", "leaf", "values", "codes", "times").join(F.broadcast(needed), ["cell", "leaf"])
    # little data and much work: an explicit number of partitions is not coalesced
    sent = sent.withColumn("target", F.explode("target")).repartition(tasks, "target")
    return sent.groupBy("target").applyInArrow(scored, TOTALS)


def _region_scores(
    tree: ds.Tree, cells: ds.Cells, roots: list[int], targets: list[int], table: pa.Table, d: int,
    widths: list[int], sizes: list[np.ndarray],
) -> tuple[list[float], int]:
    """Sums of the scores of the targets' points, and their number, from the rows sent to them."""
    points, weights, every = {}, {}, []
    for r in table.to_batches():
        for c, leaf, values, codes, times in zip(*(r.column(k) for k in ("cell", "leaf", "values", "codes", "times"))):
            c, values = c.as_py(), values.values.to_numpy(zero_copy_only=False)
            codes = codes.values.to_numpy(zero_copy_only=False).reshape(-1, len(widths))
            if leaf.as_py():
                x, times = values.reshape(-1, d), times.values.to_numpy(zero_copy_only=False)
                points[c] = x, codes, times
                weights[c, -1] = ds.coded(codes, times.astype(float), widths)
            else:
                weights[c, 0] = codes, values.reshape(-1, len(codes))
    every = np.unique(np.concatenate([codes for codes, _ in weights.values()]), axis=0)
    number = {tuple(code): i for i, code in enumerate(every.tolist())}
    column = {k: [number[tuple(code)] for code in codes.tolist()] for k, (codes, _) in weights.items()}

    def source(c: int, grid: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        if grid < 0:
            return points[c][0], weights[c, -1][1], column[c, -1]
        if (c, grid) not in weights:
            codes, held = weights[c, 0]
            weights[c, grid] = codes, cells.moved(held, (c, 0), (c, grid))
        return cells.nodes(c, grid), weights[c, grid][1], column[c, 0]

    pairs: dict[int, list] = {t: [] for t in targets}
    for target, *pair in cells.pairs(tree, roots, targets):
        pairs[target].append(pair)
    totals, n = [0.0] * len(widths), 0
    starts = np.concatenate([[0], np.cumsum(widths)])
    for t, mine in pairs.items():
        if t not in points:
            continue
        x, own, times = points[t]
        sums = {-1: np.zeros((len(x), len(every)))}
        for c, gap, grid in mine:
            y, held, at = source(c, grid)
            to = cells.grid(t, gap)
            if to >= 0 and cells.count(t, to) >= len(x):
                to = -1
            if to >= 0 and to not in sums:
                sums[to] = np.zeros((cells.count(t, to), len(every)))
            from_ = x if to < 0 else cells.nodes(t, to)
            if to < 0 and grid < 0:
                sums[to][:, at] += ds.near_sums(from_, y, held)
            else:
                sums[to][:, at] += ds.far_sums(from_, y, held, cells.centre[t if to >= 0 else c])
        for to in [k for k in sums if k >= 0]:
            sums[-1] += cells.basis(t, to, x) @ sums[to]
        total = sums[-1] @ ds.columns_of(every, widths)
        for i in range(len(widths)):
            totals[i] += _scores(own[:, i], total[:, starts[i]:starts[i + 1]], sizes[i], times)
        n += int(times.sum())
    return totals, n


def _by_tiles(
    points: DataFrame, features: Sequence[str], labels: Sequence[str], row_id: str, size: Row
) -> DataFrame:
    """Sums of the scores and counts by labelling and block, every pair of points computed:
    ``(i, total, n)``."""
    d, n_labels = len(features), len(labels)
    blocks = max(1, -(-size["n"] // BLOCK_ROWS))
    widths = [int(size[f"__{i}"] or 0) + 1 for i in range(n_labels)]
    starts = np.concatenate([[0], np.cumsum(widths)])
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    bands = int(np.ceil(max(np.sqrt(2 * TILES_PER_TASK * tasks), size["n"] / MOST_BAND_ROWS)))
    bands = min(blocks, bands)

    packed = (
        points.select(
            F.pmod(F.xxhash64(row_id), F.lit(blocks)).cast("int").alias("block"),
            F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
            F.array(*[F.col(c).cast("int") for c in labels]).alias("l"),
        )
        .groupBy("block")
        .agg(F.collect_list(F.struct("x", "l")).alias("p"))
        .select(
            "block", (F.col("block") % bands).alias("band"),
            F.flatten("p.x").alias("x"), F.flatten("p.l").alias("l"),
        )
    )
    other = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("other")
    tiles = packed.select("*", other).withColumns(
        {"low": F.least("band", "other"), "high": F.greatest("band", "other")}
    )
    # little data and much work: an explicit number of partitions is not coalesced
    tiles = tiles.repartition(tasks, "low", "high")

    def sums(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        held = []
        for r in rows:
            l = np.asarray(r["l"], dtype=int).reshape(-1, n_labels)
            onehot = np.zeros((len(l), starts[-1]))
            for i in range(n_labels):
                onehot[np.arange(len(l)), starts[i] + l[:, i]] = 1
            held.append((r["block"], r["band"], np.asarray(r["x"], dtype=float).reshape(-1, d), onehot))
        total = [np.zeros(h[3].shape) for h in held]
        diagonal = rows[0]["low"] == rows[0]["high"]
        for i, (_, band, x, onehot) in enumerate(held):
            for j in range(i, len(held)):
                if not diagonal and held[j][1] == band:
                    continue
                distance = pairwise(x, held[j][2])
                total[i] += distance @ held[j][3]
                if j != i:
                    total[j] += distance.T @ onehot
        return pa.table({
            "block": pa.array([h[0] for h in held], pa.int32()),
            "tile": pa.array([rows[0]["low"] * bands + rows[0]["high"]] * len(held), pa.int64()),
            "sums": pa.array([t.ravel() for t in total], pa.list_(pa.float64())),
            "l": pa.array([r["l"] if diagonal else None for r in rows], pa.list_(pa.int32())),
        })

    schema = "block int, tile bigint, sums array<double>, l array<int>"
    by_tile = tiles.groupBy("low", "high").applyInArrow(sums, schema)
    sizes = _sizes(points, labels, widths, F.lit(1))

    def finish(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["tile"])
        own = np.asarray(next(r["l"] for r in rows if r["l"] is not None), dtype=int).reshape(-1, n_labels)
        total = sum(np.asarray(r["sums"]).reshape(len(own), -1) for r in rows)
        scores = [
            _scores(own[:, i], total[:, starts[i]:starts[i + 1]], sizes[i]) for i in range(n_labels)
        ]
        return _totals(scores, len(own))

    return by_tile.groupBy("block").applyInArrow(finish, TOTALS)
