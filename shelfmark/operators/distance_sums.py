"""Sums of Euclidean distances from every point to the points of each label, in up to three
dimensions and without forming all pairs.

Points are cut into cells by a tree. Seen from a box that is far from a cell, compared with the
cell's size, a distance is a smooth function of the place in the cell: it is interpolated between
Chebyshev nodes, and the cell's points count as weights on its nodes. Likewise the sums over far
cells are smooth in a box of targets: they are worked out on its nodes and interpolated to its
points. The number of nodes follows from the gap, so that one interpolation changes no distance by
more than 1e-9 of itself (``NODES_FROM``); whatever is nearer is computed point by point. All
points of all cells count; the work grows as n log n.

A cell's weights have a column for every combination of labels in it, or for every label where
combinations would be more.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np

#: (half widths to the gap, Chebyshev nodes): from that gap on, so many nodes of a dimension give
#: the distance to 1e-9 of itself, wherever the other end lies. Found by trying all directions.
NODES_FROM = (
    (2.07, 12), (2.39, 11), (2.92, 10), (3.59, 9), (4.82, 8), (6.64, 7), (11.18, 6), (21.69, 5),
    (62.9, 4), (361.0, 3), (15820.0, 2),
)
#: a cell's grids, by the gap in half widths of its widest side from which each serves
GAPS = (2.1, 3.6, 6.7, 11.2, 21.7)
MOST_DIMENSIONS = 3
#: distances worked out at a time, small enough for a core's own cache
CACHED = 32_768


def nodes_from(gap: float) -> int:
    return next(n for least, n in reversed(NODES_FROM) if gap >= least)


@cache
def _chebyshev(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes, and the factors from Chebyshev polynomials to the nodes' Lagrange polynomials."""
    nodes = np.cos((np.arange(n) + 0.5) * np.pi / n)
    factors = np.cos(np.arange(n)[:, None] * np.arccos(nodes)) * 2 / n
    factors[0] /= 2
    return nodes, factors


def lagrange(values: np.ndarray, low: float, high: float, n: int) -> np.ndarray:
    """The nodes' Lagrange polynomials over [low, high] at the values, one column per node."""
    if n == 1:
        return np.ones((len(values), 1))
    t = np.clip((values - (low + high) / 2) / ((high - low) / 2), -1, 1)
    return np.cos(np.arccos(t)[:, None] * np.arange(n)) @ _chebyshev(n)[1]


def pairwise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed column by column (no cancellation for near points)."""
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        gap = x[:, j, None] - y[None, :, j]
        total += gap * gap
    return np.sqrt(total)


def near_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The distances of ``pairwise`` times the weights of ``y``, a few rows at a time."""
    out = np.empty((len(x), weights.shape[1]))
    rows = max(1, CACHED // len(y))
    columns = np.ascontiguousarray(y.T)
    total, gap = np.empty((rows, len(y))), np.empty((rows, len(y)))
    for i in range(0, len(x), rows):
        some = x[i:i + rows]
        t, g = total[:len(some)], gap[:len(some)]
        for j, column in enumerate(columns):
            to = g if j else t
            np.subtract(some[:, j, None], column, out=to)
            np.multiply(to, to, out=to)
            if j:
                t += g
        np.matmul(np.sqrt(t, out=t), weights, out=out[i:i + rows])
    return out


def far_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Like ``near_sums``, the squares by one matrix product, which is right where the gap is large
    seen from ``centre``."""
    x, y = x - centre, y - centre
    left = np.column_stack([-2 * x, (x * x).sum(axis=1), np.ones(len(x))])
    right = np.column_stack([y, np.ones(len(y)), (y * y).sum(axis=1)]).T.copy()
    out = np.empty((len(x), weights.shape[1]))
    rows = max(1, CACHED // len(y))
    squares = np.empty((rows, len(y)))
    for i in range(0, len(x), rows):
        some = left[i:i + rows]
        t = np.matmul(some, right, out=squares[:len(some)])
        np.matmul(np.sqrt(np.maximum(t, 0, out=t), out=t), weights, out=out[i:i + rows])
    return out


@dataclass
class Tree:
    """Cells that split at a coordinate of one axis; a cell without children is a leaf. Boxes and
    sizes are those of the points, once they are known."""

    axis: list[int] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)

    def leaves(self, cell: int = 0) -> list[int]:
        return [c for c in self.below(cell) if self.left[c] < 0]

    def below(self, cell: int) -> Iterator[int]:
        """The cell and all under it, children after their parent."""
        stack = [cell]
        while stack:
            c = stack.pop()
            yield c
            if self.left[c] >= 0:
                stack += [self.right[c], self.left[c]]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        axis, at, left, right = map(np.asarray, (self.axis, self.at, self.left, self.right))
        cell = np.zeros(len(points), dtype=np.int32)
        inner = np.arange(len(points))
        while len(inner := inner[left[cell[inner]] >= 0]):
            c = cell[inner]
            low = points[inner, axis[c]] <= at[c]
            cell[inner] = np.where(low, left[c], right[c])
        return cell

    def regions(self, most: int) -> dict[int, list[int]]:
        """Disjoint subtrees of at most ``most`` leaves, by their root."""
        found, stack = {}, [0]
        while stack:
            c = stack.pop()
            leaves = self.leaves(c)
            if len(leaves) <= most:
                found[c] = leaves
            else:
                stack += [self.right[c], self.left[c]]
        return found


def grow_tree(points: np.ndarray, most: int) -> Tree:
    """Split the widest side in its middle, but leave an eighth of the points on each side where
    equal coordinates allow it, until ``most`` are left."""
    tree, todo = Tree(), [(points, None, None)]
    while todo:
        mine, parent, side = todo.pop()
        cell = len(tree.axis)
        for column, value in ((tree.axis, 0), (tree.at, 0.0), (tree.left, -1), (tree.right, -1)):
            column.append(value)
        if parent is not None:
            (tree.left if side == 0 else tree.right)[parent] = cell
        if len(mine) <= most:
            continue
        low, high = mine.min(axis=0), mine.max(axis=0)
        axis = int(np.argmax(high - low))
        if not high[axis] > low[axis]:
            continue
        values = mine[:, axis]
        eighth = np.partition(values, [len(mine) // 8, len(mine) - 1 - len(mine) // 8])
        at = np.clip((low[axis] + high[axis]) / 2, eighth[len(mine) // 8], eighth[len(mine) - 1 - len(mine) // 8])
        if at >= high[axis]:
            at = values[values < high[axis]].max()
        tree.axis[cell], tree.at[cell] = axis, float(at)
        lower = values <= at
        todo += [(mine[~lower], cell, 1), (mine[lower], cell, 0)]
    return tree


class Cells:
    """Boxes and sizes of a tree's cells, and what they say about pairs of cells."""

    def __init__(self, low: np.ndarray, high: np.ndarray, size: np.ndarray):
        self.low, self.high, self.size = low, high, size
        self.centre = (low + high) / 2
        self.half = (high - low) / 2
        self.widest = self.half.max(axis=1)
        self._shapes: dict[tuple[int, int], tuple[tuple[int, ...], int]] = {}

    @classmethod
    def of(cls, tree: Tree, found: dict[int, tuple[Sequence[float], Sequence[float], int]]) -> Cells:
        """From the leaves' boxes and sizes; a cell without points has size 0."""
        n, d = len(tree.axis), len(next(iter(found.values()))[0])
        low, high, size = np.full((n, d), np.inf), np.full((n, d), -np.inf), np.zeros(n, dtype=int)
        for cell, (a, b, count) in found.items():
            low[cell], high[cell], size[cell] = a, b, count
        for cell in reversed(range(n)):  # children have larger numbers
            for child in (tree.left[cell], tree.right[cell]):
                if child >= 0 and size[child]:
                    low[cell] = np.minimum(low[cell], low[child])
                    high[cell] = np.maximum(high[cell], high[child])
                    size[cell] += size[child]
        low[size == 0] = high[size == 0] = 0
        return cls(low, high, size)

    def gap(self, cell: int, others: np.ndarray) -> np.ndarray:
        apart = np.maximum(self.low[others] - self.high[cell], self.low[cell] - self.high[others])
        return np.sqrt((np.maximum(apart, 0) ** 2).sum(axis=1))

    def grid(self, cell: int, gap: float) -> int:
        """The coarsest grid of the cell that serves at that gap, −1 where none does."""
        if not gap > 0:
            return -1
        widest = self.widest[cell]
        return bisect_right(GAPS, gap / widest) - 1 if gap < GAPS[-1] * widest else len(GAPS) - 1

    def shape(self, cell: int, grid: int) -> tuple[int, ...]:
        """Nodes of the grid in each dimension."""
        return self._shape(cell, grid)[0]

    def count(self, cell: int, grid: int) -> int:
        """Nodes of the grid."""
        return self._shape(cell, grid)[1]

    def _shape(self, cell: int, grid: int) -> tuple[tuple[int, ...], int]:
        if (cell, grid) not in self._shapes:
            gap = GAPS[grid] * self.widest[cell]
            shape = tuple(nodes_from(gap / h) if gap < 1e12 * h else 1 for h in self.half[cell])
            self._shapes[cell, grid] = shape, int(np.prod(shape))
        return self._shapes[cell, grid]

    def sides(self, cell: int, grid: int) -> list[np.ndarray]:
        """The grid's coordinates, dimension by dimension."""
        return [
            self.centre[cell, j] + self.half[cell, j] * (_chebyshev(n)[0] if n > 1 else np.zeros(1))
            for j, n in enumerate(self.shape(cell, grid))
        ]

    def nodes(self, cell: int, grid: int) -> np.ndarray:
        mesh = np.meshgrid(*self.sides(cell, grid), indexing="ij")
        return np.stack([g.ravel() for g in mesh], axis=1)

    def bases(self, cell: int, grid: int, points: Sequence[np.ndarray]) -> list[np.ndarray]:
        """For each dimension the grid's Lagrange polynomials at ``points`` of that dimension."""
        return [
            lagrange(points[j], self.low[cell, j], self.high[cell, j], n)
            for j, n in enumerate(self.shape(cell, grid))
        ]

    def basis(self, cell: int, grid: int, points: np.ndarray) -> np.ndarray:
        """One row per point, one column per node of the grid."""
        out = np.ones((len(points), 1))
        for b in self.bases(cell, grid, points.T):
            out = (out[:, :, None] * b[:, None, :]).reshape(len(points), -1)
        return out

    def moved(self, weights: np.ndarray, source: tuple[int, int], target: tuple[int, int]) -> np.ndarray:
        """Weights on the nodes of one (cell, grid) as weights on those of another that holds it."""
        out = weights.reshape(*self.shape(*source), -1)
        for j, b in enumerate(self.bases(*target, self.sides(*source))):
            out = np.moveaxis(np.tensordot(b, out, axes=(0, j)), 0, j)
        return out.reshape(-1, weights.shape[1])

    def pairs(
        self, tree: Tree, roots: Sequence[int], targets: Sequence[int]
    ) -> Iterator[tuple[int, int, float, int]]:
        """What the targets, leaves, are to add up: ``(target, cell, gap, grid)``, with the points
        of a leaf for grid −1 and the nodes of the cell's grid otherwise."""
        stack = [(r, np.asarray([t for t in targets if self.size[t]])) for r in roots]
        while stack:
            cell, mine = stack.pop()
            if not self.size[cell] or not len(mine):
                continue
            gaps = self.gap(cell, mine)
            far = (gaps > 0) & (gaps > GAPS[0] * self.widest[cell] * (1 + 1e-12))
            leaf = tree.left[cell] < 0
            for target, gap in zip(mine[far].tolist(), gaps[far].tolist()):
                grid = self.grid(cell, gap)
                if leaf and self.size[cell] <= self.count(cell, grid):
                    grid = -1
                yield target, cell, gap, grid
            if leaf:
                for target, gap in zip(mine[~far].tolist(), gaps[~far].tolist()):
                    yield target, cell, gap, -1
            else:
                stack += [(tree.right[cell], mine[~far]), (tree.left[cell], mine[~far])]


def single_labels(widths: Sequence[int]) -> np.ndarray:
    """One code per label: its number in its own labelling, −1 in the others."""
    codes = np.full((sum(widths), len(widths)), -1)
    starts = np.concatenate([[0], np.cumsum(widths)])
    for i, width in enumerate(widths):
        codes[starts[i]:starts[i] + width, i] = np.arange(width)
    return codes


def columns_of(codes: np.ndarray, widths: Sequence[int]) -> np.ndarray:
    """1 where a code counts for a label: one row per code, one column per label."""
    starts = np.concatenate([[0], np.cumsum(widths)])
    out = np.zeros((len(codes), starts[-1]))
    row, i = np.nonzero(codes >= 0)
    out[row, starts[i] + codes[row, i]] = 1
    return out


def coded(labels: np.ndarray, weights: np.ndarray, widths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the rows' labels, and each row's weight under its codes: one code for its
    combination, or one per labelling where combinations are more than labels."""
    codes, at = np.unique(labels, axis=0, return_inverse=True)
    if len(codes) > sum(widths):
        codes, singles = single_labels(widths), columns_of(labels, widths)
        return codes, singles * weights[:, None]
    out = np.zeros((len(labels), len(codes)))
    out[np.arange(len(labels)), at.ravel()] = weights
    return codes, out


def added(parts: list[tuple[np.ndarray, np.ndarray]], widths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several ``(codes, weights)`` over the same rows."""
    every = np.concatenate([codes for codes, _ in parts])
    weights = np.concatenate([w for _, w in parts], axis=1)
    codes, at = np.unique(every, axis=0, return_inverse=True)
    if len(codes) > sum(widths):
        return single_labels(widths), weights @ columns_of(every, widths)
    out = np.zeros((len(weights), len(codes)))
    np.add.at(out.T, at.ravel(), weights.T)
    return codes, out
