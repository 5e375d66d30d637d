"""Vector code compression: product codes from Lloyd rounds over cover trees.

Vectors become fixed-point integers and are cut into equal parts; each part position has its own
codebook. Every Arrow batch of a partition grows one cover tree for each part position: a node
covers a contiguous range of the batch's distinct parts, knows its radius, and sums over the range
come from cumulative sums. A round sends the codebooks to the trees. A node whose nearest entry
stays nearest for the whole ball (triangle inequality) gives its sum and count at once; other nodes
descend, and points of ambiguous leaves are compared exactly. All decisions are those of exact
integer arithmetic: the bounds keep a margin wider than rounding, ties go to exact comparison.

The trees are written once and read by each round. A task holds one batch of rows, a round returns
one row for each part, entry and position, whatever the size of the table.

Defined cases: rows whose vector is null, holds null or non-finite components, or differs in length
from that of the smallest id take no part; equal ids each count, the smallest ids are taken in the
order of id, then vector, null ids last; with fewer rows than entries the codebook is as short; an
empty table gives no rows. A length that is no multiple of the parts, or a component beyond ±32768
(whose square would leave 64 bits), is an error.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.groups import join_groups
from shelfmark.session import stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Largest magnitude of a fixed-point component.
WIDEST = 1 << 27
#: Points of a node that is not split further.
LEAF_POINTS = 16


def fixed_point(flat: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` of finite numbers."""
    x = np.floor(flat.astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max() > WIDEST:
        raise ValueError(f"vector components beyond ±{WIDEST // SCALE} are not supported")
    return x.astype(np.int32)


class CoverTree:
    """A cover tree over the distinct rows of an integer matrix.

    ``points[start:end]`` of a node are all it covers; its children follow each other in the node
    arrays and split the range. ``row`` maps each input row to its place in ``points``.
    """

    def __init__(self, rows: np.ndarray):
        distinct, inverse, copies = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        order = np.arange(len(distinct))
        x = distinct.astype(np.float64)
        start, end, centre, radius, first, last = [0], [len(x)], [0], [], [], []
        centre_of = [len(x) // 2]
        node = 0
        while node < len(start):
            s, e, c = start[node], end[node], centre_of[node]
            mine = order[s:e]
            distance = np.sqrt(((x[mine] - x[c]) ** 2).sum(axis=1))
            reach = float(distance.max())
            radius.append(reach)
            first.append(len(start))
            if e - s > LEAF_POINTS and reach > 0:
                left, near, groups = mine, distance <= reach / 2, []
                while len(left):
                    groups.append((c, left[near]))
                    left = left[~near]
                    if len(left):
                        c = left[0]
                        near = ((x[left] - x[c]) ** 2).sum(axis=1) <= (reach / 2) ** 2
                at = s
                for c, group in groups:
                    order[at : at + len(group)] = group
                    start.append(at)
                    at += len(group)
                    end.append(at)
                    centre_of.append(c)
            last.append(len(start))
            node += 1
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.points = distinct[order]
        self.copies = copies[order].astype(np.int32)
        self.row = place[inverse.reshape(-1)]
        self.start, self.end = np.array(start, np.int32), np.array(end, np.int32)
        self.centre = place[np.array(centre_of, dtype=int)]
        self.radius = np.array(radius)
        self.first, self.last = np.array(first, np.int32), np.array(last, np.int32)

    @classmethod
    def of(cls, arrays: dict) -> CoverTree:
        """The tree whose arrays (``vars``) were stored."""
        tree = cls.__new__(cls)
        vars(tree).update(arrays)
        return tree

    def ranges(self, codebook: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ranges of points with one nearest entry each: (starts, ends, entries), disjoint, all of them."""
        entries = codebook.astype(np.int64)
        nodes = np.array([0])
        while len(nodes):
            squares = _squares(self.points[self.centre[nodes]], entries)
            best = squares.argmin(axis=1)
            distance = np.sqrt(squares.astype(np.float64))
            nearest = distance[np.arange(len(nodes)), best]
            distance[np.arange(len(nodes)), best] = np.inf
            second, reach = distance.min(axis=1), self.radius[nodes]
            margin = np.where(np.isfinite(second), 1e-9 * (1 + nearest + second + reach), 0)
            settled = (reach == 0) | (second - nearest > 2 * reach + margin)
            yield self.start[nodes[settled]], self.end[nodes[settled]], best[settled]
            nodes = nodes[~settled]
            leaf = self.first[nodes] == self.last[nodes]
            points = _spans(self.start[nodes[leaf]], self.end[nodes[leaf]])
            yield points, points + 1, _squares(self.points[points], entries).argmin(axis=1)
            nodes = _spans(self.first[nodes[~leaf]], self.last[nodes[~leaf]])

    def sums(self, codebook: np.ndarray) -> np.ndarray:
        """Per entry the componentwise sum of its rows, and their number in the last column."""
        weighted = np.hstack([self.points.astype(np.int64), np.ones((len(self.points), 1), np.int64)])
        weighted *= self.copies[:, None]
        running = np.vstack([np.zeros((1, weighted.shape[1]), np.int64), weighted.cumsum(axis=0)])
        out = np.zeros((len(codebook), weighted.shape[1]), np.int64)
        for start, end, entry in self.ranges(codebook):
            np.add.at(out, entry, running[end] - running[start])
        return out

    def assign(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and exact squared distance of every input row."""
        found = np.zeros(len(self.points), np.int64)
        for start, end, entry in self.ranges(codebook):
            found[_spans(start, end)] = np.repeat(entry, end - start)
        away = self.points.astype(np.int64) - codebook[found]
        return found[self.row], (away * away).sum(axis=1)[self.row]


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    away = points[:, None, :].astype(np.int64) - entries[None, :, :]
    return (away * away).sum(axis=2)


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All whole numbers of the half-open ranges, range by range."""
    size = (end - start).astype(np.int64)
    if not len(size):
        return np.zeros(0, np.int64)
    ahead = np.cumsum(size) - size
    return np.arange(size.sum()) - np.repeat(ahead, size) + np.repeat(start.astype(np.int64), size)


def kept_vectors(vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, x`` of the rows with whole, finite vectors."""
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(F.col("x").isNotNull() & finite)


def grow_trees(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """One row for each batch of rows: their ids and labels, and a cover tree for each part."""
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = fixed_point(batch.column(2).flatten().to_numpy(zero_copy_only=False)).reshape(n, width)
            cut = width // parts
            trees = [CoverTree(x[:, p * cut : (p + 1) * cut]) for p in range(parts)]
            whole = pa.array([0, n], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(whole, batch.column(0)), pa.ListArray.from_arrays(whole, batch.column(1)),
                 pa.array([pickle.dumps([vars(t) for t in trees], 5)], pa.binary())],
                names=["ids", "labels", "trees"])

    return rows.mapInArrow(grow, f"ids array<{id_type}>, labels array<{label_type}>, trees binary")


def next_codebooks(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """One Lloyd round: means (floored) of the rows nearest to each entry; unused entries stay."""
    parts, entries, cut = books.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, cut + 1), np.int64)
        for batch in batches:
            for held in batch.column(0):
                for p, arrays in enumerate(pickle.loads(held.as_py())):
                    total[p] += CoverTree.of(arrays).sums(books[p])
        p, e, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[p, e, d])],
            names=["part", "entry", "place", "total"])

    sums = trees.select("trees").mapInArrow(partial, "part int, entry int, place int, total bigint")
    total = np.zeros((parts, entries, cut + 1), np.int64)
    # one row for each part, entry and position
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():
        total[r["part"], r["entry"], r["place"]] = r["total"]
    count = total[:, :, -1:]
    return np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books)


def encode(trees: DataFrame, books: np.ndarray, *, id_col: str, label_col: str) -> DataFrame:
    """``id_col, label_col, code, error`` for every row of the trees."""
    id_type, label_type = (trees.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))
    digits = np.array([f"{i:02x}" for i in range(256)], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                code, error = "", 0
                for p, arrays in enumerate(pickle.loads(batch.column(2)[i].as_py())):
                    entry, square = CoverTree.of(arrays).assign(books[p])
                    code, error = code + digits[entry], error + square
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values, pa.array(code, pa.string()), pa.array(error, pa.int64())],
                    names=[id_col, label_col, "code", "error"])

    return trees.mapInArrow(run, f"`{id_col}` {id_type}, `{label_col}` {label_type}, code string, error bigint")


def with_label_error(coded: DataFrame, *, label_col: str) -> DataFrame:
    """Add ``label_error``, the sum of ``error`` over equal labels, nulls together."""
    keys = {"__none": F.col(label_col).isNull(), "__label": F.coalesce(F.col(label_col).cast("string"), F.lit(""))}
    rows = coded.withColumns(keys)
    sums = rows.groupBy(*keys).agg(F.sum("error").alias("label_error"))
    return join_groups(rows, sums, list(keys)).drop(*keys)


def compress(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """``id_col, label_col, code, error, label_error, codebooks_sha256`` of every kept row.

    ``code`` holds two hex digits for each part (at most 256 entries), ``error`` the squared
    distance between the fixed-point vector and its entries, ``codebooks_sha256`` the digest of all
    final entries as decimal numbers.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col)
    seeds = kept.select("id", "x").orderBy(F.asc_nulls_last("id"), "x").limit(1).collect()
    if not seeds:
        id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
        return spark.createDataFrame(
            [], f"`{id_col}` {id_type}, `{label_col}` {label_type}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    width = len(seeds[0]["x"])
    if not width or width % parts:
        raise ValueError(f"vectors of length {width} can't be cut into {parts} equal parts")
    kept = kept.where(F.size("x") == width)
    seeds = kept.select("id", "x").orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()
    first = fixed_point(np.array([r["x"] for r in seeds]).ravel()).reshape(len(seeds), parts, width // parts)
    books = first.transpose(1, 0, 2).astype(np.int64)
    trees = stored(grow_trees(kept, width, parts))
    for _ in range(rounds):
        books = next_codebooks(trees, books)
    coded = with_label_error(stored(encode(trees, books, id_col=id_col, label_col=label_col)), label_col=label_col)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.withColumn("codebooks_sha256", F.lit(digest))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``compress`` on the table ``embeddings``: every distance of every round."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, embedding AS x, row_number() OVER (ORDER BY vec_id, embedding) AS n
            FROM embeddings WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        f"""flat AS MATERIALIZED (SELECT n, (i - 1) // (len(x) // {parts}) AS part, (i - 1) % (len(x) // {parts}) AS place,
            CAST(floor({SCALE} * CAST(x[i] AS DOUBLE)) AS BIGINT) AS v
            FROM (SELECT n, x, unnest(range(1, len(x) + 1)) AS i FROM kept))""",
        f"book0 AS MATERIALIZED (SELECT part, n - 1 AS entry, place, v FROM flat WHERE n <= {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (SELECT n, part, entry, d FROM (SELECT f.n, f.part, b.entry, CAST(sum((f.v - b.v) * (f.v - b.v)) AS BIGINT) AS d
                FROM flat f JOIN book{r} b USING (part, place) GROUP BY ALL)
                QUALIFY row_number() OVER (PARTITION BY n, part ORDER BY d, entry) = 1)""")
        if r < rounds:
            steps.append(
                f"""mean{r} AS MATERIALIZED (SELECT part, entry, place, CAST(sum(v) AS BIGINT) AS s, count(*) AS c
                    FROM flat JOIN near{r} USING (n, part) GROUP BY ALL)""")
            steps.append(
                f"""book{r + 1} AS MATERIALIZED (SELECT part, entry, place,
                    CASE WHEN c IS NULL THEN v ELSE (s - ((s % c) + c) % c) // c END AS v
                    FROM book{r} LEFT JOIN mean{r} USING (part, entry, place))""")
    return "WITH " + ",\n".join(steps) + f""",
        coded AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY n)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (n)"""
