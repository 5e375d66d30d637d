"""Approximate nearest neighbours by adaptive dimension scans in probed lists.

Vectors are dealt to lists by nearest centre (centres fitted on a bounded sample; every vector is
indexed) and rotated by a random orthogonal matrix. A query visits its nearest lists. There the
vectors lie in column blocks: after each block of dimensions a hypothesis test compares the
partial distance, scaled up, with the query's reach, and abandons the candidates that are too far
with high confidence; the few that are left get the exact distance on the original vectors.
The reach starts as the distance to the k-th neighbour in a small sample of distinct ids, which
bounds the answer from above, and shrinks with what the first rows of a list yield. Vectors without clusters put
neighbours in many lists, so a large share of the lists is visited and the tests save the work.

Lists and queries are cut to groups of bounded size, so a list that holds a third of all vectors
is scanned by many tasks. Vectors that are null, zero, not of the usual length, or hold a null or
non-finite number take no part. Rows that repeat a ``vec_id`` count once by vector; a query's own
id is never its neighbour; ties go to the smaller id; fewer candidates than ``k`` give fewer rows;
an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import stored

#: Rows that centres and first reaches are fitted on, at most.
SAMPLE = 20_000
MOST_LISTS = 2048
#: Rows, of distinct ids, that first reaches are taken from: at most so many, and at most this share of all.
REACH_ROWS = 512
REACH_SHARE = 8
#: Rows of a list that are scanned before the reach shrinks.
FIRST_ROWS = 512
#: Share of the lists that a query visits.
PROBED = 0.7
#: Rows and queries of a group, about.
GROUP = 4096
STEP = 8
#: Width of the test: larger keeps more candidates.
EPSILON = 2.1


@dataclass
class Index:
    rotation: np.ndarray
    centres: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    counts: np.ndarray


def _usable(column: Column, size: int) -> Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & (F.size(column) == size) & ~bad & F.exists(column, lambda x: x != 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size) if len(column) else np.zeros((0, size))


def _centres(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        near = _closest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=n)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _closest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    out = np.empty((len(x), n), np.int32)
    for a in range(0, len(x), 2048):
        d = (centres**2).sum(1) - 2 * x[a : a + 2048] @ centres.T
        out[a : a + 2048] = np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


def scan(rotated: np.ndarray, query: np.ndarray, reach: float, k: int, width: float) -> np.ndarray:
    """Rows of ``rotated`` that the tests don't abandon."""
    size = rotated.shape[1]
    alive = np.arange(len(rotated))
    partial = np.zeros(len(rotated))
    for a in range(0, size, STEP):
        b = min(a + STEP, size)
        partial = partial + ((rotated[alive, a:b] - query[a:b]) ** 2).sum(axis=1)
        bound = reach * reach * (b / size) * (1 + width / np.sqrt(b)) ** 2 if b < size else reach * reach * (1 + 1e-9)
        keep = partial <= bound
        alive, partial = alive[keep], partial[keep]
        if len(alive) <= k:
            break
    return alive


def nearest(
    vectors: DataFrame, queries: Column, *, k: int = 10, probed: float = PROBED, width: float = EPSILON,
    seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` that ``queries`` holds for."""
    base = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull())
    lengths = base.groupBy(F.size("v").alias("size")).count().where("size > 0").orderBy(F.desc("count"), "size").limit(1).collect()
    size = lengths[0]["size"] if lengths else 1
    rows = stored(base.where(_usable(F.col("v"), size)))
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    held = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).toArrow()
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
    sample = _matrix(held.column("v").combine_chunks(), size)
    n_lists = int(np.clip(round(n**0.5 / 2), 1, min(MOST_LISTS, len(sample))))
    few = min(REACH_ROWS, n // REACH_SHARE)
    # one row for each id: k rows of fewer ids would not bound the distance to the k-th neighbour
    ids = held.column("vec_id").to_numpy()
    first = np.sort(np.unique(ids, return_index=True)[1])[:few]
    index = Index(rotation, _centres(sample, n_lists, rng), ids[first], sample[first], np.zeros(0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _closest(_matrix(batch.column(1), size), index.centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["vec_id", "v", "asks", "list"])

    dealt = stored(rows.mapInArrow(assign, "vec_id long, v array<double>, asks boolean, list int"))
    counted = dealt.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("q")).collect()
    index.counts = np.zeros(n_lists, np.int64)  # one row for each of at most MOST_LISTS lists
    for r in counted:
        index.counts[r["list"]] = r["n"]
    asked = sum(r["q"] for r in counted)
    probes = max(1, int(np.ceil(n_lists * probed)))
    shards = np.maximum(1, -(-index.counts // GROUP))
    slices = max(1, int(-(-asked * probes // (n_lists * GROUP))))
    table = F.array(*[F.lit(int(s)) for s in shards])
    left = dealt.select(
        "list", F.pmod(F.xxhash64("vec_id"), F.element_at(table, F.col("list") + 1)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "vec_id", "v")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), size)
            order = _closest(x, index.centres, n_lists)
            for i, q in enumerate(x):
                d = np.sqrt(((index.sample - q) ** 2).sum(axis=1))
                d = np.sort(d[index.sample_ids != ids[i]])
                reach = float(d[k - 1]) if len(d) >= k else float("inf")
                gathered = np.cumsum(index.counts[order[i]])
                visits = order[i][: max(probes, int(np.searchsorted(gathered, 10 * k)) + 1)]
                lists = np.repeat(visits, shards[visits])
                parts = np.concatenate([np.arange(shards[v]) for v in visits]).astype(np.int32)
                m = len(lists)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int32()), pa.array(parts), pa.array(np.full(m, (int(ids[i]) * 0x9E3779B97F4A7C15 % (1 << 64) >> 33) % slices, np.int32)), pa.array(np.full(m, ids[i])),
                     pa.array([q.tolist()] * m, pa.list_(pa.float64())), pa.array(np.full(m, reach))],
                    names=["list", "shard", "slice", "query_id", "q", "reach"])

    asks = dealt.where("asks").select("vec_id", "v").dropDuplicates(["vec_id"])
    right = asks.mapInArrow(ask, "list int, shard int, slice int, query_id long, q array<double>, reach double")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if a.num_rows and b.num_rows:
            ids, x = a.column("vec_id").to_numpy(), _matrix(a.column("v").combine_chunks(), size)
            asking, q = b.column("query_id").to_numpy(), _matrix(b.column("q").combine_chunks(), size)
            xr, qr = np.asfortranarray(x @ index.rotation), q @ index.rotation
            for i, reach in enumerate(b.column("reach").to_numpy()):
                found, score = np.zeros(0, np.int64), np.zeros(0)
                for start, end in ((0, FIRST_ROWS), (FIRST_ROWS, len(x))):
                    more = start + scan(xr[start:end], qr[i], reach, k, width)
                    more = more[ids[more] != asking[i]]
                    found = np.concatenate([found, more])
                    score = np.concatenate([score, np.sqrt(((x[more] - q[i]) ** 2).sum(axis=1))])
                    near = np.sort(score[np.unique(ids[found], return_index=True)[1]])
                    reach = min(reach, float(near[k - 1])) if len(near) >= k else reach
                best = np.lexsort((ids[found], score))
                # equal rows of one id count once
                _, first = np.unique(ids[found][best], return_index=True)
                best = best[np.sort(first)][:k]
                out.append((np.full(len(best), asking[i]), ids[found][best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))

    keys = ("list", "shard", "slice")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
