"""Shapley values of the forest's mean path length, and feature importance.

Conditional expectations follow the trees' own sample shares (Lundberg et al. 2020,
tree-path dependent). A leaf contributes ``path · Π (inside? 1 : 0 or sample share)``, a
product over features, so its exact Shapley values come from a polynomial in the coalition
size; no coalition is listed and nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.iforest import with_trees
from shelfmark.operators.ordering import top_n

ROWS_AT_ONCE = 16
# much work per row: few rows share one copy of the trees
ROWS_EXPLAINED = 128


def leaves(tree: dict, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per leaf: lower and upper bound and sample share by feature, and path length."""
    low, high, share, value = [], [], [], []
    todo = [(0, np.full(features, -np.inf), np.full(features, np.inf), np.ones(features))]
    while todo:
        node, lo, hi, sh = todo.pop()
        f = int(tree["feature"][node])
        if f < 0:
            low.append(lo), high.append(hi), share.append(sh), value.append(tree["path"][node])
            continue
        for child, is_left in ((tree["left"][node], True), (tree["right"][node], False)):
            lo2, hi2, sh2 = lo.copy(), hi.copy(), sh.copy()
            if is_left:
                hi2[f] = min(hi2[f], tree["threshold"][node])
            else:
                lo2[f] = max(lo2[f], tree["threshold"][node])
            sh2[f] *= tree["samples"][child] / tree["samples"][node]
            todo.append((int(child), lo2, hi2, sh2))
    return np.array(low), np.array(high), np.array(share), np.array(value)


def shapley_values(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """One row per point, one column per feature."""
    n, m = x.shape
    parts = [leaves(t, m) for t in trees]
    low, high, share = (np.concatenate([p[i] for p in parts]) for i in range(3))
    value = np.concatenate([p[3] for p in parts]) / len(trees)
    weight = [factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)]
    out = np.zeros((n, m))
    for start in range(0, n, ROWS_AT_ONCE):
        rows = x[start:start + ROWS_AT_ONCE]
        inside = ((rows[:, None, :] > low) & (rows[:, None, :] <= high)).astype(float)
        for f in range(m):
            poly = [np.ones(inside.shape[:2])]
            for j in range(m):
                if j == f:
                    continue
                grown = [p * share[:, j] for p in poly] + [0.0]
                for s, p in enumerate(poly):
                    grown[s + 1] = grown[s + 1] + p * inside[:, :, j]
                poly = grown
            total = sum(w * p for w, p in zip(weight, poly))
            out[start:start + ROWS_AT_ONCE, f] = (
                total * (inside[:, :, f] - share[:, f]) * value
            ).sum(axis=1)
    return out


def shapley_rows(
    rows: DataFrame, forest: DataFrame, features: Sequence[str], by: str = "Cluster",
    row_id: str = "rule_id",
) -> DataFrame:
    """``(by, id, feature, value)`` for the given rows; groups without a forest give none."""
    names = list(features)
    key_type = rows.schema[by].dataType.simpleString()
    id_type = rows.schema[row_id].dataType.simpleString()

    def explain(mine: pa.Table, x: np.ndarray, trees: list[dict]) -> pa.Table:
        if not trees:
            mine, x = mine.slice(0, 0), x[:0]
        values = shapley_values(trees, x).ravel() if len(x) else np.zeros(0)
        each = pa.array(np.repeat(np.arange(len(x)), len(names)))
        return pa.table({
            by: mine.column(by).take(each), row_id: mine.column(row_id).take(each),
            "feature": pa.array(names * len(x), pa.string()), "value": pa.array(values, pa.float64()),
        })

    schema = f"`{by}` {key_type}, `{row_id}` {id_type}, feature string, value double"
    needed = rows.select(by, row_id, *[f for f in names if f not in (by, row_id)])
    return with_trees(needed, forest, features, by, ROWS_EXPLAINED, explain, schema)


def feature_importance(
    rows: DataFrame, forest: DataFrame, features: Sequence[str], by: str = "Cluster",
    row_id: str = "rule_id", flag: str = "isolation_forest_anomaly",
) -> DataFrame:
    """Mean absolute Shapley value per feature over the flagged rows. Groups without a
    flagged row have none."""
    values = shapley_rows(rows.where(F.col(flag) == 1), forest, features, by, row_id)
    return values.groupBy(by, "feature").agg(F.avg(F.abs("value")).alias("importance"))


def rank_features(importance: DataFrame, by: str = "Cluster", n: int | None = None) -> DataFrame:
    ordered = [F.desc("importance"), F.asc("feature")]
    return top_n(importance, [by], ordered, n) if n else importance.orderBy(by, *ordered)
