"""Job 2: customer segments from cleaned lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfmark.operators.kmeans import SegmentModel, fit_clustering
from shelfmark.operators.rfm import rfm, segment_summary
from shelfmark.session import stored


@dataclass
class Segmented:
    customers: DataFrame
    summary: DataFrame
    model: SegmentModel


def segment(
    lines: DataFrame, n_clusters: int | None = None, seed: int = 42, metric: str = "euclidean",
    order_by: int | None = None,
) -> Segmented:
    customers, model = fit_clustering(rfm(lines), n_clusters, seed, metric, order_by)
    customers = stored(customers)
    return Segmented(customers, segment_summary(customers), model)
