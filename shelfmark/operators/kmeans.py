"""k-means segments on scaled columns, choice of k, and the two-component projection."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.rfm import RFM, cluster_name
from shelfmark.operators.scaling import apply_scaler, fit_scaler
from shelfmark.operators.silhouette import silhouette
from shelfmark.session import materialise, stored

SCALED = {c: f"{c}_scaled" for c in RFM}
MAX_ITERATIONS = 300
FITS_AT_ONCE = 4


def nearest(features: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest centre, the first on a tie; a plain row-wise expression."""
    distances = F.array(
        *[
            sum(
                (
                    (F.col(f) - F.lit(float(x))) * (F.col(f) - F.lit(float(x)))
                    for f, x in zip(features, centre)
                ),
                F.lit(0.0),
            )
            for centre in centres
        ]
    )
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def assign_nearest(
    df: DataFrame, features: Sequence[str], centres: Sequence[Sequence[float]],
    output: str = "Cluster",
) -> DataFrame:
    return df.withColumn(output, nearest(features, centres))


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__vector").transform(df)


def fit_centres(df: DataFrame, features: Sequence[str], k: int, seed: int = 42) -> list[list[float]]:
    return _fit_vectors(_vectors(df, features), k, seed)


def _fit_vectors(vectors: DataFrame, k: int, seed: int) -> list[list[float]]:
    kmeans = KMeans(featuresCol="__vector", k=k, seed=seed, maxIter=MAX_ITERATIONS)
    return [list(map(float, c)) for c in kmeans.fit(vectors).clusterCenters()]


def find_optimal_clusters(
    df: DataFrame, features: Sequence[str], k_range: Sequence[int] = range(2, 11), seed: int = 42,
    metric: str = "euclidean", row_id: str = "CustomerID",
) -> tuple[int, DataFrame, dict[int, list[list[float]]]]:
    """Best k by silhouette (first on ties), the score of each k, and each k's centres.

    ``metric="euclidean"`` is the exact score; all values of k share its one pass, whose work
    grows almost as the rows in up to three features, with their square in more.
    ``"squaredEuclidean"`` is linear. The number of rows never decides.
    """
    # every fit makes many short passes over the same points: keep them in memory, and let
    # a few fits fill each other's gaps
    points = _vectors(df, features).select("__vector").persist()
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        fits = pool.map(lambda k: _fit_vectors(points, k, seed), k_range)
        centres = dict(zip(k_range, fits))
    points.unpersist()
    labelled = df
    for k, c in centres.items():
        labelled = assign_nearest(labelled, features, c, f"k{k}")
    if metric == "euclidean":
        scores = {
            int(r["label"][1:]): r["silhouette"]
            for r in silhouette(labelled, features, [f"k{k}" for k in k_range], row_id).collect()
        }
    else:
        vectors = _vectors(labelled, features)
        scores = {
            k: ClusteringEvaluator(
                featuresCol="__vector", predictionCol=f"k{k}", distanceMeasure="squaredEuclidean"
            ).evaluate(vectors)
            for k in k_range
        }
    table = df.sparkSession.createDataFrame(
        [(int(k), float(scores[k]), metric) for k in k_range],
        "k int, silhouette double, metric string",
    )
    return argmax_k(table), table, centres


def argmax_k(scores: DataFrame) -> int:
    best = scores.agg(F.max_by("k", F.struct(F.col("silhouette"), -F.col("k"))).alias("k"))
    return best.first()["k"]


def fit_projection(df: DataFrame, features: Sequence[str], components: int = 2) -> list[list[float]]:
    """Principal axes, one list per component, the largest loading of each positive."""
    model = PCA(k=components, inputCol="__vector", outputCol="__pc").fit(_vectors(df, features))
    axes = np.array(model.pc.toArray())
    for j in range(components):
        if axes[np.argmax(np.abs(axes[:, j])), j] < 0:
            axes[:, j] = -axes[:, j]
    return [list(map(float, axes[:, j])) for j in range(components)]


def project(df: DataFrame, features: Sequence[str], axes: list[list[float]]) -> DataFrame:
    """Add PC1, PC2, … of columns that are already centred."""
    return df.withColumns(
        {
            f"PC{j + 1}": sum((F.col(f) * F.lit(w) for f, w in zip(features, axis)), F.lit(0.0))
            for j, axis in enumerate(axes)
        }
    )


def pca_2d(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return project(df, features, fit_projection(df, features, 2))


@dataclass
class SegmentModel:
    """A fitted segmentation: plain numbers and a one-row table of scaling statistics."""

    scaler: DataFrame
    centres: list[list[float]]
    axes: list[list[float]]
    scores: DataFrame | None = None

    @property
    def k(self) -> int:
        return len(self.centres)

    def scale(self, rfm: DataFrame) -> DataFrame:
        return apply_scaler(rfm, self.scaler, RFM, SCALED)

    def predict_cluster(self, rfm: DataFrame) -> DataFrame:
        """Clusters of new customers, with the fitted scaling and centres."""
        scaled = self.scale(rfm)
        return assign_nearest(scaled, list(SCALED.values()), self.centres).drop(*SCALED.values())


def predict_cluster(model: SegmentModel | None, rfm: DataFrame) -> DataFrame:
    if model is None:
        raise ValueError("fit a segmentation before predicting")
    return model.predict_cluster(rfm)


def order_centres(centres: list[list[float]], order_by: int | None) -> list[list[float]]:
    """k-means numbers its clusters arbitrarily while names go by number. An index here
    orders the clusters by that feature's centre, to make the numbers repeatable."""
    return centres if order_by is None else sorted(centres, key=lambda c: c[order_by])


def fit_clustering(
    rfm: DataFrame, n_clusters: int | None = None, seed: int = 42, metric: str = "euclidean",
    order_by: int | None = None,
) -> tuple[DataFrame, SegmentModel]:
    """Scale, choose k unless given, cluster, name, project. The scaled customers are
    written once: every fit is a further pass over them."""
    features = list(SCALED.values())
    rfm = stored(rfm)
    scaler = materialise(fit_scaler(rfm, RFM))
    scaled = materialise(apply_scaler(rfm, scaler, RFM, SCALED))
    scores = None
    if n_clusters is None:
        n_clusters, scores, fitted = find_optimal_clusters(scaled, features, seed=seed, metric=metric)
        centres = fitted[n_clusters]
    else:
        centres = fit_centres(scaled, features, n_clusters, seed)
    centres = order_centres(centres, order_by)
    model = SegmentModel(scaler, centres, fit_projection(scaled, features), scores)
    clustered = assign_nearest(scaled, features, centres).withColumn(
        "Cluster_Name", cluster_name(F.col("Cluster"))
    )
    return project(clustered, features, model.axes).drop(*features), model
