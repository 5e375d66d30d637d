"""Queries on k-means segments and silhouettes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import stages as s
from checks.ctes import CENTRES
from checks.registry import query
from shelfmark.operators import kmeans
from shelfmark.operators.rfm import segment_summary
from shelfmark.operators.silhouette import silhouette
from shelfmark.plans.segment import segment


@query("kmeans_assign", "CustomerID; Cluster", "FROM seg")
def _(spark, d):
    return kmeans.assign_nearest(s.scaled(spark, d), s.SCALED, CENTRES)


def fixed_model(spark, d):
    scaler = kmeans.fit_scaler(s.customers(spark, d), kmeans.RFM)
    return kmeans.SegmentModel(scaler, CENTRES, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])


@query("predict_cluster", "CustomerID; Cluster", "FROM seg")
def _(spark, d):
    return kmeans.predict_cluster(fixed_model(spark, d), s.customers(spark, d))


@query("silhouette", "label; silhouette:6",
       sql="""SELECT 'Cluster' AS label, round(avg(CASE WHEN size = 1 THEN 0
  ELSE (outer_d - inner_d) / greatest(outer_d, inner_d) END), 6) AS silhouette
FROM (
  SELECT "CustomerID", any_value(size) AS size,
         max(CASE WHEN own THEN total / (n - 1) END) AS inner_d,
         min(CASE WHEN NOT own THEN total / n END) AS outer_d
  FROM (
    SELECT p."CustomerID", p."Cluster" = o."Cluster" AS own, o."Cluster" AS other,
           count(*) AS n, max(p.size) AS size,
           sum(sqrt((p.recency_z - o.recency_z) * (p.recency_z - o.recency_z)
                    + (p.frequency_z - o.frequency_z) * (p.frequency_z - o.frequency_z)
                    + (p.monetary_z - o.monetary_z) * (p.monetary_z - o.monetary_z))) AS total
    FROM (SELECT *, count(*) OVER (PARTITION BY "Cluster") AS size FROM seg) p
    JOIN seg o ON true GROUP BY 1, 2, 3)
  GROUP BY 1)""")
def _(spark, d):
    labelled = kmeans.assign_nearest(s.scaled(spark, d), s.SCALED, CENTRES)
    return silhouette(labelled, s.SCALED, ["Cluster"], "CustomerID")


@query("kmeans")
def _(spark, d):
    base = s.scaled(spark, d)
    centres = kmeans.fit_centres(base, s.SCALED, 5)
    return kmeans.assign_nearest(base, s.SCALED, centres).select("CustomerID", "Cluster")


@query("kmeans_embeddings")
def _(spark, d):
    from shelfmark.sources.star import table

    names = [f"e{i}" for i in range(64)]
    vectors = table(spark, d, "embeddings").select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]
    )
    centres = kmeans.fit_centres(vectors, names, 4)
    return kmeans.assign_nearest(vectors, names, centres).select("vec_id", "Cluster")


@query("select_k")
def _(spark, d):
    _, scores, _ = kmeans.find_optimal_clusters(s.scaled(spark, d), s.SCALED)
    return scores


@query("argmax_k")
def _(spark, d):
    base = s.scaled(spark, d)
    best, _, _ = kmeans.find_optimal_clusters(base, s.SCALED)
    return base.agg(F.lit(best).alias("k"), F.count("*").alias("customers"))


@query("pca_2d")
def _(spark, d):
    return kmeans.pca_2d(s.scaled(spark, d), s.SCALED).select("CustomerID", "PC1", "PC2")


@query("segmentation_job")
def _(spark, d):
    return segment(s.clean(spark, d), n_clusters=5, order_by=2).customers


@query("segmentation_job_summary")
def _(spark, d):
    return segment_summary(segment(s.clean(spark, d)).customers)
