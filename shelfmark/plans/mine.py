"""Job 3: association rules of every customer segment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfmark.operators import baskets as b
from shelfmark.operators import rules as r
from shelfmark.session import materialise, stored


@dataclass
class Mined:
    """What one mining run hands on."""

    lines: DataFrame
    statistics: DataFrame
    tuning: DataFrame
    params: DataFrame
    rules: DataFrame


def mine_all(
    lines: DataFrame, segments: DataFrame, sample: bool = False,
    item: str = "CategoryExtraction", order_by: list[str] = ["StockCode", "UnitPrice"],
) -> Mined:
    """Mine once per cluster at the lowest grid support; every grid point and the final
    rules are filters of that one result. All invoices are mined; ``sample=True`` mines
    the first of the large clusters only."""
    # read by the baskets and the statistics
    clustered = stored(b.lines_with_cluster(lines, segments))
    used = b.first_invoices(clustered, ["Cluster"]) if sample else clustered
    baskets = b.prepare_baskets(used, item, ["Cluster"], order_by)
    itemsets = materialise(b.frequent_itemsets(baskets, min(r.GRID_SUPPORT)))
    rules = r.association_rules(itemsets, min(r.GRID_CONFIDENCE))
    points = materialise(r.rules_at_points(rules, r.GRID_SUPPORT, r.GRID_CONFIDENCE))
    tuning = r.tuning_results(points)
    params = r.best_params(tuning, itemsets)
    final = r.extra_metrics(r.tuned_rules(points, params))
    return Mined(used, b.cluster_statistics(clustered, used), tuning, params, final)


def mine_cluster(lines: DataFrame, segments: DataFrame, cluster: int, sample: bool = False) -> Mined:
    return mine_all(lines, b.cluster_subset(segments, cluster), sample)
