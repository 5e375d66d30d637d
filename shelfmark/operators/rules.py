"""Association rules from frequent itemsets, their metrics, filters and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions import rules as r
from shelfmark.functions.numeric import is_infinite, round_half_even
from shelfmark.operators.groups import join_groups
from shelfmark.operators.ordering import top_n
from shelfmark.session import stored

MIN_BASKETS = 10
MAX_RULES = 5000

# The tuning grid, its accepted range and its fallback.
GRID_SUPPORT = [0.03, 0.05]
GRID_CONFIDENCE = [0.3, 0.4]
GRID_LIFT = [1.2, 1.5]
RULES_RANGE = (20, 1000)
DEFAULT_POINT = (0.03, 0.3, 1.2)

POINT = ["min_support", "min_confidence"]


def association_rules(itemsets: DataFrame, min_confidence: float, by: str = "Cluster") -> DataFrame:
    """Every split of every itemset into two non-empty sides with enough confidence.

    Consequents grow level by level. The confidence of a set's rule only falls as its consequent
    grows, so a consequent is tried only where two of one item less hold that share all but their
    last item; a set with few confident single consequents costs no more than these. Each level is
    written once and is one pass over the rules of the level before. ``itemsets`` must hold the
    subsets of its sets, as mining returns them.
    """
    sets = itemsets.withColumn("support", F.col("count") / F.col("baskets"))
    columns = [by, "items", "count", "baskets", "support"]

    def side(items: str) -> DataFrame:
        return sets.select(
            by, F.col("items").alias(f"{items}s"), F.col("support").alias(f"{items} support")
        )

    def confident(splits: DataFrame) -> DataFrame:
        rest = F.array_except("items", "consequents")
        joined = splits.withColumn("antecedents", rest).join(side("antecedent"), [by, "antecedents"])
        joined = joined.withColumn("confidence", F.col("support") / F.col("antecedent support"))
        return stored(joined.where(F.col("confidence") >= min_confidence))

    single = sets.where(F.size("items") > 1).withColumn("item", F.explode("items"))
    levels = [confident(single.withColumn("consequents", F.array("item")).drop("item"))]
    while True:
        size = len(levels)
        larger = levels[-1].where(F.size("items") > size + 1)
        if larger.isEmpty():
            break
        levels.append(confident(_longer_consequents(larger, columns, size)))
    joined = reduce(DataFrame.unionByName, levels).join(side("consequent"), [by, "consequents"])
    s, a, c = F.col("support"), F.col("antecedent support"), F.col("consequent support")
    return joined.select(
        by, "antecedents", "consequents", a, c, s, "confidence",
        (F.col("confidence") / c).alias("lift"),
        r.leverage(s, a, c).alias("leverage"),
        r.conviction(c, F.col("confidence")).alias("conviction"),
        "count", "baskets",
    )


def _longer_consequents(rules: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Consequents of ``size + 1`` items out of two of ``size`` items with equal beginnings."""
    last = F.element_at("consequents", -1)
    alike = rules.groupBy(*columns, F.slice("consequents", 1, size - 1).alias("beginning")).agg(
        F.array_sort(F.collect_list(last)).alias("lasts")
    )
    firsts = alike.where(F.size("lasts") > 1).select("*", F.posexplode("lasts").alias("place", "one"))
    pairs = firsts.withColumn(
        "other", F.explode(F.slice("lasts", F.col("place") + 2, F.size("lasts")))
    )
    return pairs.select(*columns, F.concat("beginning", F.array("one", "other")).alias("consequents"))


def extra_metrics(rules: DataFrame) -> DataFrame:
    s, a, c = F.col("support"), F.col("antecedent support"), F.col("consequent support")
    return rules.withColumns(
        {
            "representativity": r.representativity(),
            "zhangs_metric": r.zhangs_metric(s, a, c),
            "jaccard": r.jaccard(s, a, c),
            "certainty": r.certainty(F.col("confidence"), c),
            "kulczynski": r.kulczynski(s, a, c),
        }
    )


def cap_conviction(rules: DataFrame, by: list[str]) -> DataFrame:
    """Infinite conviction becomes the rule set's largest finite one, or 1.0."""
    finite = F.max(F.when(~is_infinite(F.col("conviction")), F.col("conviction")))
    largest = rules.groupBy(*by).agg(finite.alias("__largest"))
    capped = F.when(
        is_infinite(F.col("conviction")), F.coalesce(F.col("__largest"), F.lit(1.0))
    ).otherwise(F.col("conviction"))
    return join_groups(rules, largest, by).withColumn("conviction", capped).drop("__largest")


def rule_order() -> list[Column]:
    """Best rules first; the item sets settle ties."""
    return [
        F.desc("lift"), F.desc("confidence"), F.desc("support"),
        F.asc("antecedents"), F.asc("consequents"),
    ]


def sort_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(*rule_order())


def rank_rules(rules: DataFrame, by: list[str]) -> DataFrame:
    """1-based place in rule order. For rule sets already cut to a top-n."""
    return rules.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*by).orderBy(*rule_order()))
    )


def cap_rules(rules: DataFrame, by: list[str], n: int = MAX_RULES) -> DataFrame:
    return top_n(rules, by, rule_order(), n)


def lift_filter(rules: DataFrame, min_lift: float | Column) -> DataFrame:
    return rules.where(F.col("lift") >= min_lift)


def rules_at_points(
    rules: DataFrame, supports: list[float], confidences: list[float], max_rules: int | None = None
) -> DataFrame:
    """The rule set of each (support, confidence) point, out of rules mined at the lowest
    of them: conviction capped within the point, then the best ``max_rules`` kept, by
    default all."""
    grid = F.array(
        *[
            F.struct(F.lit(s).alias("min_support"), F.lit(c).alias("min_confidence"))
            for s in supports
            for c in confidences
        ]
    )
    points = (
        rules.where(F.col("baskets") >= MIN_BASKETS)
        .withColumn("__point", F.explode(grid))
        .select("*", "__point.*")
        .drop("__point")
        .where(
            (F.col("count") >= r.min_count(F.col("min_support"), F.col("baskets")))
            & (F.col("confidence") >= F.col("min_confidence"))
        )
    )
    by = ["Cluster", *POINT]
    capped = cap_conviction(points, by)
    return capped if max_rules is None else cap_rules(capped, by, max_rules)


def generate_rules(
    itemsets: DataFrame, min_support: float, min_confidence: float, min_lift: float,
    max_rules: int | None = None,
) -> DataFrame:
    """The rules of one parameter choice, unordered."""
    rules = association_rules(itemsets, min_confidence)
    points = rules_at_points(rules, [min_support], [min_confidence], max_rules)
    return lift_filter(points, min_lift).drop(*POINT)


def tuning_results(points: DataFrame, lifts: list[float] = GRID_LIFT) -> DataFrame:
    """Rule count and mean metrics at every grid point that yields rules."""
    return (
        points.withColumn("min_lift", F.explode(F.array(*map(F.lit, lifts))))
        .where(F.col("lift") >= F.col("min_lift"))
        .groupBy("Cluster", *POINT, "min_lift")
        .agg(
            F.count(F.lit(1)).alias("num_rules"),
            F.avg("lift").alias("avg_lift"),
            F.avg("confidence").alias("avg_confidence"),
            F.avg("leverage").alias("avg_leverage"),
        )
    )


def candidate_range(tuning: DataFrame, low: int = RULES_RANGE[0], high: int = RULES_RANGE[1]) -> DataFrame:
    return tuning.where(F.col("num_rules").between(low, high))


def best_params(tuning: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster the grid point with the largest mean lift in range, else the default.

    Two points may hold the same rules, whose mean then differs only by the order of
    summation: means are compared to nine digits, and ties go to the lower thresholds.
    """
    names = [*POINT, "min_lift"]
    chosen = candidate_range(tuning).groupBy("Cluster").agg(
        F.min_by(
            F.struct(*names),
            F.struct((-F.round("avg_lift", 9)).alias("a"), *names),
        ).alias("best")
    )
    joined = clusters.select("Cluster").distinct().join(chosen, "Cluster", "left")
    return joined.select(
        "Cluster",
        *[
            F.coalesce(F.col("best").getField(n), F.lit(v)).alias(n)
            for n, v in zip(names, DEFAULT_POINT)
        ],
    )


def tuned_rules(points: DataFrame, params: DataFrame) -> DataFrame:
    """The rules of each cluster at its own chosen point."""
    joined = join_groups(points, params, ["Cluster", *POINT])
    return joined.where(F.col("lift") >= F.col("min_lift")).drop(*POINT, "min_lift")


def union_cluster_rules(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def rules_summary(rules: DataFrame) -> DataFrame:
    """Spread of the rule metrics per cluster, four decimals; deviations with n−1."""
    functions = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wanted = {
        "support": ["mean", "std", "min", "max"],
        "confidence": ["mean", "std", "min", "max"],
        "lift": ["mean", "std", "min", "max"],
        "leverage": ["mean", "std"],
        "conviction": ["mean", "std"],
    }
    aggregates = [F.count("support").alias("total_rules")] + [
        round_half_even(functions[f](metric), 4).alias(f"{f}_{metric}")
        for metric, names in wanted.items()
        for f in names
    ]
    return rules.groupBy("Cluster").agg(*aggregates)


def lift_by_cluster(rules: DataFrame) -> DataFrame:
    return rules.groupBy("Cluster").agg(
        F.avg("lift").alias("avg_lift"), F.max("lift").alias("max_lift")
    )


def top_rules(rules: DataFrame, n: int = 10, by: list[str] | None = None) -> DataFrame:
    if by:
        return top_n(rules, by, rule_order(), n)
    return rules.orderBy(*rule_order()).limit(n)


def rule_edges(rules: DataFrame, n: int = 10) -> DataFrame:
    """Item-to-item edges of each cluster's ``n`` best rules. Where two rules give the
    same edge the lower-ranked one, drawn last, gives its numbers."""
    best = rank_rules(top_rules(rules, n, ["Cluster"]), ["Cluster"])
    edges = best.select(
        "Cluster", "rank", "lift", "confidence", "support", "consequents",
        F.explode("antecedents").alias("src"),
    ).withColumn("dst", F.explode("consequents"))
    return edges.groupBy("Cluster", "src", "dst").agg(
        F.max_by(F.struct(F.col("lift").alias("weight"), "confidence", "support"), "rank").alias("e")
    ).select("Cluster", "src", "dst", "e.*")


