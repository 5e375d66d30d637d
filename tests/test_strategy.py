import pytest

from shelfmark.operators import strategy
from shelfmark.operators.anomalies import FEATURES
from shelfmark.sources.retail import RULE_METRICS

# cluster -> support, leverage, conviction, confidence and lift
EXPECTED = {
    0: ["bundling", "cross_selling", None, "cross_selling"],
    1: ["promotions", "cross_selling", "reactivation", "cross_selling"],
    2: ["cross_selling", "cross_selling", "upselling", "cross_selling"],
    3: ["wholesale", "wholesale", None, "cross_selling"],
    4: ["personalization", "cross_selling", "upselling", "cross_selling"],
}


@pytest.fixture(scope="module")
def lookup(spark):
    return {(r["Cluster"], r["metric"]): r["Recommended_Strategy"]
            for r in strategy.strategy_lookup(spark).collect()}


@pytest.mark.parametrize("cluster", sorted(EXPECTED))
@pytest.mark.parametrize("metric", ["support", "leverage", "conviction", "confidence", "lift"])
def test_strategy_matrix(lookup, cluster, metric):
    column = {"support": 0, "leverage": 1, "conviction": 2}.get(metric, 3)
    assert lookup.get((cluster, metric)) == EXPECTED[cluster][column]


def test_plain_metrics_stand_in_where_none_is_scaled(spark):
    rows = [(0, ["a"], ["b"], "r1", .9, .2, .1), (0, ["c"], ["d"], "r2", .1, .8, .3), (0, ["e"], ["f"], "r3", .1, .1, .2)]
    plain = spark.createDataFrame(
        [(*r, 0.0, 1.0) for r in rows], "Cluster int, antecedents array<string>, consequents array<string>, rule_id string, "
        "support double, confidence double, lift double, leverage double, conviction double")
    got = {r["Rule"]: r for r in strategy.business_rules(plain, top=2).collect()}
    assert sorted((r["Key_Metric"], r["Key_Metric_Value"]) for r in got.values()) == [("confidence", .8), ("support", .9)]
    assert {r["Anomaly_Score"] for r in got.values()} == {None}
    some = plain.withColumn("lift_normalized", plain["lift"] * 100)
    assert strategy.default_metrics(some) == ["lift_normalized", "support", "confidence"]
    flags = some.selectExpr("*", "1 AS isolation_forest_anomaly", "0 AS lof_anomaly")
    importance = spark.createDataFrame([(0, "lift", .9), (0, "support", .5)], "Cluster int, feature string, importance double")
    best = strategy.business_rules(flags, importance, top=1).first()
    assert best["Key_Metric"] == "lift_normalized" and best["Key_Metric_Value"] == pytest.approx(30)


def test_no_other_metric_or_cluster_has_an_answer(lookup):
    assert {m for _, m in lookup} == {"support", "leverage", "conviction", "confidence", "lift"}
    assert {c for c, _ in lookup} == set(EXPECTED)


def rules(spark, rows):
    """(cluster, id, the seven scaled metrics, forest flag, factor flag)"""
    full = [([f"x{i}"], ["y"], f"id{i}", c, *([0.5] * 7), *map(float, z), iso, lof, -0.1)
            for i, (c, z, iso, lof) in enumerate(rows)]
    schema = "antecedents array<string>, consequents array<string>, rule_id string, Cluster int, "
    schema += ", ".join(f"`{m}` double" for m in RULE_METRICS) + ", "
    schema += ", ".join(f"`{f}` double" for f in FEATURES)
    schema += ", isolation_forest_anomaly int, lof_anomaly int, anomaly_score double"
    return spark.createDataFrame(full, schema)


def z(support=0.0, confidence=0.0, lift=0.0, antecedent=0.0):
    return [antecedent, 0.0, support, confidence, lift, 0.0, 0.0]


def test_each_rule_takes_its_largest_metric_first_listed_on_ties(spark):
    df = rules(spark, [(0, z(1, 1, 0), 0, 0), (0, z(0, 1, 2), 0, 0), (9, z(5, 5, 5), 0, 0)])
    got = {tuple(r["Antecedents"]): r for r in strategy.business_rules(df).collect()}
    assert set(got) == {("x0",), ("x1",)}, "an unknown cluster has no strategy"
    assert got[("x0",)]["Key_Metric"] == "support_normalized"
    assert got[("x0",)]["Recommended_Strategy"] == "bundling"
    assert (got[("x1",)]["Key_Metric"], got[("x1",)]["Key_Metric_Value"]) == ("lift_normalized", 2.0)
    assert got[("x1",)]["Rule"] == "['x1'] -> ['y']" and got[("x1",)]["Cluster_Name"] == "Casual Buyers"


def test_only_the_top_rules_of_a_cluster(spark):
    df = rules(spark, [(1, z(i, i, i), 0, 0) for i in range(12)])
    best = strategy.sort_business_rules(strategy.business_rules(df, top=5)).collect()
    assert [r["Key_Metric_Value"] for r in best] == [11, 10, 9, 8, 7]


def test_importance_decides_metric_and_anomalies_only(spark):
    df = rules(spark, [(3, z(1, 2, 3), 1, 0), (3, z(9, 9, 9), 0, 0), (3, z(4, 0, 0), 0, 1),
                       (4, z(1, 1, 1, 7), 1, 1)])
    importance = spark.createDataFrame(
        [(3, "support_normalized", .9), (3, "lift_normalized", .5), (3, "confidence_normalized", .1),
         (4, "antecedent support_normalized", .9), (4, "lift_normalized", .5)],
        "Cluster int, feature string, importance double")
    got = strategy.business_rules(df, importance).collect()
    assert {(r["Antecedents"][0], r["Key_Metric"], r["Recommended_Strategy"]) for r in got} == {
        ("x0", "support_normalized", "wholesale"), ("x2", "support_normalized", "wholesale")}


def test_cluster_without_importance_keeps_its_general_ranking(spark):
    rows = [(3, z(1, 2, 3), 1, 0), (3, z(9, 9, 9), 0, 0), (1, z(1, 0, 5), 0, 1), (1, z(7, 1, 1), 0, 0)]
    df = rules(spark, rows)
    importance = spark.createDataFrame(
        [(3, "support_normalized", .9), (3, "lift_normalized", .5)],
        "Cluster int, feature string, importance double")
    general = [tuple(r) for r in strategy.business_rules(df).where("Cluster = 1").collect()]
    got = [tuple(r) for r in strategy.business_rules(df, importance).collect()]
    assert len(general) == 2 and sorted(r for r in got if r[0] == 1) == sorted(general)
    assert [r[2] for r in got if r[0] == 3] == ["['x0'] -> ['y']"]


def test_thresholds(spark):
    df = rules(spark, [(0, z(1), 0, 0)])
    assert strategy.business_rules(df, min_support=0.5, min_confidence=0.5).count() == 1
    assert strategy.business_rules(df, min_support=0.6, min_confidence=0.5).count() == 0
