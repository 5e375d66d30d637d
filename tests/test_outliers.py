import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import anomalies as a
from shelfmark.operators import contamination, iforest, lof, neighbours, shapley, silhouette
from shelfmark.operators.kmeans import argmax_k, assign_nearest, fit_clustering, predict_cluster
from shelfmark.sources.retail import RULE_METRICS

COLUMNS = ["x", "y", "z"]


def points(spark, data, groups=None, partitions=4):
    rows = [(i, int(groups[i]) if groups is not None else 0, *map(float, p))
            for i, p in enumerate(data)]
    return spark.createDataFrame(rows, "id int, Cluster int, x double, y double, z double"
                                 ).repartition(partitions)


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    k_distance = dist[:, -1]
    density = 1 / (np.maximum(k_distance[near], dist).mean(1) + 1e-10)
    return (density[near] / density[:, None]).mean(1)


@pytest.mark.parametrize("cell", [10_000, 40])
def test_lof_equals_brute_force(spark, monkeypatch, cell):
    """With small cells the search runs over many pivots and visits other cells."""
    monkeypatch.setattr(neighbours, "CELL_POINTS", cell)
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", 32)
    rng = np.random.default_rng(3)
    data = np.vstack([rng.normal(size=(220, 3)), rng.normal(8, 0.2, size=(60, 3)), [[20, 20, 20]]])
    groups = np.array([0] * 200 + [1] * 81)
    df = points(spark, data, groups)
    for k in (3, 10):
        got = {r["id"]: -r["lof_score"] for r in lof.lof(df, COLUMNS, k, row_id="id").collect()}
        for g in (0, 1):
            mine = np.nonzero(groups == g)[0]
            want = brute_lof(data[mine], k)
            np.testing.assert_allclose([got[i] for i in mine], want, rtol=1e-9)


def test_neighbours_in_one_dense_cell_and_in_many_groups(spark, monkeypatch):
    """Nearly all points lie in one cell of many blocks; 60 other groups have a k of their own."""
    monkeypatch.setattr(neighbours, "CELL_POINTS", 400)
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", 16)
    monkeypatch.setattr(neighbours, "SLICE_POINTS", 64)
    rng = np.random.default_rng(11)
    dense = np.vstack([rng.normal(size=(300, 3)) * 1e-3, rng.normal(size=(20, 3)) * 50])
    data, groups, ks = [*dense], [0] * len(dense), [(0, 7)]
    for g in range(1, 61):
        n = int(rng.integers(1, 9))
        data += [*rng.normal(size=(n, 3))]
        groups += [g] * n
        ks.append((g, 1 + g % 4))
    data, groups = np.array(data), np.array(groups)
    spread, _ = neighbours.distinct_points(points(spark, data, groups), "Cluster", "id", COLUMNS)
    wanted = spark.createDataFrame(ks, "Cluster int, k int")
    got = {}
    for r in neighbours.nearest_neighbours(spread, "Cluster", wanted).collect():
        got.setdefault(r["point"], []).append((round(r["d"], 9), r["near"]))
    k_of = dict(ks)
    for i in range(len(data)):
        mine = [j for j in np.nonzero(groups == groups[i])[0] if j != i]
        want = sorted((round(float(np.sqrt(((data[i] - data[j]) ** 2).sum())), 9), int(j)) for j in mine)[: k_of[groups[i]]]
        assert sorted(got.get(i, [])) == want


def test_nothing_of_pivots_or_trees_is_limited():
    assert not hasattr(neighbours, "MAX_PIVOTS") and not hasattr(iforest, "MAX_NODES")


def test_forests_of_many_groups_are_scored_by_slices(spark, monkeypatch):
    """300 groups, one of them in many slices, one without a forest, one NULL."""
    monkeypatch.setattr(iforest, "SLICE_ROWS", 50)
    nodes = [(g, t, 0, t % 3, 0.1 * g, 1, 2, 4, 0.0) for g in range(300) for t in (0, 1)]
    nodes += [(g, t, n, -1, 0.0, -1, -1, 2, float(n)) for g in range(300) for t in (0, 1) for n in (1, 2)]
    forest = spark.createDataFrame(nodes, f"Cluster int, {iforest.NODE_COLUMNS}")
    rng = np.random.default_rng(1)
    data = rng.normal(size=(1200, 3)) * 20
    groups = [7] * 600 + [int(x) for x in rng.integers(0, 300, 598)] + [999, None]
    rows = [(i, g, *map(float, x), ["list"]) for i, (g, x) in enumerate(zip(groups, data))]
    df = spark.createDataFrame(rows, "id int, Cluster int, x double, y double, z double, extra array<string>")
    got = {r["id"]: r for r in iforest.score_forest(df, forest, COLUMNS).collect()}
    assert len(got) == 1200 and got[0]["extra"] == ["list"]
    unit = float(iforest.mean_path(4))
    for i, (g, x) in enumerate(zip(groups, data)):
        if g is None or g == 999:
            assert got[i]["iforest_score"] is None
        else:
            depth = np.mean([1.0 if x[t] <= 0.1 * g else 2.0 for t in (0, 1)])
            assert got[i]["iforest_score"] == pytest.approx(-2 ** (-depth / unit))


def test_copies_cost_one_point_and_count_as_many(spark, monkeypatch):
    """A third of all rows are copies of one vector."""
    monkeypatch.setattr(neighbours, "CELL_POINTS", 50)
    rng = np.random.default_rng(5)
    data = np.vstack([rng.normal(size=(200, 3)), np.tile([[0.5, 0.5, 0.5]], (100, 1))])
    df = points(spark, data)
    spread, members = neighbours.distinct_points(df, "Cluster", "id", COLUMNS)
    assert spread.count() == 201 and members.count() == 300
    got = {r["id"]: -r["lof_score"] for r in lof.lof(df, COLUMNS, 5, row_id="id").collect()}
    # the copies' density is the guard's inverse: compare away from points that touch them
    want = brute_lof(data, 5)
    far = [i for i in range(200) if want[i] < 1e3]
    np.testing.assert_allclose([got[i] for i in far], want[far], rtol=1e-6)
    assert {round(got[i], 9) for i in range(200, 300)} == {1.0}


def test_lof_near_one_on_a_grid_and_k_is_clamped(spark):
    grid = np.array(list(itertools.product(range(6), range(6), range(2))), dtype=float)
    scores = [-r["lof_score"] for r in lof.lof(points(spark, grid), COLUMNS, 10, row_id="id").collect()]
    assert max(scores) < 1.3 and min(scores) > 0.8
    few = points(spark, grid[:5])
    scores = lof.lof_scores(few, COLUMNS, lof.k_table(few, [4, 50]), 50, row_id="id")
    by_id = {}
    for r in scores.collect():
        by_id.setdefault(r["id"], set()).add(r["factor"])
    assert len(by_id) == 5 and all(len(v) == 1 for v in by_id.values())


def test_silhouette_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(silhouette, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(2)
    data = rng.normal(size=(200, 3))
    two, three = (data[:, 0] > 0).astype(int), np.arange(200) % 3
    three[0] = 3  # a cluster of one
    rows = [(i, *map(float, p), int(two[i]), int(three[i])) for i, p in enumerate(data)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double, two int, three int")
    got = {r["label"]: r["silhouette"] for r in
           silhouette.silhouette(df, COLUMNS, ["two", "three"], "id").collect()}
    d = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    for name, labels in (("two", two), ("three", three)):
        values = []
        for i in range(200):
            same = labels == labels[i]
            if same.sum() == 1:
                values.append(0.0)
                continue
            inner = d[i, same].sum() / (same.sum() - 1)
            outer = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
            values.append((outer - inner) / max(inner, outer))
        assert got[name] == pytest.approx(np.mean(values), abs=1e-12)


def test_best_k_is_the_first_of_equals(spark):
    df = spark.createDataFrame([(2, .5), (3, .6), (4, .6)], "k int, silhouette double")
    assert argmax_k(df) == 3


def test_segments_predict_like_they_were_fitted(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i), int(r), int(f), float(m), False) for i, (r, f, m) in enumerate(
        np.vstack([rng.normal([300, 2, 50], 5, (40, 3)), rng.normal([10, 30, 900], 5, (40, 3))]))]
    df = spark.createDataFrame(
        rows, "CustomerID string, Recency int, Frequency int, Monetary double, IsGuest boolean")
    fitted, model = fit_clustering(df, order_by=2)
    assert model.k == 2 and {r["metric"] for r in model.scores.collect()} == {"euclidean"}
    want = {r["CustomerID"]: r["Cluster"] for r in fitted.collect()}
    got = {r["CustomerID"]: r["Cluster"] for r in predict_cluster(model, df).collect()}
    assert got == want and all(want[str(i)] == (i >= 40) for i in range(80))
    stats = fitted.agg(F.var_pop("PC1").alias("a"), F.var_pop("PC2").alias("b"),
                       F.covar_pop("PC1", "PC2").alias("c")).first()
    assert stats["a"] >= stats["b"] and abs(stats["c"]) < 1e-9
    with pytest.raises(ValueError):
        predict_cluster(None, df)


def test_assignment_ties_go_to_the_first_centre(spark):
    df = spark.createDataFrame([(0.0,)], "x double")
    assert assign_nearest(df, ["x"], [[1.0], [-1.0]]).first()["Cluster"] == 0


@pytest.fixture(scope="module")
def forest_data(spark):
    rng = np.random.default_rng(9)
    data = np.vstack([rng.normal(size=(400, 3)), [[9, 9, 9]]])
    df = points(spark, data)
    return data, df, iforest.fit_forest(df, COLUMNS, row_id="id", trees=20)


def test_forest_does_not_depend_on_partitions(spark, forest_data):
    data, df, forest = forest_data
    again = iforest.fit_forest(points(spark, data, partitions=1), COLUMNS, row_id="id", trees=20)
    key = ["Cluster", "tree", "node"]
    assert forest.orderBy(*key).collect() == again.orderBy(*key).collect()
    sizes = forest.where("node = 0").select("samples").distinct().collect()
    assert [r[0] for r in sizes] == [256]


def test_forest_scores_and_flag_share(spark, forest_data):
    data, df, forest = forest_data
    scored = iforest.score_forest(df, forest, COLUMNS)
    scores = {r["id"]: r["iforest_score"] for r in scored.collect()}
    assert min(scores, key=scores.get) == 400, "the far point is set apart first"
    trees = iforest.trees_of(iforest.packed(forest).toArrow())

    def depth(tree, row):
        node = 0
        while tree["feature"][node] >= 0:
            goes_left = row[tree["feature"][node]] <= tree["threshold"][node]
            node = tree["left"][node] if goes_left else tree["right"][node]
        return tree["path"][node]

    for i in (0, 17, 400):
        mean = np.mean([depth(t, data[i]) for t in trees])
        assert scores[i] == pytest.approx(-2 ** (-mean / float(iforest.mean_path(256))))
    rates = spark.createDataFrame([(0, 0.05)], "Cluster int, contamination double")
    flagged = iforest.flag_forest(scored, rates)
    assert flagged.where("isolation_forest_anomaly = 1").count() == 20  # 5 % of 401


def test_mean_path_length():
    assert list(iforest.mean_path(np.array([0, 1, 2]))) == [0, 0, 1]
    assert float(iforest.mean_path(256)) == pytest.approx(10.244770920, abs=1e-6)


def test_shapley_values_equal_all_coalitions(spark, forest_data):
    data, df, forest = forest_data
    trees, rows = iforest.trees_of(iforest.packed(forest).toArrow()), data[[3, 400]]

    def expected(tree, node, row, known):
        f = tree["feature"][node]
        if f < 0:
            return tree["path"][node]
        left, right = tree["left"][node], tree["right"][node]
        if f in known:
            go = left if row[f] <= tree["threshold"][node] else right
            return expected(tree, go, row, known)
        n = tree["samples"]
        return (n[left] * expected(tree, left, row, known)
                + n[right] * expected(tree, right, row, known)) / n[node]

    got = shapley.shapley_values(trees, rows)
    for row, values in zip(rows, got):
        v = {s: np.mean([expected(t, 0, row, s) for t in trees])
             for n in range(4) for s in itertools.combinations(range(3), n)}
        for f in range(3):
            others = [j for j in range(3) if j != f]
            want = 0.0
            for n in range(3):
                for s in itertools.combinations(others, n):
                    w = factorial(n) * factorial(2 - n) / factorial(3)
                    want += w * (v[tuple(sorted((*s, f)))] - v[s])
            assert values[f] == pytest.approx(want)
        assert values.sum() == pytest.approx(v[(0, 1, 2)] - v[()])


def rules_table(spark, n, cluster=0, conviction=None):
    rng = np.random.default_rng(n)
    rows = [([f"a{i}"], [f"b{i % 4}"], *map(float, rng.random(6)),
             conviction if conviction is not None else float(rng.random()), cluster)
            for i in range(n)]
    schema = "antecedents array<string>, consequents array<string>, " + ", ".join(
        f"`{m}` double" for m in RULE_METRICS) + ", Cluster int"
    return spark.createDataFrame(rows, schema)


def uniform(spark, contamination=0.1, k=5, clusters=(0, 1)):
    return spark.createDataFrame([(c, contamination, k) for c in clusters],
                                 "Cluster int, contamination double, n_neighbors int")


def test_small_groups_get_no_flags(spark):
    rules = rules_table(spark, 9, 0).unionByName(rules_table(spark, 40, 1))
    found = a.detect_anomalies(a.preprocess_rules(rules), uniform(spark))
    got = {r["Cluster"]: r for r in a.anomaly_counts(found.rules).collect()}
    assert got[0]["total_rules"] == 9 and got[0]["isolation_forest_anomaly"] == 0
    assert got[0]["lof_anomaly"] == 0 and got[1]["isolation_forest_anomaly"] == 4
    zero = found.rules.where("Cluster = 0").select("anomaly_score").distinct().collect()
    assert [r[0] for r in zero] == [0.0]


def test_all_infinite_conviction_and_constant_metric(spark):
    rules = rules_table(spark, 12, conviction=float("inf")).withColumn("lift", F.lit(2.0))
    got = a.preprocess_rules(rules).collect()
    assert all(r["conviction_normalized"] is None for r in got)
    assert all(r["lift_normalized"] == 0.0 for r in got)
    assert len({r["rule_id"] for r in got}) == 12


def test_any_metrics_may_be_scaled(spark):
    rules = rules_table(spark, 40).withColumn("jaccard", F.col("lift") / 2)
    got = a.preprocess_rules(rules, features=["lift", "jaccard"])
    assert {"lift_normalized", "jaccard_normalized"} <= set(got.columns) and "support_normalized" not in got.columns
    one = got.agg(F.avg("jaccard_normalized"), F.stddev_pop("jaccard_normalized")).first()
    assert one[0] == pytest.approx(0, abs=1e-9) and one[1] == pytest.approx(1)
    found = a.detect_anomalies(got, uniform(spark), features=["lift_normalized", "jaccard_normalized"])
    assert found.rules.count() == 40 and found.rules.where("isolation_forest_anomaly = 1").count() == 4
    again = a.predict_anomalies(rules, found.forest, found.offsets, metrics=["lift", "jaccard"])
    assert again.where("isolation_forest_anomaly = 1").count() == 4
    with pytest.raises(ValueError, match="no columns"):
        a.preprocess_rules(rules, features=["lift", "nothing"])


def test_predicting_needs_a_trained_cluster(spark):
    prepared = a.preprocess_rules(rules_table(spark, 30, 0))
    found = a.detect_anomalies(prepared, uniform(spark, clusters=(0,)))
    new = rules_table(spark, 30, 0)
    got = a.predict_anomalies(new, found.forest, found.offsets)
    want = {r["rule_id"]: r["anomaly_score"] for r in found.rules.collect()}
    assert {r["rule_id"]: r["anomaly_score"] for r in got.collect()} == pytest.approx(want)
    with pytest.raises(ValueError):
        a.predict_anomalies(rules_table(spark, 5, 7), found.forest, found.offsets)


def test_repeated_rules_come_back_as_often(spark):
    once = rules_table(spark, 12, 0)
    twice = a.preprocess_rules(once.unionByName(once))
    found = a.detect_anomalies(twice, uniform(spark, clusters=(0,)))
    got = found.rules.select("rule_id", *a.FLAGS, "anomaly_score").collect()
    assert len(got) == 24 and len({r["rule_id"] for r in got}) == 12
    assert len({tuple(r) for r in got}) == 12
    again = a.predict_anomalies(once.unionByName(once), found.forest, found.offsets)
    assert again.count() == 24 and "__row" not in again.columns + found.rules.columns


def test_jaccard_of_flag_sets(spark):
    rows = [(0, str(i), rate, 0.0, int(i in hit)) for rate, hit in
            ((.01, {1}), (.03, {1, 2, 3})) for i in range(5)]
    rows += [(1, str(i), rate, 0.0, 0) for rate in (.01, .03) for i in range(3)]
    df = spark.createDataFrame(
        rows, "Cluster int, rule_id string, rate double, threshold double, flag int")
    got = {r["Cluster"]: r["jaccard"] for r in contamination.jaccard_of_neighbours(df).collect()}
    assert got == {0: pytest.approx(1 / 3), 1: 1.0}


def test_item_ratios(spark):
    rows = [(0, ["a"] if i < 2 else [f"n{i}"], ["z"], int(i < 4)) for i in range(4)]
    rows += [(0, ["a"] if i == 0 else [f"m{i}"], ["z"], 0) for i in range(8)]
    df = spark.createDataFrame(
        rows, "Cluster int, antecedents array<string>, consequents array<string>, flag int")
    got = {r["item"]: tuple(r)[3:] for r in a.item_anomaly_ratio(df, ["flag"]).collect()}
    assert got["a"] == (.5, .125, 4.0) and got["n2"] == (.25, 0.0, float("inf"))
