import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import ordering as o
from shelfmark.operators.groups import join_groups
from shelfmark.operators import scaling


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, one value with a third of them."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        group = "hot" if i % 5 else "cold"
        value = 1.25 if i % 3 == 0 else float(rng.normal())
        rows.append((i, group, value, float(rng.integers(0, 5)), None if i % 7 == 0 else value))
    return rows, spark.createDataFrame(
        rows, "id int, g string, a double, b double, c double").repartition(5)


@pytest.mark.parametrize("partitions", ["8", "64"])
def test_quantiles_are_exact(spark, skewed, partitions):
    rows, df = skewed
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.93, 1.0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {(r["g"], r["column"]): r["q"] for r in
           o.quantiles(df, ["g"], ["a", "b", "c"], probabilities).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for group in ("hot", "cold"):
        for i, column in ((2, "a"), (3, "b"), (4, "c")):
            values = [r[i] for r in rows if r[1] == group and r[i] is not None]
            want = np.quantile(values, probabilities)
            np.testing.assert_allclose(got[(group, column)], want, rtol=1e-12)


def test_average_rank_shares_ties(spark, skewed):
    rows, df = skewed
    got = {r["id"]: r["r"] for r in o.average_rank(df, ["g"], "b", "r").collect()}
    for group in ("hot", "cold"):
        mine = [(r[0], r[3]) for r in rows if r[1] == group]
        values = np.sort([v for _, v in mine])
        for row_id, v in mine:
            low, high = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            assert got[row_id] == (low + 1 + high) / 2


def test_top_n_beyond_the_group_limit(spark, skewed):
    rows, df = skewed
    for n in (3, 1500):
        got = {r["id"] for r in o.top_n(df, ["g"], [F.desc("a"), F.asc("id")], n).collect()}
        want = set()
        for group in ("hot", "cold"):
            mine = sorted((r for r in rows if r[1] == group), key=lambda r: (-r[2], r[0]))
            want |= {r[0] for r in mine[:n]}
        assert got == want


def test_hot_group_is_cut_inside_the_map_tasks(spark, skewed):
    plan = o.top_n(skewed[1], ["g"], [F.desc("a"), F.asc("id")], 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in text and "WindowGroupLimit" in text


def test_group_rows_go_to_the_data(spark, skewed):
    stats = skewed[1].groupBy("g").agg(F.avg("a").alias("m"))
    joined = join_groups(skewed[1], stats, ["g"])
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_many_groups_are_not_broadcast_by_force(spark, monkeypatch):
    from shelfmark.operators import groups

    monkeypatch.setattr(groups, "MAX_GROUPS", 5)
    rows = spark.range(50).withColumn("g", F.col("id") % 20)
    stats = rows.groupBy("g").agg(F.count("*").alias("n"))
    assert join_groups(rows, stats, ["g"]).count() == 50


def test_scaling_has_mean_zero_and_population_deviation_one(spark, skewed):
    got = scaling.standard_scale(skewed[1].withColumn("k", F.lit(3.0)), ["a", "b", "k"], ["g"])
    for r in got.groupBy("g").agg(
        *[f(c).alias(f"{c}{i}") for c in ("a_scaled", "b_scaled")
          for i, f in enumerate((F.avg, F.stddev_pop))], F.max("k_scaled").alias("k"),
    ).collect():
        assert abs(r["a_scaled0"]) < 1e-9 and abs(r["a_scaled1"] - 1) < 1e-9
        assert abs(r["b_scaled0"]) < 1e-9 and abs(r["b_scaled1"] - 1) < 1e-9
        assert r["k"] == 0.0, "a constant column scales to zero"


def test_impute_fills_gaps_and_infinities_with_the_median(spark):
    rows = [("g", 1.0), ("g", 3.0), ("g", None), ("g", float("inf")), ("h", None), ("h", 4.0)]
    got = scaling.median_impute(spark.createDataFrame(rows, "g string, x double"), ["x"], ["g"])
    assert sorted(tuple(r) for r in got.select("g", "x").collect()) == [
        ("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", 3.0), ("h", 4.0), ("h", 4.0)]
