import itertools

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import rules as fr
from shelfmark.operators import baskets as b
from shelfmark.operators import rules as r
from shelfmark.sources import retail, sinks

INF = float("inf")


def itemsets_of(spark, baskets, support, cluster=0):
    rows = [(cluster, str(i), sorted(x)) for i, x in enumerate(baskets)]
    df = spark.createDataFrame(rows, "Cluster int, InvoiceNo string, items array<string>")
    return b.frequent_itemsets(df, support)


def test_min_occurrence_steps(spark):
    df = spark.createDataFrame([(99,), (100,), (999,), (1000,)], "n int")
    assert [x[0] for x in df.select(fr.min_occurrence(F.col("n"))).collect()] == [2, 3, 3, 5]


def test_small_example(spark):
    sets = itemsets_of(spark, ["ab", "abc", "ac", "abc"], 0.5)
    found = {"".join(x["items"]): x["count"] / x["baskets"] for x in sets.collect()}
    assert found == {"a": 1.0, "b": .75, "c": .75, "ab": .75, "ac": .75, "bc": .5, "abc": .5}
    rules = {("".join(x["antecedents"]), "".join(x["consequents"])): x
             for x in r.association_rules(sets, 0.0).collect()}
    assert len(rules) == 12, "2 per pair and 6 of the triple"
    assert rules[("b", "a")]["confidence"] == 1.0 and rules[("b", "a")]["lift"] == 1.0
    assert rules[("b", "a")]["conviction"] == INF
    assert rules[("b", "ac")]["confidence"] == pytest.approx(2 / 3)
    assert rules[("b", "ac")]["lift"] == pytest.approx(8 / 9)


def test_itemsets_match_enumeration_and_rules_keep_their_identities(spark):
    baskets = [set("abcde"[: 2 + i % 4]) | {"xyz"[i % 3]} for i in range(60)]
    sets = itemsets_of(spark, baskets, 0.1)
    want = {}
    for basket in baskets:
        for n in range(1, len(basket) + 1):
            for c in itertools.combinations(sorted(basket), n):
                want[c] = want.get(c, 0) + 1
    want = {c: n for c, n in want.items() if n >= 6}
    assert {tuple(x["items"]): x["count"] for x in sets.collect()} == want
    for x in r.association_rules(sets, 0.2).collect():
        sa, sc, s = x["antecedent support"], x["consequent support"], x["support"]
        assert s <= min(sa, sc) + 1e-12
        assert x["lift"] * sa * sc == pytest.approx(s)
        assert x["confidence"] * sa == pytest.approx(s)
        assert x["leverage"] == pytest.approx(s - sa * sc)


def test_a_set_of_25_items_is_not_split_exhaustively(spark):
    """Only the single consequents are tried: none is confident, so no longer one is."""
    whole = [f"i{n:02d}" for n in range(25)]
    rows = [(0, whole, 10, 100)] + [(0, whole[:n] + whole[n + 1:], 90, 100) for n in range(25)]
    rows += [(0, [x], 90, 100) for x in whole]
    sets = spark.createDataFrame(rows, "Cluster int, items array<string>, count long, baskets long")
    assert r.association_rules(sets, 0.3).count() == 0
    assert r.association_rules(sets, 0.1).count() == 25


def test_levels_find_what_all_splits_find(spark):
    baskets = [set("abcdefg"[: 3 + i % 5]) | {"xyz"[i % 3]} for i in range(90)]
    sets = itemsets_of(spark, baskets, 0.05).collect()
    support = {tuple(x["items"]): x["count"] for x in sets}
    table = spark.createDataFrame(sets)
    for least in (0.0, 0.55, 0.9):
        want = {
            (tuple(x for x in s if x not in c), c)
            for s in support for n in range(1, len(s)) for c in itertools.combinations(s, n)
            if support[s] / 90 / (support[tuple(x for x in s if x not in c)] / 90) >= least}
        got = [(tuple(x["antecedents"]), tuple(x["consequents"])) for x in r.association_rules(table, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("local", [1_000_000, 40, 0])
def test_groups_are_mined_together_with_their_own_least_count(spark, local):
    """The same sets whether a base is grown in a task or projected item by item."""
    groups = {
        1: [set("abcdef"[: 2 + i % 5]) | {"xyz"[i % 3]} for i in range(60)],
        2: [set("bcd") for _ in range(500)], None: [set("ab"), set("a"), set("c")], 3: [set()]}
    rows = [(g, sorted(x)) for g, baskets in groups.items() for x in baskets]
    df = spark.createDataFrame(rows, "Cluster int, items array<string>")
    got = {(x["Cluster"], tuple(x["items"])): (x["count"], x["baskets"]) for x in b.frequent_itemsets(df, 0.3, local=local).collect()}
    want = {}
    for g, baskets in groups.items():
        seen = {}
        for basket in baskets:
            for n in range(1, len(basket) + 1):
                for c in itertools.combinations(sorted(basket), n):
                    seen[c] = seen.get(c, 0) + 1
        least = -(-len(baskets) * 3 // 10)
        want |= {(g, c): (n, len(baskets)) for c, n in seen.items() if n >= least}
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert b.frequent_itemsets(df.limit(0), 0.3).count() == 0


def test_conviction_cap(spark):
    df = spark.createDataFrame(
        [(0, 2.5), (0, INF), (0, 2.0), (1, INF), (1, INF)], "Cluster int, conviction double")
    got = sorted((x["Cluster"], x["conviction"]) for x in r.cap_conviction(df, ["Cluster"]).collect())
    assert got == [(0, 2.0), (0, 2.5), (0, 2.5), (1, 1.0), (1, 1.0)]
    one = spark.createDataFrame([(.5, .8), (.4, 1.0), (.2, .6)], "c double, conf double")
    assert [x[0] for x in one.select(fr.conviction(F.col("c"), F.col("conf"))).collect()] == [
        pytest.approx(2.5), INF, pytest.approx(2.0)]


@pytest.mark.parametrize("n,rules", [(9, 0), (10, 2)])
def test_too_few_baskets_give_no_rules(spark, n, rules):
    sets = itemsets_of(spark, ["ab"] * n, 0.5)
    assert r.generate_rules(sets, 0.5, 0.5, 0.0).count() == rules


@pytest.mark.parametrize("n,kept", [(3000, 3000), (3001, 1000)])
def test_large_clusters_keep_their_first_invoices(spark, n, kept):
    df = spark.range(n).select(
        F.lit(1).alias("Cluster"), F.col("id").cast("string").alias("InvoiceNo"))
    got = b.first_invoices(df, ["Cluster"])
    assert got.count() == kept
    if kept < n:
        assert got.agg(F.max(F.col("InvoiceNo").cast("int"))).first()[0] == 999


def test_baskets_keep_first_seen_items_of_a_giant_invoice(spark):
    hot = spark.range(5000).select(
        F.lit("1").alias("InvoiceNo"), (F.col("id") % 200).cast("string").alias("item"),
        F.col("id").alias("place"))
    more = hot.where("place < 200").withColumn("InvoiceNo", F.lit("2"))
    lines = hot.unionByName(more).withColumn("Cluster", F.lit(0)).repartition(6)
    for most in (50, None):
        got = {x["InvoiceNo"]: x["items"] for x in
               b.prepare_baskets(lines, "item", order_by=["place"], max_items=most).collect()}
        assert got["1"] == got["2"] == sorted(str(i) for i in range(most or 200))


def test_items_below_the_minimum_and_empty_baskets_go(spark):
    rows = [(0, "1", "a", 1), (0, "2", "a", 1), (0, "2", "z", 2), (0, "3", "y", 1)]
    df = spark.createDataFrame(rows, "Cluster int, InvoiceNo string, item string, place int")
    got = {x["InvoiceNo"]: x["items"] for x in
           b.prepare_baskets(df, "item", order_by=["place"]).collect()}
    assert got == {"1": ["a"], "2": ["a"]}


def test_best_point_range_default_and_ties(spark):
    rows = [
        (0, .03, .3, 1.2, 50, 2.0), (0, .03, .3, 1.5, 50, 2.0 + 1e-13), (0, .05, .3, 1.2, 19, 9.0),
        (1, .03, .3, 1.2, 1001, 3.0),
    ]
    tuning = spark.createDataFrame(
        rows, "Cluster int, min_support double, min_confidence double, min_lift double, "
        "num_rules int, avg_lift double")
    clusters = spark.createDataFrame([(0,), (1,), (2,)], "Cluster int")
    got = {x["Cluster"]: tuple(x)[1:] for x in r.best_params(tuning, clusters).collect()}
    assert got == {0: (.03, .3, 1.2), 1: (.03, .3, 1.2), 2: (.03, .3, 1.2)}


def test_rule_texts(spark):
    df = spark.createDataFrame([(["b", "a"], ["c"])], "a array<string>, c array<string>")
    row = df.select(fr.rule_id(F.col("a"), F.col("c")), fr.rule_string(F.col("a"), F.col("c"), "→"))
    assert tuple(row.first()) == ("['a', 'b']->['c']", "['b', 'a'] → ['c']")


def test_set_text_is_read_not_run(spark):
    rows = [("frozenset({'b', 'a'})",), ('frozenset({"child\'s", \'mug\'})',), ("frozenset()",)]
    df = spark.createDataFrame(rows, "t string")
    assert [x[0] for x in df.select(retail.items_from_text(F.col("t"))).collect()] == [
        ["a", "b"], ["child's", "mug"], []]


def test_later_edge_wins(spark):
    rows = [(0, ["a"], ["b", "c"], .1, .5, 3.0), (0, ["a", "d"], ["b"], .2, .6, 2.0)]
    df = spark.createDataFrame(
        rows, "Cluster int, antecedents array<string>, consequents array<string>, support double, "
        "confidence double, lift double")
    got = {(x["src"], x["dst"]): x["weight"] for x in r.rule_edges(df).collect()}
    assert got == {("a", "b"): 2.0, ("a", "c"): 3.0, ("d", "b"): 2.0}


def test_rules_round_trip_and_empty_write(spark, tmp_path):
    sets = itemsets_of(spark, ["ab"] * 6 + ["bc"] * 6 + ["abc"] * 3, 0.2)
    rules = r.generate_rules(sets, 0.2, 0.2, 0.0).select(
        "antecedents", "consequents", *retail.RULE_METRICS, "Cluster")
    want = sorted(map(str, rules.collect()))
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        assert sinks.write_rules(rules, path, fmt)
        assert sorted(map(str, retail.scan_rules(spark, path, fmt).select(
            *rules.columns).collect())) == want
    assert not sinks.write_rules(rules.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_extra_metrics_guard_their_divisors(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0)], "support double, `antecedent support` double, "
                               "`consequent support` double, confidence double")
    x = r.extra_metrics(df).first()
    assert (x["zhangs_metric"], x["certainty"], x["jaccard"], x["kulczynski"]) == (0.0, 0.0, 1.0, 1.0)
