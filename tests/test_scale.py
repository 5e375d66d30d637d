"""What the plans look like, and that hot keys do not change results."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import baskets as b
from shelfmark.operators import cleaning as c
from shelfmark.operators import rfm as rf
from shelfmark.operators import rules as r
from shelfmark.operators import summaries as su
from shelfmark.operators.groups import hot_keys, join_uneven, stored_with_heavy
from shelfmark.session import ensure_checkpoint_dir, scratch
from shelfmark.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark):
    """One customer, one invoice and one item hold a third of all lines each."""
    n = F.col("id")
    hot = n % 3 == 0
    return spark.range(30_000).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("c"), (n % 900).cast("string"))).alias("CustomerID"),
        F.when(hot, "1").otherwise((n % 5000 + 2).cast("string")).alias("InvoiceNo"),
        (n % 700).cast("string").alias("StockCode"),
        F.when(n % 3 == 1, "mug").otherwise(F.concat(F.lit("item"), (n % 60).cast("string")))
        .alias("CategoryExtraction"),
        F.lit(1.0).alias("UnitPrice"), F.lit(2.0).alias("TotalPrice"),
        F.timestamp_add("DAY", (n % 50).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
        .alias("InvoiceDate"),
    ).repartition(12)


def test_no_cross_join_in_the_plans(spark, lines):
    customers = rf.rfm(lines).withColumn("Cluster", F.col("Frequency").cast("int") % 3)
    clustered = b.lines_with_cluster(lines, customers)
    frames = {
        "rfm": customers, "clustered": clustered, "frequency": c.customer_frequency(lines),
        "recency": c.row_recency(lines), "sample": b.first_invoices(clustered, ["Cluster"]),
        "baskets": b.prepare_baskets(clustered), "describe": su.describe(lines, ["TotalPrice"]),
        "histogram": su.histogram(lines, "TotalPrice"), "guests": rf.fill_guest_ids(lines),
    }
    crossed = [name for name, df in frames.items()
               if "CartesianProduct" in plan(df) or "BroadcastNestedLoopJoin" in plan(df)]
    assert crossed == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("sketch", [False, True])
def test_hot_keys_are_sliced(spark, lines, how, sketch):
    """No task of the join sees more than a fair share of the hot customer's lines."""
    per_key = lines.select("CustomerID").distinct().where("CustomerID <> 'c1'")
    if how != "left_semi":
        per_key = per_key.withColumn("name", F.concat(F.lit("n_"), F.col("CustomerID")))
    lines = lines.withColumn("CustomerID", F.when(F.col("StockCode") != "7", F.col("CustomerID")))
    lines, (heavy,) = stored_with_heavy(lines, ["CustomerID"])
    assert [n for _, n in heavy.slices] == [3], "a third of the lines against an eighth per partition"
    joined = join_uneven(lines, per_key, ["CustomerID"], how, heavy if sketch else None)
    want = lines.join(per_key, ["CustomerID"], how)
    assert sorted(map(str, joined.select(sorted(want.columns)).collect())) == sorted(
        map(str, want.select(sorted(want.columns)).collect()))
    slices = {x["CustomerID"]: x["__slices"] for x in hot_keys(lines, ["CustomerID"]).collect()}
    assert slices == {"hot": 3}, "a third of the lines against an eighth per partition"


def test_even_keys_are_joined_plainly(spark, lines):
    even = lines.where("CustomerID <> 'hot'")
    assert hot_keys(even, ["CustomerID"]).count() == 0


def test_building_a_join_runs_nothing(spark, lines):
    """Jobs are counted by their group: none starts before the result is asked for."""
    spark.sparkContext.setJobGroup("building", "joins")
    per_key = lines.select("CustomerID").distinct()
    for how in ("inner", "left", "left_semi"):
        join_uneven(lines, per_key, ["CustomerID"], how)
    c.customer_frequency(lines)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("building") == []
    spark.sparkContext.setJobGroup("", "")


def test_null_keys_are_dealt_and_types_may_differ(spark):
    rows = spark.range(8000).select(
        F.when(F.col("id") % 4 == 0, F.col("id").cast("int") % 5).alias("k"), "id")
    per_key = spark.createDataFrame([(0, "a"), (3, "b")], "k long, name string")
    stored, (heavy,) = stored_with_heavy(rows, ["k"])
    for known in (None, heavy):
        got = join_uneven(stored, per_key, ["k"], "left", known)
        assert got.count() == 8000 and got.where("name is not null").count() == 800
    keyed = join_uneven(stored, per_key.withColumn("k", F.col("k").cast("int")), ["k"], "left", heavy)
    spread = keyed.where("k is null").groupBy(F.spark_partition_id()).count()
    assert keyed.where("name = 'a'").count() == 400 and spread.count() >= 1

def test_results_do_not_depend_on_partitions(spark, lines):
    def outcome(df):
        customers = rf.rfm(df).withColumn("Cluster", F.lit(0))
        used = b.lines_with_cluster(df, customers)
        rules = r.association_rules(b.frequent_itemsets(b.prepare_baskets(used), 0.01), 0.1)
        return sorted(map(str, customers.collect())), sorted(map(str, rules.collect()))

    assert outcome(lines) == outcome(lines.repartition(3, "StockCode"))


def test_hot_keys_are_counted_exactly(spark, lines):
    got = {x["CustomerID"]: x["Frequency"] for x in rf.rfm(lines).collect()}
    assert got["hot"] == 1 and len(got) == 601
    counts = {x["item"]: x["invoices"] for x in b.item_counts(
        b.distinct_items(lines, "CategoryExtraction", [], ["StockCode"]), []).collect()}
    want = lines.select("InvoiceNo", "CategoryExtraction").distinct().groupBy(
        "CategoryExtraction").count().collect()
    assert counts == {x[0]: x[1] for x in want}


def test_columns_and_filters_reach_the_scan(spark, lines, tmp_path):
    path = str(tmp_path / "lines")
    lines.write.parquet(path)
    text = plan(su.daily_revenue(spark.read.parquet(path)))
    assert "ReadSchema: struct<TotalPrice:double,InvoiceDate:timestamp_ntz>" in text
    rules = lines.select(F.lit(1).alias("x"), (F.col("StockCode").cast("int") % 5).alias("Cluster"))
    rules.write.partitionBy("Cluster").parquet(str(tmp_path / "rules"))
    text = plan(b.cluster_subset(spark.read.parquet(str(tmp_path / "rules")), 3))
    assert "PartitionFilters: [isnotnull(Cluster" in text or "PartitionFilters: [Cluster" in text


def test_scratch_owns_what_a_job_stores(spark, lines):
    from pathlib import Path

    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")) / "tables"
    before = set(folder.iterdir()) if folder.exists() else set()
    with scratch(spark):
        kept, _ = stored_with_heavy(lines.limit(50), ["CustomerID"])
        assert kept.count() == 50 and len(set(folder.iterdir()) - before) == 1
    assert set(folder.iterdir()) == before


def test_a_model_counts_when_it_is_committed(spark, tmp_path):
    """A version that was begun and never committed is not read, nor does it disturb."""
    path = str(tmp_path / "model")
    model = spark.createDataFrame([(1, "a"), (2, "b")], "Cluster int, name string")
    sinks.save_table(model, path)
    first = sinks.load_table(spark, path)
    model.limit(1).write.parquet(f"{path}/versions/half")
    assert sinks.load_table(spark, path).count() == 2
    sinks.save_table(model.withColumn("name", F.lit("new")), path)
    assert {r["name"] for r in sinks.load_table(spark, path).collect()} == {"new"}
    assert {r["name"] for r in first.collect()} == {"a", "b"}


def test_categories_of_texts_need_no_limit(spark):
    lines = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "RED MUG").when(
        F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("ITEM SIGN "), F.col("id"))).alias("Description"), "id")
    got = c.with_category_of_texts(lines)
    want = c.with_category(lines)
    assert sorted(map(str, got.select("id", "CategoryExtraction").collect())) == sorted(
        map(str, want.select("id", "CategoryExtraction").collect()))


def test_checkpoint_folder_comes_from_the_session(spark):
    ensure_checkpoint_dir(spark)
    first = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert first and spark.sparkContext.getCheckpointDir() == first
