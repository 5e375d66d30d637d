"""What queries leave on the disks of a cluster while they run."""

import os
import time

from pyspark.sql import functions as F

from shelfmark.operators import cleaning as c
from shelfmark.session import DROP_SHUFFLES, materialise, stored


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {
        f for folder in folders for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")
    }


def test_written_tables_keep_no_shuffle_files(spark):
    df = spark.range(20_000).groupBy((F.col("id") % 7_001).alias("k")).agg(F.sum("id").alias("s"))
    for write in (stored, materialise):
        before = shuffle_files(spark)
        out = write(df)
        for _ in range(50):  # files go a moment later
            if shuffle_files(spark) <= before:
                break
            time.sleep(0.2)
        assert shuffle_files(spark) <= before
        assert out.count() == 7_001 and out.agg(F.sum("s")).first()[0] == sum(range(20_000))
    assert spark.conf.get(DROP_SHUFFLES, "false") == "false"
    assert df.agg(F.sum("s")).first()[0] == sum(range(20_000))


def test_merged_lines_take_the_first_value_of_each_column(spark):
    """Lines with gaps before, between and after lines without."""
    rows = [
        ("1", "s", "2", 1, None, "a", None, None, 1),
        ("1", "s", "2", 2, "d2", "b", "c2", "x2", 2),
        ("1", "s", "2", 4, "d3", None, "c3", "x3", 3),
        ("2", "s", "2", 1, None, None, None, None, 1),
        ("2", "s", "2", 2, "d", None, None, "y2", 3),
        ("2", "s", "2", 2, None, "e", None, "y1", 2),
        ("3", "s", "2", 5, "d", "f", "c", "z", None),
    ]
    df = spark.createDataFrame(
        rows, "InvoiceNo string, StockCode string, UnitPrice string, Quantity int, InvoiceDate string, "
        "CustomerID string, Country string, Description string, seq int",
    )
    got = {r["InvoiceNo"]: tuple(r)[3:] for r in c.merge_duplicates(df).collect()}
    assert got == {
        "1": (7, "d2", "a", "c2", "x2"), "2": (5, "d", "e", None, "y1"), "3": (5, None, None, None, None),
    }


def test_neighbours_are_written_by_column(spark, monkeypatch):
    """They are k rows per point and more, the largest tables of the factors."""
    from shelfmark.operators import lof

    written, write = [], lof.stored
    monkeypatch.setattr(lof, "stored", lambda df: written.append(df.columns) or write(df))
    rows = spark.createDataFrame([(0, f"r{i}", float(i * i)) for i in range(40)], "Cluster int, rule_id string, x double")
    assert lof.lof(rows, ["x"], 3).where("lof_score < 0").count() == 40
    assert any("near" in columns and "d" in columns for columns in written)
