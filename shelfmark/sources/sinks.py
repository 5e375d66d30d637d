"""Writers. Parquet is the hand-over format between jobs; CSV is there for export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.rules import quoted_items


def _write(df: DataFrame, path: str, format: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        (
            writer.option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    else:
        writer.format(format).save(path)


def write_cleaned(lines: DataFrame, path: str, format: str = "parquet") -> None:
    _write(lines, path, format)


def write_segments(
    segments: DataFrame, summary: DataFrame, path: str, summary_path: str, format: str = "parquet"
) -> None:
    _write(segments, path, format)
    _write(summary, summary_path, format)


def items_as_text(items: str):
    """``frozenset({'a', "b's"})``, as ``items_from_text`` reads it."""
    return F.concat(F.lit("frozenset({"), F.array_join(quoted_items(F.col(items)), ", "), F.lit("})"))


def write_rules(rules: DataFrame, path: str, format: str = "parquet") -> bool:
    """Write the rules unless there are none; Parquet is partitioned by Cluster so that
    a one-cluster read prunes the rest. Returns whether anything was written."""
    if rules.isEmpty():
        return False
    if format == "csv":
        rules = rules.withColumns(
            {name: items_as_text(name) for name in ("antecedents", "consequents")}
        )
        _write(rules, path, "csv")
    else:
        # one shuffle key per cluster would put a hot cluster into one task: let the
        # writers keep their partitions and only split the folders
        _write(rules, path, format, ["Cluster"])
    return True


def save_table(df: DataFrame, path: str, cluster: str = "Cluster") -> None:
    """Keep a fitted model's table (forest nodes, thresholds, importances) by cluster.

    Each save is a folder of its own, and counts from the row that names it in ``commits``,
    which is added when all of it is written: a reader never sees half a model, and goes on
    reading the one it began with.
    """
    version = uuid.uuid4().hex
    _write(df, f"{path}/versions/{version}", "parquet", [cluster])
    done = df.sparkSession.createDataFrame([(version,)], "version string")
    done.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as last saved."""
    commits = spark.read.schema("version string, at timestamp").parquet(f"{path}/commits")
    last = commits.orderBy(F.desc("at"), F.desc("version")).first()
    return spark.read.parquet(f"{path}/versions/{last['version']}")
