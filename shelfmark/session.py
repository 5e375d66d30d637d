"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the jobs are written for. All are runtime settings except the first two
#: of a cluster's own (memory, cores), which stay with whoever submits the job.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a single-machine session without that setting gets a folder of its own; a
    cluster without it is an error, since a machine-local folder dies with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


_OWNERS: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owns the tables that ``stored`` writes inside, and deletes them at the end. Write what
    is wanted of a job before leaving: its frames read those tables.

    Checkpoints go by themselves with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    _OWNERS.append([])
    try:
        yield
    finally:
        for path in _OWNERS.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A query planned inside drops its shuffle files when it ends. Spark otherwise keeps them
    until the driver happens to collect its garbage, those of one table beside those of the next;
    a written table needs them no longer."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and read it from there.

    For large frames that several passes read: each pass reads only its columns, and the
    optimiser knows the table's size. The table stays unless a ``scratch`` owns it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    folder = df.sparkSession.sparkContext.getCheckpointDir()
    path = f"{folder}/tables/stored-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append(path)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` and go on from the written copy, partitions as they are.

    For smaller frames that several jobs read: no recomputation, and the copy outlives the
    executors that wrote it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, with the setting
