"""Registration of queries with their oracles, and the tables that queries share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.ctes import with_tables
from shelfmark.session import ensure_checkpoint_dir, materialise, stored

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SPEC = re.compile(r"^(?P<out>[^:<]+)(?::(?P<kind>\w+))?(?:<(?P<src>.+))?$")


def _parts(spec: str) -> list[tuple[str, str, str]]:
    """``out[:kind][<source]``; kinds: digits to round to, a(rray), t(ime), d(ate)."""
    found = []
    for item in spec.split(";"):
        m = _SPEC.match(item.strip())
        found.append((m["out"].strip(), m["kind"] or "", (m["src"] or "").strip()))
    return found


def spark_columns(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind, _ in _parts(spec):
        spaced = name.replace("_", " ")
        col = F.col(f"`{name}`") if name in df.columns else F.col(f"`{spaced}`")
        if name not in df.columns and spaced not in df.columns:
            col = F.col(f"`{name.replace('_', ' ', 1)}`")
        if kind.isdigit():
            col = F.round(col.cast("double"), int(kind))
        elif kind == "a":
            col = F.array_join(col, "|")
        elif kind == "t":
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif kind == "d":
            col = F.date_format(col, "yyyy-MM-dd")
        out.append(col.alias(name))
    return df.select(*out)


def sql_columns(spec: str) -> str:
    out = []
    for name, kind, src in _parts(spec):
        src = src or f'"{name}"'
        if kind.isdigit():
            r = f"round(({src})::DOUBLE, {kind})"
            src = f"CASE WHEN {r} = 0 THEN 0::DOUBLE ELSE {r} END"
        elif kind == "a":
            src = f"array_to_string({src}, '|')"
        elif kind == "t":
            src = f"strftime({src}, '%Y-%m-%d %H:%M:%S')"
        elif kind == "d":
            src = f"strftime({src}, '%Y-%m-%d')"
        out.append(f'{src} AS "{name}"')
    return ", ".join(out)


def query(
    name: str, spec: str | None = None, tail: str | None = None, sql: str | None = None,
    tables: dict[str, str] | None = None,
):
    """Register a query. With ``spec`` the result's columns are picked and rounded alike in
    Spark and in the oracle, which is ``SELECT spec`` + ``tail``; ``sql`` is a whole oracle."""
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            return spark_columns(df, spec) if spec else df

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql, tables)
        elif tail is not None:
            ORACLES[name] = with_tables(f"SELECT {sql_columns(spec)} {tail}", tables)
        return build

    return register


_STAGES: dict[tuple[str, str, str], object] = {}


LARGE = {"clean", "customers", "scaled", "segments", "clustered", "used", "baskets"}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """What ``build`` returns, called once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = build()
    return _STAGES[key]


def stage(build: Query) -> Query:
    """A job's output table: written once per session and input folder, then read, as the
    jobs hand their results on. Tables that grow with the lines are stored by column."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        write = stored if build.__name__ in LARGE else materialise
        return once(spark, sf_dir, build.__name__, lambda: write(build(spark, sf_dir)))

    run.__name__ = build.__name__
    return run


def forget_stages() -> None:
    _STAGES.clear()


def table_folder(spark: SparkSession, name: str) -> str:
    """A folder for written tables, beside the checkpoints all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{name}"
