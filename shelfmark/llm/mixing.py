"""Mix sources to target weights by Poisson replication.

Each source gets a mean repetition rate: the characters it shall have in the mixture over the
characters it has. Each document draws a number of copies by inverting the Poisson distribution
of its source's rate at a uniform number that is a hash of (seed, document id), is exploded by
it, and the copies are shuffled globally by a hash of (seed, id, copy). Everything is DataFrame
functions; only a table of one row for each source is aggregated before the documents move.

Defined cases: a null source is a source of its own; an empty or null text counts one character,
so no rate is infinite; rows that repeat an id draw the same number; a null id draws as the
empty id; an empty table gives an empty mixture; a source without a given weight gets none.
Other columns pass through, also under names that the operator uses itself: those it adds are
``copy``, ``rate`` and ``shuffle_key`` and replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialise

#: Sources whose rates are sent to all tasks: at most so many rows, of at most so many bytes each.
BROADCAST_SOURCES = 10_000
BROADCAST_KEY_BYTES = 200

#: Slices of a source's rows where the table of rates is too large to send.
SLICES = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts: 52 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """``P(X <= k)`` for k = 0, 1, ... as an array, up to where the rest is under rounding."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    grown = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])
    return F.when(rate > 0, grown).otherwise(F.array(F.lit(1.0)))


def source_rates(
    docs: DataFrame, *, weights: dict[str, float] | None = None, exponent: float = 0.5,
    target_chars: float | None = None, source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``src, rate, cdf``: one row for each source, from the sizes of all its texts. Without
    ``weights`` a source weighs its size to the power ``exponent``; without ``target_chars``
    the mixture is as large as the input."""
    chars = F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1))
    sizes = docs.groupBy(F.col(source_col).alias("src")).agg(F.sum(chars).cast("double").alias("chars"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("chars", F.lit(float(exponent))))
    else:
        given = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "src string, weight double")
        weighed = sizes.join(given, sizes["src"].eqNullSafe(given["src"]), "left").select(
            sizes["src"], "chars", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighed = materialise(weighed)
    totals = weighed.agg(F.sum("weight").alias("w"), F.sum("chars").alias("c")).first()
    target = float(target_chars if target_chars is not None else totals["c"] or 0.0)
    rate = F.lit(target) * F.col("weight") / F.lit(totals["w"] or 1.0) / F.col("chars")
    return weighed.select("src", rate.alias("rate")).withColumn("cdf", poisson_cdf(F.col("rate")))


def mix_sources(
    docs: DataFrame, *, weights: dict[str, float] | None = None, exponent: float = 0.5,
    target_chars: float | None = None, seed: int = 7, id_col: str = "doc_id",
    source_col: str = "source", text_col: str = "text", broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """The documents, each as often as drawn, in a random order that depends on ``seed`` only,
    with ``copy`` (from 1), ``rate`` (its source's) and ``shuffle_key``."""
    rates = materialise(source_rates(
        docs, weights=weights, exponent=exponent, target_chars=target_chars,
        source_col=source_col, text_col=text_col))
    size = rates.agg(F.count("*").alias("n"), F.max(F.octet_length("src")).alias("longest")).first()
    added = {"copy", "rate", "shuffle_key"}
    kept = [c for c in docs.columns if c.lower() not in added]
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    key, doc_id = F.col(f"row.`{source_col}`"), F.col(f"row.`{id_col}`")
    if size["n"] <= broadcast_sources and (size["longest"] or 0) <= BROADCAST_KEY_BYTES:
        joined = left.join(F.broadcast(rates), key.eqNullSafe(F.col("src")))
    else:
        # a source's rows are dealt to slices, and its rate goes to each of them
        left = left.withColumn("slice", F.pmod(F.xxhash64(doc_id), F.lit(SLICES)).cast("int"))
        spread = rates.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        joined = left.join(spread, key.eqNullSafe(F.col("src")) & (left["slice"] == spread["slice"]))
    drawn = uniform(F.lit(seed), doc_id)
    copies = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    out = joined.withColumn("u", drawn).withColumn("copies", copies).where(F.col("copies") > 0)
    out = out.select("row", "rate", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.coalesce(doc_id.cast("string"), F.lit("")), F.col("copy").cast("string")))
    out = out.withColumn("shuffle_key", order)
    return (
        out.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
        .select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "copy", "rate", "shuffle_key")
    )


#: DuckDB SQL of ``mix_sources(documents)`` with the query's parameters.
ORACLE = """
WITH RECURSIVE sizes AS (
  SELECT source AS src, sum(greatest(coalesce(length(text), 0), 1))::DOUBLE AS chars FROM documents GROUP BY source
), rates AS (
  SELECT src, (SELECT sum(chars) FROM sizes) * pow(chars, {exponent}) / (SELECT sum(pow(chars, {exponent})) FROM sizes) / chars AS rate FROM sizes
), poisson AS (
  SELECT src, rate, 0 AS k, -rate AS log_p, exp(-rate) AS total FROM rates
  UNION ALL
  SELECT src, rate, k + 1, log_p + ln(rate) - ln(k + 1), total + exp(log_p + ln(rate) - ln(k + 1)) FROM poisson
  WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), cdf AS (SELECT src, any_value(rate) AS rate, list(total) AS totals FROM poisson GROUP BY src),
drawn AS (
  SELECT d.*, rate, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u, totals
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.src
), counted AS (SELECT *, len(list_filter(totals, lambda t: t <= u)) AS copies FROM drawn),
exploded AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, round(rate, 6) AS rate,
  md5('{seed}/order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
FROM exploded
"""
