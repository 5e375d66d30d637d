"""How the forest's flags react to the contamination rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.operators.groups import join_groups
from shelfmark.operators.iforest import score_thresholds

# The rates tried.
RATES = [0.01, 0.03, 0.05, 0.07, 0.1]


def flags_at_rates(
    scored: DataFrame, rates: Sequence[float] = RATES, by: str = "Cluster",
    row_id: str = "rule_id", score: str = "iforest_score",
) -> DataFrame:
    """``(by, id, rate, threshold, flag)``: 1 where the score is not above the threshold."""
    thresholds = score_thresholds(scored, rates, by, score)
    return join_groups(scored.select(by, row_id, score), thresholds, [by]).select(
        by, row_id, "rate", "threshold",
        (F.col(score) <= F.col("threshold")).cast("int").alias("flag"),
    )


def contamination_analysis(flags: DataFrame, by: str = "Cluster") -> DataFrame:
    return flags.groupBy(by, "rate").agg(
        F.max("threshold").alias("threshold"), F.sum("flag").alias("anomalies")
    )


def jaccard_of_neighbours(
    flags: DataFrame, by: str = "Cluster", row_id: str = "rule_id", step: str = "rate"
) -> DataFrame:
    """Overlap of the flagged sets at each rate and the next; 1.0 for two empty sets."""
    # one window partition holds one row's flags: as many as there are rates
    along = Window.partitionBy(by, row_id).orderBy(step)
    pairs = flags.withColumns(
        {"next": F.lead(step).over(along), "next_flag": F.lead("flag").over(along)}
    ).where(F.col("next").isNotNull())
    both = F.sum(F.col("flag") * F.col("next_flag"))
    either = F.sum(F.greatest("flag", "next_flag"))
    return pairs.groupBy(by, step, "next").agg(
        F.when(either > 0, both / either).otherwise(F.lit(1.0)).alias("jaccard")
    )
