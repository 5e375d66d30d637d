"""Queries behind the dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import stages as s
from checks.ctes import item_list
from checks.registry import query
from shelfmark.operators import rules as r
from shelfmark.operators import summaries as su


@query("kpi_totals", "kpi; value:2",
       sql="""SELECT 'customers' AS kpi, count(*)::DOUBLE AS value FROM seg
UNION ALL SELECT 'transactions', count(*) FROM clean
UNION ALL SELECT 'rules', count(*) FROM rules
UNION ALL SELECT 'revenue', round(sum("TotalPrice"), 2) FROM clean""")
def _(spark, d):
    return su.kpi_totals(s.clean(spark, d), s.segments(spark, d), s.rules(spark, d))


@query("daily_revenue", 'day:d<"InvoiceDate"::DATE; revenue:2<sum("TotalPrice")',
       'FROM clean WHERE "InvoiceDate" IS NOT NULL GROUP BY "InvoiceDate"::DATE')
def _(spark, d):
    return su.daily_revenue(s.clean(spark, d))


@query("cluster_counts", "Cluster; rows; share:6<rows * 100 / (SELECT count(*) FROM seg)",
       'FROM (SELECT "Cluster", count(*) AS rows FROM seg GROUP BY 1)')
def _(spark, d):
    return su.cluster_counts(s.segments(spark, d))


@query("rfm_mean_by_cluster", 'Cluster; Recency:4<avg("Recency"); Frequency:4<avg("Frequency"); '
       'Monetary:4<avg("Monetary")', 'FROM seg GROUP BY "Cluster"')
def _(spark, d):
    return su.rfm_mean_by_cluster(s.segments(spark, d))


@query("cluster_card", 'customers<count(*); avg_value:4<avg("Monetary"); '
       'avg_frequency:4<avg("Frequency")', 'FROM seg WHERE "Cluster" = 2')
def _(spark, d):
    return su.cluster_card(s.segments(spark, d), 2)


def describe_sql(table_: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count("{c}") AS count, round(avg("{c}"), 4) AS mean,
 round(stddev_samp("{c}"), 4) AS std, round(min("{c}")::DOUBLE, 4) AS min,
 round(quantile_cont("{c}", 0.25), 4) AS q25, round(quantile_cont("{c}", 0.5), 4) AS q50,
 round(quantile_cont("{c}", 0.75), 4) AS q75, round(max("{c}")::DOUBLE, 4) AS max FROM {table_}"""
        for c in columns
    )


DESCRIBED = "column; count; mean:4; std:4; min:4; q25:4; q50:4; q75:4; max:4"
LINE_COLUMNS = ["UnitPrice", "Quantity", "TotalPrice", "Hour", "Frequency", "Recency"]
SEGMENT_COLUMNS = ["Recency", "Frequency", "Monetary", "Cluster"]


@query("describe_lines", DESCRIBED, sql=describe_sql("clean", LINE_COLUMNS))
def _(spark, d):
    return su.describe(s.clean(spark, d), LINE_COLUMNS)


@query("describe_segments", DESCRIBED, sql=describe_sql("seg", SEGMENT_COLUMNS))
def _(spark, d):
    return su.describe(s.segments(spark, d), SEGMENT_COLUMNS)


@query("rule_kpis", "total_rules<count(*); avg_confidence:6<avg(confidence); avg_lift:6<avg(lift); "
       "avg_support:6<avg(support)", "FROM rules")
def _(spark, d):
    return su.rule_kpis(s.rules(spark, d))


@query("explorer_bounds", "max_lift:6<max(lift); max_support:6<max(support)", "FROM rules")
def _(spark, d):
    return su.explorer_bounds(s.rules(spark, d))


@query("rule_explorer", "Rule; Cluster; support; confidence; lift; leverage; conviction",
       sql=f"""SELECT {item_list("a")} || ' → ' || {item_list("c")} AS "Rule", "Cluster",
 {", ".join(f"round_even({m}, 4) AS {m}" for m in
            ("support", "confidence", "lift", "leverage", "conviction"))}
FROM rules WHERE "Cluster" IN (0, 1, 3) AND confidence >= 0.5::DOUBLE AND lift >= 1.5::DOUBLE
 AND support >= 0.01::DOUBLE""")
def _(spark, d):
    return su.explorer_table(su.rule_explorer(s.rules(spark, d), [0, 1, 3]))


@query("histogram_30", "Cluster; bin; left_edge:6; rows; density:6",
       sql="""SELECT "Cluster", bin, round(lo + (hi - lo) / 30 * bin, 6) AS left_edge,
 count(*) AS rows, round(count(*) / (any_value(total) * (any_value(hi) - any_value(lo)) / 30), 6) AS density
FROM (SELECT "Cluster", lo, hi, total,
  least(floor(("Monetary" - lo) / (hi - lo) * 30), 29)::INTEGER AS bin
  FROM seg JOIN (SELECT "Cluster", min("Monetary") AS lo, max("Monetary") AS hi, count(*) AS total
                 FROM seg GROUP BY 1) USING ("Cluster"))
GROUP BY "Cluster", bin, lo, hi""")
def _(spark, d):
    return su.histogram(s.segments(spark, d), "Monetary", ["Cluster"])


@query("histogram_of_lift", "bin; left_edge:6; rows; density:6",
       sql="""SELECT bin, round(lo + (hi - lo) / 30 * bin, 6) AS left_edge, count(*) AS rows,
 round(count(*) / (any_value(total) * (any_value(hi) - any_value(lo)) / 30), 6) AS density
FROM (SELECT lo, hi, total, least(floor((lift - lo) / (hi - lo) * 30), 29)::INTEGER AS bin
  FROM rules, (SELECT min(lift) AS lo, max(lift) AS hi, count(*) AS total FROM rules))
GROUP BY bin, lo, hi""")
def _(spark, d):
    return su.histogram(s.rules(spark, d), "lift")


@query("head_n", "CustomerID; Recency; Frequency; Monetary:2",
       'FROM (SELECT * FROM seg WHERE "Cluster" = 2 ORDER BY "CustomerID" LIMIT 5)')
def _(spark, d):
    mine = s.segments(spark, d).where(F.col("Cluster") == 2)
    return su.head_n(mine, ["CustomerID"], 5)


@query("top_rules_explorer", "Rule; Cluster; lift",
       sql=f"""SELECT {item_list("a")} || ' → ' || {item_list("c")} AS "Rule", "Cluster",
 round_even(lift, 4) AS lift FROM (SELECT * FROM rules WHERE confidence >= 0.5::DOUBLE
 AND lift >= 1.5::DOUBLE AND support >= 0.01::DOUBLE
 ORDER BY lift DESC, confidence DESC, support DESC, a, c, "Cluster" LIMIT 10)""")
def _(spark, d):
    found = su.rule_explorer(s.rules(spark, d)).orderBy(*r.rule_order(), "Cluster").limit(10)
    return su.explorer_table(found)
