"""Queries on raw and cleaned lines, customers and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import stages as s
from checks.ctes import category_case, normalise
from checks.registry import query, table_folder
from shelfmark.functions import text
from shelfmark.functions.categories import with_category
from shelfmark.functions.numeric import infinite_to_null
from shelfmark.functions.rules import min_occurrence
from shelfmark.operators import cleaning as c
from shelfmark.operators import rfm as rf
from shelfmark.operators import scaling
from shelfmark.operators.ordering import average_rank
from shelfmark.sources import retail, sinks
from shelfmark.sources.star import retail_raw, table

RAW = "InvoiceNo; StockCode; Description; Quantity; InvoiceDate; UnitPrice; CustomerID; Country"
CLEAN = (
    "InvoiceNo; StockCode; UnitPrice:2; Quantity; InvoiceDate:t; CustomerID; Country; Description; "
    "CategoryExtraction; TotalPrice:2; DayOfWeek; Hour:0; Frequency; Recency:0"
)
MERGED = "InvoiceNo; StockCode; UnitPrice; Quantity; InvoiceDate; CustomerID; Country; Description"


def raw_lines(spark, d):
    return retail_raw(spark, d)


def identified(spark, d):
    return c.guest_id(c.drop_missing_description(raw_lines(spark, d)))


def typed(spark, d):
    return c.parse_invoice_date(c.cast_types(c.merge_duplicates(identified(spark, d))))


TYPED = """(SELECT *, replace("UnitPrice", ',', '.')::DOUBLE AS price,
 try_strptime("InvoiceDate", '%m/%d/%Y %H:%M') AS ts FROM merged)"""
TYPED_COLUMNS = (
    "InvoiceNo; StockCode; UnitPrice:2<price; Quantity; InvoiceDate:t<ts; CustomerID; Country; "
    "Description"
)


# ---- sources and sinks ----
@query("scan_raw", RAW, "FROM raw")
def _(spark, d):
    path = table_folder(spark, "raw_csv")
    lines = raw_lines(spark, d).select(*retail.RAW_COLUMNS)
    sinks._write(lines, path, "csv")
    return retail.scan_raw(spark, path)


@query("scan_cleaned", CLEAN, "FROM clean")
def _(spark, d):
    path = table_folder(spark, "cleaned")
    sinks.write_cleaned(s.clean(spark, d), path)
    return retail.scan_cleaned(spark, path)


@query("sink_cleaned", CLEAN, "FROM clean")
def _(spark, d):
    path = table_folder(spark, "cleaned_csv")
    sinks.write_cleaned(s.clean(spark, d), path, "csv")
    return retail.scan_cleaned(spark, path, "csv")


@query("scan_segments", "CustomerID; Cluster", "FROM seg")
def _(spark, d):
    path = table_folder(spark, "segments")
    sinks._write(s.segments(spark, d), path, "parquet")
    return retail.scan_segments(spark, path)


SUMMARY = (
    "Cluster_Name; Recency_mean; Recency_median; Frequency_mean; Frequency_median; Monetary_mean; "
    "Monetary_median; IsGuest_count; IsGuest_sum; Guest_Percentage"
)
SUMMARY_SQL = """SELECT "Cluster_Name", """ + ", ".join(
    f'round_even({f}("{m}"), 2) AS "{m}_{name}"'
    for m in rf.RFM for f, name in (("avg", "mean"), ("median", "median"))
) + """, count("IsGuest") AS "IsGuest_count", sum("IsGuest"::INTEGER)::BIGINT AS "IsGuest_sum",
 round_even(sum("IsGuest"::INTEGER) / count("IsGuest") * 100, 2) AS "Guest_Percentage"
FROM seg GROUP BY 1"""


@query("scan_summary", SUMMARY, sql=SUMMARY_SQL)
def _(spark, d):
    path = table_folder(spark, "summary_csv")
    sinks._write(rf.segment_summary(s.segments(spark, d)), path, "csv")
    return retail.scan_summary(spark, path)


@query("sink_segments", "CustomerID; Recency; Frequency; Monetary:2; IsGuest; Cluster; Cluster_Name",
       "FROM seg")
def _(spark, d):
    path, summary_path = table_folder(spark, "segments_out"), table_folder(spark, "summary_out")
    segments = s.segments(spark, d)
    sinks.write_segments(segments, rf.segment_summary(segments), path, summary_path)
    return spark.read.parquet(path)


# ---- projections and filters ----
@query("drop_missing_description", RAW, 'FROM raw WHERE "Description" IS NOT NULL')
def _(spark, d):
    return c.drop_missing_description(raw_lines(spark, d))


@query("customer_type", "InvoiceNo; StockCode; CustomerID; CustomerType",
       sql="""SELECT "InvoiceNo", "StockCode", "CustomerID",
 CASE WHEN "CustomerID" IS NULL THEN 'Guest' ELSE 'Registered' END AS "CustomerType" FROM raw""")
def _(spark, d):
    return c.customer_type(raw_lines(spark, d))


@query("guest_id", "InvoiceNo; StockCode; CustomerID",
       """FROM (SELECT * REPLACE (coalesce("CustomerID", 'Guest_' || "InvoiceNo") AS "CustomerID")
 FROM raw)""")
def _(spark, d):
    return c.guest_id(raw_lines(spark, d))


@query("cast_types", "InvoiceNo; StockCode; CustomerID; UnitPrice:2<replace(\"UnitPrice\", ',', '.')",
       "FROM raw")
def _(spark, d):
    return c.cast_types(raw_lines(spark, d))


@query("parse_timestamp",
       "InvoiceNo; InvoiceDate:t<try_strptime(\"InvoiceDate\", '%m/%d/%Y %H:%M')", "FROM raw")
def _(spark, d):
    return c.parse_invoice_date(raw_lines(spark, d))


@query("filter_country", RAW, """FROM raw WHERE "Country" <> 'Unspecified' OR "Country" IS NULL""")
def _(spark, d):
    return c.filter_country(raw_lines(spark, d))


@query("filter_cancelled", RAW, """FROM raw WHERE left("InvoiceNo", 1) NOT IN ('C', 'A')""")
def _(spark, d):
    return c.filter_cancelled(raw_lines(spark, d))


@query("filter_positive", TYPED_COLUMNS, f'FROM {TYPED} WHERE "Quantity" > 0 AND price > 0')
def _(spark, d):
    return c.filter_positive(typed(spark, d))


@query("total_price", "InvoiceNo; StockCode; UnitPrice:2<price; TotalPrice:2<\"Quantity\" * price",
       f"FROM {TYPED}")
def _(spark, d):
    return c.total_price(typed(spark, d))


@query("is_guest", "InvoiceNo; CustomerID; IsGuest<\"CustomerID\" IS NULL OR "
       "starts_with(\"CustomerID\", 'Guest_')", "FROM (SELECT * FROM raw UNION ALL "
       "SELECT * FROM identified)")
def _(spark, d):
    both = raw_lines(spark, d).unionByName(identified(spark, d))
    return both.withColumn("IsGuest", rf.is_guest(F.col("CustomerID")))


@query("rfm_dropna", "CustomerID; Recency; Frequency; Monetary:2", "FROM rfm")
def _(spark, d):
    return rf.rfm(s.clean(spark, d))


@query("cluster_name", "CustomerID; Cluster_Name<CASE \"Cluster\" WHEN 0 THEN 'Casual Buyers' "
       "WHEN 1 THEN 'Inactive Customers' WHEN 2 THEN 'Loyal High-Value Customers' "
       "WHEN 3 THEN 'VIP/Wholesale Customers' WHEN 4 THEN 'Frequent Mid-to-High Value Customers' "
       "ELSE 'Cluster_' || \"Cluster\" END",
       'FROM (SELECT "CustomerID", "Cluster" + 2 AS "Cluster" FROM seg)')
def _(spark, d):
    shifted = s.segments(spark, d).withColumn("Cluster", F.col("Cluster") + 2)
    return shifted.withColumn("Cluster_Name", rf.cluster_name(F.col("Cluster")))


# ---- aggregates and windows on lines ----
@query("merge_duplicates", MERGED, "FROM merged")
def _(spark, d):
    return c.merge_duplicates(identified(spark, d))


@query("rfm", "CustomerID; Recency; Frequency; Monetary:2; IsGuest", "FROM rfm")
def _(spark, d):
    return rf.rfm(s.clean(spark, d))


@query("segment_summary", SUMMARY, sql=SUMMARY_SQL)
def _(spark, d):
    return rf.segment_summary(s.segments(spark, d))


@query("guest_percentage", "Cluster; share",
       sql="""SELECT "Cluster", round_even(sum("IsGuest"::INTEGER) / count(*) * 100, 2) AS share
FROM seg GROUP BY 1""")
def _(spark, d):
    return s.segments(spark, d).groupBy("Cluster").agg(
        rf.guest_percentage(F.sum(F.col("IsGuest").cast("int")), F.count("*")).alias("share")
    )


@query("customer_frequency", "InvoiceNo; StockCode; UnitPrice:2; CustomerID; Frequency", "FROM clean")
def _(spark, d):
    return c.customer_frequency(s.clean(spark, d).drop("Frequency"))


@query("row_recency", "InvoiceNo; StockCode; UnitPrice:2; Recency:0", "FROM clean")
def _(spark, d):
    return c.row_recency(s.clean(spark, d).drop("Recency"))


@query("guest_ngroup", "InvoiceNo; CustomerID",
       sql="""SELECT DISTINCT "InvoiceNo", coalesce("CustomerID",
 'Guest_' || (dense_rank() OVER (ORDER BY "InvoiceNo") - 1)) AS "CustomerID" FROM raw""")
def _(spark, d):
    return rf.fill_guest_ids(raw_lines(spark, d)).select("InvoiceNo", "CustomerID").distinct()


# ---- scalar functions ----
@query("normalize_text", "InvoiceNo; StockCode; Description<upper(trim(\"Description\")); "
       "Country<trim(\"Country\")", "FROM raw")
def _(spark, d):
    return c.normalise_text(raw_lines(spark, d))


@query("category_extraction", "InvoiceNo; StockCode; Description; CategoryExtraction",
       sql=f"""SELECT "InvoiceNo", "StockCode", "Description",
 {category_case("n")} AS "CategoryExtraction"
FROM (SELECT *, {normalise('"Description"')} AS n FROM raw)""")
def _(spark, d):
    return with_category(raw_lines(spark, d))


@query("category_of_part_names", "p_partkey; p_name; category",
       sql=f"""SELECT p_partkey, p_name, {category_case("n")} AS category
FROM (SELECT *, {normalise("p_name")} AS n FROM part)""")
def _(spark, d):
    return with_category(table(spark, d, "part"), "p_name", "category")


@query("time_features", "InvoiceNo; StockCode; UnitPrice:2; DayOfWeek; Hour:0", "FROM clean")
def _(spark, d):
    return c.time_features(s.clean(spark, d).drop("DayOfWeek", "Hour"))


@query("whole_days", "event_id; days",
       sql="""SELECT event_id, date_sub('day', ts, (SELECT max(ts) FROM events))::INTEGER AS days
FROM events""")
def _(spark, d):
    events = table(spark, d, "events")
    latest = events.agg(F.max("ts")).scalar()
    return events.select("event_id", text.whole_days(F.col("ts"), latest).alias("days"))


@query("format_ts", "event_id; text",
       sql="SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", text.format_timestamp(F.col("ts")).alias("text")
    )


@query("to_date", "event_id; day:d<ts::DATE", "FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))


@query("min_occurrence", "user_id; n; least",
       sql="""SELECT user_id, count(*) * 7 AS n,
 CASE WHEN count(*) * 7 < 100 THEN 2 WHEN count(*) * 7 < 1000 THEN 3 ELSE 5 END AS least
FROM events GROUP BY 1""")
def _(spark, d):
    counts = table(spark, d, "events").groupBy("user_id").agg((F.count("*") * 7).alias("n"))
    return counts.withColumn("least", min_occurrence(F.col("n")))


@query("null_to_unknown", "InvoiceNo; StockCode; Description<coalesce(\"Description\", 'unknown')",
       "FROM raw")
def _(spark, d):
    return raw_lines(spark, d).withColumn("Description", text.null_to_unknown(F.col("Description")))


@query("inf_to_null", "event_id; value:4",
       sql="""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE round(value, 4) END AS value
FROM events""")
def _(spark, d):
    events = table(spark, d, "events")
    broken = F.when(
        F.col("event_type") == "error", F.lit(float("inf")) * F.signum(F.col("value") - 10)
    ).otherwise(F.col("value"))
    broken = F.when(F.isnan(broken), F.lit(float("-inf"))).otherwise(broken)
    return events.select("event_id", infinite_to_null(broken).alias("value"))


@query("rename_flatten", "Cluster; mean_Recency:4; median_Recency:4; Recency_mean:4",
       sql="""SELECT "Cluster", round(avg("Recency"), 4) AS "mean_Recency",
 round(median("Recency"), 4) AS "median_Recency", round(avg("Recency"), 4) AS "Recency_mean"
FROM seg GROUP BY 1""")
def _(spark, d):
    seg = s.segments(spark, d)
    from shelfmark.operators.ordering import medians

    middle = medians(seg, ["Cluster"], ["Recency"]).withColumnRenamed("Recency", "median_Recency")
    return seg.groupBy("Cluster").agg(
        F.avg("Recency").alias("mean_Recency"), F.avg("Recency").alias("Recency_mean")
    ).join(middle, "Cluster")


@query("round_cols", "event_id; two; four",
       sql="""SELECT event_id, round_even(value / 8, 2) AS two, round_even(value / 16, 4) AS four
FROM events""")
def _(spark, d):
    from shelfmark.functions.numeric import round_half_even

    return table(spark, d, "events").select(
        "event_id", round_half_even(F.col("value") / 8, 2).alias("two"),
        round_half_even(F.col("value") / 16, 4).alias("four"),
    )


# ---- scaling and ranks ----
@query("standard_scale", "CustomerID; Recency_scaled:6<recency_z; Frequency_scaled:6<frequency_z; "
       "Monetary_scaled:6<monetary_z", "FROM scaled")
def _(spark, d):
    return scaling.standard_scale(s.customers(spark, d), rf.RFM)


DIMS = range(64)


@query("standard_scale_embeddings", "; ".join(["vec_id", *[f"e{i}_scaled:6" for i in DIMS]]),
       sql="SELECT vec_id, " + ", ".join(
           f"round((e[{i + 1}]::DOUBLE - avg(e[{i + 1}]::DOUBLE) OVER ()) / "
           f"stddev_pop(e[{i + 1}]::DOUBLE) OVER (), 6) AS e{i}_scaled" for i in DIMS
       ) + " FROM (SELECT vec_id, embedding AS e FROM embeddings)")
def _(spark, d):
    wide = table(spark, d, "embeddings").select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in DIMS]
    )
    return scaling.standard_scale(wide, [f"e{i}" for i in DIMS])


@query("median_impute", "CustomerID; Monetary:4",
       sql="""SELECT "CustomerID", round(coalesce(m, median(m) OVER (PARTITION BY "Cluster")), 4)
 AS "Monetary"
FROM (SELECT *, CASE WHEN "Recency" % 3 <> 0 THEN "Monetary" END AS m FROM seg)""")
def _(spark, d):
    holed = s.segments(spark, d).withColumn(
        "Monetary", F.when(F.col("Recency") % 3 != 0, F.col("Monetary"))
    )
    return scaling.median_impute(holed, ["Monetary"], ["Cluster"])


@query("spearman", "Cluster; rho:6",
       sql="""SELECT "Cluster", round(corr(a, b), 6) AS rho FROM (
 SELECT "Cluster",
  rank() OVER (PARTITION BY "Cluster" ORDER BY "Recency")
   + (count(*) OVER (PARTITION BY "Cluster", "Recency") - 1) / 2 AS a,
  rank() OVER (PARTITION BY "Cluster" ORDER BY "Frequency")
   + (count(*) OVER (PARTITION BY "Cluster", "Frequency") - 1) / 2 AS b
 FROM seg) GROUP BY 1""")
def _(spark, d):
    ranked = average_rank(s.segments(spark, d), ["Cluster"], "Recency", "a")
    ranked = average_rank(ranked, ["Cluster"], "Frequency", "b")
    return ranked.groupBy("Cluster").agg(F.corr("a", "b").alias("rho"))


# ---- whole jobs ----
@query("preprocess_data", CLEAN, "FROM clean")
def _(spark, d):
    from shelfmark.plans.preprocess import preprocess

    return preprocess(raw_lines(spark, d))
