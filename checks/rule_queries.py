"""Queries on baskets, itemsets and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import stages as s
from checks.ctes import CENTRES, METRIC, RULE_ORDER, item_list
from checks.registry import query, table_folder
from shelfmark.functions import rules as fr
from shelfmark.operators import baskets as b
from shelfmark.operators import rules as r
from shelfmark.operators.lof import box_stats
from shelfmark.plans.mine import mine_all, mine_cluster
from shelfmark.sources import retail, sinks
from shelfmark.sources.star import spread, table

NUMBERS = "; ".join(f"{m}:6" for m in METRIC.values())
RULE = f"Cluster; antecedents:a<a; consequents:a<c; {NUMBERS}"
KEY = "Cluster; antecedents:a<a; consequents:a<c"

# the words of whole documents: letters only, at least two, lower case
WORDS_SQL = """SELECT lang AS "Cluster", doc_id AS "InvoiceNo", word AS item, min(place) AS first_seen
FROM (SELECT lang, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place
      FROM (SELECT lang, doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS words FROM documents))
GROUP BY 1, 2, 3"""
WORD_TABLES = {
    "worditems": WORDS_SQL,
    "wordfrequent": """SELECT "Cluster", item, count(*) AS invoices FROM worditems JOIN
  (SELECT "Cluster", count(DISTINCT "InvoiceNo") AS n FROM worditems GROUP BY 1) USING ("Cluster")
  GROUP BY "Cluster", item, n
  HAVING count(*) >= CASE WHEN n < 100 THEN 2 WHEN n < 1000 THEN 3 ELSE 5 END""",
    "wordkept": """SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY "Cluster", "InvoiceNo"
  ORDER BY first_seen, item) AS place FROM worditems i SEMI JOIN wordfrequent f
  USING ("Cluster", item)) WHERE place <= 50""",
}


def words(spark, d):
    """One row per word of a document, as lines of a basket source."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))
    documents = spread(table(spark, d, "documents").select("doc_id", "lang", "text"))
    return documents.select(
        F.col("lang").alias("Cluster"), F.col("doc_id").alias("InvoiceNo"),
        F.posexplode(found).alias("place", "word"),
    )


def word_items(spark, d):
    return b.distinct_items(words(spark, d), "word", ["Cluster"], ["place"])


# ---- joins and samples ----
@query("lines_with_cluster", "InvoiceNo; StockCode; UnitPrice:2; CustomerID; Cluster", "FROM lines")
def _(spark, d):
    return b.lines_with_cluster(s.clean(spark, d), s.segments(spark, d))


@query("drop_unclustered", "InvoiceNo; StockCode; UnitPrice:2; Cluster",
       'FROM lines WHERE "Cluster" <> 1')
def _(spark, d):
    seg = s.segments(spark, d)
    holed = seg.withColumn("Cluster", F.when(F.col("Cluster") != 1, F.col("Cluster")))
    return b.lines_with_cluster(s.clean(spark, d), holed)


@query("cluster_subset", "InvoiceNo; StockCode; UnitPrice:2; Cluster",
       'FROM lines WHERE "Cluster" IN (2, 3)')
def _(spark, d):
    return b.cluster_subset(s.clustered(spark, d), [2, 3])


@query("first_n_invoices", "Cluster; InvoiceNo; StockCode; UnitPrice:2", "FROM used")
def _(spark, d):
    return b.first_invoices(s.clustered(spark, d), ["Cluster"])


@query("semi_join_invoices", "InvoiceNo; StockCode; UnitPrice:2",
       'FROM clean SEMI JOIN (SELECT "InvoiceNo" FROM clean WHERE "UnitPrice" > 15) '
       'USING ("InvoiceNo")')
def _(spark, d):
    lines = s.clean(spark, d)
    return b.keep_invoices(lines, lines.where(F.col("UnitPrice") > 15))


@query("cluster_statistics", "Cluster; n_customers; n_transactions; n_items; avg_items_per_txn:6",
       sql="""SELECT "Cluster", (SELECT count(DISTINCT "CustomerID") FROM lines l
   WHERE l."Cluster" = u."Cluster") AS n_customers,
 count(DISTINCT "InvoiceNo") AS n_transactions, count(DISTINCT "StockCode") AS n_items,
 round(count(*) / count(DISTINCT "InvoiceNo"), 6) AS avg_items_per_txn FROM used u GROUP BY 1""")
def _(spark, d):
    return b.cluster_statistics(s.clustered(spark, d), s.used(spark, d))


# ---- baskets ----
@query("distinct_items", "Cluster; InvoiceNo; item", "FROM items")
def _(spark, d):
    return b.distinct_items(
        s.clustered(spark, d), "CategoryExtraction", ["Cluster"], ["StockCode", "UnitPrice"]
    )


@query("item_counts", "Cluster; item; invoices", "FROM wordfrequent", tables=WORD_TABLES)
def _(spark, d):
    return b.frequent_items(word_items(spark, d), ["Cluster"])


@query("semi_join_items", "Cluster; InvoiceNo; item",
       'FROM worditems SEMI JOIN wordfrequent USING ("Cluster", item)', tables=WORD_TABLES)
def _(spark, d):
    items = word_items(spark, d)
    return b.keep_items(items, b.frequent_items(items, ["Cluster"]), ["Cluster"])


@query("first_50_items", "Cluster; InvoiceNo; item", "FROM wordkept", tables=WORD_TABLES)
def _(spark, d):
    items = word_items(spark, d)
    kept = b.keep_items(items, b.frequent_items(items, ["Cluster"]), ["Cluster"])
    return b.first_items(kept, ["Cluster"])


@query("sort_items_in_basket", "InvoiceNo; items:a<list(word ORDER BY word)",
       """FROM (SELECT DISTINCT doc_id AS "InvoiceNo",
 unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents) GROUP BY 1""")
def _(spark, d):
    return words(spark, d).groupBy("InvoiceNo").agg(
        F.array_sort(F.collect_set("word")).alias("items")
    )


@query("prepare_baskets", "Cluster; InvoiceNo; items:a", "FROM baskets")
def _(spark, d):
    return b.prepare_baskets(s.clustered(spark, d))


@query("prepare_word_baskets", "Cluster; InvoiceNo; items:a<list(item ORDER BY item)",
       'FROM worditems SEMI JOIN wordfrequent USING ("Cluster", item) '
       'GROUP BY "Cluster", "InvoiceNo"', tables=WORD_TABLES)
def _(spark, d):
    return b.prepare_baskets(words(spark, d), "word", ["Cluster"], ["place"])


@query("one_hot", "Cluster; InvoiceNo; item; present<1", "FROM kept")
def _(spark, d):
    return b.one_hot(s.baskets(spark, d), ["Cluster"])


@query("distinct_clusters", "Cluster", "FROM (SELECT DISTINCT \"Cluster\" FROM rules)")
def _(spark, d):
    return b.distinct_clusters(s.rules(spark, d))


# ---- itemsets and rules ----
@query("frequent_itemsets", "Cluster; items:a; count<cnt; baskets<n; support:6<cnt / n",
       "FROM itemsets")
def _(spark, d):
    found = b.frequent_itemsets(s.baskets(spark, d), 0.03)
    return found.withColumn("support", F.col("count") / F.col("baskets"))


@query("association_rules", RULE, "FROM minedrules")
def _(spark, d):
    return r.association_rules(s.itemsets(spark, d), 0.3)


@query("rule_support_lookup", "Cluster; antecedents:a<a; antecedent_support:6; consequents:a<c; "
       "consequent_support:6; support:6", "FROM minedrules WHERE confidence >= 0.5::DOUBLE")
def _(spark, d):
    return r.association_rules(s.itemsets(spark, d), 0.5)


@query("leverage", f"{KEY}; leverage:6", "FROM minedrules")
def _(spark, d):
    mined = r.association_rules(s.itemsets(spark, d), 0.3)
    return mined.withColumn(
        "leverage",
        fr.leverage(F.col("support"), F.col("antecedent support"), F.col("consequent support")),
    )


@query("conviction", f"{KEY}; conviction:6", "FROM minedrules")
def _(spark, d):
    mined = r.association_rules(s.itemsets(spark, d), 0.3)
    return mined.withColumn(
        "conviction", fr.conviction(F.col("consequent support"), F.col("confidence"))
    )


# every seventh confidence is taken as certain, to have infinite convictions to cap
CERTAIN = "floor(confidence * 1000)::BIGINT % 7 = 0"


@query("conviction_cap", f"{KEY}; conviction:6",
       sql=f"""SELECT "Cluster", array_to_string(a, '|') AS antecedents,
 array_to_string(c, '|') AS consequents, round(coalesce(v, max(v) OVER (PARTITION BY "Cluster"), 1.0), 6)
 AS conviction FROM (SELECT *, CASE WHEN NOT ({CERTAIN}) AND NOT isinf(conviction) THEN conviction END AS v FROM minedrules)""")
def _(spark, d):
    mined = r.association_rules(s.itemsets(spark, d), 0.3)
    certain = F.floor(F.col("confidence") * 1000) % 7 == 0
    holed = mined.withColumn(
        "conviction", F.when(certain, F.lit(float("inf"))).otherwise(F.col("conviction"))
    )
    return r.cap_conviction(holed, ["Cluster"])


@query("extra_rule_metrics", f"{KEY}; representativity:6<1.0; "
       "zhangs_metric:6<leverage / greatest(support * (1 - antecedent_support), "
       "antecedent_support * (consequent_support - support)); "
       "jaccard:6<support / (antecedent_support + consequent_support - support); "
       "certainty:6<(confidence - consequent_support) / (1 - consequent_support); "
       "kulczynski:6<(support / antecedent_support + support / consequent_support) / 2",
       "FROM minedrules")
def _(spark, d):
    return r.extra_metrics(r.association_rules(s.itemsets(spark, d), 0.3))


POINT = "min_support:2; min_confidence:2"


@query("generate_rules", RULE, "FROM points WHERE min_support = 0.03::DOUBLE "
       "AND min_confidence = 0.4::DOUBLE AND lift >= 1.5::DOUBLE")
def _(spark, d):
    return r.generate_rules(s.itemsets(spark, d), 0.03, 0.4, 1.5)


@query("lift_filter", RULE, "FROM minedrules WHERE lift >= 4.5::DOUBLE")
def _(spark, d):
    return r.lift_filter(r.association_rules(s.itemsets(spark, d), 0.3), 4.5)


@query("sort_rules", RULE, f"FROM rules ORDER BY {RULE_ORDER}")
def _(spark, d):
    return r.sort_rules(s.rules(spark, d))


@query("cap_rules_5000", RULE,
       f"""FROM (SELECT *, row_number() OVER (PARTITION BY "Cluster" ORDER BY {RULE_ORDER}) AS place
 FROM minedrules) WHERE place <= 5000""")
def _(spark, d):
    return r.cap_rules(r.association_rules(s.itemsets(spark, d), 0.3), ["Cluster"], 5000)


@query("cap_rules_25", RULE,
       f"""FROM (SELECT *, row_number() OVER (PARTITION BY "Cluster" ORDER BY {RULE_ORDER}) AS place
 FROM minedrules) WHERE place <= 25""")
def _(spark, d):
    return r.cap_rules(r.association_rules(s.itemsets(spark, d), 0.3), ["Cluster"], 25)


@query("tuning_results", f"Cluster; {POINT}; min_lift:2; num_rules; avg_lift:6; avg_confidence:6; "
       "avg_leverage:6", "FROM tuning")
def _(spark, d):
    return r.tuning_results(s.points(spark, d))


@query("candidate_range", f"Cluster; {POINT}; min_lift:2; num_rules",
       "FROM tuning WHERE num_rules >= 20 AND num_rules <= 1000")
def _(spark, d):
    return r.candidate_range(r.tuning_results(s.points(spark, d)))


@query("best_params", f"Cluster; {POINT}; min_lift:2", "FROM best")
def _(spark, d):
    return r.best_params(r.tuning_results(s.points(spark, d)), s.itemsets(spark, d))


@query("tune_params", f"Cluster; {POINT}; min_lift:2", "FROM best")
def _(spark, d):
    return mine_all(s.clean(spark, d), s.segments(spark, d)).params


@query("mine_cluster", RULE, 'FROM rules WHERE "Cluster" = 3')
def _(spark, d):
    return mine_cluster(s.clean(spark, d), s.segments(spark, d), 3).rules


@query("mine_all", RULE, "FROM rules")
def _(spark, d):
    return mine_all(s.clean(spark, d), s.segments(spark, d)).rules


@query("mine_all_unsampled", RULE, "FROM rules")
def _(spark, d):
    return mine_all(s.clean(spark, d), s.segments(spark, d), sample=False).rules


@query("union_cluster_rules", RULE, "FROM rules")
def _(spark, d):
    rules = s.rules(spark, d)
    clusters = range(len(CENTRES))
    return r.union_cluster_rules([rules.where(F.col("Cluster") == k) for k in clusters])


@query("scan_rules", RULE, "FROM rules")
def _(spark, d):
    path = table_folder(spark, "rules_csv")
    sinks.write_rules(s.rules(spark, d).drop("count", "baskets").select(
        "antecedents", "consequents", *retail.RULE_METRICS, "Cluster"), path, "csv")
    return retail.scan_rules(spark, path, "csv")


@query("sink_rules", RULE, "FROM rules")
def _(spark, d):
    path = table_folder(spark, "rules")
    sinks.write_rules(s.rules(spark, d), path)
    return retail.scan_rules(spark, path)


@query("set_literal", KEY, "FROM rules")
def _(spark, d):
    as_text = s.rules(spark, d).select(
        "Cluster", *[sinks.items_as_text(c).alias(c) for c in ("antecedents", "consequents")]
    )
    return as_text.withColumns(
        {c: retail.items_from_text(F.col(c)) for c in ("antecedents", "consequents")}
    )


@query("rule_string", "Cluster; rule",
       sql=f"""SELECT "Cluster", {item_list("a")} || ' -> ' || {item_list("c")} AS rule FROM rules""")
def _(spark, d):
    return s.rules(spark, d).select(
        "Cluster", fr.rule_string(F.col("antecedents"), F.col("consequents")).alias("rule")
    )


@query("rule_id", "Cluster; rule_id", "FROM prepared")
def _(spark, d):
    return s.rules(spark, d).select(
        "Cluster",
        fr.rule_id(F.reverse("antecedents"), F.reverse("consequents")).alias("rule_id"),
    )


# ---- summaries of rules ----
@query("rules_summary",
       "Cluster; total_rules; " + "; ".join(
           f"{f}_{m}" for m, fs in (
               ("support", "mean std min max"), ("confidence", "mean std min max"),
               ("lift", "mean std min max"), ("leverage", "mean std"), ("conviction", "mean std"),
           ) for f in fs.split()),
       sql="""SELECT "Cluster", count(*) AS total_rules, """ + ", ".join(
           f"round_even({sql}({m}), 4) AS {f}_{m}" for m, fs in (
               ("support", "mean std min max"), ("confidence", "mean std min max"),
               ("lift", "mean std min max"), ("leverage", "mean std"), ("conviction", "mean std"),
           ) for f, sql in ((f, {"mean": "avg", "std": "stddev_samp"}.get(f, f)) for f in fs.split())
       ) + ' FROM rules GROUP BY 1')
def _(spark, d):
    return r.rules_summary(s.rules(spark, d))


@query("lift_by_cluster", "Cluster; avg_lift:6<avg(lift); max_lift:6<max(lift)",
       'FROM rules GROUP BY "Cluster"')
def _(spark, d):
    return r.lift_by_cluster(s.rules(spark, d))


@query("top_rules", RULE, f"FROM (SELECT * FROM rules ORDER BY {RULE_ORDER}, \"Cluster\" LIMIT 10)")
def _(spark, d):
    return s.rules(spark, d).orderBy(*r.rule_order(), "Cluster").limit(10)


@query("top_rules_per_cluster", RULE,
       f"""FROM (SELECT *, row_number() OVER (PARTITION BY "Cluster" ORDER BY {RULE_ORDER}) AS place
 FROM rules) WHERE place <= 10""")
def _(spark, d):
    return r.top_rules(s.rules(spark, d), 10, ["Cluster"])


EDGES = {"edges": f"""SELECT "Cluster", place, src, unnest(c) AS dst, lift, confidence, support
FROM (SELECT *, unnest(a) AS src FROM (SELECT *, row_number() OVER (PARTITION BY "Cluster"
 ORDER BY {RULE_ORDER}) AS place FROM rules) WHERE place <= 10)"""}


@query("rule_edges", "Cluster; src; dst; weight:6<lift; confidence:6; support:6",
       """FROM (SELECT *, row_number() OVER (PARTITION BY "Cluster", src, dst ORDER BY place DESC) AS n
 FROM edges) WHERE n = 1""", tables=EDGES)
def _(spark, d):
    return r.rule_edges(s.rules(spark, d))


@query("last_edge_wins", "Cluster; src; dst; weight:6<lift", """FROM (SELECT *, row_number() OVER (
 PARTITION BY "Cluster", src, dst ORDER BY place DESC) AS n FROM edges) WHERE n = 1""", tables=EDGES)
def _(spark, d):
    return r.rule_edges(r.top_rules(s.rules(spark, d), 10, ["Cluster"]), 10)


@query("box_stats", "Cluster; q1:6<quantile_cont(lift, 0.25); median:6<quantile_cont(lift, 0.5); "
       "q3:6<quantile_cont(lift, 0.75); iqr:6<quantile_cont(lift, 0.75) - quantile_cont(lift, 0.25)",
       'FROM rules GROUP BY "Cluster"')
def _(spark, d):
    return box_stats(s.rules(spark, d), ["Cluster"], "lift")
