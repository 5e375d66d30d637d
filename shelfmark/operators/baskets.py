"""Invoice lines to baskets, and baskets to frequent itemsets."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions.rules import min_occurrence
from shelfmark.operators.groups import HeavyKeys, join_groups, join_uneven, stored_with_heavy
from shelfmark.operators.ordering import top_n
from shelfmark.session import stored

SAMPLE_ABOVE = 3000
SAMPLE_SIZE = 1000
MAX_ITEMS = 50
# item numbers of a conditional base that one task grows
LOCAL_CELLS = 1_000_000


def lines_with_cluster(
    lines: DataFrame, segments: DataFrame, heavy: HeavyKeys | None = None
) -> DataFrame:
    """Lines of clustered customers, with the cluster.

    Segments grow with the customers, so neither side is broadcast by hint; a customer
    with very many lines is sliced.
    """
    clusters = segments.select("CustomerID", "Cluster").where(F.col("Cluster").isNotNull())
    return join_uneven(lines, clusters, ["CustomerID"], heavy=heavy)


def cluster_subset(df: DataFrame, clusters: int | list[int]) -> DataFrame:
    wanted = clusters if isinstance(clusters, list) else [clusters]
    return df.where(F.col("Cluster").isin(wanted))


def keep_invoices(
    lines: DataFrame, invoices: DataFrame, heavy: HeavyKeys | None = None
) -> DataFrame:
    wanted = invoices.select("InvoiceNo").distinct()
    return join_uneven(lines, wanted, ["InvoiceNo"], "left_semi", heavy)


def invoice_order(invoice: str = "InvoiceNo") -> list[Column]:
    """Number order for invoice numbers kept as text: shorter first, then by text."""
    return [F.length(invoice), F.col(invoice)]


def first_invoices(
    lines: DataFrame, by: list[str], above: int = SAMPLE_ABOVE, size: int = SAMPLE_SIZE
) -> DataFrame:
    """In a group with more than ``above`` invoices keep the first ``size`` in order.

    Only the last kept invoice of each group is looked up (one row per group), so the
    lines pass through without a shuffle of their own.
    """
    invoices = lines.select(*by, "InvoiceNo").distinct()
    last_kept = (
        top_n(invoices, by, invoice_order(), size)
        .groupBy(*by)
        .agg(F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(invoice_order())])).alias("__last"))
    )
    sizes = invoices.groupBy(*by).agg(F.count(F.lit(1)).alias("__invoices"))
    cut = sizes.join(last_kept, by)
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(invoice_order())])
    return (
        join_groups(lines, cut, by)
        .where((F.col("__invoices") <= above) | (at <= F.col("__last")))
        .drop("__invoices", "__last")
    )


def cluster_statistics(lines: DataFrame, sampled: DataFrame) -> DataFrame:
    """Customers before sampling; invoices, items and lines per invoice after it."""
    customers = lines.groupBy("Cluster").agg(F.count_distinct("CustomerID").alias("n_customers"))
    invoices = sampled.groupBy("Cluster", "InvoiceNo").agg(F.count(F.lit(1)).alias("__lines"))
    per_invoice = invoices.groupBy("Cluster").agg(
        F.count(F.lit(1)).alias("n_transactions"), F.avg("__lines").alias("avg_items_per_txn")
    )
    items = sampled.groupBy("Cluster").agg(F.count_distinct("StockCode").alias("n_items"))
    return customers.join(per_invoice, "Cluster").join(items, "Cluster")


def distinct_items(
    lines: DataFrame, item: str, by: list[str], order_by: list[str], invoice: str = "InvoiceNo"
) -> DataFrame:
    """Distinct items of each invoice with the place where each is first seen.

    A single ordering column stays a plain value, which hash aggregation can update in
    place; only several of them need a struct."""
    place = F.struct(*order_by) if len(order_by) > 1 else F.col(order_by[0])
    return lines.groupBy(*by, F.col(invoice), F.col(item).alias("item")).agg(
        F.min(place).alias("first_seen")
    )


def item_counts(items: DataFrame, by: list[str]) -> DataFrame:
    """Invoices that hold each item."""
    return items.groupBy(*by, "item").agg(F.count(F.lit(1)).alias("invoices"))


def transaction_counts(items: DataFrame, by: list[str], invoice: str = "InvoiceNo") -> DataFrame:
    return items.groupBy(*by).agg(F.count_distinct(invoice).alias("transactions"))


def frequent_items(
    items: DataFrame, by: list[str], minimum: int | None = None, invoice: str = "InvoiceNo"
) -> DataFrame:
    """Items in at least ``minimum`` invoices, by default as many as the group's size asks."""
    counts = item_counts(items, by)
    if minimum is not None:
        return counts.where(F.col("invoices") >= minimum)
    sizes = transaction_counts(items, by, invoice)
    joined = join_groups(counts, sizes, by) if by else counts.withColumn("transactions", sizes.scalar())
    return joined.where(F.col("invoices") >= min_occurrence(F.col("transactions"))).drop(
        "transactions"
    )


def keep_items(
    items: DataFrame, wanted: DataFrame, by: list[str], heavy: HeavyKeys | None = None
) -> DataFrame:
    return join_uneven(items, wanted.select(*by, "item"), [*by, "item"], "left_semi", heavy)


def first_items(
    items: DataFrame, by: list[str], n: int = MAX_ITEMS, invoice: str = "InvoiceNo"
) -> DataFrame:
    """The first ``n`` items of each invoice in the order they are seen. The limit is
    applied inside the map tasks too, so a giant invoice never reaches one task whole."""
    return top_n(items, [*by, invoice], [F.col("first_seen"), F.col("item")], n)


def prepare_baskets(
    lines: DataFrame, item: str = "CategoryExtraction", by: list[str] = ["Cluster"],
    order_by: list[str] = ["StockCode", "UnitPrice"], minimum: int | None = None,
    max_items: int | None = None, invoice: str = "InvoiceNo",
) -> DataFrame:
    """One sorted item array per invoice that keeps at least one frequent item.

    Cleaned lines are grouped by (InvoiceNo, StockCode, UnitPrice), which is therefore
    the default for 'first seen'. ``max_items`` keeps that many items of a basket, by
    default all.
    """
    # counted by item and by invoice, then filtered: written once, read by column
    items, (heavy,) = stored_with_heavy(
        distinct_items(lines, item, by, order_by, invoice), [*by, "item"]
    )
    kept = keep_items(items, frequent_items(items, by, minimum, invoice), by, heavy)
    if max_items is not None:
        kept = first_items(kept, by, max_items, invoice)
    return kept.groupBy(*by, invoice).agg(F.array_sort(F.collect_list("item")).alias("items"))


def one_hot(baskets: DataFrame, by: list[str], invoice: str = "InvoiceNo") -> DataFrame:
    """The true cells of the basket × item matrix."""
    return baskets.select(*by, invoice, F.explode("items").alias("item"), F.lit(1).alias("present"))


def distinct_clusters(df: DataFrame) -> DataFrame:
    return df.select("Cluster").distinct().orderBy("Cluster")


def frequent_itemsets(
    baskets: DataFrame, min_support: float, by: str = "Cluster", local: int = LOCAL_CELLS
) -> DataFrame:
    """All itemsets with at least ``min_support`` of their group's baskets.

    One pattern-growth run for all groups, each with its own least count: items are numbered by
    falling frequency, a basket becomes its ordered numbers, and equal baskets count together. The
    conditional base of an item holds what stands before it; bases are keyed by (group, suffix) and
    so spread over the cluster. A base of at most ``local`` numbers is grown within a task, a larger
    one is projected by one more item and looked at again, so that no task holds more.
    ``(by, items, count, baskets)``, items sorted.
    """
    equal = baskets.groupBy(by, "items").agg(F.count(F.lit(1)).alias("c"))
    equal = stored(equal.withColumn("basket", F.monotonically_increasing_id()))
    sizes = equal.groupBy(by).agg(F.sum("c").alias("baskets")).withColumn(
        "least", F.ceil(F.lit(min_support) * F.col("baskets"))
    )
    cells = equal.select(by, "basket", "c", F.explode("items").alias("item"))
    counts = cells.groupBy(by, "item").agg(F.sum("c").alias("n"))
    # few: a group's frequent items are at most its mean basket size over min_support
    order = Window.partitionBy(by).orderBy(F.desc("n"), "item")
    items = stored(
        join_groups(counts, sizes, [by]).where(F.col("n") >= F.col("least"))
        .withColumn("number", F.row_number().over(order))
    )
    numbered = cells.join(items.select(by, "item", "number", "least"), [by, "item"])
    ordered = numbered.groupBy(by, "basket", "c", "least").agg(
        F.array_sort(F.collect_list("number")).alias("before")
    )
    bases = ordered.select(by, F.array().cast("array<int>").alias("suffix"), "before", "c", "least")
    found = [items.select(by, F.array("number").alias("numbers"), F.col("n").alias("count"))]
    frequent = items.select(by, F.col("number").alias("next"), "n")
    while True:
        bases = stored(_projected(bases, frequent, by))
        cells_of = bases.groupBy(by, "suffix").agg(F.sum(F.size("before")).alias("cells"))
        sized = join_groups(bases, cells_of, [by, "suffix"])
        found.append(_grown(sized.where(F.col("cells") <= local), by))
        bases = sized.where(F.col("cells") > local).drop("cells")
        if bases.isEmpty():
            break
        frequent = stored(_conditional_counts(bases, by))
        found.append(
            frequent.select(by, F.concat("suffix", F.array("next")).alias("numbers"), F.col("n").alias("count"))
        )
    sets = stored(reduce(DataFrame.unionByName, found))
    named = sets.select(by, "numbers", "count", F.explode("numbers").alias("number")).join(
        items.select(by, "number", "item"), [by, "number"]
    )
    named = named.groupBy(by, "numbers", "count").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return join_groups(named, sizes.select(by, "baskets"), [by]).select(by, "items", "count", "baskets")


def _conditional_counts(bases: DataFrame, by: str) -> DataFrame:
    """Frequent items of each base: ``(by, suffix, next, n)``."""
    seen = bases.select(by, "suffix", "c", "least", F.explode("before").alias("next"))
    counted = seen.groupBy(by, "suffix", "least", "next").agg(F.sum("c").alias("n"))
    return counted.where(F.col("n") >= F.col("least")).drop("least")


def _projected(bases: DataFrame, frequent: DataFrame, by: str) -> DataFrame:
    """The bases with a suffix longer by one frequent item; equal rows count together."""
    places = bases.select("*", F.posexplode("before").alias("place", "next"))
    on = [c for c in (by, "suffix", "next") if c in frequent.columns]
    kept = places.where("place > 0").join(frequent.select(*on), on)
    rows = kept.select(
        by, F.concat("suffix", F.array("next")).alias("suffix"),
        F.slice("before", 1, F.col("place")).alias("before"), "c", "least",
    )
    return rows.groupBy(by, "suffix", "before", "least").agg(F.sum("c").alias("c"))


def _grown(bases: DataFrame, by: str) -> DataFrame:
    """The frequent sets of each base, its suffix included: ``(by, numbers, count)``."""
    kind = bases.schema[by].dataType.simpleString()

    def grow(table: pa.Table) -> pa.Table:
        group, suffix = table.column(by)[0].as_py(), table.column("suffix")[0].as_py()
        rows = list(zip(table.column("before").to_pylist(), table.column("c").to_pylist()))
        sets = list(_growth(rows, table.column("least")[0].as_py()))
        return pa.table({
            by: pa.array([group] * len(sets), table.schema.field(by).type),
            "numbers": pa.array([suffix + list(s) for s, _ in sets], pa.list_(pa.int32())),
            "count": pa.array([n for _, n in sets], pa.int64()),
        })

    columns = bases.select(by, "suffix", "before", "c", "least")
    return columns.groupBy(by, "suffix").applyInArrow(grow, f"`{by}` {kind}, numbers array<int>, count bigint")


def _growth(rows: list, least: int, ahead: tuple = ()):
    """Sets of at least ``least`` in weighted ordered rows, each as (numbers, count)."""
    counts: Counter = Counter()
    for numbers, c in rows:
        for number in numbers:
            counts[number] += c
    frequent = {x for x, n in counts.items() if n >= least}
    kept = [([x for x in numbers if x in frequent], c) for numbers, c in rows]
    where = defaultdict(list)
    for row, (numbers, _) in enumerate(kept):
        for place, number in enumerate(numbers):
            where[number].append((row, place))
    for number in sorted(frequent):
        mine = (*ahead, number)
        yield mine, counts[number]
        base: Counter = Counter()
        for row, place in where[number]:
            if place:
                base[tuple(kept[row][0][:place])] += kept[row][1]
        if base:
            yield from _growth(list(base.items()), least, mine)
