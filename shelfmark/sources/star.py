"""Retail invoice lines derived from the star tables ``lineitem``, ``orders``,
``customer`` and ``nation``.

The star tables hold neither missing values nor text defects, so both are derived from
their keys by plain arithmetic. The same arithmetic is written in SQL in
``checks/ctes.py``. Each order belongs to one of five themes of nine products, which
gives its basket the correlation that rule mining needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHRASES = [
    "WHITE HANGING HEART T-LIGHT HOLDER", "GIFT WRAP ROLL", "SET OF 3 CAKE TINS PANTRY DESIGN",
    "CHRISTMAS RIBBONS", "DANISH ROSES TRAY", "SET OF 2 CAKE TIN PLAIN",
    "SET OF 6 FLYING DUCKS", "SET CUTLERY PLAIN", "METAL SIGN TAKE IT OR LEAVE IT",
    "GREAT LIGHT HOLDER", "ASSORTED COLOUR BIRD ORNAMENT", "HAND WARMER UNION JACK",
    "VINTAGE BILLBOARD DRINK ME MUG", "JUMBO BAG RED RETROSPOT", "BOX OF 24 COCKTAIL PARASOLS",
    "CABBAGE", "SCENTED CANDLESTICK", "SET/20 RED RETROSPOT PAPER NAPKINS",
    "JAPAN FAN", "PAINTING SET", "OPEN SIGN",
    "VALENTINE HEARTS", "MILK JUG", "BREAKFAST IN BED SET",
    "CHILDS BREAKFAST BOWL", "RIBBON REEL", "DOORKNOB",
    "red plate", "CHRISTMAS CRAFT LITTLE FRIENDS", "VINTAGE DOILY",
    "CHRISTMAS", "LONDON BUS COFFEE", "NEW YORK MAP",
    "WICKER BOX", "GLASS GLOBE", "GLASS GLOBE 6",
    "PACK OF 72 RETROSPOT CAKE CASES", "REGENCY CAKESTAND 3 TIER", "15CM RULER",
    "old rod", "small ring", "THE SET",
    "RED", "3", "DRAWER KNOB (CERAMIC)",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of fewer splits than cores, such as one file of one row group, before
    work that is heavy per row. A scan of many splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def retail_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spread(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag",
            "l_extendedprice",
        )
    )
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # the orders meet their customers first: the lines, many more, are shuffled once
    placed = order.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    joined = line.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    # the line's own order key: what is derived from it alone can be filtered before the join
    okey, pkey, lno = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    product = (
        (okey % 5) * 9 + F.floor(F.sqrt((pkey % 81).cast("double")))
    ).cast("int")
    stock = F.lit(10000) + product * 20 + (F.col("l_suppkey") % 20).cast("int")
    cents = F.lit(45) + (stock * 79) % 1900 + F.when(lno == 6, 100).otherwise(0)
    price = F.concat(
        F.floor(cents / 100).cast("string"),
        F.when(pkey % 2 == 0, ",").otherwise("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), product + 1)
    prefix = F.when(okey % 23 == 0, "C").when(okey % 41 == 0, "A").otherwise("")
    minutes = (okey % 1440).cast("int")
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    country = (
        F.when((F.col("o_custkey") + lno) % 97 == 0, F.lit(None).cast("string"))
        .when(F.col("n_nationkey") == 24, "Unspecified")
        .when(F.col("n_nationkey") % 2 == 1, F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")))
        .otherwise(F.col("n_name"))
    )
    return joined.select(
        F.concat(prefix, F.lpad(okey.cast("string"), 12, "0")).alias("InvoiceNo"),
        stock.cast("string").alias("StockCode"),
        F.when(pkey % 89 == 0, F.lit(None).cast("string"))
        .when(lno % 5 == 0, F.concat(F.lit("  "), F.lower(phrase), F.lit(" ")))
        .otherwise(phrase).alias("Description"),
        (
            F.col("l_quantity")
            * F.when((lno == 7) & (F.col("l_returnflag") == "R"), -1).otherwise(1)
        ).cast("bigint").alias("Quantity"),
        F.when(okey % 211 == 0, "not a date")
        .otherwise(F.date_format(at, "M/d/yyyy H:mm")).alias("InvoiceDate"),
        F.when(pkey % 101 == 0, "0").otherwise(price).alias("UnitPrice"),
        F.when(okey % 7 != 0, F.col("o_custkey").cast("string")).alias("CustomerID"),
        country.alias("Country"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )
