import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.functions.numeric import round_half_even
from shelfmark.operators import cleaning as c
from shelfmark.operators import rfm as rf
from shelfmark.plans.preprocess import preprocess
from shelfmark.sources.retail import scan_raw

RAW = (
    "seq int, InvoiceNo string, StockCode string, Description string, Quantity bigint, "
    "InvoiceDate string, UnitPrice string, CustomerID string, Country string"
)


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def line(seq, invoice="1", stock="s", description="MUG", quantity=1, date="1/2/2024 10:00",
         price="1,5", customer="c", country="UK"):
    return (seq, invoice, stock, description, quantity, date, price, customer, country)


@pytest.mark.parametrize("partitions", [1, 4])
def test_merge_takes_first_present_value_in_line_order(spark, partitions):
    df = raw(spark, [
        line(3, description="LATE", country="FR"),
        line(1, description="EARLY", country=None, quantity=2),
        line(2, description="MIDDLE", country="DE", quantity=-5),
        line(4, price="1.5"),
        line(5, invoice=None),
    ]).repartition(partitions)
    got = {r["UnitPrice"]: r for r in c.merge_duplicates(df).collect()}
    assert set(got) == {"1,5", "1.5"}, "prices are grouped as text, null keys dropped"
    assert (got["1,5"]["Description"], got["1,5"]["Country"]) == ("EARLY", "DE")
    assert got["1,5"]["Quantity"] == -2


def test_country_filter_keeps_null_and_runs_before_the_trim(spark):
    rows = [line(i, invoice=str(i), country=x)
            for i, x in enumerate([None, "Unspecified", " Unspecified ", "UK"])]
    assert sorted(str(r["Country"]) for r in preprocess(raw(spark, rows)).collect()) == [
        "None", "UK", "Unspecified"]


def test_pipeline_filters_and_features(spark):
    rows = [
        line(1, invoice="C9"), line(2, invoice="A9"), line(3, invoice="7", quantity=0),
        line(4, invoice="8", price="0"), line(5, invoice="9", description=None),
        line(6, invoice="10", customer=None, date="bad", description=" blue mug "),
        line(7, invoice="11", quantity=4, date="1/1/2024 9:30"),
        line(8, invoice="12", date="1/3/2024 9:00"),
    ]
    got = {r["InvoiceNo"]: r for r in preprocess(raw(spark, rows)).collect()}
    assert set(got) == {"10", "11", "12"}
    guest = got["10"]
    assert guest["CustomerID"] == "Guest_10" and guest["Description"] == "BLUE MUG"
    assert guest["InvoiceDate"] is None and guest["Recency"] is None and guest["Hour"] is None
    eleven = got["11"]
    assert (eleven["TotalPrice"], eleven["DayOfWeek"], eleven["Hour"]) == (6.0, "Monday", 9)
    assert (eleven["Frequency"], eleven["Recency"]) == (2, 1), "47.5 hours are one whole day"


def test_empty_table(spark):
    assert preprocess(raw(spark, [])).count() == 0
    assert rf.rfm(preprocess(raw(spark, []))).count() == 0


def test_whole_days(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-01-01 10:00' a, TIMESTAMP_NTZ'2024-01-03 09:00' b")
    assert df.select(text.whole_days(F.col("a"), F.col("b"))).first()[0] == 1


def test_half_even_rounding_of_binary_values(spark):
    df = spark.createDataFrame([(0.575,), (0.125,), (2.5,)], "x double")
    assert [r[0] for r in df.select(round_half_even(F.col("x"), 2)).collect()] == [0.57, 0.12, 2.5]


def test_strip_removes_every_kind_of_white_space(spark):
    df = spark.createDataFrame([("\t  a b  \n",)], "x string")
    assert df.select(text.strip(F.col("x"))).first()[0] == "a b"


def test_scan_raw_reads_missing_tokens_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
        '536365,85123A,"WHITE, ""HANGING""",6,12/1/2010 8:26,"2,55",17850,United Kingdom\n'
        "536366,x,NA,-1,,nan,,null\n"
    )
    first, second = scan_raw(spark, str(tmp_path)).orderBy("seq").collect()
    assert first["Description"] == 'WHITE, "HANGING"' and first["UnitPrice"] == "2,55"
    assert first["CustomerID"] == "17850" and first["Quantity"] == 6
    assert [second[n] for n in ("Description", "InvoiceDate", "UnitPrice", "CustomerID", "Country")
            ] == [None] * 5


def test_scan_raw_reads_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
        '536365,1,"WHITE\nHANGING, ""BIG""",6,12/1/2010 8:26,2.55,17850,France\n536366,2,MUG,1,12/1/2010 8:27,1,1,France\n')
    got = {r["InvoiceNo"]: r["Description"] for r in scan_raw(spark, str(tmp_path), multi_line=True).collect()}
    assert got == {"536365": 'WHITE\nHANGING, "BIG"', "536366": "MUG"}


def test_guest_ids_count_from_zero_over_all_invoices(spark):
    df = spark.createDataFrame(
        [("b", None), ("a", "7"), ("c", None), ("b", None)], "InvoiceNo string, CustomerID string")
    got = {(r["InvoiceNo"], r["CustomerID"]) for r in rf.fill_guest_ids(df).collect()}
    assert got == {("b", "Guest_1"), ("a", "7"), ("c", "Guest_2")}


def test_rfm_and_guest_share(spark):
    day = dt.datetime(2024, 1, 10, 12)
    rows = [("1", "1", day, 5.0), ("1", "2", day - dt.timedelta(days=3), 2.0),
            ("Guest_3", "3", day - dt.timedelta(hours=30), 1.0), ("4", "4", None, 9.0)]
    df = spark.createDataFrame(
        rows, "CustomerID string, InvoiceNo string, InvoiceDate timestamp_ntz, TotalPrice double")
    got = {r["CustomerID"]: tuple(r)[1:] for r in rf.rfm(df).collect()}
    assert got == {"1": (1, 2, 7.0, False), "Guest_3": (2, 1, 1.0, True)}
    shares = spark.createDataFrame([(495, 3552), (925, 1954)], "g int, n int")
    assert [r[0] for r in shares.select(rf.guest_percentage(F.col("g"), F.col("n"))).collect()] == [
        13.94, 47.34]
