from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quayline.functions import dates, money, text
from quayline.sources.tables import days_as_dates


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(
    "line, words",
    [
        ("hello world", ["hello", "world"]),
        ("a  b", ["a", "", "b"]),
        (" a", ["", "a"]),
        ("a   ", ["a"]),
        ("", [""]),
        ("   ", []),
        ("tab\there", ["tab\there"]),
        ("a \n", ["a", "\n"]),
    ],
)
def test_words(spark, line, words):
    assert one(spark.createDataFrame([(line,)], "t STRING").select(text.words_of("t"))) == words


def test_null_line_has_no_words(spark):
    df = spark.createDataFrame([(None,)], "t STRING")
    assert df.select(F.explode(text.words_of("t"))).count() == 0


@pytest.mark.parametrize("kind", ["DOUBLE", "DECIMAL(15,2)"])
def test_line_revenue_is_exact(spark, kind):
    rows = [("0.01", "0.00"), ("1234567.89", "0.07"), ("9999999999999.99", "0.10"), ("0.29", "0.57")]
    df = spark.createDataFrame(rows, "p STRING, d STRING").select(
        "p", "d", F.col("p").cast(kind).alias("price"), F.col("d").cast(kind).alias("discount")
    )
    for row in df.select("p", "d", money.line_revenue("price", "discount").alias("r")).collect():
        assert row.r == Decimal(row.p) * (1 - Decimal(row.d))


def test_sum_beyond_bigint(spark):
    # 400 lines of 9.2e16 units add up to more than a BIGINT holds
    df = spark.range(400).select(F.lit(9_200_000_000_000_000_0).cast("bigint").alias("u"), "id")
    signed = F.when(F.col("id") % 40 == 0, -F.col("u") + F.lit(7)).otherwise(F.col("u"))
    expected = Decimal((390 - 10) * 92_000_000_000_000_000 + 70) / 10_000
    assert one(df.agg(money.sum_units(signed))) == expected


def test_sum_of_negative_units(spark):
    df = spark.createDataFrame([(-1,), (-99_999,), (5,)], "u BIGINT")
    assert one(df.agg(money.sum_units(F.col("u")))) == Decimal("-9.9995")


@pytest.mark.parametrize(
    "units, rounded", [(149, 100), (150, 200), (-149, -100), (-150, -200), (0, 0), (-50, -100)]
)
def test_round_units(spark, units, rounded):
    df = spark.createDataFrame([(units,)], "u BIGINT")
    assert one(df.select(money.round_units(F.col("u")))) == rounded
    as_amount = money.to_cents(money.units_to_amount(F.col("u")))
    assert one(df.select(as_amount)) == Decimal(rounded) / 10_000


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_days_survive_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT DATE '1995-03-15' AS d").select(
            "d", dates.day_to_event_time("d").alias("ts")
        )
        window = df.groupBy("d", F.window("ts", "1 day").alias("w")).count()
        back = window.select(dates.iso_text("d"), dates.iso_text(dates.event_time_to_day("w.start")))
        assert tuple(back.first()) == ("1995-03-15", "1995-03-15")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_month_start(spark):
    df = spark.sql("SELECT DATE '1995-03-01' AS a, DATE '1995-12-02' AS b").select(
        dates.iso_text(dates.month_start_on_or_after(F.col("a"))),
        dates.iso_text(dates.month_start_on_or_after(F.col("b"))),
    )
    assert tuple(df.first()) == ("1995-03-01", "1996-01-01")


def test_rank_line(spark):
    df = spark.sql("SELECT 1L AS r, 42L AS k, 1234.565BD AS v, DATE '1995-01-02' AS d")
    line = one(df.select(text.rank_line("r", "k", "v", "d")))
    assert line == "Rank  1 | orderKey:       42 | Revenue:    1234.57 | orderDate: 1995-01-02"


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Tokyo"])
def test_timestamps_become_their_utc_day(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        stamps = spark.sql("SELECT timestamp_seconds(1577923200) AS a, timestamp_seconds(1577923199) AS b, TIMESTAMP_NTZ'2020-01-02 23:59:59' AS c")
        row = days_as_dates(stamps).first()
        assert [str(d) for d in row] == ["2020-01-02", "2020-01-01", "2020-01-02"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_more_than_two_decimals_round_as_the_decimal_type(spark):
    prices = ["10.005", "0.015", "1.115", "2.675", "-10.005", "33.333", "10.004999", "99999999.99", "0.1", "7"]
    rows = spark.createDataFrame([(float(p), 0.125) for p in prices], "l_extendedprice double, l_discount double")
    found = [r[0] for r in rows.select(money.line_revenue()).collect()]
    half_up = [r[0] for r in rows.selectExpr("CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) AS DECIMAL(38,4))").collect()]
    assert found == half_up and str(found[0]) == "8.7087"
    decimals = rows.selectExpr("CAST(l_extendedprice AS DECIMAL(20,6)) AS l_extendedprice", "CAST(l_discount AS DECIMAL(20,6)) AS l_discount")
    assert [r[0] for r in decimals.select(money.line_revenue()).collect()] == half_up
