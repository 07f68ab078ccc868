"""Column helpers: id formatting, id parsing, string order keys, sizing."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from boutique.functions.bounds import parse_timestamp
from boutique.functions.ids import format_id, id_number, padded
from boutique.functions.numbers import python_float, python_int
from boutique.functions.text import blank_to_null_stripped, strip_python
from boutique.session import cluster_settings


def test_padded_matches_format_string(spark):
    vals = [0, 7, 99999, 100000, 1234567, -5]
    df = spark.createDataFrame([(v,) for v in vals], "n long")
    got = df.select(padded(F.col("n"), 5).alias("a"), F.format_string("%05d", "n").alias("b")).collect()
    assert all(r.a == r.b for r in got)
    assert df.select(format_id("PROD_", 5, F.col("n")).alias("x")).first().x == "PROD_00000"


def test_id_number(spark):
    df = spark.createDataFrame([("PROD_00042",), ("X-PROD_7-1",), ("PROD_",), (None,)], "s string")
    assert [r.n for r in df.select(id_number("s", "PROD_").alias("n")).collect()] == [42, 7, None, None]


def test_strip_and_blank(spark):
    df = spark.createDataFrame([("\t a \n",), ("",), ("  ",), (None,)], "s string")
    got = df.select(strip_python("s").alias("a"), blank_to_null_stripped("s").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("a", "a"), ("", None), ("", ""), (None, None)]


def test_cluster_settings():
    conf = cluster_settings(100 * 2**40, cluster_cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert int(cluster_settings(10, cluster_cores=16)["spark.sql.shuffle.partitions"]) == 32


NUMBERS = ["12", " +12\t", "-0", "1_000", "1__0", "_1", "1_", "12d", "12f", "0x1p3", "0x10", "1,5", "", " ", "1 2", "1.", ".5", ".", "1.5e3", "1e", "1_0.0_1e+1_0", "1._5",
           "1_.5", "inf", "-Infinity", "NaN", "infinit", "1e400", "12.0", "9" * 30, "--1", "+", "1e5_0", "\u00a01\u2003"]


def test_number_grammar_is_pythons(spark):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(NUMBERS)], "k int, s string")
    for r in df.select("k", python_float("s").alias("f"), python_int("s", "decimal(38,0)").alias("i")).collect():
        text = NUMBERS[r.k]
        for got, read in ((r.f, float), (r.i, int)):
            try:
                want = read(text)
            except ValueError:
                want = None
            assert got == want or (isinstance(want, float) and math.isnan(want) and math.isnan(got)), text
    assert spark.sql("select '99999999999' s").select(python_int("s")).first()[0] is None


@pytest.mark.parametrize("text", ["2024-1-5", "2024-01-05", " 2024/1/5 ", "20240105", "1/5/2024", "01/05/2024", "13/1/2024", "5 Jan 2024", "January 5, 2024", "jan 5 2024", "5-Jan-2024",
                                  "2024", "2024-03", "Jan 2024", "2024-01-05 7:08", "2024-01-05T07:08:09.5", "2024-01-05 07:08:09 PM", "2024-01-05 12:00 am", "2024-01-05T07:08:09Z",
                                  "2024-01-05 07:08:09+02:00", "1/5/2024 7:08"])
def test_date_forms_as_pandas_reads_them(text):
    pd = pytest.importorskip("pandas")
    want = pd.to_datetime(text.strip())
    want = want.tz_convert("UTC").tz_localize(None) if want.tzinfo else want
    assert parse_timestamp(text) == want.to_pydatetime()


@pytest.mark.parametrize("text", ["", " ", "soon", "2024-13-01", "2024-02-30", "32/13/2024", "5 Jam 2024", "2024-01-05 25:00", "2024-01-05 13:00 pm", "12", "2024-1-5-6", "1/5/24x"])
def test_no_dates(text):
    assert parse_timestamp(text) is None


def test_dates_given_as_dates():
    assert parse_timestamp(dt.date(2024, 1, 5)) == dt.datetime(2024, 1, 5) == parse_timestamp(dt.datetime(2024, 1, 5))
    assert parse_timestamp(dt.datetime(2024, 1, 5, tzinfo=dt.timezone(dt.timedelta(hours=2)))) == dt.datetime(2024, 1, 4, 22)


def test_padded_numbers_as_the_format_says(spark):
    from boutique.functions.ids import padded

    numbers = [None, 0, 42, 9999, 10000, 123456789012, -1, -42, -999, -10000, 2**63 - 1, -2**63]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    for width in (2, 4, 5, 6, 8):
        shown = padded(F.col("n"), width)
        assert "format_string" not in str(shown)
        assert [r[0] for r in df.select(shown).collect()] == [r[0] for r in df.select(F.format_string(f"%0{width}d", "n")).collect()]
