import datetime as dt

import pytest
from pyspark.sql import functions as F

from bazaarlens.functions import dates, numbers, tails, text


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw, shown",
    [("santa bárbara d'oeste", "Santa Bárbara D'Oeste"), ("SAO PAULO", "Sao Paulo"), ("a-b c1d", "A-B C1D"), (None, "Unknown")],
)
def test_title_case(spark, raw, shown):
    assert one(spark, raw, "string", text.filled_title) == shown


@pytest.mark.parametrize("raw", ["  Préço (R$) ", "ID-Cliente", "__a__b", "São João"])
def test_slug_column_matches_header_rule(spark, raw):
    assert one(spark, raw, "string", text.slug) == text.slug_name(raw)


@pytest.mark.parametrize(
    "value, expected",
    [(1234567.891, "1.234.567,89"), (-0.5, "-0,50"), (None, "n/d"), (float("nan"), "n/d")],
)
def test_br_number(spark, value, expected):
    assert one(spark, value, "double", text.br_number) == expected


def test_other_formats(spark):
    assert one(spark, 2.5, "double", text.br_integer) == "2"
    assert one(spark, 3.5, "double", text.br_integer) == "4"
    assert one(spark, 1234.5, "double", text.br_currency) == "R$ 1.234,50"
    assert one(spark, 0.0004, "double", text.br_pvalue) == "<0,001"
    assert one(spark, 0.0456, "double", text.br_pvalue) == "0,0456"
    assert one(spark, 1_234_567.0, "double", text.short_currency) == "R$ 1.2M"
    assert one(spark, 3_400.0, "double", text.short_currency) == "R$ 3k"
    assert one(spark, 12.0, "double", text.short_currency) == "R$ 12"
    assert one(spark, 2.5, "double", text.whole_currency) == "R$ 3"
    assert one(spark, 0.0125, "double", text.one_decimal_percent) == "1.3%"
    assert one(spark, 7, "bigint", lambda c: text.zero_padded(c, 3)) == "007"
    assert one(spark, 12345, "bigint", lambda c: text.zero_padded(c, 3)) == "12345"


@pytest.mark.parametrize("score, stars", [(4.99, "★★★★☆"), (5.0, "★★★★★"), (7.0, "★★★★★"), (-1.0, "☆☆☆☆☆"), (None, "☆☆☆☆☆")])
def test_star_rating(spark, score, stars):
    assert one(spark, score, "double", text.star_rating) == stars


@pytest.mark.parametrize("day, week", [("2017-01-01", 1), ("2017-01-02", 2), ("2018-12-31", 53), ("2018-01-01", 1)])
def test_week_of_year(spark, day, week):
    assert one(spark, dt.date.fromisoformat(day), "date", dates.week_of_year) == week


def test_weekday(spark):
    assert one(spark, dt.date(2017, 1, 1), "date", dates.weekday_monday_first) == 7


def test_blank_arithmetic(spark):
    rows = spark.createDataFrame([(None, 4.0), (3.0, None), (None, None), (3.0, 0.0), (6.0, 4.0)], "a double, b double")
    found = rows.select(numbers.blank_minus(F.col("a"), F.col("b")), numbers.relative_change(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in found] == [(-4.0, -1.0), (3.0, None), (None, None), (3.0, None), (2.0, 0.5)]


@pytest.mark.parametrize(
    "t, df, p",
    [(2.0, 10.0, 0.07338803477074039), (1.0, 1.0, 0.5), (0.0, 5.0, 1.0), (2.5758293035489, 1e7, 0.01)],
)
def test_student_tail(t, df, p):
    assert tails.student_two_sided(t, df) == pytest.approx(p, rel=1e-5)


def test_student_tail_at_any_size():
    for df in (9_000, 10_000):
        for t in (0.01, 0.5, 1.0, 1.7, 2.5, 8.0, 30.0):
            exact = tails.regularized_beta(df / 2, 0.5, df / (df + t * t))
            assert tails.normal_two_sided(tails._student_deviate(t, df)) == pytest.approx(exact, rel=1e-9)
    for df in (10_001, 1e7, 1e11, 1e13):
        for t in (0.01, 1.0, 3.0):
            assert tails.student_two_sided(t, df) == pytest.approx(tails.normal_two_sided(t), rel=1e-13, abs=t * (1 + t**2) / df)
    with pytest.raises(ArithmeticError):
        tails.regularized_beta(5e12, 5e12, 0.5)


def test_normal_tail():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-12)
    assert tails.normal_pvalue(-0.3) == 1.0
    assert tails.normal_pvalue(None) is None
