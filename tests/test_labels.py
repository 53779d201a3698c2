"""Axis steps, price changes and old news on hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.functions import labels as L

c = F.col


@pytest.mark.parametrize(("value", "step", "most"), [(None, 1, 1), (0, 1, 1), (3, 1, 3), (4, 1, 4), (7, 2, 8), (17, 5, 20), (100, 50, 100), (101, 50, 150), (999, 500, 1000), (1600, 500, 2000), (8000, 2000, 8000)])
def test_nice_scale(spark, value, step, most):
    row = spark.createDataFrame([(value,)], "v long").select(L.nice_scale(c("v")).alias("s"), F.size(L.ticks(L.nice_scale(c("v")))).alias("n")).first()
    assert (row.s.step, row.s.most, row.n) == (step, most, most // step + 1)


def test_rank_ticks(spark):
    rows = spark.createDataFrame([(1,), (10,), (11,), (50,), (99,), (230,)], "w long").select(L.rank_ticks(c("w")).alias("t")).collect()
    assert [r.t for r in rows] == [[1, 5, 10], [1, 5, 10], [1, 5, 10, 15, 20], [1, 10, 20, 30, 40, 50], [1, 10, 20, 40, 60, 80, 100], [1, 50, 100, 150, 200, 250]]


def test_change_kinds(spark):
    cases = [((10.0, "USD", "3 a day"), (0.0, "USD", "3 a day"), "opened"), ((10.0, "USD", " "), (12.0, "USD", "3 a day"), "opened"), ((10.0, "USD", "x"), (12.0, "USD", "x"), "rose"), ((10.0, "USD", "x"), (9.0, "USD", "y"), "fell"),
             ((10.0, "USD", "x"), (9.0, "EUR", "x"), None), ((10.0, "USD", "x"), (9.0, "EUR", "y"), "free"), ((None, None, None), (None, None, None), None), ((None, "USD", "x"), (5.0, "USD", None), "free"), ((0.0, None, "x"), (0.0, None, "x"), None)]
    kind = "struct<price: double, currency: string, free: string>"
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {kind}, b {kind}")
    got = {r.i: r.k for r in rows.select("i", L.change_kind(c("a"), c("b")).alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]


def test_old_news_takes_the_first_reason(spark):
    day = lambda m, d: dt.datetime(2024, m, d)
    first = day(6, 20)
    cases = [(2019, day(6, 1), day(6, 1), day(1, 1), "the title says (2019)"), (None, day(6, 9), day(6, 1), None, "its articles are from 09 Jun 2024"), (None, day(6, 19), day(6, 1), None, "the main article is from 01 Jun 2024"),
             (None, day(6, 10), day(6, 10), day(4, 1), "the article link is dated Apr 2024"), (None, day(6, 10), None, day(5, 1), None), (None, None, None, None, None)]
    rows = spark.createDataFrame([(i, first, *x[:4]) for i, x in enumerate(cases)], "i int, f timestamp, y int, n timestamp, l timestamp, u timestamp")
    got = {r.i: r.x for r in rows.select("i", L.old_news(c("f"), c("y"), c("n"), c("l"), c("u")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [x[4] for x in cases]
