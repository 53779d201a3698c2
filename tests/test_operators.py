"""Operators without a SQL twin, against plain Python on small data."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import urls as U
from skein.operators import ordered, similarity
from skein.sources import html


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_greedy_clusters(spark):
    rows = [("b", 1, [1.0, 0.0]), ("b", 2, [0.99, 0.1]), ("b", 3, [0.0, 1.0]), ("b", 4, [0.1, 0.99]), ("c", 5, [1.0, 0.0])]
    got = ordered.greedy_clusters(spark.createDataFrame(rows, "block string, id long, v array<double>"), "block", "id", "v", 0.9)
    assert {r.id: r.cluster for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_greedy_clusters_capacity(spark):
    rows = [("b", i, [1.0, 0.0]) for i in range(5)]
    got = ordered.greedy_clusters(spark.createDataFrame(rows, "block string, id long, v array<double>"), "block", "id", "v", 0.9, total=2)
    assert sorted(r.cluster for r in got.collect()) == [0, 0, 2, 2, 4]


def test_fold_deals(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", 1, 100.0, day), ("a", 2, 110.0, day + dt.timedelta(9)), ("a", 3, 200.0, day), ("a", 4, 100.0, day + dt.timedelta(60)), ("b", 5, 100.0, day)]
    got = ordered.fold_deals(spark.createDataFrame(rows, "company string, deal_id long, amount double, day date"))
    assert {r.deal_id: r.fold for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_anchored_groups_are_no_session_windows(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("k", i, base + dt.timedelta(minutes=m)) for i, m in enumerate([0, 20, 28, 35, 60, 66])]
    got = ordered.anchored_groups(spark.createDataFrame(rows, "k string, i long, at timestamp"), "k", "at", "i", 29)
    start = {r.i: r.first_us for r in got.collect()}
    assert start[0] == start[1] == start[2] and start[3] == start[4] and start[5] != start[3] and start[3] != start[0]


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    w, mean = ordered.ridge(df, {k: F.col(k) for k in "abc"}, F.col("y"))
    assert np.allclose(w, np.linalg.solve(x.T @ x + np.eye(3), x.T @ (y - y.mean()))) and np.isclose(mean, y.mean())


def test_near_pairs_find_all(spark):
    rng = np.random.default_rng(2)
    base = [int(v) for v in rng.integers(-(2**62), 2**62, 30)]
    prints = []
    for i, h in enumerate(base):
        prints.append((2 * i, h))
        flipped = h
        for b in rng.choice(63, int(rng.integers(0, 14)), replace=False):
            flipped ^= 1 << int(b)
        prints.append((2 * i + 1, flipped))
    got = {(r.a, r.b) for r in similarity.near_pairs(spark.createDataFrame(prints, "id long, h long"), "id").collect()}
    kinds = {}
    for i, h in prints:
        kinds[h] = min(i, kinds.get(h, i))
    want = {(min(i, j), max(i, j)) for h, i in kinds.items() for g, j in kinds.items() if i != j and bin((h ^ g) & (2**64 - 1)).count("1") <= 10}
    assert got == want
    with pytest.raises(ValueError):
        similarity.near_pairs(spark.createDataFrame(prints, "id long, h long"), "id", 12)


@pytest.mark.parametrize(("url", "want"), [
    ("https://www.Example.com/a/b/?utm_source=x&id=3#top", "https://example.com/a/b?id=3"),
    ("http://m.news.example.org/x/amp", "http://news.example.org/x"),
    ("https://e.org", "https://e.org/"),
])
def test_normalize_url(spark, url, want):
    assert one(spark, U.normalize(F.col("u")), u=url) == want


@pytest.mark.parametrize(("title", "want"), [
    ("Some long title about a thing here - Daily News", "Some long title about a thing here"),
    ("Short - Daily News", "Short - Daily News"),
    ("A piece  of   work (2019)", "A piece of work"),
    (None, ""),
])
def test_clean_title(spark, title, want):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(T.clean_title(F.col("t"))).first()[0] == want


def test_figures(spark):
    assert one(spark, T.figures(F.col("t")), t="raised 2.5 million in 3 rounds and 1 billion") == [2.5e6, 3.0, 1e9]


def test_article_reader():
    page = "<title>A b</title><nav>x y z</nav><p>before it all</p><article><h1>A b</h1><p>one two three<script>no</script></p><p>four five &amp; six</p></article>"
    title, paragraphs = html.read_article(page)
    assert title == "A b" and paragraphs == ["A b", "one two three", "four five & six"]
    assert html.read_article(None) == ("", [])


def test_first_kept(spark):
    rows = [(1, 0, 0), (2, 0b111, 0), (3, (1 << 40) - 1, 0), (4, (1 << 41) - 1, 0)]
    got = ordered.first_kept_of_all(spark.createDataFrame(rows, "id long, h long, t long"), "id", "t", "test", 10)
    assert {r.id: r.duplicate_of for r in got.collect()} == {1: None, 2: 1, 3: None, 4: 3}


def test_merge_forest(spark):
    rows = [("x", 1, 2, 0.9), ("x", 2, 3, 0.8), ("x", 1, 3, 0.7), ("x", 4, 5, 0.95), ("x", 3, 4, 0.5)]
    df = spark.createDataFrame(rows, "block string, a long, b long, sim double")
    assert [(r.a, r.b, r.root) for r in ordered.merge_forest(df, "block").collect()] == [(4, 5, 4), (1, 2, 1), (2, 3, 1), (3, 4, 1)]
    assert [(r.a, r.b) for r in ordered.merge_forest(df, "block", most_size=3).collect()] == [(4, 5), (1, 2), (2, 3)]
    assert ordered.merge_forest(df, "block", most_merges=1).count() == 1


def test_majority_amounts(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", 1, 100.0, day), ("a", 2, 500.0, day), ("a", 3, 110.0, day + dt.timedelta(1)), ("b", 4, 7.0, day), ("b", 5, 70.0, day), ("b", 6, None, day)]
    got = ordered.majority_amounts(spark.createDataFrame(rows, "company string, deal_id long, amount double, day date"))
    assert {r.company: (r.amount, r.n) for r in got.collect()} == {"a": (100.0, 2), "b": (7.0, 1)}


def test_assign_threads(spark):
    rows = [("b", 1, ["x"], ["m"], [1.0, 0.0]), ("b", 2, ["x"], [], [0.99, 0.1]), ("b", 3, ["y"], [], [1.0, 0.0]), ("b", 4, ["x"], ["m"], [0.8, 0.6]), ("b", 5, ["x"], [], [0.8, 0.6])]
    df = spark.createDataFrame(rows, "block string, story_id long, names array<string>, specific array<string>, v array<double>")
    assert {r.story_id: r.thread for r in ordered.assign_threads(df, "block", 0.9, 0.7).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
