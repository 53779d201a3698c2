"""Cases of the fourth round's findings."""

import datetime as dt
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import registry
from skein.functions import leads as L
from skein.operators import clusters, duplicates
from skein.plans import feeds, stories  # noqa: F401
from skein.shared import connected, shared_dir
from tests.test_stories import brute_events

STORY = "story_id long, headline string, names array<string>, at timestamp, v array<double>, topic string"
DAY = dt.datetime(2024, 1, 1)


def test_feeds_name_their_subjects_in_descriptions(spark, tmp_path):
    """An invented title with "ai" for a word is no subject: a general source keeps what its description names one in, as the SQL says."""
    rows = [(i, "Le ai la\nx", "fr", f"src{n}", 10) for i, n in enumerate([3, 3, 3, 0, 1, 2, 10, 10, 10])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(registry.ORACLES["s01_feed_scan"]).fetchall()
    got = registry.QUERIES["s01_feed_scan"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 5


def _watched(monkeypatch):
    """Tables settled by the story operators, by label."""
    written, real = {}, duplicates.settle
    monkeypatch.setattr(duplicates, "settle", lambda df, label: written.setdefault(label, real(df, label)))
    return written


def test_like_vectors_alone_leave_no_task(spark, monkeypatch):
    """Stories whose vectors are over the bar, but that share too little to be told anything of, are no rows anywhere."""
    written = _watched(monkeypatch)
    rows = [(i, f"w{i} x{i} y{i}", [f"name {i}"], DAY + dt.timedelta(hours=i), [1.0, 0.0], str(i)) for i in range(60)]
    rows += [(100, "a b c d e", ["Name 1"], DAY, [0.8, 0.6], "u"), (101, "a b c d f", ["name-1"], DAY, [0.6, 0.8], "w"), (102, "a q r s t", ["name-1"], DAY, [0.6, 0.8], "v")]
    got = duplicates.same_event(spark.createDataFrame(rows, STORY), 0.25, "alone").collect()
    assert [(r.a, r.b, r.sim, r.reason) for r in got] == [(100, 101, 0.96, "0.96 alike, both about Name 1")]
    assert written["alone-met"].count() == 1


@pytest.mark.parametrize("seed", [3, 4])
def test_events_over_many_blocks(spark, monkeypatch, seed):
    """All pairs as by a plain loop, with names by the dozen, so that marks of names collide, and blocks of a few stories."""
    monkeypatch.setattr(duplicates, "BLOCK", 7)
    monkeypatch.setattr(duplicates, "PAIRS", 40)
    rnd = random.Random(seed)
    rows = []
    for i in range(120):
        v = [rnd.gauss(0, 1) for _ in range(4)]
        norm = sum(x * x for x in v) ** 0.5
        head = " ".join(rnd.choice("abcdefghkl") + "x" for _ in range(rnd.randint(1, 6)))
        names = [f"Name {rnd.randrange(200)}" for _ in range(rnd.randint(0, 12))]
        rows.append((i, head, names if i % 9 else None, DAY + dt.timedelta(hours=rnd.randrange(24 * 30)), [x / norm for x in v], rnd.choice(["a", "b", "c", None])))
    got = duplicates.same_event(spark.createDataFrame(rows, STORY), 0.4, f"many{seed}").collect()
    sure, maybe = brute_events(rows, 0.4)
    assert len(got) == len(sure) + len(maybe) and sure and maybe
    assert {(r.a, r.b) for r in got if r.merge} == sure and {(r.a, r.b) for r in got if not r.merge} == maybe


def test_words_make_few_candidates(spark, monkeypatch):
    """Headlines over few words share keys in nearly all pairs; only those pairs are written of whose words 0.6 may be shared, and none that has a cosine."""
    made, real = [], duplicates.settle

    def counted(df, label):
        out = real(df, label)
        made.extend([out.count()] if out.columns[:2] == ["a", "b"] else [])
        return out

    monkeypatch.setattr(duplicates, "settle", counted)
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(24)]
    rows = [(i, " ".join(rnd.sample(vocabulary, 9)), [f"Name {i % 3}"], DAY + dt.timedelta(hours=i % 24), None if i % 4 else [1.0, 0.0], None) for i in range(120)]
    rows += [(200 + i, rows[i][1].rsplit(" ", 1)[0] + " new more", ["name 0", "name 1", "name 2"], DAY, [0.0, 1.0] if i % 2 else None, None) for i in range(20)]
    got = duplicates.same_event(spark.createDataFrame(rows, STORY), 0.25, "few").collect()
    sure, maybe = brute_events(rows, 0.25)
    assert {(r.a, r.b) for r in got if r.merge} == sure and {(r.a, r.b) for r in got if not r.merge} == maybe and len(sure) > 10
    assert made and max(made) <= 4 * len(sure)


def test_tables_that_were_read_go(spark, sf):
    """The members that the first leads are chosen from, and the words that stories meet by, are on no disk while merges are made."""
    rows = registry.QUERIES["u11_story_merge"](spark, sf)
    folder = f"{shared_dir(spark).removeprefix('file://')}/skein-{spark.sparkContext.applicationId}"
    left = [x for top, names, _ in os.walk(folder) for x in names if "u11" in top + x]
    assert rows.count() > 0 and left and not [x for x in left if "leads" in x or "words" in x or "near" in x]


def test_near_articles_are_linked_by_few_rows(spark, monkeypatch):
    """Articles that are all alike are linked by less rows than there are articles and blocks, not by all their pairs."""
    written, real = {}, clusters.settle
    monkeypatch.setattr(clusters, "settle", lambda df, label: written.setdefault(label, real(df, label)))
    rows = [(i, "a", DAY + dt.timedelta(minutes=i), [1.0, 0.001 * i], True, 5, False) for i in range(200)]
    placed, _ = clusters.place(spark.createDataFrame(rows, "id long, topic string, at timestamp, v array<double>, news boolean, importance int, primary boolean"), None, 0.8, "few")
    assert {r.id: (r.cluster, r.status) for r in placed.collect()} == {i: (i // 80 * 80, "published" if i % 80 < 40 else "overflow") for i in range(200)}
    assert written["few-near"].count() < 200


def test_links_connect_what_near_pairs_connect(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 9)
    monkeypatch.setattr(clusters, "PAIRS", 30)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(150, 5))
    v /= np.linalg.norm(v, axis=1)[:, None]
    t, topic = rng.integers(0, 4000, 150), rng.integers(0, 2, 150)
    near = (v @ v.T >= 0.85) & (np.abs(t[:, None] - t) <= 500) & (topic[:, None] == topic)
    first = np.arange(150)
    for _ in range(150):
        first = np.where(near, first[None, :], 999).min(axis=1)
    rows = [(i, str(topic[i]), int(t[i]), v[i].tolist()) for i in range(150)]
    links = clusters._near(spark.createDataFrame(rows, "node long, topic string, t long, w array<double>"), 500, 0.85)
    got = {r.id: r.component for r in connected(links, "linked").collect()}
    assert [got.get(i, i) for i in range(150)] == first.tolist() and 5 < len(set(first)) < 145


def test_first_person_is_told_as_by_the_whole_pattern(spark):
    heads = ["I say", "What I'd do", "a my b", "myth", "amy", "My way", "é my", "émy", "in I.", "(I)", "AI I'm", "I", "my", "we, I've", "I'll", "xIx", "", None, "x my?", " Why", "my_x", "my-x", "I’m"]
    rows = spark.createDataFrame([(x,) for x in heads], "h string").select("h", L.opinion_headline(F.col("h")).alias("got"), F.trim(F.coalesce("h", F.lit(""))).alias("t"))
    whole = (F.col("t") != "") & (F.col("t").endswith("?") | F.col("t").rlike(L.plain_borders(L.OPINION_START)) | F.col("t").rlike(L.plain_borders(L.FIRST_PERSON)))
    assert all(r.got is r.want for r in rows.withColumn("want", whole).collect())
