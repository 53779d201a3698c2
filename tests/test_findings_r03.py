"""Cases of the third round's findings."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from skein import registry
from skein.functions import leads
from skein.operators import duplicates, similarity
from skein.plans import joins, more  # noqa: F401


def test_probes_are_not_broadcast(spark, tmp_path):
    """Fingerprints read from a small file: their probes are 68 times as many rows, so the join must not go through the driver."""
    spark.createDataFrame([(i, (i * 0x9E3779B97F4A7C15) % 2**63) for i in range(500)] + [(1000, 7), (1001, 6)], "id long, h long").write.parquet(f"{tmp_path}/prints")
    pairs = similarity.near_pairs(spark.read.parquet(f"{tmp_path}/prints"), "id")
    assert (1000, 1001, 1) in {tuple(r) for r in pairs.collect()}
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_related_stories_meet_by_cells(spark, sf, monkeypatch):
    """What is written on the way is six rows a story at most and the pairs of name sets, not the pairs of stories."""
    written, settle = {}, joins.settle

    def kept(df, label):
        out = settle(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(joins, "settle", kept)
    got = registry.QUERIES["j30_related_stories"](spark, sf).count()
    stories = written["j30-stories"]
    assert got == 5 * stories and written["j30-tops"] <= 6 * stories


def test_day_numbers_at_the_nearest_second(spark, tmp_path):
    """Half a second before midnight and less counts for the next day, as in the SQL; so do times before 1970."""
    times = ["2024-01-01 23:59:59.4", "2024-01-01 23:59:59.5", "2024-01-01 23:59:58.5", "2024-01-01 23:59:59.999999", "2024-01-02 00:00:00", "1969-12-31 23:59:59.7", "1969-12-30 12:00:00", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "event_id long, t string")
    rows = rows.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = {i: (day, n) for i, day, n in con.execute(registry.ORACLES["f56_day_range"]).fetchall()}
    assert {r.event_id: (r.day, r.number) for r in registry.QUERIES["f56_day_range"](spark, str(tmp_path)).collect()} == want


def test_opinion_starts_end_at_plain_letters(spark):
    heads = {"Ouréeux la": True, "Isère rises": False, "Our plan": True, "Ourselves": False, "éour": False, "dé my la": True, "émy la": False, "My_ la": False}
    heads |= {"Doñ": True, "Willé": True, "Élémy": True}
    con = duckdb.connect()
    sql = "SELECT regexp_matches(?, ?) OR regexp_matches(?, ?)"
    want = {h: con.execute(sql, [h, leads.OPINION_START, h, leads.FIRST_PERSON]).fetchone()[0] for h in heads}
    got = {r.h: r.x for r in spark.createDataFrame([(h,) for h in heads], "h string").select("h", leads.opinion_headline(F.col("h")).alias("x")).collect()}
    assert got == want and got["Ouréeux la"] and not got["Ourselves"]


def test_names_and_topics_alone_make_no_candidates(spark, monkeypatch):
    """Two hundred stories with the same names and topic and vectors at right angles: none of them meet. Blocks of a few stories give the near pairs."""
    monkeypatch.setattr(duplicates, "BLOCK", 30)
    written, settle = {}, duplicates.settle

    def kept(df, label):
        written[label] = settle(df, label)
        return written[label]

    monkeypatch.setattr(duplicates, "settle", kept)
    unit = lambda i: [1.0 if k == i else 0.0 for k in range(200)]
    rows = [(i, f"w{i} x{i} y{i}", ["One", "Two", "Three"], dt.datetime(2024, 1, 1 + i % 20), unit(i - 1 if i in (41, 82) else i), "t") for i in range(200)]
    got = duplicates.same_event(spark.createDataFrame(rows, "story_id long, headline string, names array<string>, at timestamp, v array<double>, topic string"), 0.25, "apart").collect()
    assert {(r.a, r.b) for r in got} == {(40, 41), (81, 82)} and written["apart-met"].count() == 2
