"""Operators on inputs that the given tables don't hold: many files, copies across blocks, small groups, parts of items."""

import duckdb
import pytest
from pyspark.sql import functions as F

from skein import registry
from skein.bind import articles
from skein.operators import ordered, similarity
from tests.test_queries import sorted_rows


@pytest.fixture(scope="module", params=["backwards", "forwards"])
def many_files(spark, sf, tmp_path_factory, request):
    """The events in twelve files, read one after the other, whose times overlap and run backwards or forwards."""
    folder = tmp_path_factory.mktemp("events")
    rows = spark.read.parquet(f"{sf}/events.parquet").toPandas()
    quarter = rows["ts"].rank(pct=True).mul(4).clip(upper=3.999).astype(int)
    (folder / "events.parquet").mkdir()
    for i in range(12):
        part = rows[(rows["event_id"] % 3 == i % 3) & (quarter == (3 - i // 3 if request.param == "backwards" else i // 3))]
        part.to_parquet(folder / "events.parquet" / f"part-{i:02d}.parquet", index=False, coerce_timestamps="us")
    return str(folder)


@pytest.mark.parametrize("name", ["t10_first_views_stream", "t13_session_stream"])
def test_streams_of_many_files(spark, many_files, name):
    got = registry.QUERIES[name](spark, many_files)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{many_files}/events.parquet/*.parquet')")
    assert con.execute("SELECT count(*) FROM events").fetchone() == (spark.read.parquet(f"{many_files}/events.parquet").count(),)
    want = con.execute(registry.ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted_rows(got.columns, got.collect()) == sorted_rows(names, want.fetchall())


def test_first_kept_of_all_times_and_copies(spark):
    day = 86400
    rows = [(5, 0, 0), (1, 0b11, day), (2, 0, 6 * day), (3, 0, 8 * day), (4, 0, 8 * day), (6, (1 << 40) - 1, day), (7, 0b111, 14 * day), (8, -1, 0)]
    got = ordered.first_kept_of_all(spark.createDataFrame(rows, "id long, h long, t long"), "id", "t", "test")
    assert {r.id: r.duplicate_of for r in got.collect()} == {5: None, 1: 5, 2: 5, 3: None, 4: 3, 6: None, 7: 3, 8: None}


def test_first_kept_titles_against_a_scan(spark, sf):
    """The query's duplicates are those of one scan over all titles in order of arrival, whatever their sources."""
    a = articles(spark, sf)
    prints = similarity.fingerprints(a.select("id", "title"), "id", F.col("title")).join(a.select("id", "created_at", "source_key"), "id").collect()
    kept, want, sources = [], {}, {r.id: r.source_key for r in prints}
    for r in sorted(prints, key=lambda r: (r.created_at, r.id)):
        near = [k.id for k in kept if (r.created_at - k.created_at).total_seconds() <= 7 * 86400 and bin((k.h ^ r.h) & (2**64 - 1)).count("1") <= 10]
        want[r.id] = near[0] if near else None
        if not near:
            kept.append(r)
    got = {r.id: r.duplicate_of for r in registry.QUERIES["x03_first_kept_titles"](spark, sf).collect()}
    assert got == want
    assert any(k is not None and sources[k] != sources[i] for i, k in got.items())


def test_members_lose_no_link(spark):
    """Copies, and different titles of one fingerprint, are links as well."""
    rows = [(1, 0), (2, 0), (3, 0), (4, 0b111), (5, -1), (6, -1), (7, 0xFFFFFFFF)]
    prints = spark.createDataFrame(rows, "id long, h long")
    got = {r.id: (r.rep, r.n_links) for r in similarity.members(prints, similarity.near_pairs(prints, "id"), "id").collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 3), 5: (5, 1), 6: (5, 1), 7: (7, 0)}


def test_pairs_and_classes_give_all_near_titles(spark, sf):
    a = articles(spark, sf)
    prints = similarity.fingerprints(a.select("id", "title"), "id", F.col("title")).collect()
    want = {(x.id, y.id) for x in prints for y in prints if x.id < y.id and bin((x.h ^ y.h) & (2**64 - 1)).count("1") <= 10}
    reps = {r.id: r.rep for r in registry.QUERIES["j13_title_classes"](spark, sf).collect()}
    pairs = {(r.a, r.b) for r in registry.QUERIES["j13_near_duplicate_titles"](spark, sf).collect()}
    near = {(x, y) for x in reps for y in reps if x < y and (reps[x] == reps[y] or (min(reps[x], reps[y]), max(reps[x], reps[y])) in pairs)}
    assert near == want and any(reps[x] == reps[y] for x, y in near)


def _scan(rows, seconds=7 * 86400, most=10):
    kept, out = [], {}
    for i, h, t in sorted(rows, key=lambda r: (r[2], r[0])):
        near = [k for k, g, since in kept if t - since <= seconds and bin((g ^ h) & (2**64 - 1)).count("1") <= most]
        out[i] = near[0] if near else None
        if not near:
            kept.append((i, h, t))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_kept_of_all_against_a_scan(spark, seed):
    """Walks of a few bits a step, in order and out of it, copies at many times, equal times."""
    import random

    rnd, rows, day = random.Random(seed), [], 86400
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    for walk in range(6):
        h = rnd.getrandbits(64)
        for step in range(40):
            for bit in rnd.sample(range(64), rnd.choice([0, 2, 6, 9])):
                h ^= 1 << bit
            t = step * 3600 if walk < 2 else rnd.randrange(40) * day if walk < 4 else rnd.randrange(20 * day)
            rows.append((len(rows) * 7 % 1009, signed(h), t))
    got = ordered.first_kept_of_all(spark.createDataFrame(rows, "id long, h long, t long").repartition(4), "id", "t", "test")
    assert {r.id: r.duplicate_of for r in got.collect()} == _scan(rows)


def test_a_long_chain_of_near_titles_takes_few_rounds(spark, monkeypatch):
    """Each title is near the next one only and comes after it: every second one is kept, in a number of tables that grows with the bits of its length."""
    import random

    rnd, h, last, rows, written = random.Random(5), 0, [], [], []
    for i in range(3000):
        rows.append((i, h if h < 2**63 else h - 2**64, i))
        last = rnd.sample([b for b in range(64) if b not in last], 7)
        for bit in last:
            h ^= 1 << bit
    settle = ordered.settle
    monkeypatch.setattr(ordered, "settle", lambda df, label: written.append(label) or settle(df, label))
    got = {r.id: r.duplicate_of for r in ordered.first_kept_of_all(spark.createDataFrame(rows, "id long, h long, t long"), "id", "t", "chain").collect()}
    assert got == _scan(rows)
    assert len(written) <= 40


def test_first_kept_of_nothing(spark):
    assert ordered.first_kept_of_all(spark.createDataFrame([], "id long, h long, t long"), "id", "t", "none").count() == 0
