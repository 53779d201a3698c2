"""Tables written in place, the log of revisions, and feeds, on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from skein.sources import feeds, tables

ROW = "id long, part int, v long, w string"


def stored(spark, path, like):
    return {r.id: (r.v, r.w) for r in tables.load(spark, path, like).collect()}


def test_merges_against_a_dictionary(spark, tmp_path):
    """Random changes and removals, each written twice; a partition that becomes empty goes, others aren't touched."""
    rnd, path, want = random.Random(2), str(tmp_path / "t"), {}
    like = spark.createDataFrame([], ROW)
    assert stored(spark, path, like) == {}
    for turn in range(4):
        ids = rnd.sample(range(20), 8)
        rows = [(i, i % 4, rnd.choice([None, turn]), f"{turn}-{i}", turn > 0 and rnd.random() < 0.4) for i in ids]
        changes = spark.createDataFrame(rows, ROW + ", gone boolean")
        for _ in range(2):
            tables.merge(path, changes, ["id"], "part", gone="gone", keep_old=["v"])
        for i, _, v, w, gone in rows:
            want[i] = (v if v is not None or i not in want else want[i][0], w)
            if gone:
                del want[i]
        assert stored(spark, path, like) == want
    tables.merge(path, spark.createDataFrame([(i, i % 4, None, None, True) for i in want if i % 4 == 1], ROW + ", gone boolean"), ["id"], "part", gone="gone")
    assert stored(spark, path, like) == {i: x for i, x in want.items() if i % 4 != 1}
    assert not (tmp_path / "t" / "part=1").exists() and (tmp_path / "t" / "part=2").exists()


def test_replaced_and_dropped_days(spark, tmp_path):
    path, like = str(tmp_path / "d"), spark.createDataFrame([], "n long, day date")
    rows = spark.sql("SELECT id AS n, date_add(DATE '2024-01-01', cast(id AS int)) AS day FROM range(6)")
    tables.replace(path, rows, "day", [f"2024-01-0{i}" for i in range(1, 7)])
    tables.replace(path, rows.where("n = 4").withColumn("n", F.lit(40).cast("long")), "day", ["2024-01-04", "2024-01-05"])
    assert sorted(r.n for r in tables.load(spark, path, like).collect()) == [0, 1, 2, 5, 40]
    assert tables.drop_before(spark, path, "day", "2024-01-03") == ["2024-01-01", "2024-01-02"] and tables.drop_before(spark, path, "day", "2024-01-03") == []
    assert sorted(r.n for r in tables.load(spark, path, like).collect()) == [2, 5, 40]
    assert tables.drop_before(spark, str(tmp_path / "none"), "day", "2024-01-03") == []


@pytest.mark.parametrize("seed", [1, 2])
def test_a_reader_that_looks_back_equals_a_full_read(spark, tmp_path, seed):
    """Writers finish out of order by one revision; the reader's copy is at last what all revisions, read whole, give."""
    rnd, path = random.Random(seed), str(tmp_path / "log")
    like = spark.createDataFrame([], "id long, v long, gone boolean")
    revisions = {r: [(i, rnd.randrange(9), rnd.random() < 0.3) for i in rnd.sample(range(8), 3)] for r in range(1, 7)}
    copy, watermark = like.withColumn("revision", F.lit(0).cast("long")), 0
    for group in ([1], [3], [2], [5], [4, 6]):
        for r in group:
            tables.record(path, spark.createDataFrame(revisions[r], like.schema), r)
        copy = spark.createDataFrame(tables.follow(copy, tables.since(spark, path, like, watermark, 1), ["id"]).collect(), copy.schema)
        watermark = max(watermark, *group)
    want = {}
    for r in sorted(revisions):
        want |= {i: (v, gone, r) for i, v, gone in revisions[r]}
    assert {r.id: (r.v, r.gone, r.revision) for r in copy.collect()} == want


def test_feeds_that_are_hard_to_read(spark):
    rss = '<rss version="2.0"><channel><title>R</title>{}</channel></rss>'
    item = "<item><title>{0}</title><link>{1}</link><pubDate>Tue, 02 Jan 2024 05:06:07 +0200</pubDate><description><![CDATA[a & <b>b</b>]]></description></item>"
    atom = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">T</title><link rel="enclosure" href="http://x.org/i.png"/><link href="http://x.org/a"/><updated>2024-01-02T03:04:05Z</updated></entry></feed>'
    one = rss.format(item.format("AI & R&D", "http://www.a.com/1?x=1&y=2"))
    rows = [("plain", rss.format(item.format("One", "http://a.com/1")), None, None, False), ("amp", "junk\n" + one, None, None, False), ("atom", atom, "ignored", None, False), ("none", None, None, None, False),
            ("down", "<html>503</html>", atom, None, False), ("empty", rss.format(""), "also down", None, False), ("kept", one, None, "A.com", True), ("other", one, None, "b.com", False), ("topic", rss.format(item.format("Rain", "http://a.com/2")), None, None, True),
            ("mail", rss.format(item.format("x", "mailto:a@b.c")), None, None, False)]
    got = {r.source_key: (r.link, r.title, str(r.published_at), r.description) for r in feeds.read_feeds(spark.createDataFrame(rows, "source_key string, document string, fallback string, keep_domain string, topic_only boolean")).collect()}
    at, text = "2024-01-02 03:06:07", "a & <b>b</b>"
    entry, two = ("http://x.org/a", "T", "2024-01-02 03:04:05", ""), ("http://www.a.com/1?x=1&y=2", "AI & R&D", at, text)
    assert got == {"plain": ("http://a.com/1", "One", at, text), "amp": two, "atom": entry, "down": entry, "kept": two}
