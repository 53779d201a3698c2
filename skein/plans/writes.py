"""Queries that write a table, write again what they wrote, and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.bind import articles, events, load
from skein.registry import query
from skein.shared import new_path, settle
from skein.sources import tables as W

c = F.col


@query("u06_upsert", """SELECT coalesce(n.key, o.key) AS key, coalesce(n.v, o.v) AS v FROM (SELECT source_id AS key, max(points) AS v FROM {art} WHERE status = 'published' GROUP BY 1) o
  FULL JOIN (SELECT source_id AS key, max(trend) AS v FROM {art} WHERE status = 'overflow' GROUP BY 1) n ON o.key = n.key""")
def u06(s: SparkSession, d: str) -> DataFrame:
    """Sources' rows, replaced by incoming rows of their key. The second merge runs twice."""
    a, path, bucket = articles(s, d), new_path(s, "u06"), F.pmod(F.xxhash64("key"), F.lit(16)).alias("bucket")
    stored = a.where("status = 'published'").groupBy(c("source_id").alias("key")).agg(F.max("points").alias("v")).select("key", "v", bucket)
    new = a.where("status = 'overflow'").groupBy(c("source_id").alias("key")).agg(F.max("trend").alias("v")).select("key", "v", bucket)
    for rows in (stored, new, new):
        W.merge(path, rows, ["key"], "bucket", label="u06")
    return W.load(s, path, stored).select("key", "v")


@query("u07_replace_days", """SELECT day, n FROM (SELECT day, count(*) AS n FROM {ev} WHERE day < DATE '2024-01-28' GROUP BY 1)
  UNION ALL SELECT day, count(DISTINCT who) FROM {ev} WHERE day >= DATE '2024-01-28' AND day <> DATE '2024-01-29' GROUP BY 1""", dates="day")
def u07(s: SparkSession, d: str) -> DataFrame:
    """Daily rows of which the last days are replaced, twice; one of these days has no rows any more."""
    e, path = events(s, d), new_path(s, "u07")
    old = e.groupBy("day").agg(F.count("*").alias("n"))
    days = [str(r.day) for r in e.where("day >= DATE '2024-01-28'").select("day").distinct().collect()]
    new = e.where(c("day").cast("string").isin(days) & (c("day") != F.lit("2024-01-29").cast("date"))).groupBy("day").agg(F.count_distinct("who").alias("n"))
    W.replace(path, old, "day", [str(r.day) for r in old.select("day").distinct().collect()], "u07")
    for _ in range(2):
        W.replace(path, new, "day", days, "u07")
    return W.load(s, path, old)


@query("u10_retention", "SELECT event_id FROM {ev} WHERE day >= DATE '2024-01-11'")
def u10(s: SparkSession, d: str) -> DataFrame:
    """Events in partitions by day, of which those before a day are dropped without being read; dropping again drops none."""
    e, path = events(s, d).select("event_id", "day"), new_path(s, "u10")
    e.repartition("day").write.partitionBy("day").parquet(path)
    W.drop_before(s, path, "day", "2024-01-11")
    if W.drop_before(s, path, "day", "2024-01-11"):
        raise RuntimeError("partitions that were dropped are still there")
    return W.load(s, path, e).select("event_id")


@query("u16_backup_accumulate", """SELECT coalesce(n.id, o.id) AS id, coalesce(n.v, o.v) AS v FROM (SELECT id, points AS v FROM {art} WHERE status <> 'new') o
  FULL JOIN (SELECT id, CASE WHEN id % 3 > 0 THEN trend END AS v FROM {art} WHERE lang = 'en') n ON n.id = o.id WHERE coalesce(n.id, o.id) NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def u16(s: SparkSession, d: str) -> DataFrame:
    """A backup that remembers: new rows are merged over the remembered ones, null takes nothing away, removed ids go. Each step runs twice."""
    a, path, bucket = articles(s, d), new_path(s, "u16"), F.pmod(F.xxhash64("id"), F.lit(16)).alias("bucket")
    old = a.where("status <> 'new'").select("id", c("points").alias("v"), bucket)
    new = a.where("lang = 'en'").select("id", F.when(c("id") % 3 > 0, c("trend")).alias("v"), bucket)
    gone = load(s, d, "labels").where("toxic = 1").select(c("doc_id").alias("id"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("gone"), bucket).distinct()
    W.merge(path, old, ["id"], "bucket", label="u16")
    for _ in range(2):
        W.merge(path, new, ["id"], "bucket", label="u16", keep_old=["v"])
    for _ in range(2):
        W.merge(path, gone, ["id"], "bucket", gone="gone", label="u16")
    return W.load(s, path, old).select("id", "v")


@query("k16_archive_append", """SELECT story_id, max(published_at) AS last_at, count(*) AS n, max(published_at) >= TIMESTAMP '2024-01-10 00:00:00' AS late FROM {art} a GROUP BY story_id
  HAVING max(published_at) < TIMESTAMP '2024-01-20 00:00:00'""")
def k16(s: SparkSession, d: str) -> DataFrame:
    """Stories that leave the window are appended to an archive, by their day; a run over a longer past finds some there already and adds the others."""
    g = articles(s, d).groupBy("story_id").agg(F.max("published_at").alias("last_at"), F.count("*").alias("n"))
    g, path = settle(g.withColumns({"late": c("last_at") >= F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"), "day": F.to_date("last_at")}), "k16"), new_path(s, "k16")
    for end in ("2024-01-10", "2024-01-20", "2024-01-20"):
        W.merge(path, g.where(c("last_at") < F.expr(f"TIMESTAMP_NTZ '{end} 00:00:00'")), ["story_id", "day"], "day", label="k16")
    return W.load(s, path, g).drop("day")


@query("u14_revisions", """WITH log AS (
  SELECT id, 1 AS revision, points AS v, false AS gone FROM {art} WHERE status <> 'new' UNION ALL SELECT id, 2, trend, false FROM {art} WHERE lang = 'en'
  UNION ALL SELECT id, 3, NULL, true FROM {art} WHERE id % 5 = 0 UNION ALL SELECT id, 4, importance, false FROM {art} WHERE id % 10 = 0)
SELECT id, arg_max({'v': v}, revision).v AS v, max(revision) AS revision, arg_max(gone, revision) AS gone FROM log GROUP BY id""")
def u14(s: SparkSession, d: str) -> DataFrame:
    """A reader's copy that follows a log of revisions. The writer of revision 2 finishes after that of 3, which the reader has seen by then: it looks back
    over one revision in flight, and reads 3 and 4 twice."""
    a, path = articles(s, d), new_path(s, "u14")
    rows = lambda which, v, gone=False: a.where(which).select("id", F.lit(v).cast("long").alias("v") if v is None else c(v).cast("long").alias("v"), F.lit(gone).alias("gone"))
    revisions = {1: rows("status <> 'new'", "points"), 2: rows("lang = 'en'", "trend"), 3: rows("id % 5 = 0", None, True), 4: rows("id % 10 = 0", "importance")}
    copy = s.createDataFrame([], revisions[1].withColumn("revision", F.lit(0).cast("long")).schema)
    watermark = 0
    for written in ((1,), (3,), (2, 4), (4,)):
        for revision in written:
            W.record(path, revisions[revision], revision)
        copy = settle(W.follow(copy, W.since(s, path, revisions[1], watermark, 1), ["id"]), "u14-copy")
        watermark = max(watermark, *written)
    return copy.select("id", "v", "revision", "gone")
