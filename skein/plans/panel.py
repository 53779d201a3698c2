"""Queries of panels, rankings and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.bind import NOW, articles, deals, entities, events, load, prices
from skein.functions import text as T
from skein.registry import query

c = F.col
_at = lambda t: F.expr(f"TIMESTAMP_NTZ '{t}'")


def hours_before(column: Column, now: str = NOW) -> Column:
    return F.timestamp_diff("SECOND", column, _at(now)) / 3600.0


@query("a16_weighted_position", "SELECT o_orderpriority AS query, round(sum(o_totalprice * (o_custkey % 50)) / nullif(sum(o_custkey % 50), 0) / 1000, 6) AS position FROM orders GROUP BY 1")
def a16(s: SparkSession, d: str) -> DataFrame:
    shown = c("o_custkey") % 50
    return load(s, d, "orders").groupBy(c("o_orderpriority").alias("query")).agg(F.round(F.try_divide(F.sum(c("o_totalprice") * shown), F.sum(shown)) / 1000, 6).alias("position"))


@query("a17_queries_with_impressions", "SELECT CAST(o_orderdate AS DATE) AS day, count(DISTINCT o_custkey) AS queries FROM orders WHERE o_custkey % 50 > 0 GROUP BY 1", dates="day")
def a17(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "orders").where("o_custkey % 50 > 0").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count_distinct("o_custkey").alias("queries"))


@query("a18_usage_ledger", "SELECT source AS provider, CAST(sum(CASE WHEN day = DATE '2024-01-30' THEN 1 ELSE 0 END) AS BIGINT) AS today, count(*) AS month, round(max(value), 4) AS most FROM {ev} GROUP BY source")
def a18(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy(c("source").alias("provider")).agg(F.count_if(c("day") == F.lit("2024-01-30").cast("date")).alias("today"), F.count("*").alias("month"), F.round(F.max("value"), 4).alias("most"))


@query("a19_funnel", """SELECT CAST(created_at AS DATE) AS day, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'rejected') AS rejected,
  count(*) FILTER (status = 'overflow') AS overflow, count(*) FILTER (status = 'new') AS waiting FROM {art} GROUP BY 1""", dates="day")
def a19(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d).groupBy(F.to_date("created_at").alias("day"))
    return a.agg(*[F.count_if(c("status") == k).alias(n) for k, n in (("published", "published"), ("rejected", "rejected"), ("overflow", "overflow"), ("new", "waiting"))])


@query("a20_source_week", """SELECT source_key, count(*) AS articles, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (points >= 5) AS discussed
  FROM {art} WHERE created_at >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1""")
def a20(s: SparkSession, d: str) -> DataFrame:
    week = articles(s, d).where(c("created_at") >= _at("2024-01-24 00:00:00"))
    return week.groupBy("source_key").agg(F.count("*").alias("articles"), F.count_if(c("status") == "published").alias("published"), F.count_if(c("status") == "rejected").alias("rejected"), F.count_if(c("points") >= 5).alias("discussed"))


@query("a21_extraction_quality", """SELECT domain, count(*) AS total, count(*) FILTER (n_chars >= 1000) AS whole, round(count(*) FILTER (n_chars >= 1000) * 1.0 / count(*), 6) AS whole_rate,
  CASE WHEN count(*) FILTER (created_at >= TIMESTAMP '2024-01-28 00:00:00') >= 3 THEN round(count(*) FILTER (created_at >= TIMESTAMP '2024-01-28 00:00:00' AND n_chars < 500) * 1.0 / count(*) FILTER (created_at >= TIMESTAMP '2024-01-28 00:00:00'), 6) ELSE -1 END AS recent_bad
  FROM {art} WHERE status <> 'new' GROUP BY domain ORDER BY total DESC, domain LIMIT 25""")
def a21(s: SparkSession, d: str) -> DataFrame:
    recent = c("created_at") >= _at("2024-01-28 00:00:00")
    q = articles(s, d).where("status <> 'new'").groupBy("domain").agg(F.count("*").alias("total"), F.count_if(c("n_chars") >= 1000).alias("whole"), F.count_if(recent).alias("r"), F.count_if(recent & (c("n_chars") < 500)).alias("b"))
    bad = F.when(c("r") >= 3, F.round(F.try_divide("b", "r"), 6)).otherwise(-1.0)
    return q.select("domain", "total", "whole", F.round(c("whole") / c("total"), 6).alias("whole_rate"), bad.alias("recent_bad")).orderBy(F.desc("total"), "domain").limit(25)


@query("a22_freshness_median", "SELECT source_key, CAST(xs[len(xs) // 2 + 1] AS BIGINT) AS minutes FROM (SELECT source_key, list(m ORDER BY m) AS xs FROM (SELECT source_key, epoch(created_at - published_at) / 60 AS m FROM {art}) WHERE m BETWEEN 0 AND 10080 GROUP BY 1)")
def a22(s: SparkSession, d: str) -> DataFrame:
    """The upper median: the element at half the length of the sorted list, found by rank so that a group needs no list."""
    m = articles(s, d).select("source_key", (F.timestamp_diff("SECOND", "published_at", "created_at") / 60).cast("long").alias("m")).where("m BETWEEN 0 AND 10080")
    by = Window.partitionBy("source_key")
    ranked = m.withColumns({"r": F.row_number().over(by.orderBy("m")), "n": F.count("*").over(by)})
    return ranked.where("r = floor(n / 2) + 1").select("source_key", c("m").alias("minutes"))


@query("a24_story_performance", """SELECT story_id, max(importance) AS top, CAST(sum(points) AS BIGINT) AS points, max(trend) AS trend, bool_or(source_type = 'primary') AS has_primary, count(*) AS n FROM {art} WHERE status = 'published' GROUP BY story_id""")
def a24(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).where("status = 'published'").groupBy("story_id").agg(F.max("importance").alias("top"), F.sum("points").alias("points"), F.max("trend").alias("trend"), F.bool_or(c("source_type") == "primary").alias("has_primary"), F.count("*").alias("n"))


@query("a25_top_engaged", "SELECT a.story_id, CAST(sum(e.n) AS BIGINT) AS n FROM (SELECT DISTINCT story_id FROM {art}) a JOIN (SELECT story_id, count(*) AS n FROM {ev} GROUP BY 1) e USING (story_id) GROUP BY 1 ORDER BY n DESC, story_id LIMIT 15")
def a25(s: SparkSession, d: str) -> DataFrame:
    n = events(s, d).groupBy("story_id").agg(F.count("*").alias("n"))
    return n.join(articles(s, d).select("story_id").distinct(), "story_id").select(c("story_id").cast("long"), "n").orderBy(F.desc("n"), "story_id").limit(15)


@query("a26_coverage_by_type", "SELECT story_id, count(*) FILTER (source_type = 'primary') AS first_hand, count(*) FILTER (source_type = 'press') AS press, count(*) FILTER (source_type = 'community') AS community, count(*) FILTER (status = 'overflow') AS overflow FROM {art} GROUP BY 1")
def a26(s: SparkSession, d: str) -> DataFrame:
    kind = lambda k: F.count_if(c("source_type") == k)
    return articles(s, d).groupBy("story_id").agg(kind("primary").alias("first_hand"), kind("press").alias("press"), kind("community").alias("community"), F.count_if(c("status") == "overflow").alias("overflow"))


@query("a27_entity_index", """SELECT kind, key, arg_max(name, (n, -first_id)) AS name, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT kind, lower(name) AS key, name, count(*) AS n, min(article_id) AS first_id FROM {ent} GROUP BY 1, 2, 3) GROUP BY kind, key""")
def a27(s: SparkSession, d: str) -> DataFrame:
    """The most common spelling of each name; of equally common ones the first seen."""
    spelt = entities(s, d).groupBy("kind", F.lower("name").alias("key"), "name").agg(F.count("*").alias("n"), F.min("article_id").alias("first_id"))
    return spelt.groupBy("kind", "key").agg(F.max_by("name", F.struct("n", (-c("first_id")).alias("f"))).alias("name"), F.sum("n").alias("n"))


@query("a28_topic_pages", "SELECT regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS slug, count(DISTINCT story_id) AS stories FROM {ent} GROUP BY 1")
def a28(s: SparkSession, d: str) -> DataFrame:
    return entities(s, d).groupBy(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-").alias("slug")).agg(F.count_distinct("story_id").alias("stories"))


@query("a29_model_rows", """SELECT name AS model, count(DISTINCT source_id) AS sources, min(published_at) AS first_at, arg_min(title, (published_at, id)) AS title FROM {ent} e JOIN {art} a ON e.article_id = a.id WHERE kind = 'model' GROUP BY 1""")
def a29(s: SparkSession, d: str) -> DataFrame:
    joined = entities(s, d).where("kind = 'model'").drop("story_id").join(articles(s, d), c("article_id") == c("id"))
    return joined.groupBy(c("name").alias("model")).agg(F.count_distinct("source_id").alias("sources"), F.min("published_at").alias("first_at"), F.min_by("title", F.struct("published_at", "id")).alias("title"))


@query("a32_majority_vote", """SELECT company, round AS chosen, n FROM (SELECT company, round, n, row_number() OVER (PARTITION BY company ORDER BY n DESC, round = '1-URGENT' DESC, first_day, round) AS r FROM (
  SELECT company, round, count(*) AS n, min(day) AS first_day FROM {deal} GROUP BY 1, 2)) WHERE r = 1""")
def a32(s: SparkSession, d: str) -> DataFrame:
    votes = deals(s, d).groupBy("company", "round").agg(F.count("*").alias("n"), F.min("day").alias("first_day"))
    order = Window.partitionBy("company").orderBy(F.desc("n"), (c("round") == "1-URGENT").desc(), "first_day", "round")
    return votes.withColumn("r", F.row_number().over(order)).where("r = 1").select("company", c("round").alias("chosen"), "n")


@query("a34_reason_histogram", "SELECT CASE WHEN lang <> 'en' THEN 'language ' || lang WHEN n_chars < 400 THEN 'too short' ELSE 'ok' END AS reason, count(*) AS n FROM {art} GROUP BY 1")
def a34(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy(F.when(c("lang") != "en", F.concat(F.lit("language "), "lang")).when(c("n_chars") < 400, "too short").otherwise("ok").alias("reason")).agg(F.count("*").alias("n"))


@query("a35_funding_total", "SELECT year(day) AS year, round(sum(coalesce(amount, 0)) / 1000, 3) AS total, count(*) AS n FROM {deal} GROUP BY 1")
def a35(s: SparkSession, d: str) -> DataFrame:
    return deals(s, d).groupBy(F.year("day").cast("long").alias("year")).agg(F.round(F.sum(F.coalesce("amount", F.lit(0.0))) / 1000, 3).alias("total"), F.count("*").alias("n"))


_SCORE = """SELECT story_id, round(0.20 * coalesce(max(importance), 5) / 10.0 + 0.22 * greatest(pow(0.5, greatest(min(h), 0) * 0 + max(h) / 18.0), 0.5 * pow(0.5, min(h) / 18.0)) * CASE WHEN bool_or(content_type IN ('news', 'product') AND source_type <> 'newsletter') THEN 1.0 ELSE 0.55 END
  + 0.10 * least(1.0, ln(1 + count(*)) / ln(6)) + 0.10 * least(1.0, max(ln(1 + points) + 0.6 * ln(1 + trend)) / 6.0 * (24.0 / greatest(greatest(1.0, max(h)), 6.0)))
  + 0.15 * CASE WHEN max(points) <= 30 THEN 0 ELSE least(1, (log10(1 + max(points)) - log10(31)) / (log10(1001) - log10(31))) END, 5) AS score
  FROM (SELECT *, epoch(TIMESTAMP '2024-01-31 00:00:00' - published_at) / 3600.0 AS h FROM {art}) WHERE status = 'published' GROUP BY story_id"""


def story_scores(a: DataFrame, now: str = NOW) -> DataFrame:
    """Importance, freshness, breadth, velocity and traction of each story's published articles, weighted."""
    h = hours_before(c("published_at"), now)
    g = a.where("status = 'published'").groupBy("story_id").agg(
        F.max("importance").alias("top"), F.max(h).alias("first_h"), F.min(h).alias("last_h"), F.count("*").alias("n"), F.max("points").alias("points"),
        F.max(T.popularity(c("points"), c("trend"))).alias("pop"), F.bool_or(c("content_type").isin("news", "product") & (c("source_type") != "newsletter")).alias("breaking"),
    )
    fresh = F.greatest(T.recency(c("first_h")), 0.5 * T.recency(c("last_h"))) * F.when(c("breaking"), 1.0).otherwise(0.55)
    breadth = F.least(F.lit(1.0), F.log1p("n") / F.log(F.lit(6.0)))
    velocity = F.least(F.lit(1.0), c("pop") / 6.0 * (24.0 / F.greatest(c("first_h"), F.lit(6.0))))
    return g.select("story_id", F.round(0.20 * F.coalesce("top", F.lit(5)) / 10.0 + 0.22 * fresh + 0.10 * breadth + 0.10 * velocity + 0.15 * T.traction(c("points")), 5).alias("score"))


@query("a36_story_score", _SCORE)
def a36(s: SparkSession, d: str) -> DataFrame:
    return story_scores(articles(s, d))


@query("a37_source_performance", """WITH o AS (SELECT avg(points) AS m FROM {art}) SELECT source_key, round(least(2.0, (count(*) * avg(points) + 5 * any_value(m)) / (count(*) + 5) / any_value(m)), 6) AS weight FROM {art}, o GROUP BY source_key""")
def a37(s: SparkSession, d: str) -> DataFrame:
    """Shrunken relative mean, capped at 2: one row of the overall mean is broadcast."""
    a = articles(s, d)
    g = a.groupBy("source_key").agg(F.count("*").alias("n"), F.avg("points").alias("mean"))
    joined = g.join(F.broadcast(a.agg(F.avg("points").alias("m"))))
    return joined.select("source_key", F.round(F.least(F.lit(2.0), (c("n") * c("mean") + 5 * c("m")) / (c("n") + 5) / c("m")), 6).alias("weight"))


@query("a38_discovery_terms", """SELECT key, name, n, weight FROM (SELECT lower(name) AS key, arg_min(name, article_id) AS name, count(DISTINCT article_id) AS n, round(sum(ln(1 + points)), 4) AS weight
  FROM (SELECT DISTINCT e.article_id, e.name, a.points FROM {ent} e JOIN {art} a ON e.article_id = a.id WHERE kind <> 'person') GROUP BY 1) WHERE n >= 2 ORDER BY weight DESC, key LIMIT 8""")
def a38(s: SparkSession, d: str) -> DataFrame:
    e = entities(s, d).where("kind <> 'person'").select("article_id", "name").distinct().join(articles(s, d).select("id", "points"), c("article_id") == c("id"))
    g = e.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "article_id").alias("name"), F.count_distinct("article_id").alias("n"), F.round(F.sum(F.log1p("points")), 4).alias("weight"))
    return g.where("n >= 2").orderBy(F.desc("weight"), "key").limit(8)


@query("a40_pooled_rates", """WITH g AS (SELECT story_id, count(*) FILTER (type = 'view') AS views, count(*) FILTER (type = 'click_source') AS tries FROM {ev} GROUP BY 1), p AS (SELECT sum(tries) * 1.0 / sum(views) AS r FROM g)
  SELECT story_id, round((tries + 20 * r) / (views + 20), 6) AS rate, round(log2((tries + 20 * r) / (views + 20) / r), 6) AS lift FROM g, p""")
def a40(s: SparkSession, d: str) -> DataFrame:
    """Rates with a prior of 20 views at the pooled rate."""
    g = events(s, d).groupBy("story_id").agg(F.count_if(c("type") == "view").alias("views"), F.count_if(c("type") == "click_source").alias("tries"))
    p = g.agg((F.sum("tries") / F.sum("views")).alias("r"))
    rate = (c("tries") + 20 * c("r")) / (c("views") + 20)
    return g.join(F.broadcast(p)).select("story_id", F.round(rate, 6).alias("rate"), F.round(F.log2(rate / c("r")), 6).alias("lift"))


@query("a41_jobs_and_tools", "SELECT content_type AS job, count(*) AS cards, count(DISTINCT source_id) AS tools FROM {art} GROUP BY 1")
def a41(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy(c("content_type").alias("job")).agg(F.count("*").alias("cards"), F.count_distinct("source_id").alias("tools"))


@query("a42_tools_directory", """SELECT source_key, arg_max(title, (published_at, id)) AS newest, arg_max(title, (length(title), -id)) AS longest, min(published_at) AS first_seen, array_to_string(list_sort(list(DISTINCT content_type)), ',') AS kinds FROM {art} GROUP BY 1""")
def a42(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy("source_key").agg(
        F.max_by("title", F.struct("published_at", "id")).alias("newest"), F.max_by("title", F.struct(F.length("title"), -c("id"))).alias("longest"),
        F.min("published_at").alias("first_seen"), F.array_join(F.array_sort(F.collect_set("content_type")), ",").alias("kinds"))


@query("a43_weeks", """SELECT strftime(published_at, '%G-W%V') AS week, count(*) AS n, count(*) FILTER (content_type = 'guide') AS guides, min(id) AS first_id FROM {art} GROUP BY 1""")
def a43(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy(T.iso_week(F.to_date("published_at")).alias("week")).agg(F.count("*").alias("n"), F.count_if(c("content_type") == "guide").alias("guides"), F.min("id").alias("first_id"))


@query("a44_fold_by_tool", """SELECT source_key, id AS best, others FROM (SELECT source_key, id, row_number() OVER (PARTITION BY source_key ORDER BY points DESC, id) AS r, count(*) OVER (PARTITION BY source_key) - 1 AS others FROM {art}) WHERE r = 1""")
def a44(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy("source_key").agg(F.max_by("id", F.struct("points", -c("id"))).alias("best"), (F.count("*") - 1).alias("others"))


@query("a45_source_leaderboard", "SELECT source_key, count(DISTINCT story_id) AS stories, count(*) AS articles FROM {art} WHERE created_at >= TIMESTAMP '2024-01-24 00:00:00' AND status = 'published' GROUP BY 1 ORDER BY stories DESC, articles DESC, source_key LIMIT 25")
def a45(s: SparkSession, d: str) -> DataFrame:
    week = articles(s, d).where((c("created_at") >= _at("2024-01-24 00:00:00")) & (c("status") == "published"))
    return week.groupBy("source_key").agg(F.count_distinct("story_id").alias("stories"), F.count("*").alias("articles")).orderBy(F.desc("stories"), F.desc("articles"), "source_key").limit(25)


@query("a46_key_topics", "SELECT lower(name) AS topic, count(DISTINCT story_id) AS stories FROM {ent} GROUP BY 1 HAVING count(DISTINCT story_id) >= 3 ORDER BY stories DESC, topic LIMIT 20")
def a46(s: SparkSession, d: str) -> DataFrame:
    return entities(s, d).groupBy(F.lower("name").alias("topic")).agg(F.count_distinct("story_id").alias("stories")).where("stories >= 3").orderBy(F.desc("stories"), "topic").limit(20)


@query("a47_week_summary", """SELECT week, publishers, lead FROM (SELECT strftime(published_at, '%G-W%V') AS week, count(DISTINCT domain) AS publishers, arg_max(id, (importance, -id)) AS lead FROM {art} GROUP BY 1)""")
def a47(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy(T.iso_week(F.to_date("published_at")).alias("week")).agg(F.count_distinct("domain").alias("publishers"), F.max_by("id", F.struct("importance", -c("id"))).alias("lead"))


@query("a49_briefing_stats", "SELECT category, count(DISTINCT story_id) AS stories, count(*) AS articles, greatest(3, CAST(round_even(sum(n_chars) / 1380.0, 0) AS BIGINT)) AS minutes FROM {art} WHERE status = 'published' GROUP BY 1")
def a49(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).where("status = 'published'").groupBy("category").agg(F.count_distinct("story_id").alias("stories"), F.count("*").alias("articles"), F.greatest(F.lit(3), F.bround(F.sum("n_chars") / 1380.0, 0)).cast("long").alias("minutes"))


@query("a51_posts_per_day", "SELECT CAST(published_at AS DATE) AS day, least(count(*), 5) AS posts FROM {art} WHERE importance >= 9 GROUP BY 1", dates="day")
def a51(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).where("importance >= 9").groupBy(F.to_date("published_at").alias("day")).agg(F.least(F.count("*"), F.lit(5)).alias("posts"))


@query("a56_ubiquitous_names", "WITH n AS (SELECT count(DISTINCT story_id) AS all_n FROM {ent}) SELECT lower(name) AS name, count(DISTINCT story_id) AS stories FROM {ent}, n GROUP BY 1 HAVING count(DISTINCT story_id) >= 3 AND count(DISTINCT story_id) > 0.06 * any_value(all_n)")
def a56(s: SparkSession, d: str) -> DataFrame:
    e = entities(s, d)
    df = e.groupBy(F.lower("name").alias("name")).agg(F.count_distinct("story_id").alias("stories"))
    return df.join(F.broadcast(e.agg(F.count_distinct("story_id").alias("all_n")))).where("stories >= 3 AND stories > 0.06 * all_n").drop("all_n")


@query("a59_stats_by_method", "SELECT content_type AS method, status, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM {art} GROUP BY 1, 2")
def a59(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy(c("content_type").alias("method"), "status").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("a61_release_fill", "SELECT week, (r - 1) // 20 AS release, count(*) AS n FROM (SELECT strftime(published_at, '%G-W%V') AS week, row_number() OVER (PARTITION BY strftime(published_at, '%G-W%V') ORDER BY id) AS r FROM {art}) GROUP BY 1, 2")
def a61(s: SparkSession, d: str) -> DataFrame:
    week = T.iso_week(F.to_date("published_at")).alias("week")
    r = articles(s, d).select(week, "id").withColumn("r", F.row_number().over(Window.partitionBy("week").orderBy("id")))
    return r.groupBy("week", F.floor((c("r") - 1) / 20).alias("release")).agg(F.count("*").alias("n"))


_HIST = "(SELECT tool, day, obs, line, price, lag(price) OVER (PARTITION BY tool ORDER BY day, obs, line) AS prev FROM {price})"


def history(s: SparkSession, d: str) -> DataFrame:
    return prices(s, d).withColumn("prev", F.lag("price").over(Window.partitionBy("tool").orderBy("day", "obs", "line")))


@query("w06_price_changes", f"SELECT tool, obs, line, CASE WHEN prev IS NULL THEN 'first' WHEN price > prev THEN 'up' WHEN price < prev THEN 'down' ELSE 'same' END AS change FROM {_HIST}")
def w06(s: SparkSession, d: str) -> DataFrame:
    change = F.when(c("prev").isNull(), "first").when(c("price") > c("prev"), "up").when(c("price") < c("prev"), "down").otherwise("same")
    return history(s, d).select("tool", "obs", "line", change.alias("change"))


@query("w07_price_history", f"""SELECT tool, min(day) AS since, max(day) AS checked, any_value(price) AS price, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR prev <> price THEN 1 ELSE 0 END) OVER (PARTITION BY tool ORDER BY day, obs, line) AS island FROM {_HIST}) GROUP BY tool, island""", dates="since checked")
def w07(s: SparkSession, d: str) -> DataFrame:
    """Consecutive equal observations are one entry, whose checked date moves on. An entry ends where the tool's next one starts, so the sorted rows are
    read as they stand: nothing is grouped by entries, which are nearly as many as observations."""
    by = Window.partitionBy("tool").orderBy("day", "obs", "line")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = prices(s, d).select("tool", "day", "obs", "line", "price", F.lag("price").over(by).alias("prev"), F.lag("day").over(by).alias("before"), F.row_number().over(by).cast("long").alias("r"),
                            F.min("day").over(every).alias("first"), F.max("day").over(every).alias("last"), F.count("*").over(every).alias("total"))
    starts = h.where(c("prev").isNull() | (c("prev") != c("price")))
    entry = starts.select("tool", "day", "first", "price", "r", F.coalesce(F.lead("r").over(by), c("total") + 1).alias("next"), F.when(F.lead("r").over(by).isNull(), c("last")).otherwise(F.lead("before").over(by)).alias("checked"))
    since = F.coalesce("day", F.when(c("checked").isNotNull(), c("first")))  # days that are missing come first
    return entry.select("tool", since.alias("since"), "checked", "price", (c("next") - c("r")).alias("n"))


@query("w08_latest_observations", "SELECT tool, obs, line FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY day DESC, obs DESC, line DESC) AS r FROM {price}) WHERE r <= 24")
def w08(s: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("tool").orderBy(F.desc("day"), F.desc("obs"), F.desc("line"))
    return prices(s, d).withColumn("r", F.row_number().over(order)).where("r <= 24").select("tool", "obs", "line")


@query("w09_latest_episode", "SELECT story_id, arg_max(id, (published_at, id)) AS latest, max(published_at) AS at FROM {art} GROUP BY 1")
def w09(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy("story_id").agg(F.max_by("id", F.struct("published_at", "id")).alias("latest"), F.max("published_at").alias("at"))


@query("w16_sidebar_fingerprint", "SELECT id, coalesce(tail = lag(tail) OVER (PARTITION BY domain ORDER BY published_at, id), false) AS repeated FROM (SELECT id, domain, published_at, string_split(text, chr(10))[-1] AS tail FROM {art})")
def w16(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d).select("id", "domain", "published_at", F.element_at(F.split("text", "\n"), -1).alias("tail"))
    return a.select("id", F.coalesce(c("tail") == F.lag("tail").over(Window.partitionBy("domain").orderBy("published_at", "id")), F.lit(False)).alias("repeated"))


@query("w18_pager", "SELECT id, (r - 1) // 60 + 1 AS page, (n + 59) // 60 AS pages FROM (SELECT id, row_number() OVER (PARTITION BY category ORDER BY published_at DESC, id) AS r, count(*) OVER (PARTITION BY category) AS n FROM {art})")
def w18(s: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("category")
    a = articles(s, d).select("id", F.row_number().over(by.orderBy(F.desc("published_at"), "id")).alias("r"), F.count("*").over(by).alias("n"))
    return a.select("id", (F.floor((c("r") - 1) / 60) + 1).alias("page"), F.floor((c("n") + 59) / 60).alias("pages"))


@query("w19_day_navigation", "SELECT category, day, coalesce(lag(day) OVER w, '') AS older, coalesce(lead(day) OVER w, '') AS newer FROM (SELECT DISTINCT category, strftime(published_at, '%Y-%m-%d') AS day FROM {art}) WINDOW w AS (PARTITION BY category ORDER BY day)")
def w19(s: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("category").orderBy("day")
    days = articles(s, d).select("category", F.date_format("published_at", "yyyy-MM-dd").alias("day")).distinct()
    return days.select("category", "day", F.coalesce(F.lag("day").over(by), F.lit("")).alias("older"), F.coalesce(F.lead("day").over(by), F.lit("")).alias("newer"))


@query("w21_stacked_offsets", "SELECT week, category, n, CAST(coalesce(sum(n) OVER (PARTITION BY week ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT strftime(published_at, '%G-W%V') AS week, category, count(*) AS n FROM {art} GROUP BY 1, 2)")
def w21(s: SparkSession, d: str) -> DataFrame:
    n = articles(s, d).groupBy(T.iso_week(F.to_date("published_at")).alias("week"), "category").agg(F.count("*").alias("n"))
    before = Window.partitionBy("week").orderBy("category").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


@query("w22_ema_step", "WITH o AS (SELECT avg(points) AS m FROM {art}) SELECT source_key, round(1.0 + (1 - pow(1 - 0.3, 1.0 / 48)) * (least(2.0, (count(*) * avg(points) + 5 * any_value(m)) / (count(*) + 5) / any_value(m)) - 1.0), 8) AS ema FROM {art}, o GROUP BY 1")
def w22(s: SparkSession, d: str) -> DataFrame:
    step = 1 - 0.7 ** (1 / 48)
    a = articles(s, d)
    g = a.groupBy("source_key").agg(F.count("*").alias("n"), F.avg("points").alias("mean")).join(F.broadcast(a.agg(F.avg("points").alias("m"))))
    weight = F.least(F.lit(2.0), (c("n") * c("mean") + 5 * c("m")) / (c("n") + 5) / c("m"))
    return g.select("source_key", F.round(1.0 + step * (weight - 1.0), 8).alias("ema"))


@query("w13_failure_streak", """SELECT user_id, count(*) AS streak FROM (SELECT user_id, max(CASE WHEN type <> 'search' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM {ev}) WHERE ok = 0 GROUP BY user_id""")
def w13(s: SparkSession, d: str) -> DataFrame:
    """Failures in a row from the newest backwards."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    return events(s, d).withColumn("ok", F.max(F.when(c("type") != "search", 1).otherwise(0)).over(w)).where("ok = 0").groupBy("user_id").agg(F.count("*").alias("streak"))
