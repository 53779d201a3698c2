"""Queries of sorts, top-k, selection policies and sinks (O, K, P19-P33, W03, W15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.bind import NOW, articles, entities, load
from skein.functions import text as T
from skein.plans.panel import _SCORE, story_scores
from skein.registry import query

c = F.col
_AGE = "epoch(TIMESTAMP '2024-01-31 00:00:00' - published_at) / 3600.0"
_STORY = f"(SELECT s.story_id, s.score, a.category, a.n, a.pub, a.first_hand, a.last_at FROM ({_SCORE}) s JOIN (SELECT story_id, any_value(category) AS category, count(*) AS n, count(DISTINCT domain) AS pub, bool_or(source_type = 'primary') AS first_hand, max(published_at) AS last_at FROM {{art}} WHERE status = 'published' GROUP BY 1) a USING (story_id))"


def stories(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d)
    g = a.where("status = 'published'").groupBy("story_id").agg(
        F.any_value("category").alias("category"), F.count("*").alias("n"), F.count_distinct("domain").alias("pub"), F.bool_or(c("source_type") == "primary").alias("first_hand"), F.max("published_at").alias("last_at"))
    return story_scores(a).join(g, "story_id")


@query("o01_queue_limit", f"SELECT a.id FROM {{art}} a JOIN supplier ON source_id = s_suppkey ORDER BY s_acctbal DESC, created_at, a.id LIMIT 120")
def o01(s: SparkSession, d: str) -> DataFrame:
    w = load(s, d, "supplier").select(c("s_suppkey").cast("int").alias("source_id"), "s_acctbal")
    return articles(s, d).join(w, "source_id").orderBy(F.desc("s_acctbal"), "created_at", "id").limit(120).select("id")


@query("o02_newest_and_oldest", "SELECT DISTINCT id FROM (SELECT id FROM (SELECT id FROM {art} ORDER BY published_at DESC, id DESC LIMIT 300) UNION ALL SELECT id FROM (SELECT id FROM {art} ORDER BY published_at, id LIMIT 25))")
def o02(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d).select("id", "published_at")
    return a.orderBy(F.desc("published_at"), F.desc("id")).limit(300).unionByName(a.orderBy("published_at", "id").limit(25)).select("id").distinct()


@query("o03_queue_score", f"SELECT id, round(importance / 10.0 + CASE WHEN source_type = 'primary' THEN 0.5 ELSE 0 END + 0.1 * ln(1 + points) - CASE WHEN regexp_matches(title, '^[0-9]+ ') THEN 0.5 ELSE 0 END, 6) AS score FROM {{art}} WHERE {_AGE} <= 48")
def o03(s: SparkSession, d: str) -> DataFrame:
    age = F.timestamp_diff("SECOND", c("published_at"), F.expr(f"TIMESTAMP_NTZ '{NOW}'")) / 3600.0
    score = c("importance") / 10.0 + F.when(c("source_type") == "primary", 0.5).otherwise(0.0) + 0.1 * F.log1p("points") - F.when(c("title").rlike("^[0-9]+ "), 0.5).otherwise(0.0)
    return articles(s, d).where(age <= 48).select("id", F.round(score, 6).alias("score"))


@query("o04_front_page", f"SELECT story_id, score FROM {_STORY} ORDER BY first_hand DESC, score DESC, story_id LIMIT 50")
def o04(s: SparkSession, d: str) -> DataFrame:
    return stories(s, d).orderBy(F.desc("first_hand"), F.desc("score"), "story_id").limit(50).select("story_id", "score")


@query("o05_briefing_widening", f"""WITH s AS (SELECT *, epoch(TIMESTAMP '2024-01-31 00:00:00' - last_at) / 3600.0 AS h FROM {_STORY}), w AS (SELECT CASE WHEN count(*) FILTER (h <= 48) >= 13 THEN 48 WHEN count(*) FILTER (h <= 72) >= 13 THEN 72 ELSE 96 END AS reach FROM s)
  SELECT story_id, score FROM s, w WHERE h <= reach ORDER BY score DESC, story_id LIMIT 13""")
def o05(s: SparkSession, d: str) -> DataFrame:
    """The narrowest window with thirteen stories: counts first, one row of them, then the filter."""
    h = F.timestamp_diff("SECOND", c("last_at"), F.expr(f"TIMESTAMP_NTZ '{NOW}'")) / 3600.0
    rows = stories(s, d).withColumn("h", h)
    reach = rows.agg(F.when(F.count_if(c("h") <= 48) >= 13, 48).when(F.count_if(c("h") <= 72) >= 13, 72).otherwise(96).alias("reach"))
    return rows.join(F.broadcast(reach)).where("h <= reach").orderBy(F.desc("score"), "story_id").limit(13).select("story_id", "score")


@query("o07_confirmed_first", f"SELECT story_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, story_id) AS r FROM {_STORY}) WHERE r <= 10 AND (first_hand OR pub >= 2)")
def o07(s: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "story_id"))
    return stories(s, d).withColumn("r", r).where("r <= 10 AND (first_hand OR pub >= 2)").select("story_id")


@query("o10_category_week", f"SELECT category, story_id, CAST(r AS INTEGER) AS place FROM (SELECT category, story_id, row_number() OVER (PARTITION BY category ORDER BY n DESC, first_hand DESC, score DESC, story_id) AS r FROM {_STORY}) WHERE r <= 5")
def o10(s: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), F.desc("first_hand"), F.desc("score"), "story_id"))
    return stories(s, d).select("category", "story_id", r.alias("place")).where("place <= 5")


@query("o13_one_per_domain", "SELECT story_id, id FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY importance DESC, points DESC, n_chars DESC, id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY story_id, domain ORDER BY importance DESC, points DESC, n_chars DESC, id) AS r FROM {art}) WHERE r = 1) WHERE k <= 4")
def o13(s: SparkSession, d: str) -> DataFrame:
    order = [F.desc("importance"), F.desc("points"), F.desc("n_chars"), c("id")]
    one = articles(s, d).withColumn("r", F.row_number().over(Window.partitionBy("story_id", "domain").orderBy(*order))).where("r = 1")
    return one.withColumn("k", F.row_number().over(Window.partitionBy("story_id").orderBy(*order))).where("k <= 4").select("story_id", "id")


@query("o15_pick_lead", "SELECT story_id, arg_max(id, (content_type = 'news', importance + CASE WHEN source_type = 'primary' THEN 3 ELSE 0 END, -epoch(published_at), -id)) AS lead FROM {art} GROUP BY 1")
def o15(s: SparkSession, d: str) -> DataFrame:
    key = F.struct((c("content_type") == "news").alias("news"), (c("importance") + F.when(c("source_type") == "primary", 3).otherwise(0)).alias("w"), (-F.unix_seconds(c("published_at").cast("timestamp"))).alias("t"), (-c("id")).alias("i"))
    return articles(s, d).groupBy("story_id").agg(F.max_by("id", key).alias("lead"))


@query("o17_capped_feeds", "SELECT source_key, id FROM (SELECT source_key, id, row_number() OVER (PARTITION BY source_key ORDER BY content_type = 'news' DESC, published_at DESC, id) AS r FROM {art}) WHERE r <= 8")
def o17(s: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("source_key").orderBy((c("content_type") == "news").desc(), F.desc("published_at"), "id"))
    return articles(s, d).withColumn("r", r).where("r <= 8").select("source_key", "id")


@query("o19_every_kth_page", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source_key ORDER BY id) AS r FROM {art}) WHERE r % 7 = 0")
def o19(s: SparkSession, d: str) -> DataFrame:
    """The sampling operator: every seventh row of each source."""
    return articles(s, d).withColumn("r", F.row_number().over(Window.partitionBy("source_key").orderBy("id"))).where("r % 7 = 0").select("id")


@query("o20_first_fitting_sentence", r"""SELECT id, coalesce(list_filter(string_split(regexp_replace(trim(text), '([.!?])[ \n\t\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) BETWEEN 1 AND 60)[1], '') AS said FROM {art}""")
def o20(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).select("id", F.coalesce(F.get(F.filter(T.sentences(c("text")), lambda x: F.length(x) <= 60), F.lit(0)), F.lit("")).alias("said"))


@query("o22_sources_in_order", "SELECT source_key, CAST(row_number() OVER (ORDER BY source_key) AS INTEGER) AS place FROM (SELECT DISTINCT source_key FROM {art})")
def o22(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).select("source_key").distinct().select("source_key", F.row_number().over(Window.orderBy("source_key")).alias("place"))


@query("w03_top_per_category", f"SELECT category, story_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, story_id) AS r FROM {_STORY}) WHERE r <= 12")
def w03(s: SparkSession, d: str) -> DataFrame:
    return stories(s, d).withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "story_id"))).where("r <= 12").select("category", "story_id")


@query("w15_unique_slugs", r"""SELECT id, CASE WHEN r = 1 THEN base ELSE base || '-' || CAST(r AS VARCHAR) END AS slug FROM (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS r FROM (SELECT id, substr(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), 1, 20) AS base FROM {art}))""")
def w15(s: SparkSession, d: str) -> DataFrame:
    base = articles(s, d).select("id", F.substring(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), 1, 20).alias("base"))
    r = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    return base.withColumn("r", r).select("id", F.when(c("r") == 1, c("base")).otherwise(F.concat("base", F.lit("-"), c("r").cast("string"))).alias("slug"))


@query("p19_confirmed_by_announcement", "SELECT story_id, bool_or(source_type = 'primary' AND content_type = 'news') OR count(DISTINCT domain) >= 2 AS confirmed FROM {art} GROUP BY 1")
def p19(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy("story_id").agg((F.bool_or((c("source_type") == "primary") & (c("content_type") == "news")) | (F.count_distinct("domain") >= 2)).alias("confirmed"))


@query("p20_confirmed_by_primary", "SELECT story_id, bool_or(source_type = 'primary') OR count(DISTINCT domain) >= 4 AS confirmed FROM {art} GROUP BY 1")
def p20(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy("story_id").agg((F.bool_or(c("source_type") == "primary") | (F.count_distinct("domain") >= 4)).alias("confirmed"))


@query("p21_research_story", "SELECT story_id, bool_and(source_type = 'research') AS research_only, bool_or(source_type = 'research') AS has_research FROM {art} GROUP BY 1")
def p21(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy("story_id").agg(F.bool_and(c("source_type") == "research").alias("research_only"), F.bool_or(c("source_type") == "research").alias("has_research"))


@query("p26_thin_pages", "SELECT lower(name) AS page, 'topic' AS kind FROM {ent} GROUP BY 1 HAVING count(DISTINCT story_id) < 12 UNION ALL SELECT strftime(published_at, '%Y-%m-%d'), 'day' FROM {art} GROUP BY 1 HAVING count(*) < 2")
def p26(s: SparkSession, d: str) -> DataFrame:
    topics = entities(s, d).groupBy(F.lower("name").alias("page")).agg(F.count_distinct("story_id").alias("n")).where("n < 12").select("page", F.lit("topic").alias("kind"))
    days = articles(s, d).groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("page")).agg(F.count("*").alias("n")).where("n < 2").select("page", F.lit("day").alias("kind"))
    return topics.unionByName(days)


@query("p32_upgrade_eligibility", "SELECT story_id, count(DISTINCT domain) AS sources FROM {art} WHERE status = 'published' GROUP BY 1 HAVING count(DISTINCT domain) >= 2 AND max(importance) >= 6")
def p32(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).where("status = 'published'").groupBy("story_id").agg(F.count_distinct("domain").alias("sources"), F.max("importance").alias("top")).where("sources >= 2 AND top >= 6").drop("top")


@query("p38_single_source_lead", f"SELECT story_id FROM {_STORY} WHERE pub = 1 AND score >= 0.2 AND NOT first_hand")
def p38(s: SparkSession, d: str) -> DataFrame:
    return stories(s, d).where("pub = 1 AND score >= 0.2 AND NOT first_hand").select("story_id")


@query("k01_story_export", """SELECT story_id, count(*) AS article_count, array_to_string(list('{"id":' || CAST(id AS VARCHAR) || ',"domain":"' || domain || '"}' ORDER BY id), ',') AS articles FROM {art} WHERE status = 'published' GROUP BY 1""")
def k01(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d).where("status = 'published'").groupBy("story_id").agg(F.count("*").alias("article_count"), F.array_sort(F.collect_list(F.struct("id", "domain"))).alias("xs"))
    return a.select("story_id", "article_count", F.array_join(F.transform("xs", lambda x: F.to_json(x)), ",").alias("articles"))


@query("k04_podcast_durations", "SELECT id, lpad(CAST(n_chars // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n_chars % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS duration FROM {art}")
def k04(s: SparkSession, d: str) -> DataFrame:
    n = c("n_chars")
    return articles(s, d).select("id", F.format_string("%02d:%02d:%02d", F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60).alias("duration"))


@query("k06_sitemap_plan", """SELECT path, max(lastmod) AS lastmod FROM (SELECT '/story/' || CAST(story_id AS VARCHAR) AS path, published_at AS lastmod, story_id FROM {art} UNION ALL SELECT '/category/' || category, published_at, story_id FROM {art}) p
  WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = p.story_id) GROUP BY path""")
def k06(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d)
    paths = a.select(F.concat(F.lit("/story/"), c("story_id").cast("string")).alias("path"), "published_at", "story_id").unionByName(a.select(F.concat(F.lit("/category/"), "category").alias("path"), "published_at", "story_id"))
    return paths.join(load(s, d, "labels").where("toxic = 1"), c("story_id") == c("doc_id"), "left_anti").groupBy("path").agg(F.max("published_at").alias("lastmod"))


@query("k09_full_text_document", "SELECT story_id, arg_max(text, (source_type = 'primary', n_chars, id)) AS text FROM {art} GROUP BY 1")
def k09(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy("story_id").agg(F.max_by("text", F.struct((c("source_type") == "primary").alias("p"), "n_chars", "id")).alias("text"))


@query("k14_media_release", "SELECT id, strftime(published_at, '%G-W%V') || CASE WHEN r > 60 THEN '-' || CAST((r - 1) // 60 + 1 AS VARCHAR) ELSE '' END AS tag FROM (SELECT id, published_at, row_number() OVER (PARTITION BY strftime(published_at, '%G-W%V') ORDER BY id) AS r FROM {art})")
def k14(s: SparkSession, d: str) -> DataFrame:
    week = T.iso_week(F.to_date("published_at"))
    a = articles(s, d).select("id", week.alias("week")).withColumn("r", F.row_number().over(Window.partitionBy("week").orderBy("id")))
    return a.select("id", F.concat("week", F.when(c("r") > 60, F.concat(F.lit("-"), (F.floor((c("r") - 1) / 60) + 1).cast("string"))).otherwise("")).alias("tag"))


@query("k15_chart_series", "SELECT day, coalesce(n_news, 0) AS news, coalesce(n_guide, 0) AS guide FROM (SELECT strftime(published_at, '%Y-%m-%d') AS day, count(*) FILTER (content_type = 'news') AS n_news, count(*) FILTER (content_type = 'guide') AS n_guide FROM {art} GROUP BY 1)")
def k15(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("day")).pivot("content_type", ["news", "guide"]).count().na.fill(0)
