"""Queries of joins and set operations (J, U, S09-S18, K16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.bind import articles, entities, events, load
from skein.functions import text as T
from skein.registry import query
from skein.shared import settle

c = F.col
_SRC = "(SELECT CAST(s_suppkey AS INTEGER) AS source_id, s_name AS name, s_acctbal AS weight FROM supplier)"


def sources(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "supplier").select(c("s_suppkey").cast("int").alias("source_id"), c("s_name").alias("name"), c("s_acctbal").alias("weight"))


@query("j01_articles_with_sources", f"SELECT a.id, s.name, s.weight FROM {{art}} a JOIN {_SRC} s USING (source_id)")
def j01(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).join(sources(s, d), "source_id").select("id", "name", "weight")


@query("j02_stories_with_articles", "SELECT e.story_id, a.id, e.n FROM (SELECT story_id, count(*) AS n FROM {ev} GROUP BY 1) e JOIN {art} a ON a.story_id = e.story_id")
def j02(s: SparkSession, d: str) -> DataFrame:
    n = events(s, d).groupBy(c("story_id").cast("long").alias("story_id")).agg(F.count("*").alias("n"))
    return n.join(articles(s, d).select("story_id", "id"), "story_id").select(c("story_id").cast("int"), "id", "n")


@query("j03_story_members", "SELECT story_id, array_to_string(list(CAST(id AS VARCHAR) ORDER BY id), ',') AS members, count(*) AS n FROM {art} GROUP BY 1")
def j03(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy("story_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("members"), F.count("*").alias("n"))


@query("j04_lead_article", "SELECT story_id, coalesce(min(CASE WHEN source_type = 'primary' THEN id END), min(id)) AS lead FROM {art} GROUP BY 1")
def j04(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy("story_id").agg(F.coalesce(F.min(F.when(c("source_type") == "primary", c("id"))), F.min("id")).alias("lead"))


@query("j05_source_or_default", f"SELECT a.id, coalesce(s.name, 'unknown') AS name FROM {{art}} a LEFT JOIN (SELECT * FROM {_SRC} WHERE weight > 0) s USING (source_id)")
def j05(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).join(sources(s, d).where("weight > 0"), "source_id", "left").select("id", F.coalesce("name", F.lit("unknown")).alias("name"))


@query("j06_threads_of_two", "SELECT name AS thread, count(DISTINCT story_id) AS stories FROM {ent} WHERE kind = 'company' GROUP BY 1 HAVING count(DISTINCT story_id) >= 2")
def j06(s: SparkSession, d: str) -> DataFrame:
    return entities(s, d).where("kind = 'company'").groupBy(c("name").alias("thread")).agg(F.count_distinct("story_id").alias("stories")).where("stories >= 2")


@query("j07_known_entity_stories", "SELECT DISTINCT name, story_id FROM {ent} e WHERE EXISTS (SELECT 1 FROM {ev} v WHERE v.story_id = e.story_id)")
def j07(s: SparkSession, d: str) -> DataFrame:
    known = events(s, d).select(c("story_id").cast("long").alias("story_id")).distinct()
    return entities(s, d).join(known, "story_id", "left_semi").select("name", "story_id").distinct()


@query("j08_model_pages", "SELECT e.slug, h.n AS hub, count(DISTINCT e.story_id) AS stories FROM (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS slug, story_id FROM {ent} WHERE kind = 'model') e JOIN (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS slug, count(*) AS n FROM {ent} GROUP BY 1) h USING (slug) GROUP BY 1, 2")
def j08(s: SparkSession, d: str) -> DataFrame:
    e = entities(s, d).withColumn("slug", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", ""))
    hub = e.groupBy("slug").agg(F.count("*").alias("hub"))
    return e.where("kind = 'model'").join(hub, "slug").groupBy("slug", "hub").agg(F.count_distinct("story_id").alias("stories"))


@query("j09_full_text_pick", "SELECT story_id, arg_max(id, (source_type = 'primary', published_at, id)) AS pick FROM {art} WHERE n_chars >= 500 GROUP BY 1")
def j09(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).where("n_chars >= 500").groupBy("story_id").agg(F.max_by("id", F.struct((c("source_type") == "primary").alias("p"), "published_at", "id")).alias("pick"))


_REDIRECT = "SELECT DISTINCT story_id AS id, CASE WHEN story_id % 3 = 1 THEN story_id - 1 WHEN story_id % 9 = 3 THEN story_id - 3 WHEN story_id % 27 = 9 THEN story_id - 9 END AS target FROM {art}"


@query("j10_story_redirects", f"""WITH RECURSIVE p AS ({_REDIRECT}), walk AS (SELECT id, target AS pos, 1 AS hops FROM p WHERE target IS NOT NULL UNION ALL
  SELECT w.id, p.target, w.hops + 1 FROM walk w JOIN p ON p.id = w.pos WHERE p.target IS NOT NULL AND w.hops < 10) SELECT id, arg_max(pos, hops) AS root, CAST(max(hops) AS INTEGER) AS hops FROM walk GROUP BY id""")
def j10(s: SparkSession, d: str) -> DataFrame:
    """Parent pointers followed by doubling: four self-joins reach past ten hops."""
    story = c("story_id")
    target = F.when(story % 3 == 1, story - 1).when(story % 9 == 3, story - 3).when(story % 27 == 9, story - 9)
    at = articles(s, d).select("story_id").distinct().select(story.alias("id"), F.coalesce(target, story).alias("root"), F.when(target.isNotNull(), 1).otherwise(0).alias("hops"))
    for _ in range(4):
        up = at.select(c("id").alias("up"), c("root").alias("above"), c("hops").alias("more"))
        at = at.join(up, c("root") == c("up"), "left").select("id", F.coalesce("above", "root").alias("root"), (c("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
    return at.where("root <> id AND hops <= 10")


@query("j11_live_redirects", "SELECT DISTINCT a.id AS old_id FROM {art} a WHERE a.status = 'overflow' AND EXISTS (SELECT 1 FROM {art} b WHERE b.story_id = a.story_id AND b.status = 'published') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.id)")
def j11(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d)
    live = a.where("status = 'published'").select("story_id").distinct()
    return a.where("status = 'overflow'").join(load(s, d, "labels"), c("id") == c("doc_id"), "left_anti").join(live, "story_id", "left_semi").select(c("id").alias("old_id"))


@query("j12_not_posted_yet", "SELECT id FROM {art} a WHERE importance >= 8 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.id AND l.quality = 1)")
def j12(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).where("importance >= 8").join(load(s, d, "labels").where("quality = 1"), c("id") == c("doc_id"), "left_anti").select("id")


@query("j17_latest_row_per_group", "SELECT a.story_id, b.title, b.n_chars FROM (SELECT story_id, arg_max(id, (published_at, id)) AS id FROM {art} GROUP BY 1) a JOIN {art} b USING (id)")
def j17(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).groupBy("story_id").agg(F.max_by(F.struct("title", "n_chars"), F.struct("published_at", "id")).alias("x")).select("story_id", "x.title", "x.n_chars")


@query("j19_weekly_rows", "SELECT a.week, a.n, coalesce(e.n, 0) AS events FROM (SELECT strftime(published_at, '%G-W%V') AS week, count(*) AS n FROM {art} GROUP BY 1) a LEFT JOIN (SELECT strftime(ts, '%G-W%V') AS week, count(*) AS n FROM {ev} GROUP BY 1) e USING (week)")
def j19(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d).groupBy(T.iso_week(F.to_date("published_at")).alias("week")).agg(F.count("*").alias("n"))
    e = events(s, d).groupBy(T.iso_week(c("day")).alias("week")).agg(F.count("*").alias("m"))
    return a.join(e, "week", "left").select("week", "n", F.coalesce("m", F.lit(0)).alias("events"))


@query("j20_window_against_previous", "SELECT n.k, n.n AS now_n, coalesce(p.n, 0) AS before_n, n.n - coalesce(p.n, 0) AS gain FROM (SELECT k, count(*) AS n FROM {ev} WHERE day >= DATE '2024-01-24' GROUP BY 1) n LEFT JOIN (SELECT k, count(*) AS n FROM {ev} WHERE day < DATE '2024-01-24' AND day >= DATE '2024-01-17' GROUP BY 1) p USING (k)")
def j20(s: SparkSession, d: str) -> DataFrame:
    """One pass with two conditional counts in place of the self-join: the left rows are those with a current count."""
    now = c("day") >= F.lit("2024-01-24").cast("date")
    g = events(s, d).where(c("day") >= F.lit("2024-01-17").cast("date")).groupBy("k").agg(F.count_if(now).alias("now_n"), F.count_if(~now).alias("before_n"))
    return g.where("now_n > 0").withColumn("gain", c("now_n") - c("before_n"))


@query("j21_story_event_counts", "SELECT a.story_id, coalesce(e.n, 0) AS n FROM (SELECT DISTINCT story_id FROM {art}) a LEFT JOIN (SELECT story_id, count(*) AS n FROM {ev} GROUP BY 1) e USING (story_id)")
def j21(s: SparkSession, d: str) -> DataFrame:
    n = events(s, d).groupBy(c("story_id").cast("long").alias("story_id")).agg(F.count("*").alias("m"))
    return articles(s, d).select("story_id").distinct().join(n, "story_id", "left").select("story_id", F.coalesce("m", F.lit(0)).alias("n"))


@query("j22_unknown_urls", "SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = p.page_id AND d.n_chars > 1500)")
def j22(s: SparkSession, d: str) -> DataFrame:
    known = load(s, d, "documents").where("n_chars > 1500").select(c("doc_id").alias("page_id"))
    return load(s, d, "pages").join(known, "page_id", "left_anti").select("page_id")


@query("j25_same_title_other_row", "SELECT a.id, min(b.id) AS other FROM {art} a JOIN {art} b ON a.title = b.title AND a.id <> b.id GROUP BY a.id")
def j25(s: SparkSession, d: str) -> DataFrame:
    """Smallest other row of the same title from the title's two smallest ids: no pairs are made."""
    a = articles(s, d).select("id", "title")
    two = a.withColumn("r", F.row_number().over(Window.partitionBy("title").orderBy("id"))).where("r <= 2").groupBy("title").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y")
    return a.join(two, "title").select("id", F.when(c("id") == c("x"), c("y")).otherwise(c("x")).alias("other"))


@query("j27_moderated", "SELECT id, CASE WHEN domain IN ('src3.example.com', 'src9.example.com') THEN 'blocked' WHEN id % 50 = 7 THEN 'unpublished' ELSE status END AS status FROM {art}")
def j27(s: SparkSession, d: str) -> DataFrame:
    blocked = s.createDataFrame([("src3.example.com",), ("src9.example.com",)], "blocked string")
    joined = articles(s, d).join(F.broadcast(blocked), c("domain") == c("blocked"), "left")
    return joined.select("id", F.when(c("blocked").isNotNull(), "blocked").when(c("id") % 50 == 7, "unpublished").otherwise(c("status")).alias("status"))


@query("j28_zone_to_country", "SELECT event_id, coalesce(n_name, 'Unknown') AS country FROM {ev} LEFT JOIN nation ON tz = 'Z' || CAST(n_nationkey AS VARCHAR) AND n_nationkey < 8")
def j28(s: SparkSession, d: str) -> DataFrame:
    zones = load(s, d, "nation").where("n_nationkey < 8").select(F.concat(F.lit("Z"), c("n_nationkey").cast("string")).alias("zone"), "n_name")
    return events(s, d).join(F.broadcast(zones), c("tz") == c("zone"), "left").select("event_id", F.coalesce("n_name", F.lit("Unknown")).alias("country"))


@query("j29_as_of_previous", "SELECT user_id, day, views, coalesce(lag(views) OVER (PARTITION BY user_id ORDER BY day), -1) AS before FROM (SELECT user_id, day, count(*) AS views FROM {ev} WHERE type = 'view' GROUP BY 1, 2)", dates="day")
def j29(s: SparkSession, d: str) -> DataFrame:
    n = events(s, d).where("type = 'view'").groupBy("user_id", "day").agg(F.count("*").alias("views"))
    return n.withColumn("before", F.coalesce(F.lag("views").over(Window.partitionBy("user_id").orderBy("day")), F.lit(-1)))


@query("j30_related_stories", """WITH n AS (SELECT DISTINCT story_id, lower(name) AS name FROM {ent} WHERE kind <> 'person'), d AS (SELECT story_id, max(published_at) AS at, any_value(category) AS category FROM {art} GROUP BY 1),
  w AS (SELECT x.story_id AS a, y.story_id AS b, count(*) AS shared FROM n x JOIN n y ON x.name = y.name AND x.story_id <> y.story_id JOIN d p ON p.story_id = x.story_id JOIN d q ON q.story_id = y.story_id WHERE abs(epoch(p.at - q.at)) <= 15 * 86400 GROUP BY 1, 2),
  r AS (SELECT a, b, round(3 * shared + CASE WHEN p.category = q.category THEN 1 ELSE 0 END - least(abs(epoch(p.at - q.at)) / 86400, 30) / 10, 4) AS weight FROM w JOIN d p ON p.story_id = a JOIN d q ON q.story_id = b)
  SELECT a, b, weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS k FROM r WHERE weight > 0) WHERE k <= 5""")
def j30(s: SparkSession, d: str) -> DataFrame:
    """Three for each shared name, one for the category, less for the days between; five a story, within fifteen days.

    Stories never meet one by one. Those of one set of names, time and category are a cell, of which the six smallest ids can be asked for (one may be the
    asking story itself). A shared name more outweighs category and days together, so a cell looks at the sets of names that share most, down to
    the level at which its period of fifteen days has six stories. Sets of names meet by name; cells of two sets in neighbouring periods."""
    span, best = 15 * 86400, 5
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', max(published_at))")
    story = articles(s, d).groupBy("story_id").agg(at.alias("t"), F.any_value("category").alias("category"))
    named = entities(s, d).where("kind <> 'person'").groupBy("story_id").agg(F.array_sort(F.collect_set(F.lower("name"))).alias("names"))
    named = settle(named.join(story, "story_id").where("size(names) > 0 AND t IS NOT NULL").withColumn("period", F.floor(c("t") / span)), "j30-named")
    sets = settle(named.groupBy("names").agg(F.min("story_id").alias("p")), "j30-sets")
    stories = settle(named.join(sets, "names").drop("names"), "j30-stories")

    each = sets.select("p", F.explode("names").alias("name"))
    shared = each.join(each.withColumnRenamed("p", "q"), "name").groupBy("p", "q").agg(F.count("*").alias("shared"))
    held = stories.groupBy("p", "period").agg(F.count("*").alias("n"))
    near = shared.join(held.select("p", "period"), "p").join(held.withColumnRenamed("p", "q"), ["q", "period"], "left")
    levels = near.groupBy("p", "period", "shared").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("p", "period").orderBy(F.desc("shared")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = levels.withColumn("above", above).where(c("above") <= best).groupBy("p", "period").agg(F.min("shared").alias("least"))
    asked = settle(shared.join(wanted, "p").where("shared >= least").select("p", "q", "period", "shared"), "j30-asked")

    cell = ["p", "t", "category"]
    heads = stories.withColumn("k", F.row_number().over(Window.partitionBy(*cell).orderBy("story_id"))).where(c("k") <= best + 1)
    heads = heads.select(c("p").alias("q"), c("story_id").alias("b"), c("t").alias("tb"), c("category").alias("cb"), F.explode(F.array(c("period") - 1, c("period"), c("period") + 1)).alias("period"))
    met = stories.select(*cell, "period").distinct().join(asked, ["p", "period"]).join(heads, ["q", "period"]).where(F.abs(c("t") - c("tb")) <= span)
    weight = F.round(3 * c("shared") + F.when(c("category") == c("cb"), 1).otherwise(0) - F.abs(c("t") - c("tb")) / 86400 / 10, 4)
    met = met.select(*cell, "b", weight.alias("weight")).withColumn("k", F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("weight"), "b")))
    tops = settle(met.where(c("k") <= best + 1).drop("k").withColumnRenamed("category", "ca"), "j30-tops")
    r = stories.select(c("story_id").alias("a"), *cell).join(tops, ["p", "t"]).where(c("category").eqNullSafe(c("ca")) & (c("a") != c("b"))).select("a", "b", "weight")
    return r.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))).where(c("k") <= best).drop("k")


@query("u01_union_first_wins", "SELECT id, min(place) AS place FROM (SELECT id, 1 AS place FROM {art} WHERE importance >= 9 UNION ALL SELECT id, 2 FROM {art} WHERE points > 900) GROUP BY id")
def u01(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d)
    first, second = a.where("importance >= 9").select("id", F.lit(1).alias("place")), a.where("points > 900").select("id", F.lit(2).alias("place"))
    return first.unionByName(second).groupBy("id").agg(F.min("place").alias("place"))


@query("u02_distinct_pairs", "SELECT DISTINCT source, tz FROM {ev}")
def u02(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("source", "tz").distinct()


@query("u03_shared_names", "SELECT name FROM {ent} e JOIN {art} a ON a.id = e.article_id WHERE lang = 'en' INTERSECT SELECT name FROM {ent} e JOIN {art} a ON a.id = e.article_id WHERE lang = 'fr'")
def u03(s: SparkSession, d: str) -> DataFrame:
    e = entities(s, d).join(articles(s, d).select("id", "lang"), c("article_id") == c("id"))
    return e.where("lang = 'en'").select("name").intersect(e.where("lang = 'fr'").select("name"))


@query("u04_names_left", "SELECT name FROM {ent} EXCEPT SELECT name FROM {ent} WHERE kind = 'person'")
def u04(s: SparkSession, d: str) -> DataFrame:
    e = entities(s, d)
    return e.select("name").subtract(e.where("kind = 'person'").select("name"))


@query("u05_multiset_difference", "SELECT importance, points FROM {art} EXCEPT ALL SELECT importance, points FROM {art} WHERE status = 'rejected'")
def u05(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d)
    return a.select("importance", "points").exceptAll(a.where("status = 'rejected'").select("importance", "points"))


@query("u08_bounded_update", "SELECT id, CASE WHEN r <= 50 THEN '' ELSE title END AS title FROM (SELECT id, title, row_number() OVER (ORDER BY published_at, id) AS r FROM {art} WHERE status = 'rejected')")
def u08(s: SparkSession, d: str) -> DataFrame:
    """Only the 50 oldest rows are cleared: they are found by a bounded top-k, the rest never meets in one task."""
    rejected = articles(s, d).where("status = 'rejected'").select("id", "title", "published_at")
    chosen = rejected.orderBy("published_at", "id").limit(50).select("id", F.lit(True).alias("hit"))
    return rejected.join(F.broadcast(chosen), "id", "left").select("id", F.when(c("hit"), "").otherwise(c("title")).alias("title"))


@query("u09_changed_rows_only", "SELECT id, round(points * 1.0 / 1000, 4) AS score FROM {art} WHERE abs(points * 1.0 / 1000 - trend / 50.0) > 0.25")
def u09(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).where(F.abs(c("points") / 1000 - c("trend") / 50.0) > 0.25).select("id", F.round(c("points") / 1000, 4).alias("score"))


@query("u12_overflow_flip", "SELECT id, CASE WHEN r > 3 THEN 'overflow' ELSE status END AS status FROM (SELECT id, status, row_number() OVER (PARTITION BY story_id ORDER BY importance DESC, id) AS r FROM {art})")
def u12(s: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("importance"), "id"))
    return articles(s, d).select("id", F.when(r > 3, "overflow").otherwise(c("status")).alias("status"))


@query("u15_history_fix_up", "SELECT o.day, o.n AS old_n, n.n AS new_n FROM (SELECT day, count(*) AS n FROM {ev} WHERE type <> 'search' GROUP BY 1) o JOIN (SELECT day, count(*) AS n FROM {ev} GROUP BY 1) n USING (day) WHERE o.n IS DISTINCT FROM n.n", dates="day")
def u15(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).groupBy("day").agg(F.count_if(c("type") != "search").alias("old_n"), F.count("*").alias("new_n"))
    return e.where(~c("old_n").eqNullSafe(c("new_n")))


@query("s09_registry_sync", f"SELECT coalesce(s.source_id, a.source_id) AS source_id, s.source_id IS NOT NULL AS listed, coalesce(a.n, 0) AS articles FROM (SELECT * FROM {_SRC} WHERE source_id <= 30) s FULL JOIN (SELECT source_id, count(*) AS n FROM {{art}} GROUP BY 1) a ON s.source_id = a.source_id")
def s09(s: SparkSession, d: str) -> DataFrame:
    listed = sources(s, d).where("source_id <= 30").select("source_id", F.lit(True).alias("here"))
    n = articles(s, d).groupBy("source_id").agg(F.count("*").alias("n"))
    return listed.join(n, "source_id", "full").select("source_id", F.coalesce("here", F.lit(False)).alias("listed"), F.coalesce("n", F.lit(0)).alias("articles"))


@query("s11_discussion_lookup", "SELECT url_key, arg_max(id, (points, id)) AS link, max(points) AS points FROM (SELECT source_key || '-' || CAST(id % 20 AS VARCHAR) AS url_key, id, points FROM {art} WHERE points >= 5) GROUP BY 1")
def s11(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d).where("points >= 5").select(F.concat("source_key", F.lit("-"), (c("id") % 20).cast("string")).alias("url_key"), "id", "points")
    return a.groupBy("url_key").agg(F.max_by("id", F.struct("points", "id")).alias("link"), F.max("points").alias("points"))


@query("s17_keyed_fetch", "SELECT id, text FROM {art} WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s17(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).join(load(s, d, "labels").where("toxic = 1"), c("id") == c("doc_id"), "left_semi").select("id", "text")


@query("s18_vector_fetch", "SELECT a.id, list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))) IS NOT NULL AS has_vector FROM {art} a JOIN embeddings e ON e.vec_id = a.id")
def s18(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).join(load(s, d, "embeddings"), c("id") == c("vec_id")).select("id", c("embedding").isNotNull().alias("has_vector"))


@query("s25_copy_missing", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s25(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").join(load(s, d, "labels"), "doc_id", "left_anti").select(c("doc_id").alias("id"))
