"""Queries of sinks that are read back, sources by kind, nearest-neighbour joins, selection by several rules and streams with anchors (K, S, J, O, T, W rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.bind import articles, entities, events, load
from skein.functions import text as T
from skein.functions import vectors
from skein.operators import similarity as S
from skein.plans.ordered import _ANCHORS
from skein.plans.readers import _WAVE, _wave
from skein.plans.selection import _STORY, stories
from skein.registry import query
from skein.shared import new_path, settle
from skein.sources import files
from skein.streaming import runs

c = F.col

# -- feeds and documents: written to the shared folder and read back --------------------------------------------------------------------------


def _escaped(text: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = f"replace({text}, '{raw}', '{safe}')"
    return text


_RSS = f"'<item><title>' || {_escaped('title')} || '</title><link>' || {_escaped('url')} || '</link><guid>' || CAST(id AS VARCHAR) || '</guid><pubDate>' || strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') || '</pubDate></item>'"
_MAP = f"'<url><loc>' || {_escaped('url')} || '</loc><news:publication_date>' || strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') || '</news:publication_date><news:title>' || {_escaped('title')} || '</news:title></url>'"


def _stamp() -> Column:
    return F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rss_item() -> Column:
    return F.concat(F.lit("<item><title>"), T.escape(c("title")), F.lit("</title><link>"), T.escape(c("url")), F.lit("</link><guid>"), c("id").cast("string"), F.lit("</guid><pubDate>"), _stamp(), F.lit("</pubDate></item>"))


def sitemap_entry() -> Column:
    return F.concat(F.lit("<url><loc>"), T.escape(c("url")), F.lit("</loc><news:publication_date>"), _stamp(), F.lit("</news:publication_date><news:title>"), T.escape(c("title")), F.lit("</news:title></url>"))


def written(rows: DataFrame, label: str) -> DataFrame:
    """rows as JSON lines in the shared folder, read back from there."""
    path = new_path(rows.sparkSession, label)
    rows.write.json(path)
    return files.read(rows.sparkSession, path, rows.schema, "json")


@query("k03_card_rss", f"SELECT id, {_RSS} AS item FROM {{art}} WHERE content_type = 'guide' ORDER BY published_at DESC, id LIMIT 50")
def k03(s: SparkSession, d: str) -> DataFrame:
    return written(articles(s, d).where("content_type = 'guide'").orderBy(F.desc("published_at"), "id").limit(50).select("id", rss_item().alias("item")), "k03")


@query("k05_news_sitemap", f"SELECT id, {_MAP} AS entry FROM {{art}} WHERE status = 'published' AND n_chars >= 500 AND published_at > TIMESTAMP '2024-01-29 00:00:00' ORDER BY published_at DESC, id LIMIT 1000")
def k05(s: SparkSession, d: str) -> DataFrame:
    fresh = (c("status") == "published") & (c("n_chars") >= 500) & (c("published_at") > F.expr("TIMESTAMP_NTZ '2024-01-29 00:00:00'"))
    return written(articles(s, d).where(fresh).orderBy(F.desc("published_at"), "id").limit(1000).select("id", sitemap_entry().alias("entry")), "k05")


@query("k07_story_markdown", """SELECT story_id, '# ' || arg_min(title, id) || chr(10) || chr(10) || arg_min(text, id) || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || string_agg('- [' || domain || '](' || url || ')', chr(10) ORDER BY id) AS doc FROM {art} GROUP BY 1""")
def k07(s: SparkSession, d: str) -> DataFrame:
    """A document per story: the lead's title and whole text, then its sources."""
    a = articles(s, d).groupBy("story_id").agg(F.min_by(F.struct("title", "text"), "id").alias("lead"), F.array_sort(F.collect_list(F.struct("id", "domain", "url"))).alias("xs"))
    sources = F.array_join(F.transform("xs", lambda x: F.concat(F.lit("- ["), x["domain"], F.lit("]("), x["url"], F.lit(")"))), "\n")
    return written(a.select("story_id", F.concat(F.lit("# "), c("lead.title"), F.lit("\n\n"), c("lead.text"), F.lit("\n\n## Sources\n\n"), sources).alias("doc")), "k07")


@query("k08_feed_slices", f"SELECT category, r AS place, {_RSS} AS item FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY published_at DESC, id) AS r FROM {{art}} WHERE status = 'published') WHERE r <= 12")
def k08(s: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("published_at"), "id"))
    top = articles(s, d).where("status = 'published'").withColumn("r", r).where("r <= 12")
    return written(top.select("category", c("r").alias("place"), rss_item().alias("item")), "k08")


@query("k10_encrypted_payload", "SELECT id, title AS opened, md5(text) AS text_md5 FROM {art}")
def k10(s: SparkSession, d: str) -> DataFrame:
    """Titles and texts sealed under a passphrase's key, written, read back and opened."""
    key = files.derived_key("correct horse", b"k10")
    path = new_path(s, "k10")
    articles(s, d).select("id", files.sealed(c("title"), key).alias("title"), files.sealed(c("text"), key).alias("text")).write.parquet(path)
    back = s.read.parquet(path)
    return back.select("id", files.opened(c("title"), key).alias("opened"), F.md5(files.opened(c("text"), key)).alias("text_md5"))


def _backup(s: SparkSession, d: str, label: str) -> tuple[str, DataFrame]:
    path = new_path(s, label)
    return path, files.export({t: load(s, d, t) for t in ("customer", "labels", "nation", "pages")}, path, "correct horse")


@query("k11_encrypted_backup", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'pages', count(*) FROM pages")
def k11(s: SparkSession, d: str) -> DataFrame:
    return _backup(s, d, "k11")[1].select("name", "n")


@query("k12_restored_tables", "SELECT 'customer' AS name, c_custkey AS id, c_name || '|' || CAST(c_nationkey AS VARCHAR) || '|' || CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) AS row FROM customer UNION ALL SELECT 'pages', page_id, url || '|' || md5(html) FROM pages")
def k12(s: SparkSession, d: str) -> DataFrame:
    """What an export gives back."""
    back = files.restore(s, _backup(s, d, "k12")[0], "correct horse")
    customer = back["customer"].select(F.lit("customer").alias("name"), c("c_custkey").alias("id"), F.concat_ws("|", "c_name", c("c_nationkey").cast("string"), F.round(c("c_acctbal") * 100).cast("long").cast("string")).alias("row"))
    return customer.unionByName(back["pages"].select(F.lit("pages").alias("name"), c("page_id").alias("id"), F.concat_ws("|", "url", F.md5("html")).alias("row")))


# -- sources by kind, documents with a fallback, configuration, caches ------------------------------------------------------------------------


@query("s07_sources_by_kind", "SELECT source_key, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM (SELECT CASE s_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source_key, s_suppkey FROM supplier) GROUP BY 1")
def s07(s: SparkSession, d: str) -> DataFrame:
    """Suppliers split over a JSON, a CSV and a Parquet source, each read by its own kind; a missing source has no rows."""
    rows = load(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    sources = []
    for i, (key, kind) in enumerate((("a", "json"), ("b", "csv"), ("c", "parquet"))):
        path = new_path(s, f"s07-{key}")
        rows.where(c("s_nationkey") % 3 == i).write.format(kind).save(path)
        sources.append({"key": key, "kind": kind, "path": path})
    sources.append({"key": "gone", "kind": "json", "path": new_path(s, "s07-gone"), "missing_ok": True})
    return files.read_sources(s, sources, rows.schema).groupBy("source_key").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))


@query("s19_json_scan", "SELECT id, category, points FROM {art}")
def s19(s: SparkSession, d: str) -> DataFrame:
    """Documents read under a schema; those of a file that isn't there are none."""
    rows = articles(s, d).select("id", "category", "points")
    return written(rows, "s19").unionByName(files.read(s, new_path(s, "s19-gone"), rows.schema, "json", missing_ok=True))


@query("s21_config_scan", "SELECT n_name AS country, r_name AS region, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def s21(s: SparkSession, d: str) -> DataFrame:
    """A lookup kept as a JSON document, a line a key, joined to the counts of the large table."""
    config = written(load(s, d, "nation").join(load(s, d, "region"), c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").alias("key"), c("n_name").alias("country"), c("r_name").alias("region")), "s21")
    n = load(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return config.join(n, c("key") == c("c_nationkey"), "left").select("country", "region", F.coalesce("n", F.lit(0)).alias("customers"))


@query("t21_cached_aggregate", "SELECT tz, count(*) AS n, count(DISTINCT who) AS visitors FROM {ev} GROUP BY 1")
def t21(s: SparkSession, d: str) -> DataFrame:
    """The zones' counts through a cache of one hour: made once, then read, then made again for a later clock."""
    folder = new_path(s, "t21")
    make = lambda: events(s, d).groupBy("tz").agg(F.count("*").alias("n"), F.count_distinct("who").alias("visitors"))
    files.cached(s, folder, make, "2024-01-31 00:00:00", 1)
    files.cached(s, folder, make, "2024-01-31 00:30:00", 1)
    return files.cached(s, folder, make, "2024-01-31 02:00:00", 1)


@query("t19_changes_in_flight", "WITH w AS (SELECT coalesce(min(id) FILTER (status = 'new' AND created_at >= TIMESTAMP '2024-01-30 00:00:00'), max(id) + 1) AS mark FROM {art}) SELECT id, status FROM {art}, w WHERE id < mark AND id >= mark - 500")
def t19(s: SparkSession, d: str) -> DataFrame:
    """Changes up to the first revision that is still being written: what lies behind it is read again next time. One row is broadcast."""
    a = articles(s, d)
    open_ = F.when((c("status") == "new") & (c("created_at") >= F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")), c("id"))
    mark = a.agg(F.coalesce(F.min(open_), F.max("id") + 1).alias("mark"))
    return a.join(F.broadcast(mark), (c("id") < c("mark")) & (c("id") >= c("mark") - 500)).select("id", "status")


@query("t23_wave_detection", f"""WITH d AS (SELECT day, wave, auto, views FROM ({_WAVE})), w AS (SELECT *, lag(day) OVER (ORDER BY day) AS prev FROM d WHERE wave), i AS (SELECT *, sum(CASE WHEN prev IS NULL OR day - prev > 2 THEN 1 ELSE 0 END) OVER (ORDER BY day) AS island FROM w)
  SELECT max(day) AS day, min(day) AS since, count(*) AS days, CAST(arg_max(auto, day) AS BIGINT) AS automated, arg_max(views, day) - CAST(arg_max(auto, day) AS BIGINT) AS readers FROM i GROUP BY island HAVING max(day) >= (SELECT max(day) FROM d) - 1""", dates="day since")
def t23(s: SparkSession, d: str) -> DataFrame:
    """The wave of automated visits on the last day or the day before: since when, and how many days of it, one quiet day between allowed. The windows see
    a row a day."""
    by = Window.orderBy("day")
    n = settle(_wave(s, d), "t23")
    marked = n.where("wave").withColumn("prev", F.lag("day").over(by))
    marked = marked.withColumn("island", F.sum(F.when(c("prev").isNull() | (F.date_diff("day", "prev") > 2), 1).otherwise(0)).over(by))
    found = marked.groupBy("island").agg(F.max("day").alias("day"), F.min("day").alias("since"), F.count("*").alias("days"), F.max_by("auto", "day").alias("automated"), F.max_by(c("views") - c("auto"), "day").alias("readers"))
    last = n.agg(F.max("day").alias("last"))
    return found.join(F.broadcast(last), c("day") >= F.date_sub("last", 1)).drop("island", "last")


# -- nearest story and thread -----------------------------------------------------------------------------------------------------------------

_VEC = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, vec_id // 168 AS week FROM embeddings)"
_MEANS = f"(SELECT label, week, count(*) AS n, arg_min(v, vec_id) AS lead, min(vec_id) AS story FROM {_VEC} GROUP BY 1, 2)"
_SUMS = f"(SELECT label, week, list(m ORDER BY i) AS mean FROM (SELECT label, week, i, avg(x) AS m FROM (SELECT label, week, unnest(range(len(v))) AS i, unnest(v) AS x FROM {_VEC}) GROUP BY 1, 2, 3) GROUP BY 1, 2)"


@query("j15_nearest_story", f"""WITH s AS (SELECT a.story, a.label, a.week, a.n, a.lead, b.mean FROM {_MEANS} a JOIN {_SUMS} b USING (label, week)),
  p AS (SELECT e.vec_id, s.story, list_dot_product(e.v, s.mean) / sqrt(list_dot_product(s.mean, s.mean)) AS near_mean, list_dot_product(e.v, s.lead) AS near_lead FROM {_VEC} e JOIN s ON s.label = e.label AND s.week = e.week - 1 WHERE s.n < 80)
  SELECT vec_id, story, round(score, 5) AS score FROM (SELECT vec_id, story, least(near_mean, near_lead) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY least(near_mean, near_lead) DESC, story) AS r FROM p WHERE near_mean >= 0.2 AND near_lead >= 0.1) WHERE r = 1""")
def j15(s: SparkSession, d: str) -> DataFrame:
    """For each vector the story of the week before and its label that is nearest by mean and by lead, both over a threshold, if it isn't full: an
    equality join on label and week proposes, map-side maxima choose."""
    e = load(s, d, "embeddings").select("vec_id", "label", c("embedding").cast("array<double>").alias("v"), F.floor(c("vec_id") / 168).alias("week"))
    e = e.withColumn("at", F.concat_ws("-", "label", "week"))
    heads = e.groupBy("at").agg(F.count("*").alias("n"), F.min("vec_id").alias("story"), F.min_by("v", "vec_id").alias("lead"), F.first("label").alias("l"), F.first("week").alias("w"))
    known = heads.join(S.mean_vectors(e, "at", "v"), "at").where("n < 80")
    near = e.join(known, (c("label") == c("l")) & (c("week") == c("w") + 1)).select("vec_id", "story", T.dot(c("v"), c("mean")).alias("a"), T.dot(c("v"), c("lead")).alias("b"))
    fits = near.where("a >= 0.2 AND b >= 0.1").select("vec_id", F.struct(F.least("a", "b").alias("score"), (-c("story")).alias("back")).alias("x"))
    best = fits.groupBy("vec_id").agg(F.max("x").alias("x"))
    return best.select("vec_id", (-c("x.back")).alias("story"), F.round("x.score", 5).alias("score"))


_NAMES = "(SELECT DISTINCT article_id, lower(name) AS name, kind = 'model' AS specific FROM {ent})"


@query("j16_nearest_thread", f"""WITH t AS (SELECT label, week, max(vec_id) AS latest FROM {_VEC} GROUP BY 1, 2 HAVING count(*) < 80),
  p AS (SELECT e.vec_id, t.latest, any_value(list_dot_product(e.v, l.v)) AS near, bool_or(n.specific) AS specific FROM {_VEC} e JOIN t ON t.week = e.week - 1 JOIN {_VEC} l ON l.vec_id = t.latest
    JOIN {_NAMES} n ON n.article_id = e.vec_id JOIN {_NAMES} m ON m.article_id = t.latest AND m.name = n.name GROUP BY 1, 2)
  SELECT vec_id, latest, round(near, 5) AS near FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY near DESC, latest) AS r FROM p WHERE near >= 0.3 OR specific AND near >= 0.1) WHERE r = 1""")
def j16(s: SparkSession, d: str) -> DataFrame:
    """For each story the thread of the week before, of any label, whose latest episode shares a name with it and is nearest, over one threshold or, with
    a specific name shared, a lower one. Names and weeks are the join's keys."""
    e = load(s, d, "embeddings").select("vec_id", "label", c("embedding").cast("array<double>").alias("v"), F.floor(c("vec_id") / 168).alias("week"))
    names = entities(s, d).select("article_id", F.lower("name").alias("name"), (c("kind") == "model").alias("specific")).distinct()
    latest = e.groupBy("label", "week").agg(F.count("*").alias("n"), F.max_by(F.struct("vec_id", "v"), "vec_id").alias("x")).where("n < 80")
    threads = latest.select(c("x.vec_id").alias("latest"), c("x.v").alias("w"), (c("week") + 1).alias("week")).join(names.select(c("article_id").alias("latest"), "name"), "latest")
    told = e.join(names.select(c("article_id").alias("vec_id"), "name", "specific"), "vec_id")
    met = told.join(threads, ["week", "name"]).groupBy("vec_id", "latest").agg(F.first("v").alias("v"), F.first("w").alias("w"), F.bool_or("specific").alias("specific"))
    near = met.select("vec_id", "latest", "specific", T.dot(c("v"), c("w")).alias("near")).where("near >= 0.3 OR specific AND near >= 0.1")
    best = near.groupBy("vec_id").agg(F.max(F.struct("near", (-c("latest")).alias("back"))).alias("x"))
    return best.select("vec_id", (-c("x.back")).alias("latest"), F.round("x.near", 5).alias("near"))


# -- selections, scripts, labels, slugs, packed vectors ---------------------------------------------------------------------------------------

_SHARE = f"""WITH s AS (SELECT st.*, i.importance FROM {_STORY} st JOIN (SELECT story_id, max(importance) AS importance FROM {{art}} WHERE status = 'published' GROUP BY 1) i USING (story_id)),
  b AS (SELECT *, row_number() OVER (ORDER BY score DESC, story_id) AS place FROM s), one AS (SELECT story_id, category, 'briefing' AS kind, row_number() OVER (ORDER BY pub < 2, place) AS r FROM b WHERE place <= 13 QUALIFY r <= 4),
  two AS (SELECT story_id, category, 'work' AS kind, 5 AS r FROM b WHERE category = 'work' AND story_id NOT IN (SELECT story_id FROM one) ORDER BY place LIMIT 1),
  three AS (SELECT story_id, category, 'variety' AS kind, 6 AS r FROM b WHERE importance >= 6 AND category NOT IN (SELECT category FROM one UNION ALL SELECT category FROM two) AND story_id NOT IN (SELECT story_id FROM one UNION ALL SELECT story_id FROM two) ORDER BY importance DESC, score DESC, story_id LIMIT 1),
  had AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three),
  four AS (SELECT story_id, category, 'fill' AS kind, 6 + row_number() OVER (ORDER BY place) AS r FROM b WHERE story_id NOT IN (SELECT story_id FROM had) QUALIFY row_number() OVER (ORDER BY place) <= greatest(0, 5 - (SELECT count(*) FROM had)))
  SELECT story_id, kind FROM had UNION ALL SELECT story_id, kind FROM four"""


@query("o12_share_shortlist", _SHARE)
def o12(s: SparkSession, d: str) -> DataFrame:
    """Five to eight stories to share: four of the briefing, those of two publishers first; one of the work section; one important story of a category that
    isn't there yet; then the best of the rest up to five. Every step is a bounded top-k."""
    top = articles(s, d).where("status = 'published'").groupBy("story_id").agg(F.max("importance").alias("importance"))
    st = settle(stories(s, d).join(top, "story_id").select("story_id", "category", "score", "pub", "importance"), "o12")
    order = [F.desc("score"), c("story_id")]
    pick = lambda rows, n, kind, *by: rows.orderBy(*by).limit(n).select("story_id", "category", F.lit(kind).alias("kind"))
    without = lambda had: st.join(had.select("story_id"), "story_id", "left_anti")
    had = settle(pick(st.orderBy(*order).limit(13), 4, "briefing", c("pub") < 2, *order), "o12-one")
    had = settle(had.unionByName(pick(without(had).where("category = 'work'"), 1, "work", *order)), "o12-two")
    fresh = without(had).where("importance >= 6").join(had.select("category").distinct(), "category", "left_anti")
    had = settle(had.unionByName(pick(fresh, 1, "variety", F.desc("importance"), *order)), "o12-three")
    fill = pick(without(had), max(0, 5 - had.count()), "fill", *order)
    return had.unionByName(fill).select("story_id", "kind")


#: What a spoken briefing says before its first, middle and last stories.
FIRST = ["We start here.", "First today.", "Top of the list.", "We begin with this.", "First up."]
MIDDLE = ["Next,", "Also today,", "Then this.", "Elsewhere,", "Next up,", "Also in the news,", "Moving on,", "There is more.", "Then,", "Also worth knowing,"]
LAST = ["And finally,", "One last story.", "And to finish,", "Last today,"]


def _phrase(phrases: list[str]) -> str:
    return f"[{', '.join(repr(p) for p in phrases)}][1 + ('0x' || substr(md5(CAST(day AS VARCHAR) || '-' || CAST(place AS VARCHAR)), 1, 8))::BIGINT % {len(phrases)}]"


@query("o21_briefing_script", f"""SELECT day, place, CASE WHEN place = 1 THEN {_phrase(FIRST)} WHEN place = n THEN {_phrase(LAST)} ELSE {_phrase(MIDDLE)} END || ' ' || title AS line FROM (
  SELECT CAST(published_at AS DATE) AS day, title, row_number() OVER (PARTITION BY CAST(published_at AS DATE) ORDER BY importance DESC, points DESC, id) AS place, least(8, count(*) OVER (PARTITION BY CAST(published_at AS DATE))) AS n
  FROM {{art}} WHERE status = 'published') WHERE place <= 8""", dates="day")
def o21(s: SparkSession, d: str) -> DataFrame:
    """A day's eight first stories as lines of a spoken briefing; the words before each are chosen by a hash of day and place."""
    per_day = Window.partitionBy("day")
    a = articles(s, d).where("status = 'published'").select(F.to_date("published_at").alias("day"), "title", "importance", "points", "id")
    a = a.withColumn("place", F.row_number().over(per_day.orderBy(F.desc("importance"), F.desc("points"), "id"))).withColumn("n", F.least(F.lit(8), F.count("*").over(per_day))).where("place <= 8")
    h = F.conv(F.substring(F.md5(F.concat_ws("-", c("day").cast("string"), c("place").cast("string"))), 1, 8), 16, 10).cast("long")
    choose = lambda phrases: F.get(F.array(*[F.lit(p) for p in phrases]), (h % len(phrases)).cast("int"))
    said = F.when(c("place") == 1, choose(FIRST)).when(c("place") == c("n"), choose(LAST)).otherwise(choose(MIDDLE))
    return a.select("day", "place", F.concat(said, F.lit(" "), "title").alias("line"))


@query("w20_spread_labels", """SELECT category, day, round(y + least(0, 700 - max(y) OVER (PARTITION BY day)), 4) AS y FROM (SELECT category, day, 13 * place + max(ly - 13 * place) OVER (PARTITION BY day ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM (
  SELECT category, day, ly, row_number() OVER (PARTITION BY day ORDER BY ly, category) AS place FROM (SELECT category, CAST(published_at AS DATE) AS day, avg(points) AS ly FROM {art} GROUP BY 1, 2)))""", dates="day")
def w20(s: SparkSession, d: str) -> DataFrame:
    """Labels of a chart's lines at least thirteen apart: the place of each is a running maximum of what is left when the gaps before it are taken off;
    a stack that outgrows the chart moves up as a whole."""
    ly = articles(s, d).groupBy("category", F.to_date("published_at").alias("day")).agg(F.avg("points").alias("ly"))
    by = Window.partitionBy("day").orderBy("ly", "category")
    placed = ly.withColumn("place", F.row_number().over(by))
    up_to = Window.partitionBy("day").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = placed.withColumn("y", 13 * c("place") + F.max(c("ly") - 13 * c("place")).over(up_to))
    return spread.select("category", "day", F.round(c("y") + F.least(F.lit(0.0), 700 - F.max("y").over(Window.partitionBy("day"))), 4).alias("y"))


@query("x14_unique_slugs", r"""SELECT id, CASE WHEN r = 1 THEN base ELSE regexp_replace(base[1:70], '-+$', '') || '-' || substr(sha1(CAST(id AS VARCHAR)), 1, 6) END AS slug FROM (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS r FROM (
  SELECT id, CASE WHEN trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'story' ELSE regexp_replace(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-')[1:20], '-+$', '') END AS base FROM {art}))""")
def x14(s: SparkSession, d: str) -> DataFrame:
    """The first of a slug keeps it, later ones get the start of a hash: no loop over what is taken."""
    plain = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-|-$", "")
    base = F.when(plain == "", "story").otherwise(F.regexp_replace(F.substring(plain, 1, 20), "-+$", ""))
    a = articles(s, d).select("id", base.alias("base")).withColumn("r", F.row_number().over(Window.partitionBy("base").orderBy("id")))
    marked = F.concat(F.regexp_replace(F.substring("base", 1, 70), "-+$", ""), F.lit("-"), F.substring(F.sha1(c("id").cast("string")), 1, 6))
    return a.select("id", F.when(c("r") == 1, c("base")).otherwise(marked).alias("slug"))


@query("f19_packed_vectors", "SELECT vec_id, CAST(4 + 4 * ceil(len(embedding) * 2 / 3.0) AS INTEGER) AS characters, true AS close FROM embeddings")
def f19(s: SparkSession, d: str) -> DataFrame:
    """Vectors packed and unpacked: characters each takes, and whether every component is back within a thousandth."""
    pack, unpack = F.pandas_udf(vectors.packed, "string"), F.pandas_udf(vectors.unpacked, "array<float>")
    e = load(s, d, "embeddings").select("vec_id", "embedding", pack("embedding").alias("packed"))
    back = e.withColumn("back", unpack("packed"))
    return back.select("vec_id", F.length("packed").alias("characters"), F.forall(F.zip_with("embedding", "back", lambda x, y: F.abs(x - y)), lambda x: x < 1e-3).alias("close"))


@query("x12_story_vectors", "SELECT story, CAST(i AS INTEGER) AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY story)), 6) AS m FROM (SELECT story, i, avg(x) AS m FROM (SELECT vec_id // 5 AS story, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2)")
def x12(s: SparkSession, d: str) -> DataFrame:
    """The mean vector of each story's members at length one, position by position; members without a vector don't count."""
    e = load(s, d, "embeddings").where("embedding IS NOT NULL").select(F.floor(c("vec_id") / 5).alias("story"), "embedding")
    return S.mean_vectors(e, "story", "embedding").select("story", F.posexplode("mean").alias("i", "m")).select("story", "i", F.round("m", 6).alias("m"))


@query("t12_anchored_runs_stream", _ANCHORS)
def t12(s: SparkSession, d: str) -> DataFrame:
    stream = runs.anchored(runs.event_stream(s, d), 29 * 3600)
    told = runs.drained(stream, "t12", "append").withColumn("all", F.max("seen").over(Window.partitionBy("user_id")))
    return told.where("seen = all").groupBy("user_id", "first_us").agg(F.count("*").alias("n"))
