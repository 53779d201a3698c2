"""Queries of the reader analytics (A01-A14, A39, A51-A52, A57, W01-W05, T01-T12 as batch twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.bind import NOW, events
from skein.operators import readers as R
from skein.registry import query

START, UNTIL = "2024-01-08 00:00:00", "2024-01-24 00:00:00"
_PROFILE = """SELECT who, max(tz) AS tz, CAST(sum(CASE WHEN type <> 'view' AND NOT (type = 'dwell' AND value < 10) THEN 1 ELSE 0 END) AS BIGINT) AS acts,
  CAST(sum(CASE WHEN type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS views, max(source) AS src, CAST(sum(CASE WHEN ts >= TIMESTAMP '2024-01-24 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS recent
  FROM {ev} WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY who"""
_ZONES = f"""SELECT tz, count(*) AS visitors, count(*) FILTER (acts = 0 AND views = 1 AND src = 'direct') AS bare, count(*) FILTER (recent > 0) AS visitors_recent,
  count(*) FILTER (acts = 0 AND views = 1 AND src = 'direct' AND recent > 0) AS bare_recent FROM ({_PROFILE}) WHERE views > 0 AND tz IS NOT NULL GROUP BY tz"""
_HEAVY = f"""SELECT tz FROM ({_ZONES}) WHERE (bare >= 5 AND bare >= 0.15 * visitors) OR (bare_recent >= 5 AND bare_recent >= 0.15 * visitors_recent)"""


def _tag(start: str, until: str) -> str:
    return f"""SELECT * FROM (SELECT *, CASE WHEN (type = 'view' OR (type = 'dwell' AND value < 10)) AND tz IN ({_HEAVY})
      AND sum(CASE WHEN type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY who) = 1
      AND sum(CASE WHEN type <> 'view' AND NOT (type = 'dwell' AND value < 10) THEN 1 ELSE 0 END) OVER (PARTITION BY who) = 0
      AND sum(CASE WHEN source <> 'direct' THEN 1 ELSE 0 END) OVER (PARTITION BY who) = 0 THEN 1 ELSE 0 END AS auto
      FROM {{ev}} WHERE ts >= TIMESTAMP '{start}' - INTERVAL 1 DAY AND ts < TIMESTAMP '{until}' + INTERVAL 1 DAY)
      WHERE ts >= TIMESTAMP '{start}' AND ts < TIMESTAMP '{until}'"""


_TAGGED = _tag("2024-01-01 00:00:00", NOW)
_DAILY = f"""SELECT day, count(*) FILTER (type = 'view' AND auto = 0) AS views, count(*) FILTER (type = 'view' AND auto = 1) AS automated,
  count(DISTINCT CASE WHEN type = 'view' AND auto = 0 THEN who END) AS visitors,
  count(DISTINCT CASE WHEN type = 'dwell' AND auto = 0 THEN session || '|' || CAST(story_id AS VARCHAR) END) AS readings,
  count(*) FILTER (type = 'click_source' AND auto = 0) AS clicks, count(*) FILTER (type = 'follow') AS follows, count(*) FILTER (type = 'search') AS searches
  FROM ({_TAGGED}) GROUP BY day"""


def heavy(s: SparkSession, d: str) -> DataFrame:
    return R.bot_heavy_zones(R.zone_counts(R.visitor_profiles(events(s, d), NOW)), share=0.15)


def tagged(s: SparkSession, d: str) -> DataFrame:
    return R.tagged(events(s, d), heavy(s, d), "2024-01-01 00:00:00", NOW)


@query("a03_visitor_profiles", _PROFILE)
def a03(s: SparkSession, d: str) -> DataFrame:
    return R.visitor_profiles(events(s, d), NOW)


@query("a04_zone_visitors", _ZONES)
def a04(s: SparkSession, d: str) -> DataFrame:
    return R.zone_counts(R.visitor_profiles(events(s, d), NOW))


@query("a05_bot_heavy_zones", _HEAVY)
def a05(s: SparkSession, d: str) -> DataFrame:
    return heavy(s, d)


@query("w01_automated_flag", f"SELECT event_id, who, auto FROM ({_TAGGED})")
def w01(s: SparkSession, d: str) -> DataFrame:
    return tagged(s, d).select("event_id", "who", "auto")


@query("w02_automated_flag_padded", f"SELECT event_id, who, auto FROM ({_tag(START, UNTIL)})")
def w02(s: SparkSession, d: str) -> DataFrame:
    return R.tagged(events(s, d), heavy(s, d), START, UNTIL).select("event_id", "who", "auto")


@query("a06_events_by_day_and_type", f"""SELECT day, type, count(*) AS n, round(sum(CASE WHEN auto = 0 THEN value ELSE 0 END), 4) AS value,
  count(DISTINCT CASE WHEN auto = 0 THEN session END) AS sessions, CAST(sum(auto) AS BIGINT) AS automated FROM ({_TAGGED}) GROUP BY day, type""", dates="day")
def a06(s: SparkSession, d: str) -> DataFrame:
    real = F.col("auto") == 0
    return tagged(s, d).groupBy("day", "type").agg(F.count("*").alias("n"), F.round(F.sum(F.when(real, F.col("value")).otherwise(0.0)), 4).alias("value"), F.count_distinct(F.when(real, F.col("session"))).alias("sessions"), F.sum("auto").alias("automated"))


@query("a07_visitors_per_day", "SELECT day, count(DISTINCT coalesce(who, session)) AS visitors FROM {ev} WHERE type = 'view' GROUP BY day", dates="day")
def a07(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).where("type = 'view'").groupBy("day").agg(F.count_distinct(F.coalesce("who", "session")).alias("visitors"))


@query("a08_reading_sessions_per_day", "SELECT day, count(DISTINCT session || '|' || CAST(story_id AS VARCHAR)) AS readings FROM {ev} WHERE type = 'dwell' GROUP BY day", dates="day")
def a08(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).where("type = 'dwell'").groupBy("day").agg(F.count_distinct(F.concat("session", F.lit("|"), F.col("story_id").cast("string"))).alias("readings"))


_NAME = "CASE source WHEN 'direct' THEN 'Direct' WHEN 'bsky.app' THEN 'Bluesky' ELSE 'Google' END"


@query("a09_sources_by_display_name", f"SELECT {_NAME} AS name, count(*) AS views, count(DISTINCT who) AS visitors FROM ({_TAGGED}) WHERE type = 'view' AND auto = 0 GROUP BY 1")
def a09(s: SparkSession, d: str) -> DataFrame:
    from skein.functions.urls import source_name

    return tagged(s, d).where("type = 'view' AND auto = 0").groupBy(source_name(F.col("source")).alias("name")).agg(F.count("*").alias("views"), F.count_distinct("who").alias("visitors"))


@query("a10_top_pages", "SELECT story_id, count(*) AS views, count(DISTINCT who) AS visitors FROM {ev} WHERE type = 'view' GROUP BY story_id ORDER BY views DESC, story_id LIMIT 10")
def a10(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).where("type = 'view'").groupBy("story_id").agg(F.count("*").alias("views"), F.count_distinct("who").alias("visitors")).orderBy(F.desc("views"), "story_id").limit(10)


@query("a11_countries", f"""SELECT coalesce(n_name, 'Unknown') AS country, count(*) FILTER (type = 'view') AS views, count(DISTINCT who) AS visitors, CAST(sum(auto) AS BIGINT) AS automated
  FROM ({_TAGGED}) LEFT JOIN nation ON tz = 'Z' || CAST(n_nationkey AS VARCHAR) AND n_nationkey < 8 GROUP BY 1""")
def a11(s: SparkSession, d: str) -> DataFrame:
    from skein.bind import load

    zones = load(s, d, "nation").where("n_nationkey < 8").select(F.concat(F.lit("Z"), F.col("n_nationkey").cast("string")).alias("zone"), "n_name")
    joined = tagged(s, d).join(F.broadcast(zones), F.col("tz") == F.col("zone"), "left")
    return joined.groupBy(F.coalesce("n_name", F.lit("Unknown")).alias("country")).agg(F.count_if(F.col("type") == "view").alias("views"), F.count_distinct("who").alias("visitors"), F.sum("auto").alias("automated"))


@query("a12_story_events", "SELECT story_id, type, count(*) AS n, round(sum(value), 4) AS value FROM {ev} GROUP BY story_id, type")
def a12(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy("story_id", "type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("a13_read_depth", """SELECT story_id, round(avg(depth), 6) AS depth, count(*) AS readings, count(*) FILTER (stage = 'end') AS ended FROM (
  SELECT session, story_id, max(least(value, 100)) AS depth, CASE WHEN max(value) >= 90 THEN 'end' WHEN max(value) >= 50 THEN 'half' ELSE 'top' END AS stage
  FROM {ev} WHERE type = 'dwell' GROUP BY session, story_id) GROUP BY story_id""")
def a13(s: SparkSession, d: str) -> DataFrame:
    deepest = events(s, d).where("type = 'dwell'").groupBy("session", "story_id").agg(F.max(F.least("value", F.lit(100.0))).alias("depth"), F.max("value").alias("top"))
    stage = F.when(F.col("top") >= 90, "end").when(F.col("top") >= 50, "half").otherwise("top")
    return deepest.groupBy("story_id").agg(F.round(F.avg("depth"), 6).alias("depth"), F.count("*").alias("readings"), F.count_if(stage == "end").alias("ended"))


@query("a14_search_terms", """SELECT 'k' || CAST(k AS VARCHAR) AS term, count(*) AS n, count(DISTINCT who) AS visitors, CAST(arg_max(CAST(floor(value) AS BIGINT), (ts, event_id)) AS BIGINT) AS results
  FROM {ev} WHERE type = 'search' GROUP BY k""")
def a14(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).where("type = 'search'")
    return e.groupBy(F.concat(F.lit("k"), F.col("k").cast("string")).alias("term")).agg(F.count("*").alias("n"), F.count_distinct("who").alias("visitors"), F.max_by(F.floor("value").cast("long"), F.struct("ts", "event_id")).alias("results"))


@query("a15_daily_panel", _DAILY, dates="day")
def a15(s: SparkSession, d: str) -> DataFrame:
    return R.daily_panel(tagged(s, d))


_ENG = """SELECT article_id, sum(CASE type WHEN 'view' THEN 1.0 WHEN 'click_source' THEN 3.0 WHEN 'dwell' THEN 1.0 / 30.0 WHEN 'follow' THEN 2.0 END
   * CASE WHEN type = 'dwell' THEN least(total, 600) ELSE least(coalesce(top, 1), 1) END) AS engagement FROM (
   SELECT article_id, type, session, day, sum(value) AS total, max(value) AS top FROM {ev} WHERE type <> 'search' GROUP BY 1, 2, 3, 4) GROUP BY article_id"""


@query("a01_engagement", f"SELECT article_id, round(engagement, 4) AS engagement FROM ({_ENG})")
def a01(s: SparkSession, d: str) -> DataFrame:
    return R.engagement(events(s, d)).select("article_id", F.round("engagement", 4).alias("engagement"))


@query("a02_engagement_incremental", f"SELECT article_id, round(engagement, 4) AS engagement FROM ({_ENG})")
def a02(s: SparkSession, d: str) -> DataFrame:
    """The count as of a day ago, with only articles that have events since then counted anew: equal to a full count."""
    e = events(s, d)
    before = F.expr("TIMESTAMP_NTZ '2024-01-29 23:00:00'")
    old, changed = R.engagement(e.where(F.col("ts") < before)), e.where(F.col("ts") >= before).select("article_id").distinct()
    fresh = R.engagement(e.join(changed, "article_id", "left_semi"))
    return old.join(changed, "article_id", "left_anti").unionByName(fresh).select("article_id", F.round("engagement", 4).alias("engagement"))


@query("a39_recency_weighted_actions", """SELECT story_id, round(sum(CASE WHEN type = 'click_source' THEN w ELSE 0 END), 6) AS wclicks, round(sum(CASE WHEN type = 'view' THEN w ELSE 0 END), 6) AS wviews,
  count(*) FILTER (type = 'view') AS views FROM (SELECT *, pow(0.5, (floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - ts) / 86400) + 0.5) / 14) AS w FROM {ev}) GROUP BY story_id""")
def a39(s: SparkSession, d: str) -> DataFrame:
    age = F.floor(F.expr("timestampdiff(SECOND, ts, TIMESTAMP_NTZ '2024-01-31 00:00:00')") / 86400)
    w = F.pow(F.lit(0.5), (age + 0.5) / 14)
    return events(s, d).withColumn("w", w).groupBy("story_id").agg(
        F.round(F.sum(F.when(F.col("type") == "click_source", F.col("w")).otherwise(0.0)), 6).alias("wclicks"),
        F.round(F.sum(F.when(F.col("type") == "view", F.col("w")).otherwise(0.0)), 6).alias("wviews"), F.count_if(F.col("type") == "view").alias("views"))


@query("a52_visitor_pairs", """SELECT source, tz, visitors FROM (SELECT source, tz, visitors, row_number() OVER (PARTITION BY source ORDER BY visitors DESC, tz) AS r FROM (
  SELECT source, tz, count(*) AS visitors FROM (SELECT DISTINCT source, tz, who FROM {ev}) GROUP BY source, tz)) WHERE r <= 3""")
def a52(s: SparkSession, d: str) -> DataFrame:
    n = events(s, d).select("source", "tz", "who").distinct().groupBy("source", "tz").agg(F.count("*").alias("visitors"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("visitors"), "tz"))).where("r <= 3").drop("r")


@query("a57_first_event_day", "SELECT type, min(day) AS first_day FROM {ev} GROUP BY type", dates="first_day")
def a57(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy("type").agg(F.min("day").alias("first_day"))


@query("a60_gate_counters", "SELECT day, tz AS country, CASE WHEN value < 1 THEN 'client' WHEN user_id % 13 = 0 THEN 'origin' ELSE 'ok' END AS reason, count(*) AS n FROM {ev} GROUP BY 1, 2, 3", dates="day")
def a60(s: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("value") < 1, "client").when(F.col("user_id") % 13 == 0, "origin").otherwise("ok")
    return events(s, d).groupBy("day", F.col("tz").alias("country"), reason.alias("reason")).agg(F.count("*").alias("n"))


_RANKS = """SELECT story_id, row_number() OVER (ORDER BY views DESC, story_id) AS view_rank, row_number() OVER (ORDER BY dwell DESC, story_id) AS dwell_rank FROM (
  SELECT story_id, count(*) FILTER (type = 'view') AS views, round(sum(CASE WHEN type = 'dwell' THEN value ELSE 0 END), 4) AS dwell FROM {ev} GROUP BY story_id)"""


def _ranks(s: SparkSession, d: str) -> DataFrame:
    """Ranks over one row a story: the ranking needs a total order, the rows are few."""
    n = events(s, d).groupBy("story_id").agg(F.count_if(F.col("type") == "view").alias("views"), F.round(F.sum(F.when(F.col("type") == "dwell", F.col("value")).otherwise(0.0)), 4).alias("dwell"))
    return n.select("story_id", F.row_number().over(Window.orderBy(F.desc("views"), "story_id")).alias("view_rank"), F.row_number().over(Window.orderBy(F.desc("dwell"), "story_id")).alias("dwell_rank"))


@query("w04_rank_positions", f"SELECT story_id, CAST(view_rank AS INTEGER) AS view_rank FROM ({_RANKS})")
def w04(s: SparkSession, d: str) -> DataFrame:
    return _ranks(s, d).select("story_id", "view_rank")


@query("w05_rank_gap", f"SELECT story_id, CAST(view_rank - dwell_rank AS INTEGER) AS gap FROM ({_RANKS}) WHERE view_rank - dwell_rank >= 5")
def w05(s: SparkSession, d: str) -> DataFrame:
    return _ranks(s, d).select("story_id", (F.col("view_rank") - F.col("dwell_rank")).alias("gap")).where("gap >= 5")


@query("w14_movers", f"SELECT story_id, CAST(view_rank - dwell_rank AS INTEGER) AS moved FROM ({_RANKS}) ORDER BY abs(view_rank - dwell_rank) DESC, story_id LIMIT 4")
def w14(s: SparkSession, d: str) -> DataFrame:
    return _ranks(s, d).select("story_id", (F.col("view_rank") - F.col("dwell_rank")).alias("moved")).orderBy(F.abs("moved").desc(), "story_id").limit(4)


@query("t02_time_clamp", """SELECT event_id, CASE WHEN ts IS NULL OR ts > TIMESTAMP '2024-01-15 00:05:00' OR ts < TIMESTAMP '2024-01-14 00:00:00' THEN TIMESTAMP '2024-01-15 00:00:00' ELSE ts END AS at FROM {ev}""")
def t02(s: SparkSession, d: str) -> DataFrame:
    now = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    far = F.col("ts").isNull() | (F.col("ts") > now + F.expr("INTERVAL '5' MINUTE")) | (F.col("ts") < now - F.expr("INTERVAL '1' DAY"))
    return events(s, d).select("event_id", F.when(far, now).otherwise(F.col("ts")).alias("at"))


@query("t03_rate_limit", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS n FROM {ev}""")
def t03(s: SparkSession, d: str) -> DataFrame:
    """Events of a session so far within the period: the unfiltered count, an upper bound of what the limiter stores."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-21600 * 1_000_000, 0)
    return events(s, d).select("event_id", F.count("*").over(w).alias("n"))


@query("t04_known_stories_only", "SELECT event_id FROM {ev} e WHERE EXISTS (SELECT 1 FROM {art} a WHERE a.story_id = e.story_id AND a.status = 'published')")
def t04(s: SparkSession, d: str) -> DataFrame:
    from skein.bind import articles

    return events(s, d).join(articles(s, d).where("status = 'published'").select("story_id").distinct(), "story_id", "left_semi").select("event_id")


@query("t11_once_per_session_and_day", "SELECT article_id, day, count(*) AS n FROM (SELECT DISTINCT article_id, type, session, day FROM {ev}) GROUP BY 1, 2", dates="day")
def t11(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("article_id", "type", "session", "day").distinct().groupBy("article_id", "day").agg(F.count("*").alias("n"))


@query("t15_dwell_by_session", "SELECT session, story_id, round(least(sum(least(value, 3600)), 600), 4) AS dwell FROM {ev} WHERE type = 'dwell' GROUP BY 1, 2")
def t15(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).where("type = 'dwell'").groupBy("session", "story_id").agg(F.round(F.least(F.sum(F.least("value", F.lit(3600.0))), F.lit(600.0)), 4).alias("dwell"))


@query("t17_impressions_capped", "SELECT session, event_id FROM (SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS r FROM {ev} WHERE type = 'view') WHERE r <= 2")
def t17(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session").orderBy("ts", "event_id")
    return events(s, d).where("type = 'view'").withColumn("r", F.row_number().over(w)).where("r <= 2").select("session", "event_id")


_WAVE = """SELECT day, auto, views, auto >= 3 AND auto >= 0.04 * views AS wave FROM (SELECT day, CAST(sum(auto) AS BIGINT) AS auto, count(*) AS views FROM (""" + _TAGGED + """) WHERE type = 'view' GROUP BY day)"""


@query("p44_wave_days", f"SELECT day, wave FROM ({_WAVE})", dates="day")
def p44(s: SparkSession, d: str) -> DataFrame:
    return _wave(s, d).select("day", "wave")


def _wave(s: SparkSession, d: str) -> DataFrame:
    n = tagged(s, d).where("type = 'view'").groupBy("day").agg(F.sum("auto").alias("auto"), F.count("*").alias("views"))
    return n.withColumn("wave", (F.col("auto") >= 3) & (F.col("auto") >= 0.04 * F.col("views")))


@query("w12_wave_spans", f"""SELECT min(day) AS first_day, max(day) AS last_day, CAST(sum(auto) AS BIGINT) AS automated FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR day - prev > 2 THEN 1 ELSE 0 END) OVER (ORDER BY day) AS island FROM (
    SELECT *, lag(day) OVER (ORDER BY day) AS prev FROM ({_WAVE}) WHERE wave)) GROUP BY island""", dates="first_day last_day")
def w12(s: SparkSession, d: str) -> DataFrame:
    """Spans of wave days with at most one quiet day between; one row a day goes through the window."""
    by = Window.orderBy("day")
    days = _wave(s, d).where("wave").withColumn("prev", F.lag("day").over(by))
    island = F.sum(F.when(F.col("prev").isNull() | (F.date_diff("day", "prev") > 2), 1).otherwise(0)).over(by)
    return days.withColumn("island", island).groupBy("island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("auto").alias("automated")).drop("island")


@query("a64_period_deltas", f"""WITH p AS (SELECT 'views' AS metric, CAST(sum(CASE WHEN day >= DATE '2024-01-24' THEN views ELSE 0 END) AS BIGINT) AS now_n,
   CAST(sum(CASE WHEN day < DATE '2024-01-24' AND day >= DATE '2024-01-17' THEN views ELSE 0 END) AS BIGINT) AS before_n FROM ({_DAILY}))
  SELECT metric, now_n, before_n, round(100.0 * (now_n - before_n) / nullif(before_n, 0), 4) AS change FROM p""")
def a64(s: SparkSession, d: str) -> DataFrame:
    day, views = F.col("day"), F.col("views")
    span = lambda a, b: F.sum(F.when((day >= F.lit(a).cast("date")) & (day < F.lit(b).cast("date")), views).otherwise(0))
    p = R.daily_panel(tagged(s, d)).agg(span("2024-01-24", "2024-02-01").alias("now_n"), span("2024-01-17", "2024-01-24").alias("before_n"))
    return p.select(F.lit("views").alias("metric"), "now_n", "before_n", F.round(100.0 * (F.col("now_n") - F.col("before_n")) / F.nullif(F.col("before_n"), F.lit(0)), 4).alias("change"))


@query("w10_period_windows", f"""SELECT day, views, CAST(sum(views) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS last7,
  CAST(coalesce(sum(views) OVER (ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING), 0) AS BIGINT) AS before7 FROM ({_DAILY})""", dates="day")
def w10(s: SparkSession, d: str) -> DataFrame:
    by = Window.orderBy("day")
    return R.daily_panel(tagged(s, d)).select("day", "views", F.sum("views").over(by.rowsBetween(-6, 0)).alias("last7"), F.coalesce(F.sum("views").over(by.rowsBetween(-13, -7)), F.lit(0)).alias("before7"))


@query("p36_since_first", f"SELECT day, follows FROM ({_DAILY}) WHERE day >= (SELECT min(day) FROM ({_DAILY}) WHERE follows > 20)", dates="day")
def p36(s: SparkSession, d: str) -> DataFrame:
    """Leading days before the first with enough follows go."""
    panel = R.daily_panel(tagged(s, d)).select("day", "follows")
    first = panel.where("follows > 20").agg(F.min("day").alias("first_day"))
    return panel.join(F.broadcast(first), F.col("day") >= F.col("first_day")).drop("first_day")


@query("a23_stories_per_day", """SELECT CAST(g AS DATE) AS day, coalesce(n, 0) AS n FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-02', INTERVAL 1 DAY) t(g)
  LEFT JOIN (SELECT CAST(published_at AS DATE) AS day, count(DISTINCT story_id) AS n FROM {art} WHERE status = 'published' GROUP BY 1) ON CAST(g AS DATE) = day""", dates="day")
def a23(s: SparkSession, d: str) -> DataFrame:
    from skein.bind import articles

    days = s.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-02-02')) AS day")
    n = articles(s, d).where("status = 'published'").groupBy(F.to_date("published_at").alias("at")).agg(F.count_distinct("story_id").alias("n"))
    return days.join(n, F.col("day") == F.col("at"), "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
