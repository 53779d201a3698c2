"""Queries of axis steps, price changes and old news."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.bind import articles
from skein.functions import labels as L
from skein.functions import text as T
from skein.plans.panel import history
from skein.plans.text import over_articles
from skein.registry import query

c = F.col

_STEP = """greatest(1.0, CASE WHEN round(raw / p, 9) <= 1 THEN 1 WHEN round(raw / p, 9) <= 2 THEN 2 WHEN round(raw / p, 9) <= 5 THEN 5 ELSE 10 END * p)"""
over_articles("f70_nice_scale", f"""step, step * greatest(1, ceil(round(v / step, 9))) AS most, CASE WHEN points <= 10 THEN 3 WHEN points <= 20 THEN 5 WHEN points <= 50 THEN 6 WHEN points <= 100 THEN 7
    ELSE 1 + CAST(greatest(1, ceil(round(points / step5, 9))) AS INTEGER) END AS rank_ticks
  FROM (SELECT *, {_STEP} AS step, {_STEP.replace('raw', 'raw5').replace(' p', ' p5').replace('/ p,', '/ p5,')} AS step5
    FROM (SELECT *, pow(10, floor(log10(raw))) AS p, pow(10, floor(log10(raw5))) AS p5 FROM (SELECT id, points, greatest(1.0, n_chars) AS v, greatest(1.0, n_chars) / 4 AS raw, greatest(1.0, points) / 5 AS raw5 FROM {{art}})))""",
              lambda: dict(step=L.nice_scale(c("n_chars"))["step"], most=L.nice_scale(c("n_chars"))["most"], rank_ticks=F.size(L.rank_ticks(c("points")))))


_OBS = """(SELECT *, lag(p) OVER w AS p0, lag(cur) OVER w AS cur0, lag(free) OVER w AS free0, lag(obs) OVER w AS was FROM (
  SELECT tool, day, obs, line, CASE WHEN obs % 11 = 0 THEN 0.0 ELSE price END AS p, CASE WHEN obs % 13 = 0 THEN 'EUR' ELSE 'USD' END AS cur, CASE obs % 4 WHEN 0 THEN '' WHEN 1 THEN '3 a day' ELSE '5 a day' END AS free FROM {price})
  WINDOW w AS (PARTITION BY tool ORDER BY day, obs, line))"""


@query("f72_change_kind", f"""SELECT tool, obs, line, CASE WHEN p0 > 0 AND p = 0 OR free0 = '' AND free <> '' THEN 'opened' WHEN cur = cur0 AND p > p0 THEN 'rose' WHEN cur = cur0 AND p < p0 THEN 'fell'
  WHEN free <> free0 THEN 'free' END AS kind FROM {_OBS} WHERE was IS NOT NULL""")
def f72(s: SparkSession, d: str) -> DataFrame:
    """What changed from each price observation of a tool to the next one."""

    seen = F.struct(F.when(c("obs") % 11 == 0, 0.0).otherwise(c("price")).alias("price"), F.when(c("obs") % 13 == 0, "EUR").otherwise("USD").alias("currency"),
                    F.when(c("obs") % 4 == 0, "").when(c("obs") % 4 == 1, "3 a day").otherwise("5 a day").alias("free"))
    rows = history(s, d).select("tool", "day", "obs", "line", seen.alias("new"))
    rows = rows.withColumn("old", F.lag("new").over(Window.partitionBy("tool").orderBy("day", "obs", "line"))).where("old IS NOT NULL")
    return rows.select("tool", "obs", "line", L.change_kind(c("old"), c("new")).alias("kind"))


_STORIES = r"""(SELECT story_id, min(created_at) + to_days(CAST(story_id % 4 * 25 AS INTEGER)) AS first_at, max(published_at) AS newest, arg_min(published_at, (-importance, id)) AS lead_at,
  min(TRY_CAST(nullif(regexp_extract(title, '[\(\[]\s*((19|20)[0-9][0-9])\s*[\)\]]\s*$', 1), '') AS INTEGER)) AS year,
  arg_min(CASE WHEN id % 2 = 0 THEN date_trunc('month', published_at) - INTERVAL 1 MONTH END, (-importance, id)) FILTER (id % 2 = 0) AS month FROM {art} WHERE status IN ('published', 'overflow') GROUP BY story_id)"""


@query("p37_old_news", f"""SELECT story_id, CASE WHEN year < 2024 THEN 'the title says (' || year || ')' WHEN newest < first_at - INTERVAL 10 DAY THEN 'its articles are from ' || strftime(newest, '%d %b %Y')
  WHEN lead_at < first_at - INTERVAL 10 DAY THEN 'the main article is from ' || strftime(lead_at, '%d %b %Y') WHEN month < first_at - INTERVAL 62 DAY THEN 'the article link is dated ' || strftime(month, '%b %Y') END AS reason FROM {_STORIES}""")
def p37(s: SparkSession, d: str) -> DataFrame:
    """Stories with the moment they were first shown, some of them long after their articles, and why they are old."""
    order = F.struct((-c("importance")).alias("i"), "id")
    month = F.when(c("id") % 2 == 0, F.add_months(F.trunc("published_at", "month"), -1).cast("timestamp_ntz"))
    a = articles(s, d).where("status IN ('published', 'overflow')").withColumns({"year": T.title_year(c("title")), "month": month})
    g = a.groupBy("story_id").agg(F.min("created_at").alias("first_at"), F.max("published_at").alias("newest"), F.min_by("published_at", order).alias("lead_at"), F.min("year").alias("year"),
                                  F.min_by("month", F.when(c("id") % 2 == 0, order)).alias("month"))
    first = c("first_at") + F.make_dt_interval(c("story_id").cast("int") % 4 * 25)
    return g.select("story_id", L.old_news(first, F.when(c("year") < 2024, c("year")), c("newest"), c("lead_at"), c("month")).alias("reason"))
