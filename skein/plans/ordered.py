"""Queries of ordered operators and learned ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.bind import articles, deals, events, load
from skein.functions import text as T
from skein.operators import ordered as O
from skein.registry import query
from skein.sources import html

c = F.col


@query("x01_online_clusters")
def x01(s: SparkSession, d: str) -> DataFrame:
    """One run within a label and thirty days, without takeovers; x01_clusters_over_runs goes on from run to run."""
    e = load(s, d, "embeddings").select(F.concat_ws("-", "label", F.floor(c("vec_id") / 720)).alias("block"), "vec_id", "embedding")
    return O.greedy_clusters(e, "block", "vec_id", "embedding", 0.3)


@query("x05_deal_folding")
def x05(s: SparkSession, d: str) -> DataFrame:
    return O.fold_deals(deals(s, d))


@query("a33_folded_deals")
def a33(s: SparkSession, d: str) -> DataFrame:
    """Companies' folds with their deals counted and the largest amount."""
    folded = O.fold_deals(deals(s, d)).join(deals(s, d), "deal_id")
    return folded.groupBy("company", "fold").agg(F.count("*").alias("n"), F.max("amount").alias("amount"), F.min("day").alias("first_day"))


_ANCHORS = """WITH RECURSIVE a AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1 UNION ALL SELECT a.user_id, min(e.ts) AS t FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.t + INTERVAL 29 HOUR GROUP BY a.user_id, a.t)
  SELECT user_id, epoch_us(t) AS first_us, count(*) AS n FROM (SELECT e.event_id, e.user_id, max(a.t) AS t FROM events e JOIN a ON a.user_id = e.user_id AND a.t <= e.ts GROUP BY 1, 2) GROUP BY 1, 2"""


@query("x06_anchored_runs", _ANCHORS)
def x06(s: SparkSession, d: str) -> DataFrame:
    g = O.anchored_groups(events(s, d), "user_id", "ts", "event_id", 29 * 60)
    return g.groupBy("user_id", "first_us").agg(F.count("*").alias("n"))


_R = """WITH t AS (SELECT id, importance / 10.0 AS x0, ln(1 + points) / 6.0 AS x1, (doc_quality) AS y FROM (SELECT a.*, CAST(l.quality AS DOUBLE) AS doc_quality FROM {art} a JOIN labels l ON l.doc_id = a.id)), m AS (SELECT avg(y) AS y0 FROM t),
  p AS (SELECT sum(x0 * x0) + 1 AS a, sum(x0 * x1) AS b, sum(x1 * x1) + 1 AS e, sum(x0 * (y - y0)) AS u, sum(x1 * (y - y0)) AS v, any_value(y0) AS y0 FROM t, m)"""


def _features() -> dict:
    return {"importance": c("importance") / 10.0, "points": F.log1p("points") / 6.0}


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).join(load(s, d, "labels"), c("id") == c("doc_id"))


@query("x07_ridge", f"{_R} SELECT 'importance' AS feature, round((e * u - b * v) / (a * e - b * b), 6) AS weight FROM p UNION ALL SELECT 'points', round((a * v - b * u) / (a * e - b * b), 6) FROM p")
def x07(s: SparkSession, d: str) -> DataFrame:
    weights, _ = O.ridge(_labelled(s, d), _features(), c("quality"))
    return s.createDataFrame(list(zip(_features(), weights.tolist(), strict=True)), "feature string, weight double").withColumn("weight", F.round("weight", 6))


@query("x08_prediction", f"{_R} SELECT a.id, round(greatest(0, least(1, y0 + (e * u - b * v) / (a_ * e - b * b) * importance / 10.0 + (a_ * v - b * u) / (a_ * e - b * b) * ln(1 + points) / 6.0)), 6) AS predicted FROM {{art}} a, (SELECT *, a AS a_ FROM p) q".replace("(a_ *", "(q.a *").replace("(SELECT *, a AS a_ FROM p) q", "p q").replace("(e * u - b * v)", "(q.e * q.u - q.b * q.v)").replace("* e - b * b)", "* q.e - q.b * q.b)").replace("* v - b * u)", "* q.v - q.b * q.u)"))
def x08(s: SparkSession, d: str) -> DataFrame:
    weights, mean = O.ridge(_labelled(s, d), _features(), c("quality"))
    return O.predict(articles(s, d), _features(), weights, mean).select("id", F.round("predicted", 6).alias("predicted"))


_F17 = """SELECT id, slot, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM (SELECT id, h % 512 AS slot, sum(CASE WHEN (h // 512) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM (
  SELECT id, ('0x' || substr(md5(g), 25, 8))::BIGINT AS h FROM (SELECT id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) ELSE w END)) AS g FROM (
    SELECT id, regexp_extract_all(lower(title), '[a-z0-9][a-z0-9''+.-]*') AS w FROM {art}))) GROUP BY 1, 2) WHERE x <> 0"""


@query("f17_hashed_embedding", _F17)
def f17(s: SparkSession, d: str) -> DataFrame:
    """Signed, hashed counts of words and word pairs at length one, as (id, slot, x): 512 slots, only those used."""
    words = T.tokens(c("title"))
    grams = articles(s, d).select("id", F.explode(F.concat(words, T.shingles(words))).alias("g"))
    h = F.conv(F.substring(F.md5("g"), 25, 8), 16, 10).cast("long")
    x = grams.groupBy("id", (h % 512).alias("slot")).agg(F.sum(F.when((F.floor(h / 512) % 2) == 0, 1.0).otherwise(-1.0)).alias("x")).where("x <> 0")
    return x.withColumn("x", F.round(c("x") / F.sqrt(F.sum(c("x") * c("x")).over(Window.partitionBy("id"))), 6))


@query("f21_sequence_ratio")
def f21(s: SparkSession, d: str) -> DataFrame:
    """Ratio of matching blocks of a title and the next one, where their tokens overlap at all."""
    a = articles(s, d).select("id", "title", T.tokens(c("title")).alias("w"))
    b = a.select((c("id") - 1).alias("id"), c("title").alias("other"), c("w").alias("v"))

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)])

    near = a.join(b, "id").where(T.jaccard(c("w"), c("v")) >= 0.4)
    return near.select("id", F.round(ratio("title", "other"), 6).alias("ratio"))


@query("x09_article_extraction")
def x09(s: SparkSession, d: str) -> DataFrame:
    """Title, paragraphs and words of each page's article element."""
    return html.extract(load(s, d, "pages").select("page_id", "html"))


@query("x13_row_expander", "SELECT id, CAST(i AS INTEGER) AS i, w[i + 1] AS word FROM (SELECT id, w, unnest(range(0, len(w))) AS i FROM (SELECT id, regexp_extract_all(lower(title), '[a-z0-9][a-z0-9''+.-]*') AS w FROM {art}))")
def x13(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).select("id", F.posexplode(T.tokens(c("title"))).alias("i", "word"))


@query("s08_scan_by_host", "SELECT regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', '') AS host, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1")
def s08(s: SparkSession, d: str) -> DataFrame:
    pages = load(s, d, "pages")
    host = F.regexp_replace(F.regexp_extract("url", "://([^/?#]*)", 1), r"^www\.", "")
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))


@query("a31_majority_amounts")
def a31(s: SparkSession, d: str) -> DataFrame:
    return O.majority_amounts(deals(s, d))


@query("x02_thread_assignment")
def x02(s: SparkSession, d: str) -> DataFrame:
    """Stories are the vectors' rows; their names come from the document of the same id."""
    from skein.bind import entities

    names = entities(s, d).groupBy("article_id").agg(F.collect_set(F.lower("name")).alias("names"), F.collect_set(F.when(c("kind") == "model", F.lower("name"))).alias("specific"))
    e = load(s, d, "embeddings").join(names, c("vec_id") == c("article_id"))
    block = F.floor(c("vec_id") / 720)  # a month of stories, whatever their labels
    return O.assign_threads(e.select(block.alias("block"), c("vec_id").alias("story_id"), "names", "specific", c("embedding").alias("v")), "block", 0.35, 0.2)


@query("x03_first_kept_titles")
def x03(s: SparkSession, d: str) -> DataFrame:
    """Near-duplicate titles of all sources within seven days, the first one kept."""
    from skein.operators import similarity as S

    a = articles(s, d)
    prints = S.fingerprints(a.select("id", "title"), "id", c("title"))
    created = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', created_at)")
    return O.first_kept_of_all(prints.join(a.select("id", created.alias("created")), "id"), "id", "created", "x03")
