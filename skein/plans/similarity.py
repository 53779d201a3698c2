"""Queries of fingerprints and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.bind import articles, load
from skein.functions import text as T
from skein.operators import similarity as S
from skein.registry import query
from skein.shared import settle

c = F.col
_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP) + ")"
_PRINT = f"""SELECT id, CAST(sum(CASE WHEN votes > 0 THEN CASE WHEN i = 63 THEN -9223372036854775808 ELSE CAST(1 AS HUGEINT) << i END ELSE 0 END) AS BIGINT) AS h FROM (
  SELECT id, i, sum(CASE WHEN (('0x' || substr(md5(pair), 17, 16))::UBIGINT >> i) & 1 = 1 THEN 1 ELSE -1 END) AS votes FROM (
    SELECT id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) WHEN len(w) = 1 THEN w ELSE [''] END) AS pair FROM (
      SELECT id, list_filter(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9''+.-]*'), lambda x: x NOT IN {_STOP}) AS w FROM {{art}})), range(64) r(i) GROUP BY id, i) GROUP BY id"""


def prints(s: SparkSession, d: str) -> DataFrame:
    return S.fingerprints(articles(s, d).select("id", "title"), "id", c("title"))


@query("f14_simhash", _PRINT)
def f14(s: SparkSession, d: str) -> DataFrame:
    return prints(s, d)


@query("f15_hamming", f"SELECT id, bit_count(xor(h, 81985529216486895)) AS apart FROM ({_PRINT})")
def f15(s: SparkSession, d: str) -> DataFrame:
    return prints(s, d).select("id", F.bit_count(c("h").bitwiseXOR(F.lit(81985529216486895))).alias("apart"))


@query("j13_near_duplicate_titles", f"""WITH k AS (SELECT h, min(id) AS rep FROM ({_PRINT}) GROUP BY h) SELECT x.rep AS a, y.rep AS b, bit_count(xor(x.h, y.h)) AS apart FROM k x JOIN k y ON x.rep < y.rep AND bit_count(xor(x.h, y.h)) <= 10""")
def j13(s: SparkSession, d: str) -> DataFrame:
    return S.near_pairs(settle(prints(s, d), "j13"), "id")


@query("j13_title_classes", f"""WITH p AS ({_PRINT}) SELECT x.id, (SELECT min(y.id) FROM p y WHERE y.h = x.h) AS rep, (SELECT count(*) FROM p y WHERE y.id <> x.id AND bit_count(xor(x.h, y.h)) <= 10) AS n_links FROM p x""")
def j13_classes(s: SparkSession, d: str) -> DataFrame:
    """Every title with the one that stands for its fingerprint in j13_near_duplicate_titles' pairs, and its number of near titles."""
    p = settle(prints(s, d), "j13")
    return S.members(p, S.near_pairs(p, "id"), "id")


@query("f18_cosine_to_next", "SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f18(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    n = e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(T.dot(c("embedding"), c("other")), 5).alias("cosine"))


@query("f20_token_jaccard", "SELECT a.id, round(len(list_intersect(a.w, b.w)) * 1.0 / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 6) AS jaccard FROM (SELECT id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9''+.-]*')) AS w FROM {art}) a JOIN (SELECT id - 1 AS id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9''+.-]*')) AS w FROM {art}) b USING (id) WHERE len(list_concat(a.w, b.w)) > 0")
def f20(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d).select("id", T.tokens(c("title")).alias("w"))
    b = a.select((c("id") - 1).alias("id"), c("w").alias("v"))
    return a.join(b, "id").where("size(w) + size(v) > 0").select("id", F.round(T.jaccard(c("w"), c("v")), 6).alias("jaccard"))


@query("j14_similar_pairs_of_a_label", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND b.vec_id - a.vec_id <= 168 AND list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3")
def j14(s: SparkSession, d: str) -> DataFrame:
    """Pairs within 168 hours and a shared label: rows meet by (label, week) and by the next week, so that no label makes all its pairs."""
    e = load(s, d, "embeddings").select("vec_id", "label", "embedding", F.floor(c("vec_id") / 168).alias("week"))
    x = e.select(c("vec_id").alias("a"), "label", c("embedding").alias("v"), F.explode(F.array("week", c("week") + 1)).alias("week"))
    y = e.select(c("vec_id").alias("b"), "label", c("embedding").alias("w"), "week")
    cosine = T.dot(c("v"), c("w"))
    return x.join(y, ["label", "week"]).where((c("a") < c("b")) & (c("b") - c("a") <= 168)).select("a", "b", cosine.alias("x")).where("x >= 0.3").select("a", "b", F.round("x", 5).alias("cosine"))


_MEAN = """(SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


@query("a54_mean_vectors", f"SELECT label, CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS m FROM (SELECT label, unnest(range(1, len(mean) + 1)) AS i, unnest(mean) / sqrt(list_dot_product(mean, mean)) AS m FROM {_MEAN})")
def a54(s: SparkSession, d: str) -> DataFrame:
    m = S.mean_vectors(load(s, d, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("mean").alias("i", "m")).select("label", "i", F.round("m", 6).alias("m"))


@query("a55_centroid_ranking", f"SELECT label, vec_id, CAST(r AS INTEGER) AS place FROM (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY round(list_dot_product(CAST(e.embedding AS DOUBLE[]), m.mean) / sqrt(list_dot_product(m.mean, m.mean)), 9) DESC, e.vec_id) AS r FROM embeddings e JOIN {_MEAN} m USING (label)) WHERE r <= 40")
def a55(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "embeddings")
    near = e.join(S.mean_vectors(e, "label", "embedding"), "label").select("label", "vec_id", F.round(T.dot(c("embedding"), c("mean")), 9).alias("x"))
    return near.select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("x"), "vec_id")).alias("place")).where("place <= 40")
