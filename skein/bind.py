"""The news model's tables as views of the generic tables: reader events, articles, entity edges, deals and price observations.

Each binding has a DataFrame form and the same in SQL. NOW is the fixed reference clock; operators take it as a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"

SQL = {
    "ev": """SELECT *, who || '-' || CAST(hour(ts) // 6 AS VARCHAR) AS session, k // 4 AS story_id, k AS article_id FROM (
        SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
          CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'click_source' WHEN 'purchase' THEN 'dwell' WHEN 'signup' THEN 'follow' ELSE 'search' END AS type,
          CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS who, 'Z' || CAST(user_id % 10 AS VARCHAR) AS tz,
          CASE WHEN user_id % 2 = 0 THEN 'direct' WHEN user_id % 4 = 1 THEN 'bsky.app' ELSE 'google.com' END AS source
        FROM events)""",
    "art": """SELECT doc_id AS id, doc_id // 5 AS story_id, split_part(text, chr(10), 1) AS title, text, lang, n_chars, source AS source_key,
          CAST(substr(source, 4) AS INTEGER) AS source_id, source || '.example.com' AS domain, 'https://www.' || source || '.example.com/a/' || CAST(doc_id AS VARCHAR) || '/?utm_source=x&p=' || CAST(doc_id % 9 AS VARCHAR) AS url,
          TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS published_at,
          TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) + to_minutes(CAST(doc_id % 211 AS INTEGER)) AS created_at,
          1 + doc_id % 10 AS importance, n_chars % 1000 AS points, doc_id * 7 % 50 AS trend,
          CASE doc_id % 7 WHEN 4 THEN 'overflow' WHEN 5 THEN 'rejected' WHEN 6 THEN 'new' ELSE 'published' END AS status,
          CASE CAST(substr(source, 4) AS INTEGER) % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'press' WHEN 2 THEN 'community' WHEN 3 THEN 'newsletter' ELSE 'research' END AS source_type,
          CASE doc_id % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'analysis' WHEN 2 THEN 'product' ELSE 'guide' END AS content_type,
          CASE doc_id // 5 % 6 WHEN 0 THEN 'models' WHEN 1 THEN 'business' WHEN 2 THEN 'policy' WHEN 3 THEN 'research' WHEN 4 THEN 'tools' ELSE 'work' END AS category
        FROM documents""",
    "ent": """SELECT doc_id // 5 AS story_id, doc_id AS article_id, unnest([{'kind': 'company', 'name': CASE WHEN doc_id % 2 = 0 THEN 'Org ' ELSE 'ORG ' END || CAST(doc_id % 17 AS VARCHAR)},
          {'kind': 'model', 'name': 'Model-' || CAST(doc_id % 11 AS VARCHAR) || '.' || CAST(doc_id % 3 AS VARCHAR)},
          {'kind': 'person', 'name': 'Person ' || CAST(doc_id % 23 AS VARCHAR)}], recursive := true) FROM documents""",
    "deal": """SELECT o_orderkey AS deal_id, c_name AS company, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS round
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "rel": """SELECT id AS article_id, published_at, source_id, availability, name,
          CASE WHEN id % 31 = 0 THEN 'arXiv' WHEN id % 37 = 0 THEN '' ELSE CASE id % 3 WHEN 0 THEN 'Org ' WHEN 1 THEN 'ORG ' ELSE 'Org' END || CAST(id // 5 % 17 AS VARCHAR) || CASE WHEN id % 2 = 0 THEN ' AI' ELSE ', Inc.' END END AS lab,
          CASE id % 6 WHEN 0 THEN 'Maker releases ' || name || ' for all' WHEN 1 THEN name || ' vs Model-1.0: which one' WHEN 2 THEN title WHEN 3 THEN 'How ' || upper(name) || ' reads' WHEN 4 THEN 'Maker unveils Model ' || CAST(id % 11 AS VARCHAR) ELSE name END AS headline
        FROM (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, CAST(substr(source, 4) AS INTEGER) AS source_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS published_at,
            CASE doc_id % 5 WHEN 0 THEN 'api' WHEN 1 THEN 'Open_Weights' WHEN 2 THEN 'research' WHEN 3 THEN 'consumer' ELSE '' END AS availability,
            CASE doc_id % 4 WHEN 0 THEN 'Model-' WHEN 1 THEN 'model v' WHEN 2 THEN 'MODEL ' ELSE 'Model' END || CAST(doc_id % 11 AS VARCHAR) || CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '.1' WHEN 2 THEN '.2-GGUF' WHEN 3 THEN '.12' ELSE '.' || CAST(doc_id % 3 AS VARCHAR) || ' Flash' END AS name
          FROM documents)""",
    "price": """SELECT l_partkey AS tool, CAST(l_shipdate AS DATE) AS day, l_orderkey AS obs, l_linenumber AS line, round(l_extendedprice / l_quantity) AS price FROM lineitem""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader events: who is a visitor's number for a day, session a quarter of it."""
    e = load(spark, sf_dir, "events")
    kind = {"view": "view", "click": "click_source", "purchase": "dwell", "signup": "follow"}
    kinds = F.create_map(*[F.lit(x) for pair in kind.items() for x in pair])
    e = e.select(
        "event_id", "ts", F.to_date("ts").alias("day"), "user_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("search")).alias("type"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("who"),
        F.concat(F.lit("Z"), (F.col("user_id") % 10).cast("string")).alias("tz"),
        F.when(F.col("user_id") % 2 == 0, "direct").when(F.col("user_id") % 4 == 1, "bsky.app").otherwise("google.com").alias("source"),
    )
    session = F.concat("who", F.lit("-"), F.floor(F.hour("ts") / 6).cast("string"))
    return e.select("*", session.alias("session"), F.floor(F.col("k") / 4).cast("int").alias("story_id"), F.col("k").alias("article_id"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    source_id = F.substring("source", 4, 10).cast("int")
    published = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 720 as int), 0, 0)")
    created = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 720 as int), cast(doc_id % 211 as int), 0)")
    pick = lambda c, names, last: _choice(c, names, last)
    story = F.floor(F.col("doc_id") / 5)
    return d.select(
        F.col("doc_id").alias("id"), story.alias("story_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text", "lang", "n_chars", F.col("source").alias("source_key"),
        source_id.alias("source_id"), F.concat("source", F.lit(".example.com")).alias("domain"),
        F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.com/a/"), F.col("doc_id").cast("string"), F.lit("/?utm_source=x&p="), (F.col("doc_id") % 9).cast("string")).alias("url"),
        published.alias("published_at"), created.alias("created_at"), (1 + F.col("doc_id") % 10).alias("importance"), (F.col("n_chars") % 1000).alias("points"), (F.col("doc_id") * 7 % 50).alias("trend"),
        pick(F.col("doc_id") % 7, {4: "overflow", 5: "rejected", 6: "new"}, "published").alias("status"),
        pick(source_id % 5, {0: "primary", 1: "press", 2: "community", 3: "newsletter"}, "research").alias("source_type"),
        pick(F.col("doc_id") % 4, {0: "news", 1: "analysis", 2: "product"}, "guide").alias("content_type"),
        pick(story % 6, {0: "models", 1: "business", 2: "policy", 3: "research", 4: "tools"}, "work").alias("category"),
    )


def _choice(c, names: dict[int, str], last: str):
    out = None
    for key, name in names.items():
        out = F.when(c == key, name) if out is None else out.when(c == key, name)
    return out.otherwise(last)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from stories to the names in them; company names come in two spellings."""
    d = F.col("doc_id")
    named = lambda kind, *name: F.struct(F.lit(kind).alias("kind"), F.concat(*name).alias("name"))
    edges = F.array(
        named("company", F.when(d % 2 == 0, "Org ").otherwise("ORG "), (d % 17).cast("string")),
        named("model", F.lit("Model-"), (d % 11).cast("string"), F.lit("."), (d % 3).cast("string")),
        named("person", F.lit("Person "), (d % 23).cast("string")),
    )
    return load(spark, sf_dir, "documents").select(F.floor(d / 5).alias("story_id"), d.alias("article_id"), F.explode(edges).alias("e")).select("story_id", "article_id", "e.kind", "e.name")


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of models: spelled in several ways, with and without a version, launched, compared or only named."""
    d, part = F.col("doc_id"), lambda n: (F.col("doc_id") % n).cast("string")
    name = F.concat(_choice(d % 4, {0: "Model-", 1: "model v", 2: "MODEL "}, "Model"), part(11), F.when(d % 7 > 3, F.concat(F.lit("."), part(3), F.lit(" Flash"))).otherwise(_choice(d % 7, {0: "", 1: ".1", 2: ".2-GGUF"}, ".12")))
    lab = F.concat(_choice(d % 3, {0: "Org ", 1: "ORG "}, "Org"), (F.floor(d / 5) % 17).cast("string"), F.when(d % 2 == 0, " AI").otherwise(", Inc."))
    lab = F.when(d % 31 == 0, "arXiv").when(d % 37 == 0, "").otherwise(lab)
    rows = load(spark, sf_dir, "documents").select(
        d.alias("article_id"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 720 as int), 0, 0)").alias("published_at"),
        F.substring("source", 4, 10).cast("int").alias("source_id"), _choice(d % 5, {0: "api", 1: "Open_Weights", 2: "research", 3: "consumer"}, "").alias("availability"),
        name.alias("name"), lab.alias("lab"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    k, n = F.col("article_id") % 6, F.col("name")
    said = F.when(k == 0, F.concat(F.lit("Maker releases "), n, F.lit(" for all"))).when(k == 1, F.concat(n, F.lit(" vs Model-1.0: which one"))).when(k == 2, F.col("title"))
    said = said.when(k == 3, F.concat(F.lit("How "), F.upper(n), F.lit(" reads"))).when(k == 4, F.concat(F.lit("Maker unveils Model "), (F.col("article_id") % 11).cast("string"))).otherwise(n)
    return rows.withColumn("headline", said).drop("title")


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("deal_id"), F.col("c_name").alias("company"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("round"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("tool"), F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("obs"), F.col("l_linenumber").alias("line"), F.round(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
