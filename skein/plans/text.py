"""Queries of the scalar library (F rows), screens and filters (P rows) and text sources (S rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.bind import NOW, articles, events, load
from skein.functions import text as T
from skein.functions import urls as U
from skein.registry import query


def over_articles(key: str, sql: str, columns: Callable[[], dict[str, Column]]) -> None:
    """One row an article: its id and expressions over it. sql: the same expressions, with their own FROM where they need one."""
    @query(key, f"SELECT id, {sql}" if "{art}" in sql else f"SELECT id, {sql} FROM {{art}}")
    def run(s: SparkSession, d: str) -> DataFrame:
        return articles(s, d).select("id", *[x.alias(k) for k, x in columns().items()])


c = F.col
_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP) + ")"


over_articles("f01_normalize_url", "'https://' || source_key || '.example.com/a/' || CAST(id AS VARCHAR) || '?p=' || CAST(id % 9 AS VARCHAR) AS url", lambda: dict(url=U.normalize(c("url"))))
over_articles("f02_domain_of", r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') AS host", lambda: dict(host=U.host(c("url"))))
over_articles("f05_hashes", "substr(sha1(url), 1, 16) AS url_hash, md5(title) AS key, sha256(domain) AS sha", lambda: dict(url_hash=F.substring(F.sha1("url"), 1, 16), key=F.md5("title"), sha=F.sha2("domain", 256)))
over_articles("f06_slugify", r"""CASE WHEN s = '' THEN 'story' ELSE s END AS slug FROM (SELECT id, CASE WHEN length(f) > 80 THEN CASE WHEN contains(f[1:80], '-') THEN regexp_replace(f[1:80], '-[^-]*$', '') ELSE f[1:80] END ELSE f END AS s FROM (
  SELECT id, lower(regexp_replace(regexp_replace(title, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS f FROM {art}))""", lambda: dict(slug=T.slug(c("title"))))
over_articles("f08_clean_title", r"""trim(CASE WHEN length(b) >= 25 AND length(b) < length(a) THEN b ELSE a END) AS title FROM (SELECT id, a, regexp_replace(a, ' +[-|–—:] +[A-Z][A-Za-z0-9_.&'' ]{1,40}$', '') AS b FROM (
  SELECT id, regexp_replace(regexp_replace(trim(regexp_replace(title || ' (2019)', '[ \t\n\r\f]+', ' ', 'g')), ' *[\(\[] *(19|20)[0-9][0-9] *[\)\]] *$', ''), ' *(\.\.\.|…)$', '') AS a FROM {art}))""",
              lambda: dict(title=T.clean_title(F.concat(c("title"), F.lit(" (2019)")))))
over_articles("f11_tokens", "array_to_string(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9''+.-]*'), ' ') AS tokens", lambda: dict(tokens=F.array_join(T.tokens(c("title")), " ")))
over_articles("f12_word_count", r"len(regexp_extract_all(text, '[^ \t\n\r\f\x0b]+')) AS n", lambda: dict(n=F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))).cast("long")))
over_articles("f13_keywords", f"""array_to_string(list_transform(list_sort(list_transform(w, lambda x, i: {{'l': -length(x), 'i': i, 't': x}}))[1:5], lambda y: y.t), ' ') AS keywords FROM (
  SELECT id, list_filter(u, lambda x, i: list_position(u, x) = i) AS w FROM (SELECT id, list_filter(list_transform(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9''+.-]*'), lambda t: regexp_replace(regexp_replace(t, '^[.'']+|[.'']+$', '', 'g'), '''s$', '')),
  lambda x: length(x) >= 4 AND x NOT IN {_STOP}) AS u FROM {{art}}))""",
              lambda: dict(keywords=F.array_join(T.keywords(c("title")), " ")))
over_articles("f23_first_sentences", r"""array_to_string(list_filter(string_split(regexp_replace(trim(text), '([.!?])[ \n\t\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 20)[1:2], ' ') AS said""",
              lambda: dict(said=F.array_join(F.slice(F.filter(T.sentences(c("text")), lambda x: F.length(x) > 20), 1, 2), " ")))
over_articles("f24_plain_text", r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('# <b>' || title || '</b> [more](http://x.y) *now*', '<[^>]+>', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`#>]+', '', 'g'), '[ \n\t\r]+', ' ', 'g')) AS plain""",
              lambda: dict(plain=T.strip_marks(F.concat(F.lit("# <b>"), c("title"), F.lit("</b> [more](http://x.y) *now*")))))
over_articles("f25_clip", r"CASE WHEN length(title) <= 40 THEN title ELSE regexp_replace(substr(title, 1, 39), '\s+\S*$', '') || '…' END AS clipped", lambda: dict(clipped=T.clip(c("title"), 40)))
over_articles("f26_escape", "replace(replace(replace(replace('<' || title || '> & \"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS safe", lambda: dict(safe=T.escape(F.concat(F.lit("<"), c("title"), F.lit('> & "')))))
over_articles("f27_post_length", "length(title) + 1 + 23 AS n", lambda: dict(n=(F.length(F.regexp_replace(F.concat_ws(" ", "title", "url"), r"https?://\S+", "")) + 23).cast("long")))
over_articles("f28_hashtags", "'#' || category || ' #' || source_key AS tags", lambda: dict(tags=F.array_join(F.slice(F.array_distinct(F.transform(F.array("category", "source_key", "category"), lambda x: F.concat(F.lit("#"), F.regexp_replace(x, "[^A-Za-z0-9]", "")))), 1, 3), " ")))
over_articles("f32_figures", r"""round(coalesce(list_sum(list_transform(regexp_extract_all(lower(text), '[0-9]+(?:\.[0-9]+)?(?: (?:thousand|million|billion))?'), lambda x: CAST(regexp_extract(x, '^[0-9]+(\.[0-9]+)?', 0) AS DOUBLE)
  * CASE WHEN ends_with(x, 'thousand') THEN 1e3 WHEN ends_with(x, 'million') THEN 1e6 WHEN ends_with(x, 'billion') THEN 1e9 ELSE 1 END)), 0) / 1e12, 6) AS total""",
              lambda: dict(total=F.round(F.aggregate(T.figures(c("text")), F.lit(0.0), lambda a, x: a + x) / 1e12, 6)))
over_articles("f33_same_figure", "abs(n_chars - points * 3) <= 0.2 * greatest(n_chars, points * 3) AS same", lambda: dict(same=T.close(c("n_chars"), c("points") * 3, 0.2)))
over_articles("f37_unsupported_figures", "len(list_filter(regexp_extract_all(text, '[0-9]{4,}'), lambda x: NOT contains(title, x))) AS n", lambda: dict(n=F.size(F.filter(F.regexp_extract_all("text", F.lit("[0-9]{4,}"), F.lit(0)), lambda x: ~F.contains(c("title"), x))).cast("long")))
over_articles("f39_keys", r"regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS key", lambda: dict(key=F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "")))
over_articles("f43_usefulness", "round(0.4 * importance / 10.0 + 0.3 * least(points / 500.0, 1) + CASE content_type WHEN 'guide' THEN 0.3 WHEN 'product' THEN 0.2 ELSE 0 END, 6) AS useful",
              lambda: dict(useful=F.round(0.4 * c("importance") / 10.0 + 0.3 * F.least(c("points") / 500.0, F.lit(1.0)) + F.when(c("content_type") == "guide", 0.3).when(c("content_type") == "product", 0.2).otherwise(0.0), 6)))
@query("f45_readability", r"""SELECT id, round(0.39 * w / s + 11.8 * y / w - 15.59, 4) AS grade FROM (SELECT id, len(t) AS w, greatest(len(regexp_extract_all(text, '[.!?]')), 1) AS s,
  list_sum(list_transform(t, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')), 1))) AS y FROM (SELECT id, text, regexp_extract_all(text, '[A-Za-z]+') AS t FROM {art}) WHERE len(t) > 0)""")
def f45(s: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    a = articles(s, d).select("id", words.alias("t"), F.greatest(F.regexp_count("text", F.lit("[.!?]")), F.lit(1)).alias("s")).where("size(t) > 0")
    y = F.aggregate(F.transform("t", lambda x: T.syllables(x).cast("long")), F.lit(0).cast("long"), lambda p, x: p + x)
    return a.select("id", F.round(0.39 * F.size("t") / c("s") + 11.8 * y / F.size("t") - 15.59, 4).alias("grade"))


over_articles("f49_popularity", "round(ln(1 + points) + 0.6 * ln(1 + trend), 6) AS popularity", lambda: dict(popularity=F.round(T.popularity(c("points"), c("trend")), 6)))
over_articles("f50_traction", "round(CASE WHEN points <= 30 THEN 0 ELSE least(1, (log10(1 + points) - log10(31)) / (log10(1001) - log10(31))) END, 6) AS traction", lambda: dict(traction=F.round(T.traction(c("points")), 6)))
over_articles("f51_recency", "round(pow(0.5, greatest(epoch(TIMESTAMP '2024-01-31 00:00:00' - published_at) / 3600.0, 0) / 18.0), 6) AS recency",
              lambda: dict(recency=F.round(T.recency(F.expr(f"timestampdiff(SECOND, published_at, TIMESTAMP_NTZ '{NOW}')") / 3600.0), 6)))
over_articles("f55_iso_week", "strftime(published_at, '%G-W%V') AS week", lambda: dict(week=T.iso_week(F.to_date("published_at"))))
over_articles("f57_billing_cycle", "strftime(date_trunc('month', published_at), '%Y-%m-') || lpad(CAST(least(31, day(last_day(published_at))) AS VARCHAR), 2, '0') AS starts",
              lambda: dict(starts=F.concat(F.date_format("published_at", "yyyy-MM-"), F.lpad(F.least(F.lit(31), F.day(F.last_day("published_at"))).cast("string"), 2, "0"))))
over_articles("f58_reading_minutes", "greatest(1, round_even(n_chars / 1000.0, 0)) :: BIGINT AS minutes", lambda: dict(minutes=F.greatest(F.lit(1), F.bround(c("n_chars") / 1000.0, 0)).cast("long")))
over_articles("f59_iso_z", "strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS at", lambda: dict(at=F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
over_articles("f65_token_estimate", "CAST(ceil(n_chars / 4.0) AS BIGINT) AS n", lambda: dict(n=F.ceil(c("n_chars") / 4.0).cast("long")))
over_articles("f67_query_sanitiser", r"regexp_replace(regexp_replace(title || ' me@x.org 123456', '[^ @]+@[^ @]+', '', 'g'), '[0-9]{5,}', '', 'g') AS clean", lambda: dict(clean=F.regexp_replace(F.regexp_replace(F.concat("title", F.lit(" me@x.org 123456")), "[^ @]+@[^ @]+", ""), "[0-9]{5,}", "")))
over_articles("f71_short_number", "CASE WHEN n_chars >= 1000 THEN CAST(n_chars // 1000 AS VARCHAR) || 'k' ELSE CAST(n_chars AS VARCHAR) END AS short", lambda: dict(short=F.when(c("n_chars") >= 1000, F.concat(F.floor(c("n_chars") / 1000).cast("string"), F.lit("k"))).otherwise(c("n_chars").cast("string"))))
over_articles("f76_clean_name", "replace(replace(title, chr(8203), ''), chr(8209), '-') AS name", lambda: dict(name=F.translate("title", "‑​", "-")))
over_articles("f77_path_key", r"regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(index\.html)?/*$', '') AS path", lambda: dict(path=F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1), r"(index\.html)?/*$", "")))
over_articles("f78_embed_note", "base64(encode(title)) AS packed, title AS note", lambda: dict(packed=F.translate(F.base64(F.encode("title", "UTF-8")), "\r\n", ""), note=F.decode(F.unbase64(F.base64(F.encode("title", "UTF-8"))), "UTF-8")))
over_articles("f80_longest_suffix_rule", "CASE WHEN source_key = 'src1' THEN 'src1.example.com' ELSE 'example.com' END AS rule",
              lambda: dict(rule=F.array_max(F.transform(F.filter(F.array(F.lit("com"), F.lit("example.com"), F.lit("src1.example.com")), lambda r: U.on_domain(c("domain"), r)), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]))
over_articles("f83_modified_date", "least(greatest(published_at, created_at), TIMESTAMP '2024-01-30 00:00:00') AS modified", lambda: dict(modified=F.least(F.greatest("published_at", "created_at"), F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'"))))
over_articles("p02_computed_columns", "coalesce(length(text), -1) AS n, coalesce(ascii(substr(text, 1, 1)), 0) + 7 * coalesce(length(text), 0) AS sig", lambda: dict(n=F.coalesce(F.length("text"), F.lit(-1)).cast("long"), sig=(F.coalesce(F.ascii(F.substring("text", 1, 1)), F.lit(0)) + 7 * F.coalesce(F.length("text"), F.lit(0))).cast("long")))
over_articles("p03_text_prefix", "substr(text, 1, 600) AS lead", lambda: dict(lead=F.substring("text", 1, 600)))
over_articles("p17_page_date", "CASE WHEN published_at >= created_at - INTERVAL 1 HOUR THEN 'feed' ELSE 'page' END AS chosen", lambda: dict(chosen=F.when(c("published_at") >= c("created_at") - F.expr("INTERVAL '1' HOUR"), "feed").otherwise("page")))
over_articles("p18_source_type", "CASE WHEN source_key IN ('src0', 'src5') THEN 'primary' WHEN source_type = 'community' THEN 'press' ELSE source_type END AS kind", lambda: dict(kind=F.when(c("source_key").isin("src0", "src5"), "primary").when(c("source_type") == "community", "press").otherwise(c("source_type"))))
over_articles("p43_tidy", "CASE WHEN status = 'rejected' THEN NULL ELSE title END AS title, CASE WHEN published_at < TIMESTAMP '2024-01-10 00:00:00' THEN NULL ELSE domain END AS domain", lambda: dict(title=F.when(c("status") != "rejected", c("title")), domain=F.when(c("published_at") >= F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"), c("domain"))))
over_articles("s24_rules_only_summary", r"""array_to_string(list_filter(string_split(regexp_replace(trim(text), '([.!?])[ \n\t\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 20)[1:3], ' ') AS summary, 'heuristic' AS model""",
              lambda: dict(summary=F.array_join(F.slice(F.filter(T.sentences(c("text")), lambda x: F.length(x) > 20), 1, 3), " "), model=F.lit("heuristic")))


@query("p04_age_filter", "SELECT id FROM {art} WHERE (published_at < TIMESTAMP '2024-01-17 00:00:00') OR (published_at IS NULL AND created_at < TIMESTAMP '2024-01-17 00:00:00')")
def p04(s: SparkSession, d: str) -> DataFrame:
    cut = F.expr("TIMESTAMP_NTZ '2024-01-17 00:00:00'")
    return articles(s, d).where((c("published_at") < cut) | (c("published_at").isNull() & (c("created_at") < cut))).select("id")


@query("p06_phrase_screen", "SELECT id FROM {art} WHERE text ILIKE '%licen%' OR text ILIKE '%copyright%'")
def p06(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).where(c("text").ilike("%licen%") | c("text").ilike("%copyright%")).select("id")


@query("p09_quality_gate", r"""SELECT id, CASE WHEN source_key IN ('src3', 'src7') THEN 'blocked domain' WHEN regexp_matches(lower(title), 'http|@') THEN 'blocked title pattern' WHEN lang NOT IN ('en') THEN 'language ' || lang
  WHEN published_at > TIMESTAMP '2024-01-30 02:00:00' THEN 'published in the future' WHEN published_at < TIMESTAMP '2024-01-05 00:00:00' THEN 'too old' WHEN n_chars < 400 THEN 'too short' END AS reason FROM {art}""")
def p09(s: SparkSession, d: str) -> DataFrame:
    at = lambda t: F.expr(f"TIMESTAMP_NTZ '{t}'")
    reason = (
        F.when(c("source_key").isin("src3", "src7"), "blocked domain").when(F.lower("title").rlike("http|@"), "blocked title pattern").when(c("lang") != "en", F.concat(F.lit("language "), "lang"))
        .when(c("published_at") > at("2024-01-30 02:00:00"), "published in the future").when(c("published_at") < at("2024-01-05 00:00:00"), "too old").when(c("n_chars") < 400, "too short")
    )
    return articles(s, d).select("id", reason.alias("reason"))


@query("p11_language_filter", "SELECT id, lang FROM {art} WHERE lang IN ('en', 'unknown')")
def p11(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).where(c("lang").isin("en", "unknown")).select("id", "lang")


@query("p35_insert_policy", "SELECT event_id, type IN ('view', 'dwell', 'click_source', 'follow') AND value BETWEEN 0 AND 90 AS accepted FROM {ev}")
def p35(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("event_id", (c("type").isin("view", "dwell", "click_source", "follow") & c("value").between(0, 90)).alias("accepted"))


@query("s10_html_scan", "SELECT page_id, url FROM pages WHERE url LIKE 'http%' AND octet_length(encode(html)) <= 6000000 AND html ILIKE '%<html%'")
def s10(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "pages").where(c("url").like("http%") & (F.octet_length("html") <= 6_000_000) & c("html").ilike("%<html%")).select("page_id", "url")


@query("s05_link_scan", r"""SELECT page_id, coalesce(list_filter(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda x: x LIKE '/%')[1], '') AS link FROM pages""")
def s05(s: SparkSession, d: str) -> DataFrame:
    links = F.filter(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)), lambda x: x.like("/%"))
    return load(s, d, "pages").select("page_id", F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("link"))


@query("s12_comment_scan", "SELECT conv_id, count(*) AS n, sum(length(said))::BIGINT AS chars FROM (SELECT conv_id, substr(text, 1, 600) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE length(text) >= 40) WHERE r <= 25 GROUP BY conv_id")
def s12(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    said = load(s, d, "conversations").where(F.length("text") >= 40).withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("r <= 25")
    return said.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length(F.substring("text", 1, 600))).alias("chars"))


@query("s15_window_scan", "SELECT id FROM {art} WHERE created_at >= TIMESTAMP '2024-01-15 00:00:00' OR (status IN ('published', 'overflow') AND created_at >= TIMESTAMP '2024-01-05 00:00:00')")
def s15(s: SparkSession, d: str) -> DataFrame:
    at = lambda t: c("created_at") >= F.expr(f"TIMESTAMP_NTZ '{t}'")
    return articles(s, d).where(at("2024-01-15 00:00:00") | (c("status").isin("published", "overflow") & at("2024-01-05 00:00:00"))).select("id")


@query("s16_incremental_scan", "SELECT id, status FROM {art} a WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.id AND l.toxic = 1)")
def s16(s: SparkSession, d: str) -> DataFrame:
    """Rows of revisions from the watermark on, without those in the delete log."""
    gone = load(s, d, "labels").where("toxic = 1").select(c("doc_id").alias("id"))
    return articles(s, d).where(c("created_at") >= F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'")).join(gone, "id", "left_anti").select("id", "status")
