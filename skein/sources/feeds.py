"""RSS and Atom documents: written from rows, and read back as rows, repaired where they are malformed, from a fallback where they can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import urls as U
from skein.sources.html import repaired

#: Fixed value: subjects of which an entry of a general source must name one.
TOPIC = (
    r"(?i)\b(?:AI|A\.I\.|artificial intelligence|generative|GenAI|ChatGPT|GPT|Gemini|Claude|Copilot|"
    r"LLMs?|chatbots?|agents?|agentic|machine learning|automation|automate[ds]?|Perplexity|Midjourney|"
    r"AI Overviews?|AI Mode|Performance Max|Advantage\+)\b"
)
_RSS = "channel struct<item: array<struct<title: string, link: string, pubDate: string, date: string, description: string, encoded: string, creator: string, author: string>>>"
_ATOM = ("entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, published: string, updated: string, summary: string, content: string, "
         "author: array<struct<name: string>>>>")
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
_ENTRY = "array<struct<title: string, link: string, said_at: string, summary: string, body: string, author: string>>"


def entries(document: Column) -> Column:
    """A document's entries as title, link, said_at, summary, body and author; null where it isn't a well-formed feed with entries. An Atom entry's link is its
    alternate one, or the first."""
    def of_rss(x: Column) -> Column:
        return F.struct(x["title"].alias("title"), x["link"].alias("link"), F.coalesce(x["pubDate"], x["date"]).alias("said_at"), x["description"].alias("summary"),
                        x["encoded"].alias("body"), F.coalesce(x["creator"], x["author"]).alias("author"))

    def of_atom(x: Column) -> Column:
        best = F.coalesce(F.get(F.filter(x["link"], lambda y: F.coalesce(y["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get(x["link"], F.lit(0)))
        return F.struct(x["title"].alias("title"), best["_href"].alias("link"), F.coalesce(x["published"], x["updated"]).alias("said_at"), x["summary"].alias("summary"),
                        x["content"].alias("body"), F.get(x["author"], F.lit(0))["name"].alias("author"))

    rss = F.transform(F.from_xml(document, _RSS, _OPTIONS)["channel"]["item"], of_rss).cast(_ENTRY)
    atom = F.transform(F.from_xml(document, _ATOM, _OPTIONS)["entry"], of_atom).cast(_ENTRY)
    some = lambda x: F.when(F.size(x) > 0, x)
    return F.when(document.contains("<rss"), T.let(rss, some)).when(document.contains("<feed"), T.let(atom, some))


def said_at(text: Column) -> Column:
    """The time of an entry: day, month name, year, time and offset, or ISO form; null if neither."""
    day = F.regexp_extract(text, r"([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) *(?:GMT|UTC|Z|[+-][0-9]{4})", 1)
    offset = F.regexp_extract(text, r"[0-9] *([+-][0-9]{4})\s*$", 1)
    named = F.try_to_timestamp(F.concat(day, F.lit(" "), F.when(offset == "", "+0000").otherwise(offset)), F.lit("d MMM yyyy HH:mm:ss xx"))
    return F.when(day != "", named).otherwise(F.trim(text).try_cast("timestamp"))


def read_feeds(feeds: DataFrame, titles: bool = True) -> DataFrame:
    """(source_key, link, title, published_at, description, feed_content, author): the entries of feeds (source_key, document, fallback, keep_domain, topic_only).

    A document that gives no entries is repaired and read again; if it still gives none, the fallback is read in the same way. Entries without an http
    link go, those outside keep_domain (if it isn't null), and those of a topic_only source that name no subject in their title or the first 600 characters
    of their summary; without `titles` only the summary counts. Descriptions have 2,000 characters at most; feed_content is the body, or else the summary, of over 50 words."""
    whole = lambda d: F.coalesce(entries(d), entries(repaired(d)))
    found = feeds.select("source_key", "keep_domain", "topic_only", F.explode(F.coalesce(whole(F.col("document")), whole(F.col("fallback")))).alias("e"))
    summary = F.coalesce(F.col("e.summary"), F.lit(""))
    title, link = F.coalesce(F.col("e.title"), F.lit("")), F.trim(F.col("e.link"))
    told = F.substring(F.regexp_replace(summary, "<[^>]+>", " "), 1, 600)
    named = (F.concat(title, F.lit(" "), told) if titles else told).rlike(TOPIC)
    kept = F.col("keep_domain").isNull() | U.on_domain(U.host(link), F.lower("keep_domain"))
    rows = found.where(link.startswith("http") & kept & (~F.coalesce("topic_only", F.lit(False)) | named))
    long = lambda x: F.when(T.word_count(x) > 50, x)
    return rows.select("source_key", link.alias("link"), title.alias("title"), said_at(F.col("e.said_at")).alias("published_at"), F.substring(summary, 1, 2000).alias("description"),
                       F.coalesce(long(F.col("e.body")), long(F.col("e.summary"))).alias("feed_content"), F.substring("e.author", 1, 300).alias("author"))


def _element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), T.escape(F.regexp_replace(F.coalesce(value, F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")), F.lit(f"</{name}>"))


def documents(rows: DataFrame, most: int, atom: bool = False) -> DataFrame:
    """(source_key, document): a feed of each source's newest `most` rows (source_key, id, title, link, published_at, description, author)."""
    place = F.row_number().over(Window.partitionBy("source_key").orderBy(F.desc("published_at"), F.desc("id")))
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'" if atom else "E, dd MMM yyyy HH:mm:ss 'GMT'")
    if atom:
        one = F.concat(F.lit("<entry>"), _element("title", F.col("title")), F.lit('<link rel="self" href="https://feed.example.com/"/><link rel="alternate" href="'), T.escape(F.col("link")), F.lit('"/>'),
                       _element("published", at), _element("summary", F.col("description")), F.lit("<author>"), _element("name", F.col("author")), F.lit("</author></entry>"))
        head, tail = '<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom">', "</feed>"
    else:
        one = F.concat(F.lit("<item>"), _element("title", F.col("title")), _element("link", F.col("link")), _element("pubDate", at), _element("dc:creator", F.col("author")),
                       _element("description", F.col("description")), F.lit("</item>"))
        head, tail = '<?xml version="1.0" encoding="utf-8"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>', "</channel></rss>"
    items = rows.withColumn("place", place).where(F.col("place") <= most).select("source_key", "place", one.alias("one"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "one"))), lambda x: x["one"])
    return items.groupBy("source_key").agg(F.concat(F.lit(head), _element("title", F.col("source_key")), F.array_join(listed, ""), F.lit(tail)).alias("document"))
