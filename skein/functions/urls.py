"""URL and host expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, in alphabetical order.
TRACKING = [
    "_hsenc", "_hsmi", "cmpid", "dclid", "fbclid", "feature", "gclid", "guccounter", "guce_referrer", "guce_referrer_sig", "igshid", "mc_cid", "mc_eid", "msclkid",
    "ncid", "ocid", "ref", "ref_src", "s", "si", "smid", "smtyp", "source", "sr_share", "trk", "utm_campaign", "utm_content", "utm_id", "utm_medium", "utm_source", "utm_term",
]
# Second levels under which a registrable domain has three labels.
SECOND_LEVELS = ["ac", "co", "com", "edu", "gov", "ne", "net", "or", "org"]
# Sites without article text.
SKIP = ["bing.com", "facebook.com", "google.com", "instagram.com", "linkedin.com", "news.google.com", "tiktok.com", "twitter.com", "x.com", "youtu.be", "youtube.com"]
SKIP_SUFFIXES = ["msn.com"]


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def normalize(url: Column) -> Column:
    """Scheme and host in lower case without www. and m., no tracking parameters, no final slashes or /amp, no fragment."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    name = F.when(F.length(host(url)) - F.length(F.replace(host(url), F.lit("."), F.lit(""))) >= 2, F.regexp_replace(host(url), r"^m\.", "")).otherwise(host(url))
    path = F.regexp_replace(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    path = F.regexp_replace(path, "/amp$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(TRACKING))
    kept = F.array_join(pairs, "&")
    return F.concat(scheme, F.lit("://"), name, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def registrable(name: Column) -> Column:
    last = lambda n: F.array_join(F.slice(F.split(name, r"\."), -n, n), ".")
    labels = F.size(F.split(name, r"\."))
    second = F.split_part(name, F.lit("."), F.lit(-2))
    short = F.length(F.split_part(name, F.lit("."), F.lit(-1))) == 2
    return F.when(labels <= 2, name).when(second.isin(SECOND_LEVELS) & short, last(3)).otherwise(last(2))


def skipped(name: Column) -> Column:
    out = name.isin(SKIP)
    for suffix in SKIP_SUFFIXES:
        out = out | (name == suffix) | name.endswith("." + suffix)
    return out


def on_domain(name: Column, domain: Column) -> Column:
    return (name == domain) | F.endswith(name, F.concat(F.lit("."), domain))


def source_name(raw: Column) -> Column:
    """A referring host or tag as a readable name."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), r"^www\.", "")
    return (
        F.when((s == "") | (s == "direct"), "Direct")
        .when(s.rlike(r"(^|\.)bsky\.app$"), "Bluesky")
        .when(s.rlike(r"^([a-z0-9-]+\.)*google(\.[a-z]{2,3}){1,2}$") | (s == "google"), "Google")
        .when(s.rlike(r"^([a-z0-9-]+\.)*bing\.com$") | (s == "bing"), "Bing")
        .when(s.contains("duckduckgo"), "DuckDuckGo")
        .when(s.rlike(r"^([a-z0-9-]+\.)*(mastodon|mstdn)([.-][a-z0-9-]+)*\.[a-z]{2,}$"), "Mastodon")
        .otherwise(s)
    )


def path(url: Column) -> Column:
    """The path without .html and a final slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), r"\.html$", ""), "/$", "")


def older_list_page(at: Column, sections: tuple[str, ...] = ("topic", "models", "category", "daily")) -> Column:
    """Whether a path is a numbered older page of a list."""
    return at.rlike(rf"^/({'|'.join(sections)})/[^/]+/[0-9]+$") | at.rlike("^/threads/[0-9]+$")


def url_date(url: Column) -> Column:
    """First day of the month that a /YYYY/MM/ in the URL names, or null."""
    year, month = (F.nullif(F.regexp_extract(url, "/((?:19|20)[0-9]{2})/(0[1-9]|1[0-2])(?:/|$)", i), F.lit("")).cast("int") for i in (1, 2))
    return F.make_date(year, month, F.lit(1))


def page_date(raw: Column) -> Column:
    """An ISO date, of a timestamp its day; null for anything else."""
    return F.when(raw.rlike(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.trim(raw).substr(1, 10).try_cast("date"))


def links(html: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.replace(x, F.lit("&amp;"), F.lit("&"))))


def link_in(html: Column, own: Column) -> Column:
    """The first link to another site that is more than its home page, or null."""
    name = lambda x: F.lower(F.regexp_extract(x, "^https?://([^/?#:]*)", 1))
    return F.get(F.filter(links(html), lambda x: x.rlike("^https?://[^/?#]") & ~x.rlike("^https?://[^/?#]+/?$") & ~on_domain(name(x), own)), F.lit(0))
