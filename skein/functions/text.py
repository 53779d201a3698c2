"""Text expressions: titles, tokens, figures, money, screens, readability. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9][a-z0-9'+.-]*"
# Words that say nothing of a title's subject.
STOP = """a an the and or but if then of to in on at by for with from as is are was were be been being this that these those it its into over under about after before between during without
    within how why what when where which who whom whose will would can could should may might must shall has have had do does did not no nor so than too very just also more most such own
    same other new says said say here there their they them our your you we he she his her i me my us up out than via amid among around""".split()


def let(x: Column, f) -> Column:
    """f(x), with x computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))).cast("long")


def clean_title(title: Column) -> Column:
    """One line of single spaces without a year tag, final dots or a source suffix; the suffix only where a full title stays."""
    t = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"[ \t\n\r\f]+", " "))
    t = F.regexp_replace(t, r" *[\(\[] *(19|20)[0-9][0-9] *[\)\]] *$", "")
    t = F.regexp_replace(t, r" *(\.\.\.|…)$", "")
    short = F.regexp_replace(t, r" +[-|–—:] +[A-Z][A-Za-z0-9_.&' ]{1,40}$", "")
    return F.trim(F.when((F.length(short) >= 25) & (F.length(short) < F.length(t)), short).otherwise(t))


def title_year(title: Column) -> Column:
    """The earliest year in brackets among the tags at a title's end."""
    tags = F.regexp_extract(F.coalesce(title, F.lit("")), r"(\s*[\(\[][^()\[\]]{1,12}[\)\]])+\s*$", 0)
    return F.array_min(F.transform(F.regexp_extract_all(tags, F.lit(r"[\(\[]\s*((19|20)[0-9][0-9])\s*[\)\]]"), F.lit(1)), lambda y: y.cast("int")))


def seconds_of(text: Column) -> Column:
    """Seconds in waits such as 1.5s or 1m2s."""
    parts = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9.]*[0-9][0-9.]*)([hms])"), F.lit(i)) for i in (1, 2)]
    each = F.zip_with(*parts, lambda n, u: F.coalesce(n.try_cast("double"), F.lit(0.0)) * F.when(u == "h", 3600).when(u == "m", 60).otherwise(1))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def provider(mark: Column) -> Column:
    """Who made an answer: the mark up to a colon or plus."""
    return F.split_part(F.split_part(F.coalesce(mark, F.lit("heuristic")), F.lit(":"), F.lit(1)), F.lit("+"), F.lit(1))


def upgrades(mark: Column) -> Column:
    """Sources of the last rewriting that a mark tells, or null."""
    return F.nullif(F.regexp_extract(mark, r"\+u([0-9]{1,9})$", 1), F.lit("")).cast("long")


def json_in(prose: Column) -> Column:
    """From the first brace to the last."""
    return F.nullif(F.regexp_extract(prose, r"(?s)\{.*\}", 0), F.lit(""))


def slug(text: Column, most: int = 80) -> Column:
    """Letters and digits joined by dashes, cut at a dash."""
    s = F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    cut = F.substring(s, 1, most)
    cut = F.when(cut.contains("-"), F.regexp_replace(cut, "-[^-]*$", "")).otherwise(cut)
    s = F.when(F.length(s) > most, cut).otherwise(s)
    return F.when(s == "", "story").otherwise(s)


def keywords(text: Column, n: int = 5) -> Column:
    """The longest distinct words that say something; of one length the first ones."""
    words = F.transform(tokens(text), lambda t: F.regexp_replace(F.regexp_replace(t, r"^[.']+|[.']+$", ""), "'s$", ""))
    words = F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 4) & ~t.isin(STOP)))
    keyed = F.transform(words, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t")))
    return F.slice(F.transform(F.array_sort(keyed), lambda x: x["t"]), 1, n)


def shingles(words: Column) -> Column:
    """Neighbouring word pairs; a lone word as itself."""
    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda x, y: F.concat_ws(" ", x, y))

    return let(words, lambda w: F.when(F.size(w) > 1, pairs(w)).otherwise(w))


def jaccard(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sentences(text: Column) -> Column:
    """Stretches up to a full stop, question or exclamation mark before space."""
    marked = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"([.!?])[ \n\t\r]+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def strip_marks(text: Column) -> Column:
    """Text without tags and simple markdown."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, "[*_`#>]+", "")
    return F.trim(F.regexp_replace(t, "[ \n\t\r]+", " "))


def clip(text: Column, most: int) -> Column:
    """At most so many characters, cut at a word, with an ellipsis where something is cut."""
    cut = F.regexp_replace(F.substring(text, 1, most - 1), r"\s+\S*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def figures(text: Column) -> Column:
    """Numbers in a text with thousands, million, billion words worked in."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+(?:\.[0-9]+)?(?: (?:thousand|million|billion))?"), F.lit(0))

    def value(x: Column) -> Column:
        scale = F.when(x.endswith("thousand"), 1e3).when(x.endswith("million"), 1e6).when(x.endswith("billion"), 1e9).otherwise(1.0)
        return F.regexp_extract(x, r"^[0-9]+(\.[0-9]+)?", 0).cast("double") * scale

    return F.transform(found, value)


def close(a: Column, b: Column, tolerance: float = 0.25) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(a, b)


def syllables(word: Column) -> Column:
    return F.greatest(F.regexp_count(F.lower(word), F.lit("[aeiouy]+")), F.lit(1))


def iso_week(day: Column) -> Column:
    return F.format_string("%d-W%02d", F.date_part(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def recency(hours: Column, half_life: float = 18.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(hours, F.lit(0.0)) / half_life)


def popularity(points: Column, trend: Column) -> Column:
    return F.log1p(F.greatest(points, F.lit(0))) + 0.6 * F.log1p(F.greatest(trend, F.lit(0)))


def traction(points: Column, floor: int = 30, full: int = 1000) -> Column:
    """0 up to floor points, 1 from full points on, logarithmic between."""
    low = F.log10(F.lit(1.0 + floor))
    return F.when(points <= floor, 0.0).otherwise(F.least(F.lit(1.0), (F.log10(1.0 + points) - low) / (F.log10(F.lit(1.0 + full)) - low)))
