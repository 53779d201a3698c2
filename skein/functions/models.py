"""Model launches: one key for each spelling of a model, and whether a mention is a launch. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import let

# -- fixed values: what makes a mention a launch, and what labs' names carry besides the name -------------------------------------------------

USABLE = ["api", "open_weights", "consumer"]
UNKNOWN = ["", "unknown", "none", "n/a", "null"]
NOT_LABS = r"(?i)^(?:arxiv|hugging ?face|github|papers with code|unknown lab)$|\bet al\b|\bresearch team\b|\bresearchers\b"
LAUNCH_WORDS = (
    r"(?i)\b(?:launch(?:es|ed)?|releas(?:e|es|ed)|unveil(?:s|ed)?|introduc(?:e|es|ed)|debut(?:s|ed)?|announc(?:e|es|ed)|"
    r"roll(?:s|ed)? out|ship(?:s|ped)?|open-sourc(?:e|es|ed)|drop(?:s|ped)?|adds|now available|available)\b"
)
COMPARISON = r"(?i)\bvs\.?\b|\bversus\b"
FILE_SUFFIX = r"(?i)(?:[-_. ]?gguf\b.*|\.(?:safetensors|bin|onnx))$"
ORG_WORDS = (
    r"(?i)\b(?:ai|inc|labs?|platforms|technologies|corp(?:oration)?|ltd|llc|research|machine learning|"
    r"s\.?a\.?s?|gmbh|ag|plc|bv|nv|pte|pty|srl|holdings?)\b\.?"
)
VERSION = r"v?[0-9][0-9.]*"


def _plain(text: Column) -> Column:
    """Lower-case letters, digits and dots; whatever else stands between them is one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9.]+", " "))


def lab_key(lab: Column) -> Column:
    """A lab's name without legal forms and filler; two spellings of one lab are one."""
    one = F.replace(F.replace(_plain(lab), F.lit("google deepmind"), F.lit("google")), F.lit("deepmind"), F.lit("google"))
    return F.regexp_replace(F.regexp_replace(one, ORG_WORDS, " "), "[^a-z0-9]", "")


def distinctive(name: Column, lab: Column) -> Column:
    """A model name's words that tell it from others: not the lab's name, nothing of a file's ending, no short word without a digit."""
    words = F.transform(F.split(_plain(F.regexp_replace(F.coalesce(name, F.lit("")), FILE_SUFFIX, "")), " +"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.filter(words, lambda w: (w != "") & (w != lab_key(lab)) & ((F.length(w) >= 3) | w.rlike("[0-9]")))


def model_key(name: Column, lab: Column) -> Column:
    """The distinctive words run together, and the lab's key after a bar."""
    return F.concat(F.replace(F.array_join(distinctive(name, lab), ""), F.lit("."), F.lit("")), F.lit("|"), lab_key(lab))


def is_release(name: Column, lab: Column, availability: Column, headline: Column) -> Column:
    """Whether a story launches a model that people can use: a maker is known, nothing is compared, it is available or said to be launched, and the
    headline has the first distinctive word of its name and three fifths of them."""
    name, head = F.coalesce(name, F.lit("")), F.coalesce(headline, F.lit(""))
    lab = F.trim(F.coalesce(lab, F.lit("")))
    kind = F.trim(F.lower(F.coalesce(availability, F.lit(""))))
    named = (F.trim(name) != "") & ~F.lower(lab).isin(UNKNOWN) & ~lab.rlike(NOT_LABS)
    alone = ~name.contains(",") & ~name.rlike(COMPARISON) & ~head.rlike(COMPARISON)
    usable = (kind != "research") & (kind.isin(USABLE) | head.rlike(LAUNCH_WORDS))
    said = F.replace(_plain(head), F.lit(" "), F.lit(""))
    about = let(distinctive(name, lab), lambda words: (F.size(words) > 0) & F.contains(said, F.get(words, F.lit(0))) & (F.size(F.filter(words, lambda w: F.contains(said, w))) >= 0.6 * F.size(words)))
    return named & alone & usable & F.coalesce(about, F.lit(False))
