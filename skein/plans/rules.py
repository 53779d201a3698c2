"""Queries of the rule library over titles, texts, URLs and pages (rules of P, F and X rows), with twins built from the same fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.bind import articles, entities, events, load
from skein.functions import rules as R
from skein.functions import text as T
from skein.functions import urls as U
from skein.plans.text import over_articles
from skein.registry import query
from skein.sources import html

c = F.col
YEAR = 2024


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit(text: str, pattern: str) -> str:
    """Twin of R.has. Accented letters count as letters at word borders there, so they are plain ones here."""
    return f"regexp_matches({ascii_of(text)}, {q('(?i)' + pattern)})"


def ascii_of(text: str) -> str:
    return f"regexp_replace({text}, '[ªµºÀ-ÖØ-öø-ɏ]', 'z', 'g')"


def found(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({ascii_of(text)}, {q('(?i)' + pattern)}, {group})"


def n_words(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '\S+'))"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def _weights(text: str) -> str:
    return " + ".join(f"{w} * len({found(text, p)})" for p, w in R.RELEVANCE)


over_articles("p10_relevance", f"round(3.0 * ({_weights('title')}) + 200.0 * ({_weights('body')}) / greatest(1, {n_words('body')}), 4) AS score FROM (SELECT id, title, text[1:{R.RELEVANCE_BODY}] AS body FROM {{art}})",
              lambda: dict(score=F.round(R.relevance(c("title"), c("text")), 4)))
over_articles("p12_blocked_title", f"{hit('title', R.BLOCKED_TITLE)} AS blocked, domain IN {listed(R.BLOCKED_DOMAINS)} AS blocked_domain, {hit('text[1:600]', R.PRESS_RELEASE)} AS release",
              lambda: dict(blocked=R.has(c("title"), R.BLOCKED_TITLE), blocked_domain=c("domain").isin(R.BLOCKED_DOMAINS), release=R.has(F.substring("text", 1, 600), R.PRESS_RELEASE)))
over_articles("p13_teaser_reason", f"""CASE WHEN n < {R.TEASER_FLOOR} THEN 'too short to be an article (' || CAST(n AS VARCHAR) || ' words)'
  WHEN n <= {R.TEASER_MOST} AND (len(hits) >= 2 OR len(hits) > 0 AND {hit('text', R.STRONG_TEASER)}) THEN 'paywall teaser (' || hits[1] || ')' END AS reason
  FROM (SELECT id, text, {n_words('text')} AS n, list_sort(list_distinct(list_transform({found('text', R.TEASER)}, lambda x: lower(x)))) AS hits FROM {{art}})""", lambda: dict(reason=R.teaser_reason(c("text"))))

_BARE = r"regexp_replace(regexp_replace(p, '^[#>* \-]+', ''), '^\s+|\s+$', '', 'g')"
_ENDS = r"regexp_replace(p, '^[#>* \-]+', '')"
_STAYS = (
    f"NOT ({hit(_BARE, R.DROPPED)} AND {n_words(_BARE)} < 40 OR {hit(_BARE, R.INBOX)} AND {n_words(_BARE)} < 45 OR {hit(_BARE, R.META_LINE)} AND {n_words(_BARE)} < 8 "
    f"OR regexp_matches(p, {q(R.TICKER)}) OR {n_words(_BARE)} <= 3 AND NOT starts_with(p, '#') AND regexp_matches(replace({_BARE}, '''', ''), {q(R.WORDLESS)}))"
)
_PLAIN = "text || chr(10)"
for _code, _mark in (("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, {q(_code)}, {q(_mark)})"
over_articles("p15_scrub_paragraphs", rf"""coalesce(array_to_string(kept[1:coalesce(list_max(list_transform(kept, lambda p, i: CASE WHEN {n_words(_ENDS)} > 4 THEN i ELSE 0 END)), 0)], chr(10) || chr(10)), '') AS kept
  FROM (SELECT id, list_filter(ps[1:coalesce(cut, len(ps))], lambda p: {_STAYS}) AS kept FROM (
    SELECT id, ps, list_filter(list_transform(ps, lambda p, i: CASE WHEN i - 1 > len(ps) * 0.4 AND {n_words(_BARE)} <= 6 AND {hit(_BARE, R.CUT_HEADING)} THEN i - 1 END), lambda i: i IS NOT NULL)[1] AS cut FROM (
      SELECT id, list_filter(list_transform(regexp_split_to_array(replace({_PLAIN}, chr(10), chr(10) || chr(10)), '\n[ \t\n\x0b\f\r]*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM {{art}})))""",
              lambda: dict(kept=R.scrub(F.replace(F.concat("text", F.lit("\n")), F.lit("\n"), F.lit("\n\n")))))


_TERMS = " UNION ALL ".join(
    f"SELECT id, {k} AS k, {q(label)} AS label, unnest(list_distinct(list_transform({found('clean', rf'\b(?:{p})\b')}, lambda x: lower(x)))) AS term FROM clean" for k, (label, p) in enumerate(R.RISKS)
)


@query("p22_risk_terms", f"""WITH clean AS (SELECT id, regexp_replace(text, {q('(?i)' + R.BENIGN)}, ' ', 'g') AS clean FROM {{art}}), firsts AS (SELECT id, term, arg_min(label, k) AS label FROM ({_TERMS}) GROUP BY id, term)
  SELECT id, coalesce(string_agg(label || ': ' || term, '; ' ORDER BY label || ': ' || term), '') AS risks FROM {{art}} LEFT JOIN firsts USING (id) GROUP BY id""")
def p22(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).select("id", F.array_join(F.array_sort(F.transform(R.risks(c("text")), lambda x: F.concat(x["label"], F.lit(": "), x["term"]))), "; ").alias("risks"))


@query("p22_held_stories")
def p22_held(s: SparkSession, d: str) -> DataFrame:
    """Why stories of one publisher wait for approval: someone named, and risky words in the headline or the first two sentences."""
    a = articles(s, d).groupBy("story_id").agg(F.count_distinct("domain").alias("publishers"), F.min_by(F.struct("title", "text"), "id").alias("lead"))
    lede = F.array_join(F.slice(T.sentences(c("lead.text")), 1, 2), " ")
    return a.select("story_id", R.hold_reason(c("lead.title"), lede, c("publishers")).alias("reason"))


over_articles("p23_headline_names", f"""len(list_filter(list_transform(regexp_extract_all(title, {q(R.NAME_WORD)}, 2), lambda w: regexp_extract(regexp_replace(w, '^[''’.-]+|[''’.-]+$', '', 'g'), '^[^''’]*', 0)),
  lambda w: w <> '' AND lower(w) NOT IN {listed(R.NOT_NAMES)} AND regexp_matches(w, '[A-Z]'))) > 0 AS named""", lambda: dict(named=R.names_someone(c("title"))))

_TERM = "trim(name)"


@query("p28_discovery_terms", f"SELECT DISTINCT name FROM {{ent}} WHERE length({_TERM}) BETWEEN 3 AND 39 AND NOT {hit(_TERM, R.GENERIC_TERM)} UNION SELECT DISTINCT title FROM {{art}} WHERE length(trim(title)) BETWEEN 3 AND 39 AND NOT {hit('trim(title)', R.GENERIC_TERM)}")
def p28(s: SparkSession, d: str) -> DataFrame:
    """Names and short titles that may be searched for."""
    names = entities(s, d).select("name").unionByName(articles(s, d).select(c("title").alias("name")))
    return names.where(R.discovery_term(c("name"))).distinct()


_CARD = "regexp_replace(text, '[‐-―−]', '-', 'g')"
over_articles("p29_card_screen", f"CASE WHEN {hit(f'regexp_replace({_CARD}, {q(chr(40) + '?i)' + R.NO_COURSE)}, {q(' ')}, {q('g')})', R.COURSE)} THEN 'course' WHEN {hit(_CARD, R.DEVELOPER)} AND NOT {hit(_CARD, R.NO_CODE)} THEN 'developer' END AS screen",
              lambda: dict(screen=R.card_screen(c("text"))))

_CLAIM = rf"""split_part(regexp_replace(regexp_replace(regexp_replace(said, '([a-z]{{4}})[.!]\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '([a-z]{{3}}[''’”"])[.!]\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\s[—–-]\s|[—–]|:\s', chr(1), 'g'), chr(1), 1)"""
_CLAIM = f"regexp_replace({_CLAIM}, {q('(?i)' + R.RELATIVE_HEDGE)}, ' ', 'g')"
_CLAIM = rf"replace(regexp_replace(regexp_replace({_CLAIM}, '(?i)\bopinion:', chr(2) || ':', 'g'), '(?i)\bopinion\b', ' ', 'g'), chr(2), 'opinion')"
_ASKS = rf"contains(said, '?') AND {n_words(rf"regexp_replace(regexp_extract(said, '(?s)\?([^?]*)$', 1), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")} <= 2"
_REAL = rf"{_ASKS} AND NOT regexp_matches(regexp_extract(said, '(?s)^(.*)\?', 1), '[.!]\s+\S') AND NOT ({hit('said', R.OPEN_QUESTION)} AND NOT {hit('said', r'^[^\p{L}\p{N}_]*what\s+if')})"
_KEPT = f"contains(title, '?') OR {hit('title', rf'(?:{R.SOURCE_HEDGES}|{R.ATTRIBUTIONS})')} OR {hit('title', R.OPEN_CLAIMS)}"
over_articles("p40_hedged_headline", f"({hit(_CLAIM, rf'(?:{R.SOURCE_HEDGES})')} OR {_REAL}) AS hedged, trim(said) <> trim(title) AND trim(title) <> '' AND ({hit(_CLAIM, rf'(?:{R.SOURCE_HEDGES})')} OR {_REAL}) AND NOT ({_KEPT}) AS dropped FROM (SELECT id, title, split_part(text, chr(10), 2) AS said FROM {{art}})",
              lambda: dict(hedged=R.claim_hedged(F.split_part("text", F.lit("\n"), F.lit(2))), dropped=R.hedge_dropped(F.split_part("text", F.lit("\n"), F.lit(2)), c("title"))))

# -- money and deals: the claim is that the company a later line begins with did a deal of the text's first amount --------------------------

_SCALE = " ".join(f"WHEN {q(k)} THEN {v!r}" for k, v in R.SCALES.items())
_RATE = " ".join(f"WHEN {q(k)} THEN {v!r}" for k, v in R.RATES.items())


def money_sql(text: str) -> str:
    groups = [f"regexp_extract_all({text}, {q('(?i)' + R.MONEY)}, {i})" for i in (1, 2, 3, 4)]
    rows = f"list_zip({', '.join(groups)})"
    cur, unit = "lower(coalesce(nullif(x[1], ''), x[4], ''))", "lower(coalesce(x[3], ''))"
    real = f"list_filter({rows}, lambda x: NOT ({cur} = '' AND {unit} IN ('', 't', 'b', 'm', 'k')))"
    value = f"CAST(replace(x[2], ',', '') AS DOUBLE) * CASE {unit} {_SCALE} ELSE 1 END"
    return f"flatten(list_transform({real}, lambda x: CASE WHEN {cur} IN {listed(list(R.RATES))} THEN [{value} * CASE {cur} {_RATE} END, {value}] ELSE [{value}] END))"


over_articles("f34_money", f"len(m) AS n, round(coalesce(list_sum(m), 0) / 1e3, 4) AS total FROM (SELECT id, {money_sql('text')} AS m FROM {{art}})",
              lambda: dict(n=F.size(R.money(c("text"))).cast("long"), total=F.round(F.aggregate(R.money(c("text")), F.lit(0.0), lambda a, x: a + x) / 1e3, 4)))
over_articles("f35_amount_in_text", f"len(list_filter({money_sql('text')}, lambda v: v > 0 AND points > 0 AND abs(v - points) <= 0.25 * greatest(v, points))) > 0 AS found",
              lambda: dict(found=F.exists(R.money(c("text")), lambda v: R.close(v, c("points").cast("double")))))
over_articles("f36_past_year", f"{hit('text', R.LAST_YEAR)} OR len(list_filter({found('text', R.PAST_YEAR_DEAL, 1)}, lambda y: CAST(y AS INTEGER) < {YEAR})) > 0 AS past", lambda: dict(past=R.past_year(c("text"), YEAR)))

_DEAL = f"""SELECT id, title AS head, text, regexp_extract(text, '\\n([A-Z][a-z]+)', 1) AS company, CASE WHEN {hit('text', R.ACQUISITION)} THEN 'acquisition' WHEN {hit('text', R.IPO)} THEN 'ipo' ELSE 'other' END AS kind,
  {money_sql('text')}[1] AS amount, points * 1.0 AS valuation, published_at, created_at FROM {{art}}"""


@query("p24_deal_ladder", f"""SELECT id, CASE WHEN company = '' THEN 'no company'
  WHEN length(company) >= 3 AND lower(company) NOT IN ('inc', 'ltd', 'the', 'labs') AND len(list_filter(regexp_extract_all(lower(head), '[a-z0-9]+'), lambda b: starts_with(b, lower(company)))) = 0 THEN 'company not named in the headline'
  WHEN {hit('head', R.SPECULATIVE)} THEN 'not a done deal' WHEN kind = 'ipo' AND NOT {hit('head', R.IPO)} THEN 'called an IPO, but the headline does not say so'
  WHEN NOT {hit('head', R.FUNDING)} AND {hit('head', R.LAUNCH)} THEN 'headline is about a product, not a deal' WHEN NOT {hit('head', R.FUNDING)} AND NOT {hit('text', R.FUNDING)} THEN 'nothing about a deal in the text'
  WHEN kind = 'acquisition' AND NOT {hit('head', R.ACQUISITION)} THEN 'called an acquisition, but the headline does not say so'
  WHEN amount IS NOT NULL AND NOT (amount > 0 AND amount <= {R.MOST_AMOUNT}) THEN 'implausible amount'
  WHEN amount IS NOT NULL AND len(list_filter({money_sql("(head || ' ' || text)")}, lambda v: v > 0 AND abs(v - amount) <= 0.25 * greatest(v, amount))) = 0 THEN 'amount not in the article''s text'
  WHEN amount >= 0.8 * valuation AND kind <> 'acquisition' THEN 'amount is the valuation'
  WHEN abs(date_diff('day', CAST(created_at AS DATE), CAST(published_at AS DATE))) > {R.STORY_DAYS} THEN 'article is not from the story''s time'
  WHEN {hit('(head || chr(10) || text)', R.LAST_YEAR)} OR len(list_filter({found('(head || chr(10) || text)', R.PAST_YEAR_DEAL, 1)}, lambda y: CAST(y AS INTEGER) < {YEAR})) > 0 THEN 'a deal from an earlier year' END AS problem FROM ({_DEAL})""")
def p24(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(R.has(c("text"), R.ACQUISITION), "acquisition").when(R.has(c("text"), R.IPO), "ipo").otherwise("other")
    company, amount = F.regexp_extract("text", r"\n([A-Z][a-z]+)", 1), F.get(R.money(c("text")), F.lit(0))
    return articles(s, d).select("id", R.deal_problem(company, kind, amount, c("points").cast("double"), c("title"), c("text"), c("published_at"), c("created_at"), YEAR).alias("problem"))


# -- headlines and plain words --------------------------------------------------------------------------------------------------------------

_CUT = r"regexp_replace(title, '^\s+|\s+$', '', 'g')"
_COUNT = lambda mark: f"(length(t) - length(replace(t, {q(mark)}, '')))"
over_articles("f31_usable_headline", rf"""length(t) >= {R.LEAST_HEADLINE} AND {n_words('t')} >= {R.LEAST_HEADLINE_WORDS} AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '^[\p{{L}}\p{{N}}_"“‘''(\[$£€]') AND NOT regexp_matches(t, '[,;:\-–—(\[|]$')
  AND {_COUNT('(')} = {_COUNT(')')} AND {_COUNT('[')} = {_COUNT(']')} AND {_COUNT('"')} % 2 = 0 AND {_COUNT('“')} = {_COUNT('”')} AS usable FROM (SELECT id, {_CUT} AS t FROM {{art}})""",
              lambda: dict(usable=R.usable_headline(c("title"))))
_FORMS = """[w, CASE WHEN ends_with(w, 'ies') THEN w[1:length(w) - 3] || 'y' END, CASE WHEN ends_with(w, 'es') THEN w[1:length(w) - 2] END, CASE WHEN ends_with(w, 's') THEN w[1:length(w) - 1] END,
  CASE WHEN ends_with(w, 'ing') THEN w[1:length(w) - 3] END, CASE WHEN ends_with(w, 'ing') THEN w[1:length(w) - 3] || 'e' END,
  CASE WHEN ends_with(w, 'ing') AND length(w) > 5 AND w[length(w) - 3:length(w) - 3] = w[length(w) - 4:length(w) - 4] THEN w[1:length(w) - 4] END]"""


@query("f40_verb_base", f"SELECT id, count(*) AS n, coalesce(string_agg(base, ',' ORDER BY place) FILTER (base IS NOT NULL), '') AS verbs FROM (SELECT id, place, list_filter({_FORMS}, lambda f: f IN {listed(R.VERBS)})[1] AS base FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w, unnest(range(len(regexp_extract_all(lower(text), '[a-z]+')))) AS place FROM {{art}})) GROUP BY id")
def f40(s: SparkSession, d: str) -> DataFrame:
    """A text's words, how many there are and the listed verbs among them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    bases = F.transform("w", lambda w: R.verb_base(w))
    return articles(s, d).select("id", words.alias("w")).where("size(w) > 0").select("id", F.size("w").cast("long").alias("n"), F.array_join(F.array_compact(bases), ",").alias("verbs"))


over_articles("f41_cost_kind", r"""CASE WHEN t = '' THEN 'unknown' WHEN contains(t, 'included') OR contains(t, 'already') THEN 'included' WHEN contains(t, 'free tier') OR contains(t, 'freemium') OR contains(t, 'free plan') THEN 'free tier'
  WHEN regexp_matches(t, '\$|\beur\b|€|£|paid|subscription|per month|/mo|per seat|credits') THEN 'paid' WHEN contains(t, 'free') THEN 'free' ELSE 'unknown' END AS kind,
  round(CAST(nullif(regexp_replace(regexp_extract(t, '[0-9][0-9,\s]*(\.[0-9]+)?', 0), '[,\s]', '', 'g'), '') AS DOUBLE), 2) AS amount FROM (SELECT id, regexp_replace(lower(text), '[ªµºÀ-ÖØ-öø-ɏ]', 'z', 'g') AS t FROM {art})""",
              lambda: dict(kind=_cost(F.lower(F.trim("text"))), amount=F.round(F.nullif(F.regexp_replace(F.regexp_extract("text", r"[0-9][0-9,\s]*(\.[0-9]+)?", 0), r"[,\s]", ""), F.lit("")).cast("double"), 2)))


def _cost(t: Column) -> Column:
    return (
        F.when(t == "", "unknown").when(t.contains("included") | t.contains("already"), "included").when(t.contains("free tier") | t.contains("freemium") | t.contains("free plan"), "free tier")
        .when(t.rlike(r"\$|\beur\b|€|£|paid|subscription|per month|/mo|per seat|credits"), "paid").when(t.contains("free"), "free").otherwise("unknown")
    )


_SWAPPED = r"trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[‐-―−]', '-', 'g'))"
for _pattern, _plain in R.SWAPS:
    _SWAPPED = f"regexp_replace({_SWAPPED}, {q('(?i)' + _pattern)}, {q(_plain)}, 'g')"
_SWAPPED = rf"regexp_replace(regexp_replace({_SWAPPED}, '\b([Aa])n (routine|connection|simpl\w*|set up|boost|let|made|help|best|features?|uses?|web)\b', '\1 \2', 'g'), '\b([Aa]) (AI\b)', '\1n \2', 'g')"
_SWAPPED = rf"trim(regexp_replace({_SWAPPED}, '\s+', ' ', 'g'))"
over_articles("f44_jargon_swaps", f"md5({_SWAPPED}) AS plain, len({found('text', R.JARGON)}) AS jargon", lambda: dict(plain=F.md5(R.swap_jargon(c("text"))), jargon=F.size(R.jargon(c("text"))).cast("long")))

_PLAIN_WORDS = lambda t: f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN {listed(R.PLAIN_STOP)}), lambda w: regexp_replace(w, '(ing|ed|es|s)$', '')))"
over_articles("f22_word_overlap", f"round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) * 1.0 / least(len(x), len(y)) END, 6) AS overlap FROM (SELECT id, {_PLAIN_WORDS('title')} AS x, {_PLAIN_WORDS('text')} AS y FROM {{art}})",
              lambda: dict(overlap=F.round(R.overlap(c("title"), c("text")), 6)))

#: Words that say nothing of a step, beside the general ones.
STEP_FILLER = """open click select choose pick then next first go tap press enter type paste copy use using make sure button menu option options page screen your want need like once done start find
    turn text field section tool into onto each every some any""".split()
_CONTENT = lambda t: f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({t}), '[a-z][a-z0-9''+-]*'), lambda w: length(w) >= 4 AND w NOT IN {listed(T.STOP + STEP_FILLER)}), lambda w: CASE WHEN ends_with(w, 'ing') AND length(w) >= 7 THEN w[1:length(w) - 3] WHEN ends_with(w, 'ed') AND length(w) >= 6 THEN w[1:length(w) - 2] WHEN ends_with(w, 'es') AND length(w) >= 6 THEN w[1:length(w) - 2] WHEN ends_with(w, 's') AND length(w) >= 5 THEN w[1:length(w) - 1] ELSE w END))"


def content_words(text: Column) -> Column:
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z0-9'+-]*"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.isin(T.STOP + STEP_FILLER))
    cut = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    stem = lambda w: F.when(w.endswith("ing") & (F.length(w) >= 7), cut(w, 3)).when(w.endswith("ed") & (F.length(w) >= 6), cut(w, 2)).when(w.endswith("es") & (F.length(w) >= 6), cut(w, 2)).when(w.endswith("s") & (F.length(w) >= 5), cut(w, 1)).otherwise(w)
    return F.array_distinct(F.transform(words, stem))


def grounded(step: Column, source: Column) -> Column:
    """At least two of a step's meaningful words (its only one), and half of them, are in the source."""
    x = content_words(step)
    both = F.size(F.array_intersect(x, content_words(source)))
    return (F.size(x) > 0) & (both >= F.least(F.lit(2), F.size(x))) & (both >= 0.5 * F.size(x))


@query("f48_step_grounding", f"SELECT id, len(x) > 0 AND len(list_intersect(x, y)) >= least(2, len(x)) AND len(list_intersect(x, y)) >= 0.5 * len(x) AS grounded FROM (SELECT a.id, {_CONTENT('a.title')} AS x, {_CONTENT('b.text')} AS y FROM {{art}} a JOIN {{art}} b ON b.id = a.story_id * 5)")
def f48(s: SparkSession, d: str) -> DataFrame:
    """Whether a title, as a step, is supported by the whole text of its story's first article."""
    a = articles(s, d)
    lead = a.select(c("id").alias("lead"), c("text").alias("source"))
    return a.select("id", "title", (c("story_id") * 5).alias("lead")).join(lead, "lead").select("id", grounded(c("title"), c("source")).alias("grounded"))


@query("f29_disciplined_headlines")
def f29(s: SparkSession, d: str) -> DataFrame:
    """Every title as a headline, disciplined against itself as the source title and the story's names."""
    named = entities(s, d).groupBy("article_id").agg(F.collect_list("name").alias("names"))
    a = articles(s, d).join(named, c("id") == c("article_id"), "left")
    return a.select("id", R.discipline(c("title"), c("title"), c("names")).alias("headline"))


@query("f30_restored_case")
def f30(s: SparkSession, d: str) -> DataFrame:
    """Every title in lower case with the capitals back that its own source title and the story's names give."""
    named = entities(s, d).groupBy("article_id").agg(F.collect_list("name").alias("names"))
    a = articles(s, d).join(named, c("id") == c("article_id"), "left")
    return a.select("id", R.restore_case(F.lower("title"), c("title"), c("names")).alias("headline"))


@query("f37_unsupported_claims")
def f37(s: SparkSession, d: str) -> DataFrame:
    """Figures of each text's first eight sentences that the first text of its story has no match for."""
    a = articles(s, d)
    lead = a.select(c("id").alias("lead"), c("text").alias("source"))
    claims = a.select("id", F.array_join(F.slice(T.sentences(c("text")), 1, 8), " ").alias("claim"), (c("story_id") * 5).alias("lead")).join(lead, "lead")
    return claims.select("id", R.unsupported_figures(c("claim"), c("source")).alias("figures")).select("id", F.size("figures").cast("long").alias("n"), F.array_join("figures", "|").alias("figures"))


@query("f46_phrases")
def f46(s: SparkSession, d: str) -> DataFrame:
    """The longest leading part of each title that can stand, in twelve words, and the title as an order."""
    return articles(s, d).select("id", R.cut_phrase(c("title"), 12).alias("cut"), R.imperative(c("title")).alias("imperative"))


@query("f47_plain_cards")
def f47(s: SparkSession, d: str) -> DataFrame:
    """Each article as a plain card: what is wrong with its title as a headline, what it does, its catch and its uses."""
    parts = lambda said: F.struct(F.get(said, F.lit(0)).alias("first"), F.element_at(F.concat(F.array(F.lit("")), said), -1).alias("last"), F.slice(said, 2, 6).alias("uses"))
    a = articles(s, d).select("id", "title", T.let(T.sentences(c("text")), parts).alias("said")).select("id", "title", "said.*")
    return a.select("id", F.array_join(R.headline_problems(c("title")), ",").alias("problems"), R.plain_what(c("first")).alias("what"), R.plain_catch(c("last")).alias("catch"), F.array_join(R.plain_uses(c("uses")), "; ").alias("uses"))


@query("x10_verified_summaries")
def x10(s: SparkSession, d: str) -> DataFrame:
    """Each article's summary checked against its story's first article: figures and names that one doesn't have, and the summary without the
    sentences that hold them, where the source is long enough to judge."""
    a = articles(s, d)
    names = entities(s, d).groupBy("article_id").agg(F.collect_list("name").alias("names"))
    lead = a.select(c("id").alias("lead"), c("text").alias("source"))
    claims = a.select("id", F.array_join(F.slice(T.sentences(c("text")), 1, 8), " ").alias("claim"), (c("story_id") * 5).alias("lead")).join(lead, "lead").join(names, c("id") == c("article_id"), "left")
    judge = F.length("source") >= R.LEAST_SOURCE
    bad = F.when(judge, F.array_distinct(F.concat(R.unsupported_figures(c("claim"), c("source")), R.unsupported_names(c("names"), c("claim"), c("source"))))).otherwise(F.array().cast("array<string>"))
    return claims.select("id", "claim", bad.alias("bad")).select("id", F.array_join("bad", ",").alias("unsupported"), R.drop_sentences(c("claim"), c("bad")).alias("safe"))


@query("t01_ingest_validation", r"""SELECT event_id, CASE WHEN NOT EXISTS (SELECT 1 FROM {art} a WHERE a.story_id = e.story_id) THEN 'unknown story' WHEN length(session) > 40 OR length(who) > 40 OR length(source) > 60 OR length(tz) > 40 OR length(detail) > 100 THEN 'payload too large'
  WHEN type NOT IN ('view', 'click_source', 'dwell', 'follow', 'search') OR NOT (value BETWEEN 0 AND 3600) THEN 'policy' ELSE 'accept' END AS verdict, CASE WHEN type = 'search' THEN regexp_replace(regexp_replace(lower(trim(detail)), '\S+@\S+', '', 'g'), '[0-9]{5,}', '', 'g')[1:100] ELSE detail END AS detail
  FROM (SELECT e.*, p.props AS detail FROM {ev} e JOIN events p ON p.event_id = e.event_id) e""")
def t01(s: SparkSession, d: str) -> DataFrame:
    """What an ingested event is: of a story that isn't known, too large, against the policy, or accepted; a search's detail loses addresses and numbers."""
    raw = load(s, d, "events").select(c("event_id").alias("key"), c("props").alias("detail"))
    known = articles(s, d).select(c("story_id").alias("known")).distinct()
    e = events(s, d).join(raw, c("event_id") == c("key")).join(known, c("story_id") == c("known"), "left")
    large = (F.length("session") > 40) | (F.length("who") > 40) | (F.length("source") > 60) | (F.length("tz") > 40) | (F.length("detail") > 100)
    policy = ~c("type").isin("view", "click_source", "dwell", "follow", "search") | ~c("value").between(0, 3600)
    verdict = F.when(c("known").isNull(), "unknown story").when(large, "payload too large").when(policy, "policy").otherwise("accept")
    clean = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim("detail")), r"\S+@\S+", ""), "[0-9]{5,}", ""), 1, 100)
    return e.select("event_id", verdict.alias("verdict"), F.when(c("type") == "search", clean).otherwise(c("detail")).alias("detail"))


#: Origins that the site's own pages send.
ORIGINS = ["https://google.com"]


@query("p34_client_screens", f"""SELECT event_id, CASE WHEN origin <> '' AND origin NOT IN {listed(ORIGINS)} AND NOT regexp_matches(origin, {q(R.TRANSLATED)}) THEN 'origin' WHEN regexp_matches(agent, {q(R.PROGRAMS)}) OR regexp_matches(agent, {q(R.CRAWLERS)}) THEN 'client' WHEN origin = '' THEN 'noorigin' WHEN agent = '' THEN 'noagent' ELSE 'ok' END AS verdict
  FROM (SELECT e.event_id, CASE WHEN e.source = 'direct' THEN '' ELSE 'https://' || e.source END AS origin, lower(p.props) AS agent FROM {{ev}} e JOIN events p ON p.event_id = e.event_id)""")
def p34(s: SparkSession, d: str) -> DataFrame:
    """The referring site as the origin, the properties as the client's name."""
    raw = load(s, d, "events").select(c("event_id").alias("key"), c("props").alias("agent"))
    origin = F.when(c("source") == "direct", "").otherwise(F.concat(F.lit("https://"), "source"))
    return events(s, d).join(raw, c("event_id") == c("key")).select("event_id", R.client_verdict(origin, c("agent"), ORIGINS).alias("verdict"))


@query("p42_moderation", f"SELECT id, CASE WHEN coalesce(toxic, 0) = 1 THEN 'unpublished' WHEN domain IN {listed(R.BLOCKED_DOMAINS)} THEN 'blocked domain' WHEN {hit('title', R.BLOCKED_TITLE)} THEN 'blocked word' WHEN quality = 1 AND importance >= 9 THEN 'pinned' ELSE status END AS status FROM {{art}} LEFT JOIN labels ON doc_id = id")
def p42(s: SparkSession, d: str) -> DataFrame:
    """Moderators' labels first, then domains and words, then pins; else the status stays."""
    said = (
        F.when(F.coalesce("toxic", F.lit(0)) == 1, "unpublished").when(c("domain").isin(R.BLOCKED_DOMAINS), "blocked domain").when(R.has(c("title"), R.BLOCKED_TITLE), "blocked word")
        .when((c("quality") == 1) & (c("importance") >= 9), "pinned").otherwise(c("status"))
    )
    return articles(s, d).join(load(s, d, "labels"), c("id") == c("doc_id"), "left").select("id", said.alias("status"))


@query("s03_feed_entry", r"""SELECT page_id, link, title, description FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS link, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') AS host, trim(regexp_extract(html, '<title>([^<]*)</title>', 1))[1:300] AS title,
  trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '[ \n\t\r]+', ' ', 'g'))[1:1000] AS description FROM pages) WHERE (host = 'example.com' OR ends_with(host, '.example.com')) AND title <> '' AND link <> ''""")
def s03(s: SparkSession, d: str) -> DataFrame:
    """Pages of the kept domain as feed entries: link without query, title and description cut to size; entries without either go."""
    html_text = F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1), "<[^>]+>", " ")
    description = F.substring(F.trim(F.regexp_replace(html_text, "[ \n\t\r]+", " ")), 1, 1000)
    e = load(s, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("link"), U.host(c("url")).alias("host"), F.substring(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), 1, 300).alias("title"), description.alias("description"))
    return e.where(U.on_domain(c("host"), F.lit("example.com")) & (c("title") != "") & (c("link") != "")).drop("host")


# -- URLs, pages and marks: of the tables' own columns ----------------------------------------------------------------------------------------


def over_pages(key: str, sql: str, columns) -> None:
    @query(key, f"SELECT page_id, {sql}" if " FROM " in sql else f"SELECT page_id, {sql} FROM pages")
    def run(s: SparkSession, d: str) -> DataFrame:
        return load(s, d, "pages").select("page_id", *[x.alias(k) for k, x in columns().items()])


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"
over_pages("f03_registrable_domain", f"array_to_string(l[greatest(1, len(l) - CASE WHEN len(l) >= 3 AND length(l[len(l)]) = 2 AND l[len(l) - 1] IN {listed(U.SECOND_LEVELS)} THEN 2 ELSE 1 END):len(l)], '.') AS domain FROM (SELECT page_id, string_split({_HOST}, '.') AS l FROM pages)",
           lambda: dict(domain=U.registrable(U.host(c("url")))))
over_pages("p07_skip_domain", f"h IN {listed(U.SKIP)} OR h = 'msn.com' OR ends_with(h, '.msn.com') AS skipped, h = 'example.com' OR ends_with(h, '.example.com') AS on_domain FROM (SELECT page_id, {_HOST} AS h FROM pages)",
           lambda: dict(skipped=U.skipped(U.host(c("url"))), on_domain=U.on_domain(U.host(c("url")), F.lit("example.com"))))
over_pages("p41_path_predicates", r"""regexp_matches(p, '^/(topic|models|category|daily|en|fr|de|es)/[^/]+/[0-9]+$') OR regexp_matches(p, '^/threads/[0-9]+$') AS older, regexp_matches(p, '^/(en|fr|de|es)/[0-9]+$') AS leaf
  FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '\.html$', ''), '/$', '') AS p FROM pages)""",
           lambda: dict(older=U.older_list_page(U.path(c("url")), ("topic", "models", "category", "daily", "en", "fr", "de", "es")), leaf=U.path(c("url")).rlike("^/(en|fr|de|es)/[0-9]+$")))
over_pages("f10_url_date", r"CAST(nullif(regexp_extract(url, '/((19|20)[0-9]{2})/(0[1-9]|1[0-2])(/|$)', 1), '') AS INTEGER) AS year, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS number, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page",
           lambda: dict(year=F.year(U.url_date(c("url"))), number=F.regexp_extract("url", "/([a-z]{2})/([0-9]+)", 2), page=F.regexp_extract("url", "[?&]page=([0-9]+)", 1)))
over_pages("f60_page_date", r"try_strptime(nullif(regexp_extract(html, '\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b', 1), ''), '%Y-%m-%d') IS NOT NULL AS dated, regexp_extract(html, '\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b', 1) AS raw",
           lambda: dict(dated=U.page_date(F.regexp_extract("html", r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1)).isNotNull(), raw=F.regexp_extract("html", r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1)))
over_pages("f75_link_in_description", rf"""list_filter(list_transform(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1), lambda x: trim(replace(x, '&amp;', '&'))), lambda x: regexp_matches(x, '^https?://[^/?#]') AND NOT regexp_matches(x, '^https?://[^/?#]+/?$'))[1] AS link,
  len(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1)) AS n""", lambda: dict(link=U.link_in(c("html"), U.host(c("url"))), n=F.size(U.links(c("html"))).cast("long")))

over_articles("f09_title_year", r"CAST(list_min(list_transform(regexp_extract_all(regexp_extract(title, '(\s*[\(\[][^()\[\]]{1,12}[\)\]])+\s*$', 0), '[\(\[]\s*((19|20)[0-9][0-9])\s*[\)\]]', 1), lambda y: CAST(y AS INTEGER))) AS INTEGER) AS year, list_min(list_transform(regexp_extract_all(text, '\b((19|20)[0-9][0-9])\b', 1), lambda y: CAST(y AS INTEGER))) AS text_year",
              lambda: dict(year=T.title_year(c("title")), text_year=F.array_min(F.transform(F.regexp_extract_all("text", F.lit(r"\b((19|20)[0-9][0-9])\b"), F.lit(1)), lambda y: y.cast("int")))))
over_articles("f64_reset_header", r"""round(coalesce(list_sum(list_transform(list_zip(regexp_extract_all(text, '([0-9.]*[0-9][0-9.]*)([hms])', 1), regexp_extract_all(text, '([0-9.]*[0-9][0-9.]*)([hms])', 2)), lambda x: coalesce(TRY_CAST(x[1] AS DOUBLE), 0) * CASE x[2] WHEN 'h' THEN 3600 WHEN 'm' THEN 60 ELSE 1 END)), 0), 3) AS seconds""",
              lambda: dict(seconds=F.round(T.seconds_of(c("text")), 3)))
over_articles("f68_model_mark", r"split_part(split_part(coalesce(nullif(split_part(text, ' ', 2), ''), 'heuristic'), ':', 1), '+', 1) AS provider, CAST(nullif(regexp_extract(trim(text), '\+u([0-9]{1,9})$', 1), '') AS BIGINT) AS ups",
              lambda: dict(provider=T.provider(F.coalesce(F.nullif(F.split_part("text", F.lit(" "), F.lit(2)), F.lit("")), F.lit("heuristic"))), ups=T.upgrades(F.trim("text"))))


over_pages("s02_repair_xml", r"""md5(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?(<\?xml|<!DOCTYPE|<html\b|<rss\b|<feed\b|<rdf:RDF\b)', '\1'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '&([A-Za-z][A-Za-z0-9]{0,31}|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});', chr(1) || '\1;', 'g'), '&', '&amp;'), chr(1), '&')) AS repaired""",
           lambda: dict(repaired=F.md5(html.repaired(c("html")))))


@query("f63_json_from_prose", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, md5(props) AS raw FROM events")
def f63(s: SparkSession, d: str) -> DataFrame:
    """The object inside a model's wordy answer, here an event's properties with words and fences around them."""
    said = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    return load(s, d, "events").select("event_id", F.from_json(T.json_in(said), "k long")["k"].alias("k"), F.md5(T.json_in(said)).alias("raw"))


over_articles("f62_clamped_answer", r"""greatest(1, least(10, coalesce(TRY_CAST(nullif(regexp_extract(text, '[0-9]+', 0), '') AS INTEGER), 5))) AS importance, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'other' END AS lang,
  array_to_string(list_filter(list_transform(string_split(text, chr(10))[1:3], lambda x: trim(regexp_replace(x, '^[ \t]*([-*•–]|[0-9]{1,2}[.)])[ \t]+', ''))), lambda x: x <> ''), ' | ') AS points""",
              lambda: dict(importance=F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(F.regexp_extract("text", "[0-9]+", 0).try_cast("int"), F.lit(5)))), lang=F.when(c("lang").isin("en", "de"), c("lang")).otherwise("other"),
              points=F.array_join(F.filter(F.transform(F.slice(F.split("text", "\n"), 1, 3), lambda x: F.trim(F.regexp_replace(x, r"^[ \t]*([-*•–]|[0-9]{1,2}[.)])[ \t]+", ""))), lambda x: x != ""), " | ")))
