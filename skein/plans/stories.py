"""Queries of model launches and of stories that are one event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.bind import articles, entities, load, releases
from skein.functions import leads as L
from skein.functions import models as M
from skein.operators import clusters
from skein.operators import duplicates as D
from skein.operators.folding import fold_versions
from skein.operators.similarity import mean_vectors
from skein.registry import query
from skein.shared import discard, scratch, settle

c = F.col


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PLAIN = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9.]+', ' ', 'g'))"
_LAB = f"""regexp_replace(regexp_replace(replace(replace({_PLAIN.format('lab')}, 'google deepmind', 'google'), 'deepmind', 'google'),
  {_sql(M.ORG_WORDS)}, ' ', 'g'), '[^a-z0-9]', '', 'g')"""
#: Mentions with the lab's key, the words that tell the name and the model's key.
_KEYED = f"""(SELECT *, replace(array_to_string(words, ''), '.', '') || '|' || org AS key FROM (
  SELECT *, list_filter(list_transform(string_split_regex(trim(regexp_replace(lower(regexp_replace(name, {_sql(M.FILE_SUFFIX)}, '')), '[^a-z0-9.]+', ' ', 'g')), ' +'), lambda w: trim(w, '.')),
    lambda w: w <> '' AND w <> org AND (length(w) >= 3 OR regexp_matches(w, '[0-9]'))) AS words FROM (SELECT *, {_LAB} AS org FROM {{rel}})))"""
_SAID = f"replace({_PLAIN.format('headline')}, ' ', '')"
_RELEASE = f"""(SELECT * FROM {_KEYED} WHERE trim(name) <> '' AND lower(trim(lab)) NOT IN ({', '.join(map(_sql, M.UNKNOWN))}) AND NOT regexp_matches(trim(lab), {_sql(M.NOT_LABS)})
  AND NOT contains(name, ',') AND NOT regexp_matches(name, {_sql(M.COMPARISON)}) AND NOT regexp_matches(headline, {_sql(M.COMPARISON)}) AND trim(lower(availability)) <> 'research'
  AND (trim(lower(availability)) IN ({', '.join(map(_sql, M.USABLE))}) OR regexp_matches(headline, {_sql(M.LAUNCH_WORDS)})) AND len(words) > 0 AND contains({_SAID}, words[1])
  AND len(list_filter(words, lambda w: contains({_SAID}, w))) >= 0.6 * len(words))"""


@query("p25_is_release", f"SELECT article_id, name, key FROM {_RELEASE}")
def p25(s: SparkSession, d: str) -> DataFrame:
    """Mentions that launch a model, with the model's key."""
    launched = releases(s, d).where(M.is_release(c("name"), c("lab"), c("availability"), c("headline")))
    return launched.select("article_id", "name", M.model_key(c("name"), c("lab")).alias("key"))


_ROWS = f"(SELECT key, count(DISTINCT source_id) AS sources, min(published_at) AS first_at FROM {_KEYED} GROUP BY key)"
_FOLDED = rf"""WITH RECURSIVE rows AS {_ROWS},
parts AS (SELECT key, split_part(key, '|', 1) AS name, split_part(key, '|', 2) AS org FROM rows),
steps AS (
  SELECT x.key, arg_min(y.key, (length(y.key), y.key)) AS parent FROM parts x JOIN parts y
    ON x.org = y.org AND x.name <> '' AND x.key <> y.key AND starts_with(y.name, x.name) AND regexp_full_match(substr(y.name, length(x.name) + 1), 'v?[0-9][0-9.]*')
  GROUP BY x.key),
up AS (SELECT key, key AS root, 0 AS n FROM rows UNION ALL SELECT up.key, steps.parent, n + 1 FROM up JOIN steps ON steps.key = up.root),
roots AS (SELECT key, arg_max(root, n) AS root FROM up GROUP BY key)
SELECT root AS key, CAST(sum(sources) AS BIGINT) AS sources, min(first_at) AS first_at, count(*) AS folded FROM roots JOIN rows USING (key) GROUP BY root"""


@query("a30_version_folding", _FOLDED, dates="first_at")
def a30(s: SparkSession, d: str) -> DataFrame:
    """Models by key, those named without a version folded into the version that they are."""
    keyed = releases(s, d).groupBy(M.model_key(c("name"), c("lab")).alias("key")).agg(F.count_distinct("source_id").alias("sources"), F.min("published_at").alias("first_at"))
    return fold_versions(keyed, "a30").withColumn("first_at", c("first_at").cast("string"))


# -- leads ------------------------------------------------------------------------------------------------------------------------------------

_NEWS = f"""(coalesce({{1}}, 'news') NOT IN ({', '.join(map(_sql, L.NOT_NEWS))}) AND NOT (trim({{0}}) <> '' AND (ends_with(trim({{0}}), '?')
  OR regexp_matches(trim({{0}}), {_sql(L.OPINION_START)}) OR regexp_matches(trim({{0}}), {_sql(L.FIRST_PERSON)}))))"""
_PAIRS = f"""(SELECT id, story_id, lag(id) OVER w AS was, {_NEWS.format('title', 'content_type')} AS news, importance, source_type = 'primary' AS first_hand,
  lag({_NEWS.format('title', 'content_type')}) OVER w AS news0, lag(importance) OVER w AS importance0, lag(source_type = 'primary') OVER w AS first_hand0
  FROM {{art}} WINDOW w AS (PARTITION BY story_id ORDER BY id))"""


@query("o16_better_lead", f"""SELECT id, was, CASE WHEN news <> news0 THEN news WHEN news AND first_hand AND NOT first_hand0 THEN importance >= importance0
  ELSE importance >= importance0 + {L.LEAD_MARGIN} END AS takes_over FROM {_PAIRS} WHERE was IS NOT NULL""")
def o16(s: SparkSession, d: str) -> DataFrame:
    """Whether each article of a story would take the lead over from the one before it."""
    w = Window.partitionBy("story_id").orderBy("id")
    a = articles(s, d).select("id", "story_id", F.struct(L.news_ok(c("title"), c("content_type")).alias("news"), "importance", (c("source_type") == "primary").alias("primary")).alias("new"))
    both = a.withColumns({"was": F.lag("id").over(w), "now": F.lag("new").over(w)}).where("was IS NOT NULL")
    side = lambda n: {k: c(n)[k] for k in ("news", "importance", "primary")}
    return both.select("id", "was", L.better_lead(side("new"), side("now")).alias("takes_over"))


# -- one event --------------------------------------------------------------------------------------------------------------------------------

#: Cosine from which two vectors of the given tables, which are nearly random, are taken to be of one event.
LEAST = 0.25
#: Merges of a run, and the cosines down to which their pairs are looked for in turn; None: all.
MERGES, BARS = 10, (0.8, 0.5, None)
_STOPPED = "(" + ", ".join(map(_sql, L.HEADLINE_STOP)) + ")"
_TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_FACTS = f"""SELECT *, min((t, story_id)) OVER p AS head, max((t, story_id)) OVER p AS tail FROM (
  SELECT *, CAST(floor(t / 604800) AS BIGINT) AS span, list_distinct(said) AS words, CASE WHEN len(said) >= 3 THEN array_to_string(list_sort(said), ' ') ELSE '#' || story_id END AS class FROM (
    SELECT vec_id AS story_id, epoch(published_at) AS t, label AS topic, CAST(embedding AS DOUBLE[]) AS v,
      list_filter(string_split_regex(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' +'), lambda w: w <> '' AND w NOT IN {_STOPPED}) AS said,
      (SELECT list_sort(list(DISTINCT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')))) FROM {{ent}} e WHERE e.article_id = vec_id) AS names
    FROM embeddings JOIN {{art}} ON id = vec_id)) WINDOW p AS (PARTITION BY class, span)"""
_SAME_EVENT = f"""WITH facts AS ({_FACTS}), one AS (SELECT * FROM facts WHERE struct_extract(head, 2) = story_id),
met AS (
  SELECT a.story_id AS a, b.story_id AS b, round(list_dot_product(a.v, b.v), 6) AS sim, list_sort(list_intersect(a.names, b.names)) AS shared, a.topic = b.topic AS one_topic,
    len(list_intersect(a.words, b.words)) / nullif(len(list_distinct(list_concat(a.words, b.words))), 0) AS alike
  FROM one a JOIN one b ON a.story_id < b.story_id AND abs(a.t - b.t) <= 604800 AND a.class <> b.class),
judged AS (
  SELECT a, b, sim, CASE WHEN sim >= {LEAST} AND len(shared) >= 2 THEN printf('%.2f alike, both about ', sim) || {_TITLE.format('shared[1]')} || ' and ' || {_TITLE.format('shared[2]')}
    WHEN sim >= {LEAST} AND len(shared) = 1 AND coalesce(alike, 0) >= 0.4 THEN printf('%.2f alike, both about ', sim) || {_TITLE.format('shared[1]')}
    WHEN sim >= {LEAST} + 0.05 AND one_topic THEN printf('%.2f alike', sim) END AS sure,
    CASE WHEN sim >= {LEAST} - 0.06 AND one_topic AND len(shared) >= 1 THEN printf('%.2f alike, both about ', sim) || {_TITLE.format('shared[1]')} END AS maybe FROM met),
ends AS (SELECT class, span, any_value(head) AS head, any_value(tail) AS tail FROM facts GROUP BY ALL),
links AS (
  SELECT struct_extract(head, 2) AS x, story_id AS y FROM facts WHERE struct_extract(head, 2) <> story_id UNION
  SELECT struct_extract(p.tail, 2), struct_extract(q.head, 2) FROM ends p JOIN ends q ON q.class = p.class AND q.span = p.span + 1 AND struct_extract(q.head, 1) - struct_extract(p.tail, 1) <= 604800)
SELECT a, b, sim, coalesce(sure, maybe) AS reason, sure IS NOT NULL AS merge FROM judged WHERE sure IS NOT NULL OR maybe IS NOT NULL
UNION ALL SELECT least(x, y), greatest(x, y), round(list_dot_product(p.v, q.v), 6), 'the same headline', true FROM links JOIN facts p ON p.story_id = x JOIN facts q ON q.story_id = y"""


@query("j14_same_event", _SAME_EVENT)
def j14_same_event(s: SparkSession, d: str) -> DataFrame:
    """Pairs of the vectors' stories that are one event by headline, names, words and vector, with the reason, and those just under the bar."""
    names = entities(s, d).groupBy("article_id").agg(F.collect_set("name").alias("names"))
    e = load(s, d, "embeddings").select("vec_id", c("embedding").alias("v"), c("label").alias("topic"))
    a = articles(s, d).select("id", c("title").alias("headline"), c("published_at").alias("at"))
    rows = e.join(a, c("vec_id") == c("id")).join(names, c("vec_id") == c("article_id"), "left")
    return D.same_event(rows.select(c("vec_id").alias("story_id"), "headline", "names", "at", "v", "topic"), LEAST, "j14")


def _members(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d).where("status IN ('published', 'overflow')")
    return a.select("id", "story_id", c("title").alias("headline"), c("content_type").alias("kind"), "importance", (c("source_type") == "primary").alias("primary"), (c("status") == "published").alias("shown"), c("published_at").alias("at"), "category")


def _merges(s: SparkSession, d: str, label: str) -> DataFrame:
    """Merges among stories of several articles: the headline is the lead's, the vector the members' mean, the names all that they mention."""
    members = _members(s, d)
    work = scratch(f"{label}-work")
    leads = D.merged_stories(members, s.createDataFrame([], "kept long, gone long"), f"{work}/leads").select("story_id", "lead", "n", c("first_at").alias("at"))
    told = members.select(c("id").alias("lead"), "headline", c("category").alias("topic"))
    names = entities(s, d).groupBy("story_id").agg(F.collect_set("name").alias("names"))
    of = members.select("id", "story_id").join(load(s, d, "embeddings"), c("id") == c("vec_id")).select("story_id", c("embedding").cast("array<double>").alias("v"))
    means = mean_vectors(of, "story_id", "v").withColumnRenamed("mean", "v")
    rows = settle(leads.join(told, "lead", "left").join(names, "story_id", "left").join(means, "story_id", "left"), f"{label}-stories")
    discard(s, work)
    facts = D.story_facts(rows.select("story_id", "headline", "names", "at", "v", "topic"), 7, label)
    blind = D.blind_pairs(facts, 7, label)
    for bar in BARS:  # the likest pairs come first: those under a bar count only where the ones over it make too few merges
        pairs = D.told_events(facts, LEAST, label, bar=bar, blind=blind).where("merge")
        done = settle(D.merges(pairs, rows.select("story_id", "at", "n"), label, most=MERGES), f"{label}-done")
        if done.count() == MERGES:
            break
    return done


@query("x04_story_merges")
def x04(s: SparkSession, d: str) -> DataFrame:
    """The first ten merges of stories that are one event, most alike first."""
    return _merges(s, d, "x04")


@query("u11_story_merge")
def u11(s: SparkSession, d: str) -> DataFrame:
    """Stories after the merges: redirects of those that are gone, leads chosen anew, members, first dates and importance of the others."""
    return D.merged_stories(_members(s, d).drop("category"), _merges(s, d, "u11"), "u11").withColumn("first_at", c("first_at").cast("string"))


# -- online clusters --------------------------------------------------------------------------------------------------------------------------


@query("x01_clusters_over_runs")
def x01_runs(s: SparkSession, d: str) -> DataFrame:
    """Each vector's article with the story that it joins, placed in two runs, the second of which starts from the first one's open stories."""
    e = load(s, d, "embeddings").select("vec_id", c("label").alias("topic"), c("embedding").alias("v"))
    a = articles(s, d).select("id", c("published_at").alias("at"), L.news_ok(c("title"), c("content_type")).alias("news"), "importance", (c("source_type") == "primary").alias("primary"))
    rows = settle(e.join(a, c("vec_id") == c("id")).drop("vec_id"), "x01-articles")
    noon = F.lit("2024-01-16 00:00:00").cast("timestamp")
    first, state = clusters.place(rows.where(c("at").cast("timestamp") < noon), None, 0.3, "x01-one")
    second, _ = clusters.place(rows.where(c("at").cast("timestamp") >= noon), settle(state, "x01-state"), 0.3, "x01-two")
    return first.unionByName(second)
