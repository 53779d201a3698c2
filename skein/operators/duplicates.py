"""Stories that are one event: pairs by headline, names and vectors without trying all pairs, merges in order of likeness, and what is left of
the stories after them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import leads as L
from skein.functions import text as T
from skein.operators.similarity import block_pairs
from skein.shared import discard, scratch, settle

DAY = 86_400
#: Stories of a stretch of time whose vectors are multiplied by another such block, and pairs of them that a task looks at at once.
BLOCK, PAIRS = 16_000, 4_000_000
#: Longs of a sketch of a headline's words.
SKETCH = 4
#: What a pair of stories is judged by: its cosine, the number of shared names and the first two, the share of words and whether the topic is one.
TOLD = "a long, b long, sim double, n int, first string, second string, alike double, one_topic boolean"


def story_facts(stories: DataFrame, days: int, label: str) -> DataFrame:
    """stories (story_id, headline, names, at, v, topic) with their words, name keys, headline class, the stretch of `days` days that they lie in and
    the length of their vector, if it is whole (long).

    A headline class is a headline's sorted words, if there are three or more; else the story is a class of its own. Stories of a class in
    one stretch are represented by the first of them (rep)."""
    t = F.unix_micros(F.col("at").cast("timestamp")) / 1_000_000
    words = L.headline_words(F.col("headline"))
    facts = stories.select("story_id", t.alias("t"), words.alias("said"), L.name_keys(F.col("names")).alias("names"), "v", "topic")
    same = F.when(F.size("said") >= 3, F.array_join(F.array_sort("said"), " ")).otherwise(F.concat(F.lit("#"), F.col("story_id").cast("string")))
    long = F.when(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()), F.size("v"))
    facts = facts.select("*", same.alias("class"), F.floor(F.col("t") / (days * DAY)).alias("span"), F.array_distinct("said").alias("words"), long.alias("long")).drop("said")
    work, spark = scratch(f"{label}-work"), facts.sparkSession
    facts = settle(facts, f"{work}/facts")
    ends = facts.groupBy("class", "span").agg(F.min(F.struct("t", "story_id")).alias("first"), F.max(F.struct("t", "story_id")).alias("last"))
    facts = settle(facts.join(settle(ends, f"{work}/ends"), ["class", "span"]).withColumn("rep", F.col("first.story_id")), f"{label}-story-facts")
    discard(spark, work)
    return facts


def headline_links(facts: DataFrame, days: int) -> DataFrame:
    """(a, b) of stories with the same headline within `days` days: each story with the first of its stretch, and a stretch's last story with the first of
    the next one. Whatever all pairs would connect these do; a headline that a third of all stories have makes as many links as stories."""
    star = facts.where("story_id <> rep").select(F.col("rep").alias("x"), F.col("story_id").alias("y"))
    ends = facts.groupBy("class", "span").agg(F.first("first").alias("first"), F.first("last").alias("last"))
    after = ends.select("class", (F.col("span") - 1).alias("span"), F.col("first").alias("then"))
    chain = ends.join(after, ["class", "span"]).where(F.col("then.t") - F.col("last.t") <= days * DAY).select(F.col("last.story_id").alias("x"), F.col("then.story_id").alias("y"))
    return star.union(chain).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _meet(keyed: DataFrame) -> DataFrame:
    """(a, b): stories without a cosine that share a key in one stretch or in neighbouring ones, and of whose words, by their numbers n and sketches, 0.6 may be
    shared: as 64-bit sketches hold each word's bit by parity, no more bits differ than words do, and at most a quarter of both numbers may."""
    sides = ["n", "long", *[f"s{i}" for i in range(SKETCH)]]
    x = keyed.select("key", *[F.col(k).alias(f"{k}_x") for k in sides], F.col("story_id").alias("x"), F.explode(F.array("span", F.col("span") + 1)).alias("span"), F.col("span").alias("own"))
    y = keyed.select("key", *[F.col(k).alias(f"{k}_y") for k in sides], F.col("story_id").alias("y"), "span")
    fits = 10 * F.least("n_x", "n_y") >= 6 * F.greatest("n_x", "n_y")
    apart = sum((F.bit_count(F.col(f"s{i}_x").bitwiseXOR(F.col(f"s{i}_y"))) for i in range(1, SKETCH)), F.bit_count(F.col("s0_x").bitwiseXOR(F.col("s0_y"))))
    blind = F.coalesce(F.col("long_x") != F.col("long_y"), F.lit(True))
    met = x.join(y, ["key", "span"]).where(fits & blind & (4 * apart <= F.col("n_x") + F.col("n_y")) & ((F.col("x") < F.col("y")) | (F.col("own") < F.col("span")) & (F.col("x") != F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sketch(words: Column) -> list[Column]:
    """Longs s0, s1, ...: a word turns one of their bits, which its hash names."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    bits = lambda i: lambda s, h: F.when(F.pmod(F.shiftright(h, 6), F.lit(SKETCH)) == i, s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int")))).otherwise(s)
    return [F.aggregate(hashes, F.lit(0).cast("long"), bits(i)).alias(f"s{i}") for i in range(SKETCH)]


def _rare_first(rows: DataFrame, items: str, taken: Column, label: str) -> DataFrame:
    """(story_id, span, n, key, long, s0, ...): the rarest of each story's items, as many as taken says of their number n. Items are ordered by how many stories
    have them, then by themselves: one order for all, so that sets that share enough share a key."""
    each = rows.select("story_id", F.explode(items).alias("key"))
    held = settle(each.groupBy("key").agg(F.count("*").alias("held")), f"{label}-held")
    ranked = each.join(held, "key").groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("held", "key"))).alias("order")).withColumn("n", F.size("order"))
    keys = ranked.select("story_id", "n", F.explode(F.slice("order", F.lit(1), taken)).alias("k")).select("story_id", "n", F.col("k.key").alias("key"))
    return keys.join(rows.select("story_id", "span", "long", *_sketch(F.col(items))), "story_id")


def _by_words(one: DataFrame, days: int, label: str) -> DataFrame:
    """TOLD of stories without a cosine, of whose words 0.6 may be shared. Only stories with names can be told to
    be one event without a cosine."""
    named = one.where("size(words) > 0 AND size(names) > 0")
    keyed = settle(_rare_first(named, "words", F.col("n") - F.ceil(F.round(F.col("n") * 0.6, 6)).cast("int") + 1, f"{label}-words"), f"{label}-keys")
    met = settle(_meet(keyed), f"{label}-near")

    def side(n: str) -> DataFrame:
        return one.select(F.col("story_id").alias(n), *[F.col(k).alias(f"{k}_{n}") for k in ("t", "words", "names", "topic", "class")])

    both = met.join(side("a"), "a").join(side("b"), "b").where((F.abs(F.col("t_a") - F.col("t_b")) <= days * DAY) & (F.col("class_a") != F.col("class_b")))
    both = both.withColumn("shared", F.array_sort(F.array_intersect("names_a", "names_b")))
    return both.select("a", "b", F.lit(None).cast("double").alias("sim"), F.size("shared").alias("n"), F.get("shared", F.lit(0)).alias("first"), F.get("shared", F.lit(1)).alias("second"),
                       T.jaccard(F.col("words_a"), F.col("words_b")).alias("alike"), F.coalesce(F.col("topic_a") == F.col("topic_b"), F.lit(False)).alias("one_topic"))


class _Sets:
    """Sets of each row of a list column, as codes in the order of the values."""

    def __init__(self, lists: pa.ChunkedArray) -> None:
        lists = lists.combine_chunks()
        flat = lists.flatten().dictionary_encode()
        order = np.argsort(np.array(flat.dictionary.to_pylist(), object)) if len(flat.dictionary) else np.empty(0, np.int64)
        codes = np.empty(len(order), np.int64)
        codes[order] = np.arange(len(order))
        self.values = flat.dictionary.take(pa.array(order))
        self.size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        self.k = max(1, len(order))
        rows = np.repeat(np.arange(len(self.size)), self.size)
        self.keys = np.sort(rows * self.k + codes[np.asarray(flat.indices, np.int64)])  # each row's codes are one after the other
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.marks = np.zeros(len(self.size), np.uint64)
        np.bitwise_or.at(self.marks, self.keys // self.k, np.uint64(1) << (self.keys % self.k % 64).astype(np.uint64))

    def shared(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values the rows p and q share, each pair, and the codes of the first two or -1."""
        n, first = np.zeros(len(p), np.int64), np.full((len(p), 2), -1)
        maybe = np.flatnonzero(self.marks[p] & self.marks[q])
        ends = np.cumsum(self.size[p[maybe]])
        low = 0
        while low < len(maybe):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS)))
            at = maybe[low:high]
            long = self.size[p[at]]
            whose = np.repeat(np.arange(len(at)), long)
            place = np.arange(len(whose)) - np.repeat(np.cumsum(long) - long, long)
            code = self.keys[self.start[p[at]][whose] + place] % self.k
            look = q[at][whose] * self.k + code
            here = self.keys[np.minimum(np.searchsorted(self.keys, look), len(self.keys) - 1)] == look
            whose, code = whose[here], code[here]
            found = np.bincount(whose, minlength=len(at))
            nth = np.arange(len(whose)) - np.repeat(np.cumsum(found) - found, found)
            n[at] = found
            for i in range(2):
                first[at[whose[nth == i]], i] = code[nth == i]
            low = high
        return n, first


def _by_vectors(one: DataFrame, least: float, bar: float, days: int, strong: float, words: float) -> DataFrame:
    """TOLD of stories within `days` days whose vectors' product is at `bar`, or is no number, and of which by topic, names and words something can be said. Every stretch is dealt to blocks; a task multiplies two blocks of a stretch or of neighbouring ones, looks at what the pairs
    over the bar share and gives only those that count. The products are as many as pairs; what is shuffled is a story for each block that its own meets."""
    whole = one.where("long IS NOT NULL").select("story_id", "t", "span", "long", "v", "names", "words", "topic", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, t, long = table["story_id"].to_numpy(), table["t"].to_numpy(), table["long"][0].as_py()
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), long)
        kinds = table["class"].combine_chunks().dictionary_encode().indices.to_numpy()
        topics = table["topic"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        names, said = _Sets(table["names"]), _Sets(table["words"])
        x, y = (np.flatnonzero(table[side].to_numpy(zero_copy_only=False)) for side in ("left", "right"))
        norm = float(np.sqrt(np.max(np.einsum("ij,ij->i", v, v), initial=0.0)))
        w = v.astype(np.float32) if norm < 1e15 else v
        slack = 1e-6 + 2e-7 * (long + 8) * norm * norm  # what rounding, here and of the cosine, can change
        across, columns = np.ascontiguousarray(w[y].T), np.ascontiguousarray(v.T)
        inside = table["apart"][0].as_py() == 0 and table["p"][0].as_py() == table["q"][0].as_py()
        step = max(1, PAIRS // max(1, len(y)))
        for i in range(0, len(x), step):
            near = w[x[i : i + step]] @ across
            p, q = np.nonzero(~(near < bar - slack))
            about = near[p, q]
            p, q = x[i + p], y[q]
            fits = (np.abs(t[p] - t[q]) <= days * DAY) & (kinds[p] != kinds[q])
            if inside:
                fits &= ids[p] < ids[q]
            one_topic = (topics[p] == topics[q]) & (topics[p] >= 0)
            alone = one_topic & ~(about < least + strong - slack)
            fits &= alone | (names.marks[p] & names.marks[q] > 0)
            p, q, about, one_topic, alone = (z[fits] for z in (p, q, about, one_topic, alone))
            n, first = names.shared(p, q)
            over = ~(about < least - slack)
            less, more = np.minimum(said.size[p], said.size[q]), np.maximum(said.size[p], said.size[q])
            by_words = (n == 1) & over & ~one_topic & (less >= words * more - 1e-6)
            fits = alone | (n >= 1) & one_topic | (n >= 2) & over | by_words
            p, q, one_topic, n, first = (z[fits] for z in (p, q, one_topic, n, first))
            both = np.zeros(len(p), np.int64)
            asked = np.flatnonzero((n == 1))
            both[asked] = said.shared(p[asked], q[asked])[0]
            union = said.size[p] + said.size[q] - both
            alike = np.where(n == 1, both / np.maximum(union, 1), 0.0)
            fits = one_topic | (n >= 2) | (alike >= words)
            p, q, one_topic, n, first, alike = (z[fits] for z in (p, q, one_topic, n, first, alike))
            sim = np.zeros(len(p))
            for c in columns:  # in order, as one after the other adds them up
                sim += c[p] * c[q]
            told = [names.values.take(pa.array(first[:, k], mask=first[:, k] < 0)) for k in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[p], ids[q])), pa.array(np.maximum(ids[p], ids[q])), pa.array(sim), pa.array(n.astype(np.int32)), *[z.cast(pa.string()) for z in told],
                                              pa.array(alike), pa.array(one_topic)], ["a", "b", "sim", "n", "first", "second", "alike", "one_topic"])

    rows = block_pairs(whole, "story_id", ["long"], BLOCK)
    return rows.groupBy("span", "p", "apart", "q", "long").applyInArrow(run, TOLD)


def same_event(stories: DataFrame, least: float, label: str = "events", days: int = 7, strong: float = 0.05, words: float = 0.4, below: float = 0.06, bar: float | None = None) -> DataFrame:
    """(a, b, sim, reason, merge): pairs of stories that are one event (merge), and of one topic that are just under the bar (not merge).

    Within `days` days two stories are one event with the same headline; with vectors at `least` and two names in common, or one name and
    `words` of their words; or with vectors at least + strong and one topic. A pair of one topic with a name in common and vectors at
    least - below is listed. sim is the cosine, null where a vector is missing: then a shared name and 0.6 of the words make one event.

    With a bar that is higher than least - below only pairs with a cosine from there on, and those without one, are given.

    Candidates: vectors whose product is at the bar meet by blocks of time, and are judged where they meet; a pair without a cosine and with 0.6 of
    its words shares one of the rarest n - ceil(0.6 n) + 1 of either's n words, so common words are no keys. Stories with one
    headline in a stretch are linked to the first of them, which stands for them in all other pairs."""
    return told_events(story_facts(stories, days, label), least, label, days, strong, words, below, bar)


def told_events(facts: DataFrame, least: float, label: str = "events", days: int = 7, strong: float = 0.05, words: float = 0.4, below: float = 0.06, bar: float | None = None, blind: DataFrame | None = None) -> DataFrame:
    """same_event's rows from story_facts' rows, which several bars can share; blind: blind_pairs' rows, which are the same for every bar."""
    bar = least - below if bar is None else max(bar, least - below)
    one = facts.where("story_id = rep")
    blind = blind_pairs(facts, days, label) if blind is None else blind
    met = settle(_by_vectors(one, least, bar, days, strong, words).unionByName(blind), f"{label}-met")
    alike, n, sim = F.coalesce("alike", F.lit(0.0)), F.col("n"), F.round("sim", 6)
    # a half goes to where the double lies, as in C's printf; format_string rounds the digits it would print
    said, first = F.concat(F.replace(F.format_number(sim, 2), F.lit(","), F.lit("")), F.lit(" alike")), F.initcap("first")
    reason = F.when((sim >= least) & (n >= 2), F.concat(said, F.lit(", both about "), first, F.lit(" and "), F.initcap("second")))
    reason = reason.when((sim >= least) & (n == 1) & (alike >= words), F.concat(said, F.lit(", both about "), first))
    reason = reason.when((sim >= least + strong) & F.col("one_topic"), said)
    reason = reason.when(sim.isNull() & (n >= 1) & (alike >= 0.6), F.concat(F.lit("nearly the same headline, both about "), first))
    near = F.when((sim >= least - below) & F.col("one_topic") & (n >= 1), F.concat(said, F.lit(", both about "), first))
    judged = met.select("a", "b", sim.alias("sim"), reason.alias("sure"), near.alias("maybe"))
    judged = judged.where("sure IS NOT NULL OR maybe IS NOT NULL").select("a", "b", "sim", F.coalesce("sure", "maybe").alias("reason"), F.col("sure").isNotNull().alias("merge"))
    vector = facts.select("story_id", "v")
    same = headline_links(facts, days).join(vector.select(F.col("story_id").alias("a"), F.col("v").alias("p")), "a").join(vector.select(F.col("story_id").alias("b"), F.col("v").alias("q")), "b")
    same = same.select("a", "b", F.round(T.dot(F.col("p"), F.col("q")), 6).alias("sim"), F.lit("the same headline").alias("reason"), F.lit(True).alias("merge"))
    both = same.unionByName(judged)
    return both.where(F.col("sim").isNull() | (F.col("sim") >= bar)) if bar > least - below else both


def blind_pairs(facts: DataFrame, days: int, label: str) -> DataFrame:
    """What _by_words tells of the stories; nothing where all have vectors of one length, so that each pair has a cosine."""
    one = facts.where("story_id = rep")
    kinds = one.agg(F.min("long").alias("low"), F.max("long").alias("high"), F.count_if(F.col("long").isNull()).alias("none")).first()
    if not kinds.none and kinds.low == kinds.high:
        return facts.sparkSession.createDataFrame([], TOLD)
    work = scratch(f"{label}-work")
    told = settle(_by_words(one, days, f"{work}/words").where("n >= 1 AND alike >= 0.6"), f"{label}-blind")
    discard(facts.sparkSession, work)
    return told


def merges(pairs: DataFrame, stories: DataFrame, label: str = "merges", most: int = 10, total: int = 80) -> DataFrame:
    """(step, a, b, kept, gone, sim, reason): the first `most` merges among pairs (a, b, sim, reason), most alike first, a pair without a cosine as 1. The older
    story of the two is kept; a pair whose stories are one already, or would have more than `total` members, is passed over.
    stories: (story_id, at, n). Each step takes the best pair that is left: its state is as many rows as there were merges, and no pair leaves the tasks."""
    spark = pairs.sparkSession
    sizes = stories.select("story_id", "at", F.col("n").alias("members"))
    x, y = (sizes.withColumnsRenamed({"story_id": k, "at": f"at_{k}", "members": f"n_{k}"}) for k in ("a", "b"))
    left = settle(pairs.select("a", "b", F.coalesce("sim", F.lit(1.0)).alias("sim"), "reason").join(x, "a").join(y, "b"), f"{label}-pairs")
    root: dict[int, int] = {}
    size: dict[int, int] = {}
    since: dict[int, tuple] = {}
    done = []

    def found(i: int) -> int:
        while i in root:
            i = root[i]
        return i

    while len(done) < most:
        moved = spark.createDataFrame([(i, found(i), size[found(i)]) for i in {*root, *root.values()}], "id long, root long, total long")
        p, q = (F.broadcast(moved.withColumnsRenamed({"id": k, "root": f"root_{k}", "total": f"total_{k}"})) for k in ("a", "b"))  # a row a merged story
        now = left.join(p, "a", "left").join(q, "b", "left")
        apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
        fits = F.coalesce("total_a", "n_a") + F.coalesce("total_b", "n_b") <= total
        best = now.where(apart & fits).orderBy(F.desc("sim"), "a", "b").limit(1).collect()
        if not best:
            break
        r = best[0]
        for k, at, n in ((r.a, r.at_a, r.n_a), (r.b, r.at_b, r.n_b)):
            since.setdefault(k, (at, k))
            size.setdefault(k, n)
        keep, drop = sorted((found(r.a), found(r.b)), key=lambda k: since[k])
        root[drop] = keep
        size[keep] += size[drop]
        done.append((len(done) + 1, r.a, r.b, keep, drop, r.sim, r.reason))
    return spark.createDataFrame(done, "step int, a long, b long, kept long, gone long, sim double, reason string")


def merged_stories(members: DataFrame, done: DataFrame, label: str = "merged") -> DataFrame:
    """(story_id, redirect_to, lead, n, first_at, importance): each story after the merges. A story that was merged redirects to the one that has its
    members; of the others the lead is chosen anew among shown members: news over commentary, then importance with a point for a primary source and the share
    of members with two words of the headline or more, then the smallest id. members: (id, story_id, headline, kind, importance, primary, shown, at)."""
    hops = done.select("gone", "kept").collect()  # a row a merge, of which there are a stated number
    way = {r.gone: r.kept for r in hops}

    def end(i: int) -> int:
        while i in way:
            i = way[i]
        return i

    ends = F.broadcast(members.sparkSession.createDataFrame([(i, end(i)) for i in way], "story_id long, redirect_to long"))
    now = settle(members.join(ends, "story_id", "left").withColumn("root", F.coalesce("redirect_to", "story_id")), f"{label}-members")
    shown = now.where("shown").select("root", "id", L.news_ok(F.col("headline"), F.col("kind")).alias("news"), "importance", "primary", F.array_distinct(L.headline_words(F.col("headline"))).alias("words"))
    others = shown.select("root", F.col("id").alias("other"), F.col("words").alias("theirs"))
    alike = F.avg(F.when((F.size("words") >= 2) & (F.size(F.array_intersect("words", "theirs")) >= 2), 1.0).otherwise(0.0))
    share = shown.join(others, "root").groupBy("root", "id").agg(alike.alias("share"))  # stories have a bounded number of members
    weight = F.coalesce("importance", F.lit(0)) + F.when(F.col("primary"), 1).otherwise(0) + F.col("share")
    key = F.struct("news", F.round(weight, 9).alias("w"), (-F.col("id")).alias("back"))
    leads = shown.join(share, ["root", "id"]).groupBy("root").agg(F.max_by("id", key).alias("lead"))
    sums = now.groupBy("root").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("importance").alias("importance"))
    live = sums.join(leads, "root", "left").select(F.col("root").alias("story_id"), F.lit(None).cast("long").alias("redirect_to"), "lead", "n", "first_at", "importance")
    gone = ends.select("story_id", "redirect_to", *[F.lit(None).cast(t).alias(k) for k, t in live.dtypes[2:]])
    return live.unionByName(gone)
