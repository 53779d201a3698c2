"""Phrase collocation mining by branch and bound.

Words and word pairs are counted over all texts first. A pair is the prefix of longer phrases, and its counts bound the score of every phrase that
starts with it: cut after the first word, a phrase that occurs a times scores at most 2 a / (f(first word) + a), which grows with a, and a is at most
the pair's count. Pairs are the frontier: those of the highest bounds are grown first, to three and four words, by a pass that counts every phrase
in which such a pair stands first or second; so a phrase that starts with a grown pair and all phrases that are one word longer at either side are
known. A language is settled once so many phrases survive whose score no ungrown pair's bound exceeds; until then the frontier moves down for it.

Counts are of 64-bit hashes of words within a language; a phrase is the row of its words' hashes. Scores are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import chunks, flat, lowered, mix, runs, span_hashes
from skein.shared import settle

#: Words that a task gathers before it counts them; slots of the table that tells frequent words; phrases of a broadcast.
RUN_WORDS, SLOTS, KEYS = 1 << 20, 1 << 22, 1 << 20
#: Pairs that are grown for a language in the first round, in multiples of the phrases asked for, and how this rises by round.
GROW, FASTER = 8, 4

_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK[[0x20, 0x09]] = True
_K = ["k1", "k2", "k3", "k4"]


class Words:
    """A chunk's words in order: hash (never 0) within the language, whether the next word is in the same piece, bytes and place of each."""

    def __init__(self, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = lowered(data)
        self.starts, self.ends, self.rows = runs(~(_BREAK | _BLANK)[data], offsets)
        names, cuts = flat(part.column(part.schema.get_field_index("lang")))
        own = span_hashes(names, cuts[:-1], cuts[1:])
        self.keys = mix(span_hashes(self.data, self.starts, self.ends) ^ mix(own)[self.rows]) | np.uint64(1)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        self.joined = (breaks[self.starts[1:]] == breaks[self.ends[:-1]]) & (self.rows[1:] == self.rows[:-1])

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[at : at + n], self.ends[at : at + n], strict=True)).decode("utf-8", "replace")


def joint(keys: np.ndarray) -> np.ndarray:
    """One hash of each row of words' hashes (0: no word)."""
    out = np.zeros(len(keys), np.uint64)
    with np.errstate(over="ignore"):
        for column in keys.T:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def held(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def phrase_rows(docs: DataFrame, width: int, pick: Callable[[Words], np.ndarray]) -> DataFrame:
    """(k1 .. k<width>, n): counts of the rows of words' hashes that pick takes from a chunk, summed within a run and then over all."""
    names = _K[:width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0

        def counted() -> pa.RecordBatch:
            keys = np.concatenate(found)
            found.clear()
            _, first, n = np.unique(joint(keys), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([*[pa.array(keys[first, i].view(np.int64)) for i in range(width)], pa.array(n)], [*names, "n"])

        for part, data, offsets in chunks(batches, "text"):
            found.append(pick(Words(part, data, offsets)))
            size += len(found[-1])
            if size >= RUN_WORDS:
                yield counted()
                size = 0
        if found:
            yield counted()

    schema = ", ".join(f"{k} long" for k in [*names, "n"])
    return docs.mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(k1, lang, n) of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0

        def counted() -> pa.RecordBatch:
            words, n, langs = zip(*found, strict=True)
            found.clear()
            word, first, at = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
            total = np.bincount(at, np.concatenate(n)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.concat_arrays(langs).take(pa.array(first)), pa.array(total)], ["k1", "lang", "n"])

        for part, data, offsets in chunks(batches, "text"):
            words = Words(part, data, offsets)
            word, first, n = np.unique(words.keys, return_index=True, return_counts=True)
            found.append((word, n, part.column(part.schema.get_field_index("lang")).take(pa.array(words.rows[first]))))
            size += len(word)
            if size >= RUN_WORDS:
                yield counted()
                size = 0
        if found:
            yield counted()

    return docs.mapInArrow(run, "k1 long, lang string, n long").groupBy("k1", "lang").agg(F.sum("n").alias("n"))


def frequent_slots(frequent: DataFrame) -> np.ndarray:
    """SLOTS flags: which slots frequent words have. Bits above the lowest, which is always set, name a slot."""
    slot = F.shiftright("k1", 1).bitwiseAND(F.lit(SLOTS - 1))
    bits = frequent.select(F.shiftright(slot, 6).alias("at"), slot.alias("slot")).selectExpr("at", "shiftleft(1L, cast(slot % 64 as int)) AS bit")
    flags = np.zeros(SLOTS // 64, np.int64)
    for r in bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():  # SLOTS / 64 rows at most
        flags[r.at] = r.bits
    return np.unpackbits(flags.view(np.uint8), bitorder="little").astype(bool)


def key_blocks(keys: DataFrame) -> Iterator[np.ndarray]:
    """Sorted joint hashes of the phrases in keys, by blocks of about KEYS."""
    names = [k for k in _K if k in keys.columns]
    blocks = max(1, math.ceil(keys.count() / KEYS))
    for block in range(blocks):
        mine = keys.where(F.pmod(F.xxhash64(*names), F.lit(blocks)) == block).select(*names).toPandas()
        if len(mine):
            yield np.sort(joint(np.ascontiguousarray(mine.to_numpy(np.int64)).view(np.uint64)))


def grown(docs: DataFrame, prefixes: DataFrame) -> DataFrame | None:
    """(k1 .. k4, n): phrases of three (k4 is 0) and four words whose first or second pair is one of prefixes (k1, k2)."""
    out = None
    for keys in key_blocks(prefixes):
        shared = docs.sparkSession.sparkContext.broadcast(keys)

        def pick(words: Words, shared=shared) -> np.ndarray:
            k, joined = words.keys, words.joined
            if len(k) < 3:
                return np.zeros((0, 4), np.uint64)
            hit = joined & held(shared.value, joint(np.stack([k[:-1], k[1:]], axis=1)))
            hit = hit[:-1] | hit[1:]
            three = np.flatnonzero(hit & joined[:-1] & joined[1:])
            four = three[three + 3 < len(k)]
            four = four[joined[four + 2]]
            none = np.zeros(len(three), np.uint64)
            return np.concatenate([np.stack([k[three], k[three + 1], k[three + 2], none], axis=1), np.stack([k[four + i] for i in range(4)], axis=1)])

        more = phrase_rows(docs, 4, pick)
        out = more if out is None else out.union(more)
    return out


def triples(docs: DataFrame, wanted: DataFrame) -> DataFrame | None:
    """(k1 .. k4, n) of the three-word phrases in wanted (k1, k2, k3)."""
    out = None
    for keys in key_blocks(wanted):
        shared = docs.sparkSession.sparkContext.broadcast(keys)

        def pick(words: Words, shared=shared) -> np.ndarray:
            k, joined = words.keys, words.joined
            at = np.flatnonzero(joined[:-1] & joined[1:])
            three = np.stack([k[at], k[at + 1], k[at + 2]], axis=1)
            three = three[held(shared.value, joint(three))]
            return np.concatenate([three, np.zeros((len(three), 1), np.uint64)], axis=1)

        more = phrase_rows(docs, 4, pick)
        out = more if out is None else out.union(more)
    return out


def spelled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1 .. k4, phrase) of the phrases in wanted (k1 .. k4; 0: no word)."""
    out = docs.sparkSession.createDataFrame([], "k1 long, k2 long, k3 long, k4 long, phrase string")
    for keys in key_blocks(wanted):
        shared = docs.sparkSession.sparkContext.broadcast(keys)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(0, np.uint64)
            for part, data, offsets in chunks(batches, "text"):
                words = Words(part, data, offsets)
                fits, rows = np.ones(len(words.keys), bool), []
                for n in (2, 3, 4):
                    fits = fits[:-1] & words.joined[n - 2 :] if len(fits) else fits
                    at = np.flatnonzero(fits)
                    k = np.stack([words.keys[at + i] if i < n else np.zeros(len(at), np.uint64) for i in range(4)], axis=1)
                    whole, first = np.unique(joint(k), return_index=True)
                    new = held(shared.value, whole) & ~held(seen, whole)
                    seen = np.union1d(seen, whole[new])
                    rows += [(*k[i].view(np.int64).tolist(), words.phrase(int(at[i]), n)) for i in first[new]]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], [*_K, "phrase"])

        out = out.union(docs.mapInArrow(run, "k1 long, k2 long, k3 long, k4 long, phrase string"))
    return out.groupBy(*_K).agg(F.min("phrase").alias("phrase"))


def score(a: str, total: Column) -> Column:
    """floor(2000000 * a / total), exact beyond 64 bits."""
    return F.call_function("div", F.col(a).cast("decimal(20,0)") * F.lit(2_000_000), total.cast("decimal(20,0)"))


def lowest(a: str, cuts: list[tuple[Column, Column]]) -> Column:
    """struct(score, l, r) of the lowest-scoring cut, the first of equal ones."""
    return F.array_min(F.array(*[F.struct(score(a, l + r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")) for k, (l, r) in enumerate(cuts)]))


def collocations(docs: DataFrame, least: int = 30, first: int = 2000, cover: tuple[int, int] = (80, 100), label: str = "phrases") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two to four words by score, count and text, of those that occur least
    times and don't stand inside a longer such phrase with cover of their occurrences.

    Words are lower-cased (A-Z) runs without space and tab within pieces between `.,;:!?` and line ends. A null lang is `und`, a null text is empty.
    Rows that repeat count as often as they stand; columns other than lang and text are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = settle(word_counts(docs), f"{label}-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    slots = docs.sparkSession.sparkContext.broadcast(frequent_slots(frequent))

    def two(words: Words) -> np.ndarray:
        """Pairs of words that may both be frequent."""
        often = slots.value[((words.keys >> np.uint64(1)) & np.uint64(SLOTS - 1)).astype(np.int64)]
        at = np.flatnonzero(words.joined & often[:-1] & often[1:])
        return np.stack([words.keys[at], words.keys[at + 1]], axis=1)

    pairs = settle(phrase_rows(docs, 2, two).where(F.col("n") >= least).withColumnRenamed("n", "a"), f"{label}-counts")
    pairs = pairs.join(frequent.select("k1", "lang", F.col("n").alias("f1")), "k1").join(frequent.select(F.col("k1").alias("k2"), F.col("n").alias("f2")), "k2")
    pairs = settle(pairs.withColumn("bound", score("a", F.col("f1") + F.col("a"))), f"{label}-pairs")
    bins = pairs.groupBy("lang", F.expr("bound div 1000").alias("bin")).agg(F.count("*").alias("m"))
    bins = settle(bins.withColumn("above", F.sum("m").over(Window.partitionBy("lang").orderBy(F.desc("bin")))), f"{label}-bins")  # 1,001 rows a language

    langs = bins.select("lang").distinct()
    edges = settle(langs.select("lang", F.lit(1_000_001).cast("long").alias("edge"), F.lit(False).alias("done")), f"{label}-edges")
    known, want = None, GROW * first
    while True:
        down = bins.where(F.col("above") >= want).groupBy("lang").agg((F.max("bin") * 1000).alias("to"))
        next_edge = F.when(F.col("done"), F.col("edge")).otherwise(F.coalesce("to", F.lit(0)))
        moved = settle(edges.join(down, "lang", "left").select("lang", next_edge.alias("edge"), F.col("edge").alias("before")), f"{label}-moved")
        fresh = pairs.join(moved, "lang").where("bound >= edge and bound < before").select("k1", "k2")
        more = grown(docs, settle(fresh, f"{label}-fresh"))
        if more is not None:
            more = settle(more.where(F.col("n") >= least), f"{label}-grown")
            known = more if known is None else known.union(more)
        found, known = judged(docs, pairs, known, moved, cover, label)
        enough = found.groupBy("lang").agg(F.count("*").alias("m"))
        done = (F.col("edge") == 0) | (F.coalesce("m", F.lit(0)) >= first)
        edges = settle(moved.join(enough, "lang", "left").select("lang", "edge", done.alias("done")), f"{label}-edges")
        if edges.where("not done").isEmpty():
            break
        want *= FASTER
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    tops = settle(found.withColumn("place", F.rank().over(order)).where(F.col("place") <= first).drop("place"), f"{label}-tops")
    named = tops.join(spelled(docs, tops.select(*_K)), _K).join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def judged(docs: DataFrame, pairs: DataFrame, known: DataFrame | None, edges: DataFrame, cover: tuple[int, int], label: str) -> tuple[DataFrame, DataFrame | None]:
    """(lang, k1 .. k4, a, score, l, r): the phrases whose score reaches their language's edge and that survive, and known with what had to be counted for
    that. known: (k1 .. k4, n) of all phrases in which a pair with a bound at the edge or over stands first or second."""
    zero = F.lit(0).cast("long")
    reached = pairs.join(edges.select("lang", "edge"), "lang").where("bound >= edge")
    twos = reached.select("lang", "edge", "k1", "k2", zero.alias("k3"), zero.alias("k4"), "a", lowest("a", [(F.col("f1"), F.col("f2"))]).alias("cut"))
    if known is None:
        return settle(twos.where("cut.score >= edge").select("lang", *_K, "a", "cut.score", "cut.l", "cut.r"), f"{label}-found"), None
    known = settle(known.dropDuplicates(_K), f"{label}-known")
    heads = reached.select("lang", "edge", "k1", "k2", "f1", F.col("a").alias("a12"))
    threes = known.where("k4 = 0").select("k1", "k2", "k3", F.col("n").alias("a"))
    fours = known.where("k4 <> 0").withColumnRenamed("n", "a")
    ends = pairs.select(F.col("k1").alias("x"), F.col("k2").alias("y"), F.col("a").alias("tail"), F.col("f2").alias("last"))

    def cut_threes(threes: DataFrame) -> DataFrame:
        full = threes.join(heads, ["k1", "k2"]).join(ends.withColumnsRenamed({"x": "k2", "y": "k3"}), ["k2", "k3"])
        cuts = lowest("a", [(F.col("f1"), F.col("tail")), (F.col("a12"), F.col("last"))])
        return full.select("lang", "edge", "k1", "k2", "k3", zero.alias("k4"), "a", cuts.alias("cut"))

    # the count of a phrase's last three words isn't known where no grown pair is in them; until then its own count bounds it from below
    start = threes.withColumnRenamed("a", "a123")
    full = fours.join(heads, ["k1", "k2"]).join(start, ["k1", "k2", "k3"]).join(ends.withColumnsRenamed({"x": "k3", "y": "k4"}), ["k3", "k4"])

    def cut_fours(threes: DataFrame) -> DataFrame:
        after = threes.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("k3").alias("k4"), F.col("a").alias("a234"))
        cuts = [(F.col("f1"), F.coalesce("a234", "a")), (F.col("a12"), F.col("tail")), (F.col("a123"), F.col("last"))]
        return full.join(after, ["k2", "k3", "k4"], "left").select("lang", "edge", *_K, "a", lowest("a", cuts).alias("cut"), F.col("a234").isNull().alias("open"))

    high = settle(cut_fours(threes).where("cut.score >= edge"), f"{label}-fours")
    asked = settle(high.where("open").select(F.col("k2").alias("k1"), F.col("k3").alias("k2"), F.col("k4").alias("k3")).distinct(), f"{label}-asked")
    counted = triples(docs, asked)
    if counted is not None:
        known = settle(known.union(counted), f"{label}-known")
        threes = known.where("k4 = 0").select("k1", "k2", "k3", F.col("n").alias("a"))
        high = settle(cut_fours(threes).where("cut.score >= edge"), f"{label}-fours")
    longer = known.select(*_K, "n")
    around = longer.where("k4 = 0").select("k1", "k2", zero.alias("k3"), "k4", "n").union(longer.where("k4 = 0").select("k2", "k3", zero, "k4", "n"))
    around = around.union(longer.where("k4 <> 0").select("k1", "k2", "k3", zero, "n")).union(longer.where("k4 <> 0").select("k2", "k3", "k4", zero, "n"))
    around = around.groupBy(*_K).agg(F.max("n").alias("longest"))
    found = twos.union(cut_threes(threes)).where("cut.score >= edge").union(high.drop("open"))
    kept = found.join(around, _K, "left").where(F.col("longest").isNull() | (F.col("longest") * cover[1] < F.col("a") * cover[0]))
    return settle(kept.select("lang", *_K, "a", "cut.score", "cut.l", "cut.r"), f"{label}-found"), known
