"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature is a Bloom filter of its terms, each entered once for every frequency step it reaches, so that a signature bounds a term's
frequency from above and never from below. Signatures of equal width stand side by side in blocks, bit by bit: a slice has one bit of all documents of
a block. For a query the slices of each term are intersected and summed with the term's weight, which bounds every document's score from above. The
documents of the highest bounds are scored exactly; their 50th score is a floor, and every document whose bound reaches it is scored exactly. No
document that could be in the answer is left out: a Bloom filter's errors only raise bounds.

Queries are handled in blocks of about QUERY_TERMS terms: a block's terms and weights are broadcast, and each block reads the signatures twice and the
texts of those documents only that it can't exclude. 64-bit hashes of terms stand for the terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import chunks, lowered, mix, runs, span_hashes
from skein.shared import settle

#: Bits of a signature an entry, bits an entry sets, bits and documents of a block of signatures.
BITS_EACH, PROBES, BLOCK_BITS, BLOCK_DOCS = 22, 11, 1 << 23, 2048
#: Frequencies at which a term is entered once more.
STEPS = [*range(1, 17), 18, 20, 22, 25, 28, 32, 36, 40, 45, 50, 56, 64, 72, 80, 90, 100, 112, 128, 160, 200, 256, 512, 1024, 4096, 16384, 1 << 62]
#: Terms of a block of queries; slots of the tables that tell tasks which terms queries have, and which documents are asked for.
QUERY_TERMS, SLOTS = 1 << 16, 1 << 22
#: Widths of signatures: of neighbouring ones the larger is WIDER times the smaller.
WIDER = 1.2

_TERM = np.ones(256, bool)
_TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each term: runs of ASCII letters and digits and of all that is not ASCII, A-Z lower-cased."""
    starts, ends, rows = runs(_TERM[data], offsets)
    return span_hashes(lowered(data), starts, ends), rows


def counted(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's distinct terms and their frequencies."""
    hashes, rows = terms(data, offsets)
    cuts = np.searchsorted(rows, np.arange(len(offsets)))
    return [np.unique(hashes[a:b], return_counts=True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def width_for(entries: int) -> int:
    """The least signature width with BITS_EACH bits an entry."""
    return int(256 * WIDER ** max(0, math.ceil(math.log(max(1, BITS_EACH * entries / 256), WIDER)))) + 1


def places(hashes: np.ndarray, step: int, width: int) -> np.ndarray:
    """The bits that each term sets at a frequency step, in signatures of width bits."""
    with np.errstate(over="ignore"):
        h = mix(hashes + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
        jump = (h >> np.uint64(32)) | np.uint64(1)
        return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * jump[:, None]) % np.uint64(width)).astype(np.int64)


def sliced(documents: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Signatures of documents as slices: one row of bits for each place, one bit a document."""
    bits = np.zeros((width, -(-len(documents) // 8) * 8), bool)
    for i, (hashes, tf) in enumerate(documents):
        for step, least in enumerate(STEPS):
            held = hashes[tf >= least]
            if not len(held):
                break
            bits[places(held, step, width).ravel(), i] = True
    return np.packbits(bits, axis=1)


_SCHEMA = "kind int, term long, n long, width int, ids binary, lengths binary, slices binary"


def index(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """Rows of kind 0: a block of signatures with its documents' ids and lengths; kind 1: a task's documents n with a term whose slot is set; kind 2:
    its documents with terms (term 0) and all their terms (term 1)."""
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, waiting, found, total = shared.value, {}, [], [0, 0]

        def block(width: int) -> pa.RecordBatch:
            ids, held = zip(*waiting.pop(width), strict=True)
            lengths = np.array([int(tf.sum()) for _, tf in held], np.int64)
            row = [0, None, None, width, np.array(ids, np.int64).tobytes(), lengths.tobytes(), sliced(list(held), width).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

        def tally() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            found.clear()
            kind = np.concatenate([np.full(len(term), 1), [2, 2]])
            columns = [kind, np.concatenate([term.view(np.int64), [0, 1]]), np.concatenate([n, total])]
            total[:] = [0, 0]
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], *[pa.nulls(len(kind), t) for t in kinds[3:]]], names)

        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for part, data, offsets in chunks(batches, "text"):
            for doc_id, (hashes, tf) in zip(part.column(0).to_pylist(), counted(data, offsets), strict=True):
                if not len(hashes):
                    continue
                total[0] += 1
                total[1] += int(tf.sum())
                found.append(hashes[asked[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]])
                if doc_id is None:
                    continue
                entries = int(np.searchsorted(STEPS, tf, "right").sum())
                width = width_for(entries)
                kept = waiting.setdefault(width, [])
                kept.append((doc_id, (hashes, tf)))
                if len(kept) * width >= BLOCK_BITS or len(kept) >= BLOCK_DOCS:
                    yield block(width)
            if sum(map(len, found)) > 1 << 18:
                yield tally()
        for width in list(waiting):
            yield block(width)
        yield tally()

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def measure(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 50 + (50 * lengths * n_docs) // n_terms


def factor(tf: int | np.ndarray, m: int | np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Queries:
    """A block of queries: ids, the distinct terms of all, and each one's places among them with weights."""

    def __init__(self, rows: list[tuple[int, int, int]], n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.ids = sorted({r[0] for r in rows})
        self.terms = np.unique(np.array([r[1] for r in rows], np.int64).view(np.uint64))
        at = {x: i for i, x in enumerate(self.ids)}
        mine: list[list[tuple[int, int]]] = [[] for _ in self.ids]
        for item, term, w in rows:
            mine[at[item]].append((int(np.searchsorted(self.terms, np.uint64(term & (2**64 - 1)))), w))
        self.places = [np.array([x for x, _ in q], np.int64) for q in mine]
        self.weights = [np.array([w for _, w in q], np.int64) for q in mine]

    def bounds(self, width: int, lengths: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """The highest score that each document of a block can have for each query."""
        out = np.zeros((len(self.ids), len(lengths)), np.int64)
        m, alive, held, below = measure(lengths, self.n_docs, self.n_terms), np.arange(len(self.terms)), None, 0
        for step in range(len(STEPS) - 1):
            at = places(self.terms[alive], step, width)
            now = slices[at[:, 0]]
            for probe in range(1, PROBES):
                now &= slices[at[:, probe]]
            if held is not None:
                now &= held
            some = now.any(axis=1)
            alive, held = alive[some], now[some]
            if not len(alive):
                break
            # a frequency of STEPS[step] at least is below STEPS[step + 1] unless the next step is set as well
            most = factor(min(STEPS[step + 1] - 1, 1 << 32), m)
            row_of = np.full(len(self.terms), -1)
            row_of[alive] = np.arange(len(alive))
            bits = np.unpackbits(held, axis=1, count=len(lengths))
            for i, (mine, w) in enumerate(zip(self.places, self.weights, strict=True)):
                rows = row_of[mine]
                there = rows >= 0
                if there.any():
                    out[i] += (w[there].astype(np.float64) @ bits[rows[there]]).astype(np.int64) * (most - below)
            below = most
        return out

    def score(self, query: int, hashes: np.ndarray, tf: np.ndarray) -> int:
        """A document's score, from its distinct terms and their frequencies."""
        mine = self.terms[self.places[query]]
        at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
        there = hashes[at] == mine
        m = measure(tf.sum(), self.n_docs, self.n_terms)
        return int((self.weights[query][there] * factor(tf[at[there]], m)).sum())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            width = batch.column(0)[i].as_py()
            ids, lengths = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (1, 2))
            yield width, ids, lengths, np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8).reshape(width, -1)


def _pairs(items: np.ndarray, docs: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(items), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000], pa.int64()) for x in (items, docs, bounds)], ["item_id", "doc_id", "bound"])


def highest_bounds(signatures: DataFrame, queries: Queries, top: int) -> DataFrame:
    """(item_id, doc_id, bound): each task's top documents by bound, of those over 0, for each query."""
    shared = signatures.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best, best_ids = np.zeros((len(q.ids), 0), np.int64), np.zeros((len(q.ids), 0), np.int64)
        for width, ids, lengths, slices in _blocks(batches):
            best = np.concatenate([best, q.bounds(width, lengths, slices)], axis=1)
            best_ids = np.concatenate([best_ids, np.broadcast_to(ids, (len(q.ids), len(ids)))], axis=1)
            if best.shape[1] > top:
                at = np.argpartition(-best, top - 1, axis=1)[:, :top]
                best, best_ids = np.take_along_axis(best, at, axis=1), np.take_along_axis(best_ids, at, axis=1)
        row, column = np.nonzero(best)
        yield from _pairs(np.array(q.ids, np.int64)[row], best_ids[row, column], best[row, column])

    return signatures.mapInArrow(run, "item_id long, doc_id long, bound long")


def reaching(signatures: DataFrame, queries: Queries, floors: np.ndarray) -> DataFrame:
    """(item_id, doc_id, bound): every document that may stand before the query's floor, a score and the doc_id that has it, or is it."""
    shared = signatures.sparkSession.sparkContext.broadcast((queries, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floor = shared.value
        for width, ids, lengths, slices in _blocks(batches):
            bounds = q.bounds(width, lengths, slices)
            row, column = np.nonzero((bounds > floor[:, :1]) | (bounds == floor[:, :1]) & (ids <= floor[:, 1:]))
            yield from _pairs(np.array(q.ids, np.int64)[row], ids[column], bounds[row, column])

    return signatures.mapInArrow(run, "item_id long, doc_id long, bound long")


def scored(docs: DataFrame, pairs: DataFrame, queries: Queries) -> DataFrame:
    """(item_id, doc_id, score) of pairs, from whole texts. A table of slots of the documents that are asked for, of one size whatever their number, keeps
    most other texts from being shuffled; the join decides."""
    asked = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    wanted = docs.sparkSession.sparkContext.broadcast(slot_table(pairs.select(F.xxhash64("doc_id").alias("term"))))
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.asarray(batch.column(2)) & (SLOTS - 1)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["doc_id", "text"]).filter(pa.array(wanted.value[slot]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        at = {x: i for i, x in enumerate(q.ids)}
        for part, data, offsets in chunks(batches, "text"):
            out = []
            for doc_id, items, (hashes, tf) in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), counted(data, offsets), strict=True):
                if len(hashes):
                    out += [(x, doc_id, q.score(at[x], hashes, tf)) for x in items]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["item_id", "doc_id", "score"])

    some = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(likely, "doc_id long, text string")
    found = some.join(asked.hint("merge"), "doc_id").select("doc_id", "text", "items")  # one plan at every size
    return found.mapInArrow(run, "item_id long, doc_id long, score long").where("score > 0")


def slot_table(terms_of: DataFrame) -> np.ndarray:
    """SLOTS flags: which low bits of hashes occur in the column term."""
    slot = F.col("term").bitwiseAND(F.lit(SLOTS - 1))
    words = terms_of.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast((term & {SLOTS - 1}) % 64 as int))").alias("bit"))
    flags = np.zeros(SLOTS // 64, np.int64)
    for r in words.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():  # SLOTS / 64 rows at most
        flags[r.at] = r.bits
    return np.unpackbits(flags.view(np.uint8), bitorder="little").astype(bool)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, "text"):
            hashes, rows = terms(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(hashes.view(np.int64))], ["item_id", "term"])

    return items.select("item_id", "text").where("item_id is not null").mapInArrow(run, "item_id long, term long").distinct()


def search(docs: DataFrame, items: DataFrame, top: int = 50, label: str = "search") -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of each query by score, equal scores by doc_id; documents that score 0 are none.

    Null texts and texts without terms are no documents and no queries. Rows with a null doc_id count in the statistics but aren't returned; rows that
    repeat a doc_id are documents each. Rows with a null item_id are no queries; rows that repeat an item_id are one query with the terms of all.
    Columns other than doc_id, item_id and text are ignored. Without documents, or without queries, nothing is returned.
    """
    docs, spark = docs.select(F.col("doc_id").cast("long"), "text"), docs.sparkSession
    asked = settle(query_terms(items.select(F.col("item_id").cast("long"), "text")), f"{label}-terms")
    made = settle(index(docs, slot_table(asked)), f"{label}-index")
    totals = {r.term: r.n for r in made.where("kind = 2").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, n_terms = totals.get(0, 0), totals.get(1, 0)
    df = made.where("kind = 1").groupBy("term").agg(F.sum("n").alias("df"))
    weighed = settle(asked.join(df, "term").select("item_id", "term", "df"), f"{label}-weighed")
    signatures = made.where("kind = 0").select("width", "ids", "lengths", "slices")
    blocks = max(1, math.ceil(weighed.count() / QUERY_TERMS))
    order = Window.partitionBy("item_id")
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        mine = weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = [(r.item_id, r.term, weight(n_docs, r.df)) for r in mine.toLocalIterator()]  # QUERY_TERMS rows, or so
        if not rows:
            continue
        queries = Queries(rows, n_docs, n_terms)
        first = highest_bounds(signatures, queries, top)
        first = first.withColumn("place", F.row_number().over(order.orderBy(F.desc("bound"), "doc_id"))).where(F.col("place") <= top).drop("place")
        tried = scored(docs, settle(first, f"{label}-first"), queries)
        tried = tried.withColumn("place", F.row_number().over(order.orderBy(F.desc("score"), "doc_id"))).where(F.col("place") == top)
        floor = {r.item_id: (r.score, r.doc_id) for r in tried.collect()}  # a row a query
        floors = np.array([floor.get(x, (1, (1 << 63) - 1)) for x in queries.ids], np.int64)
        out = out.union(settle(scored(docs, settle(reaching(signatures, queries, floors), f"{label}-open"), queries), f"{label}-scored"))
    ranked = out.withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
