"""Benchmark decontamination by the q-gram lemma.

A benchmark passage of L bytes leaks into a text if some stretch of the text is within e = floor(rate * L) edits of it. Such a stretch shares at
least L - Q + 1 - Q * e of the passage's Q-grams with it, on diagonals that differ by e at most. So shared Q-grams are counted in overlapping
bands of diagonals, bands that reach the bound are kept, and a banded alignment verifies them. Before that, stretches of text that are too thin
in benchmark Q-grams to hold the least number that any passage asks for are left out by a running count.

A long passage leaks in part as well: overlapping windows of its words are passages of their own, by the same bound. Passages below LEAST_BYTES are
found by the hashes of all stretches of text of their lengths that begin and end at token borders; these allow no edits.

Bytes are compared after A-Z are lower-cased and every run of bytes up to 0x20 is one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import chunks, span_hashes, unused
from skein.shared import settle

#: Bytes of a gram (as many as a 64-bit code has); share of a passage's bytes that may be edits; shortest passage, normalised, that may have edits.
Q, RATE, LEAST_BYTES = 8, 0.06, 40
#: Words of a window of a passage: PART of the passage's, PART_WORDS at most; below LEAST_WORDS a part is no evidence. Windows overlap by four fifths.
PART, PART_WORDS, LEAST_WORDS = 0.8, 50, 20
#: Times a passage's bytes that its windows and itself have at most.
GROWTH = 7
#: Bytes of passages that are broadcast and indexed at once; a larger benchmark goes in blocks.
BLOCK_BYTES = 16 << 20
_WINDOW = 64
_FILTER_BITS = 20
_BAND_BITS = 30
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets and each byte's place in data after case and space folding; spaces at a row's start stay one space."""
    if not len(data):
        return data, offsets, np.zeros(0, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), np.where(data <= 32, np.uint8(32), data))
    space = low == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(low)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], at[offsets], np.flatnonzero(keep)


def fold(text: bytes) -> bytes:
    data = np.frombuffer(text, np.uint8)
    return normalised(data, np.array([0, len(data)]))[0].tobytes()


def codes_of(data: np.ndarray) -> np.ndarray:
    """The Q-gram that starts at each byte, as an integer."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - Q + 1,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()


def budget(length: int, rate: float = RATE) -> int:
    """Edits that a passage of so many bytes may have: at most rate of its bytes, and few enough for the lemma to ask for a shared gram."""
    return max(0, min(int(rate * length), (length - Q) // Q))


def align(passage: np.ndarray, text: np.ndarray, edits: int) -> tuple[int, int]:
    """Least edits between passage and a stretch of text, and that stretch's end (the first such), if they are no more than
    edits; else some larger number. The band's diagonals are those that text has room for."""
    k = np.arange(-edits, max(0, len(text) - len(passage)) + edits + 1)  # text place less passage place
    least = np.where((k >= 0) & (k <= len(text)), 0, 1 << 20).astype(np.int64)
    padded = np.concatenate([text, np.zeros(1, np.uint8)])
    for i in range(1, len(passage) + 1):
        j = k + i
        inside = (j >= 1) & (j <= len(text))
        same = padded[np.where(inside, j - 1, 0)] == passage[i - 1]
        step = np.where(inside, least + ~same, 1 << 20)
        step[:-1] = np.minimum(step[:-1], least[1:] + 1)
        step[(j < 0) | (j > len(text))] = 1 << 20
        least = np.minimum.accumulate(step - k) + k
        least[(j < 0) | (j > len(text))] = 1 << 20
    at = int(least.argmin())
    return int(least[at]), int(k[at] + len(passage))


def parts(passage: bytes) -> list[bytes]:
    """The overlapping windows of a passage's words; the last ends with it."""
    said = passage.split(b" ")
    size = min(PART_WORDS, -int(-PART * len(said) // 1))
    if size < LEAST_WORDS or size >= len(said):
        return []
    firsts = sorted({*range(0, len(said) - size, size // 5), len(said) - size})
    return [x for x in (b" ".join(said[i : i + size]) for i in firsts) if len(x) >= LEAST_BYTES]


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a token may begin or end before each byte, and at the end: not within a character, nor between two letters or digits.
    Characters of three bytes or more (CJK) are tokens of their own."""
    inner, two = (data & 0xC0) == 0x80, (data >= 0xC0) & (data < 0xE0)
    letter = (data >= 97) & (data <= 122) | (data >= 48) & (data <= 57) | two
    letter[1:] |= inner[1:] & two[:-1]
    out = np.ones(len(data) + 1, bool)
    out[1:-1] = ~inner[1:] & ~(letter[1:] & letter[:-1])
    out[offsets] = True
    return out


class Exact:
    """Hashes of short passages by length."""

    def __init__(self, passages: list[tuple[int, bytes]]):
        self.owner = np.array([i for i, _ in passages], np.int64)
        size = np.array([len(x) for _, x in passages], np.int64)
        self.sizes = np.unique(size)
        ends = np.cumsum(size)
        self.hashes = span_hashes(np.frombuffer(b"".join(x for _, x in passages), np.uint8), ends - size, ends)
        order = np.argsort(self.hashes)
        self.hashes, self.owner = self.hashes[order], self.owner[order]
        self.text = dict(passages)

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, owner, start, end) of each short passage's first stretch in each row."""
        if not len(self.hashes) or not len(data):
            return
        edge = borders(data, offsets)
        starts = np.flatnonzero(edge[:-1])
        row = np.searchsorted(offsets, starts, "right") - 1
        for size in self.sizes.tolist():
            ends = starts + size
            fits = ends <= offsets[row + 1]
            fits[fits] = edge[ends[fits]]
            first, rows = starts[fits], row[fits]
            found = span_hashes(data, first, first + size)
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == found)
            _, once = np.unique(np.stack([rows[hit], at[hit]], axis=1), axis=0, return_index=True)
            for i in hit[once].tolist():
                owner, start = int(self.owner[at[i]]), int(first[i])
                if data[start : start + size].tobytes() == self.text[owner]:
                    yield int(rows[i]), owner, start, start + size


class Index:
    """Q-grams of a block of passages and their windows: sorted codes, each with its passage and place."""

    def __init__(self, passages: list[tuple[int, bytes]], rate: float):
        self.ids = [x for x, _ in passages]
        held = [(i, x) for i, (_, x) in enumerate(passages) if len(x) >= LEAST_BYTES]
        self.n_whole = len(held)
        held += [(i, part) for i, x in held for part in parts(x)]
        self.exact = Exact([(i, x) for i, (_, x) in enumerate(passages) if 0 < len(x) < LEAST_BYTES])
        self.owner = [i for i, _ in held]
        self.texts = [x for _, x in held]
        self.bytes = [np.frombuffer(x, np.uint8) for x in self.texts]
        self.size = np.array([len(x) for x in self.texts], np.int64)
        self.edits = np.array([budget(len(x), rate) for x in self.texts], np.int64)
        self.need = self.size - Q + 1 - Q * self.edits
        self.width = 2 * self.edits + 1
        found = [codes_of(x) for x in self.bytes]
        codes = np.concatenate([np.zeros(0, np.uint64), *found])
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.passage = np.repeat(np.arange(len(found)), [len(x) for x in found])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in found]])[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(codes)] = True
        reach = self.size + self.edits
        self.reach = int(reach.max(initial=0))
        tiles = -(-reach // _WINDOW)
        self.dense = int((-(-self.need // tiles)).min(initial=1 << 30))

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(row, passage, band) of the diagonal bands that hold as many shared grams as the passage asks for."""
        none = np.zeros((0, 3), np.int64)
        codes = codes_of(data)
        if not len(codes) or not len(self.codes):
            return none
        known = self.filter[self._slot(codes)]
        count = np.concatenate([[0], np.cumsum(known)])
        ahead = count[np.minimum(np.arange(len(known)) + _WINDOW, len(known))] - count[:-1]
        thick = np.flatnonzero(ahead >= self.dense)
        if not len(thick):
            return none
        mark = np.zeros(len(known) + 1, np.int64)
        np.add.at(mark, np.maximum(thick - self.reach, 0), 1)
        np.subtract.at(mark, np.minimum(thick + _WINDOW + self.reach, len(known)), 1)
        at = np.flatnonzero(known & (np.cumsum(mark[:-1]) > 0))
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[row + 1]
        at, row = at[inside], row[inside]
        rows, row = np.unique(row, return_inverse=True)
        out = [self._bands(codes, at[i : i + (1 << 17)], row[i : i + (1 << 17)], offsets[rows]) for i in range(0, len(at), 1 << 17)]
        if not out:
            return none
        keys, n = (np.concatenate(x) for x in zip(*out, strict=True))
        keys, back = np.unique(keys, return_inverse=True)
        n = np.bincount(back, n).astype(np.int64)
        pair = n.copy()  # a band overlaps the next: bands b and b + 1 are one of double width
        pair[:-1] += np.where(keys[1:] == keys[:-1] + 1, n[1:], 0)
        which = keys >> _BAND_BITS
        passage = which % len(self.size)
        good = pair >= self.need[passage]
        return np.stack([rows[which[good] // len(self.size)], passage[good], keys[good] & ((1 << _BAND_BITS) - 1)], axis=1)

    def _bands(self, codes: np.ndarray, at: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of (row, passage, band of diagonals) that share a gram with these places, and how often. Diagonals count from 0 where the
        passage would end at the row's start."""
        first = np.searchsorted(self.codes, codes[at], "left")
        n = np.searchsorted(self.codes, codes[at], "right") - first
        which = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        passage = self.passage[which]
        diagonal = np.repeat(at - start[row], n) - self.place[which] + self.size[passage]
        return np.unique((np.repeat(row, n) * len(self.size) + passage << _BAND_BITS) + diagonal // self.width[passage], return_counts=True)

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        """For each row (passage id, edits, start, end) of the passages that leak into it, whole or else in part; places are of the normalised data."""
        out: list[list] = [[] for _ in range(len(offsets) - 1)]
        best: dict[tuple[int, int], tuple[bool, int, int, int]] = {(row, owner): (False, 0, start, end) for row, owner, start, end in self.exact.leaks(data, offsets)}
        for row, passage, band in self.candidates(data, offsets).tolist():
            key, part = (row, self.owner[passage]), passage >= self.n_whole
            if part and key in best and best[key][:2] <= (True, 0):  # a row's whole passages come first
                continue
            width, size, edits = int(self.width[passage]), int(self.size[passage]), int(self.edits[passage])
            start = int(offsets[row]) - size + band * width
            low, high = max(int(offsets[row]), start - edits), min(int(offsets[row + 1]), start + 2 * width + size + edits)
            if high <= low:
                continue
            if (found := data[low:high].tobytes().find(self.texts[passage])) >= 0:
                got = (part, 0, low + found, low + found + size)
            elif key in best and best[key][:2] <= (part, 0):
                continue
            else:
                far, end = align(self.bytes[passage], data[low:high], edits)
                if far > edits:
                    continue
                back = align(self.bytes[passage][::-1], data[low : low + end][::-1], edits)[1]
                got = (part, far, low + end - back, low + end)
            best[key] = min(best.get(key, got), got)
        for (row, owner), (_, *got) in sorted(best.items()):
            out[row].append((self.ids[owner], *got))
        return out


def mark_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES, out: str = "leaks") -> DataFrame:
    """docs with the column `out`: array<struct<item_id, edits, start, end>>, replacing a column of that name; start and end are byte places in the text.

    Passages that are equal after normalisation count as the one with the smallest item_id; null passages, null item_ids and passages without
    a byte after normalisation are left out; those below LEAST_BYTES count where they stand exactly, at token borders. Null and empty texts have no leaks. Rows are judged each on their
    own: repeated rows get the same answer. Narrow: the documents aren't shuffled; the benchmark is broadcast in blocks of at most about
    block_bytes, windows included. A task indexes its block once; each further block is one more pass over the documents, from a written table.
    """
    folded = F.trim(F.regexp_replace(F.translate("text", UPPER, UPPER.lower()), r"[\x00-\x20]+", " "))
    items = benchmark.where("item_id is not null and text is not null").groupBy(folded.alias("text")).agg(F.min("item_id").alias("item_id")).where("text <> ''")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-2 * GROWTH * size // block_bytes) if GROWTH * size > block_bytes else 1)
    marked = docs.drop(out).withColumn(out, F.lit(None).cast("array<struct<item_id:bigint,edits:int,start:bigint,end:bigint>>"))
    for b in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == b).select("item_id", "text").toLocalIterator()
        marked = _marked(marked, sorted((i, x.encode()) for i, x in part), rate, out)
        if n_blocks > 1:
            marked = settle(marked, "leaks")
    return marked


def _marked(docs: DataFrame, passages: list[tuple[int, bytes]], rate: float, out: str) -> DataFrame:
    """docs with the leaks of these passages added to column out, in order of place and passage."""
    shared = docs.sparkSession.sparkContext.broadcast(passages)
    at_out, names = docs.columns.index(out), docs.columns
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, rate)
        for part, data, offsets in chunks(batches, "text"):
            low, at, origin = normalised(data, offsets)
            origin = np.append(origin, len(data))
            found = [x or [] for x in part.column(at_out).to_pylist()]
            for i, leaks in enumerate(index.leaks(low, at)):
                start = int(offsets[i])
                found[i] += [{"item_id": x, "edits": e, "start": int(origin[s]) - start, "end": int(origin[t - 1]) + 1 - start} for x, e, s, t in leaks]
            columns = list(part.columns)
            columns[at_out] = pa.array(found, kind)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs into which no passage leaks, with docs' columns."""
    (leaks,) = unused(docs, "skein_leaks")
    return mark_leaks(docs, benchmark, rate, out=leaks).where(F.size(leaks) == 0).select(*[F.col(c) for c in docs.columns])
