"""Byte-level BPE on length-bucketed padded matrices, its inverse, and token counts by a two-tier lookup.

Encoding: a text is split by the vocabulary's pattern; the distinct pieces that the worker has not met go to padded matrices, each with pieces
of like length. In each round every row of a matrix finds its minimum-rank pair (a hashed pair table gives ranks) and merges it from the left
on, then the matrix is compacted. Where it gives the same result as one place a round, a row merges all places of its pair in the round.

Null texts are empty: no tokens, no bytes. Texts may be of any length: pieces are cut by the pattern only, and a piece's matrix has as many
columns as the piece has bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from skein.llm.common import mix, release, thrifty

#: Pieces a worker remembers; beyond it the memory starts anew (results don't depend on it).
CACHE_PIECES = 200_000
#: Longest piece in bytes that is remembered.
CACHE_BYTES = 64
#: Cells of one padded matrix.
MATRIX_CELLS = 1 << 20
_NONE = np.int32((1 << 31) - 1)


def read_ranks(rank_file: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}


class PairTable:
    """(left id, right id) -> merged id, by open addressing in two numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        values = np.array(merged, np.int32)
        size = 1 << max(4, int(len(keys) * 3).bit_length())
        self.mask = np.int64(size - 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        slot = self._slot(keys)
        pending = np.arange(len(keys))
        self.reach = 0
        while len(pending):
            free = self.keys[slot[pending]] == -1
            _, chosen = np.unique(np.where(free, slot[pending], -1 - np.arange(len(pending))), return_index=True)
            chosen = pending[chosen[free[chosen]]]
            self.keys[slot[chosen]], self.values[slot[chosen]] = keys[chosen], values[chosen]
            pending = np.setdiff1d(pending, chosen, assume_unique=True)
            slot[pending] = (slot[pending] + 1) & self.mask
            self.reach += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys.view(np.uint64)).view(np.int64) & self.mask

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of the pairs; _NONE where they don't merge. Ids below 0 are padding."""
        a, b = left.ravel(), right.ravel()
        out = np.full(len(a), _NONE, np.int32)
        look = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[look].astype(np.int64) << 32 | b[look]
        slot = self._slot(keys)
        for _ in range(self.reach):
            found = self.keys[slot]
            hit = found == keys
            out[look[hit]] = self.values[slot[hit]]
            more = ~hit & (found != -1)
            if not more.any():
                break
            look, keys, slot = look[more], keys[more], (slot[more] + 1) & self.mask
        return out.reshape(left.shape)


class Encoder:
    """Ids of pieces by padded matrices; remembers short pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        todo = []
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = np.array([whole], np.int64)
            else:
                todo.append(i)
        todo.sort(key=lambda i: len(pieces[i]))
        at = 0
        while at < len(todo):
            to = at + 1
            shortest = max(8, len(pieces[todo[at]]))
            while to < len(todo) and len(pieces[todo[to]]) <= shortest * 5 // 4 and len(pieces[todo[to]]) * (to - at + 1) <= MATRIX_CELLS:
                to += 1
            for i, ids in zip(todo[at:to], self._merge([pieces[i] for i in todo[at:to]]), strict=True):
                out[i] = ids
            at = to
        return out

    def _merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """One bucket: rows leave when none of their pairs merge; the rest are compacted to the longest row left."""
        n = np.array([len(x) for x in pieces])
        ids = np.full((len(pieces), int(n.max()) + 1), -1, np.int32)
        ids[np.arange(ids.shape[1])[None, :] < n[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(ids.shape, _NONE, np.int32)
        ranks[:, :-1] = self.pairs.ranks_of(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(pieces))
        out: list = [None] * len(pieces)
        while len(row):
            least = ranks.min(axis=1)
            if (done := least == _NONE).any():
                for k in np.flatnonzero(done):
                    out[row[k]] = ids[k][ids[k] >= 0]
                row, ids, least, ranks = row[~done], ids[~done], least[~done], ranks[~done]
                if not len(row):
                    break
            here = ranks == least[:, None]
            first = np.arange(here.shape[1])[None, :] == here.argmax(axis=1)[:, None]
            every = _from_left(here)
            after = self._apply(ids, ranks, every, least)
            # Merging one place at a time would turn to a pair that ranks no later as soon as a merge makes one: such rows take one place.
            early = after[1].min(axis=1) <= least
            close = (every[:, 2:] & every[:, :-2]).any(axis=1)
            if close.any():
                left = ids[np.arange(len(ids)), here.argmax(axis=1)]
                early |= close & (self.pairs.ranks_of(least, left) <= least)
            if early.any():
                after = self._apply(ids, ranks, np.where(early[:, None], first, every), least)
            ids, ranks = after
        return out

    def _apply(self, ids: np.ndarray, ranks: np.ndarray, places: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each row's places into its id `made` and compact; only pairs beside a merge are looked up again."""
        keep = ids >= 0
        keep[:, 1:] &= ~places[:, :-1]
        n = keep.sum(axis=1)
        shape = (len(ids), int(n.max()) + 1)
        fill = np.arange(shape[1])[None, :] < n[:, None]
        new_ids, new_ranks, new = np.full(shape, -1, np.int32), np.full(shape, _NONE, np.int32), np.zeros(shape, bool)
        new_ids[fill], new_ranks[fill], new[fill] = np.where(places, made[:, None], ids)[keep], ranks[keep], places[keep]
        stale = new.copy()
        stale[:, :-1] |= new[:, 1:]
        r, c = np.nonzero(stale[:, :-1])
        new_ranks[r, c] = self.pairs.ranks_of(new_ids[r, c], new_ids[r, c + 1])
        return new_ids, new_ranks


def _from_left(here: np.ndarray) -> np.ndarray:
    """Of each run of adjacent True cells, the first, third, fifth...: places that don't overlap, taken from the left."""
    if not (here[:, 1:] & here[:, :-1]).any():
        return here
    column = np.arange(here.shape[1])[None, :]
    start = np.where(here, -1, column)
    last_off = np.maximum.accumulate(start, axis=1)
    return here & ((column - last_off) % 2 == 1)


class Codec:
    """A worker's encoder, memory of pieces and decode table for one vocabulary."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = read_ranks(rank_file)
        self.encoder = Encoder(self.ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        top = max(self.ranks.values()) + 1
        self.token_bytes: list[bytes] = [b""] * top
        self.decimal = list(map(str, range(top)))
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, special strings being ordinary text."""
        split = [self.split(text) for text in texts]
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known, extra = self.known, {}
        new = list({p for pieces in split for p in pieces} - known.keys())
        for piece, ids in zip(new, self.encoder.encode_pieces([p.encode() for p in new]), strict=True):
            (known if len(piece) <= CACHE_BYTES else extra)[piece] = tuple(ids.tolist())
        look = known if not extra else {**known, **extra}
        return [list(chain.from_iterable(map(look.__getitem__, pieces))) for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The worker's codec for these ranks, made once."""
    key = (hashlib.md5(rank_file).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def _text_runs(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows with about limit characters."""
    texts = [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= limit):
            size += len(texts[to])
            to += 1
        yield at, to, texts[at:to]
        at = to


def _ids_type() -> pa.DataType:
    return pa.list_(pa.int32())


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with an array<int> column of the token ids of column text (replaced if there). Null text: no ids. Narrow: no shuffle."""
    with open(rank_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = docs.drop(ids)
    names = [*kept.columns, ids]
    schema = kept.withColumn(ids, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        c = codec(ranks.value, pattern)
        for batch in batches:
            for at, to, texts in _text_runs(batch, text):
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c.encode(texts), _ids_type())], names)
        release()

    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, rank_path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """coded with a binary column of the bytes that the ids stand for. Null ids: no bytes. Ids outside the vocabulary fail the job."""
    with open(rank_path, "rb") as f:
        ranks = coded.sparkSession.sparkContext.broadcast(f.read())
    kept = coded.drop(out)
    names = [*kept.columns, out]
    schema = kept.withColumn(out, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        c = codec(ranks.value, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.decode(x or []) for x in lists], pa.binary())], names)

    return kept.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so that ids of long texts never leave the task. Null texts are
    empty; a repeated row gives its row again; other columns, also of these names, are ignored; empty in, empty out."""
    with open(rank_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(key, F.col(text).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        c = codec(ranks.value, pattern)
        for batch in batches:
            for at, to, texts in _text_runs(batch, "text"):
                n, one, two = [], [], []
                for ids in c.encode(texts):
                    n.append(len(ids))
                    one.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                    two.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return rows.mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


# -- token counts -------------------------------------------------------------------------------------------------------------------


class LengthTable:
    """Token counts of pieces by 128-bit hash, in sorted arrays: 18 bytes a piece."""

    def __init__(self, pieces: list[str], lengths: list[int]):
        high, low = self._hashes(pieces)
        order = np.lexsort((low, high))
        self.high, self.low, self.lengths = high[order], low[order], np.array(lengths, np.uint16)[order]

    @staticmethod
    def _hashes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        digests = b"".join([xxh3_128_digest(p.encode()) for p in pieces])
        both = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def lookup(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece; 0 for a piece that isn't here."""
        if not len(self.high) or not pieces:
            return np.zeros(len(pieces), np.int64)
        high, low = self._hashes(pieces)
        at = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        return np.where((self.high[at] == high) & (self.low[at] == low), self.lengths[at], 0).astype(np.int64)


def frequent_pieces(docs: DataFrame, pattern: str, frequent: int, sample: int, text: str = "text") -> list[str]:
    """The most frequent pieces of about `sample` rows, `frequent` at most. Tasks tally their own rows; only tallies are shuffled."""
    split = regex.compile(pattern).findall
    n = docs.count()
    drawn = docs.select(F.col(text).alias("text")).sample(min(1.0, sample / max(1, n)), seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[str] = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                tally.update(p for p in split(x or "") if len(p) <= CACHE_BYTES)
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["piece", "n"])
        release()

    counted = drawn.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in counted.orderBy(F.desc("n"), "piece").limit(frequent).collect()]


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, frequent: int = 50_000, sample: int = 10_000, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a long column: the tokens that the tokenizers library gives for column text by this byte-level file, without added tokens;
    added tokens' strings inside a text count as the library counts them. Null text: 0. A column of the name `out` is replaced; repeated rows
    get the same count; empty in, empty out. Narrow: no pre-token is ever shuffled.

    Tier one is broadcast: a compact table of hashes and token counts of the `frequent` pre-tokens that a sample of about `sample` rows has most
    often; all counts are right whatever is in it. Tier two is the worker's memory of what it has looked up, misses included, which the library
    itself encodes in batches; it starts anew when it holds CACHE_PIECES, and pieces over CACHE_BYTES aren't kept.
    """
    import json

    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        file = f.read()
    added = [x["content"] for x in json.loads(file).get("added_tokens", [])]
    pieces = frequent_pieces(docs, pattern, frequent, sample, text)
    library = Tokenizer.from_str(file)
    library.no_truncation(), library.no_padding()
    table = LengthTable(pieces, [len(x) for x in library.encode_batch_fast(pieces, add_special_tokens=False)] if pieces else [])
    shared = docs.sparkSession.sparkContext.broadcast((file, table, added))
    kept = docs.drop(out)
    names = [*kept.columns, out]
    schema = kept.withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        count = counter(shared.value, pattern)
        for batch in batches:
            n: list[int] = []
            for _, _, texts in _text_runs(batch, text):
                n += count(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names)
        release()

    return kept.mapInArrow(run, schema)


_counters: dict[bytes, Callable] = {}


def counter(shared: tuple, pattern: str) -> Callable[[list[str]], list[int]]:
    """The worker's counter for this vocabulary, made once."""
    file, table, added = shared
    key = hashlib.md5(file.encode()).digest()
    if key in _counters:
        return _counters[key]
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(file)
    library.no_truncation(), library.no_padding()
    split = regex.compile(pattern).findall
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        parts = [split(x) for x in texts]
        if len(known) > CACHE_PIECES:
            known.clear()
        new = list({p for pieces in parts for p in pieces if p not in known})
        lengths = table.lookup(new)
        misses = np.flatnonzero(lengths == 0).tolist()
        if misses:
            lengths[misses] = [len(x) for x in library.encode_batch_fast([new[i] for i in misses], add_special_tokens=False)]
        extra = {}
        for piece, n in zip(new, lengths.tolist(), strict=True):
            (known if len(piece) <= CACHE_BYTES else extra)[piece] = n
        look = known if not extra else {**known, **extra}
        n = [sum(map(look.__getitem__, pieces)) for pieces in parts]
        for i, x in enumerate(texts):
            if any(a in x for a in added):
                n[i] = len(library.encode(x, add_special_tokens=False))
        return n

    _counters[key] = count
    return count
