"""Shared pieces of the corpus operators: Arrow batches as flat bytes, hashing, words and shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task turns into numpy arrays at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, made from these; case doesn't tell columns apart."""
    taken = {c.lower() for c in df.columns}
    return [next(x for k in range(len(taken) + 1) if (x := name + "_" * k).lower() not in taken) for name in names]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts have at most limit bytes (one longer text stands alone), with their flat bytes and offsets."""
    thrifty()
    for batch in batches:
        data, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    release()


#: Of glibc's mallopt: blocks from MMAP on are the system's again as soon as they are freed, and so is what lies unused at the heap's end beyond TRIM.
_MMAP, _TRIM = (-3, 4 << 20), (-1, 16 << 20)
_libc = ctypes.CDLL(None)


def thrifty() -> None:
    """At a task's start, in a Python worker: have Arrow and numpy hand back what they free. Workers live on, and each stage needs memory for other things."""
    pa.set_memory_pool(pa.system_memory_pool())
    if hasattr(_libc, "mallopt"):  # glibc
        for option in (_MMAP, _TRIM):
            _libc.mallopt(*option)


def release() -> None:
    """At a task's end, in a Python worker."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


# splitmix64 constants
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MULTIPLIER = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = x + _A
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """multiplier**i and its inverse for i < n, modulo 2**64; kept by the worker for chunk-sized n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        made = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.multiply.accumulate(x))
        if size > 4 * CHUNK_BYTES:
            return made[0][:n], made[1][:n]
        _powers["up"], _powers["down"] = made
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _B)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs without the six ASCII white-space bytes: start, end, hash (A-Z lower-cased) and row of each; rows never share a word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    hashes = span_hashes(_LOWER[data] if lower else data, starts, ends)
    return starts, ends, hashes, np.searchsorted(offsets, starts, "right") - 1


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of width words, and the row of each; a row with fewer words has its whole sequence as one."""
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    has = np.maximum(count - width + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(n_rows), has)
    at = np.arange(has.sum()) - np.repeat(np.cumsum(has) - has, has) + first[row]
    left = np.minimum(count[row], width)
    out = left.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            step = hashes[np.minimum(at + i, len(hashes) - 1)] if len(hashes) else np.zeros(0, np.uint64)
            out = np.where(i < left, mix(out * _B + step), out)
    return out, row


def runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of set flags over flat bytes; rows never share a run."""
    if not len(solid):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(solid) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (~np.concatenate([[False], solid[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(solid & (~np.concatenate([solid[1:], [False]]) | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[data]
