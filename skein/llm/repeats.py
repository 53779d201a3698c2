"""Removal of byte strings that stand earlier in the corpus already, with Burrows-Wheeler intervals where it is close.

Every window of LENGTH bytes has an anchor: its gram of GRAM bytes with the least hash. Neighbouring windows with one anchor are a run; equal
windows have equal anchors, so only runs under one anchor hash need comparing. Runs that are equal as a whole are settled by their hash: all
but the first in corpus order go. Where several different runs share an anchor, one of each kind goes to a shard as text, and there the
suffix array's common prefixes are found by increasing value, by breadth-first backward extension of intervals on the Burrows-Wheeler
transform; it stops at LENGTH, when the boundaries not reached are those between suffixes that share LENGTH bytes or more.

Only hashes of runs are shuffled for all texts; texts of runs only where an anchor is contested. An anchor with more than SPREAD kinds of runs
is dealt over several shards, whose first windows are then matched by hash with map-side minima. So is one of which a flush alone holds more
than HOT_KINDS kinds (fewer, where there are so many flushes that one bucket would gather too much): its runs go to buckets by content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import _B, _BYTES, chunks, mix, powers, release, span_hashes, thrifty, unused
from skein.shared import settle

LENGTH, GRAM = 100, 32
#: Kinds of runs of one anchor in one shard; bytes of a shard and of a bucket of run hashes; bytes of text between two flushes.
SPREAD, SHARD_BYTES, BUCKET_BYTES, FLUSH_BYTES = 256, 1 << 19, 8 << 20, 8 << 20
#: Kinds of runs of one anchor beyond which a flush deals them by content over all buckets, and that all flushes may leave in one bucket.
HOT_KINDS, BUCKET_KINDS = 64, 1 << 20
#: Bytes of a longer text that are looked at at once.
SEGMENT = 1 << 24
_PLACE_BITS = 28


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size bytes from each place on."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
        return mix((sums[size:] - sums[:-size]) * down[: len(data) - size + 1] + np.uint64(size) * _B)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive cells, by minima from block starts and to block ends."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor (of equal least hashes the first): row, first window, number of windows, hash of the anchor's gram,
    hash of all bytes that the windows cover and of the anchor's place in them."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = gram_hashes(data, gram)
    places = np.uint64((1 << _PLACE_BITS) - 1)
    anchor = (sliding_min(grams & ~places | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & places).astype(np.int64)
    change = np.ones(len(anchor) + 1, bool)
    change[1:-1] = anchor[1:] != anchor[:-1]
    for cut in (offsets, offsets - length + 1):  # a run ends with its row's last window
        change[cut[(cut >= 0) & (cut <= len(anchor))]] = True
    cuts = np.flatnonzero(change)
    first, end = cuts[:-1], cuts[1:]
    row = np.searchsorted(offsets, first, "right") - 1
    keep = end - 1 + length <= offsets[row + 1]
    row, first, end = row[keep], first[keep], end[keep]
    anchor = anchor[first]
    with np.errstate(over="ignore"):
        whole = mix(span_hashes(data, first, end + length - 1) + (anchor - first).astype(np.uint64) * _B)
    return row, first - offsets[row], end - first, grams[anchor], whole


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchored_runs, of a long text segment by segment: runs are cut there, which changes no anchor."""
    if len(data) <= SEGMENT + length:
        return anchored_runs(data, offsets, length, gram)
    made = []
    for row in range(len(offsets) - 1):
        for at in range(int(offsets[row]), int(offsets[row + 1]), SEGMENT):
            piece = data[at : min(at + SEGMENT + length - 1, int(offsets[row + 1]))]
            _, first, n, anchor, whole = anchored_runs(piece, np.array([0, len(piece)]), length, gram)
            made.append((np.full(len(first), row), first + at - offsets[row], n, anchor, whole))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


#: A run in transit: document, hash of its text, first window, number of windows, anchor hash, content hash.
_RUN = np.dtype([("doc", "<i8"), ("th", "<i8"), ("first", "<u4"), ("n", "<u2"), ("anchor", "<u8"), ("whole", "<u8")])
_RUN_FIELDS = ["doc", "th", "first", "n", "anchor", "whole"]
_OUT = "kind int, doc_id long, th long, first long, n long, shard long, hot boolean"
_OUT_NAMES = ["kind", "doc_id", "th", "first", "n", "shard", "hot"]


def _rows(kind: int, doc: np.ndarray, th: np.ndarray, first: np.ndarray, n: np.ndarray, shard: np.ndarray | None = None, hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(doc), 100_000):
        to = min(len(doc), at + 100_000)
        zero = np.zeros(to - at, np.int64)
        columns = [np.full(to - at, kind, np.int32), doc[at:to], th[at:to], first[at:to].astype(np.int64), n[at:to].astype(np.int64), zero if shard is None else shard[at:to], zero.astype(bool) if hot is None else hot[at:to]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], _OUT_NAMES)


def _ordered(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs by anchor, content and corpus order; which of them are no later than the first of their content (a repeated row is the same document)."""
    runs = runs[np.lexsort((runs["first"], runs["th"], runs["doc"], runs["whole"], runs["anchor"]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs["anchor"][1:] != runs["anchor"][:-1]) | (runs["whole"][1:] != runs["whole"][:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (runs["doc"] == runs["doc"][lead]) & (runs["th"] == runs["th"][lead]) & (runs["first"] == runs["first"][lead])
    return runs, new | same


_BY_ANCHOR, _SETTLED, _BY_CONTENT, _MARKS = range(4)


def run_hashes(docs: DataFrame, buckets: int, length: int, gram: int, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """(bucket, what, runs): for each flush and bucket of anchors the first run of each content; later ones of the flush are settled, in any
    bucket. Runs of an anchor with more than hot_kinds kinds in the flush are dealt by content instead, and the anchor's own bucket gets a mark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            runs, keep = _ordered(np.concatenate(held))
            held.clear()
            gone, runs = runs[~keep], runs[keep]
            new = np.ones(len(runs), bool)
            new[1:] = runs["anchor"][1:] != runs["anchor"][:-1]
            group = np.cumsum(new) - 1
            hot = np.bincount(group)[group] > hot_kinds if len(runs) else new
            home = lambda x: (x >> np.uint64(_PLACE_BITS)).astype(np.int64) % buckets
            # columns rather than records, which compress better on the way
            pack = lambda x: b"".join(np.ascontiguousarray(x[f]).tobytes() for f in _RUN_FIELDS)
            made = []

            def deal(rows: np.ndarray, bucket: np.ndarray, what: int, packed: Callable) -> None:
                order = np.argsort(bucket, kind="stable")
                rows, bucket = rows[order], bucket[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(rows) else np.zeros(1, int)
                made.extend((int(bucket[a]), what, packed(rows[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True))

            deal(runs[~hot], home(runs["anchor"][~hot]), _BY_ANCHOR, pack)
            if hot.any():
                deal(runs[hot], home(runs["whole"][hot]), _BY_CONTENT, pack)
                marks = runs["anchor"][hot & new]
                deal(marks, home(marks), _MARKS, lambda x: np.ascontiguousarray(x).tobytes())
            if len(gone):
                made.append((int(gone["whole"][0] % np.uint64(buckets)), _SETTLED, pack(gone)))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.int32()), pa.array([x[2] for x in made], pa.binary())], ["bucket", "what", "runs"])

        for part, data, offsets in chunks(batches, "text"):
            row, first, n, anchor, whole = runs_of(data, offsets, length, gram)
            made = np.empty(len(row), _RUN)
            made["doc"], made["th"] = np.asarray(part.column(0))[row], np.asarray(part.column(1))[row]
            made["first"], made["n"], made["anchor"], made["whole"] = first, n, anchor, whole
            held.append(made)
            size += len(data)
            if size >= FLUSH_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.select("doc_id", "th", "text").mapInArrow(run, "bucket long, what int, runs binary")


def compare_runs(packed: DataFrame) -> DataFrame:
    """kind 0: windows first .. first + n - 1 of a document go; kind 1: the first run of its content under a contested anchor, its shard key
    and whether its anchor is dealt over several shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        held: dict[int, list] = {_BY_ANCHOR: [], _BY_CONTENT: []}
        marks, bucket = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            what, column = batch.column(1).to_pylist(), batch.column(2)
            for i in range(batch.num_rows):
                raw = column[i].as_buffer()
                if what[i] == _MARKS:
                    marks.append(np.frombuffer(raw, np.uint64))
                    continue
                runs, at = np.empty(raw.size // _RUN.itemsize, _RUN), 0
                for f in _RUN_FIELDS:
                    runs[f] = np.frombuffer(raw, _RUN[f], len(runs), at)
                    at += runs[f].dtype.itemsize * len(runs)
                if what[i] == _SETTLED:
                    yield from _rows(0, runs["doc"], runs["th"], runs["first"], runs["n"])
                else:
                    bucket = batch.column(0)[i].as_py()
                    held[what[i]].append(runs)
        marked = np.unique(np.concatenate(marks))
        for what, parts in held.items():
            if not parts:
                continue
            runs, keep = _ordered(np.concatenate(parts))
            parts.clear()
            gone = runs[~keep]
            yield from _rows(0, gone["doc"], gone["th"], gone["first"], gone["n"])
            runs = runs[keep]
            new = np.ones(len(runs), bool)
            new[1:] = runs["anchor"][1:] != runs["anchor"][:-1]
            group = np.cumsum(new) - 1
            lead = np.flatnonzero(new)
            kinds = np.bincount(group)[group]
            salt = (np.arange(len(runs)) - lead[group]) // SPREAD
            hot = kinds > SPREAD
            if what == _BY_CONTENT:
                salt += (bucket + 1) << 24
                hot[:] = True
            elif len(marked):
                hot |= np.isin(runs["anchor"], marked)
            with np.errstate(over="ignore"):
                shard = mix(runs["anchor"] + salt.astype(np.uint64) * _B).view(np.int64)
            want = hot | (kinds > 1)
            runs = runs[want]
            yield from _rows(1, runs["doc"], runs["th"], runs["first"], runs["n"], shard[want], hot[want])

    return packed.groupBy("bucket").applyInArrow(run, _OUT)


# -- contested anchors ----------------------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a cyclic text of 16-bit symbols in order of the depth symbols (at least) from there on, by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text, text[:3] if n >= 3 else np.resize(text, 3)]).astype(np.uint64)
    keys = padded[:n] << np.uint64(48) | padded[1 : n + 1] << np.uint64(32) | padded[2 : n + 2] << np.uint64(16) | padded[3 : n + 3]
    known = 4
    while True:
        order = np.argsort(keys)
        ranked = keys[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if known >= depth or rank[order[-1]] == n - 1:
            return order
        keys = (rank * n + np.roll(rank, -known)).view(np.uint64)
        known *= 2


def shares_prefix(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a text with separators 0, and for each of its cells whether the suffix shares length symbols with the one before.

    Breadth-first: the interval of a string extends to the left by every symbol that the Burrows-Wheeler transform has in it; an extension
    whose right boundary is new gives the common prefix there the string's length and is extended in its turn. Strings with a separator in
    front are left out: nothing with a separator inside is asked for."""
    n = len(text)
    order = suffix_array(text, length)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    last_to_first = place[order - 1]
    first_symbol = text[order]
    onward = place[(order + 1) % n]
    bound = np.zeros(n + 1, bool)
    bound[0] = bound[n] = True
    owner = np.zeros(n, np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for level in range(length):
        if not len(low):
            break
        size = high - low
        at = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        owner[at] = np.repeat(np.arange(len(low)), size)
        to = last_to_first[at]
        if level:
            to = to[first_symbol[to] != 0]
        to = np.sort(to)
        new = np.ones(len(to) + 1, bool)
        if len(to):
            own, symbol = owner[onward[to]], first_symbol[to]
            new[1:-1] = (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1])
        cuts = np.flatnonzero(new)
        if len(cuts) < 2:
            break
        low, high = to[cuts[:-1]], to[cuts[1:] - 1] + 1
        fresh = ~bound[high]
        low, high = low[fresh], high[fresh]
        bound[high] = True
    return order, ~bound[:n]


def _shard_windows(rows: list[dict], length: int) -> Iterator[pa.RecordBatch]:
    """Of a shard's run texts: kind 0 windows that stand earlier in the shard; kind 2, of dealt anchors, the first of each content with its hash."""
    doc, th, first, n, hot = (np.concatenate([np.frombuffer(r[f], t) for r in rows]) for f, t in (("docs", "<i8"), ("ths", "<i8"), ("firsts", "<i8"), ("ns", "<i8"), ("hots", "?")))
    data = np.frombuffer(b"".join(r["texts"] for r in rows), np.uint8)
    size = n + length - 1
    start = np.cumsum(size) - size
    text = np.zeros(len(data) + len(size), np.uint16)
    at = start + np.arange(len(size))
    inside = np.ones(len(text), bool)
    inside[at + size] = False
    text[inside] = data.astype(np.uint16) + 1
    order, shares = shares_prefix(text, length)
    run = np.searchsorted(at, order, "right") - 1
    offset = order - at[run]
    window = offset < n[run]
    run, offset, shares = run[window], offset[window], shares[window]
    group = np.cumsum(~shares)
    place = first[run] + offset
    by = np.lexsort((place, th[run], doc[run], group))
    run, place, offset, group = run[by], place[by], offset[by], group[by]
    lead = np.ones(len(group), bool)
    lead[1:] = group[1:] != group[:-1]
    head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    same = (doc[run] == doc[run[head]]) & (th[run] == th[run[head]]) & (place == place[head])
    gone = ~lead & ~same
    yield from _joined(doc[run[gone]], th[run[gone]], place[gone])
    ask = lead & hot[run]
    if ask.any():
        r, o = run[ask], offset[ask]
        hashes = span_hashes(data, start[r] + o, start[r] + o + length).view(np.int64)
        yield from _rows(2, doc[r], th[r], place[ask], np.ones(len(r), np.int64), hashes)


def _joined(doc: np.ndarray, th: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """kind 0 rows of windows, adjacent ones as one."""
    by = np.lexsort((place, th, doc))
    doc, th, place = doc[by], th[by], place[by]
    new = np.ones(len(doc) + 1, bool)
    new[1:-1] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (place[1:] > place[:-1] + 1)
    cuts = np.flatnonzero(new)
    if len(cuts) > 1:
        a, b = cuts[:-1], cuts[1:] - 1
        yield from _rows(0, doc[a], th[a], place[a], place[b] - place[a] + 1)


_TEXTS = "shard long, docs binary, ths binary, firsts binary, ns binary, hots binary, texts binary"
_TEXT_NAMES = ["shard", "docs", "ths", "firsts", "ns", "hots", "texts"]


def run_texts(docs: DataFrame, contested: DataFrame, shards: int, length: int) -> DataFrame:
    """Texts of contested runs, packed by shard."""
    asked = contested.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "n", "shard", "hot")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: dict[int, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            made = []
            for shard, runs in held.items():
                columns = list(zip(*runs, strict=True))
                made.append((shard, *(np.array(c, np.int64).tobytes() for c in columns[:4]), np.array(columns[4], bool).tobytes(), b"".join(columns[5])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int64()), *[pa.array([x[i] for x in made], pa.binary()) for i in range(1, 7)]], _TEXT_NAMES)

        for batch in batches:
            for i in range(batch.num_rows):
                doc, th = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if (doc, th) in seen:
                    continue  # a repeated row
                seen.add((doc, th))
                data = batch.column(2)[i].as_buffer().to_pybytes()
                runs = batch.column(3)[i].values.flatten()
                for first, n, shard, hot in zip(*(x.to_pylist() for x in runs), strict=True):
                    held.setdefault(shard % shards, []).append((doc, th, first, n, hot, data[first : first + n + length - 1]))
                    size += n + length
                if size >= FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.join(asked, ["doc_id", "th"]).select("doc_id", "th", F.col("text").cast("binary").alias("text"), "asked").mapInArrow(run, _TEXTS)


def compare_texts(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        rows = [r for batch in batches for r in batch.to_pylist()]
        yield from _shard_windows(rows, length)
        release()

    return texts.groupBy("shard").applyInArrow(run, _OUT)


def repeated_windows(docs: DataFrame, length: int, gram: int, label: str) -> DataFrame:
    """(doc_id, th, first, n): runs of windows that stand earlier in the corpus. docs: doc_id (not null), th (hash of text), text (not null)."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = 2 * total // (length - gram + 2)
    buckets = max(2 * partitions, runs * _RUN.itemsize // BUCKET_BYTES)
    hot_kinds = max(1, min(HOT_KINDS, BUCKET_KINDS // (total // FLUSH_BYTES + partitions)))
    found = settle(compare_runs(run_hashes(docs, buckets, length, gram, hot_kinds)), f"{label}-runs")
    contested = found.where("kind = 1")
    size = contested.agg(F.sum(F.col("n") + length)).first()[0] or 0
    windows = found.where("kind = 0").select("doc_id", "th", "first", "n")
    if not size:
        return windows
    shards = max(partitions, size // SHARD_BYTES + 1)
    close = settle(compare_texts(run_texts(docs, contested, shards, length), length), f"{label}-close")
    windows = windows.union(close.where("kind = 0").select("doc_id", "th", "first", "n"))
    dealt = close.where("kind = 2").select(F.col("shard").alias("hash"), F.struct("doc_id", "th", "first").alias("at"))
    least = settle(dealt.groupBy("hash").agg(F.min("at").alias("least"), F.max("at").alias("most")).where("least <> most").select("hash", "least"), f"{label}-least")
    late = dealt.join(least, "hash").where("at <> least").select("at.doc_id", "at.th", "at.first", F.lit(1).cast("long").alias("n"))
    return windows.union(late)


def remove_repeats(docs: DataFrame, length: int = LENGTH, label: str = "repeats", as_text: bool = False) -> DataFrame:
    """docs without text, with n_bytes, kept (binary), n_removed, n_spans, which replace columns of these names.

    Texts are UTF-8 bytes; a null text is empty. A byte goes if a string of `length` bytes that covers it also starts earlier: in a document
    with a smaller doc_id, or earlier in its own. Matches never cross documents and are judged on the input. Rows that repeat a doc_id with
    another text are documents in order of a hash of the text; rows that repeat both are one document and are treated alike. A row with a
    null doc_id is neither compared nor changed. Other columns pass through. as_text: instead of kept, text as a string, without the bytes of
    characters that a removal cut through; a null text is then empty.
    """
    gram = max(1, min(GRAM, length // 2))
    plain = docs.drop("n_bytes", "kept", "n_removed", "n_spans")
    th, doc, at, held, whole = unused(docs, "skein_th", "skein_doc", "skein_at", "skein_spans", "skein_text")
    text = F.coalesce("text", F.lit(""))
    keyed = plain.withColumn(th, F.xxhash64(text))
    source = plain.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    windows = repeated_windows(source, length, gram, label)
    spans = windows.groupBy(F.col("doc_id").alias(doc), F.col("th").alias(at)).agg(F.collect_list(F.struct("first", "n")).alias(held))
    joined = keyed.join(spans, (F.col("doc_id") == F.col(doc)) & (F.col(th) == F.col(at)), "left")
    rest = [c for c in plain.columns if c != "text"]
    rows = joined.select(*rest, text.cast("binary").alias(whole), held)
    kept_name = "text" if as_text else "kept"
    names = [*rest, "n_bytes", kept_name, "n_removed", "n_spans"]
    schema = plain.select(*rest).withColumns({"n_bytes": F.lit(0).cast("long"), kept_name: F.lit("").cast("string" if as_text else "binary"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long")}).schema
    k = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, kept, spans = [], [], []
            for i in range(batch.num_rows):
                data = batch.column(k)[i].as_buffer()
                size.append(data.size)
                if not batch.column(k + 1)[i].is_valid:
                    kept.append(data.to_pybytes()), spans.append(0)
                    continue
                first, n = (np.asarray(x) for x in batch.column(k + 1)[i].values.flatten())
                change = np.zeros(data.size + 1, np.int64)
                np.add.at(change, first, 1)
                np.subtract.at(change, first + n + length - 1, 1)
                stay = np.cumsum(change[:-1]) == 0
                spans.append(int((~stay[1:] & stay[:-1]).sum() + ~stay[0]))
                kept.append(np.frombuffer(data, np.uint8)[stay].tobytes())
            text = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            out = [pa.array(size, pa.int64()), text, pa.array([a - len(b) for a, b in zip(size, kept, strict=True)], pa.int64()), pa.array(spans, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *out], names)

    return rows.mapInArrow(run, schema)
