"""N-gram Jaccard join on parity sketches.

A text's set is its distinct word shingles. A sketch is a row of 64-bit words; each shingle's hash is XORed into one word, so that two
sketches differ in at most as many words as the sets' symmetric difference has shingles. At a similarity of num/den that is at most
d = (a + b)(den - num) / (den + num). Sizes fall into bands; a band's sketch has d + 1 + SPARE words, so linked sets agree in at least
1 + SPARE words: sets that share a word of the same place are candidates, and every candidate is verified on the whole sets. No pair of
linked sets is missed.

Equal sets are one class from the start. A word's bucket is first reduced within each map-side run of rows and then by bucket: members are
tied to a hub (the smallest class there), so a bucket of k classes makes k - 1 candidates. After these are verified and connected, classes
outside a bucket's largest component are compared with a member of it. Of buckets that still hold two components, those of SMALL classes at most
are compared in full; classes of larger ones are keyed by their rarest shingles, one of which any two that link share early enough for both sizes, so
that neither a sketch word that a template fills nor copies that just miss the bar make all pairs. No link that could join two components is lost. Pairs are screened by sizes and parity bits before sets are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import chunks, mix, shingle_hashes, unused, words
from skein.shared import connected, discard, scratch, settle

#: Words beyond those that the pigeonhole needs, so that empty words seldom must be keys; ratio of a size band's ends.
SPARE, BAND = 1, 1.4
#: Keys that a map-side run gathers before it reduces them; bytes of keys a bucket should hold.
RUN_KEYS, BUCKET_BYTES = 1 << 18, 8 << 20


#: Classes of a bucket that are compared with each other: so many at most, else they are keyed by rare shingles.
SMALL = 32
#: Bands of sizes from the smallest set that can link with another one up to its own size.
SIZE_STEPS = 6
#: Counters of the table that tells rare shingles from frequent ones: a bounded broadcast.
SLOTS = 1 << 18
#: Counters in a row of a task's table.
BLOCK = 1 << 12
#: 64-bit words of the parity bits that screen candidates.
PARITY_WORDS = 16
_PARITY = [f"p{i}" for i in range(PARITY_WORDS)]


def band_edges(limit: int) -> list[int]:
    """Smallest set sizes of the bands, up to limit."""
    edges = [1]
    while edges[-1] <= limit:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return edges


_EDGES = np.array(band_edges(1 << 40), np.int64)


def sketches(hashes: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(band, words, alike) of one set, in its own size band and in every higher one that a larger linked set can lie in: a set of that band that links
    with it has at least alike of the words."""
    n = len(hashes)
    own = int(np.searchsorted(_EDGES, n, "right")) - 1
    for band in range(own, len(_EDGES) - 1):
        low, high = int(_EDGES[band]), int(_EDGES[band + 1]) - 1
        if band > own and n * den < low * num:
            break
        most = 2 * high * (den - num) // (den + num)
        blocks = most + 1 + SPARE
        word = ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)  # rises with the sorted hashes
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sketch = np.zeros(blocks, np.uint64)
        sketch[word[first]] = np.bitwise_xor.reduceat(hashes, first)
        larger = min(n * den // num, high)
        yield band, sketch, blocks - (n + larger) * (den - num) // (den + num)


def sketch_keys(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of one set's sketch words in all its bands."""
    keys = []
    for band, sketch, alike in sketches(hashes, num, den):
        with np.errstate(over="ignore"):
            key = mix(sketch ^ mix(np.arange(len(sketch), dtype=np.uint64) + np.uint64(band << 40)))
        filled = sketch != 0
        if (~filled).sum() < alike:
            key = key[filled]  # a linked set then agrees in a filled word
        keys.append(key)
    return np.concatenate(keys)


def least_shared(hashes: np.ndarray, num: int, den: int) -> int:
    """How many sketch keys a set has in common with any that it links with, at least. Empty words may be no keys of the other one."""
    return min(max(1, alike - int((sketch == 0).sum())) for _, sketch, alike in sketches(hashes, num, den))


def text_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of rows with each row's sorted distinct shingle hashes."""
    for part, data, offsets in chunks(batches, "text"):
        _, _, hashes, rows = words(data, offsets)
        made, row = shingle_hashes(hashes, rows, part.num_rows, width)
        cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
        yield part, [np.unique(made[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return int(hashes.sum(dtype=np.uint64).astype(np.int64)), int(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, lo, hi): size and digest of each document's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in text_sets(batches, width):
            d = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64())], ["doc_id", "n", "lo", "hi"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, lo long, hi long")


def _reduce(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sort a bucket's (key, class) rows: each key with its hub, the rows of keys with two classes or more, and distinct (hub, member) links."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    if len(keys):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids = keys[new], ids[new]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    many = np.bincount(group)[group] > 1 if len(keys) else first
    hubs = ids[first]
    links = np.unique(np.stack([hubs[group][many & ~first], ids[many & ~first]], axis=1), axis=0) if many.any() else np.zeros((0, 2), np.int64)
    return keys[first], hubs, keys[many], ids[many], links[:, 0], links[:, 1]


_PACK = "bucket long, done boolean, keys binary, ids binary, hubs binary, members binary"
_NAMES = ["bucket", "done", "keys", "ids", "hubs", "members"]


def _packed(bucket: int, done: bool, keys: np.ndarray, ids: np.ndarray, hubs: np.ndarray, members: np.ndarray) -> tuple:
    return (bucket, done, *(x.tobytes() for x in (keys, ids, hubs, members)))


def bucket_rows(docs: DataFrame, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """Packed rows: for each run of documents and bucket the keys with their hubs (done false), and what was settled within the run: the
    rows of its shared keys and its links (done true, in any bucket)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            keys, ids = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            keys, hubs, shared, at, a, b = _reduce(keys, ids)
            bucket = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, hubs, bucket = keys[order], hubs[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            rows = [_packed(int(bucket[x]), False, keys[x:y], hubs[x:y], none, none) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            if len(a):
                rows.append(_packed(int(keys[0] % np.uint64(buckets)), True, shared, at, a, b))
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), *[pa.array(c, pa.binary()) for c in columns[2:]]], _NAMES)

        size = 0
        for _, sets in text_sets(batches, width):
            for s in sets:
                if len(s):
                    keys = sketch_keys(s, num, den)
                    kept.append((keys, np.full(len(keys), digest(s)[0], np.int64)))
                    size += len(keys)
            if size >= RUN_KEYS:
                yield flush()
                size = 0
        if kept:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, _PACK)


def bucket_links(packed: DataFrame) -> DataFrame:
    """(kind, x, y): kind 0 is a candidate link of hub x and member y, kind 1 says that class y stands under the shared key x."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's rows come in Arrow batches; all are needed to see which keys are shared."""
        keys, ids = [], []
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for batch in batches:
            done = batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                k, at, a, b = (np.frombuffer(batch.column(c)[i].as_buffer() or b"", np.int64) for c in range(2, 6))
                if done[i]:
                    out += [(0, a, b), (1, k, at)]
                else:
                    keys.append(k), ids.append(at)
        if keys:
            _, _, shared, at, a, b = _reduce(np.concatenate(keys).view(np.uint64), np.concatenate(ids))
            out += [(0, a, b), (1, shared.view(np.int64), at)]
        for kind, x, y in out:
            for at in range(0, len(x), 100_000):
                x1, y1 = x[at : at + 100_000], y[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x1), kind, np.int32)), pa.array(x1), pa.array(y1)], ["kind", "x", "y"])

    return packed.groupBy("bucket").applyInArrow(run, "kind int, x long, y long")


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """A short sketch of a set: each shingle toggles one bit, so that two sets' sketches differ in at most as many bits as the sets do in shingles."""
    size = PARITY_WORDS * 64
    bits = np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def renamed(bits: DataFrame, side: str) -> DataFrame:
    """bits with lo as `side` and its other columns marked by it."""
    return bits.withColumnsRenamed({"lo": side, "n": f"{side}_n", **{c: f"{side}_{c}" for c in _PARITY}})


def may_link(a: str, b: str, num: int, den: int) -> Column:
    """Whether sizes and parity bits leave room for a similarity of num/den."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    apart = sum((F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}"))) for c in _PARITY[1:]), F.bit_count(F.col(f"{a}_{_PARITY[0]}").bitwiseXOR(F.col(f"{b}_{_PARITY[0]}"))))
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (apart * (den + num) <= (n + m) * (den - num))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of pairs whose sets have den * intersection >= num * union. sets: (lo, hashes binary, sorted)."""
    left = sets.select(F.col("lo").alias("a"), F.col("hashes").alias("s"))
    right = sets.select(F.col("lo").alias("b"), F.col("hashes").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                s, t = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(den * both >= num * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def overlap(n: str, m: str, num: int, den: int) -> Column:
    """The least number of shingles that linked sets of n and m shingles share."""
    return F.expr(f"({num} * ({n} + {m}) + {num + den - 1}) div {num + den}")


def meetings(keys: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): classes of different parts that meet early enough to link. keys: (lo, part, n, place, shingle), place from 1 in one order of all shingles.

    Sets of n and m shingles that link share overlap(n, m) of them, so that the first one they share stands among the first n + 1 - overlap(n, m) of the
    one and m + 1 - overlap(n, m) of the other. The smaller set's shingles are keyed by its own size; the larger one's by all smaller sizes that still
    may look as far as their place, in bands of sizes."""
    ratio = np.log(max((den / num) ** (1 / SIZE_STEPS), 1.01))
    band = lambda n: F.floor(F.log(n) / float(ratio))
    x = keys.where(F.col("place") <= F.col("n") + 1 - overlap("n", "n", num, den))
    x = x.select("shingle", band("n").alias("band"), F.col("lo").alias("x"), F.col("part").alias("px"), F.col("n").alias("nx"), F.col("place").alias("ix"))
    low, high = F.expr(f"(n * {num} + {den - 1}) div {den}"), F.least("n", F.expr(f"(n + 1 - place) * {num + den} div {num} - n"))
    y = keys.withColumns({"low": low, "high": high}).where("low <= high")
    y = y.select("shingle", F.explode(F.sequence(band("low"), band("high"))).alias("band"), F.col("lo").alias("y"), F.col("part").alias("py"), F.col("n").alias("ny"), F.col("place").alias("iy"))
    both = overlap("nx", "ny", num, den)
    fits = (F.col("px") != F.col("py")) & F.expr("nx < ny or nx = ny and x < y") & (F.col("ix") <= F.col("nx") + 1 - both) & (F.col("iy") <= F.col("ny") + 1 - both)
    return x.join(y, ["shingle", "band"]).where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


_MASK = np.uint64(SLOTS - 1)


def _hashes(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(batch.schema.get_field_index("hashes"))]


def tallies(held: DataFrame) -> DataFrame:
    """(block, counts binary): how many sets of held (hashes) are counted by each of BLOCK counters, a row for each task and block at most, whatever
    number of sets the task has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            found = _hashes(batch)
            if found:
                counts += np.bincount((np.concatenate(found) & _MASK).astype(np.int64), minlength=SLOTS)
        blocks = counts.reshape(-1, BLOCK)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([blocks[i].tobytes() for i in at], pa.binary())], ["block", "counts"])

    return held.mapInArrow(run, "block long, counts binary")


def counters(tallied: DataFrame) -> np.ndarray:
    """The sum of all tasks' tables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(BLOCK, np.int64)
        for batch in batches:
            for x in batch.column(1):
                total += np.frombuffer(x.as_buffer(), np.int64)
            block = batch.column(0)[:1] if batch.num_rows else block
        yield pa.RecordBatch.from_arrays([block, pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

    table = np.zeros((SLOTS // BLOCK, BLOCK), np.int64)
    for r in tallied.groupBy("block").applyInArrow(run, "block long, counts binary").collect():  # a row for each block: 2 MB in all
        table[r.block] = np.frombuffer(r.counts, np.int64)
    return table.ravel()


def rare_pairs(sets: DataFrame, classes: DataFrame, num: int, den: int, label: str) -> DataFrame:
    """(a, b): pairs of classes (lo, part, open) of different parts that may link, from their sets (lo, n, hashes); pairs with a sketch key besides the
    open ones need not be among them. Classes with fewer open keys than any link of theirs has go: most have come by one word of a common passage.
    Shingles are in the order of how many classes hold them, as far as a table of SLOTS counters tells, rarest first: what many texts share, such as a
    template, then comes too late to be a key, and few classes meet under one. A shingle whose counter says one class keeps its place and is no key."""
    slot = F.pmod(F.xxhash64("lo"), F.lit(SLOTS))
    slots = classes.select(slot.alias("slot")).distinct()  # SLOTS rows at most: few other sets come with those asked for, while these are few
    some = sets.select("lo", "n", "hashes").join(F.broadcast(slots), slot == F.col("slot"), "left_semi")

    def linkable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [n >= least_shared(np.frombuffer(x.as_buffer(), np.uint64), num, den) for n, x in zip(batch.column(4).to_pylist(), batch.column(3), strict=True)]
            yield batch.select(["lo", "part", "n", "hashes"]).filter(pa.array(fits, pa.bool_()))

    wanted = some.join(classes, "lo").select("lo", "part", "n", "hashes", "open")
    held = settle(wanted.mapInArrow(linkable, "lo long, part long, n long, hashes binary"), f"{label}-held")
    shared = sets.sparkSession.sparkContext.broadcast(counters(tallies(held)))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by = shared.value
        for batch in batches:
            taken, places = [], []
            for s in _hashes(batch):
                held = held_by[(s & _MASK).astype(np.int64)]
                order = np.lexsort((s, held))[: len(s) + 1 - -(-num * len(s) // den)]
                place = np.flatnonzero(held[order] > 1)
                taken.append(s[order[place]])
                places.append(place + 1)
            at = np.repeat(np.arange(batch.num_rows), [len(x) for x in taken])
            shingles = np.concatenate(taken) if taken else np.zeros(0, np.uint64)
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            for i in range(0, len(at), 100_000):
                rows = pa.array(at[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in range(3)], pa.array(place[i : i + 100_000]), pa.array(shingles[i : i + 100_000].view(np.int64))], ["lo", "part", "n", "place", "shingle"])

    keys = settle(held.mapInArrow(rarest, "lo long, part long, n long, place long, shingle long"), f"{label}-rare")
    early = F.min(F.col("place") - (F.col("n") + 1 - overlap("n", "n", num, den))).alias("early")  # over 0: no set looks so far for one of its own size
    open_keys = keys.groupBy("shingle").agg(F.min("part").alias("least"), F.max("part").alias("most"), early).where("least <> most and early <= 0").select("shingle")
    return meetings(settle(keys.join(open_keys, "shingle"), f"{label}-keys"), num, den)


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, label: str = "jaccard") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: documents link when the Jaccard similarity of their sets of width-word shingles is at
    least num/den; component_id is the smallest doc_id that links reach.

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer than width words has its whole sequence as one shingle; a
    null text or one without words has an empty set and links with nothing. Rows with a null doc_id get a null component. Rows that repeat
    a doc_id are judged each and share nothing but the id. Columns other than doc_id and text are ignored.
    """
    if not 0 < num <= den:
        raise ValueError("num / den must lie over 0 and be 1 at most")
    docs = docs.select("doc_id", "text")
    work = scratch(label)
    made = settle(sets_of(docs, width), f"{label}-sets")
    classes = settle(made.where("n > 0 and doc_id is not null").groupBy("lo", "hi", "n").agg(F.min("doc_id").alias("rep")), f"{work}/classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    bands = 1 + np.log(den / num) / np.log(BAND)
    per_shingle = bands * 2 * BAND * (den - num) / (den + num) + 0.02
    buckets = max(1, round(total * per_shingle * 16 / BUCKET_BYTES))
    buckets = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = settle(bucket_links(bucket_rows(docs, width, num, den, buckets)), f"{work}/candidates")
    first = settle(found.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"{work}/first")
    touched = first.select(F.col("a").alias("lo")).union(first.select("b")).distinct()
    wanted = settle(touched.join(classes, "lo").select("lo", "rep"), f"{work}/wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A repeated doc_id may bring another text, or the same one again: neither gives a row."""
        seen: set[int] = set()
        for part, sets in text_sets(batches, width):
            lo = part.column(1).to_pylist()
            fits = [x not in seen and digest(s)[0] == x and not seen.add(x) for x, s in zip(lo, sets, strict=True)]
            rows = [(x, s) for x, s, fit in zip(lo, sets, fits, strict=True) if fit]
            bits = np.stack([parity_bits(s) for _, s in rows]) if rows else np.zeros((0, PARITY_WORDS), np.int64)
            columns = [pa.array([x for x, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int64()), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(PARITY_WORDS)], pa.array([s.tobytes() for _, s in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lo", "n", *_PARITY, "hashes"])

    texts = docs.join(wanted.hint("merge"), docs.doc_id == wanted.rep).select("text", "lo")  # one plan at every size
    sets = settle(texts.mapInArrow(run, f"lo long, n long, {', '.join(f'{c} long' for c in _PARITY)}, hashes binary"), f"{work}/hashes")
    bits = sets.drop("hashes")
    near = first.join(renamed(bits, "a"), "a").join(renamed(bits, "b"), "b").where(may_link("a", "b", num, den)).select("a", "b")
    links = settle(verified(settle(near, f"{work}/near"), sets, num, den), f"{work}/links")
    parts = connected(links, f"{work}/one")
    shared = found.where("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("lo"))
    tried = first
    for final in (False, True):
        under = shared.join(parts, shared.lo == parts.id, "left").select("key", "lo", F.coalesce("component", "lo").alias("part")).distinct()
        under = settle(under, f"{work}/under")
        counted = under.groupBy("key", "part").agg(F.count("*").alias("m"), F.min_by("lo", F.xxhash64("key", "lo")).alias("pick"))
        counted = counted.groupBy("key").agg(F.max(F.struct("m", "part", "pick")).alias("most"), F.count("*").alias("parts"), F.sum("m").alias("size"))
        open_keys = settle(counted.where("parts > 1").select("key", F.col("most.part").alias("main"), F.col("most.pick").alias("pick"), "size"), f"{work}/open")
        if open_keys.isEmpty():
            break
        rest = under.join(open_keys, "key")
        if not final:
            # under each key one member of the largest component, another one for every key, stands for it
            pairs = rest.where("part <> main").select(F.least("lo", "pick").alias("a"), F.greatest("lo", "pick").alias("b")).distinct()
        else:
            pairs = rare_pairs(sets, settle(rest.where(F.col("size") > SMALL).groupBy("lo", "part").agg(F.count("*").alias("open")), f"{work}/rest"), num, den, f"{work}/rare")
        pairs = pairs.join(renamed(bits, "a"), "a").join(renamed(bits, "b"), "b").where(may_link("a", "b", num, den)).select("a", "b")
        if final:
            few = settle(rest.where(F.col("size") <= SMALL).select("key", "lo", "part", "main").join(bits, "lo"), f"{work}/few")
            odd = renamed(few.where("part <> main").withColumnRenamed("key", "k"), "u").withColumnRenamed("part", "pu")
            other = renamed(few.drop("main"), "v").withColumnRenamed("part", "pv")
            near = odd.join(other, (F.col("k") == F.col("key")) & F.expr("pu <> pv and (pv = main or u < v)") & may_link("u", "v", num, den))
            pairs = pairs.union(near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).distinct()
        new = settle(pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), f"{work}/new")
        more = settle(verified(new, sets, num, den), f"{work}/more")
        if not more.isEmpty():
            parts = connected(more.union(parts.select(F.col("id").alias("a"), F.col("component").alias("b"))), f"{work}/two")
        tried = tried.union(new)
    named = settle(classes.join(parts, classes.lo == parts.id, "left").select("lo", "hi", F.col("n").alias("m"), "rep", F.coalesce("component", "lo").alias("part")), f"{work}/named")
    least = settle(named.groupBy("part").agg(F.min("rep").alias("component")), f"{work}/least")
    reps = settle(named.join(least, "part").select("lo", "hi", "m", "component"), f"{label}-reps")
    discard(docs.sparkSession, work)  # what is returned reads made and reps only
    same = (made.lo == reps.lo) & (made.hi == reps.hi) & (made.n == reps.m)
    return made.join(reps, same, "left").select(made.doc_id, made.n.alias("n_shingles"), F.when(made.doc_id.isNotNull(), F.coalesce("component", made.doc_id)).alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, label: str = "jaccard") -> DataFrame:
    """The rows of docs whose doc_id is their component's smallest (of rows that repeat an id, all); rows with a null id stay."""
    parts, (name,) = jaccard_components(docs, width, num, den, label), unused(docs, "skein_gone")
    gone = parts.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
