"""Secret scans: fixed patterns, and a character convolutional network over every candidate that these miss.

A candidate is a maximal run of the characters of values, of 8 characters or more with a digit among them, or of 20 or more. The network sees a
candidate in windows of 48 characters, the last one flush with its end, each with the 24 bytes before and the 16 bytes after it: an embedding of
characters, one convolution, the greatest response of each filter before, within and after the value, and a logistic unit. A candidate's score is its
windows' highest. It learns from labelled findings: candidates on which a pattern matches are secrets, all others aren't. In half of the windows it
trains on the context is blanked, so that a value has to look like a secret by itself.

Training takes all distinct windows but a quarter, dealt by hash into shards of about SHARD: each epoch every shard trains from the same network, and the
mean of theirs, weighted by windows, begins the next one. Both labels weigh the same. The quarter calibrates, without context, findings by their lower score of without and with: scores become
probabilities at the labels' true shares, and each shape of value has the highest threshold that RECALL of its labelled findings reach both ways. All of its windows
are counted, by steps of 1 / GRID of a logit, so that the driver sees counts of a bounded size. The network has a fixed size, so that it is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import chunks, runs
from skein.shared import settle

#: Fixed values of the patterns: their kinds in order, their least lengths.
KINDS = ["assign", "access", "hex", "model"]
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Distinct windows of a shard, about; epochs; the fewest windows of either label that make a network.
SHARD, EPOCHS, FEWEST = 8192, 8, 16
#: Steps of a logit in counts, and the logits that they end at.
GRID, WIDEST = 64, 40
#: The share of labelled findings that a threshold must keep; findings of a shape that set a threshold of its own.
RECALL, SHAPE_FEWEST = 0.95, 40
BEFORE, VALUE, AFTER = 24, 48, 16
_SIZE, _CODES, _DIM, _SPAN, _FILTERS = BEFORE + VALUE + AFTER, 130, 12, 5, 24

_VALUE, _HEX, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_VALUE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_HEX[[*b"0123456789abcdef"]] = True
_DIGIT[[*b"0123456789"]] = True
_CODE = np.minimum(np.arange(256), 128).astype(np.uint8) + 1  # 0: outside the text; all that is not ASCII is one


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in bytes, sorted. Matches are leftmost and don't overlap within a kind; too short ones are dropped."""
    low, out = text.lower(), []
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    return out


class Chunk:
    """A chunk's patterns' matches by row and its candidates with windows and labels."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        whole = data.tobytes()
        self.base = [base_spans(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        start, end, row = runs(_HEX[data], offsets)
        for i in np.flatnonzero(end - start >= 32):
            at = offsets[row[i]]
            self.base[row[i]].append((int(start[i] - at), 2, int(end[i] - at)))
        start, end, row = runs(_VALUE[data], offsets)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        long = end - start
        some = (long >= 20) | (long >= 8) & (digits[end] > digits[start])
        self.start, self.end, self.row = start[some], end[some], row[some]
        covered = np.zeros(len(data) + 1, np.int32)
        for r, spans in enumerate(self.base):
            spans.sort()
            for a, _, b in spans:
                covered[offsets[r] + a] += 1
                covered[offsets[r] + b] -= 1
        covered = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
        self.found = covered[self.end] > covered[self.start]
        # windows: which candidate each belongs to, and its characters
        pieces = -(-(self.end - self.start) // VALUE)
        self.of = np.repeat(np.arange(len(pieces)), pieces)
        first = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        a, b = self.start[self.of], self.end[self.of]
        a = np.where(first == 0, a, np.minimum(a + first * VALUE, b - VALUE))
        b = np.minimum(a + VALUE, b)
        at = np.concatenate([a[:, None] + np.arange(-BEFORE, VALUE), b[:, None] + np.arange(AFTER)], axis=1)
        low, high = offsets[self.row[self.of]], offsets[self.row[self.of] + 1]
        inside = (at >= low[:, None]) & (at < high[:, None])
        inside[:, BEFORE : BEFORE + VALUE] &= at[:, BEFORE : BEFORE + VALUE] < b[:, None]
        codes = _CODE[data] if len(data) else np.zeros(1, np.uint8)
        self.windows = np.where(inside, codes[np.clip(at, 0, len(codes) - 1)], 0).astype(np.uint8)


def shape(windows: np.ndarray) -> np.ndarray:
    """0: a value of hexadecimal digits, 1: of capitals and digits, 2: any other."""
    value = windows[:, BEFORE : BEFORE + VALUE].astype(np.int64) - 1
    ok = [np.zeros(256, bool), np.zeros(256, bool)]
    ok[0][[*b"0123456789abcdefABCDEF-"]] = True
    ok[1][[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
    empty = value < 0
    fits = [(x[np.maximum(value, 0)] | empty).all(axis=1) for x in ok]
    return np.where(fits[0], 0, np.where(fits[1], 1, 2))


def blanked(windows: np.ndarray) -> np.ndarray:
    """Windows with nothing before and after the value."""
    out = windows.copy()
    out[:, :BEFORE] = 0
    out[:, BEFORE + VALUE :] = 0
    return out


class Network:
    """The convolutional network, its calibration and its thresholds."""

    def __init__(self, seed: int = 7) -> None:
        rnd = np.random.default_rng(seed)
        wide = _SPAN * _DIM
        self.p = {
            "embed": rnd.normal(0, 0.3, (_CODES, _DIM)), "conv": rnd.normal(0, wide**-0.5, (wide, _FILTERS)), "bias": np.zeros(_FILTERS),
            "out": rnd.normal(0, 0.1, 3 * _FILTERS), "shift": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        self.step = 0.0
        self.slope, self.offset, self.least = 1.0, 0.0, np.full(3, 2.0)
        edge = _SPAN // 2
        self.regions = [slice(0, BEFORE - edge), slice(BEFORE - edge, BEFORE + VALUE - edge), slice(BEFORE + VALUE - edge, _SIZE - _SPAN + 1)]

    def _forward(self, windows: np.ndarray) -> tuple[np.ndarray, tuple]:
        seen = self.p["embed"][windows]
        seen[windows == 0] = 0
        n, steps = len(windows), _SIZE - _SPAN + 1
        wide = np.lib.stride_tricks.as_strided(seen, (n, steps, _SPAN * _DIM), (seen.strides[0], seen.strides[1], seen.strides[2]), writeable=False)
        act = wide.reshape(n * steps, -1) @ self.p["conv"]
        act = act.reshape(n, steps, _FILTERS) + self.p["bias"]
        best = [act[:, r].argmax(axis=1) + (r.start or 0) for r in self.regions]
        tops = np.concatenate([np.take_along_axis(act, b[:, None], axis=1)[:, 0] for b in best], axis=1)
        pooled = np.maximum(tops, 0)
        return pooled @ self.p["out"] + self.p["shift"][0], (seen, best, tops, pooled)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        parts = [self._forward(windows[i : i + 256])[0] for i in range(0, len(windows), 256)]
        return np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)

    def chance(self, windows: np.ndarray) -> np.ndarray:
        """The calibrated probability that each window shows a secret."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(windows) + self.offset, -40, 40)))

    def bins(self, windows: np.ndarray) -> np.ndarray:
        """Logits of windows, in steps of 1 / GRID."""
        return np.clip(np.floor(self.logits(windows) * GRID), -WIDEST * GRID, WIDEST * GRID).astype(np.int64)

    def _gradients(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        logit, (seen, best, tops, pooled) = self._forward(windows)
        n = len(windows)
        d = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels) * weights).astype(np.float32) / n
        g = {"out": pooled.T @ d, "shift": np.array([d.sum()], np.float32)}
        back = d[:, None] * self.p["out"] * (tops > 0)
        g["bias"] = back.reshape(n, 3, _FILTERS).sum(axis=(0, 1))
        # each filter's error goes to the place of its greatest response alone
        at = np.concatenate(best, axis=1)
        place = at[:, :, None] + np.arange(_SPAN)
        codes = windows[np.arange(n)[:, None, None], place]
        there = seen[np.arange(n)[:, None, None], place]
        filters = np.tile(np.arange(_FILTERS), 3)
        g["conv"] = np.zeros((_FILTERS, _SPAN * _DIM), np.float32)
        np.add.at(g["conv"], filters, np.einsum("nf,nfsd->fsd", back, there).reshape(3 * _FILTERS, -1))
        g["conv"] = g["conv"].T
        weights = self.p["conv"].T.reshape(_FILTERS, _SPAN, _DIM)[filters]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], codes.ravel(), (back[:, :, None, None] * weights).reshape(-1, _DIM))
        g["embed"][0] = 0
        return g

    def epoch(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray, rnd: np.random.Generator, batch: int = 64, rate: float = 0.003) -> None:
        """Adam on shuffled batches; half of the windows lose what stands before and after the value."""
        m, v = self.m, self.v
        order = rnd.permutation(len(windows))
        for i in range(0, len(order), batch):
            mine = order[i : i + batch]
            shown = np.where((rnd.random(len(mine)) < 0.5)[:, None], blanked(windows[mine]), windows[mine])
            self.step += 1
            for k, g in self._gradients(shown, labels[mine], weights[mine]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**self.step)) / (np.sqrt(v[k] / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)

    def flat(self) -> np.ndarray:
        """Its parameters, Adam's means and the steps so far."""
        return np.concatenate([x.ravel() for part in (self.p, self.m, self.v) for x in part.values()] + [[self.step]])

    def filled(self, flat: np.ndarray) -> Network:
        """This network with what flat lists."""
        at = 0
        for part in (self.p, self.m, self.v):
            for k, x in part.items():
                part[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
        self.step = float(flat[at])
        return self

    def calibrate(self, labels: np.ndarray, kind: np.ndarray, bins: np.ndarray, counts: np.ndarray, shares: tuple[float, float]) -> None:
        """From counts of windows by label, shape and bin, on values without their context, as the secrets that no pattern knows have another one than labelled findings: fit slope and offset by Newton steps, findings weighted so that labels have their true shares; then the thresholds."""
        x, found = (bins + 0.5) / GRID, labels == 1
        yes, no = counts[found].sum(), counts[~found].sum()
        w = counts * np.where(found, shares[1] / yes, shares[0] / no)
        # targets short of 0 and 1, as separable labels have no finite fit
        y = np.where(found, (yes + 1) / (yes + 2), 1 / (no + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
            g = np.array([(w * (p - y) * x).sum() + 1e-3 * (a - 1), (w * (p - y)).sum()])
            c = w * p * (1 - p)
            h = np.array([[(c * x * x).sum() + 1e-3, (c * x).sum()], [(c * x).sum(), c.sum() + 1e-9]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
        self.slope, self.offset = float(a), float(b)
        at = lambda i: 1 / (1 + np.exp(-np.clip(self.slope * (i / GRID) + self.offset, -40, 40)))
        floor = np.where(bins == -WIDEST * GRID, 0.0, np.minimum(at(bins), at(bins + 1)))
        for k in range(3):
            mine = found & (kind == k)
            if counts[mine].sum() < SHAPE_FEWEST:
                mine = found
            order = np.argsort(floor[mine], kind="stable")
            level, n = floor[mine][order], counts[mine][order]
            # the highest threshold that keeps the share of findings that is asked for, allowing for chance (95 % of the time): misses + 1.64 * sqrt(misses)
            misses = int(((np.sqrt(1.64**2 + 4 * (1 - RECALL) * n.sum()) - 1.64) / 2) ** 2)
            self.least[k] = level[np.flatnonzero(np.cumsum(n) - n <= misses)[-1]]


def labelled(docs: DataFrame) -> DataFrame:
    """(window, found, n): distinct windows of candidates, whether a pattern matches there, and how often they stand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in chunks(batches, "text"):
            c = Chunk(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in c.windows], pa.binary()), pa.array(c.found[c.of])], ["window", "found"])

    return docs.select("text").mapInArrow(run, "window binary, found boolean").groupBy("window", "found").agg(F.count("*").alias("n"))


def _windows(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("window").to_pylist()), np.uint8).reshape(-1, _SIZE)


def averaged(rows: DataFrame, shards: int, network: Network, weights: tuple[float, float], epoch: int) -> Network:
    """The mean of the networks that the shards of rows (window, found, shard) make of this one in an epoch. Sums are of decimals: no order changes them."""
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("window", "ascending"), ("found", "ascending")])
        labels, own = np.array(shard.column("found").to_pylist(), np.float64), Network().filled(network.flat())
        own.epoch(_windows(shard), labels, np.where(labels == 1, weights[1], weights[0]), np.random.default_rng([11, epoch, shard.column("shard")[0].as_py()]))
        flat = own.flat().astype(np.float64)
        return pa.table({"place": pa.array(np.arange(len(flat))), "value": pa.array(flat * len(labels)), "n": pa.array(np.full(len(flat), len(labels)))})

    made = rows.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "place long, value double, n long")
    made = made.groupBy("place").agg((F.sum(F.col("value").cast("decimal(28,16)")).cast("double") / F.sum("n")).alias("value")).collect()  # three rows a parameter
    return Network().filled(np.array([r.value for r in sorted(made)]))


def binned(rows: DataFrame, network: Network, shown: bool = False) -> DataFrame:
    """rows (window, found, shard) with shape and bin, that of the value without its context; where shown, a finding has its lower one of without and with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                windows = _windows(batch)
                bins = network.bins(blanked(windows))
                if shown:
                    found = np.array(batch.column(1).to_pylist(), bool)
                    bins[found] = np.minimum(bins[found], network.bins(windows[found]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shape(windows)), pa.array(bins)], [*batch.schema.names, "shape", "bin"])

    return rows.select("window", "found", "shard").mapInArrow(run, "window binary, found boolean, shard long, shape long, bin long")


def fitted(docs: DataFrame, label: str) -> Network | None:
    """A network fitted and calibrated on all labelled findings of docs; none if either label has fewer than FEWEST. What no pattern matches isn't surely
    no secret: halfway, such windows that look like one count no more."""
    held = F.pmod(F.col("at"), F.lit(4)) == 3
    rows = settle(labelled(docs).withColumn("at", F.xxhash64("window")), f"{label}-labelled")
    told = {r.found: r for r in rows.groupBy("found").agg(F.sum("n").alias("n"), F.count("*").alias("windows"), F.count_if(held).alias("held")).collect()}
    if len(told) < 2 or min(r.windows for r in told.values()) < FEWEST:
        return None
    apart = min(r.held for r in told.values()) >= FEWEST // 4  # else all train and calibrate
    count = [told[found].windows - apart * told[found].held for found in (False, True)]
    weights = (sum(count) / (2 * count[0]), sum(count) / (2 * count[1]))
    shards = max(1, round(sum(count) / SHARD))
    rows = rows.withColumn("shard", F.pmod(F.shiftright("at", 2), F.lit(shards)))
    trained, network = rows.where(~held) if apart else rows, Network()
    trained = trained.select("window", "found", "shard")
    for epoch in range(EPOCHS):
        if epoch == EPOCHS // 2:
            seen = settle(binned(trained, network), f"{label}-seen")
            by_bin = sorted(seen.where("found").groupBy("bin").count().collect())
            low = next(r.bin for r, n in zip(by_bin, np.cumsum([r[1] for r in by_bin]), strict=True) if n >= 0.05 * count[1])
            trained = seen.where(F.col("found") | (F.col("bin") < low)).select("window", "found", "shard")
        network = averaged(trained, shards, network, weights, epoch)
    counted = binned(rows.where(held) if apart else rows, network, shown=True).groupBy("found", "shape", "bin").count().collect()  # 6 * (2 * WIDEST * GRID + 1) rows at most
    total = told[False].n + told[True].n
    network.calibrate(*np.array(sorted(tuple(int(x) for x in r) for r in counted)).T, (told[False].n / total, told[True].n / total))
    return network


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string, chances array<double>"


def scan_secrets(docs: DataFrame, label: str = "secrets") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans, chances) of each row: counts by kind, the digest of the patterns' spans, all spans as
    kind:start:end in code points, end exclusive, by start and then kind, and the probabilities of the model's spans in their order.

    The model's spans are candidates that no pattern touches and that reach their shape's threshold. A null text is empty; repeated rows and rows with a
    null doc_id are judged each; columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, label))
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for part, data, offsets in chunks(batches, "text"):
            c, spans = Chunk(data, offsets), None
            spans = [[(a, kind, b, None) for a, kind, b in row] for row in c.base]
            if network and len(c.of):
                chance, high = network.chance(c.windows), np.zeros(len(c.start))
                passed = chance >= network.least[shape(c.windows)]
                np.maximum.at(high, c.of, np.where(passed, chance, 0))
                for i in np.flatnonzero((high > 0) & ~c.found):
                    at = offsets[c.row[i]]
                    spans[c.row[i]].append((int(c.start[i] - at), 3, int(c.end[i] - at), float(high[i])))
            out = []
            for r, row in enumerate(spans):
                row.sort(key=lambda x: x[:3])
                point = np.concatenate([[0], np.cumsum((data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)]) if row else None
                said = [f"{KINDS[kind]}:{point[a]}:{point[b]}" for a, kind, b, _ in row]
                base = ",".join(x for x, s in zip(said, row, strict=True) if s[1] < 3)
                kinds = [s[1] for s in row]
                out.append((*[kinds.count(k) for k in range(4)], hashlib.sha256(base.encode()).hexdigest(), ",".join(said), [s[3] for s in row if s[1] == 3]))
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]], names)

    return docs.mapInArrow(run, _SCHEMA)
