"""Language identification by interpolated Kneser-Ney character models, one a language, held in sorted code arrays.

A text's letters are lower-cased, every run of other characters is one space. A model gives the probability of a character after the three
before it; the language with the lowest cross-entropy a character wins. Each language's rejection limit is calibrated on labelled rows that
its model has not seen. Models are fitted on a sample of the labelled rows: `sample` distinct texts a language, chosen by a hash of the text, so
that the models' size is bounded whatever the corpus and its copies; texts are used whole, in fitting and in prediction. A language of less than
twice as many is fitted on all its texts, and calibrated by models of either half on the other half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import release, thrifty
from skein.shared import settle

#: Texts a language to fit on, and as many to calibrate on; languages a corpus may have; character outcomes of the last, uniform back-off.
SAMPLE, MAX_LANGUAGES, OUTCOMES = 500, 1_000, 4096
#: A text is rejected only with so many characters, over SLACK times the calibration texts' QUANTILE of cross-entropy.
LEAST_CHARACTERS, QUANTILE, SLACK = 20, 0.99, 1.6
UNKNOWN = "und"
_PAD, _SPACE = 1, 32
_MEMO_BITS = 17
_tables: dict[str, np.ndarray] = {}


def character_ids() -> np.ndarray:
    """A 16-bit id of each code point: letters their lower case (those beyond 16 bits share ids of the private-use area), else a space."""
    if "ids" not in _tables:
        ids = np.full(0x110000, _SPACE, np.uint16)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                x = ord(low) if len(low) == 1 else cp
                ids[cp] = x if x < 0x10000 else 0xE000 + (x & 0xFFF)
        ids[_PAD] = _PAD
        _tables["ids"] = ids
    return _tables["ids"]


def four_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all windows of four characters in the texts, padded by one before and two after; first and one-past-last window of each text;
    letters of each. A code is four 16-bit ids, the last lowest."""
    joined = "".join([f"\x01{x}\x01\x01" for x in (t.replace("\x01", " ") for t in texts)])
    ids = character_ids()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(t) + 3 for t in texts])
    space = ids == _SPACE
    letters = np.concatenate([[0], np.cumsum(~space & (ids != _PAD))])
    letters = letters[ends] - letters[np.concatenate([[0], ends[:-1]])]
    keep = np.ones(len(ids), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    ends = np.concatenate([[0], np.cumsum(keep)])[ends]
    u = ids[keep].astype(np.uint64)
    codes = u[:-3] << np.uint64(48) | u[1:-2] << np.uint64(32) | u[2:-1] << np.uint64(16) | u[3:]
    return codes, np.concatenate([[0], ends[:-1]]), ends - 3, letters


@dataclass
class Model:
    """For each order from 4 down to 1: sorted codes with their log2 probabilities, sorted contexts with their log2 back-off weights."""

    codes: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: float

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log2 probability of each code's last character after its first three."""
        out = np.zeros(len(codes))
        todo = np.arange(len(codes))
        left = codes
        for order in range(4):
            keys = self.codes[order]
            at = np.minimum(np.searchsorted(keys, left), len(keys) - 1)
            hit = keys[at] == left
            out[todo[hit]] += self.logs[order][at[hit]]
            todo, left = todo[~hit], left[~hit]
            if not len(todo):
                return out
            context = left >> np.uint64(16)
            at = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
            hit = self.contexts[order][at] == context
            out[todo[hit]] += self.weights[order][at[hit]]
            left = left & np.uint64((1 << 16 * (3 - order)) - 1) if order < 3 else left
        out[todo] += self.floor
        return out


def kneser_ney(codes: np.ndarray, counts: np.ndarray) -> Model:
    """A model from distinct 4-gram codes and their counts; lower orders count the distinct characters before a gram."""
    levels = []
    for order in range(4, 0, -1):
        levels.append((codes, counts))
        codes, counts = np.unique(codes & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)
    lower_codes, lower_p = None, None
    made: list[tuple] = []
    for order in range(1, 5):
        codes, counts = levels[4 - order]
        by = np.argsort(codes)
        codes, counts = codes[by], counts[by].astype(float)
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        contexts, group = np.unique(codes >> np.uint64(16), return_inverse=True)
        total, kinds = np.bincount(group, counts), np.bincount(group)
        weight = discount * kinds / total
        if lower_codes is None:
            below = np.full(len(codes), 1 / OUTCOMES)
        else:
            below = lower_p[np.searchsorted(lower_codes, codes & np.uint64((1 << 16 * (order - 1)) - 1))]
        p = np.maximum(counts - discount, 0) / total[group] + weight[group] * below
        made.append((codes, np.log2(p), contexts, np.log2(weight)))
        lower_codes, lower_p = codes, p
    made.reverse()
    return Model(*[[x[i] for x in made] for i in range(4)], floor=-np.log2(OUTCOMES))


class Scorer:
    """Log probabilities by all models, behind a direct-mapped memory of recent codes."""

    def __init__(self, models: list[Model]):
        self.models = models
        self.codes = np.zeros(1 << _MEMO_BITS, np.uint64)
        self.values = np.zeros((1 << _MEMO_BITS, len(models)), np.float32)

    def _made(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([m.score(codes) for m in self.models], axis=1).astype(np.float32)

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a character of each text by each model, characters and letters of each text."""
        codes, first, end, letters = four_grams(texts)
        with np.errstate(over="ignore"):
            slot = (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
        values = self.values[slot]
        miss = np.flatnonzero(self.codes[slot] != codes)
        if len(miss):
            new, back = np.unique(codes[miss], return_inverse=True)
            made = self._made(new)
            values[miss] = made[back]
            self.codes[slot[miss]], self.values[slot[miss]] = codes[miss], made[back]
        bounds = np.empty(2 * len(texts), np.int64)
        bounds[::2], bounds[1::2] = first, end
        values = np.concatenate([values, np.zeros((1, values.shape[1]), np.float32)])
        sums = np.add.reduceat(values, bounds, axis=0, dtype=np.float64)[::2]
        n = end - first
        return -sums / n[:, None], n, letters


def _runs(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    texts = [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= limit):
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def predict(docs: DataFrame, languages: list[str], models: list[Model], limits: list[float]) -> DataFrame:
    """docs with lang_pred, score, bits (cross-entropy) and accepted, replacing columns of these names. Narrow: no shuffle. Ties: the first
    language in order of name. Null texts and those without a letter are `und` with score 0 and not accepted."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, models, limits))
    kept = docs.drop("lang_pred", "score", "bits", "accepted")
    names = [*kept.columns, "lang_pred", "score", "bits", "accepted"]
    schema = kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "bits": F.lit(None).cast("double"), "accepted": F.lit(True)}).schema
    state: dict[str, Scorer] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        languages, models, limits = shared.value
        scorer = state.setdefault("scorer", Scorer(models)) if models else None
        for batch in batches:
            for at, texts in _runs(batch, "text"):
                if scorer:
                    bits, n, letters = scorer.cross_entropies(texts)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(texts)), best]
                    odds = np.exp2((least[:, None] - bits) * np.minimum(n, 40)[:, None])
                    score = 1 / odds.sum(axis=1)
                    fine = (n < LEAST_CHARACTERS) | (least <= np.array(limits)[best])
                    known = letters > 0
                else:
                    best, known = np.zeros(len(texts), int), np.zeros(len(texts), bool)
                    least, score, fine = np.zeros(len(texts)), np.zeros(len(texts)), known
                out = [
                    pa.array([languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
                    pa.array(np.where(known, score, 0.0)), pa.array(least, mask=~known), pa.array(fine & known),
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, *out], names)
        release()

    return kept.mapInArrow(run, schema)


def draw(labelled: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """(text, lang, n, fold): at most 2 * sample distinct texts of each language, those of the smallest hashes among a share of all that counts
    (about how many there are) makes large enough; n is how many it got. Fold 1 of a full sample is for calibration; else folds are halves."""
    want = 1.25 * (2 * sample + 6 * (2 * sample) ** 0.5 + 20)
    rates = F.create_map(*[x for k in sorted(counts) for x in (F.lit(k), F.lit(want / max(1, counts[k])))])
    h = F.xxhash64("text", F.lit(4))
    share = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    some = labelled.withColumn("h", h).where(share < F.try_element_at(rates, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= 2 * sample)
    counted = ranked.withColumn("n", F.count("*").over(Window.partitionBy("lang")))
    fold = F.when(F.col("n") < 2 * sample, F.col("place") % 2).otherwise((F.col("place") > sample).cast("int"))
    return counted.select("text", "lang", F.col("n").cast("int").alias("n"), fold.cast("int").alias("fold"))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[Model], list[float]]:
    """Languages in order of name, their models and rejection limits, from (text, lang) rows; rows with a null in either are left out. Every
    language with a text that isn't empty gets a model; one with a single distinct text has no limit."""
    labelled = labelled.select("text", "lang").where("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text", F.lit(4)))).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return [], [], []
    languages = sorted(counts)
    drawn = settle(draw(labelled, counts, sample), "langid")
    full = F.col("n") >= 2 * sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _runs(batch, "text"):
                part = list(zip(*(batch.column(i).slice(at, len(texts)).to_pylist() for i in (1, 2)), strict=True))
                for k in sorted(set(part)):
                    own = [x for x, y in zip(texts, part, strict=True) if y == k]
                    codes, first, end, _ = four_grams(own)
                    inside = np.zeros(len(codes) + 1, np.int64)
                    inside[first] += 1
                    np.subtract.at(inside, end, 1)
                    found, n = np.unique(codes[np.cumsum(inside[:-1]) > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k[0]] * len(found), pa.string()), pa.array([k[1]] * len(found), pa.int32()), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "fold", "code", "n"])

    fitting = drawn.where(~full | (F.col("fold") == 0)).select("text", "lang", "fold")
    got = fitting.mapInArrow(run, "lang string, fold int, code long, n long").groupBy("lang", "fold", "code").agg(F.sum("n").alias("n")).toPandas()
    made = lambda g: kneser_ney(g.index.to_numpy(np.int64).view(np.uint64), g.to_numpy())
    found = {k: g for k, g in got.groupby("lang")}
    languages = [k for k in languages if k in found]
    if not languages:
        return [], [], []
    whole = {k: made(g.groupby("code")["n"].sum()) for k, g in found.items()}
    # a half's rows are judged by the other half's models, or by the fitted model where that has seen neither
    judged = None
    for fold in (0, 1):
        models = [made(g[g["fold"] == 1 - fold].set_index("code")["n"].sort_index()) if (g := found[k])["fold"].nunique() > 1 else whole[k] for k in languages]
        checking = drawn.where((F.col("fold") == fold) & (F.col("n") > 1) & (~full | (F.col("fold") == 1)))
        part = predict(checking.drop("n"), languages, models, [np.inf] * len(models)).where("lang_pred = lang").select("lang_pred", "bits")
        judged = part if judged is None else judged.unionByName(part)
    ends = {r[0]: r[1] for r in judged.groupBy("lang_pred").agg(F.percentile_approx("bits", QUANTILE, 10_000)).collect()}
    return languages, [whole[k] for k in languages], [SLACK * ends.get(k, np.inf) for k in languages]


def held_out(docs: DataFrame) -> Column:
    """Rows that no model learns from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, lang_pred, score, bits and accepted. Models learn from the rows that aren't held out and have a lang; predictions
    use the text only. A null doc_id counts as not held out. Repeated rows get the same answer; without labelled rows all are `und`."""
    held = F.coalesce(held_out(docs), F.lit(False))
    languages, models, limits = fit(docs.where(~held), sample)
    return predict(docs.drop("held_out").withColumn("held_out", held), languages, models, limits)
