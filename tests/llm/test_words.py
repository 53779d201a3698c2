"""Jaccard join, repeats, decontamination and language ID against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decontaminate, jaccard, langid, queries, repeats
from skein.llm.common import shingle_hashes, span_hashes, words
from skein.shared import connected

DOCS = "doc_id long, text string"


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, width, num, den):
    sets = {i: shingle_set(t, width) for i, t in rows}
    part = {i: i for i in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                x, y = sorted((root(i), root(j)))
                part[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed=1, groups=12):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([1, 2, 5, 40, 150, 400]))]
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 30))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((len(rows), rnd.choice([" ", "\n", "  "]).join(copy)))
    return rows


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "É é"), (906, "one two three"), (907, "ONE two three"), (908, "x " * 3000), (909, "x " * 3001)]


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 4, 5), (1, 1, 2)])
def test_jaccard(spark, width, num, den):
    rows = near_copies() + ODD
    df = spark.createDataFrame(rows, DOCS).withColumn("n_shingles", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, width, num, den).collect()}
    assert got == brute_components(rows, width, num, den)


@pytest.mark.parametrize(("num", "den", "part", "whole"), [(1, 2, 11, 22), (3, 5, 601, 1000), (1, 4, 25, 100)])
def test_low_ratios_reach_every_band(num, den, part, whole):
    """A subset of exactly the least similarity shares a key with its set, however many size bands lie between."""
    rng = np.random.default_rng(part)
    for _ in range(30):
        large = np.unique(rng.integers(0, 1 << 63, whole, dtype=np.uint64))
        small = np.sort(rng.choice(large, part, replace=False))
        assert len(np.intersect1d(jaccard.sketch_keys(large, num, den), jaccard.sketch_keys(small, num, den)))


def test_jaccard_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_ngram_jaccard_join(spark, sf).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_jaccard_repeated_rows_null_ids_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (2, text + " more"), (None, text), (3, None)]
    got = sorted(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).select("doc_id", "component_id").collect() if r.doc_id is not None)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3)]
    kept = jaccard.keep_one_of_each_group(spark.createDataFrame(rows, DOCS))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "None"]
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_hot_near_copies(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rnd.randrange(5)):
            copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), 4, 85, 100).collect()}
    assert got == brute_components(rows, 4, 85, 100)


@pytest.mark.parametrize("small", [1, 32])
def test_templates_with_different_fillings(spark, monkeypatch, small):
    """Texts of one template whose fillings are too large for a link share sketch words; near copies of some of them must still be found."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    rnd = random.Random(8)
    template = [f"t{i}" for i in range(160)]
    rows = []
    for i in range(60):
        text = template + [f"f{i}x{k}" for k in range(40)]
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            text[rnd.randrange(165, 195)] = "other"
            rows.append((500 + i, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), 4, 85, 100).collect()}
    want = brute_components(rows, 4, 85, 100)
    assert got == want and sum(k != c for k, (_, c) in want.items()) == 20


def test_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"abc def abc", np.uint8)
    h = span_hashes(data, np.array([0, 8, 4]), np.array([3, 11, 7]))
    assert h[0] == h[1] != h[2]
    start, end, hashes, rows = words(data, np.array([0, 5, 11]))
    assert [data[a:b].tobytes() for a, b in zip(start, end, strict=True)] == [b"abc", b"d", b"ef", b"abc"] and rows.tolist() == [0, 0, 1, 1]
    made, row = shingle_hashes(hashes, rows, 2, 3)
    assert len(made) == 2 and row.tolist() == [0, 1]


def test_connected_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in connected(edges, "chain").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# -- repeats ------------------------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def digest(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}


def passages(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcé \n") for _ in range(n))
    shared = [text(rnd.randint(90, 400)) for _ in range(4)]
    rows = [(i, text(rnd.randint(0, 200)) + rnd.choice(shared)[rnd.randint(0, 30) :] + text(rnd.randint(0, 60)) + rnd.choice(shared)) for i in range(40)]
    return rows + [(50, None), (51, ""), (52, "a" * 99), (53, "a" * 100), (54, "a" * 350), (55, "\x00" * 250), (56, "short")]


@pytest.mark.parametrize("segment", [50, 101, 777])
def test_segments_change_no_anchor(monkeypatch, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    data = np.random.default_rng(segment).integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 0, 1200, 1290, 3000])
    windows = lambda runs: {(r, f + k): a for r, f, n, a, _ in zip(*(x.tolist() for x in runs), strict=True) for k in range(n)}
    assert windows(repeats.runs_of(data, offsets, 100, 32)) == windows(repeats.anchored_runs(data, offsets, 100, 32))


@pytest.mark.parametrize(("spread", "hot"), [(256, 64), (3, 1)])
def test_repeats(spark, monkeypatch, spread, hot):
    """The second case deals anchors of two kinds over shards and buckets."""
    monkeypatch.setattr(repeats, "SPREAD", spread)
    monkeypatch.setattr(repeats, "HOT_KINDS", hot)
    rows = passages(spread)
    got = repeats.remove_repeats(spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(1)).withColumn("extra", F.lit(2)))
    assert "extra" in got.columns and digest(got.collect()) == brute_repeats(rows, 100)


def test_repeats_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_array_dedup(spark, sf).collect()}
    assert got == brute_repeats(rows, 100)


def test_repeats_ties_null_ids_and_empty(spark):
    text = "".join(chr(97 + random.Random(i).randrange(26)) for i in range(150))
    rows = [(1, text), (1, text), (None, text), (2, text)]
    got = sorted((str(r.doc_id), r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [("1", 0), ("1", 0), ("2", 150), ("None", 0)]
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_repeats_as_text_cuts_no_character(spark):
    rows = [(1, "é" * 80), (2, "xé" + "é" * 80 + "y")]
    got = {r.doc_id: r.text for r in repeats.remove_repeats(spark.createDataFrame(rows, DOCS), as_text=True).collect()}
    assert all("\ufffd" not in t for t in got.values()) and got[2] == "xy"


def test_suffix_array_and_shared_prefixes():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 3, 60), 0) for _ in range(6)]).astype(np.uint16)
    order, shares = repeats.shares_prefix(text, 7)
    cyclic = np.concatenate([text, text])
    keys = [tuple(cyclic[i : i + 7]) for i in order]
    assert keys == sorted(keys)
    for i in range(1, len(keys)):
        if 0 not in keys[i]:
            assert shares[i] == (keys[i] == keys[i - 1])


# -- decontamination ------------------------------------------------------------------------------------------------------------------------


def fewest_edits(passage, text):
    row = list(range(len(passage) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i in range(1, len(passage) + 1):
            new.append(min(row[i - 1] + (passage[i - 1] != c), row[i] + 1, new[i - 1] + 1))
        row, best = new, min(best, new[-1])
    return best


def leak_cases():
    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    items = [(i, text(rnd.randint(9, 30))) for i in range(12)] + [(90, None), (91, "tiny"), (92, "")]
    docs = []
    for i in range(60):
        item = bytearray(items[rnd.randrange(12)][1].encode())
        for _ in range(rnd.randrange(14)):
            at = rnd.randrange(len(item))
            item[at : at + rnd.randrange(2)] = bytes([rnd.randrange(97, 107)]) * rnd.randrange(2)
        docs.append((i, text(20) + " " + item.decode().upper().replace(" ", "\n  ", 2) + " " + text(5)))
    return items, docs + [(70, None), (71, ""), (72, "   "), (73, text(4000))]


def test_leaks(spark):
    items, docs = leak_cases()
    marked = decontaminate.mark_leaks(spark.createDataFrame(docs, DOCS).withColumn("leaks", F.lit(0)), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: {x.item_id: x.edits for x in r.leaks} for r in marked.collect()}
    for i, t in docs:
        text = decontaminate.fold((t or "").encode())
        for item, p in items:
            passage = decontaminate.fold((p or "").encode()).strip()
            if len(passage) < decontaminate.LEAST_BYTES:
                assert item not in got[i]
                continue
            if i == 73:
                continue
            within = [fewest_edits(x, text) <= decontaminate.budget(len(x)) for x in (passage, *decontaminate.parts(passage))]
            assert (item in got[i]) == any(within), (i, item, within)
            if within[0]:
                assert got[i][item] == fewest_edits(passage, text)


def test_leaks_in_blocks_and_spans(spark):
    items, docs = leak_cases()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    whole = {r.doc_id: r.leaks for r in decontaminate.mark_leaks(d, b).collect()}
    blocks = {r.doc_id: r.leaks for r in decontaminate.mark_leaks(d, b, block_bytes=400).collect()}
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in blocks.items()}
    texts = dict(docs)
    for i, leaks in whole.items():
        for x in leaks:
            if x.edits == 0:
                assert decontaminate.fold(texts[i].encode()[x.start : x.end]) == decontaminate.fold(dict(items)[x.item_id].encode())


def test_leaks_of_empty_tables(spark):
    items, docs = leak_cases()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.drop_contaminated(d, b.limit(0)).count() == len(docs)
    assert decontaminate.drop_contaminated(d.limit(0), b).count() == 0
    same = spark.createDataFrame([(7, items[0][1]), (5, items[0][1])], "item_id long, text string")
    got = decontaminate.mark_leaks(spark.createDataFrame([(1, items[0][1])], DOCS), same).first().leaks
    assert [x.item_id for x in got] == [5]


def test_leak_query(spark, sf):
    docs = {r.doc_id: decontaminate.fold(r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: decontaminate.fold(r.text.encode()).strip() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r.doc_id: set(r.item_ids) for r in queries.op8_decontamination(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        assert {k for k, p in items.items() if len(p) >= decontaminate.LEAST_BYTES and p in t} <= got[i]


# -- language ID ----------------------------------------------------------------------------------------------------------------------------


def test_language_query(spark, sf):
    rows = {r.doc_id: r for r in queries.op4_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in held} == {i for i, r in rows.items() if r.held_out}
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9000, None, "en"), (9001, "", "fr"), (9002, "123 !?", None), (None, "the of and to", None), (9003, "\x01 \u4e2d\u6587 " * 30, None), (9003, "\x01 \u4e2d\u6587 " * 30, None)], docs.schema)
    got = langid.identify(docs.unionByName(odd).withColumn("score", F.lit("clash"))).where("doc_id >= 9000 OR doc_id IS NULL").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and all(by[i].lang_pred == "und" and by[i].score == 0 and not by[i].accepted for i in (9000, 9001, 9002))
    assert by[None].lang_pred == "en" and not by[9003].accepted
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_kneser_ney_sums_to_one():
    codes, first, end, _ = langid.four_grams(["abracadabra abba cab"])
    model = langid.kneser_ney(*np.unique(codes[: end[0]], return_counts=True))
    context = codes[3] >> np.uint64(16) << np.uint64(16)
    known = np.unique(codes & np.uint64(0xFFFF))
    total = np.exp2(model.score(context | known)).sum()
    rest = np.exp2(model.score(np.array([context | np.uint64(0x7777)])))[0] * (langid.OUTCOMES - len(known))
    assert abs(total + rest - 1) < 1e-6


def plain_model(texts):
    """Interpolated Kneser-Ney by dictionaries: (counts of each order, discount of each order)."""
    levels = [Counter(p[i : i + 4] for t in texts for p in [f"\x01{t}\x01\x01"] for i in range(len(t)))]
    for _ in range(3):
        levels.append(Counter(g[1:] for g in levels[-1]))
    discounts = []
    for level in levels:
        ones, twos = sum(n == 1 for n in level.values()), sum(n == 2 for n in level.values())
        discounts.append(ones / (ones + 2 * twos) if ones and twos else 0.5)
    return levels, discounts


def plain_probability(model, gram):
    if not gram:
        return 1 / langid.OUTCOMES
    levels, discounts = model
    level, d = levels[4 - len(gram)], discounts[4 - len(gram)]
    beside = [n for g, n in level.items() if g[:-1] == gram[:-1]]
    below = plain_probability(model, gram[1:])
    return below if not beside else max(level[gram] - d, 0) / sum(beside) + d * len(beside) / sum(beside) * below


def test_language_models_against_dictionaries(spark):
    """Languages, bits a character and scores of small models by the definition."""
    rnd = random.Random(2)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5)))
    labelled = [(" ".join(word(letters) for _ in range(12)), k) for k, letters in (("aa", "abcde"), ("bb", "bcdef"), ("cc", "aeiou")) for _ in range(6)]
    asked = [" ".join(word(letters) for _ in range(9)) for letters in ("abcde", "bcdef", "aeiou", "xyzab") for _ in range(4)] + ["b", "zz zz"]
    languages, models, limits = langid.fit(spark.createDataFrame(labelled, "text string, lang string"))
    plain = {k: plain_model([t for t, x in labelled if x == k]) for k in ("aa", "bb", "cc")}
    got = {r.text: r for r in langid.predict(spark.createDataFrame([(t,) for t in asked], "text string"), languages, models, limits).collect()}
    for t in asked:
        p = f"\x01{t}\x01\x01"
        bits = {k: -sum(np.log2(plain_probability(m, p[i : i + 4])) for i in range(len(t))) / len(t) for k, m in plain.items()}
        best = min(sorted(bits), key=bits.get)
        second = sorted(bits.values())[1]
        if second - bits[best] > 1e-4:
            assert got[t].lang_pred == best
        assert abs(got[t].bits - bits[best]) < 1e-4
        assert abs(got[t].score - 1 / sum(2 ** ((bits[best] - b) * min(len(t), 40)) for b in bits.values())) < 1e-3
