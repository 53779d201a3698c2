"""Lexical search, phrase mining and secret scans against plain loops over whole tables and small cases."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from skein.llm import phrases, queries, search, secrets
from tests.test_queries import TABLES, sorted_rows

DOCS = "doc_id long, text string, lang string"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", ["op12_phrase_collocations", "op13_lexical_search"])
def test_whole_table_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in want.description]
    got = queries.queries()[name](spark, sf)
    rows = got.collect()
    assert rows and sorted_rows(got.columns, rows) == sorted_rows(names, want.fetchall())


# -- search -----------------------------------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(docs, items, top):
    said = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    said = [(i, c) for i, c in said if c]
    n_docs, n_terms = len(said), sum(sum(c.values()) for _, c in said)
    df = Counter(t for _, c in said for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(TERM.findall((text or "").translate(UPPER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in said:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def search_case(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Äpfel", "naïve", "42"]
    pick = lambda n: rnd.choice([" ", "-", "\n"]).join(rnd.choice(vocabulary[: rnd.choice([5, 60, 303])]) for _ in range(n))
    docs = [(i, pick(rnd.choice([0, 1, 3, 40, 400]))) for i in range(240)]
    docs += [(1000 + i, "same words here w7") for i in range(70)] + [(2000, None), (2001, " .;"), (2002, "w1 " * 30_000), (None, "w1 w2 w3"), (5, "w9 again w9"), (5, "w9 again w9")]
    items = [(i, pick(rnd.choice([1, 6, 40]))) for i in range(30)] + [(90, "same words"), (91, None), (92, "absent"), (None, "w1"), (93, "w1"), (93, "w2")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_search_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(search, "QUERY_TERMS", 200)  # several blocks of queries
    docs, items = search_case(seed)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(5)
    got = search.search(df, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"), 50, "test")
    assert sorted(tuple(r) for r in got.collect()) == brute_search(docs, items, 50)
    assert dict(got.dtypes)["rank"] == "int"


def test_search_of_nothing(spark):
    none, docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search.search(docs, none, 50, "test").count() == 0
    assert search.search(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string"), 50, "test").count() == 0


def test_signatures_never_fall_short():
    """The bound of a block is at least every exact score, whatever the filter's errors, and far from it for few documents only."""
    rnd = np.random.default_rng(3)
    words = rnd.integers(1, 2**63, 500).astype(np.uint64)
    docs = [np.unique(rnd.choice(words, rnd.integers(1, 200)), return_counts=True) for _ in range(100)]
    rows = [(i, int(t.astype(np.int64)), int(rnd.integers(0, 9000))) for i in range(5) for t in np.unique(rnd.choice(words, 30))]
    q = search.Queries(rows, 100, sum(int(tf.sum()) for _, tf in docs))
    bounds = q.bounds(4096, np.array([tf.sum() for _, tf in docs]), search.sliced(docs, 4096))
    exact = np.array([[q.score(i, *d) for d in docs] for i in range(5)])
    assert (bounds >= exact).all() and (bounds == exact).mean() > 0.5


# -- phrases ----------------------------------------------------------------------------------------------------------------------------


def brute_phrases(docs, least, first, cover=(80, 100)):
    counts, totals = {}, Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in often.items() for n in range(2, len(p)) for i in range(len(p) - n + 1) if cover[1] * a >= cover[0] * f[q := p[i : i + n]]}
        rows = []
        for p, a in often.items():
            if p not in inside:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, text.decode(), -a, l, x, totals[lang], -s) for r, (s, a, text, l, x) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def phrase_case(seed):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgé" for b in "aeio"]
    fixed = [[rnd.choice(words) for _ in range(rnd.randint(2, 6))] for _ in range(12)]
    docs = []
    for i in range(220):
        said = []
        for _ in range(rnd.randint(0, 30)):
            said += rnd.choice(fixed) if rnd.random() < 0.5 else [rnd.choice(words[: rnd.choice([4, 24])])]
            if rnd.random() < 0.2:
                said[-1] += rnd.choice(".,;:!?\n\x0b")
        docs.append((i, rnd.choice([" ", "\t", "  "]).join(said).upper() if i % 9 == 0 else " ".join(said), rnd.choice(["en", "de", None])))
    return [*docs, (900, None, "en"), (901, "", None), (902, "x y " * 5000, "en"), (903, "x y", "fr"), *[(904, "same again twice", "de")] * 40]


@pytest.mark.parametrize(("seed", "least", "first"), [(1, 5, 10), (2, 3, 40), (3, 2, 3), (4, 5, 5000)])
def test_phrases_against_brute_force(spark, seed, least, first, monkeypatch):
    """Small limits make several rounds, several blocks of keys and many runs."""
    monkeypatch.setattr(phrases, "GROW", 1)
    monkeypatch.setattr(phrases, "KEYS", 64)
    monkeypatch.setattr(phrases, "RUN_WORDS", 2000)
    docs = phrase_case(seed)
    got = phrases.collocations(spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", rank int").repartition(4), least, first, label="test")
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(docs, least, first)


def test_phrases_of_nothing_and_large_counts(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    big = spark.createDataFrame([(7 * 10**17, 3 * 10**17, 9 * 10**17)], "a long, l long, r long")
    from pyspark.sql import functions as F

    assert big.select(phrases.score("a", F.col("l") + F.col("r"))).first()[0] == 2_000_000 * 7 * 10**17 // (12 * 10**17)


# -- secrets ----------------------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)


def brute_base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]


def check_base(rows, texts):
    for r in rows:
        want = brute_base(texts[r.doc_id] or "")
        said = [x for x in r.spans.split(",") if x]
        assert [x for x in said if not x.startswith("model:")] == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex, r.n_model] == [sum(x.startswith(k) for x in said) for k in secrets.KINDS]
        assert len(r.chances) == r.n_model


def test_secret_patterns_of_the_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.queries()["op11_secret_scans"](spark, sf).collect()
    assert len(rows) == len(texts)
    check_base(rows, texts)


def test_secret_patterns_in_odd_texts(spark):
    key = "AKIA" + "Q7" * 8
    odd = [None, "", "é" * 50 + f" {key} ÄÖ token: 'abcdefgh1' " + "0" * 31, "password=token=abcdefghij", "PassWord \" : x", 'API_KEY"  =  "0123456789abcdef0123456789abcdef"', "apikey:short",
           "ſecret=abcdefgh1", "toKen=abcdefgh1", f"{key}{key} " + "f" * 33 + "g" + "a" * 32, "x " * 200_000 + "secret=" + "ab1" * 40_000, "AKIA", "token=abcdefg token=abcdefgh"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(2, odd[2]), (None, odd[2])]
    got = secrets.scan_secrets(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string"), "test").collect()
    assert len(got) == len(rows)
    check_base([r for r in got if r.doc_id is not None], dict(enumerate(odd)))
    assert secrets.scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def secret_texts(seed, n):
    """Prose with assigned secrets, access keys, hexadecimal digits, and things with digits that aren't secrets."""
    rnd = random.Random(seed)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = lambda k, c=chars: "".join(rnd.choice(c) for _ in range(k))
    for _ in range(n):
        prose = [" ".join(rnd.choice(["the", "value", "of", "plain", "words", "here"]) for _ in range(8)) for _ in range(4)]
        secret = rnd.choice([f"token = {some(24)}", f'password="{some(18)}"', "AKIA" + some(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), some(40, "0123456789abcdef")])
        plain = rnd.choice([f"mail{rnd.randint(1, 99)}.example.com", f"192.168.{rnd.randint(10, 99)}.{rnd.randint(10, 99)}", f"page-{rnd.randint(1000, 9999)}-of-2000", "4" + some(15, "0123456789")])
        yield f"{prose[0]} {secret} {prose[1]} {plain} {prose[2]}"


def test_network_learns_and_keeps_recall(spark):
    """On texts it hasn't seen: thresholds keep the findings, plain values stay out, and values that no pattern knows are found."""
    texts = list(secret_texts(1, 900))
    network = secrets.fitted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test")
    fresh = "".join(f"{t}\n" for t in secret_texts(2, 300)).encode()
    c = secrets.Chunk(np.frombuffer(fresh, np.uint8), np.array([0, len(fresh)]))
    passed = network.chance(c.windows) >= network.least[secrets.shape(c.windows)]
    found = c.found[c.of]
    assert passed[found].mean() >= 0.9 and passed[~found].mean() <= 0.02
    rnd = random.Random(5)
    values = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24)) for _ in range(8)]
    rows = [(i, f"we keep {v} for the printer") for i, v in enumerate(values)] + [(100, "mail77.example.com and page-1234-of-2000")]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)] + rows, "doc_id long, text string"), "test").collect()}
    hit = [got[i].spans == f"model:8:{8 + len(v)}" for i, v in enumerate(values)]
    assert sum(hit) >= 6 and got[100].n_model == 0
    assert all(0 <= p <= 1 for r in got.values() for p in r.chances)


def test_gradients_are_those_of_the_loss():
    rnd = np.random.default_rng(1)
    network = secrets.Network()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    windows, labels = rnd.integers(0, secrets._CODES, (6, secrets._SIZE)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0.0])

    def loss():
        x = network._forward(windows)[0]
        return float(np.mean(np.logaddexp(0, x) - labels * x))

    for k, g in network._gradients(windows, labels).items():
        flat, slope = network.p[k].reshape(-1), np.asarray(g).reshape(-1)
        for i in np.argsort(-abs(slope))[:5]:
            was = flat[i]
            flat[i] = was + 1e-5
            high = loss()
            flat[i] = was - 1e-5
            low = loss()
            flat[i] = was
            assert abs((high - low) / 2e-5 - slope[i]) < 1e-4
