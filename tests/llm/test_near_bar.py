"""The Jaccard join's pairs of copies that just miss the bar, and the bounds that keep them few."""

import random

import numpy as np

from skein.llm import jaccard
from tests.llm.test_words import DOCS, brute_components


def copies(rnd, n, words=150, most=5):
    base = [f"w{i}" for i in range(words)]
    for _ in range(n):
        copy = list(base)
        for at in rnd.sample(range(words), rnd.randrange(most + 1)):
            copy[at] = f"n{rnd.randrange(10**9)}"
        yield " ".join(copy)


def test_copies_below_the_bar_hardly_meet(spark, monkeypatch):
    """With three or four words changed copies are below the bar of each other: they are compared with few, and no link is lost."""
    asked, found = [], jaccard.rare_pairs

    def counted(*args):
        pairs = found(*args)
        asked.append((args[1].count(), pairs.count()))
        return pairs

    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "rare_pairs", counted)
    rows = list(enumerate(copies(random.Random(3), 240)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), 4, 85, 100).collect()}
    assert got == brute_components(rows, 4, 85, 100)
    assert len(asked) == 1 and asked[0][0] > 60 and asked[0][1] < 5 * asked[0][0]


def test_all_links_meet_early(spark):
    """Sets that link, of equal and other sizes, meet in meetings, for any ratio."""
    rnd = np.random.default_rng(2)
    for num, den in ((85, 100), (4, 5), (1, 2), (1, 1)):
        sets = []
        for _ in range(25):
            base = rnd.choice(500, rnd.integers(3, 60), replace=False)
            sets += [np.unique(np.where(rnd.random(len(base)) < 0.08, rnd.integers(500, 3000, len(base)), base)[: rnd.integers(max(1, len(base) * 7 // 10), len(base) + 1)]) for _ in range(3)]
        held = np.bincount(np.concatenate(sets), minlength=3000)
        rows = [(i, i, len(s), k + 1, int(x)) for i, s in enumerate(sets) for k, x in enumerate(s[np.lexsort((s, held[s]))][: len(s) + 1 - -(-num * len(s) // den)])]
        got = {(r.a, r.b) for r in jaccard.meetings(spark.createDataFrame(rows, "lo long, part long, n long, place long, shingle long"), num, den).collect()}
        both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if den * both(i, j) >= num * (len(sets[i]) + len(sets[j]) - both(i, j))}
        assert want <= got and (want or num == den)


def test_links_share_at_least_so_many_keys():
    rnd = np.random.default_rng(4)
    most = 0
    for num, den in ((85, 100), (4, 5), (1, 2)):
        for _ in range(300):
            one = np.unique(rnd.integers(0, (1 << 64) - 1, rnd.integers(1, 400), dtype=np.uint64))
            apart = rnd.integers(0, 2 * len(one) * (den - num) // (den + num) + 1)
            gone = rnd.integers(0, min(apart, len(one) - 1) + 1)
            two = np.unique(np.concatenate([rnd.permutation(one)[gone:], rnd.integers(0, (1 << 64) - 1, apart - gone, dtype=np.uint64)]))
            both = len(np.intersect1d(one, two))
            if den * both >= num * (len(one) + len(two) - both):
                shared = len(np.intersect1d(jaccard.sketch_keys(one, num, den), jaccard.sketch_keys(two, num, den)))
                least = max(jaccard.least_shared(one, num, den), jaccard.least_shared(two, num, den))
                assert shared >= least
                most = max(most, least)
    assert most > 3
