"""Model launches, version folding, stories of one event, merges and leads: hand-made cases and plain loops over random ones."""

import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from skein.functions import leads as L
from skein.functions import models as M
from skein.operators import duplicates, folding

c = F.col


def test_spellings_of_one_model_share_a_key(spark):
    same = [
        [("Aster-V2.3-Lite", "Aster AI"), ("V2.3 Lite", "Aster"), ("Aster V2.3 Lite", "ASTER Labs, Inc."), ("V2.3‑Lite", "aster")],
        [("Breeze 3", "Google DeepMind"), ("breeze-3.gguf", "Google"), ("Breeze 3-GGUF Q4", "DeepMind")],
        [("Comet 7", "Maker")], [("Comet 7 Pro", "Maker")],
    ]
    rows = [(i, n, lab) for i, group in enumerate(same) for n, lab in group]
    got = spark.createDataFrame(rows, "i int, n string, lab string").select("i", M.model_key(c("n"), c("lab")).alias("k")).collect()
    keys = {}
    for r in got:
        keys.setdefault(r.i, set()).add(r.k)
    assert all(len(x) == 1 for x in keys.values()) and len(set.union(*keys.values())) == 4


@pytest.mark.parametrize(("name", "lab", "kind", "headline", "want"), [
    ("Aster-V4.1-Flash", "Aster", "open_weights", "Aster releases V4.1-Flash with long context", True),
    ("Fugue Max", "Sonata AI", "", "Sonata AI releases Fugue Max and Fugue Ultra", True),
    ("Fugue Max", "Sonata AI", "", "Sonata AI explains Fugue Max", False),
    ("SWE-2", "Cogito", " Consumer ", "Cogito's SWE-2 is here", True),
    ("Comet Tale 5", "Maker", "api", "Maker: Comet used by hackers", False),
    ("Comet 5.6 Sun, Comet 6 Star", "Maker", "open_weights", "Comet 5.6 Sun and Comet 6 Star compared", False),
    ("Comet 6", "Maker", "api", "Comet 6 vs. Aster: which one", False),
    ("scTrans", "Maker", "research", "Maker launches scTrans", False),
    ("GLARE", "arXiv", "api", "New GLARE model launched", False),
    ("i-Fold", "research team of Liu et al.", "api", "i-Fold released", False),
    ("Mask", "unknown", "api", "Mask released", False), (None, "Maker", "api", "released", False), ("Mask", "Maker", "api", None, False),
])
def test_launches_and_mentions(spark, name, lab, kind, headline, want):
    row = spark.createDataFrame([(name, lab, kind, headline)], "n string, l string, k string, h string")
    assert row.select(M.is_release(c("n"), c("l"), c("k"), c("h")).alias("x")).first().x is want


def brute_fold(rows):
    rows = {k: [n, d, 1] for k, n, d in rows}
    for short in sorted(rows, key=lambda k: (len(k), k)):
        name, lab = short.split("|")
        longer = [k for k in sorted(rows, key=lambda k: (len(k), k)) if k != short and k.endswith("|" + lab) and k.startswith(name) and re.fullmatch(r"v?[0-9][0-9.]*", k.split("|")[0][len(name):] or "x")]
        if name and longer:
            into = rows[longer[0]]
            into[0] += rows[short][0]
            into[2] += rows[short][2]
            if (rows[short][1] or "") < (into[1] or "~"):
                into[1] = rows[short][1]
            del rows[short]
    return {k: tuple(v) for k, v in rows.items()}


def test_versions_fold_into_the_longest(spark):
    rnd = random.Random(4)
    keys = {f"{n}{v}|{lab}" for n in ("muse", "muses", "wind", "") for v in ("", "3", "32", "v3", "v3.1", "3v2", "x") for lab in ("a", "b")} - {"|a"}
    for rows in ([(k, rnd.randint(1, 9), rnd.choice([None, "2024-01-01", "2024-02-01", "2024-03-01"])) for k in sorted(keys)], [("breeze3|g", 2, "2024-09-08"), ("breeze|g", 1, "2024-09-10"), ("muse|m", 1, "2024-09-11"), ("musespark|m", 1, "2024-09-08")], []):
        got = folding.fold_versions(spark.createDataFrame(rows, "key string, sources long, first_at string"), "test").collect()
        assert {r.key: (r.sources, r.first_at, r.folded) for r in got} == brute_fold(rows)


def test_takeovers(spark):
    new, now = ({k: c(f"{p}_{k}") for k in ("news", "importance", "primary")} for p in ("a", "b"))
    cases = [((True, 1, False), (False, 9, True), True), ((False, 9, True), (True, 1, False), False), ((True, 5, True), (True, 5, False), True), ((True, 4, True), (True, 5, False), False),
             ((True, 6, False), (True, 5, False), False), ((True, 7, False), (True, 5, True), True), ((False, 5, True), (False, 5, False), False), ((True, None, True), (True, None, False), True)]
    rows = spark.createDataFrame([(*a, *b) for a, b, _ in cases], "a_news boolean, a_importance int, a_primary boolean, b_news boolean, b_importance int, b_primary boolean")
    assert [r.x for r in rows.select(L.better_lead(new, now).alias("x")).collect()] == [want for _, _, want in cases]
    heads = [("Is this so?", True), ("Why it fell", True), ("The price fell, I think", True), ("A.I. firm raises money", False), ("It's my turn", True), ("", False), (None, False), ("Showing results", False)]
    got = spark.createDataFrame(heads, "h string, want boolean").select("want", L.opinion_headline(c("h")).alias("x")).collect()
    assert all(r.want == r.x for r in got)


def brute_events(stories, least, days=7):
    stop, facts = set(L.HEADLINE_STOP), {}
    for i, headline, names, at, v, topic in stories:
        said = [w for w in re.sub("[^a-z0-9]+", " ", (headline or "").lower()).split() if w not in stop]
        facts[i] = (said, {re.sub("[^a-z0-9]+", " ", n.lower()).strip() for n in names or []} - {""}, at.timestamp(), v, topic, " ".join(sorted(said)) if len(said) >= 3 else f"#{i}")
    groups = {}
    for i, f in facts.items():
        groups.setdefault((f[5], f[2] // (days * 86400)), []).append((f[2], i))
    reps = {min(g)[1] for g in groups.values()}
    sure, maybe = set(), set()
    for (kind, span), g in groups.items():
        sure |= {tuple(sorted((min(g)[1], i))) for _, i in g if i != min(g)[1]}
        after = groups.get((kind, span + 1))
        if after and min(after)[0] - max(g)[0] <= days * 86400:
            sure.add(tuple(sorted((max(g)[1], min(after)[1]))))
    for a, b in itertools.combinations(sorted(reps), 2):
        x, y = facts[a], facts[b]
        if abs(x[2] - y[2]) > days * 86400 or x[5] == y[5]:
            continue
        shared, p, q = x[1] & y[1], set(x[0]), set(y[0])
        alike = len(p & q) / len(p | q) if p | q else 0
        one = x[4] is not None and x[4] == y[4]
        if x[3] is None or y[3] is None:
            if shared and alike >= 0.6:
                sure.add((a, b))
            continue
        sim = round(sum(m * n for m, n in zip(x[3], y[3], strict=True)), 6)
        if sim >= least and (len(shared) >= 2 or len(shared) == 1 and alike >= 0.4) or one and sim >= least + 0.05:
            sure.add((a, b))
        elif one and sim >= least - 0.06 and shared:
            maybe.add((a, b))
    return sure, maybe


@pytest.mark.parametrize("seed", [1, 2])
def test_events_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    words, people = [f"w{i}" for i in range(30)], [f"Name {i}" for i in range(25)]
    start = dt.datetime(2024, 1, 1)
    base = [[rnd.choice(words) for _ in range(rnd.randint(2, 7))] for _ in range(12)]
    rows = []
    for i in range(150):
        head = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            head[rnd.randrange(len(head))] = rnd.choice(words)
        rnd.shuffle(head)
        angle = [rnd.gauss(0, 1) for _ in range(3)]
        norm = sum(x * x for x in angle) ** 0.5
        names = rnd.sample(people[: rnd.choice([3, 25])], rnd.randint(0, 3))
        rows.append((i, " ".join(head), names if i % 17 else None, start + dt.timedelta(hours=rnd.randrange(24 * 40)), [x / norm for x in angle] if i % 7 else None, rnd.choice(["a", "b", None])))
    rows += [(900 + i, "one same headline here", [], start + dt.timedelta(days=i), None, None) for i in range(20)] + [(990, None, None, start, None, None)]
    got = duplicates.same_event(spark.createDataFrame(rows, "story_id long, headline string, names array<string>, at timestamp, v array<double>, topic string"), 0.8, f"t{seed}").collect()
    sure, maybe = brute_events(rows, 0.8)
    assert len({(r.a, r.b) for r in got}) == len(got)
    assert {(r.a, r.b) for r in got if r.merge} == sure and {(r.a, r.b) for r in got if not r.merge} == maybe
    assert all(r.reason for r in got)


def test_merges_and_what_they_leave(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    stories = spark.createDataFrame([(1, day(3), 2), (2, day(1), 2), (3, day(2), 70), (4, day(4), 9), (5, day(5), 1)], "story_id long, at timestamp, n long")
    pairs = spark.createDataFrame([(1, 2, 0.9, "x"), (2, 3, 0.8, "y"), (1, 3, 0.7, "z"), (3, 4, 0.6, "u"), (4, 5, None, "v"), (1, 4, 0.5, "w")], "a long, b long, sim double, reason string")
    got = [tuple(r) for r in duplicates.merges(pairs, stories, "test").orderBy("step").collect()]
    assert got == [(1, 4, 5, 4, 5, 1.0, "v"), (2, 1, 2, 2, 1, 0.9, "x"), (3, 2, 3, 2, 3, 0.8, "y")]  # 74 members and 10 more would be too many
    assert [r.step for r in duplicates.merges(pairs, stories, "test", most=1).collect()] == [1]
    assert duplicates.merges(pairs.limit(0), stories, "test").count() == 0
    members = [(10, 1, "Why it fell", "news", 9, False, True, day(3)), (11, 2, "Bank buys maker", "news", 4, False, True, day(1)), (12, 3, "Bank to buy maker soon", "news", 4, True, True, day(2)),
               (13, 3, "Maker bought", "news", 9, True, False, day(2)), (14, 4, "Else", "opinion", 3, False, True, day(4)), (15, 5, None, None, None, False, True, day(5)), (16, 6, "Alone", "news", 1, False, False, day(6))]
    rows = spark.createDataFrame(members, "id long, story_id long, headline string, kind string, importance int, primary boolean, shown boolean, at timestamp")
    done = {r.story_id: (r.redirect_to, r.lead, r.n, r.first_at, r.importance) for r in duplicates.merged_stories(rows, duplicates.merges(pairs, stories, "test"), "test").collect()}
    gone = (None, None, None, None)
    assert done == {1: (2, *gone), 3: (2, *gone), 5: (4, *gone), 2: (None, 12, 4, day(1), 9), 4: (None, 15, 2, day(4), 3), 6: (None, None, 1, day(6), 1)}
