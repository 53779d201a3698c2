"""Online clusters against a plain loop, over one run and over several."""

import datetime as dt
import random

import numpy as np
import pytest

from skein.operators import clusters

START = dt.datetime(2024, 1, 1)
ROWS = "id long, topic string, at timestamp, v array<double>, news boolean, importance int, primary boolean"


def scan(rows, least, hours, shown, total, slack=0.03):
    out, stories = {}, []
    for i, topic, at, v, news, importance, primary in sorted(rows, key=lambda r: (r[2] or START, r[0])):
        if topic is None or at is None or v is None:
            out[i] = (i, "published")
            continue
        v = np.array(v) / np.linalg.norm(v)
        best, top = None, -2.0
        for s in stories:
            if s["topic"] == topic and (at - s["at"]).total_seconds() <= hours * 3600 and s["total"] < total and s["mean"] @ v >= least and s["lead"] @ v >= least - slack and min(s["mean"] @ v, s["lead"] @ v) > top:
                best, top = s, min(s["mean"] @ v, s["lead"] @ v)
        if best is None:
            stories.append({"id": i, "topic": topic, "at": at, "mean": v, "lead": v, "shown": 1, "total": 1, "news": news, "importance": importance or 5, "primary": primary, "who": i})
            out[i] = (i, "published")
            continue
        best["total"] += 1
        if best["shown"] >= shown:
            out[i] = (best["id"], "overflow")
            continue
        mean = (best["mean"] * best["shown"] + v) / (best["shown"] + 1)
        best["mean"], best["shown"] = mean / np.linalg.norm(mean), best["shown"] + 1
        gain = (importance or 0) - best["importance"]
        if news and not best["news"] or news == best["news"] and gain >= (0 if news and primary and not best["primary"] else 2):
            best.update(lead=v, news=news, importance=importance or 0, primary=primary, who=i)
        out[i] = (best["id"], "published")
    return out, {s["id"]: s["who"] for s in stories}


def case(seed, n=160):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = []
    for i in range(n):
        v = [x + rnd.gauss(0, 0.35) for x in rnd.choice(centres)]
        rows.append((i, rnd.choice("ab"), START + dt.timedelta(hours=rnd.randrange(300)), v, rnd.random() < 0.7, rnd.choice([None, *range(1, 10)]), rnd.random() < 0.3))
    return [*rows, (900, None, START, [1.0] * 6, True, 5, False), (901, "a", None, [1.0] * 6, True, 5, False), (902, "a", START, None, True, 5, False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_one_after_the_other_equal_one_run(spark, seed):
    rows = case(seed)
    want, leads = scan(rows, 0.8, 72, 4, 6)
    assert any(status == "overflow" for _, status in want.values()) and any(k != who for k, who in leads.items())
    df = spark.createDataFrame(rows, ROWS)
    whole, last = clusters.place(df, None, 0.8, "whole", shown=4, total=6)
    assert {r.id: (r.cluster, r.status) for r in whole.collect()} == want
    got, state = {}, None
    for i, (low, high) in enumerate([(0, 90), (90, 95), (95, 240), (240, 999)]):
        part = [r for r in rows if low <= (((r[2] or START) - START).total_seconds() / 3600) < high]
        placed, state = clusters.place(spark.createDataFrame(part, ROWS), state, 0.8, f"part{i}", shown=4, total=6)
        got |= {r.id: (r.cluster, r.status) for r in placed.collect()}
    assert got == want
    same = lambda x: {r.cluster: (r.lead, r.shown, r.total) for r in x.collect()}
    assert same(state) == same(last) and all(leads[k] == v[0] for k, v in same(last).items())


def test_a_better_article_takes_the_lead_over(spark):
    """Commentary leads until news comes; what is near the old lead alone then begins a story of its own."""
    rows = [(1, "a", START, [1.0, 0.0], False, 9, True), (2, "a", START + dt.timedelta(hours=1), [0.9, 0.4359], True, 1, False), (3, "a", START + dt.timedelta(hours=2), [0.95, -0.3122], True, 1, False)]
    placed, state = clusters.place(spark.createDataFrame(rows, ROWS), None, 0.8, "lead")
    assert {r.id: r.cluster for r in placed.collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.cluster: r.lead for r in state.collect()} == {1: 2, 3: 3}


def test_no_articles(spark):
    placed, state = clusters.place(spark.createDataFrame([], ROWS), None, 0.8, "none")
    assert placed.count() == 0 and state.count() == 0
