"""Operators whose result depends on row order: greedy clustering, deal folding, anchored grouping, ridge regression."""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.similarity import near_pairs
from skein.shared import settle


def greedy_clusters(vectors: DataFrame, block: str, key: str, vector: str, least: float, lead_slack: float = 0.03, shown: int = 40, total: int = 80) -> DataFrame:
    """(block, key, cluster): in key order, each vector joins the cluster whose mean is nearest, if the mean is at `least` and the lead vector
    at least - lead_slack or nearer; else it leads a new one. Only a cluster's first `shown` members move its mean; it takes `total` at most.
    Blocks are independent; a block is one task's work, so blocks must be bounded (a label and a stretch of time). A row without a vector or with a
    null in it has a null cluster."""
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        v = np.stack(pdf[vector].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        sums, leads, lengths, sizes = np.zeros_like(v), np.zeros_like(v), np.ones(len(v)), np.zeros(len(v), int)
        names, out = [], []
        for x, name in zip(v, pdf[key], strict=True):
            n = len(names)
            near = sums[:n] @ x / lengths[:n]
            near[(leads[:n] @ x < least - lead_slack) | (near < least) | (sizes[:n] >= total)] = -2
            best = int(near.argmax()) if n and near.max() > -2 else n
            if best == n:
                leads[n] = x
                names.append(name)
            if sizes[best] < shown:
                sums[best] += x
                lengths[best] = max(np.linalg.norm(sums[best]), 1e-12)
            sizes[best] += 1
            out.append(names[best])
        return pd.DataFrame({block: pdf[block].to_numpy(), key: pdf[key].to_numpy(), "cluster": out})

    kinds = dict(vectors.dtypes)
    unplaced = vectors.where(~F.coalesce(whole, F.lit(False))).select(block, key, F.lit(None).cast(kinds[key]).alias("cluster"))
    return unplaced.unionByName(vectors.where(whole).select(block, key, vector).groupBy(block).applyInPandas(run, f"{block} {kinds[block]}, {key} {kinds[key]}, cluster {kinds[key]}"))


def in_order(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows by key, a key's rows one after the other: what a task streams through with one key's state, however many rows the key has."""
    return rows.repartition(key).sortWithinPartitions(key, *order)


def fold_deals(deals: DataFrame, tolerance: float = 0.25, days: int = 30) -> DataFrame:
    """(deal_id, fold): in date order, a company's deal folds into the newest fold of an amount within tolerance and no more than `days` days
    older than it; else it starts one, named by its deal_id. A deal without an amount or a day is a fold of its own. Sorted partitions are streamed;
    the state is a company's folds of the last `days` days."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        company, folds = None, deque()
        for pdf in batches:
            out = []
            for name, deal, amount, day in zip(pdf["company"], pdf["deal_id"], pdf["amount"], pdf["n"], strict=True):
                if name != company:
                    company = name
                    folds.clear()
                while folds and day - folds[0][2] > days:
                    folds.popleft()
                hit = next((f for f in reversed(folds) if abs(f[1] - amount) <= tolerance * max(f[1], amount)), None)
                if hit is None:
                    folds.append(hit := (deal, amount, day))
                out.append(hit[0])
            yield pd.DataFrame({"deal_id": pdf["deal_id"], "fold": out})

    known = "amount IS NOT NULL AND day IS NOT NULL"
    dated = deals.where(known).select("company", "deal_id", "amount", F.unix_date("day").alias("n"))
    alone = deals.where(f"NOT ({known})").select("deal_id", F.col("deal_id").alias("fold"))
    return in_order(dated, "company", "n", "deal_id").mapInPandas(run, "deal_id long, fold long").unionByName(alone)


def anchored_groups(rows: DataFrame, key: str, at: str, order: str, minutes: float) -> DataFrame:
    """rows' key, order and first_at: a group starts with the first row `minutes` or more after the start of the group before it, so its
    length counts from its first row and not from the row before. Sorted partitions are streamed; the state is one anchor."""
    kinds = dict(rows.dtypes)
    sorted_rows = rows.select(key, order, F.unix_micros(F.col(at).cast("timestamp")).alias("t")).repartition(key).sortWithinPartitions(key, "t", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, anchor = None, 0
        for pdf in batches:
            first = np.empty(len(pdf), np.int64)
            for i, (k, t) in enumerate(zip(pdf[key], pdf["t"], strict=True)):
                if k != current or t - anchor >= minutes * 60e6:
                    current, anchor = k, t
                first[i] = anchor
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "first_us": first})

    return sorted_rows.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, first_us long")


def ridge(rows: DataFrame, features: dict[str, Column], target: Column, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and mean of a ridge regression on a centred target without intercept. The normal equations are sums that Spark makes; the
    driver solves a system as large as the number of features."""
    named = rows.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(features.values())], target.cast("double").alias("y"))
    k = len(features)
    mean = named.agg(F.avg("y")).first()[0] or 0.0
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    row = named.agg(*products, *[F.sum(F.col(f"x{i}") * (F.col("y") - mean)).alias(f"q{i}") for i in range(k)]).first()
    a = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return np.linalg.solve(a + penalty * np.eye(k), np.array([row[f"q{i}"] or 0.0 for i in range(k)])), float(mean)


def predict(rows: DataFrame, features: dict[str, Column], weights: np.ndarray, mean: float, name: str = "predicted") -> DataFrame:
    """rows with the prediction, clamped to [0, 1]."""
    linear = F.lit(mean)
    for w, c in zip(weights, features.values(), strict=True):
        linear = linear + F.lit(float(w)) * c.cast("double")
    return rows.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), linear)))


def first_kept_of_all(prints: DataFrame, key: str, at: str, label: str, most: int = 10, seconds: int = 7 * 86400) -> DataFrame:
    """(key, duplicate_of): in order of at (in seconds) and key, a 64-bit fingerprint within `most` bits of one that was kept in the `seconds`
    before it is a duplicate of the earliest such; else it is kept. Any two rows may meet.

    Rounds of joins. Equal fingerprints are one kind; the first of its open rows is its head. A head waits for near kinds with an earlier head, but
    for single rows that are too old; one that waits for nobody is kept and settles the rows of all near kinds that follow it in time.
    Where a head waits for one row only, it is kept if that row isn't: such waits are chains, which pointer doubling follows to their end, so that
    a long chain takes as many steps as its length has bits. Rows are only counted and compared by kind; no group is one task's work."""
    prints = settle(prints.select(key, "h", F.col(at).alias("t")), f"{label}-prints")
    kinds = settle(prints.groupBy("h").agg(F.min(key).alias("k")), f"{label}-kinds")
    times = settle(prints.groupBy("h", "t").agg(F.min(key).alias("first")).join(kinds, "h").select("k", "t", "first"), f"{label}-times")
    pairs = settle(near_pairs(kinds, "k", most).select("a", "b"), f"{label}-near")
    near = settle(pairs.union(pairs.select("b", "a")).toDF("u", "v"), f"{label}-both")
    reach = near.unionByName(kinds.select(F.col("k").alias("u"), F.col("k").alias("v")))

    rows, edges, kept = times, near, []
    while True:
        heads = rows.groupBy("k").agg(F.min(F.struct("t", "first")).alias("head"), F.count("*").alias("n"))
        heads = settle(heads, f"{label}-heads")
        if heads.isEmpty():
            break
        mine = heads.select(F.col("k").alias("u"), F.col("head").alias("hu"))
        theirs = heads.select(F.col("k").alias("v"), F.col("head").alias("hv"), F.col("n").alias("nv"))
        edges = settle(edges.select("u", "v").join(mine, "u").join(theirs, "v"), f"{label}-edges")
        in_time = F.col("hu.t") - F.col("hv.t") <= seconds
        waits = edges.where((F.col("hv") < F.col("hu")) & (in_time | (F.col("nv") > 1)))
        waits = waits.groupBy("u").agg(F.count("*").alias("m"), F.max("v").alias("v"), F.max(in_time & (F.col("nv") == 1)).alias("simple"))
        waits = settle(waits, f"{label}-waits")
        free = settle(heads.join(waits.select(F.col("u").alias("k")), "k", "left_anti").select("k", "head"), f"{label}-free")
        links = settle(waits.where("m = 1 and simple").select("u", "v", F.lit(1).alias("turns")), f"{label}-links")
        while True:
            on = links.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("turns").alias("more"))
            if links.join(on, "v", "left_semi").isEmpty():
                break
            links = links.join(on, "v", "left").select("u", F.coalesce("w", "v").alias("v"), ((F.col("turns") + F.coalesce("more", F.lit(0))) % 2).alias("turns"))
            links = settle(links, f"{label}-links")
        even = links.where("turns % 2 = 0").join(free.select(F.col("k").alias("v")), "v", "left_semi").select(F.col("u").alias("k"))
        now = settle(free.union(heads.join(even, "k").select("k", "head")).select("k", "head.t", "head.first"), f"{label}-kept")
        kept.append(now)
        told = reach.join(now.select(F.col("k").alias("u"), F.col("t").alias("since"), F.col("first").alias("kept")), "u").withColumnRenamed("v", "x")
        after = (F.col("t") - F.col("since") <= seconds) & (F.struct("since", "kept") <= F.struct("t", "first"))
        rows = settle(rows.join(told, (F.col("k") == F.col("x")) & after, "left_anti"), f"{label}-rows")
    if not kept:
        return prints.select(key, F.lit(None).cast(dict(prints.dtypes)[key]).alias("duplicate_of"))
    every = settle(functools.reduce(DataFrame.union, kept), f"{label}-every")
    span = F.floor(F.col("t") / seconds)
    told = reach.join(every.withColumnsRenamed({"k": "u", "first": "kept"}), "u").select(F.col("v").alias("k"), F.col("t").alias("since"), "kept", F.explode(F.array(span, span + 1)).alias("span"))
    hit = times.withColumn("span", span).join(told, ["k", "span"]).where((F.col("t") - F.col("since") <= seconds) & (F.struct("since", "kept") <= F.struct("t", "first")))
    first = hit.groupBy("k", "t").agg(F.min(F.struct("since", "kept"))["kept"].alias("kept"))
    named = prints.join(kinds, "h").join(first, ["k", "t"])
    return named.select(key, F.when(F.col("kept") != F.col(key), F.col("kept")).alias("duplicate_of"))


def merge_forest(pairs: DataFrame, block: str, most_merges: int = 10, most_size: int = 80) -> DataFrame:
    """(block, a, b, root): of a block's pairs (a, b, sim), in order of falling similarity, those that merge two trees, as long as no tree
    outgrows most_size and no more than most_merges in all; root is the smaller of the trees' roots."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(back=-pdf["sim"]).sort_values(["back", "a", "b"])
        parent: dict[int, int] = {}
        size: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        out = []
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            p, q = sorted((root(a), root(b)))
            if len(out) < most_merges and p != q and size.get(p, 1) + size.get(q, 1) <= most_size:
                parent[q] = p
                size[p] = size.get(p, 1) + size.get(q, 1)
                out.append((a, b, p))
        return pd.DataFrame({block: [pdf[block].iloc[0]] * len(out), "a": [x[0] for x in out], "b": [x[1] for x in out], "root": [x[2] for x in out]})

    kinds = dict(pairs.dtypes)
    return pairs.select(block, "a", "b", "sim").groupBy(block).applyInPandas(run, f"{block} {kinds[block]}, a {kinds['a']}, b {kinds['b']}, root {kinds['a']}")


def majority_amounts(deals: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """(company, amount, n): each company's largest cluster of amounts. In date order an amount joins the first cluster whose first amount is
    within tolerance; of clusters of one size the earliest wins. amount is the cluster's first. Sorted partitions are streamed; the state is one
    company's clusters, whose first amounts differ by the tolerance at least."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        company, clusters = None, []

        def best() -> tuple:
            return (company, *max(clusters, key=lambda x: x[1]))

        for pdf in batches:
            out = []
            for name, amount in zip(pdf["company"], pdf["amount"], strict=True):
                if name != company:
                    if clusters:
                        out.append(best())
                    company, clusters = name, []
                hit = next((x for x in clusters if abs(x[0] - amount) <= tolerance * max(x[0], amount)), None)
                if hit:
                    hit[1] += 1
                else:
                    clusters.append([amount, 1])
            yield pd.DataFrame(out, columns=["company", "amount", "n"])
        if clusters:
            yield pd.DataFrame([best()], columns=["company", "amount", "n"])

    return in_order(deals.where("amount IS NOT NULL").select("company", "deal_id", "amount", "day"), "company", "day", "deal_id").mapInPandas(run, "company string, amount double, n long")


def assign_threads(stories: DataFrame, block: str, near: float, near_named: float, most: int = 10) -> DataFrame:
    """(block, story_id, thread): in order of story_id, a story joins the thread with the nearest latest episode, if they share a name and
    are at `near`, or at near_named with a specific name shared; at most `most` episodes. The latest episode's vector is the one known
    when the thread began its run: it isn't refreshed. stories: names and specific are arrays of names, v the vector. Stories without names or a
    vector are threads of their own."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("story_id")
        place = {x: i for i, x in enumerate(sorted({x for row in pdf["names"] for x in row} | {x for row in pdf["specific"] for x in row}))}
        n = len(pdf)
        v = np.stack(pdf["v"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        latest, sizes = np.zeros_like(v), np.zeros(n, int)
        known, special = np.zeros((n, len(place)), bool), np.zeros((n, len(place)), bool)
        ids, out = [], []
        for story, names, specific, x in zip(pdf["story_id"], pdf["names"], pdf["specific"], v, strict=True):
            own, rare = [place[k] for k in names], [place[k] for k in specific]
            k = len(ids)
            sim = latest[:k] @ x
            fits = known[:k][:, own].any(axis=1) & ((sim >= near) | (sim >= near_named) & special[:k][:, rare].any(axis=1)) & (sizes[:k] < most)
            sim[~fits] = -2
            best = int(sim.argmax()) if k and sim.max() > -2 else k
            if best == k:
                ids.append(story)
                latest[k] = x
            known[best, own] = True
            special[best, rare] = True
            sizes[best] += 1
            out.append(ids[best])
        return pd.DataFrame({block: pdf[block].to_numpy(), "story_id": pdf["story_id"].to_numpy(), "thread": out})

    kinds = dict(stories.dtypes)
    whole = F.coalesce(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & F.col("names").isNotNull() & F.col("specific").isNotNull(), F.lit(False))
    alone = stories.where(~whole).select(block, "story_id", F.col("story_id").alias("thread"))
    return alone.unionByName(stories.where(whole).select(block, "story_id", "names", "specific", "v").groupBy(block).applyInPandas(run, f"{block} {kinds[block]}, story_id long, thread long"))
