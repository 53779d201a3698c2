"""Online clusters that go on from run to run: articles join the open story that they are nearest to, a better article takes its lead over, and
the open stories are a table that the next run starts from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.leads import LEAD_MARGIN
from skein.operators.ordered import in_order
from skein.operators.similarity import block_pairs
from skein.shared import connected, settle

#: Rows of a topic's stretch of time whose vectors are multiplied by another such block, and pairs of them that a task looks at at once.
BLOCK, PAIRS = 16_000, 4_000_000

STATE = "cluster long, topic string, first_at long, v array<double>, shown int, total int, lead long, lead_v array<double>, news boolean, importance int, primary boolean"
_ROW = f"kind int, t long, id long, status string, {STATE}"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


class Open:
    """The open stories of one component in the order in which they began, as rows of growing arrays; those before `low` are gone."""

    def __init__(self, least: float, lead_least: float, seconds: int, shown: int, total: int) -> None:
        self.least, self.lead_least, self.seconds, self.most_shown, self.most = least, lead_least, seconds, shown, total
        self.all: list[dict | None] = []
        self.low = 0
        self.topics: dict[str, int] = {}
        self.means = self.leads = np.zeros((0, 0))
        self.facts = np.zeros((0, 3), np.int64)  # first_at, total, topic

    @property
    def stories(self) -> list[dict]:
        return self.all[self.low :]

    def add(self, story: dict) -> None:
        n = len(self.all)
        if len(self.facts) <= n:
            kept = slice(self.low, n)
            self.all, self.low, n = self.all[kept], 0, n - self.low
            size = max(16, 2 * n)
            self.means, self.leads, self.facts = (self._grown(x[kept], size, width) for x, width in ((self.means, len(story["v"])), (self.leads, len(story["v"])), (self.facts, 3)))
        self.means[n], self.leads[n] = story["v"], story["lead_v"]
        self.facts[n] = story["first_at"], story["total"], self.topics.setdefault(story["topic"], len(self.topics))
        self.all.append(story)

    @staticmethod
    def _grown(x: np.ndarray, size: int, width: int) -> np.ndarray:
        out = np.zeros((size, width), x.dtype)
        out[: len(x)] = x.reshape(-1, width)
        return out

    def drop_before(self, t: int) -> list[dict]:
        """Take out, from the first on, the stories that no article from t on can join. One that stands behind a younger story goes with it."""
        gone = []
        while self.low < len(self.all) and self.all[self.low]["first_at"] < t - self.seconds:
            gone.append(self.all[self.low])
            self.all[self.low] = None
            self.low += 1
        return gone

    def place(self, a: dict) -> tuple[int, str]:
        """Join the story with the greatest of its lesser likenesses, to mean and lead, the earliest of equal ones; else begin one. A full story takes
        overflow, which moves neither its mean nor its lead; one with all its members takes nothing."""
        now = slice(self.low, len(self.all))
        first_at, total, topic = self.facts[now].T
        fits = (total < self.most) & (topic == self.topics.get(a["topic"], -1)) & (np.abs(a["t"] - first_at) <= self.seconds)
        if not fits.any():
            return self._begin(a)
        to_mean, to_lead = self.means[now] @ a["v"], self.leads[now] @ a["v"]
        near = np.where(fits & (to_mean >= self.least) & (to_lead >= self.lead_least), np.minimum(to_mean, to_lead), -2.0)
        i = self.low + int(near.argmax())
        if near[i - self.low] == -2.0:
            return self._begin(a)
        s = self.all[i]
        s["total"] += 1
        self.facts[i, 1] += 1
        if s["shown"] >= self.most_shown:
            return s["cluster"], "overflow"
        mean = (s["v"] * s["shown"] + a["v"]) / (s["shown"] + 1)
        s["v"] = self.means[i] = mean / (np.linalg.norm(mean) or 1.0)
        s["shown"] += 1
        if self._better(a, s):
            s.update(lead=a["id"], lead_v=a["v"], news=a["news"], importance=a["importance"] or 0, primary=a["primary"])
            self.leads[i] = a["v"]
        return s["cluster"], "published"

    def _begin(self, a: dict) -> tuple[int, str]:
        self.add({"cluster": a["id"], "topic": a["topic"], "first_at": a["t"], "v": a["v"], "shown": 1, "total": 1, "lead": a["id"], "lead_v": a["v"],
                  "news": a["news"], "importance": a["importance"] or 5, "primary": a["primary"]})
        return a["id"], "published"

    @staticmethod
    def _better(a: dict, s: dict) -> bool:
        if a["news"] != s["news"]:
            return a["news"]
        gain = (a["importance"] or 0) - s["importance"]
        return gain >= (0 if a["news"] and a["primary"] and not s["primary"] else LEAD_MARGIN)


def _near(nodes: DataFrame, seconds: int, least: float) -> DataFrame:
    """(a, b): links of nodes (node, topic, t, w) that connect what pairs of one topic, within so many seconds, connect whose vectors are at least `least` alike.

    A task multiplies two blocks of a topic's stretches of that length; of the pairs it finds it gives a link from each node to the first of those that they
    connect it with, so that links are fewer than its nodes, however many pairs are near."""
    span = F.floor(F.col("t") / seconds)
    rows = nodes.select("node", "topic", "t", F.size("w").alias("long"), span.alias("span"), "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, t, long = table["node"].to_numpy(), table["t"].to_numpy(), table["long"][0].as_py()
        v = table["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), long)
        x, y = (np.flatnonzero(table[side].to_numpy(zero_copy_only=False)) for side in ("left", "right"))
        w, slack = v.astype(np.float32), 1e-6 + 2e-7 * (long + 8)  # lengths are one: what rounding can change; a link too many joins two streams only
        across, first, step = np.ascontiguousarray(w[y].T), np.arange(len(ids)), max(1, PAIRS // max(1, len(y)))
        for i in range(0, len(x), step):
            p, q = np.nonzero(w[x[i : i + step]] @ across >= least - slack)
            p, q = x[i + p], y[q]
            fits = (first[p] != first[q]) & (np.abs(t[p] - t[q]) <= seconds)
            p, q = p[fits], q[fits]
            while len(p):
                low, high = np.minimum(first[p], first[q]), np.maximum(first[p], first[q])
                to = np.arange(len(ids))
                np.minimum.at(to, high, low)
                while (to[to] != to).any():
                    to = to[to]
                first = to[first]
                fits = first[p] != first[q]
                p, q = p[fits], q[fits]
        moved = np.flatnonzero(first != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[first[moved]]), pa.array(ids[moved])], ["a", "b"])

    return block_pairs(rows, "node", ["topic", "long"], BLOCK).groupBy("span", "topic", "long", "p", "apart", "q").applyInArrow(run, "a long, b long")


def place(articles: DataFrame, state: DataFrame | None, least: float, label: str = "clusters", hours: int = 72, slack: float = 0.03, shown: int = 40, total: int = 80) -> tuple[DataFrame, DataFrame]:
    """((id, cluster, status), the state after them). articles: (id, topic, at, v, news, importance, primary), taken in order of at and id; state: STATE, or None.

    An article joins a story of its topic that began within `hours` of it, if its vector is at `least` to the story's mean and at least - slack to its
    lead's; see Open.place. The state is the stories that an article as late as the last one could still join, so that runs over parts of
    the articles, one after the other, give what one run gives. Rows without a topic, a time or a whole vector are stories of their own and leave no state.

    Only rows that are near enough to be a lead and its member can decide on each other, so rows are dealt by the components of that relation, and a component
    is streamed in order with its open stories as memory; a third of all rows in one topic are as many streams as they have events."""
    seconds, spark = hours * 3600, articles.sparkSession
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & F.col("topic").isNotNull() & F.col("at").isNotNull()
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(T.dot(v, v)), F.lit(1e-12)))
    rows = articles.select("id", F.col("topic").cast("string").alias("topic"), F.unix_seconds(F.col("at").cast("timestamp")).alias("t"), T.let(F.col("v").cast("array<double>"), unit).alias("v"),
                           F.coalesce("news", F.lit(True)).alias("news"), F.col("importance").cast("int"), F.coalesce("primary", F.lit(False)).alias("primary"), F.coalesce(whole, F.lit(False)).alias("whole"))
    rows = settle(rows, f"{label}-rows")
    state = spark.createDataFrame([], STATE) if state is None else state
    nodes = rows.where("whole").select((F.col("id") * 2).alias("node"), "topic", "t", F.col("v").alias("w"))
    heads = state.select((F.col("cluster") * 2 + 1).alias("node"), "topic", F.col("first_at").alias("t"), F.col("lead_v").alias("w"))
    both = nodes.unionByName(heads)
    parts = connected(settle(_near(both, seconds, least - slack), f"{label}-near"), label).select(F.col("id").alias("of"), "component")
    old = state.select((F.col("cluster") * 2 + 1).alias("node"), F.lit(0).alias("kind"), F.col("first_at").alias("t"), F.col("cluster").alias("id"), F.lit(None).cast("string").alias("status"), *state.columns)
    new = rows.where("whole").select((F.col("id") * 2).alias("node"), F.lit(1).alias("kind"), "t", "id", "topic", "v", "news", "importance", "primary")
    todo = old.unionByName(new, allowMissingColumns=True).join(parts, F.col("node") == F.col("of"), "left").withColumn("part", F.coalesce("component", "node")).drop("of", "component", "node")

    def framed(out: list[dict]) -> pd.DataFrame:
        whole = {k: "Int64" for k, kind in (x.split() for x in _ROW.split(", ")) if kind in ("int", "long")}
        rows = [{**dict.fromkeys(_NAMES), **x} for x in out]
        return pd.DataFrame({k: pd.Series([x[k] for x in rows], dtype=object) for k in _NAMES}).astype({**whole, "news": "boolean", "primary": "boolean"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = None, Open(least, least - slack, seconds, shown, total)
        for pdf in batches:
            out: list[dict] = []
            for r in pdf.to_dict("records"):
                if r["part"] != part:
                    out += [{"kind": 0, **s} for s in held.stories]
                    part, held = r["part"], Open(least, least - slack, seconds, shown, total)
                r["v"] = np.asarray(r["v"], float)
                if r["kind"] == 0:
                    held.add({**{k: r[k] for k in _NAMES[4:]}, "lead_v": np.asarray(r["lead_v"], float)})
                else:
                    out += [{"kind": 0, **s} for s in held.drop_before(r["t"])]
                    r["importance"] = None if pd.isna(r["importance"]) else int(r["importance"])
                    cluster, status = held.place(r)
                    out.append({"kind": 1, "id": r["id"], "cluster": cluster, "status": status})
            yield framed(out)
        yield framed([{"kind": 0, **s} for s in held.stories])

    done = settle(in_order(todo, "part", "kind", "t", "id").mapInPandas(run, _ROW), f"{label}-done")
    alone = rows.where("NOT whole").select("id", F.col("id").alias("cluster"), F.lit("published").alias("status"))
    last = rows.agg(F.max(F.when(F.col("whole"), F.col("t"))).alias("last"))
    after = done.where("kind = 0").join(F.broadcast(last)).where(F.col("last").isNull() | (F.col("first_at") >= F.col("last") - seconds))  # one row
    return done.where("kind = 1").select("id", "cluster", "status").unionByName(alone), after.select(*[x.split()[0] for x in STATE.split(", ")])
