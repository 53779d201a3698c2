"""Embedding near-duplicates by hierarchical navigable small-world graphs, one a shard.

Equal vectors are one class, which a member stands for. Classes are dealt over shards by a hash; each shard builds its graph, and every class is
searched in every shard. A search's beam widens until its worst hit is below the threshold, so that a crowded neighbourhood is read to its end;
a task compares a share of its queries with all vectors of its shard, more of them until enough true pairs are seen, and widens all beams until the
recall it audits is reached, over all pairs and on average over queries that have any, at the last by reading the whole shard. Hits are verified by their cosine in double precision. A task returns counts of links and a spanning forest of those
it found, never the pairs, and the components are united over all tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import mix
from skein.shared import connected, settle

#: Neighbours of a node (twice as many on the lowest layer), beam while building, first beam of a search.
NEIGHBOURS, BUILD_BEAM, BEAM = 16, 32, 16
#: Bytes of a shard's vectors and links and its vectors at most, and shards at least; queries searched at once.
SHARD_BYTES, SHARD_ROWS, LEAST_SHARDS, BATCH = 96 << 20, 65_536, 6, 512
#: Audited queries of a task: so many at least and this share; more, up to AUDIT_MOST of all, until they have AUDIT_PAIRS true pairs. Recall they must show.
AUDIT, AUDIT_SHARE, AUDIT_MOST, AUDIT_PAIRS, RECALL = 64, 0.01, 0.1, 64, 0.97
#: Shards' worth of queries in one task: a graph is sent to as many tasks as there are such chunks.
QUERY_SHARDS = 4


class Layer:
    def __init__(self, n: int, width: int):
        self.links = np.full((n, width), -1, np.int32)
        self.entry: np.ndarray = np.zeros(0, np.int64)


class Graph:
    """A navigable small-world graph of unit vectors, built batch by batch: a batch is searched in the graph so far and compared with itself."""

    def __init__(self, unit: np.ndarray, seed: int = 7):
        self.unit = unit.astype(np.float32)
        n = len(unit)
        draw = (mix(np.arange(n, dtype=np.uint64) + np.uint64(seed)) >> np.uint64(11)).astype(float) / (1 << 53)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(NEIGHBOURS)).astype(int), 4)
        top = int(level.max(initial=0))
        self.layers = [Layer(n, NEIGHBOURS * (2 if i == 0 else 1)) for i in range(top + 1)]
        for at in range(0, n, BATCH):
            batch = np.arange(at, min(n, at + BATCH))
            near = None
            for i in range(top, -1, -1):
                layer = self.layers[i]
                if len(layer.entry):
                    near = self.search(self.unit[batch], layer, near, BUILD_BEAM if i == 0 else 8)
                own = level[batch] >= i
                if own.any():
                    self._add(layer, batch[own], None if near is None else near[0][own])

    def search(self, queries: np.ndarray, layer: Layer, start: tuple | None, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the best `beam` nodes met from the start nodes on, best first; -1 where there are fewer."""
        b, size = len(queries), len(self.unit)
        seen = np.zeros((b, size + 1), bool)
        seen[:, -1] = True
        first = np.broadcast_to(layer.entry[:4], (b, len(layer.entry[:4]))) if start is None else start[0]
        ids, sims, opened = np.full((b, beam), -1, np.int64), np.full((b, beam), -2, np.float32), np.ones((b, beam), bool)
        live = np.arange(b)
        fresh = np.where(first < 0, size, first).astype(np.int64)
        while len(live):
            # mark and score what is new, each node once; what is no better than a full beam's last can't enter it
            r, c = np.nonzero(~seen[live[:, None], fresh])
            flat = np.sort(r * (size + 1) + fresh[r, c])
            flat = flat[np.concatenate([[True], flat[1:] != flat[:-1]])] if len(flat) else flat
            r, node = flat // (size + 1), flat % (size + 1)
            seen[live[r], node] = True
            many = np.bincount(r, minlength=len(live))
            score = np.einsum("ij,ij->i", np.repeat(queries[live], many, axis=0), self.unit.take(node, axis=0))
            good = score > sims[live[r], -1]
            r, node, score = r[good], node[good], score[good]
            many = np.bincount(r, minlength=len(live))
            column = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
            shape = (len(live), int(many.max(initial=0)))
            new_ids, new_sims = np.full(shape, -1, np.int64), np.full(shape, -2, np.float32)
            new_ids[r, column], new_sims[r, column] = node, score
            all_ids = np.concatenate([ids[live], new_ids], axis=1)
            all_sims = np.concatenate([sims[live], new_sims], axis=1)
            all_opened = np.concatenate([opened[live], new_ids < 0], axis=1)
            best = np.argsort(-all_sims, axis=1)[:, :beam]
            ids[live], sims[live], opened[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_opened))
            # open the best nodes that are not opened yet
            closed = ~opened[live]
            go = closed.any(axis=1)
            live, closed = live[go], closed[go]
            if not len(live):
                break
            rank = np.cumsum(closed, axis=1)
            take = closed & (rank <= 4)
            opened[live] |= take
            chosen = np.where(take, ids[live], -1)
            chosen = np.take_along_axis(chosen, np.argsort(~take, axis=1, kind="stable")[:, :4], 1)
            fresh = np.where(chosen[:, :, None] >= 0, layer.links[chosen], -1).reshape(len(live), -1).astype(np.int64)
            fresh[fresh < 0] = size  # always seen
        return ids, sims

    def _add(self, layer: Layer, nodes: np.ndarray, near: np.ndarray | None) -> None:
        width = layer.links.shape[1]
        inside = self.unit[nodes] @ self.unit[nodes].T
        np.fill_diagonal(inside, -2)
        k = min(width, len(nodes) - 1)
        own = nodes[np.argpartition(-inside, k - 1, axis=1)[:, :k]] if k > 0 else np.zeros((len(nodes), 0), np.int64)
        candidates = own if near is None else np.concatenate([near, own], axis=1)
        made = self._spread(nodes, candidates, width // 2)
        layer.links[nodes, : made.shape[1]] = made
        source = np.repeat(nodes, width)
        target = layer.links[nodes].ravel().astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, int)
        if len(first):
            hit = target[first]
            size = np.diff(np.append(first, len(target)))
            back = np.full((len(hit), int(size.max())), -1, np.int64)
            back[np.repeat(np.arange(len(hit)), size), np.arange(len(target)) - np.repeat(first, size)] = source
            made = self._spread(hit, np.concatenate([layer.links[hit], back], axis=1), width)
            layer.links[hit] = -1
            layer.links[hit, : made.shape[1]] = made
        if len(layer.entry) < 4:
            layer.entry = np.concatenate([layer.entry, nodes])[:4]

    def _spread(self, nodes: np.ndarray, candidates: np.ndarray, width: int) -> np.ndarray:
        """Of each node's candidates the nearest that are nearer to it than to those taken before, then the nearest of the rest."""
        candidates = candidates.astype(np.int64)
        made = np.full((len(nodes), min(width, candidates.shape[1])), -1, np.int64)
        held = (candidates >= 0).sum(axis=1)
        order = np.argsort(held, kind="stable")
        for at in range(0, len(nodes), BATCH):  # nodes of about as many candidates, so that one with very many widens few rows
            rows = order[at : at + BATCH]
            ids = np.sort(candidates[rows], axis=1)[:, ::-1][:, : held[rows[-1]]]  # missing ones last
            usable = (ids >= 0) & (ids != nodes[rows, None])
            usable[:, 1:] &= ids[:, 1:] != ids[:, :-1]
            sims = np.where(usable, np.matmul(self.unit[ids], self.unit[nodes[rows]][:, :, None])[:, :, 0], -2)
            best = np.argsort(-sims, axis=1)
            ids, sims, usable = (np.take_along_axis(x, best, 1) for x in (ids, sims, usable))
            unit = self.unit[ids]
            between = np.matmul(unit, unit.transpose(0, 2, 1))
            crowd, taken = np.full(ids.shape, -2, np.float32), np.zeros(ids.shape, bool)
            count = np.zeros(len(rows), int)
            for j in range(ids.shape[1]):
                pick = usable[:, j] & (crowd[:, j] < sims[:, j]) & (count < width)
                taken[:, j] = pick
                count += pick
                np.maximum(crowd, between[:, j], out=crowd, where=pick[:, None])
            rank = np.where(taken, 0, np.where(usable, 1, 2))
            best = np.argsort(rank, axis=1, kind="stable")[:, :width]
            made[rows, : best.shape[1]] = np.where(np.take_along_axis(rank, best, 1) < 2, np.take_along_axis(ids, best, 1), -1)
        return made

    def descend(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        near = None
        for layer in reversed(self.layers[1:]):
            if len(layer.entry):
                near = self.search(queries, layer, near, 8)
        return self.search(queries, self.layers[0], near, beam)

    def audited(self, queries: np.ndarray, least: float, own: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(query, its true nodes but itself) of the audited queries that have any; own: each query's own node here, or -1."""
        order = np.argsort(mix(np.arange(len(queries), dtype=np.uint64)))
        enough, most = max(AUDIT, int(AUDIT_SHARE * len(queries))), max(AUDIT, int(AUDIT_MOST * len(queries)))
        found, pairs = [], 0
        for at in range(0, min(most, len(queries)), AUDIT):
            if at >= enough and pairs >= AUDIT_PAIRS:
                break
            part = order[at : at + AUDIT]
            for i, sims in zip(part, queries[part] @ self.unit.T, strict=True):
                true = np.flatnonzero(sims >= least)
                true = true[true != own[i]]
                pairs += len(true)
                if len(true):
                    found.append((int(i), true))
        return found

    def within(self, queries: np.ndarray, least: float, own: np.ndarray | None = None) -> list[np.ndarray]:
        """Nodes at a similarity of `least` or more to each query, as far as the beams find them."""
        queries = queries.astype(np.float32)
        truth = self.audited(queries, least, np.full(len(queries), -1) if own is None else own)
        asked, sizes = np.array([i for i, _ in truth], int), np.array([len(t) for _, t in truth])
        beam = BEAM
        while len(truth) and beam < len(self.unit):  # the audited queries find the beam, all others are searched with it once
            hits = np.array([len(np.intersect1d(x, t)) for x, (_, t) in zip(self._found(queries[asked], least, beam), truth, strict=True)])
            if hits.sum() >= RECALL * sizes.sum() and (hits / sizes).mean() >= RECALL:
                break
            beam *= 2
        if beam >= len(self.unit):
            return [np.flatnonzero(x >= least) for at in range(0, len(queries), BATCH) for x in queries[at : at + BATCH] @ self.unit.T]
        return self._found(queries, least, beam)

    def _found(self, queries: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        out: list = [None] * len(queries)
        todo = np.arange(len(queries))
        while len(todo):
            wide = []
            for at in range(0, len(todo), BATCH):
                part = todo[at : at + BATCH]
                if beam >= len(self.unit):
                    for i, sims in zip(part, queries[part] @ self.unit.T, strict=True):
                        out[i] = np.flatnonzero(sims >= least)
                    continue
                ids, sims = self.descend(queries[part], beam)
                good = (sims >= least) & (ids >= 0)
                full = good[:, -1]  # the beam ends inside the neighbourhood
                for i, row, g, f in zip(part, ids, good, full, strict=True):
                    if not f:
                        out[i] = row[g]
                wide.append(part[full])
            todo = np.concatenate(wide) if wide else np.zeros(0, int)
            beam *= 2
        return out


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the edges (a, b) connect, fewer than there are ends."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            kept.append((x, y))
    return kept


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, least: float = 0.9, label: str = "vectors") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding).

    Two vectors of one length link when their cosine in double precision is at least `least`; none below is linked. A vector that is null, zero
    or has a null or non-finite component links with nothing. Rows are vectors: rows that repeat a vector link with each other. A null vec_id
    gets 0 links, a null component and a null kept. kept: vec_id = component_id.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).select("vec_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.reverse("v"), F.size("v")).alias("h2"), "v")
    classes = settle(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v")), f"{label}-classes")
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    rows_of_shard = max(1, min(SHARD_ROWS, SHARD_BYTES // (20 * width + 12 * NEIGHBOURS)))
    shards = max(LEAST_SHARDS, -(-n // rows_of_shard))
    parts = max(LEAST_SHARDS, -(-n // (QUERY_SHARDS * rows_of_shard)))  # chunks of queries
    keyed = classes.select("rep", "m", "v", F.size("v").alias("dim"), F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), F.pmod("h2", F.lit(parts)).cast("int").alias("part"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        if not got.num_rows:
            return
        got = got.sort_by("rep")
        v = np.stack([np.asarray(x.values) for x in got["v"]])
        unit = v / np.linalg.norm(v / np.abs(v).max(axis=1)[:, None], axis=1)[:, None] / np.abs(v).max(axis=1)[:, None]
        blob = pickle.dumps((np.asarray(got["rep"]), np.asarray(got["m"]), unit, Graph(unit)), protocol=5)
        yield pa.RecordBatch.from_arrays([got["shard"].slice(0, 1).combine_chunks(), got["dim"].slice(0, 1).combine_chunks(), pa.array([blob], pa.binary())], ["shard", "dim", "graph"])

    graphs = settle(keyed.groupBy("shard", "dim").applyInArrow(build, "shard int, dim int, graph binary"), f"{label}-graphs")
    queries = keyed.select("rep", "v", "dim", "part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    copies = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        ids, m, unit, graph = pickle.loads(right["graph"][0].as_py())
        rep = np.asarray(left["rep"])
        v = np.stack([np.asarray(x.values) for x in left["v"]])
        q = v / np.linalg.norm(v / np.abs(v).max(axis=1)[:, None], axis=1)[:, None] / np.abs(v).max(axis=1)[:, None]
        place = np.minimum(np.searchsorted(ids, rep), len(ids) - 1)
        found = graph.within(q, least - 1e-5, np.where(ids[place] == rep, place, -1))
        a = np.repeat(np.arange(len(rep)), [len(x) for x in found])
        b = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
        cosine = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[a[i : i + 50_000]], unit[b[i : i + 50_000]]) for i in range(0, len(a), 50_000)]])
        true = (cosine >= least) & (rep[a] != ids[b])
        a, b = a[true], b[true]
        links = np.bincount(a, m[b], minlength=len(rep)).astype(np.int64)
        edges = forest(rep[a], ids[b])
        some = np.flatnonzero(links)
        return pa.table({"kind": pa.array([0] * len(some) + [1] * len(edges), pa.int32()), "a": pa.array([*rep[some].tolist(), *[x for x, _ in edges]], pa.int64()), "b": pa.array([*links[some].tolist(), *[y for _, y in edges]], pa.int64())})

    keys = ["shard", "dim", "part"]
    found = settle(queries.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(search, "kind int, a long, b long"), f"{label}-found")
    links = found.where("kind = 0").groupBy(F.col("a").alias("x")).agg(F.sum("b").alias("links"))
    parts_of = connected(found.where("kind = 1").select("a", "b"), label)
    done = classes.select("h1", "h2", "rep", "m").join(links, F.col("rep") == F.col("x"), "left").join(parts_of, F.col("rep") == F.col("id"), "left")
    done = settle(done.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("c")), f"{label}-done")
    marked = rows.select("vec_id", F.when(usable(F.col("v")), F.xxhash64("v")).alias("h1"), F.xxhash64(F.reverse("v"), F.size("v")).alias("h2"))
    joined = marked.join(done, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    return joined.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
