"""Embedding near-dedup: a navigable small-world graph per shard.

Distinct vectors of one label are dealt to shards of about SHARD_ROWS by their
hash, and each shard builds a hierarchy of graphs. Every shard of a label is
queried with every shard of it (each pair once, the link being symmetric), with
a beam over many queries at a time. Before a pair counts, an audit compares a
part of its queries with brute force over the shard; the beam is widened until
the audit finds AUDIT_RECALL of the links, and of links at the threshold that
are planted for it, at last to the whole shard. Found pairs are verified by
cosine in double precision, and links are united to components.

Equal vectors are one node with a count, so a vector in a third of all rows is
one query; a shard is a row of a table (about 2 MB), never a whole label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, table

SIMILARITY = 0.93
SHARD_ROWS = 4_096
DEGREE, TOP_DEGREE, LEVEL_RATIO = 24, 12, 12
BUILD_BEAM, FIRST_BEAM = 48, 32
AUDIT_RECALL, AUDIT_EVERY, AUDIT_LEAST = 0.99, 20, 64
#: Links that are planted for an audit.
PLANTED = 256


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries at once: (ids, similarities) of a beam each, best first, -1 for none.

    graph holds the neighbours of each node of x, -1 for none; entry gives each query's first nodes.
    """
    q = len(queries)
    rows = np.arange(q)[:, None]
    ids = np.full((q, beam), -1, np.int32)
    sims = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, len(x)), bool)
    fresh = entry[:, :beam]
    active = np.arange(q)
    while len(active):
        r = active[:, None]
        ok = fresh >= 0
        fresh = np.where(ok, fresh, 0)
        ok &= ~seen[r, fresh]
        # A node may come twice in a row: the later one is dropped.
        order = np.argsort(fresh, axis=1, kind="stable")
        sorted_ = np.take_along_axis(fresh, order, 1)
        twice = np.zeros_like(ok)
        np.put_along_axis(twice, order[:, 1:], (sorted_[:, 1:] == sorted_[:, :-1]) & np.take_along_axis(ok, order[:, :-1], 1), 1)
        ok &= ~twice
        seen[np.broadcast_to(r, fresh.shape)[ok], fresh[ok]] = True
        s = np.where(ok, np.einsum("ijk,ik->ij", x[fresh], queries[active]), -np.inf).astype(np.float32)
        all_ids = np.concatenate((ids[active], np.where(ok, fresh, -1)), axis=1)
        all_sims = np.concatenate((sims[active], s), axis=1)
        all_done = np.concatenate((done[active], ~ok), axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        sims[active] = np.take_along_axis(all_sims, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
        left = ~done[active].all(axis=1)
        active = active[left]
        if not len(active):
            break
        # The two best nodes that have not been left yet.
        pick = np.argsort(done[active], axis=1, kind="stable")[:, :2]
        open_ = ~np.take_along_axis(done[active], pick, 1)
        nodes = np.where(open_, np.take_along_axis(ids[active], pick, 1), -1)
        done[active[:, None], pick] = True
        fresh = np.where(nodes[:, :, None] >= 0, graph[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
    return ids, sims


def _spread(x: np.ndarray, near: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """For each node, of its near ones (best first, -1 for none) those nearer to it than to any chosen one, filled up with the best others."""
    n, k = near.shape
    v = x[np.maximum(near, 0)]
    within = np.einsum("nkd,njd->nkj", v, v)
    chosen = np.zeros((n, k), bool)
    for j in range(k):
        apart = np.where(chosen, within[:, j], -np.inf).max(axis=1) < sims[:, j]
        chosen[:, j] = apart & (near[:, j] >= 0) & (chosen.sum(axis=1) < degree)
    order = np.argsort(np.where(near >= 0, np.where(chosen, 0, 1), 2), axis=1, kind="stable")[:, :degree]
    out = np.full((n, degree), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(near, order, 1)
    return out


def _linked_back(x: np.ndarray, graph: np.ndarray, add: np.ndarray) -> None:
    """Adds to every neighbour of the new nodes a link back, thinning what is full."""
    degree = graph.shape[1]
    to, new = graph[add].ravel(), np.repeat(add, degree)
    to, new = to[to >= 0], new[to >= 0]
    nodes = np.unique(to)
    old = graph[nodes]
    src = np.concatenate((np.repeat(nodes, degree)[old.ravel() >= 0], to))
    dst = np.concatenate((old.ravel()[old.ravel() >= 0], new))
    src, dst = np.unique(np.stack((src, dst), axis=1), axis=0).T
    s = np.einsum("ij,ij->i", x[src], x[dst])
    order = np.lexsort((-s, src))
    src, dst, s = src[order], dst[order], s[order]
    begin = np.searchsorted(src, nodes)
    place = np.arange(len(src)) - begin[np.searchsorted(nodes, src)]
    fits = place < 2 * degree
    near = np.full((len(nodes), 2 * degree), -1, np.int32)
    sims = np.full((len(nodes), 2 * degree), -np.inf, np.float32)
    at = np.searchsorted(nodes, src)
    near[at[fits], place[fits]], sims[at[fits], place[fits]] = dst[fits], s[fits]
    graph[nodes] = _spread(x, near, sims, degree)


def build(x: np.ndarray, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the top: (nodes, graph), the graph's members being places among the nodes.

    Nodes enter in batches that at most double a level; each batch is searched
    for in what is there, linked both ways, and full nodes are thinned.
    """
    n = len(x)
    height = np.minimum(np.random.default_rng(seed).geometric(1 - 1 / LEVEL_RATIO, n) - 1, 6)
    height[:1] = height.max(initial=0)
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(int(height.max(initial=0)), -1, -1):
        nodes = np.flatnonzero(height >= level)
        degree = DEGREE if level == 0 else TOP_DEGREE
        v = x[nodes]
        graph = np.full((len(nodes), degree), -1, np.int32)
        size = 1
        while size < len(nodes):
            add = np.arange(size, min(len(nodes), 2 * size, size + 512))
            ids, sims = search(v[:size], graph[:size], v[add], np.zeros((len(add), 1), np.int32), min(BUILD_BEAM, size))
            graph[add] = _spread(v, ids, sims, degree)
            _linked_back(v, graph, add)
            size += len(add)
        levels.append((nodes.astype(np.int32), graph))
    return levels


def descend(x: np.ndarray, levels: list, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam of each query at the lowest level, entered from the levels above."""
    entry = np.zeros((len(queries), 1), np.int32)
    for k, (nodes, graph) in enumerate(levels):
        last = k == len(levels) - 1
        ids, sims = search(x[nodes], graph, queries, entry, min(beam, len(nodes)) if last else min(4, len(nodes)))
        if last:
            return np.where(ids >= 0, nodes[np.maximum(ids, 0)], -1), sims
        below = levels[k + 1][0]
        at = np.searchsorted(below, nodes)
        entry = np.where(ids >= 0, at[np.maximum(ids, 0)], -1).astype(np.int32)
    return np.full((len(queries), 0), -1, np.int32), np.zeros((len(queries), 0), np.float32)


def plant(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, queries): vectors whose similarity to a node each is the threshold; none where vectors have one component."""
    nodes = np.unique(np.linspace(0, len(x) - 1, min(PLANTED, len(x))).astype(np.int32)) if x.shape[1] > 1 else np.zeros(0, np.int32)
    away = np.random.default_rng(11).standard_normal((len(nodes), x.shape[1]))
    v = x[nodes].astype(np.float64)
    away -= (away * v).sum(axis=1, keepdims=True) * v
    away /= np.sqrt(np.square(away).sum(axis=1, keepdims=True))
    return nodes, (threshold * v + np.sqrt(max(0.0, 1 - threshold * threshold)) * away).astype(np.float32)


def links(x: np.ndarray, levels: list, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, node) that may have the similarity, and the beam whose audit passed."""
    margin = threshold - 1e-4
    audit = np.arange(0, len(queries), max(1, min(AUDIT_EVERY, len(queries) // AUDIT_LEAST or 1)))
    truth = (queries[audit] @ x.T) >= margin
    total = int(truth.sum())
    # Where no query has a link, real ones say nothing about the beam: links at the threshold are planted as well.
    nodes, planted = plant(x, threshold)
    beam = FIRST_BEAM
    while True:
        if beam >= len(x):
            q, n = np.nonzero((queries @ x.T) >= margin)
            return q, n, len(x)
        ids, sims = descend(x, levels, queries[audit], beam)
        hits = (sims >= margin) & (ids >= 0)
        # A beam full of links is compared with the whole shard below, so it misses none.
        found = int(np.where(hits.all(axis=1), truth.sum(axis=1), hits.sum(axis=1)).sum())
        if found >= AUDIT_RECALL * total and (not len(nodes) or (descend(x, levels, planted, beam)[0] == nodes[:, None]).any(axis=1).mean() >= AUDIT_RECALL):
            break
        beam *= 2
    out_q, out_n = [], []
    for lo in range(0, len(queries), 1024):
        ids, sims = descend(x, levels, queries[lo : lo + 1024], beam)
        ok = (ids >= 0) & (sims >= margin)
        full = ok.all(axis=1)
        ok[full] = False
        q, k = np.nonzero(ok)
        out_q.append(q + lo)
        out_n.append(ids[q, k])
        if full.any():  # more links than the beam is wide
            rows = np.flatnonzero(full)
            q, n = np.nonzero((queries[lo + rows] @ x.T) >= margin)
            out_q.append(rows[q] + lo)
            out_n.append(n)
    return np.concatenate(out_q), np.concatenate(out_n), beam


SHARD = "label int, shard int, nodes binary, copies binary, vectors binary, graph binary"


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    # Scaled first, so that no finite vector over- or underflows.
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


def _index(key, t):
    """The row of one shard: nodes, vectors and levels."""
    t = t.sort_by("node")
    v = np.array(t.column("embedding").to_pylist(), np.float64)
    levels = build(_unit(v))
    parts = [np.array([len(levels)], np.int32).tobytes()]
    for nodes, graph in levels:
        parts += [np.array([len(nodes), graph.shape[1]], np.int32).tobytes(), nodes.tobytes(), graph.tobytes()]
    label, shard = (k.as_py() for k in key)
    return pa.table({"label": pa.array([label], pa.int32()), "shard": pa.array([shard], pa.int32()), "nodes": [np.array(t.column("node").to_pylist(), np.int64).tobytes()], "copies": [np.array(t.column("copies").to_pylist(), np.int64).tobytes()], "vectors": [v.tobytes()], "graph": [b"".join(parts)]})


def _levels(raw: bytes) -> list:
    x = np.frombuffer(raw, np.int32)
    at, levels = 1, []
    for _ in range(x[0]):
        n, degree = x[at], x[at + 1]
        at += 2
        levels.append((x[at : at + n], x[at + n : at + n + n * degree].reshape(n, degree)))
        at += n + n * degree
    return levels


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place that each of n places reaches over pairs (a, b)."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def _query(threshold: float):
    """For two shards, of each node with links: the vectors it links with in the other shard, and a node of its component."""
    names = ["node", "root", "others"]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                c = {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
                own, other, copies, other_copies = (np.frombuffer(c[k], np.int64) for k in ("nodes", "other_nodes", "copies", "other_copies"))
                x, y = (np.frombuffer(c[k], np.float64).reshape(len(n), -1) for k, n in (("vectors", own), ("other_vectors", other)))
                if x.shape[1] != y.shape[1]:
                    continue
                q, n, _ = links(_unit(x), _levels(c["graph"]), _unit(y), threshold)
                same = c["shard"] == c["other_shard"]
                if same:  # either end may have found the other
                    q, n = (np.concatenate(z) for z in ((q, n), (n, q)))
                    q, n = np.unique(np.stack((q, n), axis=1)[q != n], axis=0).T
                ok = np.zeros(len(q), bool)
                for lo in range(0, len(q), 65_536):
                    p, r = y[q[lo : lo + 65_536]], x[n[lo : lo + 65_536]]
                    p, r = p / np.abs(p).max(axis=1, keepdims=True), r / np.abs(r).max(axis=1, keepdims=True)
                    ok[lo : lo + 65_536] = (p * r).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((r * r).sum(axis=1))) >= threshold
                q, n = q[ok], n[ok]
                ids = other if same else np.concatenate((other, own))
                at = n if same else n + len(other)
                others = np.bincount(q, copies[n], minlength=len(ids))
                if not same:
                    others += np.bincount(at, other_copies[q], minlength=len(ids))
                root = _roots(q, at, len(ids))
                hit = np.flatnonzero(others)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[root[hit]]), pa.array(others[hit].astype(np.int64))], names=names)

    return run


def near_vectors(vectors: DataFrame, threshold: float = SIMILARITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of vectors(vec_id, embedding, label).

    Vectors that are null, empty, zero, or hold null or non-finite components,
    and rows with a null label, link with nothing and are components of their
    own. Vectors of different widths do not link. Rows that repeat a vec_id or a
    vector link with each other like any others. A null vec_id takes part, but
    names no component. Other columns are ignored.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = v.withColumn("usable", usable).withColumn("print_a", F.xxhash64("embedding", "label")).withColumn("print_b", F.xxhash64(F.lit(1), "embedding", "label"))
    good = v.where("usable")
    nodes = cut(good.groupBy("label", "print_a", "print_b").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("embedding").alias("embedding")).withColumn("node", F.monotonically_increasing_id()))
    shards = nodes.groupBy("label").count().select("label", F.ceil(F.col("count") / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(shards, "label").withColumn("shard", F.pmod("print_b", "shards").cast("int"))
    index = cut(dealt.select("label", "shard", "node", "copies", "embedding").groupBy("label", "shard").applyInArrow(_index, SHARD))
    other = index.select("label", *(F.col(c).alias(f"other_{c}") for c in ("shard", "nodes", "copies", "vectors")))
    pairs = index.join(other, "label").where("shard <= other_shard")
    # A row holds two shards: few of them to a task and to a batch.
    asked = pairs.repartition(F.xxhash64("label", "shard", "other_shard")).drop("label")
    found = cut(asked.mapInArrow(_query(threshold), "node long, root long, others long"))
    n_links = found.groupBy("node").agg(F.sum("others").alias("others"))
    united = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_node = nodes.join(n_links, "node", "left").join(united.withColumnRenamed("id", "node"), "node", "left")
    per_node = per_node.select("label", "print_a", "print_b", "first", "node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = per_node.groupBy("component").agg(F.min("first").alias("component_id"))
    named = per_node.join(least, "component").select("label", "print_a", "print_b", "n_links", "component_id")
    out = v.drop("embedding").join(named, ["label", "print_a", "print_b"], "left")
    component = F.when(F.col("usable") & F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("usable"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.expr("vec_id <=> component_id"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; unusable vectors and null labels link with nothing."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
