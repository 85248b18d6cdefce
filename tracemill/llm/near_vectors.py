"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors of one label are dealt to overlapping cluster shards. Each shard builds a graph whose lists are pruned so that a
neighbour is kept only if no kept one is much closer to it; the lists of all shards are united. A vector is searched
from the medoid of its own shard: a greedy walk with a small beam, then the range around what it reached, and around the
vector itself, is expanded until no new vector in it turns up. Links are verified in double precision. A bounded sample is compared with brute force, and the
overlap grows until the recall is reached.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import common
from tracemill.llm.components import components

LOG = logging.getLogger(__name__)
THRESHOLD = 0.98
#: Distinct vectors per shard, on average and before overlap; shards that each vector joins.
SHARD, OVERLAP = 1000, 3
#: Candidates of a list, neighbours kept, neighbours with those of other lists, and how much closer a kept one must be.
CANDIDATES, DEGREE, MOST, ALPHA = 64, 24, 64, 1.2
BEAM, WALK = 8, 40
#: The search range goes this much below the threshold, so that paths over vectors just outside are found.
MARGIN = 0.04
#: Vectors per label that centroids are fitted on; queries of the audit; the recall it asks for.
SAMPLE, AUDITED, RECALL = 4000, 200, 0.99
#: Vectors that one centroid is fitted on, so a label of few shards sends few.
FITTED = 64


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Binary vectors of one length (8-byte floats) as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def centroids(vectors: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means; fewer rows than ``count`` are all centroids."""
    if len(vectors) <= count:
        return vectors
    centers = vectors[np.random.default_rng(seed).choice(len(vectors), count, replace=False)]
    for _ in range(rounds):
        owner = np.argmax(vectors @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, owner, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centers)
    return centers


def pruned_lists(vectors: np.ndarray) -> list[np.ndarray]:
    """Neighbour lists of unit vectors: robust pruning of each one's nearest candidates, with the reverse links."""
    count = len(vectors)
    if count < 2:
        return [np.zeros(0, np.int64)] * count
    width = min(CANDIDATES, count - 1)
    sources, targets = [], []
    for begin in range(0, count, 256):
        rows = np.arange(begin, min(begin + 256, count))
        near = vectors[rows] @ vectors.T
        near[np.arange(len(rows)), rows] = -2
        found = np.argpartition(-near, width - 1, axis=1)[:, :width] if width < count - 1 else np.argsort(-near, axis=1)[:, :width]
        value = np.take_along_axis(near, found, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        found, away = np.take_along_axis(found, order, axis=1), 1 - np.take_along_axis(value, order, axis=1)
        held = vectors[found]
        between = 1 - held @ held.transpose(0, 2, 1)
        open_, line = np.ones(found.shape, bool), np.arange(len(rows))
        for _ in range(min(DEGREE, width)):
            pick = np.argmax(open_, axis=1)
            alive = open_[line, pick]
            if not alive.any():
                break
            sources.append(rows[alive])
            targets.append(found[line, pick][alive])
            open_ &= ALPHA * between[line, pick] > away
            open_[line, pick] = False
            open_ &= alive[:, None]
    sources, targets = np.concatenate(sources), np.concatenate(targets)
    both = np.unique(np.concatenate([sources * count + targets, targets * count + sources]))
    return np.split(both % count, np.searchsorted(both // count, np.arange(1, count)))


def padded_lists(lists: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Lists as rows of equal length, filled with the vector's own number; the nearest stay where there are too many."""
    out = np.repeat(np.arange(len(lists))[:, None], max(1, min(MOST, max(map(len, lists), default=1))), axis=1)
    for i, near in enumerate(lists):
        if len(near) > MOST:
            near = near[np.argsort(-(vectors[near] @ vectors[i]), kind="stable")[:MOST]]
        out[i, :len(near)] = near
    return out


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", left, right)


def range_search(vectors: np.ndarray, near: list[np.ndarray], queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query place, vector place) of about ``threshold``, from the medoid on; a block of queries at a time.

    The walk uses lists of bounded length; the expansion uses them whole, for the middle of a group of copies may be the
    only neighbour of thousands.
    """
    lists, sizes = padded_lists(near, vectors), np.array([len(x) for x in near], np.int64)
    flat, starts = np.concatenate([*near, np.zeros(0, np.int64)]).astype(np.int64), np.cumsum(sizes) - sizes
    small = vectors.astype(np.float32)
    medoid = int(np.argmax(small @ small.mean(axis=0)))
    found_q, found_v, low = [], [], threshold - MARGIN
    for begin in range(0, len(queries), 128):
        own = queries[begin:begin + 128]
        count = len(own)
        beam = np.full((count, 1), medoid)
        for _ in range(WALK):
            options = np.concatenate([beam, lists[beam].reshape(count, -1)], axis=1)
            options = np.sort(options, axis=1)
            value = np.einsum("qod,qd->qo", small[options], small[own])
            value[:, 1:][options[:, 1:] == options[:, :-1]] = -2
            best = np.argsort(-value, axis=1, kind="stable")[:, :BEAM]
            new = np.sort(np.take_along_axis(options, best, axis=1), axis=1)
            if new.shape == beam.shape and (new == beam).all():
                break
            beam = new
        seen = np.zeros((count, len(vectors)), bool)
        # a query that is in the graph also starts from its own place, so a group that the walk misses is still found
        q, v = np.repeat(np.arange(count), beam.shape[1] + 1), np.concatenate([beam, own[:, None]], axis=1).ravel()
        while len(q):
            fresh = ~seen[q, v]
            key = np.unique(q[fresh] * len(vectors) + v[fresh])
            q, v = key // len(vectors), key % len(vectors)
            seen[q, v] = True
            value = np.concatenate([_product(small[own[q[a:a + 65536]]], small[v[a:a + 65536]]) for a in range(0, len(q), 65536)] or [np.zeros(0)])
            hit = value >= threshold - 1e-5
            found_q.append(own[q[hit]])
            found_v.append(v[hit])
            q, v = q[value >= low], v[value >= low]
            count_ = sizes[v]
            first = np.repeat(starts[v] - (np.cumsum(count_) - count_), count_)
            q, v = np.repeat(q, count_), flat[first + np.arange(len(first))]
    return (np.concatenate(found_q), np.concatenate(found_v)) if found_q else (np.zeros(0, int), np.zeros(0, int))


def _build(table: pa.Table) -> pa.Table:
    nodes = np.asarray(table["node"])
    near = [nodes[x] for x in pruned_lists(unit(matrix(table["vector"])))]
    return pa.table({"node": pa.array(nodes, pa.int64()), "near": pa.array(near, pa.list_(pa.int64()))})


def _search(threshold: float):
    def search(table: pa.Table) -> pa.Table:
        nodes, primary, weight, home = (np.asarray(table[c]) for c in ("node", "primary", "weight", "home"))
        raw = matrix(table["vector"])
        vectors, order = unit(raw), np.argsort(nodes)
        lists = []
        for near in table["near"].to_pylist():
            near = np.array(near or [], np.int64)
            at = np.minimum(np.searchsorted(nodes, near, sorter=order), len(nodes) - 1)
            lists.append(order[at[nodes[order[at]] == near]] if len(near) else near)
        q, v = range_search(vectors, lists, np.flatnonzero(primary), threshold)
        size = np.sqrt(_product(raw, raw))
        exact = np.zeros(len(q), bool)
        for a in range(0, len(q), 1 << 16):
            x, y = q[a:a + (1 << 16)], v[a:a + (1 << 16)]
            exact[a:a + (1 << 16)] = (_product(raw[x], raw[y]) / (size[x] * size[y]) >= threshold) & (x != y)
        q, v = q[exact], v[exact]
        same = home[q] == home[v]
        pairs = np.unique(np.sort(np.stack([q[same], v[same]], axis=1), axis=1), axis=0)  # found from either side
        total = np.bincount(pairs[:, 0], weight[pairs[:, 1]], len(nodes)) + np.bincount(pairs[:, 1], weight[pairs[:, 0]], len(nodes))
        root = np.arange(len(nodes))
        x, y = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        while True:  # the least id each vector reaches within the shard
            low = nodes[root].copy()
            np.minimum.at(low, x, nodes[root[y]])
            new = order[np.searchsorted(nodes, low, sorter=order)]
            if (new == root).all():
                break
            root = new
        own, cross = np.flatnonzero(primary), ~same
        a, b = nodes[q[cross]], nodes[v[cross]]
        parts = [
            (nodes[own], nodes[root[own]], total[own].astype(np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), bool)),
            (np.minimum(a, b), np.maximum(a, b), np.where(a < b, weight[v[cross]], weight[q[cross]]), np.where(a < b, weight[q[cross]], weight[v[cross]]), np.ones(len(a), bool)),
        ]
        return pa.table({n: pa.array(np.concatenate(c), t) for n, c, t in zip(("a", "b", "add_a", "add_b", "across"), zip(*parts, strict=True), [pa.int64()] * 4 + [pa.bool_()], strict=True)})

    return search


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The rows of each (label, size) of a batch."""
    places: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(batch["label"].to_pylist(), batch["size"].to_pylist(), strict=True)):
        places.setdefault(key, []).append(i)
    for key, at in places.items():
        yield key, batch.take(pa.array(at, pa.int64()))


def _assign(centers: dict[tuple[str, int], np.ndarray], overlap: int):
    """Shards are numbered inside (label, size); one without centroids has a single shard."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single = []
            for key, own in _groups(batch):
                held = centers.get(key)
                if held is None:
                    single.append(own)
                    continue
                near = np.argsort(-(unit(matrix(own["vector"])) @ held.T), axis=1, kind="stable")[:, :overlap]
                for rank in range(near.shape[1]):
                    yield dealt(own, near[:, rank], near[:, 0], rank == 0)
            if single:
                rows = pa.Table.from_batches(single).combine_chunks().to_batches()
                yield from (dealt(own, *[np.zeros(own.num_rows, np.int64)] * 2, True) for own in rows)

    def dealt(own: pa.RecordBatch, shard: np.ndarray, home: np.ndarray, primary: bool) -> pa.RecordBatch:
        out = own.select(["label", "size", "node", "weight", "vector"]).append_column("shard", pa.array(shard, pa.int32()))
        return out.append_column("home", pa.array(home, pa.int32())).append_column("primary", pa.array(np.full(own.num_rows, primary)))

    return assign


def _nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All vectors with their node (least id of those equal to it; null if it can link with nothing), and the nodes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for label, values in zip(batch["label"].to_pylist(), batch["values"].to_pylist(), strict=True):
                good = label is not None and values and None not in values
                row = np.array(values, np.float64) + 0.0 if good else None
                packed.append(row.tobytes() if good and np.isfinite(row).all() and row.any() else None)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(packed, pa.binary())], names=["vec_id", "label", "vector"])

    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("values"))
    rows = common.stored(rows.mapInArrow(pack, "vec_id long, label string, vector binary"), "vectors")
    good = rows.where("vector IS NOT NULL AND vec_id IS NOT NULL")
    # vectors of another length can't be compared, so the length is part of what a shard has in common
    nodes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    return rows, common.stored(nodes.withColumn("size", F.length("vector")), "nodes")


def link(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """Links between vectors of one label with a cosine of at least ``threshold``, and the audit.

    The first result has one row per input row: vec_id, n_links, component_id (least id reachable), kept (it is that
    id). Vectors that are null, zero or hold null or non-finite components, and those with a null label or id, link with
    nothing and are their own component. Equal vectors of one label are one node and count as linked with each other;
    vectors of different lengths are never compared. Repeated ids are vectors of their own under one name. An empty
    table gives an empty result. The second result is one row: audited queries, true links, found links, recall.

    Labels are compared as text. A recall under RECALL at the widest overlap is logged as a warning.

    The driver holds sizes and centroids of labels of more than one shard only: one per SHARD distinct vectors, fitted on FITTED
    times as many of the label's vectors and at most about SAMPLE, so there are no more centroids than that.
    """
    spark = vectors.sparkSession
    rows, nodes = _nodes(vectors, id_col, vector_col, label_col)
    split = {(r["label"], r["size"]): r["n"] for r in nodes.groupBy("label", "size").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).collect()}
    counts = {key: -(-n // SHARD) for key, n in split.items()}
    held: dict[tuple[str, int], list[bytes]] = {key: [] for key in split}
    if split:
        shares = [(*key, 1_000_000 * min(SAMPLE, FITTED * counts[key]) // n + 1) for key, n in split.items()]
        drawn = nodes.join(F.broadcast(spark.createDataFrame(shares, "label string, size int, share long")), ["label", "size"])
        drawn = drawn.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < F.col("share"))
        for r in drawn.select("label", "size", "vector", "node").orderBy("label", "size", "node").collect():
            held[r["label"], r["size"]].append(r["vector"])
    centers = {key: centroids(unit(matrix(pa.array(own, pa.binary()))), counts[key]) for key, own in held.items() if own}
    widest = max(map(len, centers.values()), default=1)
    while True:
        found, across = _linked(nodes, centers, overlap, threshold)
        totals = found.select(F.col("a").alias("node"), F.col("add_a").alias("n")).unionAll(
            across.select(F.col("a").alias("node"), F.col("add_a").alias("n"))).unionAll(across.select(F.col("b").alias("node"), F.col("add_b").alias("n")))
        totals = common.stored(totals.groupBy("node").agg(F.sum("n").alias("others")), "link-counts")
        report = audit(nodes, totals, threshold)
        if report["recall"] >= RECALL:
            break
        if overlap >= widest:
            LOG.warning("the audit found %.4f of the links, less than %.2f, with each shard as wide as its label", report["recall"], RECALL)
            break
        overlap *= 2
    labels = components(found.select("a", "b").unionAll(across.select("a", "b")))
    per_node = nodes.join(totals, "node", "left").join(labels, "node", "left").select(
        "node", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    names = common.stored(rows.where("vector IS NOT NULL AND vec_id IS NOT NULL").groupBy("label", "vector").agg(F.min("vec_id").alias("node")), "names")
    with_node = rows.where("vector IS NOT NULL AND vec_id IS NOT NULL").join(names, ["label", "vector"]).select("vec_id", "node")
    out = with_node.join(per_node, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return out, spark.createDataFrame([tuple(report.values())], "queries long, true_links long, found_links long, recall double")


def _linked(nodes: DataFrame, centers: dict[tuple[str, int], np.ndarray], overlap: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    kind = "label string, size int, node long, weight long, vector binary, shard int, home int, primary boolean"
    dealt = nodes.select("label", "size", "node", "weight", "vector").mapInArrow(_assign(centers, overlap), kind)
    dealt, own = common.stored(dealt, "shards"), ["label", "size", "shard"]
    lists = dealt.select(*own, "node", "vector").groupBy(*own).applyInArrow(_build, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    ready = dealt.join(united, "node")
    found = ready.groupBy(*own).applyInArrow(_search(threshold), "a long, b long, add_a long, add_b long, across boolean")
    found = common.stored(found, "vector-links")
    return found.where("NOT across"), common.stored(found.where("across").distinct(), "across-links")


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, queries: int = AUDITED) -> dict:
    """Found links of a bounded sample of nodes against brute force over all nodes of their label."""
    picked = nodes.orderBy(F.xxhash64("node"), "node").limit(queries).select("node", "label", "size", "vector", "weight").collect()
    by_label: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for label in {(r["label"], r["size"]) for r in picked}:
        own = [r for r in picked if (r["label"], r["size"]) == label]
        by_label[label] = np.array([r["node"] for r in own]), matrix(pa.array([r["vector"] for r in own], pa.binary()))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, own in _groups(batch):
                if label not in by_label:
                    continue
                names, queries_ = by_label[label]
                near = unit(matrix(own["vector"])) @ unit(queries_).T >= threshold
                near &= np.asarray(own["node"])[:, None] != names[None]
                total = (near * np.asarray(own["weight"])[:, None]).sum(axis=0)
                yield pa.RecordBatch.from_pydict({"node": pa.array(names, pa.int64()), "n": pa.array(total, pa.int64())})

    if not picked:
        return {"queries": 0, "true_links": 0, "found_links": 0, "recall": 1.0}
    true = nodes.select("node", "label", "size", "vector", "weight").mapInArrow(brute, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    row = true.join(counts, "node", "left").agg(F.count("*").alias("q"), F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("others", F.lit(0)))).alias("found")).first()
    return {"queries": int(row["q"]), "true_links": int(row["n"]), "found_links": int(row["found"]), "recall": 1.0 if not row["n"] else row["found"] / row["n"]}


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.documents(spark, sf_dir, "embeddings"))[0].select("vec_id", "n_links", "component_id", "kept")


SQL = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS MATERIALIZED (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
  AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
