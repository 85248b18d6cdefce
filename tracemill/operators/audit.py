"""Hash-chained audit log: build and check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.skew import stage

GENESIS = "0" * 64


def entry_hash() -> Column:
    """sha256 of the entry as JSON with sorted keys; ``payload_json`` is already in that form."""
    def quoted(name: str) -> Column:
        # JSON text of a one-field object without its braces and with Python's space after the colon.
        inner = F.regexp_replace(F.to_json(F.struct(F.col(name).cast("string").alias(name))), r"^\{|\}$", "")
        return F.regexp_replace(inner, '^"' + name + '":', '"' + name + '": ')

    body = F.concat(
        F.lit("{"), quoted("entry_id"), F.lit(", "), quoted("event_type"), F.lit(", "), quoted("patient_id"),
        F.lit(', "payload": '), "payload_json", F.lit(", "), quoted("requester_id"),
        F.lit(', "sequence": '), F.col("sequence").cast("string"), F.lit("}"),
    )
    return F.sha2(body, 256)


def chain(log: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Add content, previous and chain hash: one chain per patient, in the order of ``sequence``.

    Content hashes are native and parallel. A chain is serial by nature, so one task walks a patient's entries in order;
    only digests go through it, batch by batch, and nothing but the last hash is kept. ``heads`` (see
    :func:`chain_heads`) are the ends of what is stored: a new batch continues there and costs its own entries only.
    ``sequence`` is dense per patient and goes on from its head.
    """
    hashed = log.withColumn("content_hash", entry_hash())
    digests = hashed.select("patient_id", "sequence", "content_hash")
    if heads is None:
        digests = digests.withColumn("seed", F.lit(GENESIS))
    else:
        ends = heads.select("patient_id", F.col("head").alias("seed"))
        digests = digests.join(ends, "patient_id", "left").withColumn("seed", F.coalesce("seed", F.lit(GENESIS)))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patient, previous = None, None
        for batch in batches:
            before, after = [], []
            for name, content, seed in zip(*[batch[c].to_pylist() for c in ("patient_id", "content_hash", "seed")], strict=True):
                if previous is None or name != patient:
                    patient, previous = name, seed
                before.append(previous)
                previous = hashlib.sha256((content + previous).encode()).hexdigest()
                after.append(previous)
            yield pa.RecordBatch.from_arrays(
                [batch["patient_id"], batch["sequence"], pa.array(before, pa.string()), pa.array(after, pa.string())],
                names=["patient_id", "sequence", "prev_hash", "chain_hash"],
            )

    kinds = dict(digests.dtypes)
    schema = f"patient_id {kinds['patient_id']}, sequence {kinds['sequence']}, prev_hash string, chain_hash string"
    links = digests.repartition("patient_id").sortWithinPartitions("patient_id", "sequence").mapInArrow(link, schema)
    return hashed.join(links, ["patient_id", "sequence"]).select(*hashed.columns, "prev_hash", "chain_hash")


def chain_heads(chained: DataFrame) -> DataFrame:
    """The end of each patient's chain: patient_id, sequence, head, and a seal over the head."""
    heads = chained.groupBy("patient_id").agg(F.max("sequence").alias("sequence"), F.max_by("chain_hash", "sequence").alias("head"))
    return heads.withColumn("heads_hash", F.sha2(F.concat("head", F.lit(GENESIS)), 256))


def verify_chain(log: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Violations (patient_id, sequence, kind): content hash, chain hash, previous hash, missing tail, changed head.

    Each entry is checked against the stored chain hash of the entry before it (an equi join on the sequence), so no task
    reads a whole chain. Only entry 1 may follow nothing, so a missing entry or run breaks the next one. With ``heads``
    the end of each chain must be there too: a deleted tail, or a patient deleted whole, is reported at its last entry.
    """
    earlier = log.select("patient_id", (F.col("sequence") + 1).alias("sequence"), F.col("chain_hash").alias("_stored"))
    joined = log.join(earlier, ["patient_id", "sequence"], "left").withColumn(
        "_prev", F.when(F.col("sequence") == 1, F.lit(GENESIS)).otherwise(F.coalesce("_stored", F.lit("")))
    ).withColumn("_content", entry_hash())
    kinds = F.array_compact(F.array(
        F.when(F.col("content_hash") != F.col("_content"), "content hash mismatch"),
        F.when(F.col("chain_hash") != F.sha2(F.concat("_content", "_prev"), 256), "chain hash broken"),
        F.when(F.col("prev_hash") != F.col("_prev"), "prev hash mismatch"),
    ))
    found = joined.select("patient_id", "sequence", F.explode(kinds).alias("kind"))
    if heads is None:
        return found
    ends = heads.select("patient_id", "sequence", "head").join(log.select("patient_id", "sequence", "chain_hash"), ["patient_id", "sequence"], "left")
    kind = F.when(F.col("chain_hash").isNull(), "tail missing").when(F.col("chain_hash") != F.col("head"), "head mismatch")
    return found.unionAll(ends.select("patient_id", "sequence", kind.alias("kind")).where("kind IS NOT NULL"))


def merkle_tree(heads: DataFrame, depth: int = 4) -> DataFrame:
    """(level, node, hash): one tree over the heads of all patients; its root seals the whole log.

    A patient lies under the first hex digits of the sha256 of its id: ``depth`` digits name a lowest node, each level up
    drops one, the root is the empty name on level 0. Nodes hash their sorted content, so the tree does not hang on row
    order. A lowest node holds 1 / 16^depth of the patients; see :func:`merkle_depth`. No heads, no nodes.
    """
    low = _leaves(heads, depth).groupBy("node").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("key", "leaf"))), ""), 256).alias("hash"))
    level = stage(low)
    tree = level.select(F.lit(depth).alias("level"), "node", "hash")
    for up in range(depth - 1, -1, -1):
        parts = F.array_sort(F.collect_list(F.concat("node", "hash")))
        level = level.groupBy(F.substring("node", 1, up).alias("parent")).agg(F.sha2(F.array_join(parts, ""), 256).alias("hash")).withColumnRenamed("parent", "node")
        tree = tree.unionAll(level.select(F.lit(up).alias("level"), "node", "hash"))
    return tree


def merkle_depth(heads: DataFrame, per_node: int = 64) -> int:
    """Levels at which a lowest node has some ``per_node`` patients. Trees are compared at the depth of the older one."""
    nodes, depth = heads.count() / per_node, 1
    while 16 ** depth < nodes:
        depth += 1
    return depth


def _leaves(heads: DataFrame, depth: int) -> DataFrame:
    key = F.sha2(F.col("patient_id").cast("string"), 256)
    leaf = F.sha2(F.concat_ws("|", F.col("patient_id").cast("string"), F.col("sequence").cast("string"), "head"), 256)
    return heads.select("patient_id", key.alias("key"), F.substring(key, 1, depth).alias("node"), leaf.alias("leaf"))


def changed_patients(tree: DataFrame, heads: DataFrame, tree_now: DataFrame, heads_now: DataFrame, depth: int = 4) -> DataFrame:
    """(patient_id, kind) of patients whose head changed, that are missing or that are new since ``tree`` was stored.

    The trees are walked from the root: each level looks only under nodes that differ, and only patients of differing
    lowest nodes are compared. Equal roots end the walk at once. ``heads`` may be null when only the old tree was kept:
    all patients of now under the differing nodes are then reported as "suspect".
    """
    under = None
    for level in range(depth + 1):
        sides = [t.where(F.col("level") == level).select("node", "hash") for t in (tree, tree_now)]
        if under is not None:
            parents = under.withColumnRenamed("node", "parent")
            sides = [s.withColumn("parent", F.substring("node", 1, level - 1)).join(parents, "parent", "left_semi").drop("parent") for s in sides]
        old, now = sides
        joined = old.withColumnRenamed("hash", "old").join(now, "node", "full")
        under = stage(joined.where(~F.col("old").eqNullSafe(F.col("hash"))).select("node"))
        if under.isEmpty():
            break
    current = _leaves(heads_now, depth).join(under, "node", "left_semi").select("patient_id", "leaf")
    if heads is None:
        return current.select("patient_id", F.lit("suspect").alias("kind"))
    stored = _leaves(heads, depth).join(under, "node", "left_semi").select("patient_id", F.col("leaf").alias("stored"))
    kind = F.when(F.col("leaf").isNull(), "missing").when(F.col("stored").isNull(), "new").when(F.col("leaf") != F.col("stored"), "changed")
    return stored.join(current, "patient_id", "full").select("patient_id", kind.alias("kind")).where("kind IS NOT NULL")


def list_entries(log: DataFrame, patient=None, limit: int = 100) -> DataFrame:
    """Newest entries with a shortened chain hash."""
    rows = log.where(F.col("patient_id") == patient) if patient is not None else log
    short = F.concat(F.substring("chain_hash", 1, 16), F.lit("..."))
    return rows.withColumn("chain_hash", short).orderBy(F.col("sequence").desc(), F.col("entry_id")).limit(limit)
