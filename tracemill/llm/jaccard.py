"""N-gram Jaccard join with token-combination prefixes.

The elements of a document are its distinct shingles, ordered from rare to frequent. Two similar documents share at
least one element in their prefixes; extending a prefix by one element for each class of frequent elements in it makes
them share a rare element or two elements of one class. Rare elements are indexed one by one, frequent ones by pairs
within their class, so no index key of a frequent element alone exists, except for short sets (under SMALL elements, or
with a needed overlap under SMALL): they index every element of their prefix alone. Documents with equal sets are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracemill.llm import common, hashcount, memory, words
from tracemill.llm.components import components

SHINGLE = 5
PERCENT = 75
#: Elements in more documents than this are frequent: they are indexed in pairs.
RARE = 64
#: Sets of fewer elements index all of them alone; from here on each fourfold size has its own number of classes.
SMALL = 48


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of the distinct shingles, sorted by both; a short text has its whole sequence as one."""
    owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        for begin, end in words.blocks(texts):
            data, offsets = words.flat_bytes(texts[begin:end])
            data = words.LOWER_ASCII[data]
            starts, ends, bounds = words.spans(data, offsets, words.NOT_SPACE)
            word = words.word_hashes(data, starts, ends)
            owner, counts = words.owners(bounds), np.diff(bounds)
            for width in range(1, size + 1):
                window = words.window_hashes(word, width)
                if not len(window):
                    continue
                if width == size:
                    at = np.flatnonzero(owner[:len(window)] == owner[width - 1:])
                else:
                    at = bounds[:-1][counts == width]
                who, value = owner[at], window[at]
                order = np.lexsort((value, who))
                who, value = who[order], value[order]
                new = np.concatenate([[True], (value[1:] != value[:-1]) | (who[1:] != who[:-1])])[:len(who)]
                owners.append(who[new] + begin)
                hashes.append(value[new])
    owner, value = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((value, owner))
    return owner[order], value[order]


def _level(n: int) -> int:
    level = 0
    while n >= SMALL << (2 * level):
        level += 1
    return level


def prefix_keys(values: np.ndarray, totals: np.ndarray, percent: int = PERCENT, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set (``values`` with the number of documents that hold each) and what each key bounds.

    Elements of a single document can't be shared and give no key. For two sets with at least ``percent`` similarity
    some key is equal: they meet at the level of the smaller set, which the larger one also serves. If a key is the
    first that two sets share, their overlap is at most its bound: the elements from its place on, and one of each
    frequent class before it. So a pair may be dropped at a key whose bound is too low; if it is similar, it is kept at
    its first shared key.
    """
    n = len(values)
    need = -(-percent * n // 100)
    order = np.lexsort((values, totals))
    values, totals = values[order], totals[order]
    frequent = totals > rare
    keys, bounds = [], []

    def single(length: int, chosen: np.ndarray) -> None:
        at = np.flatnonzero(chosen[:length] & (totals[:length] > 1))
        keys.append(words.mix(values[at]))
        bounds.append(n - at)

    for level in sorted({_level(n), _level(need)}):
        if level == 0 or not frequent.any():
            single(n - need + 1, np.ones(n, bool))
            continue
        classes = np.uint64((SMALL << (2 * (level - 1))) // 4)
        kind = np.where(frequent, (values % classes).astype(np.int64), -1)
        new = np.zeros(n, np.int64)
        places = np.flatnonzero(frequent)
        new[places[np.unique(kind[places], return_index=True)[1]]] = 1
        seen = np.cumsum(new)
        length = int(np.searchsorted(np.arange(1, n + 1) - seen, n - need + 1)) + 1
        single(length, ~frequent)
        places = np.flatnonzero(frequent[:length])
        places = places[np.lexsort((places, kind[places]))]
        for group in np.split(places, np.flatnonzero(np.diff(kind[places])) + 1):
            i, j = np.triu_indices(len(group), 1)
            first, second = group[i], group[j]
            keys.append(words.mix(words.mix(values[first]) * np.uint64(3) + values[second] + classes))
            bounds.append(n - first + seen[first] - 1)
    keys, bounds = np.concatenate(keys), np.concatenate(bounds)
    order = np.lexsort((-bounds, keys))
    keys, bounds = keys[order], bounds[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)]
    return keys[first], np.minimum(bounds[first], int((totals > 1).sum()))


def _send(size: int, ranges: int):
    def send(table: pa.Table) -> pa.Table:
        _, hashes = shingle_sets(table["text"].combine_chunks(), size)
        distinct, counts = np.unique(hashes, return_counts=True)
        return hashcount.pack(table["slot"][0].as_py(), distinct, counts, ranges, np.uint32)

    return send


def _index(size: int, percent: int, rare: int, ranges: int, schema: pa.Schema):
    def index(table: pa.Table, answer: pa.Table) -> pa.Table:
        owner, hashes = shingle_sets(table["text"].combine_chunks(), size)
        distinct, back = np.unique(hashes, return_inverse=True)
        totals = hashcount.unpack(answer, distinct, ranges, totals=True)[back]
        bounds = np.searchsorted(owner, np.arange(table.num_rows + 1))
        ids = table["doc_id"].to_pylist()
        sets, keys, bound, first, second = [], [], [], [], []
        with np.errstate(over="ignore"):
            mixed = words.mix(hashes)
            again = words.mix(mixed + np.uint64(1))
            for i in range(table.num_rows):
                a, b = bounds[i], bounds[i + 1]
                shared = ids[i] is not None and (totals[a:b] > 1).any()
                found, most = prefix_keys(hashes[a:b], totals[a:b], percent, rare) if shared else ([], [])
                sets.append(hashes[a:b].tobytes() if len(found) else None)
                keys.append(found.view(np.int64) if len(found) else None)
                bound.append(most if len(found) else None)
                first.append(int(mixed[a:b].sum().view(np.int64)) if len(found) else None)
                second.append(int(again[a:b].sum().view(np.int64)) if len(found) else None)
        made = {"doc_id": ids, "n_shingles": np.diff(bounds), "elements": sets, "keys": keys, "bounds": bound, "first": first, "second": second}
        if "payload" in table.column_names:
            made["payload"] = table["payload"]
        arrays = [made[f.name].cast(f.type) if isinstance(made[f.name], pa.ChunkedArray) else pa.array(made[f.name], f.type) for f in schema]
        return pa.Table.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays], schema=schema)

    return index


def _similar(percent: int):
    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return similar


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(memory.bounded("jaccard", _similar(percent)), "a long, b long")


def link_nodes(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of sets ``rows`` (node, n, elements, keys, bounds), one per distinct set, for nodes with links.

    First every index key names one of its nodes as pivot, the one of which most can be shared, and the others are
    checked against it: as many checks as index rows, however many nodes share the key. Nodes that are connected by then
    are never compared. What is still apart under a key is compared across components, without the nodes that no other
    node of the key can match: the key's bound on the overlap (``shared``) bounds the size of a partner (``most``).
    """
    def possible(n: str, shared: str, m: str, other: str):
        both = F.least(F.col(shared), F.col(other))
        return 100 * both >= percent * (F.col(n) + F.col(m) - both)

    def ordered(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    most = F.floor(F.col("shared") * (100 + percent) / percent).cast("long") - F.col("n")
    index = rows.select("node", "n", F.explode(F.arrays_zip("keys", "bounds")).alias("at"))
    index = index.select("node", "n", F.col("at.bounds").alias("shared"), F.col("at.keys").alias("key")).withColumn("most", most)
    several = index.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max(F.struct(F.col("shared") / F.col("n"), "n", "node", "shared")).alias("pivot"))
    index = common.stored(index.join(several.where("low <> high").select("key", "pivot"), "key"), "index")
    sets = rows.select("node", "elements")
    star = index.where(F.col("node") != F.col("pivot.node")).where(possible("n", "shared", "pivot.n", "pivot.shared"))
    star = star.select(*ordered("node", "pivot.node")).distinct()
    links = common.stored(_verified(star, sets, percent), "links")
    labels = components(links)
    placed = index.drop("pivot").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    for _ in range(2):
        bounds = placed.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least_n"), F.max("most").alias("best"),
        ).where("low <> high")
        placed = placed.join(bounds, "key").where("most >= least_n AND n <= best").drop("low", "high", "least_n", "best")
    placed = common.stored(placed, "apart")
    other = placed.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "shared", "component")])
    pairs = placed.join(other, "key").where("component < component_b").where(possible("n", "shared", "n_b", "shared_b"))
    more = common.stored(_verified(pairs.select(*ordered("node", "node_b")).distinct(), sets, percent), "links")
    return labels if more.isEmpty() else components(links.unionAll(more))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, rare: int = RARE, carry: list[str] | None = None) -> DataFrame:
    """Connect documents whose sets of ``size``-word shingles have a Jaccard similarity of at least ``percent``.

    Text is lower-cased (A-Z); words are runs of characters other than ASCII white space. A text of fewer words has its
    whole sequence as its one element; a null text, or one without words, has none and is linked with nothing. Returns
    one row per input row: doc_id, n_shingles, class_id (smallest id with the same set), component_id (smallest id
    reachable over links), and the ``carry`` columns.

    Rows with a null id are linked with nothing and have null class and component. Rows that repeat an id are texts of
    their own which share a name. An empty table gives an empty result. Elements are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    ranges = common.partitions(spark)
    slots = common.slotted(common.texts_of(docs, id_col, text_col, carry), ranges)
    sent = slots.groupBy("slot").applyInArrow(memory.bounded("jaccard", _send(size, ranges)), hashcount.SENT)
    answers = hashcount.repeated(sent, ranges, np.uint32, totals=True)
    schema = StructType.fromDDL("n_shingles long, elements binary, keys array<long>, bounds array<long>, first long, second long")
    schema = StructType([slots.schema["doc_id"], *schema.fields, *([slots.schema["payload"]] if carry else [])])
    index = _index(size, percent, rare, ranges, to_arrow_schema(schema))
    rows = common.stored(slots.groupBy("slot").cogroup(answers.groupBy("slot")).applyInArrow(memory.bounded("jaccard", index), schema), "sets")
    keyed = rows.where("keys IS NOT NULL")
    one = ["first", "second", "n_shingles"]
    classes = common.stored(keyed.groupBy(*one).agg(F.min("doc_id").alias("class_id")), "classes")
    nodes = keyed.join(classes, one).where("doc_id = class_id").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "elements", "keys", "bounds")
    labels = link_nodes(common.stored(nodes, "nodes"), percent)
    labels = classes.join(labels, F.col("class_id") == F.col("node"), "left").select(*one, "class_id", F.coalesce("component", "class_id").alias("component_id"))
    rest = ["payload"] if carry else []
    found = keyed.join(labels, one).select("doc_id", "n_shingles", "class_id", "component_id", *rest)
    alone = rows.where("keys IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), *rest)
    out = found.unionAll(alone)
    return common.uncarried(out, carry) if carry else out


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= {PERCENT} * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
