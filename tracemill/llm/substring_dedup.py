"""Substring dedup: Rabin-Karp hashes of every window of words, counted over the collection; repeated windows are removed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracemill.llm import common, hashcount, memory, words

WIDTH = 35


def _windows(texts: pa.Array, width: int):
    """Per block of texts: first text, word bounds, number of each window's first word, hash of each window."""
    with np.errstate(over="ignore"):
        for begin, end in words.blocks(texts):
            data, offsets = words.flat_bytes(texts[begin:end])
            starts, ends, bounds = words.spans(data, offsets, words.NOT_SPACE)
            hashes = words.window_hashes(words.word_hashes(data, starts, ends), width)
            owner = words.owners(bounds)
            at = np.flatnonzero(owner[:len(hashes)] == owner[width - 1:]) if len(hashes) else np.zeros(0, np.int64)
            yield begin, bounds, at, hashes[at]


def _send(width: int, ranges: int):
    def send(table: pa.Table) -> pa.Table:
        found = [h for _, _, _, h in _windows(table["text"].combine_chunks(), width)]
        distinct, counts = np.unique(np.concatenate(found), return_counts=True)
        return hashcount.pack(table["slot"][0].as_py(), distinct, counts, ranges, np.uint64)

    return send


def _cut(text: str | None, covered: np.ndarray) -> tuple[str, list[list[int]]]:
    """Kept words joined by one space, and the removal intervals as [first word, word after the last]."""
    tokens = (text or "").encode().split()
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    kept, at = [], 0
    for first, after in edges.reshape(-1, 2):
        kept += tokens[at:first]
        at = after
    return b" ".join(kept + tokens[at:]).decode(), edges.reshape(-1, 2).tolist()


def _remove(width: int, ranges: int, schema: pa.Schema):
    def remove(table: pa.Table, answer: pa.Table) -> pa.Table:
        texts = table["text"].combine_chunks()
        parts = list(_windows(texts, width))
        hashes = np.concatenate([p[3] for p in parts] or [np.zeros(0, np.uint64)])
        distinct, back = np.unique(hashes, return_inverse=True)
        again = hashcount.unpack(answer, distinct, ranges)[back] > 1
        n_words, n_removed, kept, cuts, done = [], [], [], [], 0
        for begin, bounds, at, own in parts:
            first = at[again[done:done + len(own)]]
            done += len(own)
            change = np.bincount(first, minlength=bounds[-1] + 1) - np.bincount(first + width, minlength=bounds[-1] + 1)
            covered = np.cumsum(change)[:bounds[-1]] > 0
            for i in range(len(bounds) - 1):
                mask = covered[bounds[i]:bounds[i + 1]]
                text, edges = _cut(texts[begin + i].as_py(), mask)
                n_words.append(len(mask))
                n_removed.append(int(mask.sum()))
                kept.append(text)
                cuts.append(edges)
        made = {
            "doc_id": table["doc_id"], "text": kept, "n_words": n_words, "n_removed": n_removed, "removed": cuts,
            "kept_sha256": [hashlib.sha256(k.encode()).hexdigest() for k in kept],
        } | ({"payload": table["payload"]} if "payload" in table.column_names else {})
        return pa.Table.from_arrays([_as(made[f.name], f.type) for f in schema], schema=schema)

    return remove


def _as(values, kind: pa.DataType):
    return values.cast(kind) if isinstance(values, pa.ChunkedArray) else pa.array(values, kind)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, carry: list[str] | None = None) -> DataFrame:
    """Remove every word that a repeated window of ``width`` words covers.

    Words are runs of characters other than ASCII white space. A window is repeated if the same words start anywhere
    else, in the same text or another; all windows are judged on the input. Repeated windows that overlap or touch merge
    into one maximal interval. Returns one row per input row: doc_id, text (kept words joined by one space), n_words,
    n_removed, removed (intervals of word numbers, end exclusive), kept_sha256, and the ``carry`` columns.

    A null or empty text, or one of fewer words than ``width``, has no window and loses nothing (null gives an empty
    text). Repeated rows count as texts of their own, so each is cut against the other; null ids are kept. An empty
    table gives an empty result. Equality of windows is that of their 64-bit hashes.
    """
    spark = docs.sparkSession
    ranges = common.partitions(spark)
    slots = common.slotted(common.texts_of(docs, id_col, text_col, carry), ranges)
    answers = hashcount.repeated(slots.groupBy("slot").applyInArrow(memory.bounded("substrings", _send(width, ranges)), hashcount.SENT), ranges)
    schema = StructType.fromDDL("text string, n_words long, n_removed long, removed array<array<int>>, kept_sha256 string")
    schema = StructType([slots.schema["doc_id"], *schema.fields, *([slots.schema["payload"]] if carry else [])])
    arrow = to_arrow_schema(schema)
    out = slots.groupBy("slot").cogroup(answers.groupBy("slot")).applyInArrow(memory.bounded("substrings", _remove(width, ranges, arrow)), schema)
    return common.uncarried(out, carry) if carry else out


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WIDTH - 1}], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM w)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS p FROM win WHERE h IN (SELECT h FROM rep)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY word.p) AS t
         FROM word LEFT JOIN cov ON word.doc_id = cov.doc_id AND word.p = cov.p WHERE cov.p IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
