"""Benchmark decontamination over a positional inverted index of the training tokens.

The index is cut by documents: a segment holds some megabytes of text as one row, with the sorted terms of its tokens,
their posting lists (token positions, ascending) and the word bounds of its documents. A query intersects the lists of
a phrase's terms within each segment, moved by their offsets, from the term that is rarest in the whole collection on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from tracemill.llm import common, memory, words

WINDOW = 13
#: Hit words from this share of all words on make a document contaminated: 20 * hits >= words.
SHARE = 20
#: Characters of benchmark text handed to the tasks at once; more items are searched in several passes over the index.
PASS_CHARS = 4_000_000
SEGMENT = "docs array<long>, bounds binary, terms binary, starts binary, positions binary"


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), and for each text the number of words before it."""
    with np.errstate(over="ignore"):
        data, offsets = words.flat_bytes(texts)
        data = words.LOWER_ASCII[data]
        starts, ends, bounds = words.spans(data, offsets, words.ALNUM)
        return words.word_hashes(data, starts, ends), bounds


def _segments(carry: bool, schema: pa.Schema):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            for begin, end in words.blocks(texts):
                tokens, bounds = _terms(texts[begin:end])
                order = np.argsort(tokens, kind="stable").astype(np.uint32)
                ordered = tokens[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[:len(ordered)]).astype(np.uint32)
                row = [
                    pa.array([batch["doc_id"][begin:end].to_pylist()], pa.list_(pa.int64())), pa.array([bounds.astype(np.uint32).tobytes()]),
                    pa.array([ordered[first].tobytes()]), pa.array([np.append(first, np.uint32(len(ordered))).tobytes()]), pa.array([order.tobytes()]),
                ]
                if carry:
                    kind = schema.field("payload").type
                    row.append(pa.ListArray.from_arrays(pa.array([0, end - begin], pa.int32()), batch["payload"][begin:end].cast(kind.value_type)).cast(kind))
                yield pa.RecordBatch.from_arrays(row, schema=schema)

    return build


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The positional index of all tokens, written to the shared folder: one row per segment of about two megabytes."""
    texts = common.texts_of(docs, id_col, text_col, carry)
    schema = StructType.fromDDL(SEGMENT)
    if carry:
        schema = schema.add("payload", ArrayType(texts.schema["payload"].dataType))
    return common.stored(texts.mapInArrow(memory.bounded("contamination", _segments(bool(carry), to_arrow_schema(schema))), schema), "index")


def item_parts(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Item ids as text with the term hashes of their words, at most about PASS_CHARS characters a part."""
    rows = items.select(items[id_col].cast("string").alias("item_id"), items[text_col].alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-int(size) // PASS_CHARS))
    for part in range(parts):
        held = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        tokens, bounds = _terms(pa.array([r["text"] for r in held], pa.string()))
        yield [(r["item_id"], tokens[a:b]) for r, a, b in zip(held, bounds[:-1], bounds[1:], strict=True) if b > a]


class Phrases:
    """Distinct phrases of the items, and the items of each."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        found: dict[bytes, set[str]] = {}
        for item, tokens in items:
            width = min(window, len(tokens))
            for i in range(len(tokens) - width + 1):
                found.setdefault(tokens[i:i + width].tobytes(), set()).add(item)
        self.terms = [np.frombuffer(p, np.uint64) for p in found]
        self.items = [sorted(x) for x in found.values()]
        self.vocabulary = np.unique(np.concatenate(self.terms)) if found else np.zeros(0, np.uint64)
        self.frequency = np.zeros(len(self.vocabulary), np.int64)

    def count(self, index: DataFrame) -> None:
        """Occurrences of each benchmark term in the whole index; one row per task and term is shuffled."""
        vocabulary = self.vocabulary

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(vocabulary), np.int64)
            for batch in batches:
                for terms, starts in zip(batch["terms"], batch["starts"], strict=True):
                    terms, starts = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(starts.as_buffer(), np.uint32)
                    at, known = _find(terms, vocabulary)
                    total[known] += np.diff(starts.astype(np.int64))[at[known]]
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"term": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

        for row in index.select("terms", "starts").mapInArrow(partial, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            self.frequency[row["term"]] = row["n"]


def _find(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in a sorted array, and which of them are there."""
    if not len(ordered):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return at, ordered[at] == wanted


def phrase_starts(lists: dict[int, np.ndarray], terms: list[int], order: list[int], slack: int = 0) -> np.ndarray:
    """Positions where a phrase may begin: lists moved by their offsets, intersected in the given order of places.

    With ``slack`` a term may stand up to that many words from its place (a proximity match).
    """
    starts = lists[terms[order[0]]].astype(np.int64) - order[0]
    for place in order[1:]:
        if not len(starts):
            break
        there = lists[terms[place]].astype(np.int64)
        want = starts + place
        at = np.searchsorted(there, want - slack)
        near = there[np.minimum(at, len(there) - 1)]
        starts = starts[(at < len(there)) & (near <= want + slack)]
    return starts


def _search(phrases: Phrases, slack: int):
    """Add the hits of the phrases to each segment's ``mask`` (one bit per token) and ``found`` (items of each document)."""
    rank = {int(t): int(n) for t, n in zip(phrases.vocabulary, phrases.frequency, strict=True)}
    by_rarest: dict[int, list] = {}
    for number, terms in enumerate(phrases.terms):
        terms = [int(t) for t in terms]
        if all(rank[t] for t in terms):
            order = sorted(range(len(terms)), key=lambda i, terms=terms: (rank[terms[i]], i))
            by_rarest.setdefault(terms[order[0]], []).append((terms, order, number))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, all_found = [], []
            for row in range(batch.num_rows):
                bounds, terms, starts, positions, mask = (
                    np.frombuffer(batch[c][row].as_buffer(), t)
                    for c, t in (("bounds", np.uint32), ("terms", np.uint64), ("starts", np.uint32), ("positions", np.uint32), ("mask", np.uint8))
                )
                at, known = _find(terms, phrases.vocabulary)
                lists = {int(t): positions[starts[i]:starts[i + 1]] for t, i in zip(phrases.vocabulary[known], at[known], strict=True)}
                items = [set(x) for x in batch["found"][row].as_py()]
                change = np.zeros(len(positions) + 1, np.int64)
                for wanted, order, number in (plan for term in lists for plan in by_rarest.get(term, ())):
                    if not all(t in lists for t in wanted):
                        continue
                    begin = phrase_starts(lists, wanted, order, slack)
                    end = begin + len(wanted)
                    doc = np.searchsorted(bounds, np.clip(begin, 0, None), side="right") - 1
                    whole = np.flatnonzero((begin >= 0) & (doc < len(items)) & (end <= bounds[np.minimum(doc + 1, len(items))]))
                    for d in np.unique(doc[whole]):
                        items[d].update(phrases.items[number])
                    np.add.at(change, begin[whole], 1)
                    np.add.at(change, end[whole], -1)
                hit = np.cumsum(change[:-1]) > 0
                hit = np.packbits(hit)
                masks.append((hit | mask if len(mask) else hit).tobytes())
                all_found.append([sorted(x) for x in items])
            for name, column in (("mask", pa.array(masks, pa.binary())), ("found", pa.array(all_found, pa.list_(pa.list_(pa.string()))))):
                batch = batch.set_column(batch.schema.get_field_index(name), name, column)
            yield batch

    return search


def _documents(carry: bool, schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bounds = np.frombuffer(batch["bounds"][row].as_buffer(), np.uint32).astype(np.int64)
                hit = np.zeros(bounds[-1], np.int64)
                mask = np.unpackbits(np.frombuffer(batch["mask"][row].as_buffer(), np.uint8))[:bounds[-1]]
                hit[:len(mask)] = mask
                before = np.concatenate([[0], np.cumsum(hit)])
                found = batch["found"][row].as_py()
                digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
                made = [
                    pa.array(batch["docs"][row].as_py(), pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(np.diff(before[bounds]), pa.int64()),
                    pa.array(found, pa.list_(pa.string())), pa.array(digest, pa.string()),
                ]
                if carry:
                    made.append(batch["payload"][row].values.cast(schema.field("payload").type))
                yield pa.RecordBatch.from_arrays(made, schema=schema)

    return rows


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE, slack: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Mark documents that hold passages of benchmark items.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. Every ``window`` consecutive
    words of an item are a phrase; an item of fewer words, but not none, is one. A document word inside any occurrence of
    a phrase is hit. Returns one row per document: doc_id, n_words, n_hit, n_items, items (ids as text, sorted),
    items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), and the ``carry`` columns. With ``slack`` each
    word of a phrase may stand that many words off its place; the phrase then hits the words of its own span.

    Null texts have no words. Items with a null id or text are left out; rows that repeat an item id are one item.
    Repeated and null document ids are rows of their own. Empty tables of either kind give no hits. Items of more than
    PASS_CHARS characters in all are searched in several passes, so what a task is sent has a fixed bound.
    """
    index = build_index(docs, id_col, text_col, carry)
    state = index.withColumn("mask", F.lit(b"")).withColumn("found", F.transform("docs", lambda _: F.array().cast("array<string>")))
    schema = StructType.fromDDL("doc_id long, n_words long, n_hit long, items array<string>, items_sha256 string")
    if carry:
        schema = schema.add("payload", index.schema["payload"].dataType.elementType)
    rows, last = _documents(bool(carry), to_arrow_schema(schema)), None
    for part in item_parts(items, item_col, item_text_col):
        phrases = Phrases(part, window)
        if len(phrases.vocabulary):
            state = common.stored(state.mapInArrow(last, state.schema), "hits") if last else state
            phrases.count(index)
            last = _search(phrases, slack)
    # the last search and the rows run in one Python process per task
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(last(batches) if last else batches)

    out = state.mapInArrow(memory.bounded("contamination", judged), schema)
    out = out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.expr(f"n_hit > 0 AND {int(share)} * n_hit >= n_words"))
    return common.uncarried(out, carry) if carry else out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(common.documents(spark, sf_dir), common.documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH b AS (SELECT item_id, ws, least({WINDOW}, len(ws)) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b))),
h AS MATERIALIZED (SELECT w.doc_id, w.i, w.k, p.item_id FROM w JOIN p ON w.k = p.k AND w.phrase = p.phrase),
n AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(g.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AND {SHARE} * coalesce(n.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""
