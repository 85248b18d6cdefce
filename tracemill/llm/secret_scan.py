"""Secret scans over a trigram inverted index.

The index is cut by documents: a segment holds some texts as one row with the sorted trigrams of their bytes (A-Z
lower-cased) and for each the list of its texts. A rule's regular expression gives a Boolean query of trigrams that
every match must hold; a segment's posting lists are intersected and united by it, and only the texts that remain are
searched with the expression itself. A rule without a trigram that all its matches share is searched in every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from tracemill.llm import common, words

SEGMENT = "docs array<long>, texts array<string>, trigrams binary, starts binary, places binary"
SPANS = "doc_id long, spans array<struct<kind: string, start: int, end: int>>"
#: Strings that one place of an expression may stand for before it is taken as any string.
SPELLINGS = 128


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and the least length of its match or of one group; shorter matches are dropped."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The three kinds that the contract names, in its order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", any_case=True, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
#: Key forms that their issuers document, and two general ones.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("payment_key", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/=-]{16,}", any_case=True),
    Rule("login_url", r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@[A-Za-z0-9]"),
)
RULES = BASE + MORE


def _all(parts: list) -> object:
    """The conjunction of queries: True is no condition, a bytes value a trigram, a tuple ("and" | "or", queries)."""
    flat = {}
    for part in parts:
        if part is not True:
            flat.update(dict.fromkeys(part[1] if isinstance(part, tuple) and part[0] == "and" else (part,)))
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", tuple(flat))


def _any(parts: list) -> object:
    if any(part is True for part in parts):
        return True
    flat = {}
    for part in parts:
        flat.update(dict.fromkeys(part[1] if isinstance(part, tuple) and part[0] == "or" else (part,)))
    held = {q: frozenset(q[1]) if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in flat}
    least = [q for q, own in held.items() if not any(other < own for other in held.values())]  # what asks for more adds nothing
    return least[0] if len(least) == 1 else ("or", tuple(least))


def _trigrams(text: bytes) -> object:
    return _all([text[i:i + 3] for i in range(len(text) - 2)])


@dataclass
class Shape:
    """What is known of the strings an expression matches: all of them, or their first and last bytes and a query."""

    exact: frozenset | None
    first: frozenset
    last: frozenset
    query: object = True

    @staticmethod
    def of(strings) -> Shape:
        strings = frozenset(strings)
        return Shape(strings, strings, strings)

    @staticmethod
    def unknown() -> Shape:
        return Shape(None, frozenset([b""]), frozenset([b""]))

    def settled(self) -> Shape:
        """The same without exact strings: their trigrams go into the query, two bytes at either end stay."""
        if self.exact is None:
            return self
        query = _all([self.query, _any([_trigrams(s) for s in self.exact])])
        return Shape(None, frozenset(s[:2] for s in self.first), frozenset(s[-2:] for s in self.last), query)

    def then(self, other: Shape) -> Shape:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= SPELLINGS:
            joined = Shape.of(a + b for a, b in product(self.exact, other.exact))
            joined.query = _all([self.query, other.query])
            return joined
        left, right = self, other
        first = frozenset(a + b for a, b in product(left.exact, right.first)) if left.exact is not None and len(left.exact) * len(right.first) <= SPELLINGS else left.first
        last = frozenset(a + b for a, b in product(left.last, right.exact)) if right.exact is not None and len(left.last) * len(right.exact) <= SPELLINGS else right.last
        across = _any([_trigrams(a + b) for a, b in product(left.last, right.first)]) if len(left.last) * len(right.first) <= SPELLINGS else True
        left, right = left.settled(), right.settled()
        return Shape(None, first, last, _all([left.query, right.query, across]))

    def either(self, other: Shape) -> Shape:
        if self.exact is not None and other.exact is not None and len(self.exact | other.exact) <= SPELLINGS:
            joined = Shape.of(self.exact | other.exact)
            joined.query = _any([self.query, other.query])
            return joined
        left, right = self.settled(), other.settled()
        return Shape(None, left.first | right.first, left.last | right.last, _any([left.query, right.query]))


def _characters(items: list) -> Shape:
    """A character class; one with a wide range is any character."""
    found: set[bytes] = set()
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            found.add(chr(value).encode())
        elif name == "RANGE" and value[1] - value[0] < SPELLINGS:
            found.update(chr(c).encode() for c in range(value[0], value[1] + 1))
        else:
            return Shape.unknown()
    found = {c.lower() for c in found}
    return Shape.of(found) if len(found) <= 8 else Shape.unknown()


def _shape(parsed) -> Shape:
    """The shape of a parsed expression; what has no case here (look-around, references) is any string."""
    whole = Shape.of([b""])
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            part = Shape.of([chr(value).encode().lower()])
        elif name == "IN":
            part = _characters(value)
        elif name == "SUBPATTERN":
            part = _shape(value[3])
        elif name == "BRANCH":
            part = reduce(Shape.either, [_shape(b) for b in value[1]])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            once = _shape(inner)
            if (low, high) == (0, 1):
                part = once.either(Shape.of([b""]))
            elif not low:
                part = Shape.unknown()
            else:
                part = reduce(Shape.then, [once] * min(low, 3))
                if (low, high) != (min(low, 3), min(low, 3)):
                    part = part.settled()
        elif name == "AT":
            continue
        else:
            part = Shape.unknown()
        whole = whole.then(part)
    return whole


def trigram_query(rule: Rule) -> object:
    """The Boolean query of trigrams (A-Z lower-cased) that every match of the rule meets; True if there is none."""
    compiled = rule.compiled()
    return _shape(re._parser.parse(rule.pattern, compiled.flags & ~re.IGNORECASE)).settled().query


def _segments(schema: pa.Schema):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in words.blocks(batch["text"]):
                texts = batch["text"][begin:end].fill_null("")
                data, offsets = words.flat_bytes(texts)
                data = words.LOWER_ASCII[data].astype(np.uint64)
                codes = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:] if len(data) > 2 else data[:0]
                owner = np.repeat(np.arange(end - begin, dtype=np.uint64), np.diff(offsets))
                within = owner[:len(codes)] == owner[2:] if len(codes) else np.zeros(0, bool)
                found = np.unique((codes[within] << np.uint64(32)) | owner[:len(codes)][within])
                grams = (found >> np.uint64(32)).astype(np.uint32)
                first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])[:len(grams)]).astype(np.uint32)
                row = [
                    pa.array([batch["doc_id"][begin:end].to_pylist()], pa.list_(pa.int64())), pa.array([texts.to_pylist()], pa.list_(pa.string())),
                    pa.array([grams[first].tobytes()]), pa.array([np.append(first, np.uint32(len(grams))).tobytes()]),
                    pa.array([found.astype(np.uint32).tobytes()]),
                ]
                if "payload" in schema.names:
                    kind = schema.field("payload").type
                    row.append(pa.ListArray.from_arrays(pa.array([0, end - begin], pa.int32()), batch["payload"][begin:end].cast(kind.value_type)).cast(kind))
                yield pa.RecordBatch.from_arrays(row, schema=schema)

    return build


class Postings:
    """The posting lists of one segment."""

    def __init__(self, trigrams: bytes, starts: bytes, places: bytes, texts: int):
        self.trigrams, self.starts, self.places = (np.frombuffer(x, np.uint32) for x in (trigrams, starts, places))
        self.texts = texts

    def of(self, trigram: bytes) -> np.ndarray:
        code = np.uint32(int.from_bytes(trigram, "big"))
        at = int(np.searchsorted(self.trigrams, code))
        if at == len(self.trigrams) or self.trigrams[at] != code:
            return self.places[:0]
        return self.places[self.starts[at]:self.starts[at + 1]]

    def answer(self, query) -> np.ndarray:
        """Numbers of the texts that meet the query, ascending; lists are intersected from the shortest on."""
        if query is True:
            return np.arange(self.texts, dtype=np.uint32)
        if isinstance(query, bytes):
            return self.of(query)
        lists = [self.answer(part) for part in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True) if len(a) else a, sorted(lists, key=len))


def matches(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches in code points, without those that are too short."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _search(rules: tuple[Rule, ...], schema: pa.Schema):
    plans = [(rule, rule.compiled(), trigram_query(rule)) for rule in rules]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                texts = batch["texts"][row].values
                postings = Postings(*[batch[c][row].as_py() for c in ("trigrams", "starts", "places")], len(texts))
                spans: list[list] = [[] for _ in range(len(texts))]
                for order, (rule, compiled, query) in enumerate(plans):
                    for number in postings.answer(query).tolist():
                        spans[number] += [(a, order, b) for a, b in matches(rule, compiled, texts[number].as_py())]
                made = [
                    batch["docs"][row].values,
                    pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(found)] for found in spans], schema.field("spans").type),
                ]
                if "payload" in schema.names:
                    made.append(batch["payload"][row].values.cast(schema.field("payload").type))
                yield pa.RecordBatch.from_arrays(made, schema=schema)

    return search


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Segments of about a megabyte of text with their trigram posting lists; write them once to scan with more rules later."""
    texts = common.texts_of(docs, id_col, text_col, carry)
    return texts.mapInArrow(_segments(to_arrow_schema(_segment(texts))), _segment(texts))


def _segment(texts: DataFrame) -> StructType:
    schema = StructType.fromDDL(SEGMENT)
    return schema.add("payload", ArrayType(texts.schema["payload"].dataType)) if "payload" in texts.columns else schema


def _found(payload) -> StructType:
    schema = StructType.fromDDL(SPANS)
    return schema.add("payload", payload) if payload is not None else schema


def search(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``scan`` over an index that was built, and perhaps written, before; a carried ``payload`` stays a struct."""
    schema = _found(index.schema["payload"].dataType.elementType if "payload" in index.columns else None)
    return index.mapInArrow(_search(rules, to_arrow_schema(schema)), schema)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Spans of secrets in whole texts.

    Each rule finds leftmost non-overlapping matches, and those too short are dropped after that; rules do not hinder
    each other. Returns one row per input row: doc_id, spans (kind, start, end in code points, end exclusive; by start,
    then in the order of the rules), and the ``carry`` columns. Index and search run in one Python process per task, so
    nothing is shuffled and the index is not written; ``build_index`` and ``search`` do the same apart.

    Null and empty texts have no spans. Repeated rows, equal ids and null ids are rows of their own. An empty table
    gives an empty result. Other columns are not read, whatever their names.
    """
    texts = common.texts_of(docs, id_col, text_col, carry)
    schema = _found(texts.schema["payload"].dataType if carry else None)
    build, find = _segments(to_arrow_schema(_segment(texts))), _search(rules, to_arrow_schema(schema))
    out = texts.mapInArrow(lambda batches: find(build(batches)), schema)
    return common.uncarried(out, carry) if carry else out


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{r.kind}'))").cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in BASE]))
    return scan(common.documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def _sql_rule(order: int, rule: Rule) -> str:
    """Matches of one rule with their places: texts between matches and matches, summed up."""
    pattern = ("(?i)" if rule.any_case else "") + rule.pattern.replace("'", "''")
    return f"""
SELECT doc_id, {order} AS k, '{rule.kind}' AS kind, length(m) AS n, length(g) AS size,
       sum(length(s) + length(m)) OVER (PARTITION BY doc_id, rn ORDER BY i) AS stop
FROM (SELECT doc_id, rn, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(g) AS g, unnest(s[1:len(m)]) AS s
      FROM (SELECT doc_id, rn, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g,
                   string_split_regex(text, '{pattern}') AS s
            FROM d WHERE regexp_matches(text, '{pattern}')))"""


SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rn, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, k, kind, CAST(stop - n AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, size, CASE k {" ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))} END AS least
      FROM ({" UNION ALL ".join(f"({_sql_rule(i, r)})" for i, r in enumerate(RULES))})),
s AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
             string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, k) FILTER (k < {len(BASE)}) AS base,
             string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, k) AS spans
      FROM m WHERE size >= least GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""
