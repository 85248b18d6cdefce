"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which of them overlap.

Both tokenizers cut the same bytes, so each text has two ascending lists of token ends. The shorter list drives an
exponential and then binary search into the longer one. Common ends cut the text into groups; differences of the ranks
found give, for each token, the range of the other's tokens that it overlaps.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from tracemill.llm import common, hashcount, memory, tokens

#: White space, then other characters, up to a space that follows one of those: neither tokenizer joins across that place.
UNIT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")
#: Parts remembered in each of two halves, those of at most so many characters; parts sent to the libraries at once.
KEEP, KEEP_CHARS, AT_ONCE = 250_000, 48, 400
#: Spreads the first id of a pair over 32 bits, one to one, so that all pairs of an id meet in one range.
SPREAD = np.uint64(0x9E3779B1)
PARTS_AT_ONCE = 1 << 18
LOWER = np.uint64(0xFFFFFFFF)
BLOCK_CHARS = 2 << 20
SENT = "block long, target int, hashes binary, counts binary"
ANSWER = "block long, target int, places binary, totals binary"
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenPair:
    """Ids of a text by a byte-level tokenizer (A, of space + text) and a piece tokenizer (B, which adds the space).

    Parts of a text across whose borders neither tokenizer joins are encoded once and remembered within a bound; files
    that do not promise such borders are applied to whole texts.
    """

    def __init__(self, path_a: str, path_b: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size_a, size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * size_a
        for token, number in self.a.get_vocab().items():
            self.bytes_a[number] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(x) for x in known], np.int64) for known in (self.bytes_a, self.bytes_b)]
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as file:
            model.ParseFromString(file.read())
        pre, norm = spec.get("pre_tokenizer") or {}, model.normalizer_spec
        self.by_unit = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            and norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
            and not any(re.search("[^▁]▁", p) for p in pieces)
        )
        #: ids as text with each sign that may follow in a group
        self.names = [[np.array([f"{i}{sign}" for i in range(size)], object) for sign in signs] for size, signs in ((size_a, ",|"), (size_b, ",;"))]
        self.space = np.array([self.b.piece_to_id("▁")], "<u4").tobytes()
        self.known = tokens.Remembered(keep)

    def _ids(self, parts: list[str]) -> list[tuple[bytes, bytes]]:
        """Little-endian 32-bit ids of both for parts that begin with a space."""
        of_a = [np.asarray(x.ids, "<u4").tobytes() for x in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        of_b = [np.asarray(x, "<u4").tobytes() for x in self.b.encode([p[1:] for p in parts], num_threads=1)]
        return [(a, self.space if p == " " else b) for p, a, b in zip(parts, of_a, of_b, strict=True)]

    def _same(self, ids: tuple[bytes, bytes], text: str) -> bool:
        """Whether the tokens of both give back the bytes of the text."""
        raw = text.encode()
        return all(b"".join([known[i] for i in np.frombuffer(x, "<u4").tolist()]) == raw for x, known in zip(ids, (self.bytes_a, self.bytes_b), strict=True))

    def _learn(self, parts: list[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        """Ids of new parts. Many go to the libraries as one text, which is cut again where the bytes of a part end."""
        found = {}
        plain = [p for p in parts if self.by_unit and not p[-1].isspace()]
        for begin in range(0, len(plain), AT_ONCE):
            some = plain[begin:begin + AT_ONCE]
            text = "".join(some)
            ids = self._ids([text])[0]
            if self._same(ids, text):
                ends = np.cumsum([len(p.encode()) for p in some])
                cuts = []
                for own, lengths in zip(ids, self.lengths, strict=True):
                    after = 4 * (np.searchsorted(np.cumsum(lengths[np.frombuffer(own, "<u4")]), ends) + 1)
                    cuts.append([own[a:b] for a, b in zip([0, *after[:-1].tolist()], after.tolist(), strict=True)])
                found.update({p: (a, b, True) for p, a, b in zip(some, *cuts, strict=True)})
        odd = [p for p in parts if p not in found]
        found.update({p: (*ids, self._same(ids, p)) for p, ids in zip(odd, self._ids(odd), strict=True)})
        return found

    def encode(self, parts: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Ids of both for distinct parts, and whether both give back the part's bytes."""
        local = self.known.lookup(parts)
        new = self._learn([p for p in parts if local[p] is None])
        local.update(new)
        self.known.update({k: v for k, v in new.items() if len(k) <= KEEP_CHARS})
        self.known.shrink()
        return [local[p] for p in parts]

    def split(self, text: str | None) -> list[str]:
        return [] if not text else UNIT.findall(f" {text}") if self.by_unit else [f" {text}"]


@lru_cache(maxsize=2)
def token_pair(path_a: str, path_b: str) -> TokenPair:
    """One per worker process, kept between tasks."""
    return TokenPair(path_a, path_b)


memory.remembered(token_pair.cache_clear)


def gallop(short: np.ndarray, long: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each value of ``short`` the first place in the ascending ``long`` that holds no less.

    All values search at once: from ``begin`` on, steps double towards the value until it is passed, then the bracket is
    halved.
    """
    right = long[begin] < short
    low, high = np.where(right, begin + 1, 0), np.where(right, len(long), begin)
    going, step = np.arange(len(short)), 1
    while len(going):
        probe = begin[going] + np.where(right[going], step, -step)
        inside = (probe >= 0) & (probe < len(long))
        going, probe = going[inside], probe[inside]
        less = long[probe] < short[going]
        low[going[less]], high[going[~less]] = probe[less] + 1, probe[~less]
        going = going[less == right[going]]
        step *= 2
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) >> 1
        less = long[middle] < short[going]
        low[going[less]], high[going[~less]] = middle[less] + 1, middle[~less]
        going = going[low[going] < high[going]]
    return low


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The integers ``first[i] ... first[i] + count[i] - 1`` one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def align(lengths_a: np.ndarray, lengths_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Align texts (or parts of them) laid end to end, given the byte lengths of their tokens and how many each has.

    Returns the token numbers of all overlapping pairs (of A, of B), and those of the last tokens of each group. Both
    lists of a text must have the same number of bytes.
    """
    at_a, at_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for a_drives in (True, False):
        texts = (n_a <= n_b) == a_drives
        own = [(np.flatnonzero(texts[at]), n[texts]) for at, n in ((at_a, n_a), (at_b, n_b))]
        ends = [np.cumsum(lengths[index]) for (index, _), lengths in zip(own, (lengths_a, lengths_b), strict=True)]
        short, other = (0, 1) if a_drives else (1, 0)
        (index, count), (index_long, count_long) = own[short], own[other]
        if not len(index):
            continue
        # the search begins at the same share of the text
        rank = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(count_long) - count_long, count) + rank * np.repeat(count_long, count) // np.repeat(count, count)
        found = gallop(ends[short], ends[other], start)
        equal = ends[other][found] == ends[short]
        first = np.concatenate([[0], found[:-1] + equal[:-1]])
        width = found - first + 1
        pair = [np.repeat(index, width), index_long[ranges(first, width)]]
        cut = [index[equal], index_long[found[equal]]]
        for kept, new in zip(parts, (pair[short], pair[other], cut[short], cut[other]), strict=True):
            kept.append(new)
    made = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
    order = np.argsort(made[2], kind="stable")
    return made[0], made[1], made[2][order], made[3][order]


class Slot:
    """Some texts as numbers of their distinct parts, and those parts encoded and aligned."""

    def __init__(self, pair: TokenPair, texts: list[str | None]):
        number: dict[str, int] = {}
        split = []
        for text in texts:
            parts = pair.split(text)
            split.append(np.fromiter([number.setdefault(p, len(number)) for p in parts], np.int32, len(parts)))
        encoded = pair.encode(list(number))
        good = np.array([e[2] for e in encoded], bool)
        # a text with a part that is not given back has no tokens
        split = [own if good[own].all() else own[:0] for own in split]
        self.size = np.array([len(own) for own in split], np.int64)
        self.parts = np.concatenate(split) if split else np.zeros(0, np.int32)
        n = [np.array([len(e[k]) // 4 if e[2] else 0 for e in encoded], np.int64) for k in (0, 1)]
        self.ids = [np.frombuffer(b"".join([e[k] for e in encoded if e[2]]), "<u4").astype(np.int64) for k in (0, 1)]
        link_a, link_b, self.cut_a, self.cut_b = align(pair.lengths[0][self.ids[0]], pair.lengths[1][self.ids[1]], *n)
        owner = np.repeat(np.arange(len(encoded)), n[0])
        order = np.argsort(owner[link_a], kind="stable")
        self.keys, self.link = np.unique(pair_keys(self.ids[0][link_a[order]], self.ids[1][link_b[order]]), return_inverse=True)
        #: of each part: tokens of A and B, groups, links; the links of a part are together in ``link``
        self.n_a, self.n_b = n
        self.n_groups = np.bincount(owner[self.cut_a], minlength=len(encoded))
        self.n_links = np.bincount(owner[link_a], minlength=len(encoded))
        self.first = np.cumsum(self.n_links) - self.n_links

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of each text, with their links there: bounds by text, places in ``keys``, numbers of links."""
        bounds, found, links, step = np.concatenate([[0], np.cumsum(self.size)]), [], [], max(1, len(self.size) * PARTS_AT_ONCE // max(1, len(self.parts)))
        for begin in range(0, len(self.size), step):
            end = min(begin + step, len(self.size))
            text = np.repeat(np.arange(begin, end, dtype=np.uint64), self.size[begin:end])
            # parts once per text first, with their number, then their links
            distinct, often = np.unique(text << np.uint64(32) | self.parts[bounds[begin]:bounds[end]].astype(np.uint64), return_counts=True)
            part = (distinct & LOWER).astype(np.int64)
            width = self.n_links[part]
            linked = np.repeat(distinct & ~LOWER, width) | self.link[ranges(self.first[part], width)].astype(np.uint64)
            seen, back = np.unique(linked, return_inverse=True)
            found.append(seen)
            links.append(np.bincount(back, weights=np.repeat(often, width), minlength=len(seen)).astype(np.int64))
        found, links = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (found, links))
        return np.searchsorted(found >> np.uint64(32), np.arange(len(self.size) + 1)), (found & LOWER).astype(np.int64), links.astype(np.int64)

    def by_text(self, values: np.ndarray) -> list[int]:
        """Values of parts, summed for each text."""
        return np.diff(np.concatenate([[0], np.cumsum(values[self.parts])])[np.concatenate([[0], np.cumsum(self.size)])]).tolist()

    def groups(self, names: list[list[np.ndarray]]) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each text, from the groups of its parts."""
        last = [np.zeros(len(ids), bool) for ids in self.ids]
        for ends, cut in zip(last, (self.cut_a, self.cut_b), strict=True):
            ends[cut] = True
        size_a, size_b = len(self.ids[0]), len(self.ids[1])
        out = np.empty(size_a + size_b, object)
        before_b = np.concatenate([[0], self.cut_b + 1])
        at = np.arange(size_a) + before_b[np.cumsum(last[0]) - last[0]], np.arange(size_b) + (np.append(self.cut_a, size_a) + 1)[np.cumsum(last[1]) - last[1]]
        for place, ids, ends, (inner, final) in zip(at, self.ids, last, names, strict=True):
            out[place[~ends]], out[place[ends]] = inner[ids[~ends]], final[ids[ends]]
        bounds = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        out = out.tolist()
        strings = ["".join(out[a:b])[:-1] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        own, bounds = [strings[p] for p in self.parts.tolist()], np.concatenate([[0], np.cumsum(self.size)]).tolist()
        return [";".join(own[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key for each pair of ids, exact; its upper half depends on A's id alone."""
    return ((a.astype(np.uint64) * SPREAD & np.uint64(0xFFFFFFFF)) << np.uint64(32)) | b.astype(np.uint64)


def _encode(paths: tuple[str, str], schema: pa.Schema):
    """Encode and align blocks of texts: all that does not hang on other texts, and the pairs with their links."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = int(TaskContext.get().partitionId()) << 32
        for batch in batches:
            texts = batch["text"].to_pylist()
            for begin, end in tokens.blocks(texts, BLOCK_CHARS):
                pair = token_pair(*paths)
                slot = Slot(pair, texts[begin:end])
                groups = slot.groups(pair.names)
                bounds, pairs, links = slot.pairs()
                held, pairs = np.unique(pairs, return_inverse=True)
                rows = {
                    "doc_id": batch["doc_id"][begin:end], "n_a": slot.by_text(slot.n_a), "n_b": slot.by_text(slot.n_b), "n_groups": slot.by_text(slot.n_groups),
                    "n_links": slot.by_text(slot.n_links), "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], "groups": groups,
                } | ({"payload": batch["payload"][begin:end]} if "payload" in batch.schema.names else {})
                kinds = schema.field("texts").type.value_type
                made = pa.StructArray.from_arrays([rows[f.name].cast(f.type) if isinstance(rows[f.name], pa.Array) else pa.array(rows[f.name], f.type) for f in kinds], fields=list(kinds))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, end - begin], pa.int32()), made).cast(schema.field("texts").type),
                    pa.array([slot.keys[held].tobytes()], pa.binary()), pa.array([np.bincount(pairs, minlength=len(held)).astype("<u4").tobytes()], pa.binary()),
                    pa.array([bounds.astype("<u4").tobytes()], pa.binary()), pa.array([pairs.astype("<u4").tobytes()], pa.binary()), pa.array([links.astype("<u4").tobytes()], pa.binary()),
                ], schema=schema)
                block += 1

    return encode


def _send(count: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, counts in zip(*[batch[c].to_pylist() for c in ("block", "keys", "counts")], strict=True):
                sent = hashcount.pack(0, np.frombuffer(keys, np.uint64), np.frombuffer(counts, "<u4"), count, np.uint64)
                yield from pa.table({"block": pa.array([block] * len(sent), pa.int64()), **{c: sent[c] for c in ("target", "hashes", "counts")}}).to_batches()

    return send


def count_pairs(table: pa.Table) -> pa.Table:
    """For one range: the texts of each pair that a slot sent, and a bit where none of the same A id has more."""
    values = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    joined = np.concatenate(values)
    ones = np.ones(len(joined), np.int64)
    for start, sparse in zip(bounds, table["counts"].to_pylist(), strict=False):
        at = np.frombuffer(sparse, np.uint32).reshape(2, -1)
        ones[start + at[0]] = at[1]
    distinct, back = np.unique(joined, return_inverse=True)
    total = np.bincount(back, weights=ones, minlength=len(distinct)).astype(np.int64)
    owner = distinct >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    highest = np.repeat(np.maximum.reduceat(total, first), np.diff(np.append(first, len(distinct))))
    best, total = (total == highest)[back], total[back]
    return pa.Table.from_pydict({
        "block": table["block"].combine_chunks(), "target": table["target"].combine_chunks(),
        "places": pa.array([np.packbits(best[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
        "totals": pa.array([total[a:b].astype(np.uint32 if total.max() <= hashcount.TOP else np.uint64).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
    })


def _totals(answer: pa.Table, distinct: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Total and best bit of each of a block's distinct keys."""
    cut = np.searchsorted(hashcount.targets(distinct, count), np.arange(count + 1))
    total, best, seen = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), bool), 0
    for target, bits, counted in zip(*[answer[c].to_pylist() for c in ("target", "places", "totals")], strict=True):
        a, b = cut[target], cut[target + 1]
        total[a:b] = np.frombuffer(counted, np.uint32 if len(counted) == 4 * (b - a) else np.uint64)
        best[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8))[:b - a]
        seen += b - a
    if seen != len(distinct):
        raise RuntimeError("the counts of a block do not belong to its pairs")
    return total, best


def _score(count: int, schema: pa.Schema):
    def score(table: pa.Table, answer: pa.Table) -> pa.Table:
        keys, bounds, pairs, links = (np.frombuffer(table[c][0].as_py(), t) for c, t in (("keys", np.uint64), ("bounds", "<u4"), ("pairs", "<u4"), ("links", "<u4")))
        total, best = _totals(answer, keys, count)
        texts = table["texts"].combine_chunks()[0].values
        sums = {name: np.diff(np.concatenate([[0], np.cumsum(links * values[pairs])])[bounds]) for name, values in (("n_best", best), ("count_sum", total))}
        return pa.Table.from_arrays([pa.array(sums[f.name], f.type) if f.name in sums else texts.field(f.name).cast(f.type) for f in schema], schema=schema)

    return score


def align_tokens(docs: DataFrame, path_a: str, path_b: str, groups: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Align the tokens of two tokenizers over whole texts, and count over all texts which ids overlap.

    A is a file of the tokenizers library (byte-level), B one of sentencepiece; A encodes space + text, B adds its own
    space, special tokens are plain text. A link is a pair of an A and a B token whose bytes overlap; its count is the
    number of rows in which the same two ids are linked. Returns one row per input row: doc_id, n_a, n_b (tokens),
    n_groups (between common ends), n_links, n_best (links whose count is the highest of their A id, ties included),
    count_sum (counts over links), groups_sha256 (of ``a1,a2|b1;a3|b2``), with ``groups`` that string itself, and the
    ``carry`` columns.

    Each text is encoded once: blocks of texts are written to the shared folder with their pairs, each pair goes once per
    block to be counted, and the counts come back to the blocks.

    Null and empty texts, and those whose tokens do not give back space + text byte by byte (such as texts with U+2581,
    or after normalisation), have no tokens: zeros, and '' unhashed. Repeated rows and equal ids are rows that count of
    their own; null ids are kept. An empty table gives an empty result.
    """
    count = common.partitions(docs.sparkSession)
    texts = common.texts_of(docs, id_col, text_col, carry)
    schema = StructType.fromDDL(COLUMNS + (", groups string" if groups else ""))
    if carry:
        schema = schema.add("payload", texts.schema["payload"].dataType)
    own = StructType([f for f in schema if f.name not in ("n_best", "count_sum")])
    blocks = StructType.fromDDL("block long, texts array<int>, keys binary, counts binary, bounds binary, pairs binary, links binary")
    blocks["texts"].dataType = ArrayType(own)
    stored = common.stored(texts.mapInArrow(memory.bounded("alignment", _encode((path_a, path_b), to_arrow_schema(blocks))), blocks), "aligned")
    sent = stored.select("block", "keys", "counts").mapInArrow(_send(count), SENT)
    answers = sent.repartitionById(count, sent["target"]).groupBy("target").applyInArrow(count_pairs, ANSWER)
    out = stored.drop("counts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(count, to_arrow_schema(schema)), schema)
    return common.uncarried(out, carry) if carry else out


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(common.documents(spark, sf_dir), *default_paths())
