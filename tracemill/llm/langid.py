"""Language identification by rank-order profiles: out-of-place distance between frequent n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.llm import common, memory

#: N-grams in a profile, of a language or a document.
PROFILE = 400
#: Letters with at least this share of the letters of some language are symbols of their own; all others share one.
RARE = 1e-4
#: Labelled documents per language that profiles are learned from (about; drawn by a hash of the id).
SAMPLE = 1500
UNKNOWN = "und"
#: Up to this many possible n-grams are counted in a table of all, more by sorting; the counts are the same.
DENSE = 1 << 19


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-case text, 0 for whatever is no letter."""
    text = text.lower()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letter_table()[points], points, 0)


_tables: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _tables:
        _tables.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _tables[0]


def ngrams(points: np.ndarray, symbol: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of one to three of ``base`` symbols; words are padded with one blank on either side."""
    s = symbol[np.concatenate([[0], points, [0]])].astype(np.int64)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    a, b, c = s[:-2], s[1:-1], s[2:]
    inner = b != 0
    codes = np.concatenate([b[inner], base + s[:-1] * base + s[1:], base + base ** 2 + (a[inner] * base + b[inner]) * base + c[inner]])
    if len(codes) < 4000 or base ** 3 > DENSE:
        return np.unique(codes, return_counts=True)
    counts = np.bincount(codes)
    found = np.flatnonzero(counts)
    return found, counts[found]


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes first; equal counts by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def _symbols(alphabet: list[int]) -> np.ndarray:
    table = np.where(_letter_table(), len(alphabet) + 1, 0).astype(np.int32)
    table[alphabet] = np.arange(1, len(alphabet) + 1)
    return table


class Profiles:
    """The alphabet, and per language the rank of each n-gram (``size`` for those not in its profile)."""

    def __init__(self, alphabet: list[int], profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.alphabet, self.size, self.languages = alphabet, size, sorted(profiles)
        self.profiles = [profiles[x] for x in self.languages]
        self.base = len(alphabet) + 2
        self.codes = self.ranks = self.symbol = None

    def prepare(self) -> None:
        """The symbol of each letter, and the ranks of the n-grams of all profiles; made once per task, not sent."""
        self.symbol = _symbols(self.alphabet)
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *self.profiles]))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), self.size, np.int64)  # the last row: in no profile
        for column, codes in enumerate(self.profiles):
            self.ranks[np.searchsorted(self.codes, codes), column] = np.arange(len(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language with the least distance (ties: first by name) and one minus its distance as part of the greatest."""
        points = letters_of(text or "")
        if not points.any() or not self.languages:
            return UNKNOWN, 0.0
        top = ranked(*ngrams(points, self.symbol, self.base), self.size)
        at = np.searchsorted(self.codes, top)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == top[known]
        ranks = self.ranks[np.where(known, at, len(self.codes))]
        away = np.abs(ranks - np.arange(len(top))[:, None])
        away[ranks == self.size] = self.size
        total = away.sum(axis=0)
        best = int(np.argmin(total))
        return self.languages[best], 1.0 - float(total[best]) / (self.size * len(top))


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch["lang"].to_pylist()
        for name in sorted(set(lang)):
            points = np.concatenate([letters_of(t) for t, x in zip(batch["text"].to_pylist(), lang, strict=True) if x == name])
            found, counts = np.unique(points[points > 0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(found), pa.string()), "code": pa.array(found, pa.int64()), "n": pa.array(counts, pa.int64())})


def _ngram_counts(alphabet: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = _symbols(alphabet)
        for batch in batches:
            lang = batch["lang"].to_pylist()
            for name in sorted(set(lang)):
                own = [ngrams(letters_of(t), symbol, len(alphabet) + 2) for t, x in zip(batch["text"].to_pylist(), lang, strict=True) if x == name]
                found, place = np.unique(np.concatenate([c for c, _ in own]), return_inverse=True)
                total = np.bincount(place, np.concatenate([n for _, n in own]), len(found)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(found), pa.string()), "code": pa.array(found, pa.int64()), "n": pa.array(total, pa.int64())})

    return count


def learn(labelled: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> Profiles:
    """Profiles from (doc_id, text, lang) rows. Counts are summed in Spark; the driver sees the finished profiles.

    About ``sample`` documents a language are used, drawn by a hash of the id. Without labelled text there are none.
    The alphabet grows with the scripts learned: each letter that is not RARE in some language (1 / RARE of them a language at most).
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    drawn = common.stored(common.drawn(labelled, "lang", sample).select("text", "lang"), "language-sample")
    if drawn.isEmpty():
        return Profiles([], {}, size)
    kinds = "lang string, code long, n long"
    totals = drawn.mapInArrow(_letter_counts, kinds).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    part = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    alphabet = sorted(r["code"] for r in totals.withColumn("part", part).where(F.col("part") >= RARE).select("code").distinct().collect())
    counts = drawn.mapInArrow(_ngram_counts(alphabet), kinds).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = counts.withColumn("rank", order).where(F.col("rank") <= size).orderBy("lang", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for row in rows:
        profiles.setdefault(row["lang"], []).append(row["code"])
    return Profiles(alphabet, {k: np.array(v) for k, v in profiles.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """The language of every whole text: doc_id, text on request, lang_pred, score, and the ``carry`` columns; no shuffle.

    A null text, or one without a letter, is ``und`` with score 0, as is every text when there are no profiles. Texts
    whose n-grams stand in no profile get the first language and score 0. Rows are judged one by one, so repeated rows
    and null ids stay. An empty table gives an empty result.
    """
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles.prepare()
        for batch in batches:
            found = [profiles.predict(t) for t in batch["text"].to_pylist()]
            batch = batch if keep_text else batch.drop_columns(["text"])
            batch = batch.append_column("lang_pred", pa.array([x for x, _ in found], pa.string()))
            yield batch.append_column("score", pa.array([y for _, y in found], pa.float64()))

    texts = common.texts_of(docs, id_col, text_col, carry)
    kept = [f for f in texts.schema if keep_text or f.name != "text"]
    kinds = StructType([*kept, *StructType.fromDDL("lang_pred string, score double")])
    out = texts.mapInArrow(memory.bounded("language", predict), kinds)
    return common.uncarried(out, carry) if carry else out


def learned(docs: DataFrame) -> Profiles:
    """Profiles from the documents outside the held-out fold."""
    return learn(docs.where(~common.held_out(5, 0)).where("doc_id IS NOT NULL").select("doc_id", "text", "lang"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return identify(docs, learned(docs)).select("doc_id", common.held_out(5, 0).alias("held_out"), "lang_pred", "score")
