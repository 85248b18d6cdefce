"""Toxicity from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning of a linear model.

Features are the words of a text and the byte 4- and 6-grams within them, hashed; each counts once a text. With a class
prior p, the risk over positives P and unlabelled U is ``p R+(P) + max(0, R-(U) - p R-(P))``: the part of the unlabelled
risk that the positives among them cause is taken off, and what is left is kept from falling below zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import common, words

BITS = 20
GRAMS = (4, 6)
#: Bounds of the training sample: toxic texts, unlabelled texts; and of the features kept.
POSITIVES, UNLABELLED, FEATURES = 2500, 6000, 4000
PREDICT = 0.3
#: Standard deviations by which a feature must be more frequent among the positives.
DEVIATIONS = 4.0
#: Least part of the positives that hold a feature.
SUPPORT = 0.015
#: Least part of a feature's unlabelled texts that are positive, by the class prior: prior * P(feature | positive) / P(feature).
PURITY = 0.5


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct hashed features of each text."""
    with np.errstate(over="ignore"):
        for begin, end in words.blocks(texts):
            data, offsets = words.flat_bytes(texts[begin:end])
            data = words.LOWER_ASCII[data]
            starts, ends, bounds = words.spans(data, offsets, words.ALNUM)
            shift = np.uint64(64 - BITS)
            word = (words.word_hashes(data, starts, ends) >> shift).astype(np.int64)
            inside = np.concatenate([[0], np.cumsum(words.ALNUM[data])])
            grams = []
            for width in GRAMS:
                values = np.zeros(max(0, len(data) - width + 1), np.uint64)
                for k in range(width):
                    values = values * np.uint64(257) + data[k:k + len(values)]
                values = (words.mix(values * np.uint64(31) + np.uint64(width)) >> shift).astype(np.int64)
                values[inside[width:] - inside[:-width] < width] = -1
                grams.append(values)
            for i in range(end - begin):
                parts = [word[bounds[i]:bounds[i + 1]]]
                parts += [v[offsets[i]:max(offsets[i], offsets[i + 1] - w + 1)] for v, w in zip(grams, GRAMS, strict=True)]
                found = np.concatenate(parts)
                if len(found) > 20_000:
                    seen = np.zeros((1 << BITS) + 1, bool)
                    seen[found] = True
                    yield np.flatnonzero(seen[:-1])
                else:
                    found = np.unique(found)
                    yield found[found >= 0]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document counts of each feature among positives and unlabelled."""
    total = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for positive, found in zip(batch["positive"].to_pylist(), features(batch["text"]), strict=True):
            total[int(positive), found] += 1
    at = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_pydict({"feature": pa.array(at, pa.int64()), "p": pa.array(total[1, at], pa.int64()), "u": pa.array(total[0, at], pa.int64())})


def nnpu_fit(rows: list[np.ndarray], positive: np.ndarray, prior: float, width: int, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with the least non-negative PU risk, by Adam on the whole sample."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    theta = np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, theta[column], len(rows)) + theta[-1]
        chance = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        as_negative = np.logaddexp(0, z)
        left = as_negative[~positive].sum() / n_u - prior * as_negative[positive].sum() / n_p
        pull = np.where(positive, -prior * chance / n_p, chance / n_u)  # of the negative part
        if left < 0:
            slope = -pull
        else:
            slope = pull + np.where(positive, -prior * (1 - chance) / n_p, 0.0)
        gradient = np.append(np.bincount(column, slope[owner], width), slope.sum())
        gradient[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], float(theta[-1])


class Model:
    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: float):
        self.kept, self.weights, self.bias = kept, weights, bias

    def scores(self, texts: pa.Array) -> list[float]:
        table = np.zeros(1 << BITS)
        table[self.kept] = self.weights
        return [float(1 / (1 + np.exp(-np.clip(table[x].sum() + self.bias, -30, 30)))) for x in features(texts)]


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, kept: int = FEATURES) -> Model:
    """Fit on about ``positives`` documents labelled toxic and ``unlabelled`` others, drawn by a hash of the id.

    ``docs`` and ``labels`` hold the rows that may be learned from. The class prior is given or taken from the labels.
    Document counts of features are summed in Spark; the driver sees the ``kept`` features that stand out most among the
    positives and their places in the sample. Without positives every score is 0.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic").alias("p"), F.count("*").alias("n")).first()
    prior = min(0.5, max(0.001, prior if prior is not None else share["p"] or 0.0))
    texts = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")
    # the ids are bounded by the parameters, so they are sent to the texts and no text is shuffled
    chosen = F.broadcast(common.drawn(known.where("toxic = 1"), "toxic", positives).select("doc_id"))
    toxic = texts.join(chosen, "doc_id").select("text", F.lit(True).alias("positive"))
    plain = common.drawn(texts.withColumn("positive", F.lit(False)), "positive", unlabelled).select("text", "positive")
    sample = common.stored(toxic.unionAll(plain), "toxic-sample")
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True):
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    counts = sample.mapInArrow(_pairs, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    p, u = F.col("p") / sizes[True], F.col("u") / max(1, sizes.get(False, 0))
    deviations = (p - u) / F.sqrt((u + F.lit(1.0 / sizes[True])) / F.lit(float(sizes[True])))
    best = counts.where(F.col("p") >= max(3, SUPPORT * sizes[True])).withColumn("z", deviations).where((F.col("z") >= DEVIATIONS) & (prior * p >= PURITY * u)).orderBy(F.desc("z"), "feature").limit(kept).collect()
    kept_ = np.sort(np.array([r["feature"] for r in best], np.int64))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.flatnonzero(np.isin(kept_, x, assume_unique=True)).astype(np.int32) for x in features(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["positive"], pa.array(at, pa.list_(pa.int32()))], names=["positive", "at"])

    held = sample.mapInArrow(places, "positive boolean, at array<int>").toArrow()
    rows = [np.asarray(x, np.int64) for x in held["at"].to_pylist()]
    weights, bias = nnpu_fit(rows, np.array(held["positive"].to_pylist(), bool), prior, len(kept_))
    return Model(kept_, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every whole text; no shuffle.

    A null or empty text has no feature and gets the model's base score. Rows are judged one by one: repeated rows and
    null ids stay. An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.scores(batch["text"]), pa.float64())], names=["doc_id", "score"])

    texts = common.texts_of(docs, id_col, text_col)
    return texts.mapInArrow(run, texts.select("doc_id").schema.add("score", "double"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, apart = common.documents(spark, sf_dir), common.held_out(4, 2)
    model = train(docs.where(~apart), common.documents(spark, sf_dir, "labels").where(~apart))
    return score(docs, model).select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
