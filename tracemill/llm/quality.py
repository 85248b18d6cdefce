"""Quality by a byte-level convolutional network, written in numpy.

A filter looks at WIDTH bytes in a row; its response is the sum of one learned weight per byte and place. Responses are
max-pooled over overlapping chunks that cover the whole text, a linear layer gives each chunk a value, and the mean
value of the chunks gives the text one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import common, words

WIDTH = 6
FILTERS = 24
#: A chunk is two steps long; chunks overlap by one step.
STEP = 256
#: Most texts of each label in the training sample.
SAMPLE = 1500
EPOCHS = 14
#: Chunks of a text that one epoch trains on, drawn anew each time from the whole text.
DRAWN = 3
PREDICT = 0.7


class Network:
    """Weights: ``filters`` (place, byte, filter), ``bias`` per filter, ``mix`` per filter, ``base``; and the last layer's scale and shift."""

    def __init__(self, seed: int = 7, filters: int = FILTERS):
        random = np.random.default_rng(seed)
        self.filters = random.normal(0, 0.25, (WIDTH, 256, filters)).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.mix = random.normal(0, 0.1, filters).astype(np.float32)
        self.base = np.float32(0)
        self.scale, self.shift = 1.0, 0.0
        self.tables: list[np.ndarray] = []

    def prepare(self) -> None:
        """Responses of two neighbouring places for each pair of bytes."""
        self.tables = [(self.filters[k][:, None] + self.filters[k + 1][None]).reshape(65536, -1) for k in range(0, WIDTH, 2)]

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Response of each filter at each place where it fits."""
        pair = data[:-1].astype(np.int64) << 8 | data[1:]
        count = len(data) - WIDTH + 1
        out = self.tables[0][pair[:count]]
        for k in range(1, WIDTH // 2):
            out += self.tables[k][pair[2 * k:2 * k + count]]
        return out

    def values(self, texts: pa.Array) -> np.ndarray:
        """The mean chunk value of each text. Texts are padded with spaces to one filter's width at least."""
        data, offsets = words.flat_bytes(texts)
        pad = np.full(WIDTH, 32, np.uint8)
        out = np.empty(len(texts))
        for i in range(len(texts)):
            own = np.concatenate([pad, data[offsets[i]:offsets[i + 1]], pad])
            best = [np.maximum.reduceat(self.responses(own[a:a + 64 * STEP + WIDTH - 1]), np.arange(0, min(64 * STEP, len(own) - WIDTH + 1 - a), STEP)) for a in range(0, len(own) - WIDTH + 1, 64 * STEP)]
            best = np.concatenate(best)
            chunk = np.maximum(best[:-1], best[1:]) if len(best) > 1 else best
            out[i] = (np.maximum(chunk + self.bias, 0) @ self.mix + self.base).mean()
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.values(texts) + self.shift, -30, 30)))

    def fit(self, texts: list[bytes], target: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the chunks' log loss with their text's label, both labels weighing the same; then scale and shift on whole texts."""
        random = np.random.default_rng(seed)
        pad = b" " * WIDTH
        padded = [np.frombuffer(pad + t + pad, np.uint8) for t in texts]
        weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum())) * len(target)
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.filters, self.bias, self.mix, np.zeros(1, np.float32))]
        step = 0
        for epoch in range(epochs):
            slow = rate * (1 - 0.9 * epoch / epochs)
            self.prepare()
            order = random.permutation(len(texts))
            for begin in range(0, len(order), batch):
                own = order[begin:begin + batch]
                pieces, label, heavy = [], [], []
                for i in own:
                    last = max(1, len(padded[i]) - 2 * STEP + 1)
                    for start in random.integers(0, last, min(DRAWN, -(-last // STEP))):
                        pieces.append(padded[i][start:start + 2 * STEP + WIDTH - 1])
                        label.append(target[i])
                        heavy.append(weight[i] / min(DRAWN, -(-last // STEP)))
                label, heavy = np.array(label), np.array(heavy) / len(own)
                self.tables or self.prepare()
                top, where = [], []
                for piece in pieces:
                    found = self.responses(piece)
                    at = found.argmax(axis=0)
                    top.append(found[at, np.arange(found.shape[1])])
                    where.append(at)
                top, where = np.array(top), np.array(where)
                active = np.maximum(top + self.bias, 0)
                chance = 1 / (1 + np.exp(-np.clip(active @ self.mix + self.base, -30, 30)))
                error = ((chance - label) * heavy).astype(np.float32)
                back = (error[:, None] * self.mix) * (top + self.bias > 0)
                slope = np.zeros_like(self.filters)
                column = np.broadcast_to(np.arange(top.shape[1]), where.shape)
                for k in range(WIDTH):
                    byte = np.array([piece[at + k] for piece, at in zip(pieces, where, strict=True)])
                    np.add.at(slope[k], (byte, column), back)
                step += 1
                slopes = [slope, back.sum(axis=0), error @ active + 1e-4 * self.mix, error.sum(keepdims=True)]
                values = [self.filters, self.bias, self.mix, np.atleast_1d(self.base)]
                for value, gradient, (m, v) in zip(values, slopes, state, strict=True):
                    m += 0.1 * (gradient - m)
                    v += 0.01 * (gradient ** 2 - v)
                    value -= (slow * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
                self.base = values[3][0]
                self.prepare()
        value = self.values(pa.array([t.decode() for t in texts], pa.string()))
        center, spread = value.mean(), max(value.std(), 1e-6)
        z, a, b = (value - center) / spread, 1.0, 0.0
        for _ in range(300):
            gap = (1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - target) * weight / len(target)
            a, b = a - (gap @ z + 0.002 * a), b - gap.sum()
        self.scale, self.shift = a / spread, b - a * center / spread


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Fit on about ``sample`` documents of each label, drawn by a hash of the id; None without both labels."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = F.broadcast(common.drawn(known, "quality", sample))  # bounded by the sample, so no text is shuffled
    rows = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text").join(picked, "doc_id").select("text", "quality", "doc_id").toArrow().sort_by("doc_id")
    target = np.array(rows["quality"].to_pylist(), np.float64)
    if len(np.unique(target)) < 2:
        return None
    network = Network()
    network.fit([t.encode() for t in rows["text"].to_pylist()], target)
    return network


def score(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every whole text; no shuffle.

    A null text is read as an empty one, which the network sees as padding. Without a network every score is 0.5. Rows
    are judged one by one: repeated rows and null ids stay. An empty table gives an empty result.
    """
    if network:
        network.tables = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if network:
            network.prepare()
        for batch in batches:
            found = network.scores(batch["text"]) if network else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.float64())], names=["doc_id", "score"])

    texts = common.texts_of(docs, id_col, text_col)
    return texts.mapInArrow(run, texts.select("doc_id").schema.add("score", "double"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, apart = common.documents(spark, sf_dir), common.held_out(4, 2)
    network = train(docs.where(~apart), common.documents(spark, sf_dir, "labels").where(~apart))
    return score(docs, network).select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
