"""Best-fit packing of token sequences: length patterns fitted to the histogram by non-negative least squares.

Only the histogram of piece lengths is planned (at most ``size`` counts, whatever the number of pieces). The plan says,
for ranges of pieces of one length, which sequences they go to and where; the pieces find their place by their rank
among those of the same length, which is a sum of counts per task and length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm import common, memory, tokens

SIZE = 4096
END_ID = 1
#: Lengths are fitted in steps of SIZE / STEPS tokens, rounded up; every step of a pattern can hold its pieces whole.
STEPS = 64
#: Most pieces in one fitted pattern.
PARTS = 3
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def patterns(steps: int, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Every non-increasing tuple of at most ``parts`` positive numbers with the sum ``steps``."""
    def grow(left: int, most: int, parts: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif parts:
            for first in range(min(left, most), 0, -1):
                for rest in grow(left - first, first, parts - 1):
                    yield (first, *rest)

    return list(grow(steps, steps, parts))


def nonnegative_fit(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Least squares with non-negative coefficients by the active set method."""
    rows, columns = matrix.shape
    pull = matrix.T @ target
    x, active = np.zeros(columns), np.zeros(columns, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(pull).max(initial=0)))
    for _ in range(6 * rows):
        gain = matrix.T @ (target - matrix @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tolerance or active.sum() >= rows:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            solved = np.linalg.lstsq(matrix[:, at], target, rcond=None)[0]
            if (solved > tolerance * 1e-6).all():
                x[:] = 0
                x[at] = solved
                break
            falling = solved <= tolerance * 1e-6
            share = x[at][falling] / np.maximum(x[at][falling] - solved[falling], 1e-300)
            x[at] += min(1.0, float(share.min())) * (solved - x[at])
            active[at[(x[at] <= 1e-12 * max(1.0, x.max())) & falling]] = False
            active[at[falling][np.argmin(share)]] = False
            x[~active] = 0
    return x


class Runs:
    """Pieces of each length, taken from the longest of a step on; a run is (length, first rank, count)."""

    def __init__(self, counts: np.ndarray, width: int):
        self.left, self.taken, self.width = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), width

    def of(self, step: int) -> int:
        return int(self.left[(step - 1) * self.width + 1:step * self.width + 1].sum())

    def longest(self, room: int) -> int:
        """The greatest length of at most ``room`` with pieces left, or 0."""
        found = np.flatnonzero(self.left[:room + 1])
        return int(found[-1]) if len(found) else 0

    def take(self, step: int, count: int) -> list[tuple[int, int, int]]:
        runs = []
        for length in range(min(step * self.width, len(self.left) - 1), (step - 1) * self.width, -1):
            if count and self.left[length]:
                runs.append(self.pop(length, min(count, int(self.left[length]))))
                count -= runs[-1][2]
        return runs

    def pop(self, length: int, count: int) -> tuple[int, int, int]:
        first = int(self.taken[length])
        self.taken[length] += count
        self.left[length] -= count
        return length, first, count


def plan(counts: np.ndarray, size: int = SIZE, steps: int = STEPS) -> tuple[np.ndarray, int]:
    """Place ``counts[length]`` pieces of each length into sequences of at most ``size``.

    Returns rows (length, first rank, count, first sequence, offset), sorted by length and rank: the piece of that length
    with rank first + i goes to sequence first + i at the offset; and the number of sequences. Pattern counts are the
    rounded fit, bounded by the pieces there are; the last part of a pattern is the longest piece that fits exactly, and
    what is left goes, long pieces first, where least room remains.
    """
    width = size // steps
    runs = Runs(counts, width)
    have = np.array([counts[(s - 1) * width + 1:s * width + 1].sum() for s in range(1, steps + 1)], np.int64)
    kinds = patterns(steps)
    matrix = np.zeros((steps, len(kinds)))
    for column, kind in enumerate(kinds):
        for step in kind:
            matrix[step - 1, column] += 1
    repeats = np.rint(nonnegative_fit(matrix, have.astype(float))).astype(np.int64)
    groups: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(size + 1)]  # by room: (sequences, [(length, first rank)])
    for column in np.argsort(-repeats, kind="stable"):
        kind = kinds[column]
        count = int(repeats[column])
        for step in set(kind[:-1]):
            count = min(count, runs.of(step) // kind[:-1].count(step))
        slots = [runs.take(step, count) for step in kind[:-1]] if count > 0 else []
        while count > 0:
            n = min([slot[0][2] for slot in slots], default=count)
            held = [(slot[0][0], slot[0][1]) for slot in slots]
            room = size - sum(length for length, _ in held)
            last = runs.longest(room)  # the last part fits the room that is left, not only its step
            if last:
                n = min(n, int(runs.left[last]))
                room -= last
                held = [*held, runs.pop(last, n)[:2]]
            elif not held:
                break
            groups[room].append((n, held))
            count -= n
            for slot in slots:
                length, first, left = slot[0]
                slot[:1] = [(length, first + n, left - n)] if left > n else []
    rooms = [room for room in range(size + 1) if groups[room]]
    for length in range(size, 0, -1):
        while runs.left[length]:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = size // length
                each = min(fit, int(runs.left[length]))
                count = int(runs.left[length]) // each
                room, group = size - each * length, (count, [runs.pop(length, count)[:2] for _ in range(each)])
            else:
                old = rooms[at]
                n, held = groups[old].pop()
                count = min(n, int(runs.left[length]))
                if count < n:
                    groups[old].append((n - count, [(x, first + count) for x, first in held]))
                if not groups[old]:
                    del rooms[at]
                room, group = old - length, (count, [*held, runs.pop(length, count)[:2]])
            if not groups[room]:
                rooms.insert(bisect_left(rooms, room), room)
            groups[room].append(group)
    rows, sequence = [], 0
    for room in range(size + 1):
        for n, held in groups[room]:
            offset = 0
            for length, first in held:
                rows.append((length, first, n, sequence, offset))
                offset += length
            sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def _pieces(tokenizer_path: str, end_id: int, size: int, carry: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.tokenizer(tokenizer_path)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            names, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for a, b in tokens.blocks(texts):
                rows, blobs = [], []
                for name, found in zip(names[a:b], encoder.encode(texts[a:b]), strict=True):
                    ids = np.frombuffer(found + end, encoder.dtype).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), size)):
                        own = ids[start:start + size]
                        rows.append((name, piece, start, len(own), zlib.crc32(own.tobytes()), part, int(seen[len(own)])))
                        blobs.append(own.tobytes())
                        seen[len(own)] += 1
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()], strict=True)]
                names_out = [x.split()[0] for x in PIECE.split(", ")]
                if carry:
                    columns.append(pa.array(blobs, pa.binary()))
                    names_out.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return cut


def _placed(rows: np.ndarray):
    key = rows[:, 0] << 44 | rows[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            found = rows[at]
            batch = batch.append_column("sequence_id", pa.array(found[:, 3] + rank - found[:, 1], pa.int64()))
            yield batch.append_column("offset", pa.array(found[:, 4], pa.int64())).drop_columns(["rank"])

    return place


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut documents longer than ``size`` tokens and place all pieces in sequences of at most ``size``.

    Ids are those of the tokenizer file without special tokens, and ``end_id`` after each document; a null or empty text
    has the end id alone. Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    ids (4-byte little-endian) on request. Rows that repeat, and null ids, are documents of their own. An empty table
    gives an empty result. The driver sees the histogram alone; the plan holds some thousand rows, bounded by ``size``.
    """
    schema = PIECE + (", ids binary" if with_ids else "")
    pieces = common.stored(common.texts_of(docs, id_col, text_col).mapInArrow(memory.bounded("tokens", _pieces(tokenizer_path, end_id, size, with_ids)), schema), "pieces")
    per_task = common.stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(size + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    rows, _ = plan(counts, size, min(STEPS, size))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = per_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = dict(ranked.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(memory.bounded(None, _placed(rows)), out)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves (sequence_id, ids, doc_ids, offsets) from pieces with ids; a group is one sequence."""
    grouped = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("held"))
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch["held"].to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch["sequence_id"],
                pa.array([np.concatenate([np.frombuffer(h["ids"], "<u4") for h in hs]).astype(np.int32) for hs in held], pa.list_(pa.int32())),
                pa.array([[h["doc_id"] for h in hs] for hs in held], pa.list_(pa.int64())),
                pa.array([[h["offset"] for h in hs] for hs in held], pa.list_(pa.int64())),
            ], names=["sequence_id", "ids", "doc_ids", "offsets"])

    return grouped.mapInArrow(join, "sequence_id long, ids array<int>, doc_ids array<long>, offsets array<long>")


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir), tokens.default_path())
