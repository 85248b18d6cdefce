"""Count 64-bit hashes over all slots of a collection and bring the counts back to the slot they came from.

A slot (some megabytes of text in one task) sends each of its distinct hashes once, packed per target range, so a
sequence that stands in a third of all texts travels once per slot. A range counts its hashes and answers each slot with
the positions, in the sent order, of those found more than once. No hash table of all hashes exists anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.llm import memory

SENT = "slot int, target int, hashes binary, counts binary"
ANSWER = "slot int, target int, places binary, totals binary"
_SENT = pa.schema([("slot", pa.int32()), ("target", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("slot", pa.int32()), ("target", pa.int32()), ("places", pa.binary()), ("totals", pa.binary())])
TOP = np.iinfo(np.uint32).max


def targets(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash, by its upper half; ascending in the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def pack(slot: int, hashes: np.ndarray, counts: np.ndarray, ranges: int, width: type) -> pa.Table:
    """Sorted distinct hashes of a slot with their counts there, one row per range.

    ``width`` is uint64, or uint32 to send only the lower half: a count is then that of all hashes which share range
    and lower half, never less than the hash's own.
    """
    cut = np.searchsorted(targets(hashes, ranges), np.arange(ranges + 1))
    counts = np.minimum(counts, TOP).astype(np.uint32)
    sent = hashes.astype(width)
    rows = [(t, sent[a:b], counts[a:b]) for t, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    return pa.Table.from_arrays([
        pa.array([slot] * len(rows), pa.int32()), pa.array([t for t, _, _ in rows], pa.int32()),
        pa.array([v.tobytes() for _, v, _ in rows], pa.binary()), pa.array([_sparse(c) for _, _, c in rows], pa.binary()),
    ], schema=_SENT)


def _sparse(counts: np.ndarray) -> bytes:
    """Counts above one, as places and values; most are one."""
    at = np.flatnonzero(counts > 1).astype(np.uint32)
    return np.concatenate([at, counts[at]]).tobytes()


def count_range(width: type, totals: bool):
    """The function that counts the hashes of one range."""
    def count(table: pa.Table) -> pa.Table:
        slots, places = table["slot"].to_pylist(), table["target"].to_pylist()
        parts = [np.frombuffer(x, width) for x in table["hashes"].to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        values = np.concatenate(parts)
        ones = np.ones(len(values), np.uint32)
        for start, sparse in zip(bounds, table["counts"].to_pylist(), strict=False):
            at = np.frombuffer(sparse, np.uint32).reshape(2, -1)
            ones[start + at[0]] = at[1]
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sums = np.add.reduceat(ones[order].astype(np.int64), first)
        total = np.empty(len(values), np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(values))))
        out_places, out_totals = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            at = np.flatnonzero(total[a:b] > 1)
            out_places.append(at.astype(np.uint32).tobytes())
            out_totals.append(np.minimum(total[a:b][at], TOP).astype(np.uint32).tobytes() if totals else b"")
        return pa.Table.from_arrays([
            pa.array(slots, pa.int32()), pa.array(places, pa.int32()),
            pa.array(out_places, pa.binary()), pa.array(out_totals, pa.binary()),
        ], schema=_ANSWER)

    return count


def repeated(sent: DataFrame, ranges: int, width: type = np.uint64, totals: bool = False) -> DataFrame:
    """For each slot and range the places of hashes that occur more than once in all, with totals on request."""
    return sent.repartitionById(ranges, sent["target"]).groupBy("target").applyInArrow(memory.bounded(None, count_range(width, totals)), ANSWER)


def unpack(answer: pa.Table, hashes: np.ndarray, ranges: int, totals: bool = False) -> np.ndarray:
    """Total count of each of the slot's sorted distinct hashes: 1 for those not repeated (2 for the others without totals)."""
    cut = np.searchsorted(targets(hashes, ranges), np.arange(ranges + 1))
    found = np.ones(len(hashes), np.uint32)
    seen = 0
    for target, places, counted in zip(*[answer[c].to_pylist() for c in ("target", "places", "totals")], strict=True):
        at = cut[target] + np.frombuffer(places, np.uint32)
        found[at] = np.frombuffer(counted, np.uint32) if totals else 2
        seen += 1
    if seen != np.count_nonzero(np.diff(cut)):
        raise RuntimeError("the counts of a slot do not belong to its texts: the input changed between two reads")
    return found
