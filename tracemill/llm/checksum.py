"""CRC-32C of many byte ranges at once, in numpy: all 512-byte pieces step together, then the pieces of each range fold."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

POLYNOMIAL = 0x82F63B78
PIECE = 512
ALL = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _tables() -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For a word of four bytes the table of each byte; for a state, the tables that pass it over PIECE zero bytes."""
    low = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        low = np.where(low & 1, (low >> 1) ^ np.uint32(POLYNOMIAL), low >> 1).astype(np.uint32)
    steps = [low]
    for _ in range(3):
        steps.append(low[steps[-1] & 255] ^ (steps[-1] >> 8))
    word = steps[::-1]
    over = []
    for byte in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        for _ in range(PIECE // 4):
            state = _step(state, word)
        over.append(state)
    return word, over


def _step(state: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][(state >> 8) & 255] ^ tables[2][(state >> 16) & 255] ^ tables[3][state >> 24]


def crc32c(ranges: list[bytes]) -> np.ndarray:
    """The CRC-32C of each byte string."""
    word, over = _tables()
    sizes = np.array([len(x) for x in ranges], np.int64)
    pieces = -(-sizes // PIECE)
    ends = np.cumsum(pieces)
    buffer = np.zeros(int(pieces.sum()) * PIECE, np.uint8)
    for data, end, size in zip(ranges, ends * PIECE, sizes, strict=True):
        buffer[end - size:end] = np.frombuffer(data, np.uint8)
        if size >= 4:  # the initial state; shorter ranges follow below
            buffer[end - size:end - size + 4] ^= np.uint8(255)
    lanes = np.ascontiguousarray(buffer.view("<u4").reshape(-1, PIECE // 4).T)
    state = np.zeros(lanes.shape[1], np.uint32)
    for lane in lanes:
        state = _step(state ^ lane, word)
    order = np.argsort(-pieces, kind="stable")
    total, firsts, counts = np.zeros(len(sizes), np.uint32), (ends - pieces)[order], pieces[order]
    for k in range(int(counts[0]) if len(counts) else 0):
        active = int(np.searchsorted(-counts, -k, side="left"))
        total[:active] = _step(total[:active], over) ^ state[firsts[:active] + k]
    out = np.empty(len(sizes), np.uint32)
    out[order] = total ^ ALL
    for i in np.flatnonzero(sizes < 4):
        value = 0xFFFFFFFF
        for byte in ranges[i]:
            value = int(word[3][(value ^ byte) & 255]) ^ (value >> 8)
        out[i] = value ^ 0xFFFFFFFF
    return out


def masked(values: np.ndarray) -> np.ndarray:
    """Checksums turned and shifted, so that a checksum of data that holds checksums stays meaningful."""
    values = values.astype(np.uint32)
    with np.errstate(over="ignore"):
        return ((values >> np.uint32(15)) | (values << np.uint32(17))) + np.uint32(0xA282EAD8)
