"""Words of whole texts as numpy arrays: byte classes, 64-bit word hashes, rolling hashes of word windows.

Everything works on the byte buffer of an Arrow string column, so no Python object is made per word. Hashes are
polynomials modulo 2**64 over odd bases, mixed per word; two different sequences get the same value with a chance of
about 2**-60 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tracemill.llm import memory

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
LENGTH_SALT = np.uint64(0xA0761D6478BD642F)
#: Text bytes handled at once; a longer text is still taken whole.
BLOCK_BYTES = (1 << 20) - 2

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


memory.remembered(_powers.clear)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table over the 256 byte values, true for those in one of the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: All but the ASCII white space 09-0D and 20.
NOT_SPACE = byte_class((0, 8), (14, 31), (33, 255))
#: ASCII letters and digits and every non-ASCII character.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def powers(base: np.uint64, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, ``count`` of each."""
    kept = _powers.get(int(base))
    if kept is None or len(kept[0]) < count:
        size = 1 << max(16, int(count - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            made = []
            for b in (base, inverse):
                full = np.full(size, b, np.uint64)
                full[0] = 1
                made.append(np.multiply.accumulate(full))
        kept = (made[0], made[1])
        if size <= 1 << 21:
            _powers[int(base)] = kept
    return kept[0][:count], kept[1][:count]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The byte buffer of a string column and ``len + 1`` offsets into it; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the buffer, and for each text the number of words before it."""
    inside = np.concatenate([table[data], [False]])
    before = np.concatenate([[False], inside[:-1]])
    before[offsets] = False
    first = inside & ~before
    after = np.concatenate([inside[1:], [False]])
    after[offsets[offsets > 0] - 1] = False
    last = inside & ~after
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    up, down = powers(BYTE_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * LENGTH_SALT)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The rolling (Rabin-Karp) hash of every ``width`` consecutive words; empty if there are fewer."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    up, down = powers(WORD_BASE, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:len(words)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:len(words) - width + 1] + np.uint64(width))


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text number of each word, from the word bounds of the texts."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, at least one text each."""
    offsets = flat_bytes(texts)[1]
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), len(texts))
        yield begin, end
        begin = end
