"""Numpy views of Arrow text: bytes, words and rolling hashes. Small helpers for code inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEPARATORS = b" \t\n\x0b\x0c\r"
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_BYTE_VALUE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def text_views(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)) or column.null_count or column.offset:
        column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices_by_bytes(offsets: np.ndarray, limit: int):
    """Row ranges of at most `limit` bytes each; a longer text stands alone, whole."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers, _inverses = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers, _inverses


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums, one longer than the input."""
    powers, _ = _power_table(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, whatever stands around it."""
    _, inverses = _power_table(len(sums))
    return mix((sums[ends] - sums[starts]) * inverses[starts])


def gram_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, inverses = _power_table(len(sums))
    return mix((sums[k:] - sums[:n]) * inverses[:n])


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[raw]


def words_of(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _IS_SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (one entry more than rows)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_sums(byte_values(raw)), starts, ends)


def sliding(values: np.ndarray, width: int, fold) -> np.ndarray:
    """fold (minimum or maximum) over every run of `width` values."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = fold(out[: len(out) - step], out[step:])
        done += step
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def one_of(values: bytes) -> np.ndarray:
    """A table of 256 that is true at these bytes."""
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


def dictionary_of(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """Number of each word in the list of distinct words, and that list; bytes are compared, not hashes.

    data: the bytes of all words, one after the other.
    """
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = words.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary
