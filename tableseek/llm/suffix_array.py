"""Suffix-array dedup on bytes by two-stage sorting.

Groups of segments (see repeats) form the text of one suffix array. Its first stage sorts only the suffixes that are
smaller than their successors, directly, by their first bytes. Its second stage induces the rest: scanning the array
from the smallest first byte up, the suffix before each entry is appended to the bucket of its own first byte. Common
prefixes of neighbours in the array then show which windows are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tableseek.llm.repeats import Windows, find_repeats, ragged

WINDOW = 50
GRAM = 24


def _loads(raw: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each position on, as one big-endian number; zeros follow the text."""
    padded = np.concatenate([raw, np.zeros(depth + 8, np.uint8)])
    return np.ndarray((len(padded) - 7,), ">u8", padded.tobytes(), 0, (1,))


def smaller_than_successor(raw: np.ndarray) -> np.ndarray:
    """Suffixes smaller than the one that starts a byte later; the empty suffix is the smallest."""
    n = len(raw)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(raw[1:].astype(np.int16) - raw[:-1])
    step[-1] = -1
    decides = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    return step[decides] > 0


def suffix_array(raw: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of raw, sorted by their first `depth` bytes at least."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_successor(raw)
    direct = np.flatnonzero(small)
    loads = _loads(raw, depth)
    direct = direct[np.lexsort([loads[direct + at].astype(np.uint64) for at in range(8 * ((depth - 1) // 8), -1, -8)])]
    edges = np.searchsorted(raw[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[raw[-1]].append(np.array([n - 1]))  # it stands before the empty suffix
    out = []
    for byte in range(256):
        induced = []
        fresh = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(fresh):  # runs of one byte induce within their own bucket
            induced.append(fresh)
            before = fresh[fresh > 0] - 1
            fresh = before[raw[before] == byte]
        bucket = np.concatenate([*induced, direct[edges[byte] : edges[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (raw[before] > byte)]
        first = raw[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else []
        for low, high in zip(cuts, np.append(cuts[1:], len(first)) if len(first) else []):
            waiting[first[low]].append(before[low:high])
    return np.concatenate(out)


def common_prefix_reaches(raw: np.ndarray, entries: np.ndarray, depth: int) -> np.ndarray:
    """For each entry whether it shares its first `depth` bytes with the entry before it."""
    loads = _loads(raw, depth)
    same = np.zeros(len(entries), bool)
    if len(entries) < 2:
        return same
    a, b = entries[1:], entries[:-1]
    equal = np.ones(len(a), bool)
    whole = depth // 8 * 8
    for at in range(0, whole, 8):
        equal &= loads[a + at] == loads[b + at]
    for at in range(whole, depth):
        equal &= loads[a + at] >> np.uint64(56) == loads[b + at] >> np.uint64(56)
    same[1:] = equal
    return same


def _resolver(window: int):
    def resolve(raw, starts, windows, marks):
        start = ragged(starts, windows)
        mark = np.repeat(marks, windows)
        number = np.full(len(raw), -1, np.int64)
        number[start] = np.arange(len(start))
        entries = suffix_array(raw, window)
        entries = entries[number[entries] >= 0]
        group = np.cumsum(~common_prefix_reaches(raw, entries, window)) - 1
        least = np.full(len(entries), np.iinfo(np.int64).max)
        np.minimum.at(least, group, mark[number[entries]])
        out = np.empty(len(start), np.int64)
        out[number[entries]] = least[group]
        return out

    return resolve


def remove_repeated_bytes(docs: DataFrame, keep: list[str], text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, **sizes: int) -> DataFrame:
    """Removes each byte covered by `window` bytes that also start in a document with a smaller id.

    Texts are taken as UTF-8 and judged on the input; matches never cross documents. Returns the columns `keep` with
    kept (binary, the bytes left), n_bytes, n_removed and n_spans (long, maximal removed runs) added; columns of these
    names are replaced. Null and empty texts have no bytes. A null id is larger than every other and rows of one id
    (or without one) do not count as smaller than each other.
    """
    added = T.StructType().add("kept", T.BinaryType()).add("n_bytes", T.LongType()).add("n_removed", T.LongType()).add("n_spans", T.LongType())

    def render(part, removed):
        rows = np.diff(part.bounds)
        sums = np.concatenate([[0], np.cumsum(removed)])
        begins = np.zeros(len(removed), bool)
        if len(removed):
            begins[1:] = removed[1:] & ~removed[:-1]
            first = part.bounds[:-1][rows > 0]
            begins[first] = removed[first]
        spans = np.concatenate([[0], np.cumsum(begins)])
        low, high = part.bounds[:-1], part.bounds[1:]
        left = part.raw[~removed]
        ends = np.concatenate([[0], np.cumsum(rows - (sums[high] - sums[low]))])
        data = left.tobytes()
        return {
            "kept": pa.array([data[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
            "n_bytes": pa.array(rows, pa.int64()),
            "n_removed": pa.array(sums[high] - sums[low], pa.int64()),
            "n_spans": pa.array(spans[high] - spans[low], pa.int64()),
        }

    return find_repeats(docs, Windows(window, gram, False, **sizes), text, doc_id, keep, _resolver(window), added, render)
