"""Substring dedup on words by prefix-partitioned suffix trees.

Every window start is a suffix of the corpus, cut off at the window length, for deeper nodes say nothing new. Suffixes
are split into groups by a prefix of variable length: it ends with the smallest gram of the window, or, where that
prefix is too frequent for one group's memory, it is the whole window (see repeats). A group's subtree is grown in
rounds of STRIDE words: suffixes at one node are told apart by their next words, a suffix alone at a node is a leaf and
is dropped. A node of full depth with two suffixes or more is a repeat, and all its suffixes are repeated windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tableseek.llm.repeats import Windows, find_repeats, ragged

WINDOW = 35
GRAM = 12
STRIDE = 5


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each different pair."""
    return np.unique(left * (right.max(initial=0) + 1) + right, return_inverse=True)[1]


def _blocks(symbol: np.ndarray, stride: int) -> np.ndarray:
    """A number for each different run of `stride` symbols, exactly; runs past the end are cut."""
    padded = np.concatenate([symbol, np.zeros(stride, np.int64)])
    name = padded[: len(symbol)]
    for i in range(1, stride):
        name = _named(name, padded[i : i + len(symbol)])
    return name


def deep_nodes(symbol: np.ndarray, suffix: np.ndarray, times: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes (positions in symbol) share their first `depth` symbols with another; times: copies of each."""
    out = np.zeros(len(suffix), bool)
    stride = STRIDE if depth % STRIDE == 0 else 1
    block = _blocks(symbol, stride)
    here, node = np.arange(len(suffix)), np.zeros(len(suffix), np.int64)
    for level in range(0, depth, stride):
        node = _named(node, block[suffix[here] + level])
        inner = np.bincount(node, times[here])[node] > 1  # the others are leaves
        here, node = here[inner], node[inner]
        if not len(here):
            return out
    out[here] = True
    return out


def _resolver(window: int):
    def resolve(raw, starts, windows, times):
        ends = np.append(starts[1:], len(raw))
        spaced = np.full(len(raw) + len(starts), 32, np.uint8)
        spaced[np.arange(len(raw)) + np.repeat(np.arange(len(starts)), ends - starts)] = raw
        words = spaced.tobytes().split()
        number: dict[bytes, int] = {}
        symbol = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        sizes = windows + window - 1  # words of each segment
        suffix = ragged(np.cumsum(sizes) - sizes, windows)
        return deep_nodes(symbol, suffix, np.repeat(times, windows), window).astype(np.int64)

    return resolve


def remove_repeated_passages(docs: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW, gram: int = GRAM, **sizes: int) -> DataFrame:
    """Removes each word covered by `window` consecutive words that also start elsewhere, the same document included.

    Words are maximal runs of bytes other than ASCII white space. Windows are judged on the input. Returns the columns
    `keep` with kept (string, the words left, joined by one space), n_words and n_removed (long) added; columns of
    these names are replaced. Null and empty texts have no words. Repeated rows are copies of each other, so all their
    words go if there are `window` or more; ids play no part and may be null or repeated.
    """
    added = T.StructType().add("kept", T.StringType()).add("n_words", T.LongType()).add("n_removed", T.LongType())

    def render(part, removed):
        sums = np.concatenate([[0], np.cumsum(removed)])
        gone = sums[part.bounds[1:]] - sums[part.bounds[:-1]]
        words = np.diff(part.bounds)
        kept = []
        raw, left = part.raw.tobytes(), ~removed
        for row in range(len(words)):
            low, high = part.bounds[row], part.bounds[row + 1]
            if low == high or gone[row] == high - low:
                kept.append("")
                continue
            if gone[row]:
                at = low + np.flatnonzero(left[low:high])
                kept.append(b" ".join([raw[a:b] for a, b in zip(part.starts[at].tolist(), part.ends[at].tolist())]).decode())
            else:
                kept.append(b" ".join(raw[part.starts[low] : part.ends[high - 1]].split()).decode())
        return {"kept": pa.array(kept, pa.string()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(gone, pa.int64())}

    return find_repeats(docs, Windows(window, gram, True, **sizes), text, None, keep, _resolver(window), added, render)
