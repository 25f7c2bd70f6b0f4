"""Byte-level BPE by corpus-level merge replay.

The texts of one slice of a partition form a corpus. Its distinct words (pattern matches) are laid out as one
array of symbols, and an inverted index leads from each adjacent pair to the positions where it stands. Merges
are then replayed in rank order: a merge touches only the positions of its pair, joins them from left to right,
and files the pairs with the two neighbours anew. Each distinct word is therefore encoded once per slice and
remembered for later slices of the task, however often it occurs.

No shuffle is needed, and memory is bounded by the slice and by REMEMBER_BYTES of stretches.
"""

from __future__ import annotations

import base64
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 3_000_000
REMEMBER_BYTES = 24_000_000  # of stretches that a task keeps with their ids, each counted with ENTRY_BYTES of its own
ENTRY_BYTES = 200
REMEMBER_PAIRS = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes many distinct words together with the merges of one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.width = max(self.tokens, default=0) + 1
        self.joined: dict[int, int] = {}

    def rank_of(self, pair: int) -> int:
        """Rank of the merge of a pair (coded left * width + right), -1 if there is none."""
        found = self.joined.get(pair)
        if found is None:
            left, right = divmod(pair, self.width)
            found = self.joined[pair] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(words)
        rest = []
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is None and word:
                rest.append(i)
            else:
                out[i] = b"" if whole is None else whole.to_bytes(4, "little")
        if len(self.joined) > REMEMBER_PAIRS:
            self.joined.clear()
        if rest:
            self._replay([words[i] for i in rest], rest, out)
        return out  # type: ignore[return-value]

    def _replay(self, words: list[bytes], slots: list[int], out: list) -> None:
        single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        symbol = single[np.frombuffer(b"".join(words), np.uint8)]
        n, width = len(symbol), self.width
        following = np.arange(1, n + 1, dtype=np.int32)
        following[bounds[1:] - 1] = -1
        preceding = np.arange(-1, n - 1, dtype=np.int32)
        preceding[bounds[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}
        queue: list[tuple[int, int]] = []

        def file(places: np.ndarray, pairs: np.ndarray) -> None:
            """Adds places to the index; pairs that no merge joins are left out."""
            order = np.argsort(pairs, kind="stable")
            places, pairs = places[order], pairs[order]
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            for pair, low, high in zip(pairs[first].tolist(), first.tolist(), [*first[1:].tolist(), len(pairs)]):
                rank = self.rank_of(pair)
                if rank < 0:
                    continue
                if pair in index:
                    index[pair].append(places[low:high])
                else:
                    index[pair] = [places[low:high]]
                    heapq.heappush(queue, (rank, pair))

        start = np.flatnonzero(following >= 0).astype(np.int32)
        if len(start):
            file(start, symbol[start] * width + symbol[start + 1])
        while queue:
            rank, pair = heapq.heappop(queue)
            left, right = divmod(pair, width)
            found = index.pop(pair)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            after = following[at]
            good = (symbol[at] == left) & (after >= 0)
            good &= symbol[np.maximum(after, 0)] == right  # else an earlier merge took one side
            at, after = at[good], after[good]
            if left == right and len(at) > 1:  # from left to right: a joined symbol takes part once
                at = np.sort(at)
                taken, chosen = -1, []
                for place, beside in zip(at.tolist(), following[at].tolist()):
                    if place != taken:
                        chosen.append(place)
                        taken = beside
                at = np.array(chosen, np.int32)
                after = following[at]
            if not len(at):
                continue
            beyond = following[after]
            symbol[at], symbol[after] = rank, -1
            following[at] = beyond
            ahead = beyond >= 0
            preceding[beyond[ahead]] = at[ahead]
            before = preceding[at]
            behind = before >= 0
            places = np.concatenate([at[ahead], before[behind]])
            if len(places):
                file(places, np.concatenate([rank * width + symbol[beyond[ahead]], symbol[before[behind]] * width + rank]))
        kept = symbol >= 0
        places = 4 * np.concatenate([[0], np.cumsum(kept)])[bounds]
        packed = symbol[kept].astype("<u4").tobytes()
        for slot, low, high in zip(slots, places[:-1].tolist(), places[1:].tolist()):
            out[slot] = packed[low:high]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Ids of every text, and what they decode to.

    Returns the columns `keep` (all by default) with n_tokens long, ids binary (little-endian unsigned 32-bit) and
    decoded binary added; columns of these names are replaced. Null and empty text give no ids. The rank file must
    lie at `ranks_path` on every executor. Rows are independent: repeated rows give repeated results.
    """
    added = ["n_tokens", "ids", "decoded"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    columns = list(dict.fromkeys([*keep, text]))
    schema = T.StructType([docs.schema[c] for c in keep])
    schema = schema.add("n_tokens", T.LongType()).add("ids", T.BinaryType()).add("decoded", T.BinaryType())

    def encode(batches):
        import regex

        replay = MergeReplay(read_ranks(ranks_path))
        token = replay.tokens.__getitem__
        find = regex.compile(pattern).findall
        text_at = columns.index(text)
        # A blank before a character that is no white space always begins a word of the pattern. Where a text has no
        # other blanks, its stretches from blank to blank are encoded once each; else its words are.
        other_blank = re.compile(r" (?:\s|\Z)").search

        def stretches(value: str) -> list[str]:
            if not value:
                return []
            if other_blank(value):
                return find(value)
            first, *rest = value.split(" ")
            return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

        known: dict[str, bytes] = {}
        held = 0
        for batch in batches:
            size = batch.column(text_at).nbytes / max(1, batch.num_rows)
            rows = max(1, int(SLICE_BYTES / max(1, size)))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                texts = part.column(text_at).to_pylist()
                used: set[str] = set()
                for value in texts:
                    used.update(stretches(value))
                fresh = list(used.difference(known))
                if held > REMEMBER_BYTES:
                    known.clear()
                    held, fresh = 0, list(used)
                pieces = [find(x) for x in fresh]
                words = list({w for piece in pieces for w in piece})
                ids_of = dict(zip(words, replay.encode([w.encode() for w in words])))
                for stretch, piece in zip(fresh, pieces):
                    ids = known[stretch] = b"".join([ids_of[w] for w in piece])
                    held += len(stretch) + len(ids) + ENTRY_BYTES
                ids = [b"".join([known[x] for x in stretches(value)]) for value in texts]
                decoded = [b"".join(map(token, np.frombuffer(row, "<u4").tolist())) for row in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(columns.index(c)) for c in keep]
                    + [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                    names=[*keep, *added],
                )

    return docs.select(*columns).mapInArrow(encode, schema)
