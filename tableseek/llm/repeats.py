"""Finding all windows of a fixed length that start in more than one place of a corpus.

A window is `length` consecutive units (words or bytes) of one document. Each window is named by its minimiser: the
smallest hash among its grams of `gram` units. The name depends on the window alone, so equal windows meet whatever
stands around them, and neighbouring windows mostly share one name, so they travel as one segment.

0. Whole texts that stand more than once are found by digest first. One of them speaks for all; the others are copies
   from end to end, which settles them.
1. announce: each chunk of documents sends its distinct names to buckets, once per chunk.
2. meet: a bucket tells each chunk which of its names occur twice or more in the corpus (one bit a name).
   A window can only repeat if its name does.
3. send: chunks send the distinct segments of such windows. Names that occur in many places (`hot`) are replaced by
   longer ones: each of their windows is sent alone, named by its whole content.
4. resolve: a bucket sorts the windows of its segments exactly (the operator's own method) and answers per window.
5. finish: each chunk marks the units that its repeated windows cover.

Copies within a chunk are sent once, so a passage that a third of all documents share costs at most one segment per
chunk. Chunks and buckets are dealt by hashes and sized in bytes; every round is a shuffle, which Spark can redo.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableseek.llm.arrays import byte_values, gram_hashes, prefix_sums, range_hash, slices_by_bytes, sliding, text_views, word_hashes, words_of
from tableseek.llm.scratch import stored

SLICE_BYTES = 1_000_000
CHUNK = "__chunk"
LAST = 2**63 - 1


@dataclass(frozen=True)
class Windows:
    length: int
    gram: int
    words: bool  # units are words, else bytes
    chunk_bytes: int = 3_000_000
    bucket_bytes: int = 4_000_000
    part_bytes: int = 1_000_000  # of segments sorted at once
    hot: int = 2000  # places in which a name is too frequent to keep its windows together


@dataclass
class Slice:
    """Texts of some rows of a chunk, cut to units."""

    raw: np.ndarray
    first_row: int
    bounds: np.ndarray  # first unit of each row, and the end
    starts: np.ndarray | None  # byte range of each word; None where units are bytes
    ends: np.ndarray | None
    sums: np.ndarray
    run_start: np.ndarray  # windows run_start..run_end share the name run_name
    run_end: np.ndarray
    run_name: np.ndarray
    place: np.ndarray  # units where a minimiser starts, and its hash
    place_name: np.ndarray


def cut(raw: np.ndarray, offsets: np.ndarray, first_row: int, of: Windows) -> Slice:
    if of.words:
        starts, ends, bounds = words_of(raw, offsets)
        values = word_hashes(raw, starts, ends)
    else:
        starts = ends = None
        bounds, values = offsets, byte_values(raw)
    sums = prefix_sums(values)
    none = np.zeros(0, np.int64)
    windows = len(values) - of.length + 1
    if windows <= 0:
        return Slice(raw, first_row, bounds, starts, ends, sums, none, none, none.astype(np.uint64), none, none.astype(np.uint64))
    grams = gram_hashes(sums, of.gram)
    span = of.length - of.gram + 1
    least = sliding(grams, span, np.minimum)
    fits = np.repeat(bounds[1:], np.diff(bounds))[:windows] >= np.arange(of.length, of.length + windows)
    least = np.where(fits, least, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    place = np.flatnonzero((sliding(padded, span, np.maximum) == grams) & (grams > 0))
    run_start = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (fits[1:] != fits[:-1])]))
    run_end = np.append(run_start[1:], windows) - 1
    good = fits[run_start]
    run_start, run_end = run_start[good], run_end[good]
    return Slice(raw, first_row, bounds, starts, ends, sums, run_start, run_end, least[run_start], place, grams[place])


def cuts(column, of: Windows) -> list[Slice]:
    raw, offsets = text_views(column)
    return [cut(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, of) for a, b in slices_by_bytes(offsets, SLICE_BYTES)]


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def names_in(slices: list[Slice], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names of a chunk by bucket and hash, how often each stands there (255 at most), and the bucket bounds."""
    names = np.concatenate([s.place_name for s in slices]) if slices else np.zeros(0, np.uint64)
    names, counts = np.unique(names, return_counts=True)
    bucket = bucket_of(names, buckets)
    order = np.lexsort((names & np.uint64(0xFFFFFFFFFFFF), bucket))
    return names[order], np.minimum(counts[order], 255).astype(np.uint8), np.searchsorted(bucket[order], np.arange(buckets + 1))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ahead = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - ahead, sizes)


def live_segments(part: Slice, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose name is in `shared` (ascending): first window, last window, name."""
    known = is_in(part.run_name, shared)
    return part.run_start[known], part.run_end[known], part.run_name[known]


def is_in(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


@dataclass
class Segments:
    """All segments of a chunk, and the distinct ones in the order in which they are sent."""

    slice_no: np.ndarray
    first: np.ndarray  # window
    count: np.ndarray  # windows
    same: np.ndarray  # number of the distinct segment
    example: np.ndarray  # segment that stands for each distinct one
    name: np.ndarray  # of each distinct one
    bounds: np.ndarray  # first distinct segment of each bucket, and the end
    times: np.ndarray  # how often each distinct segment stands in the chunk


def segments_in(slices: list[Slice], shared: np.ndarray, hot: np.ndarray, of: Windows, buckets: int) -> Segments:
    got: list[list[np.ndarray]] = [[] for _ in range(5)]
    for no, part in enumerate(slices):
        a, b, name = live_segments(part, shared)
        if len(hot) and len(a):
            split = is_in(name, hot)
            sizes = np.where(split, b - a + 1, 1)
            at = ragged(a, sizes)
            end = np.where(np.repeat(split, sizes), at, np.repeat(b, sizes))
            content = range_hash(part.sums, at, end + of.length)
            name = np.where(np.repeat(split, sizes), content, np.repeat(name, sizes))
            a, b = at, end
        else:
            content = range_hash(part.sums, a, b + of.length)
        for column, values in zip(got, (np.full(len(a), no), a, b - a + 1, name, content + (b - a).astype(np.uint64))):
            column.append(values)
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    slice_no, first, count, name, content = (np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(got, kinds))
    _, example, same, times = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
    bucket = bucket_of(name[example], buckets)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    example = example[order]
    return Segments(slice_no, first, count, rank[same], example, name[example], np.searchsorted(bucket[order], np.arange(buckets + 1)), times[order])


def segment_text(slices: list[Slice], segments: Segments, of: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the distinct segments, one after the other, and their sizes."""
    sizes = np.zeros(len(segments.example), np.int64)
    where = np.zeros(len(segments.example), np.int64)
    base, place = 0, []
    for s in slices:
        place.append(base)
        base += len(s.raw)
    for no, part in enumerate(slices):
        mine = np.flatnonzero(segments.slice_no[segments.example] == no)
        at = segments.first[segments.example[mine]]
        end = at + segments.count[segments.example[mine]] - 1 + of.length
        low, high = (part.starts[at], part.ends[end - 1]) if of.words else (at, end)
        where[mine], sizes[mine] = low + place[no], high - low
    raw = np.concatenate([s.raw for s in slices]) if slices else np.zeros(0, np.uint8)
    return raw[ragged(where, sizes)], sizes


def pack48(names: np.ndarray) -> bytes:
    return np.ascontiguousarray(names.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def covered(slices: list[Slice], flagged: list[np.ndarray], of: Windows) -> list[np.ndarray]:
    """For each slice, whether each unit lies in a flagged window. flagged: per segment occurrence, in one array a slice."""
    out = []
    for no, part in enumerate(slices):
        edge = np.zeros(len(part.sums) + of.length, np.int32)
        at = flagged[no]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + of.length, -1)
        out.append(np.cumsum(edge)[: len(part.sums) - 1] > 0)
    return out


def find_repeats(
    docs: DataFrame,
    of: Windows,
    text: str,
    order: str | None,
    keep: list[str],
    resolve: Callable,
    added: T.StructType,
    render: Callable,
) -> DataFrame:
    """The rounds described above.

    order: a long column; a window then counts as repeated where it also starts in a row with a smaller value (null is
    larger than all). Without it, where it also starts anywhere else.
    resolve(raw, starts, counts, marks): for segments that lie one after the other in raw (start bytes, window counts
    and marks), the answer per window: 1 or 0 for repeated ones without `order`, else the smallest mark.
    render(texts, units covered by row) -> columns `added` for the rows of one slice.
    """
    names = {f.name for f in added.fields}
    keep = [c for c in keep if c not in names]
    columns = list(dict.fromkeys([*keep, *([order] if order else []), text]))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks, buckets = max(1, math.ceil(total / of.chunk_bytes)), max(1, math.ceil(total / of.bucket_bytes))
    digests = [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(1), F.col(text)).alias("__h2")]
    dealt = docs.select(*columns, *digests, F.pmod(F.xxhash64(*columns), F.lit(chunks)).alias(CHUNK))
    text_at, order_at = columns.index(text), columns.index(order) if order else -1

    rank = F.coalesce(F.col(order).cast("long"), F.lit(LAST)) if order else F.lit(0).cast("long")
    local = dealt.groupBy("__h1", "__h2", CHUNK).agg(F.min(rank).alias("rank"), F.count(F.lit(1)).alias("n"))
    twice = local.groupBy("__h1", "__h2").agg(F.min("rank").alias("first"), F.min(CHUNK).alias("home"), F.sum("n").alias("n")).where("n > 1")
    copies = stored(local.join(twice.drop("n"), ["__h1", "__h2"]).select(CHUNK, "__h1", "__h2", "first", "home"), "copies")

    def settled(table: pa.Table, known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Rows that another one speaks for, and rows that are copies from end to end."""
        quiet = gone = np.zeros(table.num_rows, bool)
        if not known.num_rows or not table.num_rows:
            return quiet, gone
        mine = np.stack([np.asarray(table.column(c)) for c in ("__h1", "__h2")], 1).copy().view("i8,i8").ravel()
        theirs = np.stack([np.asarray(known.column(c)) for c in ("__h1", "__h2")], 1).copy().view("i8,i8").ravel()
        order_of = np.argsort(theirs)
        at = order_of[np.minimum(np.searchsorted(theirs[order_of], mine), len(theirs) - 1)]
        found = theirs[at] == mine
        if order:
            gone = found & (ranks_of(table) > np.asarray(known.column("first"))[at])
            return gone, gone
        return found & (np.asarray(known.column("home"))[at] != table.column(CHUNK)[0].as_py()), found

    def announce(table: pa.Table, known: pa.Table) -> pa.Table:
        chunk = table.column(CHUNK).slice(0, 1).to_pylist()
        table = table.filter(pa.array(~settled(table, known)[0]))
        found, counts, bounds = names_in(cuts(table.column(text_at), of), buckets)
        some = np.flatnonzero(np.diff(bounds))
        return pa.table(
            {
                "bucket": pa.array(some, pa.int64()),
                CHUNK: pa.array(chunk * len(some), pa.int64()),
                "names": binary([pack48(found[bounds[i] : bounds[i + 1]]) for i in some]),
                "counts": binary([counts[bounds[i] : bounds[i + 1]].tobytes() for i in some]),
            }
        )

    def meet(table: pa.Table) -> pa.Table:
        sent = [unpack48(x) for x in table.column("names").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()]).astype(np.int64)
        _, same = np.unique(np.concatenate(sent), return_inverse=True)
        times = np.bincount(same, counts)[same]
        ends = np.cumsum([len(x) for x in sent])[:-1]
        return pa.table(
            {
                "bucket": table.column("bucket"),
                CHUNK: table.column(CHUNK),
                "shared": binary([np.packbits(x).tobytes() for x in np.split(times > 1, ends)]),
                "hot": binary([np.packbits(x).tobytes() if x.any() else b"" for x in np.split(times >= of.hot, ends)]),
            }
        )

    def known_names(slices, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        found, _, bounds = names_in(slices, buckets)
        shared, hot = np.zeros(len(found), bool), np.zeros(len(found), bool)
        for bucket, a, b in zip(*(replies.column(c).to_pylist() for c in ("bucket", "shared", "hot"))):
            low, high = bounds[bucket], bounds[bucket + 1]
            shared[low:high] = np.unpackbits(np.frombuffer(a, np.uint8), count=high - low)
            if b:
                hot[low:high] = np.unpackbits(np.frombuffer(b, np.uint8), count=high - low)
        return np.sort(found[shared]), np.sort(found[hot])

    def ranks_of(table: pa.Table) -> np.ndarray:
        return np.asarray(table.column(order_at).cast(pa.int64()).fill_null(LAST))

    def rows_of(part: Slice, units: np.ndarray) -> np.ndarray:
        return part.first_row + np.searchsorted(part.bounds, units, side="right") - 1

    def marks_of(table: pa.Table, slices, segments: Segments) -> np.ndarray:
        if not order:
            return np.minimum(segments.times, 2)
        ranks = ranks_of(table)
        least = np.full(len(segments.example), LAST)
        for no, part in enumerate(slices):
            mine = segments.slice_no == no
            np.minimum.at(least, segments.same[mine], ranks[rows_of(part, segments.first[mine])])
        return least

    def parted(both: pa.Table) -> list[pa.Table]:
        return [both.filter(pa.array(np.asarray(both.column("kind")) == k)) for k in range(3)]

    def send(table: pa.Table, both: pa.Table) -> pa.Table:
        known, replies, _ = parted(both)
        table = table.filter(pa.array(~settled(table, known)[0]))
        none = np.zeros(0, np.int64)
        slices, segments = [], None
        if table.num_rows and replies.num_rows:
            slices = cuts(table.column(text_at), of)
            segments = segments_in(slices, *known_names(slices, replies), of, buckets)
        if segments is None or not len(segments.example):
            some, raw, sizes, marks, bounds, ends = none, np.zeros(0, np.uint8), none, none, none, none
        else:
            raw, sizes = segment_text(slices, segments, of)
            marks = marks_of(table, slices, segments)
            bounds = segments.bounds
            some = np.flatnonzero(np.diff(bounds))
            ends = np.concatenate([[0], np.cumsum(sizes)])
        pieces = [slice(bounds[i], bounds[i + 1]) for i in some]
        return pa.table(
            {
                "bucket": pa.array(some, pa.int64()),
                CHUNK: pa.array(table.column(CHUNK).slice(0, 1).to_pylist() * len(some), pa.int64()),
                "text": binary([raw[ends[p.start] : ends[p.stop]].tobytes() for p in pieces]),
                "sizes": binary([sizes[p].astype("<i4").tobytes() for p in pieces]),
                "windows": binary([segments.count[segments.example[p]].astype("<i4").tobytes() for p in pieces]),
                "names": binary([segments.name[p].astype("<u4").tobytes() for p in pieces]),
                "marks": binary([marks[p].astype("<i8" if order else "u1").tobytes() for p in pieces]),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        def joined(column, kind):
            return np.frombuffer(b"".join(table.column(column).to_pylist()), kind).astype(np.int64)

        raw = np.frombuffer(b"".join(table.column("text").to_pylist()), np.uint8)
        sizes, windows, names = joined("sizes", "<i4"), joined("windows", "<i4"), joined("names", "<u4")
        marks = joined("marks", "<i8" if order else "u1")
        starts, slots = np.cumsum(sizes) - sizes, np.cumsum(windows) - windows
        out = np.zeros(int(windows.sum()), np.int64)
        by_name = np.argsort(names, kind="stable")
        ends = np.cumsum(sizes[by_name])
        last = np.flatnonzero(np.append(names[by_name][1:] != names[by_name][:-1], True))  # a name is not cut
        low = 0
        while low < len(by_name):
            full = last[np.searchsorted(ends[last], (ends[low - 1] if low else 0) + of.part_bytes)] if ends[-1] > (ends[low - 1] if low else 0) + of.part_bytes else last[-1]
            mine = by_name[low : full + 1]
            text_part = raw[ragged(starts[mine], sizes[mine])]
            out[ragged(slots[mine], windows[mine])] = resolve(text_part, np.cumsum(sizes[mine]) - sizes[mine], windows[mine], marks[mine])
            low = full + 1
        per_row = np.add.reduceat(windows, np.cumsum([0] + [len(x) // 4 for x in table.column("windows").to_pylist()])[:-1]) if len(windows) else []
        pieces = np.split(out, np.cumsum(per_row)[:-1]) if len(windows) else []
        values, runs = [], []
        for piece in pieces:
            if order:
                at = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
                values.append(piece[at].astype("<i8").tobytes())
                runs.append(np.diff(np.append(at, len(piece))).astype("<i4").tobytes())
            else:
                values.append(np.packbits(piece.astype(bool)).tobytes())
                runs.append(b"")
        return pa.table({"bucket": table.column("bucket"), CHUNK: table.column(CHUNK), "values": binary(values), "runs": binary(runs)})

    def flagged_windows(table, slices, segments: Segments, answers: pa.Table) -> list[np.ndarray]:
        """Start units of the repeated windows in each slice."""
        count = segments.count[segments.example]
        slots = np.cumsum(count) - count
        found = np.zeros(int(count.sum()), np.int64)
        edges = np.append(slots, len(found))
        for bucket, values, runs in zip(*(answers.column(c).to_pylist() for c in ("bucket", "values", "runs"))):
            low, high = edges[segments.bounds[bucket]], edges[segments.bounds[bucket + 1]]
            if order:
                found[low:high] = np.repeat(np.frombuffer(values, "<i8"), np.frombuffer(runs, "<i4"))
            else:
                found[low:high] = np.unpackbits(np.frombuffer(values, np.uint8), count=high - low)
        ranks = ranks_of(table) if order else None
        out = []
        for no, part in enumerate(slices):
            mine = np.flatnonzero(segments.slice_no == no)
            sizes = segments.count[mine]
            at = ragged(segments.first[mine], sizes)
            value = found[ragged(slots[segments.same[mine]], sizes)]
            if order:
                keep_window = np.repeat(ranks[rows_of(part, segments.first[mine])], sizes) > value
            else:
                keep_window = value > 0
            out.append(at[keep_window])
        return out

    result = T.StructType([docs.schema[c] for c in keep] + added.fields)

    def finish(table: pa.Table, both: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], pa.null()) for f in result.fields})
        known, replies, answers = parted(both)
        quiet, gone = settled(table, known)
        out = []
        for part, lost in ((table.filter(pa.array(~quiet)), gone[~quiet]), (table.filter(pa.array(quiet)), gone[quiet])):
            if not part.num_rows:
                continue
            slices = cuts(part.column(text_at), of)
            if answers.num_rows and not out:
                segments = segments_in(slices, *known_names(slices, replies), of, buckets)
                marked = covered(slices, flagged_windows(part, slices, segments, answers), of)
            else:
                marked = covered(slices, [np.zeros(0, np.int64)] * len(slices), of)
            for piece, mark in zip(slices, marked):
                units = np.diff(piece.bounds)
                whole = lost[piece.first_row : piece.first_row + len(units)] & (units >= of.length)
                mark |= np.repeat(whole, units)
            parts = [render(piece, mark) for piece, mark in zip(slices, marked)]
            made = {f.name: pa.concat_arrays([p[f.name] for p in parts]) for f in added.fields}
            out.append(pa.table([*[part.column(columns.index(c)) for c in keep], *made.values()], names=[*keep, *made]))
        return pa.concat_tables(out)

    empty = {"bucket": "long", "shared": "binary", "hot": "binary", "values": "binary", "runs": "binary", "__h1": "long", "__h2": "long", "first": "long", "home": "long"}

    def kind(df: DataFrame, number: int) -> DataFrame:
        return df.select(F.lit(number).alias("kind"), CHUNK, *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()])

    by_chunk = dealt.groupBy(CHUNK)
    spoken = by_chunk.cogroup(copies.groupBy(CHUNK)).applyInArrow(announce, f"bucket long, `{CHUNK}` long, names binary, counts binary")
    replies = spoken.groupBy("bucket").applyInArrow(meet, f"bucket long, `{CHUNK}` long, shared binary, hot binary")
    told = kind(copies, 0).unionAll(kind(replies, 1))
    sent = by_chunk.cogroup(told.groupBy(CHUNK)).applyInArrow(
        send, f"bucket long, `{CHUNK}` long, text binary, sizes binary, windows binary, names binary, marks binary"
    )
    answers = sent.groupBy("bucket").applyInArrow(answer, f"bucket long, `{CHUNK}` long, values binary, runs binary")
    return by_chunk.cogroup(told.unionAll(kind(answers, 2)).groupBy(CHUNK)).applyInArrow(finish, result)
