"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel. Each partition sums its part of the normal equations, Spark adds the
parts, and the driver solves one system of fixed size (FEATURES + 1). Calibration pools adjacent violators over a
histogram of out-of-fold scores with a fixed number of bins. All labelled rows take part; nothing is sampled.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableseek.llm.arrays import slices_by_bytes, text_views, word_hashes, words_of
from tableseek.llm.scratch import stored

SLICE_BYTES = 500_000
FEATURES = 256
WIDTH = 4.0  # of the kernel, in standard deviations of the statistics
FOLDS = 4
BINS = 2048
LOW, HIGH = -0.5, 1.5  # range of the score histogram
RIDGES = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)  # per labelled row
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "bytes_per_word", "word_size_spread", "longest_word",
    "share_upper", "share_digits", "share_symbols", "share_marks", "share_stops", "share_non_ascii", "share_space",
    "share_pipes", "share_shouted_words", "share_symbol_words", "share_lone_symbols", "share_capitalised",
    "distinct_words", "share_top_pairs", "repeated_lines", "words_per_line", "share_short_words", "share_controls",
)


def _members(characters: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(characters)] = 1
    return out


_UPPER = _members(bytes(range(65, 91)))
_LOWER = _members(bytes(range(97, 123)))
_DIGIT = _members(bytes(range(48, 58)))
_SYMBOL = _members(b"#*$%&<>=@\\^_~{}[]+/`")
_MARK = _members(b"!?")
_STOP = _members(b".,;:")
_SPACE = _members(b" \t\n\x0b\x0c\r")
_PIPE = _members(b"|")
_HIGH = _members(bytes(range(128, 256)))
_CONTROL = _members(bytes(x for x in range(32) if x not in (9, 10, 11, 12, 13)))


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the number of distinct keys; the row and the count of every distinct key."""
    if not len(rows):
        return np.zeros(n, np.int64), rows, rows
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])]))
    counts = np.diff(np.concatenate([first, [len(r)]]))
    return np.bincount(r[first], minlength=n), r[first], counts


def document_statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets).astype(float)
    starts, ends, first = words_of(raw, offsets)
    words = np.diff(first).astype(float)
    per_byte, per_word = np.maximum(sizes, 1), np.maximum(words, 1)

    def running(members):
        out = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(members[raw], out=out[1:])
        return out

    def of_rows(sums):
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def of_words(flags):
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[first[1:]] - sums[first[:-1]]

    sums = {k: running(v) for k, v in {"upper": _UPPER, "lower": _LOWER, "digit": _DIGIT, "symbol": _SYMBOL, "mark": _MARK, "stop": _STOP, "space": _SPACE, "pipe": _PIPE, "high": _HIGH, "control": _CONTROL}.items()}
    row = {k: of_rows(v) for k, v in sums.items()}
    in_word = {k: sums[k][ends] - sums[k][starts] for k in ("upper", "lower", "symbol", "pipe", "mark")}
    length = (ends - starts).astype(float)
    odd = in_word["symbol"] + in_word["pipe"]
    word_rows = np.repeat(np.arange(n), words.astype(np.int64))
    hashes = word_hashes(raw, starts, ends)
    distinct, _, _ = _distinct(word_rows, hashes, n)
    same_row = word_rows[1:] == word_rows[:-1] if len(word_rows) else np.zeros(0, bool)
    pairs = (hashes[:-1] * np.uint64(3) + hashes[1:])[same_row]
    _, pair_rows, pair_counts = _distinct(word_rows[1:][same_row], pairs, n)
    repeated_pairs = np.bincount(pair_rows, np.where(pair_counts > 1, pair_counts, 0), minlength=n)
    breaks = np.flatnonzero(raw == 10)
    line_starts = np.union1d(offsets[:-1][sizes > 0], breaks + 1)
    line_starts = line_starts[line_starts < len(raw)]
    line_ends = np.minimum(np.append(line_starts[1:], len(raw)), offsets[np.searchsorted(offsets, line_starts, side="right")])
    line_rows = np.searchsorted(offsets, line_starts, side="right") - 1
    line_keys = word_hashes(raw, line_starts, line_ends - (raw[np.maximum(line_ends - 1, 0)] == 10)) if len(line_starts) else np.zeros(0, np.uint64)
    lines = np.bincount(line_rows, minlength=n).astype(float)
    distinct_lines, _, _ = _distinct(line_rows, line_keys, n)
    mean = of_words(length) / per_word
    spread = np.sqrt(np.maximum(of_words(length**2) / per_word - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, word_rows, length)
    letters = np.maximum(row["upper"] + row["lower"], 1)
    columns = [
        np.log1p(sizes), np.log1p(words), np.log1p(lines), mean, spread, np.log1p(longest),
        row["upper"] / letters, row["digit"] / per_byte, row["symbol"] / per_byte, row["mark"] / per_byte, row["stop"] / per_byte,
        row["high"] / per_byte, row["space"] / per_byte, row["pipe"] / per_byte,
        of_words((in_word["upper"] >= 2) & (in_word["lower"] == 0)) / per_word, of_words(odd > 0) / per_word,
        of_words(odd == length) / per_word, of_words((in_word["upper"] == 1) & (in_word["lower"] > 0)) / per_word,
        distinct / per_word, repeated_pairs / per_word, 1 - distinct_lines / np.maximum(lines, 1), np.log1p(words / np.maximum(lines, 1)),
        of_words(length <= 3) / per_word, row["control"] / per_byte,
    ]
    return np.stack(columns, 1)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    levels: np.ndarray  # raw scores, ascending
    chances: np.ndarray  # calibrated chance of label 1 at each level
    ridge: float
    labelled: int

    def fourier(self, statistics: np.ndarray) -> np.ndarray:
        return fourier_features((statistics - self.mean) / self.scale)

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return self.fourier(statistics) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        if not len(self.levels):
            return np.full(len(statistics), 0.5)
        return np.interp(self.raw(statistics), self.levels, self.chances)


def fourier_features(x: np.ndarray) -> np.ndarray:
    """sqrt(2 / D) cos(w x + b) with fixed draws, and a constant."""
    draws = np.random.default_rng(11)
    w = draws.normal(size=(len(STATISTICS), FEATURES)) / WIDTH
    b = draws.uniform(0, 2 * np.pi, FEATURES)
    z = np.cos(np.clip(x, -8, 8) @ w + b) * np.sqrt(2 / FEATURES)
    return np.concatenate([z, np.ones((len(z), 1))], 1)


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def statistics(docs: DataFrame, keep: list[str], text: str = "text", model: QualityModel | None = None) -> DataFrame:
    """The columns `keep` with `statistics` (array of double) or, given a model, `score` (double) added.

    Null and empty texts have zero counts and are scored like any other. A kept column of the added name is replaced.
    """
    added = "statistics" if model is None else "score"
    keep = [c for c in keep if c != added]
    columns = list(dict.fromkeys([*keep, text]))
    schema = T.StructType([docs.schema[c] for c in keep]).add(added, T.ArrayType(T.DoubleType()) if model is None else T.DoubleType())

    def measure(batches):
        for batch in batches:
            raw, offsets = text_views(batch.column(columns.index(text)))
            parts = []
            for start, end in slices_by_bytes(offsets, SLICE_BYTES):
                at, to = offsets[start], offsets[end]
                found = document_statistics(raw[at:to], offsets[start : end + 1] - at)
                parts.append(found if model is None else model.score(found))
            values = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)) if model is None else 0)
            out = pa.array(values) if model is not None else pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * len(STATISTICS), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(columns.index(c)) for c in keep], out], names=[*keep, added])

    return docs.select(*columns).mapInArrow(measure, schema)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(STATISTICS))


def _sums(labelled: DataFrame, mean: np.ndarray, scale: np.ndarray) -> dict[int, np.ndarray]:
    """For each fold the sums of z z', z y and y y as one matrix, summed by partition and then by Spark."""
    size = FEATURES + 2

    def partial(batches):
        total = np.zeros((FOLDS, size, size))
        seen = False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            z = fourier_features((_matrix(batch.column(0)) - mean) / scale)
            both = np.concatenate([z, np.asarray(batch.column(1), float)[:, None]], 1)
            fold = np.asarray(batch.column(2))
            for f in range(FOLDS):
                total[f] += both[fold == f].T @ both[fold == f]
        if seen:
            keys = np.arange(FOLDS * size)
            part = zlib.crc32(total.tobytes()) % 32
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), part)), pa.array(list(total.reshape(-1, size)), pa.list_(pa.float64()))], names=["line", "part", "total"])

    def add(key, table):
        lines = np.stack(table.column("total").to_pylist()).sum(0)
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([-1]), pa.array([lines.tolist()], pa.list_(pa.float64()))], names=["line", "part", "total"])

    schema = "line long, part long, total array<double>"
    parts = labelled.select("statistics", "quality", "fold").mapInArrow(partial, schema)
    halves = parts.groupBy("line", "part").applyInArrow(add, schema)
    rows = halves.groupBy("line").applyInArrow(add, schema).collect()  # FOLDS * (FEATURES + 2) rows whatever the input
    out = np.zeros((FOLDS * size, size))
    for row in rows:
        out[row["line"]] = row["total"]
    return dict(enumerate(out.reshape(FOLDS, size, size)))


def _solve(total: np.ndarray, ridge: float) -> np.ndarray:
    rows = total[-2, -2]
    penalty = np.eye(FEATURES + 1) * ridge * max(rows, 1)
    penalty[-1, -1] = 1e-9  # the constant is free
    return np.linalg.solve(total[:-1, :-1] + penalty, total[:-1, -1])


def pool_violators(level: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of ones / rows over ascending levels: centre and chance of each block."""
    blocks: list[list[float]] = []
    for x, a, b in zip(level, ones, rows):
        if not b:
            continue
        blocks.append([x * b, a, b])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit_quality(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> QualityModel:
    """Learns `labels.quality` from a table of (doc_id, statistics), without the held-out rows.

    Null labels and labels without a document are ignored; several labels of one document all count. Without any
    labelled row the model scores 0.5 everywhere.
    """
    fold = F.pmod(F.xxhash64(F.col(doc_id), F.lit("fold")), F.lit(FOLDS)).cast("long")
    marks = labels.where(F.col("quality").isNotNull() & ~held_out(doc_id)).select(doc_id, F.col("quality").cast("double").alias("quality"))
    labelled = stored(measured.select(doc_id, "statistics").join(marks, doc_id).select("statistics", "quality", fold.alias("fold")), "labelled")
    at = [F.col("statistics")[i] for i in range(len(STATISTICS))]
    got = labelled.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)]).first()
    empty = np.zeros(0)
    if not got["n"]:
        return QualityModel(np.zeros(len(at)), np.ones(len(at)), np.zeros(FEATURES + 1), empty, empty, 0.0, 0)
    mean = np.array([got[f"m{i}"] for i in range(len(at))])
    scale = np.array([got[f"s{i}"] for i in range(len(at))])
    scale = np.where(scale > 1e-9, scale, 1.0)
    folds = _sums(labelled, mean, scale)
    total = sum(folds.values())

    def loss(ridge):
        """Squared error on each fold of the weights that the other folds give, from the sums alone."""
        out = 0.0
        for part in folds.values():
            w = np.append(_solve(total - part, ridge), -1.0)
            out += w @ part @ w
        return out

    ridge = min(RIDGES, key=loss)
    without = np.stack([_solve(total - folds[f], ridge) for f in range(FOLDS)])

    def histogram(batches):
        for batch in batches:
            z = fourier_features((_matrix(batch.column(0)) - mean) / scale)
            raw = np.einsum("ij,ij->i", z, without[np.asarray(batch.column(2))])
            bins = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(np.asarray(batch.column(1), float)), pa.array(np.ones(len(bins), np.int64))], names=["bin", "ones", "n"])

    counted = labelled.select("statistics", "quality", "fold").mapInArrow(histogram, "bin long, ones double, n long")
    rows = sorted(counted.groupBy("bin").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).collect())  # at most BINS rows
    level = LOW + (np.array([r["bin"] for r in rows]) + 0.5) * (HIGH - LOW) / BINS
    # half a positive and half a negative row spread over all bins keep the chances off 0 and 1
    weight = 1.0 / len(rows)
    levels, chances = pool_violators(level, np.array([r["ones"] for r in rows]) + weight / 2, np.array([r["n"] for r in rows], float) + weight)
    return QualityModel(mean, scale, _solve(total, ridge), levels, chances, ridge, got["n"])


def score_measured(measured: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """As score_documents, from a table with `statistics`."""

    def apply(batches):
        for batch in batches:
            values = model.score(_matrix(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values)], names=[*keep, "score"])

    schema = T.StructType([measured.schema[c] for c in keep]).add("score", T.DoubleType())
    scored = measured.select(*keep, "statistics").mapInArrow(apply, schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_documents(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with score (0 to 1) and predicted (1 if score >= 0.5, else 0) added."""
    return statistics(docs, [c for c in keep if c != "predicted"], text, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
