"""Phrase collocation mining by best-first branch-and-bound growth.

A phrase's score is its count times all words of its language over the counts of its two parts, at the worst cut. Cutting
off the first word bounds it by 1000 n / f(first word), cutting off the last one by 1000 n / f(last word): counts of the
shortest prefix and suffix give admissible bounds, and no extension of a prefix has a higher one.

1. Words are counted per language; those with `least` occurrences are the roots of the prefix trees, highest bound (rarest
   word) first.
2. A round expands each language's first roots: phrases that begin or end with one of them grow from two words on, and
   only along pairs that are frequent themselves. All parts of a phrase whose ends are expanded, and all longer phrases
   around it, begin or end with an expanded word, so its score and its survival are settled in the same round.
3. A language is done when its `top`th surviving score lies above the bound of its next root (ties go on), or when all
   roots are expanded. The others go on with GROWTH times as many roots.

Occurrences are recognised inside tasks by two bit maps of BITS bits, whatever the number of roots: a wrong hit only
counts a phrase that nobody needs. Words and phrases are counted as strings, never as hashes. The driver gets the bit
maps and whether languages are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableseek.llm.arrays import LOWER, dictionary_of, mix, one_of, slices_by_bytes, text_views, word_hashes, words_of
from tableseek.llm.scratch import stored

LEAST = 100
LENGTH = 5
TOP = 2000
FIRST = 8000  # roots of the first round, per language
GROWTH = 4
BITS = 1 << 25
BLOCK = 1 << 16  # bits of a map that one task puts together
SLICE_BYTES = 4_000_000
PIECES = 64  # per language, before its best phrases are ranked together
NO_LANGUAGE = "und"

_CUT = one_of(b".,;:!?\n\x0b\x0c\r")
_BLANK = one_of(b" ")
_APART = _CUT | one_of(b" \t")


class Slice:
    """Words of a run of whole texts: id (of language and word), piece, and the distinct languages and words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, language: np.ndarray):
        raw = LOWER[raw]
        starts, ends, first = words_of(raw, offsets, _APART)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        self.piece = np.searchsorted(np.flatnonzero(_CUT[raw]), starts) + rows
        word, self.words = dictionary_of(raw[~_APART[raw]], ends - starts)
        distinct, self.id = _numbered(language[rows] * (len(self.words) or 1) + word)
        self.language, self.word = np.divmod(distinct, len(self.words) or 1)

    def hashes(self, languages: list[bytes]) -> np.ndarray:
        raw, offsets = text_views(self.words)
        words = word_hashes(raw, offsets[:-1], offsets[1:])
        return in_language(language_hashes(languages)[self.language], words[self.word])

    def phrases(self, at: np.ndarray, length: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Language, text and count of the distinct phrases of `length` words that start at these words."""
        code = self.id[at]
        for k in range(1, length):
            code = np.unique(code, return_inverse=True)[1] * len(self.word) + self.id[at + k]
        _, example, count = np.unique(code, return_index=True, return_counts=True)
        at = at[example]
        parts = [self.words.take(pa.array(self.word[self.id[at + k]])) for k in range(length)]
        text = parts[0] if length == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        return self.language[self.id[at]], text, count


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the place of each value among them."""
    if not len(values) or int(values.max()) > 4 * SLICE_BYTES:
        return np.unique(values, return_inverse=True)
    there = np.zeros(int(values.max()) + 1, np.int64)
    there[values] = 1
    distinct = np.flatnonzero(there)
    there[distinct] = np.arange(len(distinct))
    return distinct, there[values]


def language_hashes(languages: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in languages], np.uint64)


def in_language(language: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(word + language)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(5) + mix(right))


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def slices(batch: pa.RecordBatch) -> Iterator[tuple[Slice, list[bytes]]]:
    """From (text, lang) rows."""
    raw, offsets = text_views(batch.column(0))
    coded = batch.column(1).dictionary_encode()
    names = [x.encode() for x in coded.dictionary.to_pylist()]
    language = np.asarray(coded.indices).astype(np.int64)
    for a, b in slices_by_bytes(offsets, SLICE_BYTES):
        yield Slice(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], language[a:b]), names


def _counts(names: list[bytes], language: np.ndarray, text: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    lang = pa.array(names, pa.string()).take(pa.array(language)) if len(names) else pa.array([], pa.string())
    return pa.RecordBatch.from_arrays([lang, text.cast(pa.string()), pa.array(count.astype(np.int64))], names=["lang", "phrase", "a"])


def _word_counts(texts: DataFrame) -> DataFrame:
    def count(batches):
        for batch in batches:
            for part, names in slices(batch):
                yield _counts(names, *part.phrases(np.arange(len(part.id)), 1))

    return texts.mapInArrow(count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _phrase_counts(texts: DataFrame, frequent, expanded, pairs, lengths: range, least: int) -> DataFrame:
    """Counts from `least` on of phrases of these lengths that begin or end with an expanded word; without pairs, of pairs."""

    def count(batches):
        for batch in batches:
            for part, names in slices(batch):
                n = len(part.id)
                if n < 2:
                    continue
                hashes = part.hashes(names)
                usual, root = holds(frequent.value, hashes)[part.id], holds(expanded.value, hashes)[part.id]
                hashes = hashes[part.id]
                grows = (part.piece[1:] == part.piece[:-1]) & usual[1:] & usual[:-1]
                if pairs is not None:
                    grows &= ~(root[1:] | root[:-1]) | holds(pairs.value, pair_hash(hashes[:-1], hashes[1:]))
                chain = grows
                for length in range(2, lengths.stop):
                    if length > 2:
                        chain = chain[:-1] & grows[length - 2 :]
                    if length in lengths:
                        at = np.flatnonzero(chain & (root[: len(chain)] | root[length - 1 :]))
                        if len(at):
                            yield _counts(names, *part.phrases(at, length))

    counted = texts.mapInArrow(count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    return counted.where(F.col("a") >= least)


def _bit_map(phrases: DataFrame):
    """Broadcast bit map of the words or pairs in (lang, phrase)."""

    def place(batches):
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            language = language_hashes([x.encode() for x in coded.dictionary.to_pylist()])[np.asarray(coded.indices)]
            raw, offsets = text_views(batch.column(1))
            starts, ends, first = words_of(raw, offsets, _BLANK)
            words = word_hashes(raw, starts, ends)
            left, right = in_language(language, words[first[:-1]]), in_language(language, words[first[1:] - 1])
            at = np.where(np.diff(first) > 1, pair_hash(left, right), left) & np.uint64(BITS - 1)
            at = np.unique(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK), pa.array(at % BLOCK)], names=["block", "bit"])

    def join(table: pa.Table) -> pa.Table:
        bits = np.zeros(BLOCK, np.uint8)
        bits[np.asarray(table.column("bit"))] = 1
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    bits = np.zeros(BITS // 8, np.uint8)
    placed = phrases.select("lang", "phrase").mapInArrow(place, "block long, bit long").distinct()
    for row in placed.groupBy("block").applyInArrow(join, "block long, bits binary").toLocalIterator():
        bits[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(bits)


def _surviving(counts: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases with expanded ends that no longer phrase replaces.

    counts: phrases of two words or more; words: the expanded words. Counts stand for both.
    """
    known = counts.select("lang", "phrase", "a").unionByName(words.select("lang", "phrase", "a"))
    split = counts.withColumn("w", F.split("phrase", " "))
    ends = words.select("lang", F.col("phrase").alias("end"))
    split = split.withColumn("end", F.element_at("w", 1)).join(ends, ["lang", "end"], "left_semi")
    split = split.withColumn("end", F.element_at("w", -1)).join(ends, ["lang", "end"], "left_semi").drop("end")
    size = F.size("w")
    cuts = split.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, size), " ").alias("right")
    )
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]).join(totals, "lang")
    wide = lambda x: F.col(x).cast("decimal(18,0)")  # noqa: E731  (products of 36 digits and a factor of 1000 stay exact)
    cuts = cuts.withColumn("above", (wide("a") * wide("n")).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("below", wide("l") * wide("r"))
    scored = cuts.withColumn("score", F.expr("above div below"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    worst = worst.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    inner = counts.withColumn("w", F.split("phrase", " ")).where(size > 2)
    parts = F.array(F.array_join(F.slice("w", 1, size - 1), " "), F.array_join(F.slice("w", 2, size - 1), " "))
    inside = inner.select("lang", "a", F.explode(parts).alias("phrase")).distinct()
    return worst.join(inside, ["lang", "phrase", "a"], "left_anti")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    piece = F.pmod(F.xxhash64("phrase"), F.lit(PIECES))
    some = found.withColumn("piece", piece).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*order)))
    some = some.where(F.col("rank") <= top).drop("piece", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases are 2 to `length` words within a piece of text, of which `least` occur. Null and empty texts have none; rows
    without language stand under "und", together with those that name it. Repeated rows count as often as they stand.
    Ties of score go by count, then by the phrase's bytes, so ranks are unique. A language without such phrases, and an
    empty table, give no rows. Texts count whole, however long; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"))
    counted = stored(_word_counts(texts), "words")
    totals = stored(counted.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    frequent = stored(counted.where(F.col("a") >= least), "frequent")
    # one row for each count that words have, at most the square root of twice the words of a language
    steps = frequent.groupBy("lang", "a").agg(F.count(F.lit(1)).alias("held"))
    upward = Window.partitionBy("lang").orderBy("a")
    steps = stored(steps.select("lang", "a", F.sum("held").over(upward).alias("roots"), F.lead("a").over(upward).alias("next")), "steps")
    usual = _bit_map(frequent)
    left, done, quota = totals.select("lang"), None, first
    while True:
        enough = F.min(F.when(F.col("roots") >= quota, F.struct("a", "next")))
        limits = steps.join(left, "lang").groupBy("lang").agg(F.coalesce(enough, F.max(F.struct("a", "next"))).alias("at"))
        limits = stored(limits.select("lang", F.col("at.a").alias("limit"), "at.next"), "limits")
        words = stored(frequent.join(limits, "lang").where("a <= limit").select("lang", "phrase", "a"), "roots")
        if words.isEmpty():
            break
        roots = _bit_map(words)
        pairs = stored(_phrase_counts(texts, usual, roots, None, range(2, 3), least), "pairs")
        known = _bit_map(pairs)
        counts = stored(pairs.unionByName(_phrase_counts(texts, usual, roots, known, range(3, length + 1), least)) if length > 2 else pairs, "phrases")
        best = stored(_ranked(_surviving(counts, words, totals), top), "best")
        for used in (roots, known):
            used.destroy()
        state = limits.join(totals, "lang").join(best.where(F.col("rank") == top).select("lang", "score"), "lang", "left")
        bound = F.floor(F.lit(1000).cast("decimal(4,0)") * F.col("n").cast("decimal(19,0)") / F.col("next"))
        state = stored(state.select("lang", F.coalesce(F.col("next").isNull() | (F.col("score") > bound), F.lit(False)).alias("settled")), "state")
        final = best.join(state.where("settled"), "lang", "left_semi")
        done = final if done is None else done.unionByName(final)
        left, quota = state.where("NOT settled").select("lang"), quota * GROWTH
        if left.isEmpty():
            break
    usual.destroy()
    if done is None:
        done = _none(spark)
    return done.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
