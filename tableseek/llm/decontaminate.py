"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to `budget` edits (insertions, deletions, replacements of characters). Cut into one piece
more than that, at least one piece occurs unchanged. All pieces of a block of items form one automaton that finds
them in a text in one pass; each hit names the stretch in which its item would lie. A stretch that shares enough short
grams with the item is verified by Myers' bit-parallel edit distance over its whole length. A short item may not be
edited: it must occur as a run of whole words.

Items are taken in blocks of at most `block_chars` characters. A block is the only thing sent to all tasks, so its
size is bounded whatever the benchmark's is; every block meets every document.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 0.08
MIN_CHARS = 40
BLOCK_CHARS = 4_000_000
GRAM = 4

_OTHER = re.compile(r"[^\w]+|_+")


def normal(text: str | None) -> str:
    """Lower case; every run of characters that are neither letters nor digits is one blank."""
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal size with their offsets."""
    edges = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def myers(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of the item to any stretch of text, and where that stretch ends; None if above budget.

    One step per character of text, over bit vectors as long as the item.
    """
    size = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best = None
    for at, c in enumerate(text):
        equal = masks.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        plus = down | (~(diagonal | up) & full)
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        if score <= budget and (best is None or score < best[0]):
            best = score, at + 1
            if not score:
                break
    return best


@dataclass
class Block:
    ids: list[int | None]
    items: list[str]
    budgets: list[int]
    whole: list[bool]  # matches as whole words only

    def automaton(self):
        import ahocorasick

        where: dict[str, list[tuple[int, int]]] = {}
        for n, (item, budget) in enumerate(zip(self.items, self.budgets)):
            for offset, piece in pieces_of(item, budget):
                where.setdefault(piece, []).append((n, offset + len(piece)))
        machine = ahocorasick.Automaton()
        for piece, places in where.items():
            machine.add_word(piece, places)
        machine.make_automaton()
        return machine


def enough_grams(grams: Counter, stretch: str, size: int, budget: int) -> bool:
    """Each edit destroys GRAM grams of the item at most."""
    need = size - GRAM + 1 - GRAM * budget
    if need <= 0:
        return True
    have = Counter(stretch[i : i + GRAM] for i in range(len(stretch) - GRAM + 1))
    return sum(min(n, have[g]) for g, n in grams.items() if g in have) >= need


def matches(text: str, block: Block, machine, grams: list[Counter]) -> dict[int, int]:
    """Items of the block in a normalised text: number in the block -> least distance."""
    found: dict[int, int] = {}
    seen: set[tuple[int, int]] = set()
    for end, places in machine.iter(text):
        for n, offset in places:
            if found.get(n) == 0:
                continue
            size, budget = len(block.items[n]), block.budgets[n]
            start = end + 1 - offset
            if (n, start) in seen:
                continue
            seen.add((n, start))
            if block.whole[n]:
                if (start == 0 or text[start - 1] == " ") and (end + 1 == len(text) or text[end + 1] == " "):
                    found[n] = 0
                continue
            stretch = text[max(0, start - budget) : max(0, start) + size + budget]
            if len(stretch) < size - budget or not enough_grams(grams[n], stretch, size, budget):
                continue
            best = myers(block.items[n], stretch, budget)
            if best is not None:
                found[n] = min(best[0], found.get(n, best[0]))
    return found


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, rate: float, min_chars: int, block_chars: int):
    """Blocks of items, read one after the other. Items shorter than min_chars match as whole words without edits."""
    ids, items, budgets, whole, size = [], [], [], [], 0
    rows = benchmark.where(F.col(text).isNotNull()).select(item_id, text)
    for row in rows.toLocalIterator():
        item = normal(row[1])
        if not item:
            continue
        if size and size + len(item) > block_chars:
            yield Block(ids, items, budgets, whole)
            ids, items, budgets, whole, size = [], [], [], [], 0
        ids.append(row[0])
        items.append(item)
        whole.append(len(item) < min_chars)
        budgets.append(0 if whole[-1] else int(len(item) * rate))
        size += len(item)
    if size:
        yield Block(ids, items, budgets, whole)


def _match(docs: DataFrame, blocks: list[Block], keep: list[str], text: str) -> DataFrame:
    """The columns `keep` with `hits` (array of item and distance) added, for every row."""
    columns = list(dict.fromkeys([*keep, text]))
    hit = T.StructType().add("item_id", T.LongType()).add("distance", T.LongType())
    schema = T.StructType([docs.schema[c] for c in keep]).add("hits", T.ArrayType(hit))
    spark = docs.sparkSession
    sent = [spark.sparkContext.broadcast(b) for b in blocks]  # each of block_chars at most

    def search(batches):
        loaded = [(b.value, b.value.automaton(), [Counter(x[i : i + GRAM] for i in range(len(x) - GRAM + 1)) for x in b.value.items]) for b in sent]
        for batch in batches:
            rows, offsets = [], np.zeros(batch.num_rows + 1, np.int32)
            for i, value in enumerate(batch.column(columns.index(text))):
                plain = normal(value.as_py())
                for block, machine, grams in loaded:
                    rows += sorted(((block.ids[n], d) for n, d in matches(plain, block, machine, grams).items()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
                offsets[i + 1] = len(rows)
            flat = pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["item_id", "distance"])
            yield pa.RecordBatch.from_arrays([*[batch.column(columns.index(c)) for c in keep], pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[*keep, "hits"])

    return docs.select(*columns).mapInArrow(search, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every (document, test item) pair: the columns `keep` with item_id and distance (edits) added.

    The error budget of an item is `rate` of its normalised length; items under min_chars characters have none and match
    as whole words. Null and empty texts and items match nothing; items with a null id count; repeated rows and items
    each count. Each block is one pass over the documents.
    """
    keep = [c for c in keep if c not in ("item_id", "distance", "hits")]
    out = None
    for block in benchmark_blocks(benchmark, item_id, item_text, rate, min_chars, block_chars):
        found = _match(docs, [block], keep, text).where(F.size("hits") > 0).select(*keep, F.inline("hits"))
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = docs.select(*keep).where(F.lit(False)).withColumn("item_id", F.lit(0).cast("long")).withColumn("distance", F.lit(0).cast("long"))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no test item occurs, with all their columns. Null and empty texts stay."""
    columns = docs.columns
    for block in benchmark_blocks(benchmark, item_id, item_text, rate, min_chars, block_chars):
        plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
        clean = _match(plain, [block], plain.columns, f"c{columns.index(text)}").where(F.size("hits") == 0)
        docs = clean.drop("hits").toDF(*columns)
    return docs
