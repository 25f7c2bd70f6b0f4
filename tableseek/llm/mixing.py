"""Mixing sources to target weights by subset-sum budget fitting.

1. Each document's size is its number of words. Sources in order of name get their weights in turn; a source's target
   stops at `most` times its size, and what is above goes to the others by weight (one level raises all open targets).
2. A source gives every document as often as its target allows in full. For the remaining budget its documents are
   counted by exact size; each size gives its share of the budget but for a few times the longest size, rounded so that
   the sum falls short by less than that size, and bounded-knapsack dynamic programming over what is left of each size
   closes the gap.
3. Within a (source, size) the documents with the smallest seeded numbers are taken. Groups are cut into slots of about
   SLOT documents by that number: counts of slots say which are taken whole, and only one slot a group is ranked.

The driver gets two sums a round of step 1. A task of step 2 holds the counts of one source by size, which grow with the
longest text and not with the number of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableseek.llm.scratch import stored
from tableseek.operators.ranking import global_ids

WEIGHTS = (1, 2, 3)
MOST = 3  # a document is taken this often at most
SLOT = 1024
SALT = 32  # pieces in which a (source, size) meets its share
CAPACITY = 1 << 20  # words that the dynamic programme settles; a larger gap is first narrowed by the longest sizes
MARGIN = 4  # times the longest size is left to the dynamic programme besides what rounding leaves
WORDS = r"[^\x20\x09-\x0D]+"
GROUP = ["none", "name", "size"]


def fill(budget: int, sizes: list[int], counts: list[int]) -> list[int]:
    """How many of each size to take so that their sum comes as near to the budget as can be without passing it.

    Exact up to CAPACITY; beyond it the longest sizes narrow the gap first.
    """
    taken = [0] * len(sizes)
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0 and counts[i] > 0), key=lambda i: -sizes[i])
    for i in order:
        if budget <= CAPACITY:
            break
        taken[i] = min(counts[i], -(-(budget - CAPACITY) // sizes[i]), budget // sizes[i])
        budget -= taken[i] * sizes[i]
    reach, via, items = np.zeros(budget + 1, bool), np.zeros(budget + 1, np.int32), []
    reach[0] = True
    for i in order:
        left, times = counts[i] - taken[i], 1
        while left > 0 and not reach[budget]:
            times = min(times, left)
            weight = times * sizes[i]
            if weight > budget:
                break
            fresh = weight + np.flatnonzero(reach[:-weight] & ~reach[weight:])
            via[fresh] = len(items)
            reach[fresh] = True
            items.append((i, times, weight))
            left, times = left - times, 2 * times
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, times, weight = items[via[at]]
        taken[i] += times
        at -= weight
    return taken


def shares(sizes: list[int], counts: list[int], target: float) -> tuple[int, list[int]]:
    """Times that all documents of a source are taken, and how many of each size are taken once more."""
    total = sum(s * n for s, n in zip(sizes, counts))
    if not total:
        return 0, [0] * len(sizes)
    full, rest = divmod(min(round(target), MOST * total), total)
    bulk = max(0, rest - min(CAPACITY, MARGIN * max(sizes)))
    more, before, given = [0] * len(sizes), 0, 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        before += counts[i]
        whole = before * bulk // total if sizes[i] else given
        more[i], given = whole - given, whole
    gap = rest - sum(s * n for s, n in zip(sizes, more))
    return full, [a + b for a, b in zip(more, fill(gap, sizes, [n - m for n, m in zip(counts, more)]))]


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """none, name, source_size and target of each source, from (none, name, source_size)."""
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    weighed = stored(global_ids(sources, ["none", "name"], name="turn").select("none", "name", "source_size", turn.alias("weight")), "sources")
    level, closed = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > MOST * F.col("source_size")
        found = weighed.agg(
            F.count_if(above).alias("closed"), F.sum("source_size").alias("all"), F.sum(F.when(above, MOST * F.col("source_size"))).alias("held"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
        ).first()
        if found.closed == closed:
            break
        level, closed = ((found.all or 0) - (found.held or 0)) / (found.weight or 1), found.closed
    target = F.least(F.col("weight") * F.lit(level), MOST * F.col("source_size").cast("double"))
    return weighed.select("none", "name", "source_size", target.alias("target"))


def _picks(counts: DataFrame) -> DataFrame:
    """full and more of each (none, name, size), from (none, name, size, n, target)."""

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("size")
        full, more = shares(table.column("size").to_pylist(), table.column("n").to_pylist(), table.column("target")[0].as_py())
        out = table.select(["none", "name", "size", "n", "source_size", "target"])
        return out.append_column("full", pa.array([full] * out.num_rows, pa.int32())).append_column("more", pa.array(more, pa.int64()))

    return counts.groupBy("none", "name").applyInArrow(
        choose, "none boolean, name string, size long, n long, source_size long, target double, full int, more long"
    )


def plan_mixture(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = 42
) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies times size) of each row of docs.

    Sources take their weights in order of code points, the null source last; together their targets are the size of all
    documents. Null and empty texts have size 0 and take 0 words; a source of such texts has target 0. Rows without id and
    repeated rows count each for themselves; which of several equal rows is taken once more makes no difference. The
    choice depends on the seed, ids and texts alone, so reruns agree. Other columns are ignored, whatever their names; an
    empty table gives an empty result. A text counts as a whole, however long.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS)).cast("long")
    number = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(text)), 1)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name"),
        words.alias("size"), number.alias("number"),
    )
    rows = stored(rows.withColumn("salt", (F.col("number") % SALT).cast("int")), "sizes")
    counts = stored(rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")), "counts")
    sources = counts.groupBy("none", "name").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    picks = _picks(counts.join(source_targets(sources, weights), ["none", "name"]))
    slots = F.ceil(F.col("n") / SLOT).cast("long")
    salted = picks.withColumn("slots", slots).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    slot = F.shiftright(F.shiftright("number", 31) * F.col("slots"), 32)  # monotone in the number
    dealt = stored(rows.join(salted, [*GROUP, "salt"]).withColumn("slot", slot).drop("salt", "slots"), "dealt")
    is_open = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    some = dealt.where(is_open)
    earlier = Window.partitionBy(*GROUP).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = some.groupBy(*GROUP, "slot").agg(F.count(F.lit(1)).alias("held"))
    before = before.select(*GROUP, "slot", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*GROUP, "slot").orderBy("number", "doc_id"))
    some = some.join(before, [*GROUP, "slot"]).withColumn("once", F.col("before") + place <= F.col("more")).select(*dealt.columns, "once")
    every = dealt.where(~is_open).withColumn("once", F.col("more") > 0)
    copies = F.col("full") + F.col("once").cast("int")
    return every.unionByName(some).select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """The mixture itself: doc_id, text and source of each document as often as the plan takes it; ids must not repeat.

    Documents without id are in no mixture, since nothing names them; plan_mixture counts them.
    """
    copies = plan_mixture(docs, doc_id, text, source, weights, seed).where("copies > 0 AND size > 0").select("doc_id", "copies")
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    return held.join(copies, "doc_id").select("doc_id", "text", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
