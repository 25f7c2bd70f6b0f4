"""Chat formatting as prefix trees.

Conversations that begin with the same turns share them: a node is a turn after a given beginning, named by a hash of
all turns up to it. Each tree is one packed sequence of characters in which every node stands once, depth first, with
children ordered by their names. A node carries its position (characters before it in each of its conversations), its
offset in the packed sequence, and the intervals of its ancestors there, which are all that its tokens may attend to
besides itself. Subtree sizes come from sums over ancestors; offsets add the sizes of earlier siblings, ranked in
slices of their hash, so that a first turn that a third of all conversations share is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableseek.llm.scratch import stored

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
CONTROL = ("[INST]", "[/INST]", "</s>", "<s>")
LEARNT = "assistant"


def escape(text: Column) -> Column:
    """A backslash goes before every backslash and behind the first character of every control string."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _paths(turns: DataFrame) -> DataFrame:
    """A row per conversation: its nodes from the first turn to the last."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    segment = F.concat(head, escape(F.col("text")), F.lit(END))
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), segment.alias("segment"),
        F.length(head).cast("long").alias("head"), F.length(segment).cast("long").alias("size"),
    )
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    start = F.struct(F.lit("").alias("name"), F.lit(0).cast("long").alias("position"), F.array().cast("array<struct<node:string,parent:string,position:bigint>>").alias("path"))

    def grow(state, turn):
        name = F.sha2(F.concat(state["name"], turn["role"], F.lit("\x00"), turn["segment"]), 256)
        node = F.struct(name.alias("node"), state["name"].alias("parent"), state["position"].alias("position"))
        return F.struct(name.alias("name"), (state["position"] + turn["size"]).alias("position"), F.concat(state["path"], F.array(node)).alias("path"))

    named = talks.select("conv_id", "turns", F.aggregate("turns", start, grow)["path"].alias("path"))
    return named.select("conv_id", F.zip_with("turns", "path", lambda t, p: F.struct(p["node"].alias("node"), p["parent"].alias("parent"), p["position"].alias("position"), t["segment"].alias("segment"), t["head"].alias("head"), t["size"].alias("size"), (t["role"] == LEARNT).alias("learnt"))).alias("path"))


def format_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Formats rows of (conv_id, turn, role, text). Returns the tables `nodes` and `steps`, kept in the shared folder.

    nodes: tree, node, parent (null for a first turn), depth, text (the formatted turn), size, position, offset,
    attention (ancestors' intervals in the packed sequence), loss_start and loss_end (the part of `text` that is learnt:
    what an assistant says; null for other roles). steps: conv_id, depth, node. Rows of a conversation are taken by
    turn, null first, then by role and text, repeated rows each count; null role or text is empty; rows without
    conv_id form one conversation.
    """
    paths = stored(_paths(turns), "paths")
    places = paths.select("conv_id", F.col("path.node").alias("line"), F.posexplode("path").alias("depth", "at"))
    steps = places.select("conv_id", F.col("depth").cast("long").alias("depth"), "at.node")
    first = lambda c: F.first(c).alias(c.split(".")[-1])  # noqa: E731  equal for all rows of a node
    nodes = places.groupBy("at.node").agg(
        first("at.parent"), first("depth"), first("at.position"), first("at.size"), first("at.head"), first("at.learnt"), first("at.segment"),
        F.first(F.slice("line", 1, F.col("depth") + 1)).alias("line"),
    )
    nodes = stored(nodes, "nodes")
    narrow = nodes.select("node", "parent", "depth", "size", "line")
    spans = narrow.select(F.explode("line").alias("node"), "size").groupBy("node").agg(F.sum("size").alias("span"))
    below = narrow.where("parent != ''").select("node", "parent", "size")
    slices = below.join(spans, "node").withColumn("slice", F.substring("node", 1, 3))
    totals = slices.groupBy("parent", "slice").agg(F.sum("span").alias("total"))
    before = lambda c, by, order: F.coalesce(F.sum(c).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    earlier = totals.select("parent", "slice", before("total", ["parent"], "slice").alias("earlier"))  # 4096 slices at most
    ranked = slices.withColumn("within", before("span", ["parent", "slice"], "node")).join(earlier, ["parent", "slice"])
    sizes = narrow.select(F.col("node").alias("parent"), F.col("size").alias("parent_size"))
    # a first turn begins its tree; other nodes come behind their parent and their earlier siblings
    shift = ranked.join(sizes, "parent").select("node", "size", (F.col("parent_size") + F.col("earlier") + F.col("within")).alias("shift"))
    shift = shift.unionByName(narrow.where("parent = ''").select("node", "size", F.lit(0).cast("long").alias("shift")))
    ancestors = narrow.select(F.col("node").alias("of"), F.posexplode("line").alias("depth", "node"))
    lines = ancestors.join(shift, "node").groupBy("of").agg(F.sort_array(F.collect_list(F.struct("depth", "shift", "size"))).alias("line"))
    offset = lambda n: F.aggregate(F.slice("line", 1, n), F.lit(0).cast("long"), lambda a, x: a + x["shift"])
    intervals = F.transform(F.slice("line", 1, F.size("line") - 1), lambda x, i: F.struct(offset(i + 1).alias("start"), (offset(i + 1) + x["size"]).alias("end")))
    placed = lines.select(F.col("of").alias("node"), offset(F.size("line")).alias("offset"), intervals.alias("attention"))
    out = nodes.join(placed, "node").select(
        F.element_at("line", 1).alias("tree"), "node", F.nullif("parent", F.lit("")).alias("parent"), F.col("depth").cast("long").alias("depth"),
        F.col("segment").alias("text"), "size", "position", "offset", "attention",
        F.when(F.col("learnt"), F.col("head")).alias("loss_start"), F.when(F.col("learnt"), F.col("size") - len(END)).alias("loss_end"),
    )
    return stored(out, "chat"), steps


def read_conversations(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """conv_id, formatted (string), turns (array of role and text) and learnt (string), from the formatted output alone."""
    learnt = F.when(F.col("loss_start").isNotNull(), F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    joined = steps.join(nodes.select("node", "text", learnt.alias("learnt")), "node")
    whole = joined.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "text", "learnt"))).alias("line"))
    text = whole.select("conv_id", F.array_join("line.text", "").alias("formatted"), unescape(F.array_join("line.learnt", "")).alias("learnt"))
    parts = F.split("formatted", F.lit(END))
    spoken = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda t: F.split(F.substr(t, F.lit(len(OPEN) + 1)), F.lit("\\[/INST\\]")))
    turns = F.transform(spoken, lambda t: F.struct(unescape(t[0]).alias("role"), unescape(t[1]).alias("text")))
    return text.select("conv_id", "formatted", turns.alias("turns"), "learnt")
