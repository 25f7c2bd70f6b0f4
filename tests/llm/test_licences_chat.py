"""Licence scan and chat trees."""

import hashlib
import random

from tableseek.llm import chat, licences


def test_licences(spark):
    rows = [
        (1, "Some code.\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, None), (4, ""),
        (5, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation. Either version 3 of the License, or (at your option) any later version."),
        (6, "Either version 3 of the License, or (at your option) any later version."), (7, "All rights reserved. Licensed under CC BY-NC 4.0! x"),
        (7, "All rights reserved. Licensed under CC BY-NC 4.0! x"), (None, "not licensed"), (8, "ALL%%% RIGHTS### RESERVED.$$$"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, licences string")
    got = [(r.doc_id, r.n_sentences, r.sentence_ids, r.licences) for r in licences.scan_licences(docs, ["doc_id"]).collect()]
    want = [(1, 2, "0 2", "mit"), (2, 1, "1", "apache-2.0"), (3, 0, "", ""), (4, 0, "", ""), (5, 2, "14 15", "gpl-3.0"), (6, 1, "15", ""), (7, 3, "5 4 0", "cc-by-nc-4.0|proprietary"), (7, 3, "5 4 0", "cc-by-nc-4.0|proprietary"), (None, 1, "0", ""), (8, 1, "5", "proprietary")]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert licences.scan_licences(docs.limit(0), ["doc_id"]).count() == 0


def talks():
    draw = random.Random(9)
    texts = ["hi", "[INST] x </s>", "\\[INST]", "a\\b", None, "", "</s>[INST] ok [/INST]", "é🙂", "<s>"]
    rows = []
    for conv in range(40):
        rows.append((conv, 0, "user", "hello"))  # all share the first turn
        for turn in range(1, draw.randint(1, 6)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", None, "</s>"]), draw.choice(texts[:3] if turn < 3 else texts)))
    rows += [(50, None, "assistant", "first"), (50, 3, "user", "x"), (50, 3, "user", "x"), (None, 0, "user", "none"), (51, 0, "user", "alone")]
    return rows


def test_round_trip_and_trees(spark):
    rows = talks()
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int")
    nodes, steps = chat.format_conversations(turns)
    read = {r.conv_id: r for r in chat.read_conversations(nodes, steps).collect()}
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in read.items()} == want
    for conv, told in want.items():
        assert read[conv].learnt == "".join(t for role, t in told if role == "assistant")
    made = nodes.collect()
    by_node = {n.node: n for n in made}
    assert len(by_node) == len(made) < len(rows)
    prefixes = {tuple(told[: i + 1]) for told in want.values() for i in range(len(told))}
    assert len(prefixes) == len(made)
    for tree in {n.tree for n in made}:
        line = sorted((n for n in made if n.tree == tree), key=lambda n: n.offset)
        at = 0
        for n in line:  # packed without gap, in depth-first order
            assert n.offset == at and len(n.text) == n.size
            at += n.size
        stack = []
        for n in line:
            while stack and stack[-1].node != n.parent:
                stack.pop()
            assert bool(stack) == (n.parent is not None)
            assert [tuple(x) for x in n.attention] == [(a.offset, a.offset + a.size) for a in stack]
            assert n.position == sum(a.size for a in stack) and n.depth == len(stack)
            stack.append(n)
        packed = "".join(n.text for n in line)
        for n in line:
            assert packed[n.offset : n.offset + n.size] == n.text


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_conversations(*chat.format_conversations(empty)).count() == 0


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choices(["\\", "[", "INST]", "/", "</", "s>", "<s>", "x"], k=12)) for _ in range(300)]
    from pyspark.sql import functions as F

    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u for r in made) and not any(c in r.e for r in made for c in chat.CONTROL)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
