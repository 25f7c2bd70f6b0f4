"""Staged outputs: parts, resumption, completion markers."""

import pytest

from tableseek.session import scratch_path
from tableseek.sources import writers as W
from tableseek.sources.commit_log import CommitLog


def test_a_killed_writer_leaves_the_version_before(spark, monkeypatch):
    path = scratch_path(spark, "staged")
    W.StagedWriter(spark, path, {"seed": "1"}).write("epoch 0", {"batches": spark.range(4)})
    killed = W.StagedWriter(spark, path, {"seed": "1"})
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            killed.write("epoch 1", {"batches": spark.range(50)})
    with pytest.raises(ValueError, match="not complete"):
        W.read_staged(spark, path, {"seed": "1"}, "batches")
    assert W.read_staged(spark, path, {"seed": "1"}, "batches", complete=False).count() == 4
    again = W.StagedWriter(spark, path, {"seed": "1"})
    assert list(again.parts) == ["epoch 0"]
    with pytest.raises(ValueError, match="lacks"):
        again.finish(["epoch 0", "epoch 1"])
    for _ in range(2):  # writing a part twice changes nothing
        again.write("epoch 1", {"batches": spark.range(6)})
    again.finish(["epoch 0", "epoch 1"], batches=10)
    assert W.is_complete(spark, path) and again.entry["counts"] == {"batches": 10}
    assert W.read_staged(spark, path, {"seed": "1"}, "batches").count() == 10
    with pytest.raises(ValueError, match="complete"):
        again.write("epoch 2", {"batches": spark.range(1)})


def test_other_parameters_are_refused(spark):
    path = scratch_path(spark, "staged")
    writer = W.StagedWriter(spark, path, {"seed": "1", "size": "32"})
    writer.write("a", {"shards": spark.range(1), "queries": spark.range(2)})
    writer.finish(["a"])
    for other in ({"seed": "2", "size": "32"}, {"seed": "1"}, {"seed": "1", "size": "32", "more": "x"}):
        with pytest.raises(ValueError, match="metadata differs"):
            W.StagedWriter(spark, path, other)
        with pytest.raises(ValueError, match="metadata differs"):
            W.read_staged(spark, path, other, "shards")
    assert W.read_staged(spark, path, {"seed": "1", "size": "32"}, "queries").count() == 2


def test_two_writers_cannot_both_make_a_version(spark):
    path = scratch_path(spark, "staged")
    one, two = (W.StagedWriter(spark, path, {}) for _ in range(2))
    one.write("a", {"t": spark.range(1)})
    with pytest.raises(RuntimeError):
        two.write("b", {"t": spark.range(2)})
    assert list(W.StagedWriter(spark, path, {}).parts) == ["a"]
