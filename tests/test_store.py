"""The versioned property-graph store and the union of streams."""

import pytest

from graphloom.operators import graph
from graphloom.sources import property_graph, sinks, snapshots
from graphloom.streaming import incremental


def built(spark, rows, graph_id="g"):
    return graph.build(spark.createDataFrame([(graph_id, *r) for r in rows], "graph_id string, s string, p string, o string"))


def names(spark, sink, version=None):
    return sorted(r["name"] for r in property_graph.query_graph(spark, sink.path, "select name from {nodes}", version=version).collect())


def test_upload_rewrites_touched_buckets_only(spark, tmp_path):
    sink = sinks.PropertyGraphSink(str(tmp_path / "store"), buckets=16)
    assert sink.upload(built(spark, [(f"n{i}", "r", f"n{i + 1}") for i in range(60)])) == (61, 60)
    store = sink.store(spark)
    before = store.manifest()["tables"]["nodes"]["folders"]
    assert sink.upload(built(spark, [("n1", "R", "new")], "other")) == (62, 61)
    after = store.manifest()["tables"]["nodes"]["folders"]
    assert 1 <= sum(before.get(b) != x for b, x in after.items()) <= 2 and len(before) > 10
    assert names(spark, sink, version=0) == sorted(f"n{i}" for i in range(61))
    rows = store.read("nodes")
    assert {r["name"]: r["graph_name"] for r in rows.where("name in ('n0', 'n1', 'new')").collect()} == {"n0": "g", "n1": "other", "new": "other"}
    assert rows.count() == rows.distinct().count() == 62


def test_killed_upload_leaves_the_old_version(spark, tmp_path, monkeypatch):
    sink = sinks.PropertyGraphSink(str(tmp_path / "store"))
    sink.upload(built(spark, [("a", "r", "b")]))

    def killed(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots.Snapshots, "_commit", killed)
        for clear in (False, True):
            with pytest.raises(KeyboardInterrupt):
                sinks.PropertyGraphSink(sink.path, clear).upload(built(spark, [("a", "r", "c")]))
    assert names(spark, sink) == ["a", "b"]
    assert sink.upload(built(spark, [("a", "r", "c")])) == (3, 2)


def test_two_uploads_of_one_version_conflict(spark, tmp_path):
    sink = sinks.PropertyGraphSink(str(tmp_path / "store"))
    sink.upload(built(spark, [("a", "r", "b")]))
    store = sink.store(spark)
    with pytest.raises(snapshots.Conflict):
        store._commit(store.manifest())
    assert names(spark, sink) == ["a", "b"] and not list((tmp_path / "store" / "versions").glob(".*.draft"))


def test_clear_and_vacuum(spark, tmp_path):
    sink = sinks.PropertyGraphSink(str(tmp_path / "store"), buckets=4)
    sink.upload(built(spark, [(f"n{i}", "r", "hub") for i in range(30)]))
    assert sinks.PropertyGraphSink(sink.path, clear=True).upload(built(spark, [("x", "r", "y")])) == (2, 1)
    store = sink.store(spark)
    assert store.manifest()["buckets"] == 4 and store.versions() == [0, 1]
    assert store.vacuum(hours=1) == 0 and store.versions() == [1]
    assert store.vacuum(hours=-1) > 0 and names(spark, sink) == ["x", "y"]
    assert len(list((tmp_path / "store" / "data" / "nodes").iterdir())) == 1
    with pytest.raises(ValueError):
        store.vacuum(keep=0)


def test_null_keys_empty_uploads_and_missing_stores(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "s"), {"t": ["k"]}, 8)
    rows = lambda *r: spark.createDataFrame(r, "k string, v long")
    assert store.read("t") is None and store.versions() == []
    assert store.merge({"t": rows()}) == {"t": 0} and store.read("t").columns == ["k", "v"]
    assert store.merge({"t": rows((None, 1), ("a", 1))}) == {"t": 2}
    assert store.merge({"t": rows((None, 2), ("b", None))}) == {"t": 3}
    assert store.merge({"t": rows()}) == {"t": 3}
    assert {tuple(r) for r in store.read("t").collect()} == {(None, 2), ("a", 1), ("b", None)}
    assert property_graph.query_graph(spark, str(tmp_path / "none"), "select * from {nodes}").count() == 0
    sink = sinks.PropertyGraphSink(str(tmp_path / "g"))
    sink.upload(built(spark, [("a", "r", "b")]))
    assert property_graph.query_graph(spark, sink.path, "select nothing from {nodes}").count() == 0
    assert property_graph.query_graph(spark, sink.path, "select name from {nodes}", version=7).count() == 0


def put(spark, path, *rows):
    spark.createDataFrame([("g", *r) for r in rows], incremental.TRIPLES).coalesce(1).write.mode("append").parquet(str(path))


def ran(spark, tmp_path, source="in", checkpoint="one"):
    stream = incremental.union_stream(spark, str(tmp_path / source), str(tmp_path / "out"), str(tmp_path / checkpoint))
    stream.awaitTermination()
    return stream


def test_stream_batches_do_not_read_the_target(spark, tmp_path, monkeypatch):
    """With one checkpoint the target isn't read; what was seen long ago isn't written again."""
    monkeypatch.setattr(incremental, "_written", lambda *a: pytest.fail("the target was read"))
    provider = spark.conf.get(incremental.PROVIDER)
    seen = set()
    for turn in range(3):
        rows = [(f"s{i}", "r", None if i % 5 == 0 else f"o{i}") for i in range(turn * 10, turn * 10 + 30)]
        seen |= set(rows)
        put(spark, tmp_path / "in", *rows, *rows[:3])
        stream = ran(spark, tmp_path)
        assert stream.lastProgress is None or stream.exception() is None
    monkeypatch.undo()
    got = [tuple(r)[1:] for r in incremental.union_table(spark, str(tmp_path / "out")).collect()]
    assert len(got) == len(seen) and set(got) == seen
    assert spark.conf.get(incremental.PROVIDER) == provider


def test_stream_of_another_checkpoint_meets_nulls_and_repeats(spark, tmp_path):
    put(spark, tmp_path / "in", ("a", None, "b"), ("c", "r", "d"))
    put(spark, tmp_path / "more", ("a", None, "b"), ("a", None, "b"), ("e", "r", None))
    assert incremental.union_table(spark, str(tmp_path / "out")).count() == 0
    ran(spark, tmp_path)
    ran(spark, tmp_path, "more", "two")
    got = [tuple(r)[1:] for r in incremental.union_table(spark, str(tmp_path / "out")).collect()]
    assert len(got) == 3 and set(got) == {("a", None, "b"), ("c", "r", "d"), ("e", "r", None)}
