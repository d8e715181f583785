"""A batch that comes twice changes nothing, and a failure between any two steps is repaired by the next start."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import segments
from marlstone.streaming import sinks

SCHEMA = "key string, n int, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stored(sink):
    return sorted((r.key, r.n, r.v) for r in sink.rows().collect())


def test_upsert_takes_a_batch_once(spark, tmp_path):
    sink = sinks.KeyedSink(segments.SegmentedTable(spark, str(tmp_path)), "s", [F.desc("n")])
    sink(frame(spark, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "none")]), 0)
    sink(frame(spark, [("a", 3, "w"), ("c", 1, "c")]), 1)
    want = [("a", 3, "w"), ("b", 1, "z"), ("c", 1, "c")]
    assert stored(sink) == want
    version = sink.store.state()["version"]
    for again in (0, 1):
        sink(frame(spark, [("a", 1, "old"), ("b", 9, "old")]), again)
    assert stored(sink) == want and sink.store.state()["version"] == version
    other = sinks.KeyedSink(sink.store, "t", [F.desc("n")])  # another stream counts its own batches
    other(frame(spark, [("b", 5, "t")]), 0)
    assert ("b", 5, "t") in stored(sink)
    assert sink.store.compact([sinks.TABLE]) and sink.store.has_batch(("s", 1)) and not sink.store.has_batch(("s", 2))


def test_append_adds_new_keys_only(spark, tmp_path):
    sink = sinks.KeyedSink(segments.SegmentedTable(spark, str(tmp_path)), "s", [F.col("n")], upsert=False)
    sink(frame(spark, []), 0)
    sink(frame(spark, [("a", 2, "y"), ("a", 1, "x")]), 1)
    sink(frame(spark, [("a", 0, "late"), ("b", 1, "z")]), 2)
    sink(frame(spark, [("b", 0, "again"), ("d", 0, "again")]), 2)
    assert stored(sink) == [("a", 1, "x"), ("b", 1, "z")]


def test_retention_and_compaction(spark, tmp_path):
    sink = sinks.KeyedSink(segments.SegmentedTable(spark, str(tmp_path)), "s", newest=3, newest_first=[F.desc("n")], compact_after=2)
    for i in range(4):
        sink(frame(spark, [(f"k{i}", i, ""), (f"l{i}", i, "")]), i)
        assert len(stored(sink)) == min(3, 2 * (i + 1))
    assert [k for k, _, _ in stored(sink)] == ["k2", "k3", "l3"]
    assert sink.store.read(sinks.TABLE).count() <= 4 and len(sink.store.state()["segments"]) <= 2
    many = sinks.KeyedSink(segments.SegmentedTable(spark, str(tmp_path / "many")), "s", compact_after=2)
    for i in range(4):
        many(frame(spark, [(f"k{i}", i, "")]), i)
    assert len(stored(many)) == 4 and len(many.store.state()["segments"]) == 2


@pytest.mark.parametrize("step", ["_claim", "tidy", "_name"])
@pytest.mark.parametrize("upsert", [True, False])
def test_a_failure_is_repaired_at_the_next_start(spark, tmp_path, monkeypatch, step, upsert):
    """The stream dies in its second batch: before the commit, or behind it but before the batch is noted by Spark."""
    if step == "_name" and not upsert:
        pytest.skip("appending names no keys")
    frame(spark, [("a", 1, "x"), ("b", 1, "x")]).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(fail):
        store = segments.SegmentedTable(spark, str(tmp_path / "store"))
        sink = sinks.KeyedSink(store, "s", [F.col("n")], upsert)
        if fail:
            monkeypatch.setattr(*((sink, "tidy") if step == "tidy" else (store, step)), lambda *a: 1 / 0)
        query = sinks.start(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), sink, str(tmp_path / "ck"))
        if fail:
            with pytest.raises(Exception, match="ZeroDivision|division"):
                query.awaitTermination()
        else:
            query.awaitTermination()
        return sink

    run(False)
    frame(spark, [("a", 2, "y"), ("c", 2, "y"), ("c", 2, "y")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(True)
    sink = run(False)
    want = [("a", 2, "y"), ("b", 1, "x"), ("c", 2, "y")] if upsert else [("a", 1, "x"), ("b", 1, "x"), ("c", 2, "y")]
    assert stored(sink) == want
    assert sink.store.read(sinks.TABLE).count() == 3
    gone = sink.store.vacuum()
    assert stored(sink) == want and (step == "tidy" or gone)  # the failed batch left folders that nobody lists
