"""Few rows laid against many: what is hidden in a store, what hits join."""

from pyspark.sql import functions as F

from marlstone.operators import segments
from marlstone.plans import search, understanding, upkeep


def test_named_keys_that_hide_nothing_are_left_out(spark, tmp_path, monkeypatch):
    table = segments.SegmentedTable(spark, str(tmp_path / "t"))
    some = lambda start, end: spark.range(start, end).select(F.col("id").alias("key"))
    for start, end in ((0, 10), (8, 30), (40, 90)):
        table.put({"t": some(start, end).withColumn("v", F.lit(start))}, some(start, end))
    table.remove(some(85, 95))
    laid, plain = [], segments.if_few
    monkeypatch.setattr(segments, "if_few", lambda rows, n: laid.append(rows.count()) or plain(rows, n))
    got = sorted((r.key, r.v) for r in table.read("t", keys="t").collect())
    assert got == [(k, 0 if k < 8 else 8 if k < 30 else 40) for k in (*range(30), *range(40, 85))]
    assert got == sorted((r.key, r.v) for r in table.read("t").collect())
    assert laid == [7, 77]


def test_documents_stay_where_they_are_when_hits_join_them(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query in (search.context_build, upkeep.provenance):
            assert "SortMergeJoin" not in query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        joins = understanding.filter_leakage(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert joins.count("LeftSemi, BuildRight") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
