"""The ingest chain on a stream of files gives what it gives on a batch."""

import shutil

from pyspark.sql import functions as F

from marlstone.operators import ingest as chain
from marlstone.plans.ingest import RULES
from marlstone.streaming import ingest


def run(rows, name, mode):
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()


def test_stream_and_batch_agree(spark, sf, tmp_path):
    shutil.copy(f"{sf}/documents.parquet", tmp_path)
    batch = spark.read.parquet(str(tmp_path))
    stream = ingest.read_stream(spark, str(tmp_path), batch.schema)
    run(ingest.ingested(stream, RULES), "ingested", "append")
    run(ingest.rejections(ingest.read_stream(spark, str(tmp_path), batch.schema), RULES), "rejections", "complete")
    columns = ["doc_id", "doc_type", "pool", F.md5("text").alias("h")]
    want = sorted(map(tuple, chain.accepted(chain.ingest(batch, RULES)).select(*columns).collect()))
    assert sorted(map(tuple, spark.table("ingested").select(*columns).collect())) == want and want
    counts = {r.outcome: r.n for r in chain.outcome_counts(chain.ingest(batch, RULES), []).collect()}
    assert {r.outcome: r.n for r in spark.table("rejections").collect()} == counts


def test_stream_takes_each_key_once(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/documents.parquet").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.unionByName(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), rows.schema)
    run(ingest.ingested(stream, RULES, "doc_id", "ts"), "once", "append")
    assert spark.table("once").count() == chain.accepted(chain.ingest(rows, RULES)).count()
