"""Turns in any batching give the compression marks of the batch operator, each turn once."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import dialogue
from marlstone.streaming import conversations

SCHEMA = "conv_id string, turn long, role string, text string, at timestamp"
SIZES = {"a": 23, "b": 9, "c": 10, "d": 1, "e": 14}


def said(conv, turn, minute=None):
    return (conv, turn, "user" if turn % 2 == 0 else "assistant", f"{conv}{turn}", (minute if minute is not None else turn))


def save(spark, path, rows):
    df = spark.createDataFrame([r[:4] + (r[4],) for r in rows], "conv_id string, turn long, role string, text string, minute long")
    df.select("conv_id", "turn", "role", "text", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute"))).alias("at")).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, **options):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = conversations.compressed(rows, 10, 8, **options)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(conversations.SEGMENT).parquet(str(tmp_path / "out"))


def check(segments, turns):
    """Segments lie end to end, hold their turns, and reach the batch operator's end."""
    want = {r.conv_id: r.end for r in dialogue.compression(turns, 10, 8).collect()}
    got = {}
    for r in sorted(segments.collect(), key=lambda r: (r.conv_id, r.begin)):
        assert r.begin == got.get(r.conv_id, 0) and not r.closed
        assert [(t.turn, t.text) for t in r.turns] == [(i, f"{r.conv_id}{i}") for i in range(r.begin, r.end)]
        got[r.conv_id] = r.end
    assert got == {c: end for c, end in want.items() if end}
    assert {r.conv_id: r.upto for r in conversations.marks(segments).collect()} == got
    # With these marks there is nothing left for the batch operator to do.
    assert dialogue.compression(turns, 10, 8, conversations.marks(segments)).where("begin <> end").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_any_batching_and_a_restart(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [said(c, t) for c, n in SIZES.items() for t in range(n)]
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    for part in parts[:2]:
        save(spark, str(tmp_path / "in"), part)
    run(spark, tmp_path, late="10 hours")
    for part in parts[2:]:
        save(spark, str(tmp_path / "in"), part + part[:2] + parts[0][:3])  # repeated turns
    segments = run(spark, tmp_path, late="10 hours")
    check(segments, spark.createDataFrame([r[:4] for r in rows], "conv_id string, turn long, role string, text string"))


def test_idle_conversations_are_closed_and_may_go_on(spark, tmp_path):
    save(spark, str(tmp_path / "in"), [said("a", t, 0) for t in (0, 1, 3)] + [said(None, 0, 0)])
    run(spark, tmp_path, idle=3600, late="1 minute")
    save(spark, str(tmp_path / "in"), [said("z", 0, 600)])  # moves the watermark on
    run(spark, tmp_path, idle=3600, late="1 minute")
    save(spark, str(tmp_path / "in"), [said("z", 1, 601)])
    closed = run(spark, tmp_path, idle=3600, late="1 minute").where("conv_id = 'a'").collect()
    assert [(r.begin, r.end, r.closed, [t.turn for t in r.turns]) for r in closed] == [(0, 4, True, [0, 1, 3])]
    save(spark, str(tmp_path / "in"), [said("a", t, 602) for t in range(2, 16)])
    again = run(spark, tmp_path, idle=3600, late="1 minute").where("conv_id = 'a' and not closed").collect()
    assert [(r.begin, r.end, [t.turn for t in r.turns]) for r in again] == [(4, 8, [4, 5, 6, 7])]
