"""The kept set against a loop, the draw against its probabilities, and awkward rows through the filter."""

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def words(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary, n))


def corpus(n=120):
    rng = np.random.default_rng(3)
    good, bad = [f"g{k}" for k in range(40)], [f"b{k}" for k in range(25)] + ["g1", "g2", "g3"]
    return [(i, words(rng, bad if i % 4 == 0 else good, int(rng.choice([1, 3, 8, 40, 900])))) for i in range(n)]


def test_kept_set_matches_a_loop(spark):
    rows = corpus() + [(200, None), (201, ""), (202, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 120, 3)], LABELS)
    table = quality.fit(docs, labels)
    noise = {r.i: r.g for r in spark.createDataFrame([(i,) for i, _ in rows], "i long").select("i", quality.gumbel(F.col("i"), 7).alias("g")).collect()}
    keys = {}
    for reference in (None, 20, 3):
        for i, text in rows:
            found, _ = quality._features([(text or "").encode()], quality.WordHashes(), quality.BUCKETS)
            log_ratio = math.fsum(table[b] for b in found)
            keys[i] = log_ratio / (1 if reference is None else max(1, len(found) / reference)) + noise[i]
        for share in (0.3, 0.75):
            k = math.ceil(len(rows) * share)
            want = set(sorted(keys, key=keys.get, reverse=True)[:k])
            assert {r.doc_id for r in quality.classify(docs, labels, share=share, reference=reference).where("kept").collect()} == want
            assert {r.doc_id for r in quality.keep_good(docs, labels, share=share, reference=reference).collect()} == want


def test_draw_follows_the_weights(spark):
    weights, k, draws = np.linspace(-3, 3, 24), 8, 3000
    rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "i long, w double").crossJoin(spark.range(draws).withColumnRenamed("id", "draw"))
    key = F.col("w") + quality.gumbel(F.col("i"), F.col("draw"))
    place = F.row_number().over(Window.partitionBy("draw").orderBy(key.desc()))
    got = np.zeros(len(weights))
    for i, n in rows.withColumn("place", place).where(F.col("place") <= k).groupBy("i").count().collect():
        got[i] = n / draws
    rng, want = np.random.default_rng(5), np.zeros(len(weights))
    for _ in range(20_000):
        # One after the other, each with a chance in proportion to its weight.
        want[rng.choice(len(weights), k, replace=False, p=np.exp(weights) / np.exp(weights).sum())] += 1 / 20_000
    assert np.abs(got - want).max() < 0.04


def test_noise_matters_and_good_documents_stay(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    weights = quality.fit(docs, labels)
    scored = quality.score(docs, weights, 20).join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left").toPandas()
    n = len(scored)
    k = math.ceil(n * (labels.where("quality = 1").count() / labels.count() + 0.005))
    kept = [set(r.doc_id for r in quality.classify(docs, labels, margin=0.005, seed=seed, reference=20).where("kept").collect()) for seed in (1, 2)]
    assert len(kept[0]) == len(kept[1]) == k
    plain = set(scored.nlargest(k, "log_weight").doc_id)
    assert len(kept[0] ^ plain) >= 6 and len(kept[0] ^ kept[1]) >= 6
    good = scored[(scored.quality == 1) & (scored.toxic == 0)].doc_id
    assert all(good.isin(x).mean() > 0.99 for x in kept)


def test_filter_takes_awkward_rows(spark):
    text = "fine words here " * 40
    rows = [(1, text, "a", 1.0), (1, text, "b", 2.0), (None, text, "c", 3.0), (None, None, None, None), (2, None, "d", 4.0), (3, "", "e", 5.0), (4, "x" * 3_000_000, "f", 6.0), (5, "w " * 400_000, "g", 7.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_weight string, gumbel_key double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (5, 0, 0), (9, None, None)], LABELS)
    whole = quality.keep_good(docs, labels, share=1.0)
    assert whole.columns == docs.columns and sorted(map(tuple, whole.collect()), key=repr) == sorted(rows, key=repr)
    some = quality.keep_good(docs, labels, share=0.5)
    assert some.columns == docs.columns and some.count() >= 4
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == len(rows)
