"""Texts of megabytes through the operators that work on words, and columns of clashing names."""

import random

from pyspark.sql import functions as F

from marlstone.llm import decontamination, minhash, simhash, substring_dedup

CLASH = ("seed", "hot", "p", "mask", "dh", "toks", "node", "key", "fp", "cell", "word", "class", "hit", "context", "gone_id")


def documents(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50_000)]
    long = " ".join(rng.choice(words) for _ in range(400_000))
    shared = " ".join(f"s{i}" for i in range(60))
    leak = " ".join(f"leak{i}" for i in range(25))
    rows = [(1, f"{long} {shared}"), (2, f"{shared} short"), (3, f"{long} {leak} end"), (4, "clean text of its own"), (5, None), (6, "x" * 3_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in CLASH})
    return docs, spark.createDataFrame([(9, leak)], "item_id long, text string"), shared


def test_long_documents(spark):
    docs, items, shared = documents(spark)
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs, 35).collect()}
    # Documents 1 and 3 share all but their ends.
    assert cut[2] == (61, 60) and cut[1] == (400_060, 400_060) and cut[3] == (400_026, 400_000) and cut[4][1] == 0 and cut[5] == (0, 0) and cut[6] == (1, 0)
    classes = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}
    assert classes[1] == classes[3] == 1 and classes[4] == 4 and classes[5] == 5
    near = {r.doc_id: r.component_id for r in minhash.near_components(docs).collect()}
    assert near[1] == near[3] == 1 and near[2] == 2 and near[6] == 6
    left = decontamination.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.select("doc_id").collect()) == [1, 2, 4, 5, 6]
    kept = minhash.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 2, 4, 5, 6]
