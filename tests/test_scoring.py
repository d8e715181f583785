"""Text searches against plain loops: many terms and copies, small blocks and chunks, repeated keys."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.operators import retrieval, scoring

WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]


def loop(docs, asked, k, kind):
    """Of rows (key, words) and {query: words}; rows of one key add up, as in the SQL."""
    groups = Counter()
    for key, words in docs:
        for w, tf in Counter(words).items():
            groups[key, len(words), len(set(words)), w] += tf
    df, mean = Counter(g[3] for g in groups), sum(len(w) for _, w in docs) / len(docs)
    found = {}
    for q, words in asked.items():
        sums = Counter()
        for (key, dl, n, w), tf in groups.items():
            if w in words and kind == "bm25":
                idf = math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                sums[key] += words.count(w) * (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))
            elif w in words:
                sums[key, n] += 1
        m = len(set(words))
        if kind == "jaccard":
            sums = {key: 0.7 * c / (n + m - c) + 0.3 * min(1, 200 / n) for (key, n), c in sums.items()}
        best = sorted((-round(s, 10), key) for key, s in sums.items())[:k]
        found |= {(q, i + 1): (key, round(-s, 6)) for i, (s, key) in enumerate(best)}
    return found


def made(rng, n):
    return [rng.choice(WORDS[: rng.choice((4, 40, 120))]) for _ in range(n)]


@pytest.mark.parametrize("kind", ["bm25", "jaccard"])
@pytest.mark.parametrize("repeated", [False, True])
def test_searches_equal_a_loop(spark, monkeypatch, kind, repeated):
    monkeypatch.setattr(scoring, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(scoring, "BLOCK_TERMS", 30)
    monkeypatch.setattr(scoring, "CHUNK", 7)
    rng = random.Random(4)
    docs = [(i, made(rng, rng.randrange(0, 60))) for i in range(90)] + [(200 + i, WORDS[:9]) for i in range(30)]
    docs += [(3, made(rng, 31)), (3, made(rng, 32)), (3, docs[3][1])] if repeated and kind == "bm25" else []
    asked = {q: made(rng, rng.randrange(1, 30)) for q in range(22)} | {50: ["unknown"], 51: []}
    rng.shuffle(docs)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(q, " ".join(w)) for q, w in asked.items()], "query_id int, query string")
    search = {"bm25": retrieval.bm25_search, "jaccard": retrieval.jaccard_search}[kind]
    got = {(r.query_id, r["rank"]): (r.key, round(r.score, 6)) for r in search(rows, queries, 6).collect()}
    want = loop(docs, asked, 6, kind)
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)


def test_pairs_are_not_shuffled(spark):
    """Of texts that all share words with all queries, only what may be among the best leaves a task."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same words "), F.repeat(F.lit("x "), (F.col("id") % 50).cast("int"))).alias("text")).coalesce(2)
    asked = spark.range(30).select(F.col("id").alias("query_id"), F.lit("the words").alias("query"))
    rows, terms, repeated = retrieval.search_index(docs, asked)
    assert rows.count() == 4000 and repeated is None
    blocks = terms.groupBy("query_id").agg(F.collect_list("term").alias("terms")).select("query_id", F.lit(0).alias("m"), "terms", F.array(F.lit(1.0), F.lit(1.0)).alias("weights"))
    values = rows.select("key", "n", "terms", F.transform("tfs", lambda tf: tf / F.col("dl")).alias("values"))
    pairs = scoring.best_pairs(values, blocks, 3, lambda sums, n, m: sums, 10)
    assert pairs.count() <= 4 * 30 * 3  # of 120,000


def test_keys_and_query_ids_of_any_kind(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x"), ("é", "y y")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "x y"), (None, "y")], "query_id string, query string")
    got = [(r.query_id, r["rank"], r.key) for r in retrieval.jaccard_search(docs, asked, 2).collect()]
    assert set(got) == {("q", 1, "a"), ("q", 2, "b"), (None, 1, "é"), (None, 2, "a")}


def test_memory_does_not_follow_the_length_of_texts(spark, monkeypatch):
    """Of long texts as few are laid against a block at once as their terms allow."""
    names = [f"t{i}" for i in range(512)]
    asked = [(q, 30, [names[(q * 30 + i) % 512] for i in range(30)], [1.0] * 30) for q in range(256)]
    asked = spark.createDataFrame(asked, "query_id int, m int, terms array<string>, weights array<double>")
    rows = spark.createDataFrame([], "key long, n int, terms array<string>, values array<double>")
    monkeypatch.setattr(scoring, "map_arrow", lambda rows, run, schema: run)
    run = scoring.best_pairs(rows, asked, 3, lambda sums, n, m: sums / n, 10)
    n = 2000
    lists = lambda values: pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * 512, values)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([512.0] * n), lists(pa.array(names * n)), lists(pa.array(np.ones(512 * n)))], names=["key", "n", "terms", "values"])
    tracemalloc.start()
    found = [len(x) for x in run(iter([batch]))]
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert sum(found) >= 256 * 3 and most < 300  # MB; 665 if all are laid against the block at once


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK_TOKENS", 7)
    monkeypatch.setattr(scoring, "CHUNK_TERMS", 3)
    monkeypatch.setattr(scoring, "CHUNK_VALUES", 5)
    rng = random.Random(8)
    docs = [(i, made(rng, rng.randrange(0, 40))) for i in range(60)]
    asked = {q: made(rng, 12) for q in range(9)}
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").coalesce(2)
    queries = spark.createDataFrame([(q, " ".join(w)) for q, w in asked.items()], "query_id int, query string")
    for kind, search in (("bm25", retrieval.bm25_search), ("jaccard", retrieval.jaccard_search)):
        got = {(r.query_id, r["rank"]): (r.key, round(r.score, 6)) for r in search(rows, queries, 4).collect()}
        want = loop(docs, asked, 4, kind)
        assert got.keys() == want.keys()
        assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)


def copies(rng):
    """Documents that share keys: whole copies, equal lengths with other words, others; some without a key."""
    docs = [(i // 3, made(rng, rng.choice((20, 20, 33)))) for i in range(120)]
    docs += [docs[i] for i in range(0, 60, 4)] + [(None, made(rng, 15)) for _ in range(9)]
    docs += [(100 + i, made(rng, rng.randrange(0, 40))) for i in range(60)]
    rng.shuffle(docs)
    return docs


def by_sql(docs, asked):
    """Hits of both searches by the queries' SQL."""
    import duckdb

    import __spark_entry__

    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", [(i, " ".join(w)) for i, w in docs])
        db.executemany("INSERT INTO benchmark VALUES (?, ?)", [(q, " ".join(w)) for q, w in asked.items()])
        return {kind: db.execute(__spark_entry__.oracle_sql()[f"{kind}_search"]).fetchall() for kind in ("bm25", "jaccard")}


def test_documents_that_share_a_key_score_as_by_sql(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK_TERMS", 60)
    monkeypatch.setattr(scoring, "TASK_TERMS", 400)
    rng = random.Random(12)
    docs, asked = copies(rng), {q: made(rng, rng.randrange(1, 30)) for q in range(15)}
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(q, " ".join(w)) for q, w in asked.items()], "query_id long, query string")
    for kind, hits in by_sql(docs, asked).items():
        search = {"bm25": retrieval.bm25_search, "jaccard": retrieval.jaccard_search}[kind]
        got = [tuple(r) for r in search(rows, queries, 10).select("query_id", "key", "rank", "score").collect()]
        key = lambda r: (r[0], r[2])
        # Of rows of one key the SQL leaves nulls last among equals, and copies of a key open.
        want = {key(r): r for r in hits}
        assert {key(r) for r in got} == want.keys()
        assert all(abs(r[3] - want[key(r)][3]) < 2e-6 for r in got)
        tied = Counter((r[0], r[3]) for r in hits)
        assert all(r[1] == want[key(r)][1] for r in got if tied[r[0], want[key(r)][3]] == 1)


@pytest.mark.parametrize("kind", ["bm25", "jaccard"])
def test_pairs_of_documents_that_share_a_key_are_not_shuffled(spark, monkeypatch, kind):
    docs = spark.range(4000).select((F.col("id") % 2000).alias("doc_id"), F.concat(F.lit("the same words "), F.repeat(F.lit("x "), (F.col("id") % 50).cast("int"))).alias("text")).coalesce(2)
    asked = spark.range(30).select(F.col("id").alias("query_id"), F.lit("the words").alias("query"))
    seen, ranked = [], retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda scored, *more: seen.append(scored.count()) or ranked(scored, *more))
    hits = {"bm25": retrieval.bm25_search, "jaccard": retrieval.jaccard_search}[kind](docs, asked, 3)
    assert hits.count() == 30 * 3 and seen[0] <= 8 * 30 * 3  # of 60,000


def test_a_frequent_key_is_added_up_before_it_is_shuffled(spark, monkeypatch):
    held = []
    whole = type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, *a: held.append(self.count()) or whole(self, *a))
    rows = spark.range(0, 6000, 1, 3).select(F.lit(None).cast("long").alias("key"), F.array(F.lit("a"), F.concat(F.lit("b"), F.col("id") % 4)).alias("terms"), F.array(F.lit(1), F.lit(2)).alias("values"))
    got = [(r.key, dict(zip(r.terms, r["values"], strict=True))) for r in scoring.added_up(rows, "key").collect()]
    assert got == [(None, {"a": 6000.0} | {f"b{i}": 3000.0 for i in range(4)})]
    assert held == [3]
