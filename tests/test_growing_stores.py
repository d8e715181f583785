"""Segments, the stored text index and the vector index: growth, removal, compaction, two writers, recall."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions.segmentation import segmenter
from marlstone.operators import retrieval, text_index, vector_index
from marlstone.operators.segments import SegmentedTable


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "key long, v string")


def put(table, df):
    return table.put({"t": df}, df)


def test_later_rows_replace_and_removed_ones_hide(spark, tmp_path):
    table = SegmentedTable(spark, str(tmp_path / "t"))
    put(table, frame(spark, [(1, "a"), (1, "b"), (2, "c"), (None, "n")]))
    put(table, frame(spark, [(1, "d"), (3, "e"), (None, "m")]))
    table.remove(frame(spark, [(2, ""), (9, "")]))
    put(table, frame(spark, [(2, "f")]))
    want = [(1, "d"), (2, "f"), (3, "e"), (None, "m"), (None, "n")]
    assert rows(table.read("t"), "key", "v") == want
    assert table.info()["segments"] == 3 and table.versions() == [1, 2, 3, 4]
    assert rows(table.read("t", state=table.state(1)), "key", "v") == [(1, "a"), (1, "b"), (2, "c"), (None, "n")]
    table.compact(["t"])
    assert rows(table.read("t"), "key", "v") == want and table.info()["segments"] == 1
    # Three segments, and the keys that four commits named.
    assert len(table.vacuum()) == 7 and rows(table.read("t"), "key", "v") == want
    table.remove(frame(spark, [(3, "")]))
    assert rows(SegmentedTable(spark, str(tmp_path / "t")).read("t"), "key") == [(1,), (2,), (None,), (None,)]


def test_of_two_writers_the_second_goes_on_top(spark, tmp_path, monkeypatch):
    first, second = (SegmentedTable(spark, str(tmp_path / "t")) for _ in range(2))
    put(first, frame(spark, [(1, "a")]))
    stale = second.state()
    put(first, frame(spark, [(1, "b")]))
    answers = [stale]
    real = second.state
    monkeypatch.setattr(second, "state", lambda version=None: answers.pop() if answers else real(version))
    assert put(second, frame(spark, [(1, "c"), (2, "d")])) == 3
    assert rows(first.read("t"), "key", "v") == [(1, "c"), (2, "d")]


def test_what_is_committed_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    table, other = (SegmentedTable(spark, str(tmp_path / "t")) for _ in range(2))
    put(table, frame(spark, [(1, "a"), (2, "b"), (3, "c")]))
    table.remove(frame(spark, [(3, "")]))
    write = table._write

    def slow(tables):
        folder = write(tables)
        put(other, frame(spark, [(2, "x"), (3, "y")]))
        return folder

    monkeypatch.setattr(table, "_write", slow)
    table.compact(["t"])
    assert rows(table.read("t"), "key", "v") == [(1, "a"), (2, "x"), (3, "y")]
    monkeypatch.undo()
    monkeypatch.setattr(table, "_write", lambda tables: (write(tables), other.clear())[0])
    with pytest.raises(RuntimeError):
        table.compact(["t"])


def test_a_write_that_fails_is_not_seen(spark, tmp_path):
    table = SegmentedTable(spark, str(tmp_path / "t"))
    put(table, frame(spark, [(1, "a")]))
    broken = frame(spark, [(2, "b")]).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        put(table, broken)
    assert rows(table.read("t"), "key", "v") == [(1, "a")] and table.versions() == [1]


DOCS = [(1, "a b c"), (2, "a a d"), (3, ""), (4, None), (5, "净利润增长 5%"), (6, "b b b b"), (7, "d c a")]


def test_stored_index_searches_like_a_fresh_one(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a d"), (2, "zz"), (3, "净利润 5%"), (4, "b")], "query_id int, query string")
    index = text_index.TextIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(docs.where("doc_id <= 4"))
    index.add(docs.where("doc_id > 2").withColumn("text", F.when(F.col("doc_id") == 7, "old text").otherwise(F.col("text"))))
    index.add(docs.where("doc_id = 7"))
    index.add(spark.createDataFrame([(8, "a a a a")], "doc_id long, text string"))
    index.remove(spark.createDataFrame([(8,), (6,)], "doc_id long"))
    live = docs.where("doc_id <> 6")

    def check():
        opened = index.opened(asked)
        for search in (retrieval.bm25_search, retrieval.jaccard_search):
            assert rows(search(None, asked, index=opened), "*") == rows(search(live, asked), "*")
        assert rows(index.search(asked), "*") == rows(retrieval.bm25_search(live, asked), "*")

    check()
    index.compact()
    check()
    assert index.statistics().first()["n_docs"] == 4  # two of the six have no tokens
    index.clear()
    with pytest.raises(ValueError):
        index.search(asked)


def test_index_follows_a_changed_collection(spark, tmp_path):
    index = text_index.TextIndex(spark, str(tmp_path / "i"), buckets=2)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    report, hits = index.refreshed(docs, ["a d", "b"])
    assert (report["added"], report["removed"], report["n_docs"]) == (7, 0, 7) and hits.select("query_id").distinct().count() == 2
    changed = docs.where("doc_id <> 1").withColumn("text", F.when(F.col("doc_id") == 2, "new b").otherwise(F.col("text")))
    report, hits = index.refreshed(changed, ["new", "c"])
    assert (report["added"], report["removed"], report["n_docs"]) == (1, 1, 6)
    assert {(r["query_id"], r["key"]) for r in hits.collect()} == {(0, 2), (1, 7)}
    before = report["version"]
    assert index.refreshed(changed, ["new"])[0] == {"added": 0, "removed": 0, "n_docs": 6, "version": before}


def test_index_and_queries_share_a_segmenter(spark, tmp_path):
    words = spark.createDataFrame([("净利润", 50), ("增长", 80), ("公司", 90)], "word string, freq long")
    tokens = segmenter(words, stop=["的"])
    docs = spark.createDataFrame([(1, "公司的净利润增长"), (2, "公司的利润"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "净利润的增长")], "query_id int, query string")
    index = text_index.TextIndex(spark, str(tmp_path / "i"), buckets=2, tokens=tokens)
    index.add(docs)
    assert rows(index.search(asked), "query_id", "key") == [(1, 1)]
    fresh = retrieval.bm25_search(None, asked, index=retrieval.search_index(docs, asked, tokens=tokens))
    assert rows(index.search(asked), "*") == rows(fresh, "*")


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def test_recall_over_the_whole_table(spark, vectors, tmp_path):
    asked = vectors.where("vec_id % 50 = 0")
    index = vector_index.VectorIndex.build(vectors, str(tmp_path / "v"))
    exact = retrieval.cosine_search(vectors, asked, 10)
    assert vector_index.recall(index.search(asked), exact) >= 0.9
    assert len(index.centroids()) > 10 and index.table.read("vectors").count() == vectors.count()
    everything = index.search(asked, probes=len(index.centroids()))
    assert rows(everything, "query_id", "key", "rank") == rows(exact, "query_id", "key", "rank")


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    points = spark.range(3000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.sin((F.col("id") % 40) * 7.3 + i * (F.col("id") % 40 + 1)) + F.sin(F.col("id") * 1.7 + i * 3.1) * 0.1).alias("embedding"))
    asked = points.where("vec_id % 50 = 0")
    index = vector_index.VectorIndex.build(points, str(tmp_path / "v"))
    assert index.probes() < len(index.centroids()) / 3
    assert vector_index.recall(index.search(asked), retrieval.cosine_search(points, asked, 10)) >= 0.9


def test_index_grows_without_a_new_fit(spark, vectors, tmp_path):
    index = vector_index.VectorIndex.build(vectors.where("vec_id % 3 <> 0"), str(tmp_path / "v"), cells=8)
    centres = index.centroids().tolist()
    index.add(vectors.where("vec_id % 3 = 0"))
    index.remove(vectors.where("vec_id % 5 = 1"))
    moved = vectors.where("vec_id = 7").withColumn("vec_id", F.lit(2).cast("long"))
    index.add(moved)
    live = vectors.where("vec_id % 5 <> 1 and vec_id <> 2").unionByName(moved)
    asked = vectors.where("vec_id % 50 = 0 or vec_id = 7")
    for _ in range(2):
        opened = vector_index.VectorIndex(spark, str(tmp_path / "v"))
        assert opened.centroids().tolist() == centres
        got = opened.search(asked, probes=8)
        assert rows(got, "query_id", "key", "rank") == rows(retrieval.cosine_search(live, asked, 10), "query_id", "key", "rank")
        index.compact()


def test_odd_vectors_and_unknown_keys(spark, tmp_path):
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [1.0, 1.0]), (7, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    index = vector_index.VectorIndex.build(some, str(tmp_path / "v"), cells=2)
    assert index.table.read("vectors").count() == 7
    hits = index.search(some.where("vec_id in (1, 3, 4)"), probes=2)
    assert rows(hits, "query_id", "key", "rank", "score") == [(1, 1, 1, 1.0), (1, 2, 3, 0.0), (1, 6, 2, 0.707107), (1, 7, 4, 0.0)]
    found, counts = vector_index.mapped_hits(hits, spark.createDataFrame([(1,), (2,)], "doc_id long"), "doc_id")
    assert rows(found, "key", "rank") == [(1, 1), (2, 3)] and rows(counts, "*") == [(1, 4, 2)]
    empty = vector_index.VectorIndex.build(some.limit(0), str(tmp_path / "e"))
    assert empty.search(some).count() == 0
