"""Every German document takes part in the index, also those with odd ids."""

from marlstone.plans import registry

from .oracle import assert_same


def test_odd_german_documents_are_indexed(spark, tmp_path):
    rows = [(1, "eins zwei", "de"), (2, "zwei", "de"), (3, "un", "fr"), (4, "one", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.queries()["index_maintenance"](spark, str(tmp_path)).select("term", "df", "cf").collect()}
    assert got == {("eins", 1, 1), ("zwei", 2, 2), ("one", 1, 1)}


def test_index_matches_its_sql(spark, sf):
    assert_same(registry.queries()["index_maintenance"](spark, sf), registry.oracle_sql()["index_maintenance"], sf)
