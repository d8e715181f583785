"""Events of a day whose title and url are equal."""

from pyspark.sql import functions as F

from marlstone.plans import news as plans


def test_events_that_share_title_and_url(spark, tmp_path):
    # Ids of one day; the SQL leaves open which of these rows stands for the title.
    rows = [(9 * i + 2, "u", f"<title>a</title> text {i}") for i in range(40)]
    pages = spark.createDataFrame(rows[::-1], "page_id long, url string, html string").coalesce(1)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    want = spark.range(1).select(F.md5(F.lit(rows[0][2]))).first()[0]
    assert [r.content_md5 for r in plans.date_events(spark, str(tmp_path)).collect()] == [want]
