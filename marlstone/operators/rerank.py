"""A second ranking of hits by a given scoring function, with the first ranking to fall back on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import map_arrow
from ..staging import if_few, staged

#: Candidates that the function is given at once, and from which score a hit is called high or medium.
BATCH = 20
LEVELS = (("high", 0.8), ("medium", 0.5))

#: From a query and texts to their scores, 0 to 1; it runs in tasks and may fail.
Scorer = Callable[[str, list[str]], list[float]]


def reranked(hits: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Scorer, k: int, key: str = "doc_id", text: str = "text", batch: int = BATCH) -> DataFrame:
    """The hits of each query in the order of the function's scores, the first ``k``.

    hits (query_id, key, rank, score and others), queries (query_id, query). More
    columns: rerank_score, level (high, medium, low) and fused_rank; rank is the
    new one, ties as before. A query for which one batch failed, or gave another
    number of scores or one that is no number, keeps its order, with null scores
    and levels. Hits without a document are scored as empty texts.
    """
    some = staged(hits.select("query_id", "key", "rank"), "rerank-hits")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("candidate")).join(if_few(some.select("key")), "key", "left_semi")
    rows = staged(texts.join(some, "key", "right").join(queries.select("query_id", "query"), "query_id"), "rerank-candidates")
    part = F.floor((F.col("rank") - 1) / batch)
    # A group is a batch: BATCH texts at most.
    groups = rows.groupBy("query_id", "query", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("rank", "key", F.coalesce("candidate", F.lit("")).alias("candidate")))).alias("c"))
    groups = groups.select("query", F.col("c")["candidate"].alias("texts"), F.struct("query_id", F.col("c")["key"].alias("keys")).alias("row"))
    id_type, key_type = dict(hits.dtypes)["query_id"], dict(hits.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            scores = []
            for query, given in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                try:
                    found = [float(x) for x in scorer(query, given)]
                    scores.append(found if len(found) == len(given) and all(x == x for x in found) else None)
                except Exception:  # whatever the function raises: its batch has no scores
                    scores.append(None)
            yield pa.RecordBatch.from_arrays([some.column(2), pa.array(scores, pa.list_(pa.float64()))], names=["row", "scores"])

    scored = staged(map_arrow(groups, run, f"row struct<query_id:{id_type},keys:array<{key_type}>>, scores array<double>"), "rerank-scores")
    failed = scored.where("scores is null").select(F.col("row.query_id").alias("query_id")).distinct()
    pairs = scored.where("scores is not null").select(F.col("row.query_id").alias("query_id"), F.explode(F.arrays_zip(F.col("row.keys").alias("key"), "scores")).alias("x"))
    pairs = pairs.select("query_id", F.col("x.key").alias("key"), F.col("x.scores").alias("rerank_score")).join(failed, "query_id", "left_anti")
    level = F.lit("low")
    for name, least in reversed(LEVELS):
        level = F.when(F.col("rerank_score") >= least, name).otherwise(level)
    out = hits.withColumnRenamed("rank", "fused_rank").join(pairs, ["query_id", "key"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "fused_rank")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.withColumn("level", F.when(F.col("rerank_score").isNotNull(), level))
