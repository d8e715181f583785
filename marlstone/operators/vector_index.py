"""An inverted-file index for approximate cosine search.

Centroids are fitted once on a bounded sample; every vector is put into the cell
of its nearest centroid, and cells are partitions of the stored table. A query
reads the vectors of its nearest cells only and ranks them exactly; with all cells
the search is exact. Vectors are added and removed as segments, without a new fit.

Queries are written to the shared folder by cell. The tasks that read a cell's
vectors lay each batch against that cell's queries, so nothing is shuffled but
the best hits, and a cell that holds a third of all vectors is read by as many
tasks as its files have splits.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow
from ..staging import staged
from .retrieval import PRECISION, QUERY_VALUES, _unit, cosine_search, top_k
from .segments import SegmentedTable

#: The most cells, and the sampled vectors for each cell of which centroids are fitted.
MAX_CELLS = 16_384
PER_CELL = 64
#: Sampled vectors whose neighbours set how many cells a query reads, the neighbours of each, and the recall aimed at.
TRIALS = 200
NEIGHBOURS = 10
RECALL = 0.95
#: Cells that a scan names one by one; more are read whole.
_NAMED_CELLS = 1000
#: The cell of vectors without a direction: null, of norm zero or of another length.
NO_CELL = -1


def _rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))


class VectorIndex:
    """A stored index below a path; keys are long integers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table = SegmentedTable(spark, f"{path}/cells", partition={"vectors": "cell"})

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Fit centroids and store every vector; the width is that of most vectors of the sample.

        ``cells`` is by default the root of the number of vectors. The sample are
        the vectors whose hash of the key is below a bound, about PER_CELL a cell
        whatever the table's size. From the sample's own neighbours follows how
        many cells a query reads by default.
        """
        index = cls(vectors.sparkSession, path)
        rows = _rows(vectors, key, vector).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        rows = rows.where("norm > 0")
        n = rows.count()
        cells = min(MAX_CELLS, cells or max(1, round(math.sqrt(n))))
        share = min(1.0, cells * PER_CELL / max(1, n))
        sample = staged(rows.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key", "v"), "vector-sample")
        width = sample.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
        points = sample.where(F.size("v") == (width[0] if width else 0))
        held = points.count()
        centres = np.zeros((0, width[0] if width else 0))
        if held:
            model = KMeans(k=max(2, min(cells, held)), distanceMeasure="cosine", maxIter=10, seed=seed).fit(points.select(array_to_vector("v").alias("features")))
            centres = np.array(model.clusterCenters())
        made = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        index.spark.createDataFrame(made, "cell int, v array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
        probes = index._calibrated(points) if held else 1
        index.spark.createDataFrame([(probes,)], "probes int").write.mode("overwrite").parquet(f"{path}/fit")
        index.table.clear()
        index.add(vectors, key, vector)
        return index

    def _calibrated(self, sample: DataFrame) -> int:
        """How many cells hold RECALL of the nearest neighbours of TRIALS sampled vectors.

        The sample is thinner than the whole, so its neighbours are further away
        and the number rather too large.
        """
        trials = sample.orderBy(F.xxhash64(F.lit(3), "key"), "key").limit(TRIALS)
        found = cosine_search(sample, trials, NEIGHBOURS + 1, "key", "v").where("query_id <> key")
        cells = self._nearest(sample, 1).select("key", "cell")
        met = found.join(cells, "key").where(F.col("cell") != NO_CELL).select("query_id", "cell").collect()  # TRIALS * NEIGHBOURS rows
        centres = self.centroids()
        asked = {r["key"]: np.argsort(np.argsort(-(centres @ np.array(r["v"])), kind="stable")) for r in trials.collect()}
        places = [asked[q][cell] for q, cell in met]
        return 1 + int(np.quantile(places, RECALL, method="higher")) if places else 1

    def probes(self) -> int:
        """Cells that a query reads by default."""
        return self.spark.read.parquet(f"{self.path}/fit").first()[0]

    def centroids(self) -> np.ndarray:
        """MAX_CELLS rows at most, of length one."""
        found = sorted(self.spark.read.parquet(f"{self.path}/centroids").collect())
        centres = np.array([r["v"] for r in found]) if found else np.zeros((0, 0))
        return centres / np.maximum(np.linalg.norm(centres, axis=1), 1e-300)[:, None] if found else centres

    def _nearest(self, rows: DataFrame, probes: int) -> DataFrame:
        """(key, v, cell) with a row for each of the ``probes`` nearest cells; NO_CELL for vectors without a direction."""
        shared = self.spark.sparkContext.broadcast(self.centroids())
        kinds = pa.schema([("key", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for batch in batches:
                units = _unit(batch.column(1), centres.shape[1]) if len(centres) else np.zeros((batch.num_rows, 0))
                some = np.flatnonzero(units.any(axis=1))
                take = min(probes, len(centres))
                order = np.argsort(-np.round(units[some] @ centres.T, PRECISION), axis=1, kind="stable")[:, :take] if take else np.zeros((len(some), 0), int)
                none = np.setdiff1d(np.arange(batch.num_rows), some)
                at = np.concatenate([np.repeat(some, take), none])
                cells = np.concatenate([order.ravel(), np.full(len(none), NO_CELL)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)).cast(kinds.field(1).type), pa.array(cells)], schema=kinds)

        return map_arrow(rows, run, "key long, v array<double>, cell int")

    def add(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> int:
        """Store vectors in place of those of equal keys; a key that ``vectors`` holds twice is stored twice.

        Files of one cell are spread by key, so that a large cell is not one file.
        """
        rows = self._nearest(_rows(vectors, key, vector), 1)
        spread = rows.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(8)))
        return self.table.put({"vectors": spread}, vectors.select(F.col(key).cast("long").alias("key")))

    def remove(self, keys: DataFrame, key: str = "vec_id") -> int:
        return self.table.remove(keys.select(F.col(key).cast("long").alias("key")))

    def compact(self) -> int:
        return self.table.compact(["vectors"])

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, key, rank, score): the ``k`` nearest of the cells that each query probes.

        Queries are a stated set. Scores are cosines, below zero given as zero;
        vectors without a direction have none and are no hits, and queries
        without one have no hits. With ``probes`` of the number of cells or more
        the result is exact.
        """
        centres = self.centroids()
        probes = self.probes() if probes is None else probes
        asked = self._nearest(_rows(queries, key, vector), probes).where(F.col("cell") != NO_CELL)
        width = max(1, centres.shape[1])
        per_file = max(1, QUERY_VALUES // width)
        asked = staged(asked.select(F.col("key").alias("query_id"), "v", "cell").repartition("cell"), "probes", maxRecordsPerFile=per_file, partitionBy=["cell"])
        files: dict[int, list[str]] = defaultdict(list)
        for file in asked.inputFiles():  # names only
            files[int(file.rsplit("/cell=", 1)[1].split("/", 1)[0])].append(file)
        named = sorted(files)
        where = F.col("cell").isin(named) if len(named) <= _NAMED_CELLS else F.col("cell") != NO_CELL
        rows = self.table.read("vectors", where).select(F.col("cell").cast("int").alias("cell"), "key", "v")
        kinds = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

            def block(file: str) -> tuple[np.ndarray, np.ndarray]:
                if file not in held:
                    held.clear()
                    store, path = pafs.FileSystem.from_uri(file)
                    with store.open_input_file(path) as source:
                        read = pq.read_table(source)
                    held[file] = read.column("query_id").to_numpy(), _unit(read.column("v").combine_chunks(), width)
                return held[file]

            for batch in batches:
                cells = batch.column(0).to_numpy()
                for cell in np.unique(cells):
                    part = batch.filter(pa.array(cells == cell))
                    keys, units = part.column(1).to_numpy(zero_copy_only=False), _unit(part.column(2), width)
                    for file in files.get(int(cell), ()):
                        ids, wanted = block(file)
                        scores = np.round(wanted @ units.T, PRECISION)
                        best = np.argsort(keys, kind="stable")
                        best = best[np.argsort(-scores[:, best], axis=1, kind="stable")[:, :k]]
                        at = np.repeat(np.arange(len(ids)), best.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(keys[best.ravel()], pa.int64()), pa.array(scores[at, best.ravel()])], schema=kinds)

        found = top_k(map_arrow(rows, run, "query_id long, key long, score double"), k)
        return found.select("query_id", "key", "rank", F.greatest("score", F.lit(0.0)).alias("score"))


def mapped_hits(hits: DataFrame, docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Hits whose key ``docs`` holds, their ranks unchanged, and (query_id, n_hits, n_unmapped) of every query with hits."""
    known = docs.select(F.col(key).alias("key")).distinct().withColumn("known", F.lit(True))
    found = staged(hits.join(known, "key", "left"), "mapped-hits")
    counts = found.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.sum(F.col("known").isNull().cast("long")).alias("n_unmapped"))
    return found.where("known").drop("known"), counts


def recall(hits: DataFrame, exact: DataFrame, k: int = 10) -> float:
    """Share of the exact first ``k`` hits that are among ``hits``; 1 where there are none."""
    wanted = exact.where(F.col("rank") <= k).select("query_id", "key").distinct()
    found = wanted.join(hits.select("query_id", "key").distinct().withColumn("met", F.lit(1)), ["query_id", "key"], "left")
    return found.agg(F.coalesce(F.avg(F.coalesce("met", F.lit(0))), F.lit(1.0))).first()[0]
