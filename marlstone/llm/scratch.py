"""Tables written between the steps of an operator.

A written table cuts the lineage, so a lost executor costs a re-read and not a
recomputation, and gives the optimiser a size it can trust. Tables go to the
folder named by ``spark.checkpoint.dir``, which all executors share; only where
that setting is missing and Spark runs on this machine alone (tests) a temporary
folder is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder as a fully qualified URI."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="marlstone-"))
        base = _fallback[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/marlstone/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for root in roots:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of a staged table that may be broadcast.
LOOKUP_ROWS = 400_000
LOOKUP_BYTES = 32 << 20


def _row_bytes(value: Column, kind: DataType) -> Column:
    """About the bytes of a value: eight for a number, the length of what varies."""
    if isinstance(kind, (StringType, BinaryType)):
        found = F.octet_length(value)
    elif isinstance(kind, ArrayType):
        found = F.size(value) * (8 if not isinstance(kind.elementType, (StringType, BinaryType)) else 32)
    elif isinstance(kind, StructType):
        found = sum((_row_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(0))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(found, F.lit(0)).cast("long") + 8


def lookup(table: DataFrame, rows: int = LOOKUP_ROWS, size: int = LOOKUP_BYTES) -> DataFrame:
    """A staged table, marked for broadcast if it is small enough.

    Its rows and bytes are counted first. A larger table is left to a shuffled
    join, whose keys are then many.
    """
    each = sum((_row_bytes(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(0))
    n, held = table.limit(rows + 1).agg(F.count("*"), F.sum(each)).first()
    return F.broadcast(table) if n <= rows and (held or 0) <= size else table
