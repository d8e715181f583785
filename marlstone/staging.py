"""Tables written between steps, in the folder that driver and executors share.

A written table cuts the lineage, so a lost executor costs a re-read and not a
recomputation. The folder is ``spark.checkpoint.dir``; only where that is unset
and Spark runs on this machine alone, a temporary folder takes its place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fully qualified URI that nothing uses yet."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="marlstone-"))
        base = _fallback[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return f"{uri}/marlstone/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, partitionBy: list[str] | None = None, **options) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    path = new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path, partitionBy=partitionBy)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a staged table of a few short values that may be broadcast.
FEW = 200_000


def if_few(table: DataFrame, rows: int = FEW) -> DataFrame:
    """A staged table, marked for broadcast if its rows, which are counted, are few."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def rename_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    """Move a file or folder to a name that nothing has yet; False if something has it.

    The file system must refuse to rename onto a name that exists, as HDFS and
    local ones do.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    old, new = jvm.Path(source), jvm.Path(target)
    conf = spark._jsc.hadoopConfiguration()
    fs = new.getFileSystem(conf)
    old, new = fs.makeQualified(old), fs.makeQualified(new)
    fs.mkdirs(new.getParent())
    never_over = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
    never_over[0] = getattr(jvm, "Options$Rename").NONE
    try:
        jvm.FileContext.getFileContext(new.toUri(), conf).rename(old, new, never_over)
    except Exception as error:
        if not fs.exists(new) or "FileAlreadyExists" not in str(error):
            raise
        return False
    return True
