"""Session settings that every query needs."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def share_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it is.

    On a cluster, ship the package with ``--py-files``; the extra entry of the
    path then does no harm.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([x for x in known if x] + [ROOT])


def map_arrow(df: DataFrame, task: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package importable in the workers."""
    share_package(df.sparkSession)
    return df.mapInArrow(task, schema)
