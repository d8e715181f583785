"""Stored tables that grow: immutable segments, named keys that hide older rows, compaction.

Below one path lie the folders of segments, the keys that each commit names, and
one small manifest for each version, which lists the folders that count. Writing
adds folders and then claims the next manifest by renaming it to a name that must
not exist. So readers see a commit whole or not at all, a failed write leaves
only folders that nobody reads, and of two writers the second tries again on top
of the first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..staging import if_few, rename_if_absent, staged

#: A manifest: its number, the segments and the named keys, each [version, folder], the tables' schemas, and the last batch of each writer.
State = dict
#: Named keys that may be broadcast; each is a key and a number.
NAMED = 1_000_000
_NOTHING: State = {"version": 0, "segments": [], "named": [], "schemas": {}, "batches": {}}
#: A batch of a writer, such as a stream's, by name and number.
Batch = tuple[str, int]


class SegmentedTable:
    """Tables by name, in rows of one ``key``; rows with a null key are never replaced or removed.

    The file system must refuse to rename onto a name that exists, as HDFS and
    local ones do.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "key", partition: dict[str, str] | None = None):
        self.spark, self.key, self.partition = spark, key, partition or {}
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self._fs.makeQualified(root).toString()

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """Numbers of the commits, ascending."""
        folder = self._hadoop(f"{self.path}/manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def state(self, version: int | None = None) -> State:
        """The manifest of a version, by default the last; an empty one where there is none."""
        known = self.versions()
        if not known:
            return dict(_NOTHING)
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{version or known[-1]:09d}").collect()))

    def _claim(self, state: State) -> bool:
        """Write the manifest if nobody else has written one of its number."""
        draft = self._hadoop(f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if rename_if_absent(self.spark, draft.toString(), f"{self.path}/manifests/{state['version']:09d}"):
            return True
        self._fs.delete(draft, False)
        return False

    def has_batch(self, batch: Batch, state: State | None = None) -> bool:
        """Whether the batch, or a later one of its writer, was committed."""
        return (state or self.state()).get("batches", {}).get(batch[0], -1) >= batch[1]

    def _commit(self, change: Callable[[State, int], State], batch: Batch | None = None) -> int:
        while True:
            state = self.state()
            if batch and self.has_batch(batch, state):
                return state["version"]
            version = state["version"] + 1
            done = {"batches": state.get("batches", {}) | {batch[0]: batch[1]}} if batch else {}
            if self._claim(state | change(state, version) | done | {"version": version}):
                return version

    def _write(self, tables: dict[str, DataFrame]) -> str:
        folder = f"{self.path}/segments/{uuid.uuid4().hex}"
        for name, rows in tables.items():
            out = rows.write.partitionBy(self.partition[name]) if name in self.partition else rows.write
            out.parquet(f"{folder}/{name}")
        return folder

    def _name(self, keys: DataFrame) -> str:
        folder = f"{self.path}/named/{uuid.uuid4().hex}"
        keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().write.parquet(folder)
        return folder

    def put(self, tables: dict[str, DataFrame], keys: DataFrame | None, batch: Batch | None = None) -> int:
        """Add rows; they replace all rows of ``keys``, in every table, or none.

        A ``batch`` is recorded by the same manifest that makes its rows count, so
        there is no state in which one of the two is missing; one that was
        recorded before changes nothing.
        """
        segment, named = self._write(tables), None if keys is None else self._name(keys)
        schemas = {name: rows.schema.jsonValue() for name, rows in tables.items()}

        def change(now: State, v: int) -> State:
            more = [[v, named]] if named and now["segments"] else []
            return {"segments": [*now["segments"], [v, segment]], "named": [*now["named"], *more], "schemas": schemas}

        return self._commit(change, batch)

    def remove(self, keys: DataFrame) -> int:
        """Hide the rows of ``keys``; nothing else is read or written."""
        named = self._name(keys)
        return self._commit(lambda s, v: {"named": [*s["named"], [v, named]]})

    def clear(self) -> int:
        return self._commit(lambda s, v: {"segments": [], "named": []})

    def _stored(self, name: str, state: State) -> DataFrame | None:
        """All rows of a table, with the number of their segment."""
        found = None
        for version, folder in state["segments"]:
            part = self.spark.read.schema(StructType.fromJson(state["schemas"][name])).parquet(f"{folder}/{name}").withColumn("segment", F.lit(version))
            found = part if found is None else found.unionByName(part)
        return found

    def read(self, name: str, where: Column | None = None, state: State | None = None, keys: str | None = None) -> DataFrame:
        """The rows that count of a table; ``where`` may prune its partitions.

        ``keys`` is a smaller table that has every key once a segment: named keys
        that hide nothing are then left out before rows are laid against them.
        """
        state = state or self.state()
        found = self._stored(name, state)
        if found is None:
            raise ValueError(f"nothing is stored below {self.path}")
        found = found if where is None else found.where(where)
        if not state["named"]:
            return found.drop("segment")
        named = None
        for version, folder in state["named"]:
            part = self.spark.read.parquet(folder).withColumn("since", F.lit(version))
            named = part if named is None else named.unionByName(part)
        named = named.groupBy(F.col(self.key).alias("named_key")).agg(F.max("since").alias("since"))
        if keys is not None:
            stored = self._stored(keys, state).select(F.col(self.key).alias("k"), F.col("segment").alias("s"))
            named = staged(named.join(stored, (F.col("named_key") == F.col("k")) & (F.col("s") < F.col("since")), "left_semi"), "hiding-keys")
        named = if_few(named, NAMED)
        live = found.join(named, found[self.key] == named["named_key"], "left").where("since is null or since <= segment")
        return live.drop("segment", "named_key", "since")

    def compact(self, names: list[str], keep: Callable[[DataFrame], DataFrame] | None = None, keys: str | None = None) -> int:
        """Rewrite what counts, or what ``keep`` takes of it, as one segment; what others commit meanwhile stays on top of it."""
        state = self.state()
        keep = keep or (lambda rows: rows)
        folder = self._write({name: keep(self.read(name, state=state, keys=keys)) for name in names})
        old = {f for kind in ("segments", "named") for _, f in state[kind]}

        def change(now: State, _: int) -> State:
            if not old <= {f for kind in ("segments", "named") for _, f in now[kind]}:
                raise RuntimeError("the segments were compacted or cleared meanwhile")
            return {"segments": [[state["version"], folder], *(s for s in now["segments"] if s[1] not in old)], "named": [n for n in now["named"] if n[1] not in old]}

        return self._commit(change)

    def vacuum(self) -> list[str]:
        """Delete folders that the last manifest does not list; only when nobody writes or reads an older version."""
        kept = {f.rsplit("/", 1)[1] for kind in ("segments", "named") for _, f in self.state()[kind]}
        gone = []
        for kind in ("segments", "named", "drafts"):
            folder = self._hadoop(f"{self.path}/{kind}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if status.getPath().getName() not in kept:
                    self._fs.delete(status.getPath(), True)
                    gone.append(status.getPath().getName())
        return gone

    def info(self) -> dict:
        """Version, segments, named-key folders and bytes: what a listing of the store shows."""
        state = self.state()
        sizes = [self._fs.getContentSummary(self._hadoop(f)).getLength() for _, f in state["segments"]]
        return {"version": state["version"], "segments": len(state["segments"]), "named": len(state["named"]), "bytes": sum(sizes)}
