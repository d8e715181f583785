"""Sinks of streams that may get a batch twice: append, upsert and retention on a stored table.

A stream delivers a batch again if it failed before its end was noted. Here the
number of a batch is part of the manifest that makes its rows count, so a batch
is there whole and noted, or not at all: what a failed one has written is in
folders that no manifest lists, and the batch that comes again writes anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import knowledge
from ..operators.segments import SegmentedTable
from ..staging import if_few

TABLE = "rows"


@dataclass
class KeyedSink:
    """Takes the batches of one stream, for ``foreachBatch``: one row of each key of the store.

    ``upsert`` lets the last row of a key in ``order`` replace what is stored,
    else the first row of a key that is not stored yet is added and all others
    are left out. Rows without a key are left out. ``writer`` names the stream in
    the store; a stream that starts afresh, with new batch numbers, takes a new
    name. Only one stream may append at a time, as others' rows are not seen
    between the look-up and the commit; upserts may meet.

    ``newest`` rows by ``newest_first`` stay when the store has ``slack`` times as
    many. After ``compact_after`` segments the store is one segment again.
    """

    store: SegmentedTable
    writer: str
    order: list[Column] = field(default_factory=list)
    upsert: bool = True
    newest: int | None = None
    newest_first: list[Column] = field(default_factory=list)
    slack: float = 1.5
    compact_after: int = 50

    def __call__(self, batch: DataFrame, number: int) -> None:
        if not self.store.has_batch((self.writer, number)):
            self._put(batch, (self.writer, number))
        self.tidy()

    def _put(self, batch: DataFrame, at: tuple[str, int]) -> None:
        key = self.store.key
        order = self.order or [F.lit(0)]
        rows = knowledge.first_of(batch.where(F.col(key).isNotNull()), [key], order).persist()
        try:
            if not self.upsert and self.store.state()["segments"]:
                # Of the store only keys are read, and few of them get any further.
                known = self.store.read(TABLE).select(key).join(if_few(rows.select(key)), key, "left_semi").distinct()
                fresh = rows.join(known, key, "left_anti").select(*batch.columns)
            else:
                fresh = rows
            self.store.put({TABLE: fresh}, rows.select(key) if self.upsert else None, at)
        finally:
            rows.unpersist()

    def tidy(self) -> None:
        """Retention and compaction, where they are due; what failed here is made good after the next batch."""
        state = self.store.state()
        if not state["segments"]:
            return
        if self.newest is not None and self.store.read(TABLE, state=state).count() > self.newest * self.slack:
            self.store.compact([TABLE], lambda rows: knowledge.newest(rows, self.newest, [*self.newest_first, F.col(self.store.key)]))
        elif len(state["segments"]) > self.compact_after:
            self.store.compact([TABLE])

    def rows(self) -> DataFrame:
        """What is stored; with retention the newest rows only, also while more are there."""
        found = self.store.read(TABLE)
        return found if self.newest is None else knowledge.newest(found, self.newest, [*self.newest_first, F.col(self.store.key)])


def start(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """The running query that gives ``rows`` to the sink; ``trigger`` by default takes what is there and stops."""
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
