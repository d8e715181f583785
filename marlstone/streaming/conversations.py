"""Conversations as state of a stream: what is to be summarised next, each turn once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import share_package
from .ingest import zoned

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEGMENT = "conv_id string, n_turns long, begin long, end long, closed boolean, turns array<struct<turn:long,role:string,text:string>>"
_MARK, _TURN, _SAID = "n long, upto long, last long, closed boolean", "turn long", "role string, text string"


class Compression(StatefulProcessor):
    """State of a conversation: its mark, and the turns that no segment has had yet."""

    def __init__(self, threshold: int, keep: int, idle_ms: int, forget_ms: int):
        self.threshold, self.keep, self.idle_ms, self.forget_ms = threshold, keep, idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", _MARK)
        self.open = handle.getMapState("open", _TURN, _SAID)

    def _wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _take(self, key, n: int, begin: int, end: int, closed: bool) -> pd.DataFrame:
        """The segment [begin, end) as a row; its turns leave the state."""
        turns = []
        for turn in range(begin, end):
            if self.open.containsKey((turn,)):
                role, text = self.open.getValue((turn,))
                turns.append({"turn": turn, "role": role, "text": text})
                self.open.removeKey((turn,))
        return pd.DataFrame({"conv_id": [key[0]], "n_turns": [n], "begin": [begin], "end": [end], "closed": [closed], "turns": [turns]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.mark.get() if self.mark.exists() else None
        n, upto, last, _ = known or (0, 0, 0, False)
        for part in rows:
            for turn, role, text, at in zip(part["turn"], part["role"], part["text"], part["at_ms"]):
                turn, last = int(turn), max(last, 0 if pd.isna(at) else int(at))
                if turn >= upto and not self.open.containsKey((turn,)):
                    self.open.updateValue((turn,), (None if pd.isna(role) else role, None if pd.isna(text) else text))
        while self.open.containsKey((n,)):
            n += 1
        end = n - self.keep if n >= self.threshold else upto
        if end > upto:
            yield self._take(key, n, upto, end, False)
            upto = end
        self.mark.update((n, upto, last, False))
        self._wake(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, upto, last, closed = self.mark.get()
        if closed:
            self.mark.clear()
            self.open.clear()
            return
        # What stands behind a gap is taken too: the missing turns come no more.
        end = max([n, *(turn + 1 for (turn,) in self.open.keys())])
        yield self._take(key, end, upto, end, True)
        self.mark.update((end, end, last, True))
        self._wake(expiredTimerInfo.getExpiryTimeInMs() + self.forget_ms)

    def close(self) -> None:
        pass


def compressed(turns: DataFrame, threshold: int = 10, keep: int = 8, idle: float = 86_400.0, forget: float = 2_592_000.0, late: str = "1 hour") -> DataFrame:
    """(conv_id, n_turns, begin, end, closed, turns): segments [begin, end) of conversations, to be summarised.

    ``turns`` is a stream of (conv_id, turn, role, text, at), turns numbered from
    0. Once a conversation has ``threshold`` turns without a gap, all but the last
    ``keep`` of them are given out, each once. So however the turns are dealt to
    batches, and in whatever order they come, the segments of a conversation lie
    end to end and reach the end that ``dialogue.compression`` gives. Repeated
    turns are ignored, rows without a conversation or a number too.

    ``idle`` seconds after its last turn, by the watermark, a conversation is
    closed: one row gives out the rest of its turns. Only its mark stays, so that
    it may go on; ``forget`` seconds later that goes too. A turn that comes for a
    conversation after that waits for turn 0, and is given out when it closes.
    """
    spark = turns.sparkSession
    share_package(spark)
    spark.conf.set(STORE, ROCKS)  # the only store that knows timers and maps
    rows = zoned(turns, "at").withWatermark("at", late).where("conv_id is not null and turn >= 0")
    rows = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.unix_millis("at").alias("at_ms"))
    processor = Compression(threshold, keep, int(idle * 1000), int(forget * 1000))
    return rows.groupBy("conv_id").transformWithStateInPandas(processor, outputStructType=SEGMENT, outputMode="Append", timeMode="EventTime")


def marks(segments: DataFrame) -> DataFrame:
    """(conv_id, upto) of written segments: how far each conversation was given out, as ``dialogue.compression`` takes it."""
    return segments.groupBy("conv_id").agg(F.max("end").alias("upto"))


def segment_pairs(segments: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of written segments, for ``dialogue.question_answer_pairs`` and the summaries."""
    return segments.select("conv_id", F.inline("turns"))
