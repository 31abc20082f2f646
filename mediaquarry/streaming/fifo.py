"""First-in-first-out queues over a stream of pushes and pops, kept in state.

Each queue has its own state: how many pushes and pops there were, the pushes
that nobody has taken, by their number, and pops that still wait.  A micro-batch
reads and writes only the entries that it changes, so state may be as long as
the queue is.  Commands count in the order of their batches, and within a batch
in the order of seq; the rows of one queue in one batch are sorted by one task.

State is kept in RocksDB, as this kind of operator requires; the session's
setting is put back once the query has started.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.joblog import POP, PUSH
from ..sources import storage

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULTS = "key string, seq long, op string, n long, depth long, vain boolean"


class Queue(StatefulProcessor):
    """Rows (key, seq, op, n, depth, vain): each push with its number and each pop with that of the push it took; depth is the queue's length after it.

    A pop that finds nothing is in vain at once, or with ``wait`` (milliseconds
    of the clock) once that time is over and no push came; until then it is
    first in line for the next push.
    """

    def __init__(self, wait: int = 0) -> None:
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "pushed long, taken long, asked long, served long")
        self.pushes = handle.getMapState("pushes", "n long", "seq long")
        self.asks = handle.getMapState("asks", "n long", "seq long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        pushed, taken, asked, served = self.counts.get() if self.counts.exists() else (0, 0, 0, 0)
        # what this batch adds meets the state only if it is left at its end
        new_pushes: dict[int, int] = {}
        new_asks: dict[int, tuple[int, int]] = {}
        now, out = timerValues.getCurrentProcessingTimeInMs() if self.wait else 0, []
        for seq, op in zip(batch["seq"].tolist(), batch["op"].tolist(), strict=True):
            if op == PUSH:
                pushed += 1
                new_pushes[pushed] = seq
                out.append((key[0], seq, op, pushed, pushed - taken, False))
                if served < asked:
                    served += 1
                    ask = new_asks.pop(served)[0] if served in new_asks else self._take(self.asks, served)[0]
                    taken += 1
                    new_pushes.pop(taken)
                    out.append((key[0], ask, POP, taken, pushed - taken, False))
            elif op == POP and taken < pushed:
                taken += 1
                if taken in new_pushes:
                    new_pushes.pop(taken)
                else:
                    self._take(self.pushes, taken)
                out.append((key[0], seq, op, taken, pushed - taken, False))
            elif op == POP and self.wait:
                asked += 1
                new_asks[asked] = (seq, now + self.wait)
            elif op == POP:
                out.append((key[0], seq, op, None, 0, True))
        for n, seq in new_pushes.items():
            self.pushes.updateValue((n,), (seq,))
        for n, ask in new_asks.items():
            self.asks.updateValue((n,), ask)
        if new_asks:
            self.handle.registerTimer(now + self.wait)
        self.counts.update((pushed, taken, asked, served))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pushed, taken, asked, served = self.counts.get()
        out = []
        while served < asked and self.asks.getValue((served + 1,))[1] <= expiredTimerInfo.getExpiryTimeInMs():
            served += 1
            out.append((key[0], self._take(self.asks, served)[0], POP, None, pushed - taken, True))
        self.counts.update((pushed, taken, asked, served))
        yield self._rows(out)

    @staticmethod
    def _take(state, n: int) -> tuple:
        found = state.getValue((n,))
        state.removeKey((n,))
        return found

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=["key", "seq", "op", "n", "depth", "vain"])
        return found.astype({"key": "object", "seq": "int64", "op": "object", "n": "Int64", "depth": "int64", "vain": "bool"})

    def close(self) -> None:
        pass


def queues(log: DataFrame, wait: int = 0) -> DataFrame:
    """The rows of :class:`Queue` for a stream of commands (seq, op, key)."""
    storage.ship(log.sparkSession)
    rows = log.filter(log["op"].isin(PUSH, POP)).select("key", "seq", "op")
    return rows.groupBy("key").transformWithStateInPandas(Queue(wait), RESULTS, "Append", "ProcessingTime" if wait else "None")


def replay(log: DataFrame, path: str, checkpoint: str, wait: int = 0, **trigger) -> StreamingQuery:
    """Follow a stream of commands and append the rows of its queues to a folder, by default until no input is left."""
    spark = log.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return queues(log, wait).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
