"""Metrics that arrive in parts as streams: each key's values are kept in the state store until its run is whole, then given out once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "key string, epochs long, mean double, missing long"


class _Run(StatefulProcessor):
    """A key's value of each epoch, the last one logged, and how many epochs there will be."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "epoch long", "ord long, value double")
        self.size = handle.getValueState("size", "epochs long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for batch in rows:
            latest = max(latest, int(batch["time"].max().timestamp() * 1000))
            for epoch, ord_, value, total in zip(batch["epoch"], batch["ord"], batch["value"], batch["epochs"], strict=True):
                at = (int(epoch),)
                if not self.values.containsKey(at) or self.values.getValue(at)[0] <= ord_:
                    self.values.updateValue(at, (int(ord_), float(value)))
                if not pd.isna(total):
                    self.size.update((int(total),))
        if self.size.exists() and sum(1 for _ in self.values.keys()) >= self.size.get()[0]:
            yield self._given(key)
        else:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(latest + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.size.exists() or self.values.exists():
            yield self._given(key)

    def _given(self, key) -> pd.DataFrame:
        found = {e[0]: v[1] for e, v in self.values.iterator()}
        total = self.size.get()[0] if self.size.exists() else max(found) + 1
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.values.clear()
        self.size.clear()
        return pd.DataFrame({"key": [key[0]], "epochs": [total], "mean": [sum(found.values()) / len(found)], "missing": [total - len(found)]})

    def close(self) -> None:
        pass


def whole_runs(log: DataFrame, wait_ms: int = 60_000, late: str = "1 minute") -> DataFrame:
    """``(key, epochs, mean, missing)``, a row for each run of the stream ``log(key, epoch, ord, value, epochs, time)`` once all its epochs are there: the mean of each epoch's last value.

    ``epochs`` tells how many a run has and may be null but in one row. Epochs may come in any order and more than once. A run that gets nothing for ``wait_ms`` of the log's own ``time`` is given out with
    the number of those that are ``missing``; rows that are later than ``late`` are left out. A run's state is gone with its row; the state store and the checkpoint make it survive
    restarts. Needs the RocksDB state store.
    """
    return log.withWatermark("time", late).groupBy("key").transformWithStateInPandas(_Run(wait_ms), _OUT, "append", "eventTime")
