"""Sliding sums kept up to date by adding the pane that enters and taking off the pane that leaves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "win long, key long, value long"


class SlidingSum(StatefulProcessor):
    """Per key the sums of the panes that a window to come still needs, their total in the next window, and a timer for its end.

    A window is reported when the watermark reaches its end, also when the key has no packets any more. With its last pane a key
    leaves the state. A pane whose end the watermark has passed gets no more packets: Spark drops and counts these.
    """

    def __init__(self, pane: int, panes: int, origin: int):
        self.pane, self.panes, self.origin = pane, panes, origin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getMapState("ring", "pane long", "value long")
        self.next = handle.getValueState("next", "win long, total long")

    def _end(self, win: int) -> int:
        """Milliseconds at which a window has ended."""
        return -(-(self.origin + (win + 1) * self.pane) // 1000)

    def _value(self, pane: int) -> int:
        return self.ring.getValue((pane,))[0] if self.ring.containsKey((pane,)) else 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sums: dict[int, int] = {}
        for part in rows:
            for pane, value in part.groupby("pane")["value"].sum().items():
                sums[int(pane)] = sums.get(int(pane), 0) + int(value)
        win, total = self.next.get() if self.next.exists() else (min(sums), 0)
        for pane, value in sums.items():
            self.ring.updateValue((pane,), (self._value(pane) + value,))
            total += value if win - self.panes < pane <= win else 0
        if (first := min(sums)) < win:  # packets before the key's first ones, which come late but not too late
            win, total = first, sum(self._value(p) for p in range(first - self.panes + 1, first + 1))
        self.next.update((win, total))
        self.handle.registerTimer(self._end(win))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.next.exists():
            return
        now, (win, total), out = timerValues.getCurrentWatermarkInMs(), self.next.get(), []
        while self._end(win) <= now:
            if total:
                out.append((win, key[0], total))
            left = win - self.panes + 1
            total -= self._value(left)
            if self.ring.containsKey((left,)):
                self.ring.removeKey((left,))
            ahead = [pane for (pane,) in self.ring.keys()]
            if not ahead:
                self.next.clear()
                self.ring.clear()
                break
            win = max(win + 1, min(ahead))  # a gap as long as a window has no rows
            total += self._value(win)
        else:
            self.next.update((win, total))
            self.handle.registerTimer(self._end(win))
        if out:
            yield pd.DataFrame(out, columns=["win", "key", "value"])

    def close(self) -> None:
        pass


def sliding_sums(packets: DataFrame, key: str, value: str, pane: int, panes: int, origin: int, delay: str = "0 seconds") -> DataFrame:
    """win, key, value of a stream of packets; needs the RocksDB state store.

    The watermark, `delay` behind the newest packet of any key, ends windows. What comes later is dropped by Spark and counted in
    the progress metric numRowsDroppedByWatermark.
    """
    rows = packets.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay).filter(F.col("us") >= origin).select(
        "ts", F.col(key).cast("long").alias("key"), F.expr(f"(us - {origin}) div {pane}L").alias("pane"), F.expr(value).cast("long").alias("value")
    )
    return rows.groupBy("key").transformWithStateInPandas(SlidingSum(pane, panes, origin), _OUT, "append", "EventTime")
