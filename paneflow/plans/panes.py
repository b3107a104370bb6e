"""Windows made of panes.

Time is counted in whole microseconds from the first packet. Pane p covers [p * pane, (p + 1) * pane). A pane is closed
by a packet at or after its end, so the last one never is; `limit` caps the closed panes. A tumbling window is n panes in
a row; a sliding window is named by its last pane w and covers the panes w - n + 1 to w, fewer at the start.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lineage import cut


@dataclass(frozen=True)
class WindowSpec:
    """pane: microseconds; panes of a window; dead: microseconds at a window's start that are not seen; limit: closed panes at most."""

    pane: int = 100_000
    panes: int = 5
    dead: int = 0
    limit: int | None = None

    @property
    def window(self) -> int:
        return self.pane * self.panes

    def whole(self) -> WindowSpec:
        """The same windows as single panes."""
        limit = None if self.limit is None else self.limit // self.panes
        return replace(self, pane=self.window, panes=1, limit=limit)


def clock(packets: DataFrame) -> DataFrame:
    """One row: t0 and t1, the first and the last packet's time."""
    return packets.agg(F.min("us").alias("t0"), F.max("us").alias("t1"))


def with_panes(packets: DataFrame, spec: WindowSpec, timer: DataFrame | None = None) -> DataFrame:
    """packets in closed panes, with `pane` and `closed`, the number of closed panes.

    The clock is over all of the packets, before any filter of a query: pass `timer` where packets are filtered. It is one
    row, the only thing that is broadcast.
    """
    timed = packets.crossJoin(F.broadcast(timer if timer is not None else clock(packets)))
    closed = F.expr(f"(t1 - t0) div {spec.pane}L")
    if spec.limit is not None:
        closed = F.least(closed, F.lit(spec.limit).cast("long"))
    timed = timed.withColumn("pane", F.expr(f"(us - t0) div {spec.pane}L")).withColumn("closed", closed).filter("pane < closed")
    if spec.dead:
        timed = timed.filter(f"(us - t0) % {spec.window}L >= {spec.dead}L")
    return timed.drop("t0", "t1")


def to_windows(panes: DataFrame, spec: WindowSpec, first: str = "pane") -> DataFrame:
    """Each row of a pane once for each sliding window `win` that holds it, from `first` on."""
    last = F.least(F.col("pane") + (spec.panes - 1), F.col("closed") - 1)
    wins = F.sequence(F.col(first), last)
    return panes.filter(F.col(first) <= last).withColumn("win", F.explode(wins))


def first_windows(panes: DataFrame, spec: WindowSpec, of: list[str]) -> DataFrame:
    """Rows of panes with `start`, the first sliding window that an element (the columns `of`) enters with this pane.

    An element that was in one of the panes before is in some of the windows already, and is counted in the rest only: each
    element comes once to each window that it is in, without comparing rows within windows.
    """
    before = F.lag("pane").over(W.partitionBy(*of).orderBy("pane"))
    return panes.withColumn("start", F.greatest(F.col("pane"), F.coalesce(before + spec.panes, F.col("pane"))))


#: What one task follows: so many panes, then so many of the blocks that these make, and so on. Rows that the driver follows at
#: most, and that are broadcast at most.
FAN, FEW = 16, 1 << 18


def _followed(rows: pa.Table, pane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`at` and `last` of rows in order, and for each the place of the row that comes next (behind all rows: none)."""
    at, last = (rows.column(c).to_numpy() for c in ("at", "last"))
    order = np.argsort(at)
    at, last = at[order], last[order]
    return at, last, np.searchsorted(at, last + pane, "right")


def _blocks_ends(rows: pa.Table, pane: int, width: int, t0: int) -> pa.Table:
    """For the rows by which a chain can enter this block, the last start that it then has here; of neighbours that are alike in it, the last one."""
    at, last, follow = _followed(rows, pane)
    n = len(at)
    end = np.where(follow < n, follow, np.arange(n))
    while (further := end[end] != end).any():  # twice as many steps each time
        end = np.where(further, end[end], end)
    begin = t0 + rows.column("block")[0].as_py() * width
    enters = min(n, int(np.searchsorted(at, begin + pane, "left")) + 1)
    ends = last[end[:enters]]
    kept = np.append(ends[1:] != ends[:-1], True)
    return pa.table({"at": at[:enters][kept], "last": ends[kept]})


def _visited(rows: pa.Table, pane: int, after: int) -> pa.Table:
    """The rows of one block that a chain passes whose next start is the first time after `after`; with each, that time again."""
    at, last, follow = _followed(rows, pane)
    places, i = [], int(np.searchsorted(at, after, "right"))
    while i < len(at):
        places.append(i)
        i = int(follow[i])
    afters = np.append(np.int64(after), last[places[:-1]] + pane)
    return pa.table({"at": at[places], "last": last[places], "after": afters})


def drifting_starts(packets: DataFrame, pane: int, t0: int, t1: int, few: int = FEW) -> DataFrame:
    """`start` of each pane under the restart rule, for packets from t0 to t1.

    Each start depends on the one before, but only the times within a pane of a block's begin, and the first one after, can be the
    first start in that block. So the chain is followed from all of these at once, in each block apart, and what is left of a block is
    where they end there. That is repeated on blocks of blocks until few rows are left, which are followed from t0; then
    the blocks that the chain passes are followed again from where it enters them. The times of FAN panes come to one task.
    """
    rows = cut(packets.filter("us IS NOT NULL").select(F.col("us").alias("at")).distinct().withColumn("last", F.col("at")))
    spark, levels, width = packets.sparkSession, [], pane
    block = lambda w: F.expr(f"(at - {t0}L) div {w}L").alias("block")
    ends = lambda w: lambda x: _blocks_ends(x, pane, w, t0)
    while rows.count() > few:
        width *= FAN
        rows = rows.select("at", "last", block(width))
        levels.append((rows, width))
        if width > t1 - t0:  # one block, which the chain enters with the first time
            entered = spark.createDataFrame([(0, t0 - 1)], "block long, after long")
            break
        rows = cut(rows.groupBy("block").applyInArrow(ends(width), "at long, last long"))
    else:
        passed = spark.createDataFrame(_visited(rows.toArrow(), pane, t0 - 1))
        entered = passed.select(block(levels[-1][1]), "after") if levels else None
    for i, (rows, _) in reversed(list(enumerate(levels))):
        passed = rows.join(entered, "block").groupBy("block").applyInArrow(lambda x: _visited(x, pane, x.column("after")[0].as_py()), "at long, last long, after long")
        if i:
            entered = passed.select(block(levels[i - 1][1]), "after")
    return passed.select(F.col("last").alias("start"))


def drifting_panes(packets: DataFrame, pane: int) -> DataFrame:
    """packets with `pane` under the restart rule: the first packet more than `pane` microseconds after a pane's first packet
    starts the next one, so gaps make no empty panes.

    Starts are more than `pane` apart, so a cell of that width, counted from the first packet, has one at most, and a pane's packets
    lie in its start's cell and the next: a packet finds its pane by its cell. Starts, one row a pane, are numbered in one task.
    """
    names = packets.columns
    timer = clock(packets).first()
    if timer["t0"] is None:
        return packets.withColumn("pane", F.lit(0).cast("long")).limit(0)
    cell = f"(%s - {timer['t0']}L) div {pane}L"
    order = W.orderBy("start")
    starts = drifting_starts(packets, pane, timer["t0"], timer["t1"])
    later = F.lead(F.expr(cell % "start")).over(order)
    numbered = starts.select("start", F.expr(cell % "start").alias("cell"), (F.row_number().over(order) - 1).cast("long").alias("pane"), later.alias("later"))
    has = F.when(F.col("later") == F.col("cell") + 1, F.array("cell")).otherwise(F.array("cell", F.col("cell") + 1))
    cells = cut(numbered.select("start", "pane", F.explode(has).alias("cell")))
    if cells.count() <= FEW:
        cells = F.broadcast(cells)
    joined = packets.withColumn("cell", F.expr(cell % "us")).join(cells, "cell")
    return joined.select(*names, F.when(F.col("us") >= F.col("start"), F.col("pane")).otherwise(F.col("pane") - 1).alias("pane"))
