"""Sketches whose state depends on the order of the packets: each window's packets pass in order through one Arrow group.

They scale with the windows, not within one, and hold a fixed number of counters; groups come sorted and are read once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fold, numpy_position


class Ordered:
    """insert(key, value, positions) for each packet; query(key, positions) after the last. STATE: arrays, and what an empty cell holds."""

    STATE: dict[str, int] = {}
    joined: Callable = min

    def parts(self, key: int, at: list[int]) -> list[int]:
        """What each row says of a key; `joined` is the estimate."""
        raise NotImplementedError

    def query(self, key: int, at: list[int]) -> int:
        return int(type(self).joined(self.parts(key, at)))

    def __init__(self, depth: int, width: int):
        self.depth, self.width = depth, width


class ConservativeUpdate(Ordered):
    """Counters rise no further than the key's least counter plus the value."""

    STATE = {"cells": 0}

    def __init__(self, depth: int, width: int):
        super().__init__(depth, width)
        self.cells = np.zeros((depth, width), np.int64)

    def insert(self, key: int, value: int, at: list[int]) -> None:
        new = min(self.cells[i, p] for i, p in enumerate(at)) + value
        for i, p in enumerate(at):
            self.cells[i, p] = max(self.cells[i, p], new)

    def parts(self, key: int, at: list[int]) -> list[int]:
        return [self.cells[i, p] for i, p in enumerate(at)]


class SuMax(ConservativeUpdate):
    """From row to row, a counter rises to at most the least that the rows before have risen to."""

    def insert(self, key: int, value: int, at: list[int]) -> None:
        least = None
        for i, p in enumerate(at):
            raised = self.cells[i, p] + value
            if least is None or raised < least:
                self.cells[i, p] = least = raised
            elif self.cells[i, p] < least:
                self.cells[i, p] = least


class MajorityVote(Ordered):
    """MV: each bucket has a total, and a candidate that holds it by majority vote."""

    STATE = {"total": 0, "votes": 0, "holder": -1}

    def __init__(self, depth: int, width: int):
        super().__init__(depth, width)
        self.total = np.zeros((depth, width), np.int64)
        self.votes = np.zeros((depth, width), np.int64)
        self.holder = np.full((depth, width), -1, np.int64)

    def insert(self, key: int, value: int, at: list[int]) -> None:
        for i, p in enumerate(at):
            self.total[i, p] += value
            if self.holder[i, p] == key:
                self.votes[i, p] += value
            else:
                self.votes[i, p] -= value
                if self.votes[i, p] < 0:
                    self.holder[i, p] = key
                    self.votes[i, p] *= -1

    def parts(self, key: int, at: list[int]) -> list[int]:
        return [(self.total[i, p] + (1 if self.holder[i, p] == key else -1) * self.votes[i, p]) // 2 for i, p in enumerate(at)]

    def candidates(self) -> set[int]:
        return set(self.holder[self.holder >= 0].tolist())


class HashPipe(Ordered):
    """The first stage always takes the newcomer; later stages keep the larger count and pass the smaller on."""

    STATE = {"holder": -1, "count": 0}
    joined = sum

    def __init__(self, depth: int, width: int):
        super().__init__(depth, width)
        self.holder = np.full((depth, width), -1, np.int64)
        self.count = np.zeros((depth, width), np.int64)

    def insert(self, key: int, value: int, at: list[int]) -> None:
        for i in range(self.depth):
            p = at[i]
            if self.holder[i, p] in (-1, key):
                self.count[i, p] = value if self.holder[i, p] == -1 else self.count[i, p] + value
                self.holder[i, p] = key
                return
            if i == 0 or self.count[i, p] < value:
                self.holder[i, p], key = key, int(self.holder[i, p])
                self.count[i, p], value = value, int(self.count[i, p])
                at = self.places(key)

    def places(self, key: int) -> list[int]:
        one = np.array([key])
        return [int(numpy_position(one, i, self.width)[0]) for i in range(self.depth)]

    def parts(self, key: int, at: list[int]) -> list[int]:
        return [self.count[i, p] if self.holder[i, p] == key else 0 for i, p in enumerate(at)]

    def candidates(self) -> set[int]:
        return set(self.holder[self.holder >= 0].tolist())


KINDS: dict[str, Callable[[int, int], Ordered]] = {"cu": ConservativeUpdate, "sumax": SuMax, "mv": MajorityVote, "hashpipe": HashPipe}


def ordered_estimates(packets: DataFrame, kind: str, keys: list[str], value: str, window: str = "win", depth: int = 4, width: int = 1021, threshold: int | None = None) -> DataFrame:
    """window, keys, est, exact for the keys of each window; with a threshold those that the sketch itself lists above it.

    packets need us, seq and `window`. Keys are told apart by their fold, a hash below 2**31.
    """
    make = KINDS[kind]
    columns = [window, *keys, "us", "seq", value]
    rows = packets.select(*columns, fold(*keys).alias("folded"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (window, *keys)), "est long, exact long"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["us", "seq"], kind="stable")
        folded = part["folded"].to_numpy()
        at = np.stack([numpy_position(folded, i, width) for i in range(depth)], 1).tolist()
        sketch = make(depth, width)
        for key, v, p in zip(folded.tolist(), part[value].tolist(), at):
            sketch.insert(key, v, p)
        exact = part.groupby([window, *keys, "folded"], as_index=False)[value].sum().rename(columns={value: "exact"})
        places = np.stack([numpy_position(exact["folded"].to_numpy(), i, width) for i in range(depth)], 1).tolist()
        exact["est"] = [sketch.query(k, p) for k, p in zip(exact["folded"].tolist(), places)]
        if threshold is not None:
            listed = sketch.candidates() if hasattr(sketch, "candidates") else set(exact["folded"].tolist())
            exact = exact[exact["folded"].isin(listed) & (exact["est"] > threshold)]
        return exact[[window, *keys, "est", "exact"]]

    return rows.groupBy(window).applyInPandas(run, schema)


def exact_hitters(packets: DataFrame, keys: list[str], value: str, window: str = "win", threshold: int = 0) -> DataFrame:
    return packets.groupBy(window, *keys).agg(F.sum(value).alias("exact")).filter(F.col("exact") > threshold)


class Rotating:
    """A new and an old copy of a sketch; with each pane a share of 1 / panes of the cells is aged, as sketches.rotate says."""

    def __init__(self, kind: str, depth: int, width: int, panes: int):
        self.new, self.old, self.panes = KINDS[kind](depth, width), KINDS[kind](depth, width), panes
        self.turn = np.arange(width) * panes // width

    def age(self, pane: int) -> None:
        part = self.turn == pane % self.panes
        for name, empty in self.new.STATE.items():
            new = getattr(self.new, name)
            getattr(self.old, name)[:, part] = new[:, part]
            new[:, part] = empty

    def query(self, key: int, at: list[int]) -> int:
        return int(type(self.new).joined(a + b for a, b in zip(self.new.parts(key, at), self.old.parts(key, at))))

    def candidates(self) -> set[int]:
        return self.new.candidates() | self.old.candidates()


def _replayed(kind: str, keys: list[str], value: str, panes: int, depth: int, width: int, threshold: int | None, block: int, ordered: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of each block of rows that come sorted by block, us, seq; what is held is a sketch and the keys of a block, which a
    pipe may still pass on."""
    at_block = sketch = None
    pane = until = 0
    names: dict[int, tuple] = {}

    def close(upto: int) -> Iterator[pd.DataFrame]:
        """Ends the panes from the present one to the one before upto."""
        nonlocal pane, names
        for pane in range(pane, upto):
            sketch.age(pane)
            names = {k: x for k, x in names.items() if x[0] > pane - block}
            if pane < max(at_block * block, panes - 1):
                continue
            if threshold is None:
                asked = [k for k, x in names.items() if x[0] > pane - panes]
            else:
                asked = sorted(sketch.candidates() & names.keys())
            if not asked:
                continue
            places = np.stack([numpy_position(np.array(asked), i, width) for i in range(depth)], 1).tolist()
            found = [(pane, *names[k][1], sketch.query(k, p)) for k, p in zip(asked, places)]
            yield pd.DataFrame([x for x in found if threshold is None or x[-1] > threshold], columns=["win", *keys, "est"])
        pane = upto

    for part in ordered:
        folded = part["folded"].to_numpy()
        at = np.stack([numpy_position(folded, i, width) for i in range(depth)], 1).tolist()
        columns = (part[c].tolist() for c in ("block", "pane", "closed", "folded", value))
        for b, now, closed, key, v, p, name in zip(*columns, at, zip(*(part[c].tolist() for c in keys))):
            if b != at_block:
                if at_block is not None:
                    yield from close(until)
                at_block, sketch, pane, names, until = b, Rotating(kind, depth, width, panes), now, {}, min((b + 1) * block, closed)
            if now > pane:
                yield from close(now)
            sketch.new.insert(key, v, p)
            names[key] = (now, name)
    if at_block is not None:
        yield from close(until)


def sliding_estimates(packets: DataFrame, kind: str, keys: list[str], value: str, panes: int, depth: int = 4, width: int = 1021, threshold: int | None = None) -> DataFrame:
    """win, keys, est of a sliding sketch, for the keys of each complete window; with a threshold those that it lists above it.

    packets need us, seq, pane and closed. Rows of a sketch get values from the rows before only, and every cell is empty again
    after at most `panes` panes, so (depth + 1) * panes panes decide a window: blocks of that many windows are worked out apart,
    each from as many panes before it, and a packet goes to two blocks. That holds for sumax, mv and hashpipe; conservative
    updates look at all rows and never forget.
    """
    if kind not in ("sumax", "mv", "hashpipe"):
        raise ValueError(f"no sliding form of {kind}")
    block = (depth + 1) * panes
    last = F.least(F.expr(f"pane div {block}") + 1, F.expr(f"(closed - 1) div {block}"))
    rows = packets.select("pane", "closed", "us", "seq", *keys, value, fold(*keys).alias("folded"), F.explode(F.sequence(F.expr(f"pane div {block}"), last)).alias("block"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["win long", *(f"{c} {kinds[c]}" for c in keys), "est long"])
    rows = rows.repartition("block").sortWithinPartitions("block", "us", "seq")
    return rows.mapInPandas(partial(_replayed, kind, keys, value, panes, depth, width, threshold, block), schema)
