"""Compiles a declared query and a window mechanism to a DataFrame plan.

Mechanisms:
itw  tumbling windows.
tw1  tumbling windows with a dead time at the start of each.
isw  sliding windows, elements counted once in each window.
otw  tumbling windows merged from panes; an element counts in the pane where it first appears in its tumbling window.
osw  sliding windows merged from the panes of otw, so an element counts again when its first pane in a tumbling window slides in.
tw1a, tw2a, otwa, oswa: as a switch of bounded memory counts (`Plane`): a Bloom filter calls elements new, and a Count-Min with a list of the
keys that met a counter at 0 adds up. tw1a and tw2a are tumbling with and without a dead time and have four times the memory of
otwa and oswa, which merge the panes of one filter for each tumbling window and one set of counters for each pane.

Packets are aggregated once a pane, with partial sums before the shuffle, and only pane sums are handed to windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sketches import bloom_first, data_plane_reduce
from .panes import WindowSpec, clock, first_windows, to_windows, with_panes
from .query import TelemetryQuery

MECHANISMS = ("itw", "isw", "tw1", "otw", "osw")
#: Those that count approximately.
PLANE_MECHANISMS = ("tw1a", "tw2a", "otwa", "oswa")


@dataclass(frozen=True)
class Plane:
    """A switch's memory for one pane: bits of a Bloom filter and counters of a Count-Min, in `hashes` rows each."""

    bits: int = 1 << 21
    counters: int = 1 << 16
    hashes: int = 1


def _keyed(packets: DataFrame, query: TelemetryQuery, spec: WindowSpec) -> DataFrame:
    """The packets that count, in panes, with the key, the sums' values and the elements."""
    timed = with_panes(packets.filter(query.where), spec, clock(packets))
    columns = [F.expr(e).alias(k) for k, e in query.key] + [F.expr(e).cast("long").alias(m) for m, e in query.sums]
    return timed.select("pane", "closed", *columns, *(F.col(c).alias(f"element_{c}") for c in query.elements)).na.drop()


def _elements(query: TelemetryQuery) -> list[str]:
    return [f"element_{c}" for c in query.elements]


def _finish(sums: DataFrame, query: TelemetryQuery, win: str) -> DataFrame:
    """Windows' sums that the query reports, as win, key and measures."""
    hits = sums.filter(query.having)
    return hits.select(F.col(win).cast("long").alias("win"), *query.keys, *query.measures)


def _pane_sums(rows: DataFrame, query: TelemetryQuery, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.sum(m).alias(m) for m, _ in query.sums))


def _merged(sums: DataFrame | None, counts: DataFrame | None, query: TelemetryQuery, by: list[str]) -> DataFrame:
    """Sums and counts of the same groups in one, by one more sum."""
    parts = []
    if sums is not None:
        parts.append(sums.select(*by, *(m for m, _ in query.sums), *([F.lit(0).cast("long").alias(query.distinct)] if query.distinct else [])))
    if counts is not None:
        parts.append(counts.select(*by, *(F.lit(0).cast("long").alias(m) for m, _ in query.sums), F.col("n").cast("long").alias(query.distinct)))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy(*by).agg(*(F.sum(m).alias(m) for m in query.measures))


def tumbling(packets: DataFrame, query: TelemetryQuery, spec: WindowSpec) -> DataFrame:
    """itw, or tw1 if spec has a dead time: one aggregation."""
    rows = _keyed(packets, query, spec.whole())
    by = ["pane", *query.keys]
    if not query.elements:
        return _finish(_pane_sums(rows, query, by), query, "pane")
    # two steps, so that an element of a large group is dealt by its own value and not by the group
    each = rows.groupBy(*by, *_elements(query)).agg(F.lit(1).cast("long").alias(query.distinct), *(F.sum(m).alias(m) for m, _ in query.sums))
    return _finish(each.groupBy(*by).agg(*(F.sum(m).alias(m) for m in query.measures)), query, "pane")


def sliding(packets: DataFrame, query: TelemetryQuery, spec: WindowSpec) -> DataFrame:
    """isw."""
    rows = _keyed(packets, query, spec)
    by = ["win", *query.keys]
    sums = counts = None
    if query.sums:
        sums = to_windows(_pane_sums(rows, query, ["pane", "closed", *query.keys]), spec)
    if query.elements:
        panes = rows.select("pane", "closed", *query.keys, *_elements(query)).distinct()
        entered = first_windows(panes, spec, [*query.keys, *_elements(query)])
        counts = to_windows(entered, spec, "start").withColumn("n", F.lit(1).cast("long"))
    return _finish(_merged(sums, counts, query, by), query, "win")


def _first_panes(packets: DataFrame, query: TelemetryQuery, spec: WindowSpec) -> tuple[DataFrame | None, DataFrame | None]:
    """Pane sums, and the number of elements by the pane where they first appear in their tumbling window."""
    rows = _keyed(packets, query, spec)
    by = ["pane", "closed", *query.keys]
    sums = _pane_sums(rows, query, by) if query.sums else None
    counts = None
    if query.elements:
        group = F.expr(f"pane div {spec.panes}L").alias("turn")
        first = rows.groupBy(group, "closed", *query.keys, *_elements(query)).agg(F.min("pane").alias("pane"))
        counts = first.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return sums, counts


def merged_tumbling(packets: DataFrame, query: TelemetryQuery, spec: WindowSpec) -> DataFrame:
    """otw."""
    parts = [x.withColumn("win", F.expr(f"pane div {spec.panes}L")).filter(f"win < closed div {spec.panes}L") if x is not None else None for x in _first_panes(packets, query, spec)]
    return _finish(_merged(*parts, query, ["win", *query.keys]), query, "win")


def merged_sliding(packets: DataFrame, query: TelemetryQuery, spec: WindowSpec) -> DataFrame:
    """osw."""
    parts = [to_windows(x, spec) if x is not None else None for x in _first_panes(packets, query, spec)]
    return _finish(_merged(*parts, query, ["win", *query.keys]), query, "win")


def _plane_sums(packets: DataFrame, query: TelemetryQuery, spec: WindowSpec, plane: Plane, times: int) -> DataFrame:
    """pane, closed, key and measures as a switch with `times` the memory of `plane` reports them; each measure is a reduce of its own."""
    keys, names = query.keys, query.measures
    timed = with_panes(packets.filter(query.where), spec, clock(packets))
    columns = [F.expr(e).alias(k) for k, e in query.key] + [F.expr(e).cast("long").alias(m) for m, e in query.sums]
    turn = F.expr(f"pane div {spec.panes}L").alias("turn")
    rows = timed.select("pane", "closed", turn, "us", "seq", *columns, *(F.col(c).alias(f"element_{c}") for c in query.elements)).na.drop()
    out = None
    for m in names:
        if m == query.distinct:
            counted = bloom_first(rows, [*keys, *_elements(query)], plane.hashes, times * plane.bits, ["turn"]).withColumn("counted", F.lit(1).cast("long"))
        else:
            counted = rows.filter(F.col(m) != 0).withColumn("counted", F.col(m))
        est = data_plane_reduce(counted, keys, "counted", plane.hashes, times * plane.counters // plane.hashes, ["pane", "closed"])
        part = est.select("pane", "closed", *keys, *(F.col("est").alias(x) if x == m else F.lit(0).cast("long").alias(x) for x in names))
        out = part if out is None else out.unionByName(part)
    return out


def as_a_switch(packets: DataFrame, query: TelemetryQuery, spec: WindowSpec, mechanism: str, plane: Plane) -> DataFrame:
    """tw1a, tw2a, otwa or oswa."""
    if mechanism in ("tw1a", "tw2a"):
        spec = spec if mechanism == "tw1a" else WindowSpec(spec.pane, spec.panes, 0, spec.limit)
        rows = _plane_sums(packets, query, spec.whole(), plane, 4).withColumnRenamed("pane", "win")
    else:
        rows = _plane_sums(packets, query, WindowSpec(spec.pane, spec.panes, 0, spec.limit), plane, 1)
        rows = to_windows(rows, spec) if mechanism == "oswa" else rows.withColumn("win", F.expr(f"pane div {spec.panes}L")).filter(f"win < closed div {spec.panes}L")
    return _finish(rows.groupBy("win", *query.keys).agg(*(F.sum(m).alias(m) for m in query.measures)), query, "win")


def run(packets: DataFrame, query: TelemetryQuery, spec: WindowSpec, mechanism: str = "isw", plane: Plane = Plane()) -> DataFrame:
    """The windows and keys that the query reports, with their measures: win, key columns, measures.

    Only `tw1` and `tw1a` heed the spec's dead time.
    """
    if mechanism in PLANE_MECHANISMS:
        return as_a_switch(packets, query, spec, mechanism, plane)
    seen = spec if mechanism == "tw1" else WindowSpec(spec.pane, spec.panes, 0, spec.limit)
    plans = {"itw": tumbling, "tw1": tumbling, "isw": sliding, "otw": merged_tumbling, "osw": merged_sliding}
    if mechanism not in plans:
        raise ValueError(f"no such mechanism: {mechanism}; there are {', '.join((*plans, *PLANE_MECHANISMS))}")
    return plans[mechanism](packets, query, seen)


def hits(result: DataFrame, query: TelemetryQuery) -> DataFrame:
    """The set form of a result: a window and what it reports."""
    return result.select("win", *(query.output or query.keys)).distinct()
