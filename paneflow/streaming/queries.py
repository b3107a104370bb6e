"""The declared queries on streams of packets, in append mode: a window is reported once its last pane is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.panes import WindowSpec
from ..plans.query import TelemetryQuery


def _duration(us: int) -> str:
    return f"{us} microseconds"


def run(packets: DataFrame, query: TelemetryQuery, spec: WindowSpec, origin: int, mechanism: str = "isw", delay: str = "0 seconds") -> DataFrame:
    """win, key and measures as the batch plan gives them, for `itw`, `tw1` or `isw`.

    packets is a stream with the packet columns. A stream doesn't know its first packet, so `origin` (microseconds) is where
    pane 0 starts. The watermark closes panes; packets later than `delay` are dropped by Spark and counted in the progress metric
    numRowsDroppedByWatermark. All packets, also those that the query leaves out, move the watermark on.

    Packets are aggregated by pane first; pane sums go on to the windows with the pane's end as event time, so the state holds
    pane and window sums and no packets.
    """
    if mechanism not in ("itw", "tw1", "isw"):
        raise ValueError(f"no streaming plan for {mechanism}")
    panes = (spec.pane, spec.panes) if mechanism == "isw" else (spec.window, 1)
    spec = WindowSpec(*panes, dead=spec.dead if mechanism == "tw1" else 0)
    timed = packets.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay)
    rows = timed.filter(query.where).filter(F.col("us") >= origin)
    if spec.dead:
        rows = rows.filter(f"(us - {origin}) % {spec.pane} >= {spec.dead}")
    start = _duration(origin % spec.pane)
    sums = [F.expr(e).cast("long").alias(m) for m, e in query.sums]
    keyed = rows.select("ts", *(F.expr(e).alias(k) for k, e in query.key), *sums, *(F.col(c).alias(f"element_{c}") for c in query.elements))
    elements = [f"element_{c}" for c in query.elements]
    adding = [F.sum(m).alias(m) for m, _ in query.sums]
    pane = F.window("ts", _duration(spec.pane), startTime=start)
    group = [*query.keys, *elements]
    out = keyed.groupBy(pane, *group).agg(*(adding or [F.count(F.lit(1)).alias("seen")]))
    if spec.panes > 1:
        out = out.withColumn("ts", F.window_time("window")).drop("window")
        step = F.window("ts", _duration(spec.window), _duration(spec.pane), start)
        out = out.groupBy(step, *group).agg(*(adding or [F.count(F.lit(1)).alias("seen")]))
    if elements:
        out = out.groupBy("window", *query.keys).agg(*adding, F.count(F.lit(1)).alias(query.distinct))
    end = F.unix_micros(F.col("window.end"))
    win = F.floor((end - origin) / spec.pane).cast("long") - 1
    return out.filter(query.having).select(win.alias("win"), *query.keys, *query.measures)
