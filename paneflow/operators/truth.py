"""Exact ground truth over complete sliding windows, and operators on sets of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import run
from ..plans.panes import WindowSpec
from ..plans.query import TelemetryQuery

FLOW = ("src_ip", "dst_ip", "src_port", "dst_port", "proto")


def _complete(df: DataFrame, spec: WindowSpec) -> DataFrame:
    """Without the partial windows at the start."""
    return df.filter(F.col("win") >= spec.panes - 1)


def flow_sizes(packets: DataFrame, spec: WindowSpec) -> DataFrame:
    """Bytes of each flow in each complete sliding window."""
    query = TelemetryQuery("flow_sizes", "true", tuple((c, c) for c in FLOW), "true", sums=(("bytes", "size"),))
    return _complete(run(packets, query, spec, "isw"), spec)


def heavy_hitters(packets: DataFrame, spec: WindowSpec, threshold: int = 100, aligned: bool = False) -> DataFrame:
    """Flows with more bytes than the threshold in any complete window; aligned: in any that is a tumbling window."""
    sizes = flow_sizes(packets, spec).filter(F.col("bytes") > threshold)
    if aligned:
        sizes = sizes.filter((F.col("win") + 1) % spec.panes == 0)
    return sizes.select(*FLOW).distinct()


def superspreaders(packets: DataFrame, spec: WindowSpec, threshold: int = 10, aligned: bool = False) -> DataFrame:
    """Sources with more distinct destinations than the threshold in any complete window."""
    query = TelemetryQuery("spread", "true", (("src_ip", "src_ip"),), f"dsts > {threshold}", elements=("dst_ip",), distinct="dsts")
    found = _complete(run(packets, query, spec, "isw"), spec)
    if aligned:
        found = found.filter((F.col("win") + 1) % spec.panes == 0)
    return found.select("src_ip").distinct()


def cardinalities(packets: DataFrame, spec: WindowSpec) -> DataFrame:
    """Flows in each complete window."""
    return flow_sizes(packets, spec).groupBy("win").agg(F.count(F.lit(1)).alias("flows"))


def collapse(result: DataFrame, keys: list[str], start: int = 0, width: int = 1, stride: int = 1) -> DataFrame:
    """Unions of windows: step i holds what the windows start + i * stride to start + i * stride + width - 1 report."""
    at = F.col("win") - start
    first = F.greatest(F.lit(0), F.expr(f"(win - {start} - {width - 1} + {stride - 1}) div {stride}"))
    last = F.floor(at / stride).cast("long")
    steps = result.filter(at >= 0).withColumn("first", first.cast("long")).withColumn("last", last).filter("first <= last")
    return steps.withColumn("step", F.explode(F.sequence("first", "last"))).select("step", *keys).distinct()


def hot_keys(packets: DataFrame, keys: list[str], m: int) -> DataFrame:
    """The m keys with the most packets; ties go to the smaller key. Spark keeps m rows a task."""
    return packets.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets")).orderBy(F.desc("packets"), *keys).limit(m)


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str]) -> DataFrame:
    """The value at index floor(n * share) of the sorted values of each group, without interpolation.

    Values are counted first, so a group is as large as its distinct values.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    order = W.partitionBy(*by).orderBy(value)
    whole = W.partitionBy(*by)
    ranked = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(whole))
    at = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    asked = ranked.select("*", at).withColumn("index", F.least(F.floor(F.col("total") * F.col("share")), F.col("total") - 1))
    return asked.filter((F.col("upto") > F.col("index")) & (F.col("upto") - F.col("n") <= F.col("index"))).select(*by, "share", F.col(value).alias("value"))


def lost_packets(sent: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of sent that received lacks."""
    return sent.join(received.select(*keys), keys, "left_anti")


def pinned(counts: DataFrame, hot: DataFrame, keys: list[str], measures: list[str], windows: DataFrame | None = None) -> DataFrame:
    """counts with a row for every hot key, at 0 where it has none; in each of windows, if given, by its columns."""
    by = windows.columns if windows is not None else []
    rows = hot.select(*keys).distinct()
    if windows is not None:
        rows = windows.distinct().crossJoin(rows)
    full = counts.join(rows, [*by, *keys], "full")
    return full.select(*by, *keys, *(F.coalesce(m, F.lit(0)).alias(m) for m in measures))
