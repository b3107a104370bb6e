"""Every query by name, on the packet view over `events`: panes of 6 hours, windows of 30."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import metrics, ordered, sketches, truth
from .operators.lineage import cut
from .plans import compile as plans
from .plans import query as library
from .plans.panes import WindowSpec, drifting_panes, to_windows, with_panes
from .sources.packets import event_packets

HOUR = 3_600_000_000
SPEC = WindowSpec(pane=6 * HOUR, panes=5, dead=6 * HOUR * 5 // 25)
#: The eight queries with thresholds for the packet view.
QUERIES = {
    q.name: q
    for q in (
        library.new_tcp_connections(6), library.ssh_brute(3), library.superspreader(6), library.port_scan(5), library.ddos(25),
        library.syn_flood(4), library.completed_flow(2), library.slowloris(500, 0.0234),
    )
}
SHAPE = sketches.MultiResolution()
DEPTH, WIDTH = 4, 1021
PAIR = ["src_ip", "dst_ip"]
FLOW = list(truth.FLOW)
PLAIN = WindowSpec(SPEC.pane, SPEC.panes)
#: Microseconds that a packet takes to the far end, so that the last ones of a pane come too late.
LATE = HOUR // 20
#: A switch's memory that makes some elements and keys of the packet view collide.
PLANE = plans.Plane(bits=2048, counters=128)


def _mechanism(name: str, mechanism: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.run(event_packets(spark, sf_dir), QUERIES[name], SPEC, mechanism, PLANE)


def _panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_panes(event_packets(spark, sf_dir), PLAIN)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets in closed tumbling windows, as `win`."""
    return with_panes(event_packets(spark, sf_dir), PLAIN.whole()).withColumnRenamed("pane", "win").drop("closed")


def flow_size_isw(spark, sf_dir):
    return truth.flow_sizes(event_packets(spark, sf_dir), PLAIN).withColumn("proto", F.col("proto").cast("int"))


def heavy_hitters(aligned, spark, sf_dir):
    return truth.heavy_hitters(event_packets(spark, sf_dir), PLAIN, 45, aligned)


def superspreaders(aligned, spark, sf_dir):
    return truth.superspreaders(event_packets(spark, sf_dir), PLAIN, 5, aligned)


def cardinality_isw(spark, sf_dir):
    return truth.cardinalities(event_packets(spark, sf_dir), PLAIN)


def pr_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of every mechanism against exact sliding windows, all windows in one set for each query."""
    packets = event_packets(spark, sf_dir)
    rows = None
    for name, q in QUERIES.items():
        key = (q.output or q.keys)[0]
        parts = {m: plans.run(packets, q, SPEC, m).select(F.lit(m).alias("mechanism"), F.col(key).cast("long").alias("key")) for m in plans.MECHANISMS}
        real = parts.pop("isw").select("key").distinct()
        found = None
        for p in parts.values():
            found = p if found is None else found.unionByName(p)
        marked = found.distinct().join(real.withColumn("hit", F.lit(1)), "key", "left")
        tp = marked.groupBy("mechanism").agg(F.count("hit").alias("tp"), F.count(F.lit(1)).alias("found"))
        report = tp.crossJoin(real.agg(F.count(F.lit(1)).alias("real")))  # one row
        report = report.select(F.lit(name).alias("query"), "mechanism", "tp", "found", "real")
        rows = report if rows is None else rows.unionByName(report)
    share = lambda a, b: F.round(F.coalesce(F.col(a).cast("double") / F.nullif(F.col(b), F.lit(0)), F.lit(1.0)), 9)
    return rows.select("query", "mechanism", share("tp", "found").alias("precision"), share("tp", "real").alias("recall"))


def pr_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and f1 by window of merged against exact sliding windows, for ddos."""
    packets, q = event_packets(spark, sf_dir), QUERIES["ddos"]
    out = metrics.precision_recall(plans.run(packets, q, SPEC, "osw"), plans.run(packets, q, SPEC, "isw"), ["dst_ip"], ["win"])
    return out.select("win", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def _sets(packets: DataFrame, mechanisms: tuple[str, ...]) -> DataFrame:
    """query, mechanism, key: what each query reports by each mechanism in any window."""
    out = None
    for name, q in QUERIES.items():
        key = (q.output or q.keys)[0]
        for m in mechanisms:
            part = plans.run(packets, q, SPEC, m, PLANE).select(F.lit(name).alias("query"), F.lit(m).alias("mechanism"), F.col(key).cast("long").alias("key"))
            out = part if out is None else out.unionByName(part)
    return out.distinct()


def pr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of what a switch finds against exact sliding windows: a row for each query, a column for each mechanism."""
    sets = cut(_sets(event_packets(spark, sf_dir), (*plans.PLANE_MECHANISMS, "itw", "isw")))
    real = sets.filter("mechanism = 'isw'").select("query", "key", F.lit(1).alias("hit"))
    found = sets.filter("mechanism <> 'isw'").join(real, ["query", "key"], "left").groupBy("query", "mechanism").agg(F.count("hit").alias("tp"), F.count(F.lit(1)).alias("found"))
    rows = found.join(real.groupBy("query").agg(F.count(F.lit(1)).alias("real")), "query")
    rows = rows.select("query", "mechanism", (F.col("tp") / F.col("found")).alias("precision"), (F.col("tp") / F.col("real")).alias("recall"))
    return metrics.pivoted(rows, "query", "mechanism", [*plans.PLANE_MECHANISMS, "itw"], ["precision", "recall"])


def pr_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all windows of precision and recall by window, for ddos, of merged sliding windows as a switch counts them and exactly."""
    packets, q = event_packets(spark, sf_dir), QUERIES["ddos"]
    real, out = plans.run(packets, q, SPEC, "isw"), None
    for m in ("osw", "oswa"):
        by_window = metrics.precision_recall(plans.run(packets, q, SPEC, m, PLANE), real, ["dst_ip"], ["win"])
        part = by_window.agg(F.round(F.avg("precision"), 9).alias("precision"), F.round(F.avg("recall"), 9).alias("recall")).select(F.lit(m).alias("mechanism"), "precision", "recall")
        out = part if out is None else out.unionByName(part)
    return out


def ideal_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of what complete sliding windows find that exact tumbling windows find as well."""
    out = None
    for name, f in (("heavy_hitters", heavy_hitters), ("superspreaders", superspreaders)):
        every, some = (f(aligned, spark, sf_dir).agg(F.count(F.lit(1)).alias("n")) for aligned in (False, True))
        part = every.withColumnRenamed("n", "every").crossJoin(some)  # one row each
        part = part.select(F.lit(name).alias("measure"), F.round(F.coalesce(F.col("n") / F.nullif("every", F.lit(0)), F.lit(1.0)), 9).alias("recall"))
        out = part if out is None else out.unionByName(part)
    return out


def restricted_tp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of merged tumbling windows, for superspreader: those that tumbling windows can find, those that nothing finds, and those missed."""
    packets, q = event_packets(spark, sf_dir), QUERIES["superspreader"]
    found, real, tumbling = (plans.run(packets, q, SPEC, m, PLANE) for m in ("oswa", "isw", "itw"))
    return metrics.restricted_confusion(found, real, tumbling, ["src_ip"])


def relative_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative error of Count-Min for each pair of addresses, at a width that makes pairs collide."""
    rows = event_packets(spark, sf_dir)
    exact = rows.groupBy(*PAIR).agg(F.sum("size").alias("exact"))
    est = sketches.count_min_query(sketches.count_min(rows, PAIR, "size", 2, 61), exact, PAIR, 2, 61)
    return est.join(exact, PAIR).select(*PAIR, F.round(metrics.relative_error("est", "exact"), 9).alias("error"))


def spread_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreaders of each complete window: candidates of a spread sketch for each pane, above 1 in the pane, summed over panes, and above 4."""
    rows = _panes(spark, sf_dir)
    by = ["pane", "closed"]
    bits, candidates = sketches.spread_sketch(rows, "src_ip", "dst_ip", DEPTH, 257, SHAPE, by)
    est = sketches.spread_query(bits, candidates, "src_ip", DEPTH, 257, SHAPE, by, 1)
    return to_windows(est, PLAIN).groupBy("win", "src_ip").agg(F.sum("est").alias("est")).filter(f"est > 4 AND win >= {PLAIN.panes - 1}")


def collapse_stride(spark, sf_dir):
    result = _mechanism("new_tcp_connections", "isw", spark, sf_dir)
    return truth.collapse(result, ["dst_ip"], start=4, width=5, stride=3)


def topk_hotkeys(spark, sf_dir):
    return truth.hot_keys(event_packets(spark, sf_dir), ["src_ip", "dst_port"], 25)


def pinned_hotkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of each closed window by source and port, with a row for every hot key in every window, empty ones too."""
    keys = ["src_ip", "dst_port"]
    hot = truth.hot_keys(event_packets(spark, sf_dir), keys, 25)
    rows = with_panes(event_packets(spark, sf_dir), PLAIN.whole()).withColumnRenamed("pane", "win")
    windows = rows.agg(F.max("closed").alias("closed")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("closed") - 1)).alias("win"))
    counts = rows.groupBy("win", *keys).agg(F.count(F.lit(1)).alias("packets"))
    return truth.pinned(counts, hot, keys, ["packets"], windows)


def quantile_vals(spark, sf_dir):
    sums = _windows(spark, sf_dir).groupBy("win", "src_ip").agg(F.sum("size").alias("bytes"))
    return truth.quantiles(sums, "bytes", [0.5, 0.9, 0.99], ["win"])


def cm_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_packets(spark, sf_dir)
    exact = rows.groupBy(*PAIR).agg(F.sum("size").alias("exact"))
    est = sketches.count_min_query(sketches.count_min(rows, PAIR, "size", DEPTH, WIDTH), exact, PAIR, DEPTH, WIDTH)
    return est.join(exact, PAIR)


def cm_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each pair in each complete window: a Count-Min for each pane, the estimates summed over the panes that track the pair."""
    rows = _panes(spark, sf_dir)
    tracked = rows.select("pane", "closed", *PAIR).distinct()
    counters = sketches.count_min(rows, PAIR, "size", DEPTH, WIDTH, ["pane"])
    est = sketches.count_min_query(counters, tracked, PAIR, DEPTH, WIDTH, ["pane"]).join(tracked.select("pane", "closed").distinct(), "pane")
    return to_windows(est, PLAIN).groupBy("win", *PAIR).agg(F.sum("est").alias("est")).filter(F.col("win") >= PLAIN.panes - 1)


def hh_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy pairs of each complete window: estimates over 20 in a pane, summed, and over 100."""
    rows = _panes(spark, sf_dir)
    tracked = rows.select("pane", "closed", *PAIR).distinct()
    est = sketches.count_min_query(sketches.count_min(rows, PAIR, "size", DEPTH, WIDTH, ["pane"]), tracked, PAIR, DEPTH, WIDTH, ["pane"]).filter("est > 20")
    est = est.join(tracked.select("pane", "closed").distinct(), "pane")
    return to_windows(est, PLAIN).groupBy("win", *PAIR).agg(F.sum("est").alias("est")).filter(f"est > 100 AND win >= {PLAIN.panes - 1}")


def bloom_distinct(hashes, spark, sf_dir):
    rows = _windows(spark, sf_dir)
    new = sketches.bloom_first(rows, PAIR, hashes, 1024 * hashes, ["win"])
    return new.groupBy("win", "dst_ip").agg(F.count(F.lit(1)).alias("srcs"))


def data_plane_ddos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ddos as a switch counts it: a Bloom filter for distinct pairs, then Count-Min with a key list, in tumbling windows."""
    new = sketches.bloom_first(_windows(spark, sf_dir), PAIR, 2, 4096, ["win"]).withColumn("one", F.lit(1).cast("long"))
    return sketches.data_plane_reduce(new, ["dst_ip"], "one", 2, 17, ["win"])


def lc_card(spark, sf_dir):
    width = 65_537
    bits = sketches.linear_bits(_panes(spark, sf_dir), FLOW, width, ["pane", "closed"])
    return _sliding_union(bits, ["pos"], lambda b: sketches.linear_estimate(b, width, ["win"]))


def _sliding_union(bits, columns, estimate):
    wins = to_windows(bits, PLAIN).filter(F.col("win") >= PLAIN.panes - 1)
    return estimate(wins.select("win", *columns).distinct())


def hll_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = 4_099
    regs = to_windows(sketches.registers(_panes(spark, sf_dir), FLOW, width, ["pane", "closed"]), PLAIN).filter(F.col("win") >= PLAIN.panes - 1)
    merged = regs.groupBy("win", "pos").agg(F.max("rank").alias("rank"))
    return sketches.hyperloglog_estimate(merged, width, ["win"])


def mrb_card(spark, sf_dir):
    bits = sketches.resolution_bits(_panes(spark, sf_dir), FLOW, SHAPE, ["pane", "closed"])
    return _sliding_union(bits, ["level", "bit"], lambda b: sketches.resolution_estimate(b, SHAPE, ["win"]))


def vbf_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _windows(spark, sf_dir)
    bits = sketches.vector_bits(rows, "src_ip", "dst_ip", 1024, 257, ["win"])
    return sketches.vector_query(bits, rows, "src_ip", 1024, 257, ["win"], 3)


def spread_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits, candidates = sketches.spread_sketch(_windows(spark, sf_dir), "src_ip", "dst_ip", DEPTH, 257, SHAPE, ["win"])
    return sketches.spread_query(bits, candidates, "src_ip", DEPTH, 257, SHAPE, ["win"], 3)


def loss_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = event_packets(spark, sf_dir)
    return truth.lost_packets(sent, sent.filter("seq % 97 <> 0"), ["seq"]).select("seq", *FLOW)


def ibf_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = event_packets(spark, sf_dir)
    size = 12_288
    return sketches.subtract(sketches.digest(sent, "seq", size, 4), sketches.digest(sent.filter("seq % 97 <> 0"), "seq", size, 4))


def ibf_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lost packets, decoded from digests of both ends that are as large as the loss asks for."""
    sent = event_packets(spark, sf_dir)
    return sketches.lost_ids(sent, sent.filter("seq % 97 <> 0"), "seq", 12_288, 4)


def lookup_vs_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways to collect the same counts: by each key, from the whole sketch, and for the keys that one pane tracked."""
    rows = event_packets(spark, sf_dir)
    sketch = sketches.count_min(rows, ["dst_ip"], "size", DEPTH, WIDTH)
    keys = rows.select("dst_ip").distinct()
    lookup = sketches.count_min_query(sketch, keys, ["dst_ip"], DEPTH, WIDTH)
    dump = rows.select("dst_ip").distinct().join(lookup, "dst_ip", "left_semi")
    dump = sketches.count_min_query(sketch.hint("merge"), dump, ["dst_ip"], DEPTH, WIDTH)
    tracked = sketches.first_keys(rows, ["dst_ip"], DEPTH, WIDTH, [])
    merged = sketches.count_min_query(sketch, tracked, ["dst_ip"], DEPTH, WIDTH)
    out = None
    for name, part in (("lookup", lookup), ("dump", dump), ("candidates", merged)):
        part = part.select(F.lit(name).alias("plan"), "dst_ip", "est")
        out = part if out is None else out.unionByName(part)
    return out


def sliding_cm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panes(spark, sf_dir)
    return sketches.rotating_counters(rows, ["dst_ip"], "size", 2, 257, PLAIN.panes)


def sliding_lc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows by linear counting in a sliding sketch."""
    width = 65_537
    bits = sketches.linear_bits(_panes(spark, sf_dir), FLOW, width, ["pane", "closed"])
    held = sketches.rotate(bits, f"pos * {PLAIN.panes} div {width}", PLAIN.panes).filter(f"win >= {PLAIN.panes - 1}")
    return sketches.linear_estimate(held.select("win", "pos").distinct(), width, ["win"])


def sliding_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows by HyperLogLog in a sliding sketch."""
    width = 4_099
    regs = sketches.registers(_panes(spark, sf_dir), FLOW, width, ["pane", "closed"])
    held = sketches.rotate(regs, f"pos * {PLAIN.panes} div {width}", PLAIN.panes).filter(f"win >= {PLAIN.panes - 1}")
    return sketches.hyperloglog_estimate(held.groupBy("win", "pos").agg(F.max("rank").alias("rank")), width, ["win"])


def sliding_vbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreaders by a vector Bloom filter in a sliding sketch, aged row after row, for the sources of the window."""
    rows, height = _panes(spark, sf_dir), 1024
    bits = sketches.vector_bits(rows, "src_ip", "dst_ip", height, 257, ["pane", "closed"])
    held = sketches.rotate(bits, f"(array * {height} + row) * {PLAIN.panes} div {5 * height}", PLAIN.panes).filter(f"win >= {PLAIN.panes - 1}")
    sources = to_windows(rows.select("pane", "closed", "src_ip").distinct(), PLAIN).filter(f"win >= {PLAIN.panes - 1}")
    return sketches.vector_query(sketches.merge_vectors(held, 257, ["win"]), sources, "src_ip", height, 257, ["win"], 3)


def sliding_ss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreaders by a spread sketch in a sliding sketch; a bucket's candidate is the better one of both copies."""
    placed = sketches.spread_places(_panes(spark, sf_dir), "src_ip", "dst_ip", DEPTH, 257, SHAPE, ["pane", "closed"])
    held = sketches.rotate(placed, f"pos * {PLAIN.panes} div 257", PLAIN.panes).filter(f"win >= {PLAIN.panes - 1}")
    bits, candidates = sketches.spread_cells(held, "src_ip", ["win"])
    return sketches.spread_query(bits, candidates, "src_ip", DEPTH, 257, SHAPE, ["win"], 3)


def _sliding_ordered(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    width, threshold = (WIDTH, None) if kind == "sumax" else (257, 40)
    return ordered.sliding_estimates(_panes(spark, sf_dir), kind, PAIR, "size", PLAIN.panes, DEPTH, width, threshold)


def loss_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows that seem to lose packets between two ends, against those that do: the far end also misses, in each pane, what comes so late that the pane has ended there."""
    sent = _panes(spark, sf_dir)
    start = event_packets(spark, sf_dir).agg(F.min("us").alias("t0"))
    late = F.expr(f"(us - t0) % {PLAIN.pane}L + {LATE}L >= {PLAIN.pane}L")
    received = sent.filter("seq % 97 <> 0").crossJoin(F.broadcast(start)).filter(~late)  # one row
    missing = truth.lost_packets(sent, received, ["pane", "seq"])
    return metrics.precision_recall(missing, sent.filter("seq % 97 = 0"), FLOW).select("tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def pinned_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of each sliding window by source and port; a key that leaves the window goes, unless it is a hot key, which stays at 0."""
    keys, rows = ["src_ip", "dst_port"], _panes(spark, sf_dir)
    hot = truth.hot_keys(event_packets(spark, sf_dir), keys, 25)
    windows = rows.agg(F.max("closed").alias("closed")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("closed") - 1)).alias("win"))
    counts = to_windows(rows.groupBy("pane", "closed", *keys).agg(F.count(F.lit(1)).alias("packets")), PLAIN)
    return truth.pinned(counts.groupBy("win", *keys).agg(F.sum("packets").alias("packets")), hot, keys, ["packets"], windows)


def drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drifting_panes(event_packets(spark, sf_dir), 6 * HOUR)
    return rows.groupBy("pane").agg(F.min("us").alias("start"), F.count(F.lit(1)).alias("packets"))


def keys_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow keys with the time when each first appears."""
    return event_packets(spark, sf_dir).groupBy(*FLOW).agg(F.min(F.struct("us", "seq")).alias("at")).select(*FLOW, "at.us", "at.seq")


def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average relative error of Count-Min by tumbling window, at a width that makes keys collide."""
    rows = _windows(spark, sf_dir)
    exact = rows.groupBy("win", *PAIR).agg(F.sum("size").alias("exact"))
    est = sketches.count_min_query(sketches.count_min(rows, PAIR, "size", 2, 61, ["win"]), exact, PAIR, 2, 61, ["win"])
    out = metrics.average_relative_error(est.join(exact, ["win", *PAIR]), "est", "exact", ["win"])
    return out.select("win", F.round("are", 6).alias("are"))


def _ordered(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    width = WIDTH if kind in ("cu", "sumax") else 257
    threshold = None if kind in ("cu", "sumax") else 40
    return ordered.ordered_estimates(_windows(spark, sf_dir), kind, PAIR, "size", "win", DEPTH, width, threshold)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {f"{name}_{m}": partial(_mechanism, name, m) for name in QUERIES for m in (*plans.MECHANISMS, *plans.PLANE_MECHANISMS)}
    out |= {"heavy_hitters_isw": partial(heavy_hitters, False), "heavy_hitters_tw": partial(heavy_hitters, True)}
    out |= {"superspreaders_isw": partial(superspreaders, False), "superspreaders_tw": partial(superspreaders, True)}
    out |= {"bloom_distinct": partial(bloom_distinct, 1), "bloom_distinct_2": partial(bloom_distinct, 2)}
    for f in (flow_size_isw, cardinality_isw, pr_report, pr_windows, collapse_stride, topk_hotkeys, pinned_hotkeys, quantile_vals, cm_point, cm_merged, hh_merged):
        out[f.__name__] = f
    for f in (data_plane_ddos, lc_card, hll_card, mrb_card, vbf_spread, spread_candidates, loss_anti, ibf_cells, ibf_decode, lookup_vs_dump, sliding_cm):
        out[f.__name__] = f
    for f in (drifting, keys_extracted, error_report, pr_table, pr_average, ideal_recall, restricted_tp, relative_errors, spread_merged):
        out[f.__name__] = f
    for f in (sliding_lc, sliding_hll, sliding_vbf, sliding_ss, loss_report, pinned_sliding):
        out[f.__name__] = f
    out |= {kind: partial(_ordered, kind) for kind in ordered.KINDS}
    out |= {f"sliding_{kind}": partial(_sliding_ordered, kind) for kind in ("sumax", "mv", "hashpipe")}
    return out


