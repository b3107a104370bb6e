"""Invariants of the sketches, and the order-dependent ones against plain loops."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneflow.functions import hashing
from paneflow.operators import metrics, ordered, sketches, truth
from paneflow.sources.packets import PACKETS, as_packets

KEYS = ["src_ip", "dst_ip"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i * 1000, i, rng.randrange(60), rng.randrange(30), 1000, 80, 6, 2, rng.randrange(1, 50)) for i in range(900)]


@pytest.fixture(scope="module")
def packets(spark, rows):
    return spark.createDataFrame(rows, PACKETS).withColumn("win", F.expr("seq div 300")).cache()


def test_count_min_never_underestimates(packets):
    exact = packets.groupBy(*KEYS).agg(F.sum("size").alias("exact"))
    for width in (17, 1021):
        est = sketches.count_min_query(sketches.count_min(packets, KEYS, "size", 3, width), exact, KEYS, 3, width)
        assert est.join(exact, KEYS).filter("est < exact").count() == 0
    assert est.join(exact, KEYS).filter("est <> exact").count() < 100


def test_merged_counters_equal_one_sketch(packets):
    one = sketches.count_min(packets, KEYS, "size", 3, 61)
    merged = sketches.merge_counters(sketches.count_min(packets, KEYS, "size", 3, 61, ["win"]))
    assert one.exceptAll(merged).count() == merged.exceptAll(one).count() == 0


def test_bloom_never_counts_more_than_there_are(packets, rows):
    exact = packets.select(*KEYS).distinct().count()
    for hashes in (1, 2):
        small = sketches.bloom_first(packets, KEYS, hashes, 128 * hashes, []).count()
        large = sketches.bloom_first(packets, KEYS, hashes, 2**20 * hashes, []).count()
        assert small <= exact and large >= exact - 2
    bits, new = [set() for _ in range(2)], 0
    for r in rows:
        folded = 0
        for c in r[2:4]:
            folded = (folded * 1000003 + c) % hashing.PRIME
        at = [int(hashing.numpy_position(np.array([folded]), i, 128)[0]) for i in range(2)]
        new += any(p not in s for p, s in zip(at, bits))
        for p, s in zip(at, bits):
            s.add(p)
    assert sketches.bloom_first(packets, KEYS, 2, 256, []).count() == new


@pytest.mark.parametrize("kind", ["lc", "hll", "mrb"])
def test_cardinalities_are_near(packets, kind):
    exact = packets.select(*KEYS).distinct().count()
    if kind == "lc":
        est = sketches.linear_estimate(sketches.linear_bits(packets, KEYS, 8191, []), 8191, [])
    elif kind == "hll":
        est = sketches.hyperloglog_estimate(sketches.registers(packets, KEYS, 1021, []), 1021, [])
    else:
        shape = sketches.MultiResolution(4, 509, 1021)  # odd, as levels and bits come from one hash
        est = sketches.resolution_estimate(sketches.resolution_bits(packets, KEYS, shape, []), shape, [])
    assert abs(est.first()["est"] - exact) < 0.15 * exact


def test_union_of_bits_is_the_sketch_of_the_union(packets):
    parts = sketches.linear_bits(packets, KEYS, 509, ["win"]).select("pos").distinct()
    whole = sketches.linear_bits(packets, KEYS, 509, [])
    assert parts.exceptAll(whole).count() == whole.exceptAll(parts).count() == 0


def test_digest_finds_the_lost_packets(packets):
    kept = packets.filter("seq % 50 <> 0")
    cells = sketches.subtract(sketches.digest(packets, "seq", 400, 4), sketches.digest(kept, "seq", 400, 4))
    found, left = sketches.peel(cells, "seq", 400, 4)
    assert sorted(r.seq for r in found.collect()) == list(range(0, 900, 50)) and left.count() == 0
    assert truth.lost_packets(packets, kept, ["seq"]).count() == 18
    overfull = sketches.subtract(sketches.digest(packets, "seq", 40, 4), sketches.digest(packets.limit(0), "seq", 40, 4))
    assert sketches.peel(overfull, "seq", 40, 4)[1].count() > 0  # a digest that is too small says so


def test_rotating_counters_cover_one_to_two_windows(packets):
    panes = packets.withColumn("pane", F.expr("seq div 60")).withColumn("one", F.lit(1).cast("long"))
    got = sketches.rotating_counters(panes, ["dst_ip"], "one", 1, 7, 5)
    new, old, expect = defaultdict(int), defaultdict(int), {}
    by_pane = defaultdict(list)
    for r in panes.select("pane", hashing.fold("dst_ip").alias("k")).collect():
        by_pane[r.pane].append(int(hashing.numpy_position(np.array([r.k]), 0, 7)[0]))
    for w in range(15):
        for p in by_pane[w]:
            new[p] += 1
        for p in range(7):  # at the end of a pane its share of the cells grows old
            if p * 5 // 7 == w % 5:
                old[p], new[p] = new[p], 0
            if new[p] + old[p]:
                expect[w, p] = new[p] + old[p]
    assert {(r.win, r.pos): r.val for r in got.filter("win < 15").collect()} == expect


def test_ordered_sketches(spark, packets, rows):
    exact = {(r["win"], r["src_ip"], r["dst_ip"]): r["v"] for r in packets.groupBy("win", *KEYS).agg(F.sum("size").alias("v")).collect()}
    for kind in ("cu", "sumax"):
        got = ordered.ordered_estimates(packets, kind, KEYS, "size", "win", 3, 61).collect()
        assert {(r.win, r.src_ip, r.dst_ip): r.exact for r in got} == exact
        assert all(r.est >= r.exact for r in got)
        plain = sketches.count_min_query(sketches.count_min(packets, KEYS, "size", 3, 61, ["win"]), packets.select("win", *KEYS).distinct(), KEYS, 3, 61, ["win"])
        above = {(r.win, r.src_ip, r.dst_ip): r.est for r in plain.collect()}
        assert all(r.est <= above[r.win, r.src_ip, r.dst_ip] for r in got)
    wide = ordered.ordered_estimates(packets, "hashpipe", KEYS, "size", "win", 4, 4099, threshold=60).collect()
    assert {(r.win, r.src_ip, r.dst_ip) for r in wide} == {k for k, v in exact.items() if v > 60}
    heavy = packets.withColumn("size", F.when(F.col("src_ip") == 1, 5000).otherwise(F.col("size")).cast("long"))
    found = ordered.ordered_estimates(heavy, "mv", KEYS, "size", "win", 4, 257, threshold=4000).collect()
    assert {(r.win, r.src_ip, r.dst_ip) for r in found} == {(r.win, r.src_ip, r.dst_ip) for r in ordered.exact_hitters(heavy, KEYS, "size", "win", 4000).collect()}


def test_spread_estimates(spark):
    rows = [(i, i, 1, i % 200, 0, 0, 6, 2, 40) for i in range(600)] + [(i + 600, i + 600, 2 + i % 50, 1, 0, 0, 6, 2, 40) for i in range(200)]
    df = spark.createDataFrame(rows, PACKETS)
    shape = sketches.MultiResolution()
    bits, candidates = sketches.spread_sketch(df, "src_ip", "dst_ip", 4, 257, shape, [])
    found = {r.src_ip: r.est for r in sketches.spread_query(bits, candidates, "src_ip", 4, 257, shape, [], 50).collect()}
    assert set(found) == {1} and 120 < found[1] < 280
    vector = sketches.vector_query(sketches.vector_bits(df, "src_ip", "dst_ip", 1024, 1021, []), df, "src_ip", 1024, 1021, [], 50).collect()
    assert [r.src_ip for r in vector] == [1] and 150 < vector[0].est < 250


def test_vector_filter_is_no_larger_than_its_rows(spark):
    rows = [(i, i, 1 + i % 90, i * 7 % 40, 0, 0, 6, 2, 40) for i in range(3000)] + [(4000 + i, 4000 + i, 5, 100 + i, 0, 0, 6, 2, 40) for i in range(60)]
    df = spark.createDataFrame(rows, PACKETS).withColumn("win", F.expr("seq % 2"))
    bits = sketches.vector_bits(df, "src_ip", "dst_ip", 64, 257, ["win"])
    assert bits.count() <= 2 * 5 * 64
    places = [F.expr(e).alias(f"r{i}") for i, e in enumerate(sketches.slice_rows("src_ip", 64))]
    at = df.withColumn("pair", hashing.fold("src_ip", "dst_ip")).select("win", "src_ip", hashing.position("pair", 4, 257).alias("col"), *places).collect()
    held = defaultdict(set)
    for r in at:
        for i in range(5):
            held[r.win, i, r[f"r{i}"]].add(r.col)
    expect = {}
    for r in at:
        used = len(set.intersection(*(held[r.win, i, r[f"r{i}"]] for i in range(5))))
        v = 1 - sum(len(held[r.win, 4, k]) for k in range(64) if (r.win, 4, k) in held) / (257 * 64)
        delta = -257 * np.log(v * (2 - v))
        if 257 - used < np.floor(257 * np.exp(-(3 + delta) / 257)):
            expect[r.win, r.src_ip] = int(np.floor(257 * np.log(257 / max(257 - used, 1)) - delta))
    got = sketches.vector_query(bits, df, "src_ip", 64, 257, ["win"], 3)
    assert expect and {(r.win, r.src_ip): r.est for r in got.collect()} == expect


def test_metrics(spark):
    result, real = spark.createDataFrame([(0, 1), (0, 2), (1, 5)], "win long, k long"), spark.createDataFrame([(0, 2), (0, 3), (2, 7)], "win long, k long")
    by_win = {r.win: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in metrics.precision_recall(result, real, ["k"], ["win"]).collect()}
    assert by_win == {0: (1, 1, 1, 0.5, 0.5), 1: (0, 1, 0, 0.0, 1.0), 2: (0, 0, 1, 1.0, 0.0)}
    all_ = metrics.precision_recall(result, real, ["k"]).first()
    assert (all_.tp, all_.fp, all_.fn) == (1, 2, 2) and abs(all_.f1 - 1 / 3) < 1e-9
    assert tuple(metrics.restricted_confusion(result, real, spark.createDataFrame([(3,)], "k long"), ["k"]).first()) == (0, 2, 2)
    est = spark.createDataFrame([(10, 8), (9, 9)], "e long, t long")
    assert metrics.average_relative_error(est, "e", "t").first()["are"] == 0.125
    assert est.select(metrics.relative_error("e", "t").alias("x")).first()["x"] == 0.25


def test_quantiles_and_collapse(spark):
    df = spark.createDataFrame([(0, v) for v in (5, 1, 1, 9, 7)] + [(1, 3)], "win long, v long")
    got = {(r.win, r.share): r.value for r in truth.quantiles(df, "v", [0.0, 0.5, 0.99], ["win"]).collect()}
    assert got == {(0, 0.0): 1, (0, 0.5): 5, (0, 0.99): 9, (1, 0.0): 3, (1, 0.5): 3, (1, 0.99): 3}
    wins = spark.createDataFrame([(w, w) for w in range(8)], "win long, k long")
    sets = defaultdict(set)
    for r in truth.collapse(wins, ["k"], start=1, width=3, stride=2).collect():
        sets[r.step].add(r.k)
    assert {i: sets[i] for i in range(3)} == {0: {1, 2, 3}, 1: {3, 4, 5}, 2: {5, 6, 7}}


def test_crcs_and_addresses(spark):
    # fixed values: what each gives for the text 123456789
    check = {"crc32": 0xCBF43926, "crc32c": 0xE3069283, "crc32d": 0x87315576, "jamcrc": 0x340BC6D9, "xfer": 0xBD0BE338, "posix": 0x765E7680, "bzip2": 0xFC891918, "mpeg": 0x0376E6E7, "crc32q": 0x3010BF7F}
    assert {k: hashing.crc(b"123456789", k) for k in hashing.CRCS} == check
    df = spark.createDataFrame([(b"123456789", 0xC0A80001)], "b binary, ip long")
    row = df.select(hashing.crc_column(F.col("b")).alias("a"), hashing.crc_column(F.col("b"), "mpeg").alias("m"), hashing.format_ip("ip").alias("ip")).first()
    assert (row.a, row.m, row.ip) == (check["crc32"], check["mpeg"], "192.168.0.1")
    assert df.select(hashing.format_ip("ip").alias("t")).select(hashing.parse_ip("t").alias("x")).first()["x"] == 0xC0A80001
    assert [hashing.next_prime(n) for n in (1, 8, 257, 2**19)] == [2, 11, 257, 524309]


def test_bit_expressions(spark):
    for x in (1, 2, 3, 7, 8, 12, 23, 2**30):
        row = spark.range(1).selectExpr(f"{hashing.trailing_zeros_sql(str(x))} AS z", f"{hashing.trailing_ones_sql(str(x))} AS o").first()
        assert row.z == len(f"{x:b}") - len(f"{x:b}".rstrip("0")) and row.o == len(f"{x:b}") - len(f"{x:b}".rstrip("1"))


def test_packets_are_checked(spark, packets):
    with pytest.raises(ValueError, match="dst_port"):
        as_packets(packets.drop("dst_port"))
    with_null = packets.withColumn("size", F.when(F.col("seq") > 0, F.col("size")))
    assert as_packets(with_null).count() == packets.count() - 1


@pytest.mark.parametrize("kind, threshold", [("sumax", None), ("mv", 30), ("hashpipe", 30)])
def test_sliding_ordered_sketches_equal_one_pass_over_the_whole_trace(packets, rows, kind, threshold):
    """Blocks of windows replayed apart against one sketch that sees every packet from the first on."""
    depth, width, panes, length = 2, 13, 3, 20
    panes_of = packets.withColumn("pane", F.expr(f"seq div {length}")).withColumn("closed", F.lit(len(rows) // length).cast("long"))
    got = ordered.sliding_estimates(panes_of, kind, KEYS, "size", panes, depth, width, threshold).collect()
    places = lambda k: [int(hashing.numpy_position(np.array([k]), i, width)[0]) for i in range(depth)]
    new, old = ordered.KINDS[kind](depth, width), ordered.KINDS[kind](depth, width)
    seen, expect = {}, []
    for pane in range(len(rows) // length):
        for r in rows[pane * length : (pane + 1) * length]:
            folded = 0
            for c in r[2:4]:
                folded = (folded * 1000003 + c) % hashing.PRIME
            new.insert(folded, r[8], places(folded))
            seen[folded] = (pane, r[2:4])
        for pos in range(width):
            if pos * panes // width == pane % panes:
                for name, empty in new.STATE.items():
                    getattr(old, name)[:, pos] = getattr(new, name)[:, pos]
                    getattr(new, name)[:, pos] = empty
        if pane < panes - 1:
            continue
        for k, (last, key) in seen.items():
            listed = last > pane - panes if threshold is None else k in new.candidates() | old.candidates()
            est = int(type(new).joined(a + b for a, b in zip(new.parts(k, places(k)), old.parts(k, places(k)))))
            if listed and (threshold is None or est > threshold):
                expect.append((pane, *key, est))
    assert sorted(map(tuple, got)) == sorted(expect) and len({x[0] for x in expect}) > 5 * panes


def test_no_sliding_form_of_conservative_updates(packets):
    with pytest.raises(ValueError):
        ordered.sliding_estimates(packets, "cu", KEYS, "size", 3)


def test_sliding_ordered_sketches_of_nothing(packets):
    empty = packets.limit(0).withColumn("pane", F.lit(0).cast("long")).withColumn("closed", F.lit(0).cast("long"))
    assert ordered.sliding_estimates(empty, "mv", KEYS, "size", 3, threshold=1).collect() == []
