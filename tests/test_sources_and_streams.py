"""Raw traces, key files, and streaming plans against the batch plans."""

import struct

import pytest
from pyspark.sql import functions as F

from paneflow import catalog
from paneflow.plans import compile as plans
from paneflow.sources import trace
from paneflow.sources.packets import event_packets
from paneflow.streaming import incremental
from paneflow.streaming import queries as streams

SF = "/root/testdata/sf0.001"


def test_trace_round_trip(spark, tmp_path):
    packets = event_packets(spark, SF).filter("seq < 300").withColumn("pkt_ts", F.lit(10.0) + F.col("seq") * 0.25)
    trace.write_trace(packets.repartition(3), str(tmp_path / "t"))
    for records in (7, 1 << 20):
        back = trace.read_trace(spark, str(tmp_path / "t"), records)
        assert back.select("seq").distinct().count() == 300
        columns = ["src_ip", "dst_ip", "src_port", "dst_port", "proto", "tcp_flag", "size"]
        assert packets.select(*columns, "pkt_ts").exceptAll(back.select(*columns, "pkt_ts")).count() == 0
        assert back.filter("us = 10250000").count() == 1
    trace.write_trace(packets.limit(5), str(tmp_path / "t"))
    assert trace.read_trace(spark, str(tmp_path / "t")).count() == 5


def test_trace_layout_and_length_check(spark, tmp_path):
    record = struct.pack("<IIHHBiIIBdBB", 2**32 - 1, 7, 65535, 80, 6, 1500, 11, 12, 18, 1.5, 5, 8)
    (tmp_path / "a").write_bytes(record * 2)
    row = trace.read_trace(spark, str(tmp_path / "a")).orderBy("seq").first()
    assert len(record) == 36
    assert (row.src_ip, row.dst_ip, row.src_port, row.size, row.tcp_flag, row.us, row.seq) == (2**32 - 1, 7, 65535, 1500, 18, 1_500_000, 0)
    (tmp_path / "b").write_bytes(record[:-1])
    with pytest.raises(Exception, match="36-byte records"):
        trace.read_trace(spark, str(tmp_path / "b")).count()
    (tmp_path / "c").write_bytes(b"")
    assert trace.read_trace(spark, str(tmp_path / "c")).count() == 0


def test_key_file(spark, tmp_path):
    (tmp_path / "k").write_bytes(struct.pack("<Q", 2) + struct.pack("<IIHHB", 1, 2, 3, 4, 6) + struct.pack("<IIHHB", 5, 6, 7, 8, 17))
    assert sorted(map(tuple, trace.read_keys(spark, str(tmp_path / "k")).collect())) == [(1, 2, 3, 4, 6), (5, 6, 7, 8, 17)]


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """The packets as a stream of four files in the order of time, one a batch, and as a table."""
    folder = tmp_path_factory.mktemp("stream")
    packets = event_packets(spark, SF).cache()
    for i in range(4):
        packets.filter(f"seq div 250 = {i}").coalesce(1).write.mode("append").parquet(str(folder / "in"))
    source = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    return packets, source, folder


def collected(spark, out, name, folder):
    query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


@pytest.mark.parametrize("name, having, mechanism", [("ddos", "srcs >= 3", "isw"), ("ddos", "srcs >= 3", "tw1"), ("syn_flood", "syn > 0 AND syn + synack - ack >= 1", "isw"), ("slowloris", "bytes >= 50 AND conns > 0", "itw")])
def test_stream_equals_batch(spark, stream, name, having, mechanism):
    packets, source, folder = stream
    origin = packets.agg(F.min("us")).first()[0]
    query = catalog.QUERIES[name].with_threshold(having)
    got = collected(spark, streams.run(source, query, catalog.SPEC, origin, mechanism), f"{name}_{mechanism}", folder)
    assert got == sorted(map(tuple, plans.run(packets, query, catalog.SPEC, mechanism).collect())) and got


def test_unknown_streaming_mechanism(stream):
    with pytest.raises(ValueError):
        streams.run(stream[1], catalog.QUERIES["ddos"], catalog.SPEC, 0, "osw")


def test_incremental_sums_equal_recomputed_ones(spark, stream):
    packets, source, folder = stream
    origin = packets.agg(F.min("us")).first()[0]
    pane, n = catalog.SPEC.pane, catalog.SPEC.panes
    got = collected(spark, incremental.sliding_sums(source, "dst_ip", "size", pane, n, origin), "incremental", folder)
    closed = (packets.agg(F.max("us")).first()[0] - origin) // pane
    sums = {}
    for r in packets.select(F.expr(f"(us - {origin}) div {pane}L").alias("p"), "dst_ip", "size").collect():
        sums.setdefault(r.dst_ip, {}).setdefault(r.p, 0)
        sums[r.dst_ip][r.p] += r["size"]
    expect = []
    for key, panes in sums.items():
        for w in range(min(panes), min(max(panes) + n, closed)):
            if total := sum(panes.get(p, 0) for p in range(w - n + 1, w + 1)):
                expect.append((w, key, total))
    assert got == sorted(expect)
    assert {w for w, _, _ in expect} == set(range(closed))


def test_incremental_sums_forget_keys_and_count_late_packets(spark, tmp_path):
    """Four batches: a key comes and goes, another moves the clock on, a packet comes late, and one so early that it closes all."""
    pane, n, origin = 1_000_000, 3, 10**12
    batches = [[(0, 1, 5), (500_000, 1, 2)], [(2_100_000, 2, 1), (1_900_000, 1, 4)], [(20_000_000, 2, 9)], [(1_000_000, 1, 100), (40_000_000, 3, 1)], [(60_000_000, 3, 7)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(origin + us, k, v) for us, k, v in rows], "us long, k long, v long").coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
    source = spark.readStream.schema("us long, k long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = incremental.sliding_sums(source, "k", "v", pane, n, origin, "1 second")
    query = out.writeStream.format("memory").queryName("forgets").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("forgets").collect()))
    sums = {1: {0: 7, 1: 4}, 2: {2: 1, 20: 9}, 3: {40: 1, 60: 7}}
    expect = [(w, k, t) for k, panes in sums.items() for w in range(59) if (t := sum(panes.get(p, 0) for p in range(w - n + 1, w + 1)))]
    assert got == sorted(expect)
    states = [x["stateOperators"][0] for x in query.recentProgress if x["stateOperators"]]
    assert sum(x["numRowsDroppedByWatermark"] for x in states) == 1
