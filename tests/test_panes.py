"""Window mechanisms against a model that handles one packet at a time, on hand-made and random traces."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paneflow.plans import compile as plans
from paneflow.plans import query as library
from paneflow.plans.panes import WindowSpec, drifting_panes, drifting_starts
from paneflow.sources.packets import PACKETS

MS = 1000
SPEC = WindowSpec(pane=100 * MS, panes=5, dead=20 * MS)


def packet(us, seq, src=1, dst=2, sport=1000, dport=80, proto=6, flag=2, size=40):
    return (us, seq, src, dst, sport, dport, proto, flag, size)


def frame(spark, rows):
    return spark.createDataFrame(rows, PACKETS)


def model(rows, spec, mechanism, key, element=None, keep=lambda p: True):
    """Windows' counts by key: {(win, key): value}; elements are counted once in a window, or by their first pane in a tumbling one."""
    rows = sorted(rows)
    if not rows:
        return {}
    t0, t1 = rows[0][0], rows[-1][0]
    if mechanism in ("itw", "tw1"):
        width, panes = spec.window, 1
    else:
        width, panes = spec.pane, spec.panes
    closed = (t1 - t0) // width
    if spec.limit is not None:
        closed = min(closed, spec.limit if panes > 1 else spec.limit // spec.panes)
    by_pane = defaultdict(list)
    for p in rows:
        pane = (p[0] - t0) // width
        if pane < closed and keep(p) and not (mechanism == "tw1" and (p[0] - t0) % spec.window < spec.dead):
            by_pane[pane].append(p)
    out = defaultdict(int)
    if mechanism == "isw":
        for w in range(closed):
            seen = set()
            for pane in range(max(0, w - panes + 1), w + 1):
                for p in by_pane[pane]:
                    if element is None or (key(p), element(p)) not in seen:
                        seen.add((key(p), element(p) if element else None))
                        out[w, key(p)] += 1
        return dict(out)
    counts = defaultdict(lambda: defaultdict(int))
    seen, turn = set(), None
    for pane in range(closed):
        if pane // panes != turn:
            seen, turn = set(), pane // panes
        for p in by_pane[pane]:
            if element is None or (key(p), element(p)) not in seen:
                seen.add((key(p), element(p) if element else None))
                counts[pane][key(p)] += 1
    for pane in range(closed):
        if mechanism in ("itw", "tw1"):
            wins = [pane]
        elif mechanism == "otw":
            wins = [pane // panes] if pane // panes < closed // panes else []
        else:
            wins = range(pane, min(pane + panes, closed))
        for w in wins:
            for k, v in counts[pane].items():
                out[w, k] += v
    return dict(out)


def run(spark, rows, query, mechanism, spec=SPEC):
    found = plans.run(frame(spark, rows), query, spec, mechanism).collect()
    return {(r["win"], r[query.keys[0]]): r[query.measures[0]] for r in found}


DDOS, CONNS = library.ddos(1), library.new_tcp_connections(1)


@pytest.mark.parametrize("mechanism", plans.MECHANISMS)
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_traces(spark, mechanism, seed):
    rng = random.Random(seed)
    rows, us = [], 7_777_777
    for i in range(400):
        us += rng.choice([0, 0, 3 * MS, 9 * MS, 40 * MS, 230 * MS])
        rows.append(packet(us, i, rng.randrange(4), rng.randrange(3), flag=rng.choice([2, 16, 17])))
    spec = WindowSpec(SPEC.pane, 5, SPEC.dead, 200 if seed == 3 else None)
    assert run(spark, rows, DDOS, mechanism, spec) == model(rows, spec, mechanism, lambda p: p[3], lambda p: p[2])
    syn = lambda p: p[7] == 2
    assert run(spark, rows, CONNS, mechanism, spec) == model(rows, spec, mechanism, lambda p: p[3], keep=syn)


def test_boundary_packet_starts_the_next_pane_and_closes_the_last(spark):
    rows = [packet(0, 0, dst=1), packet(100 * MS, 1, dst=2)]
    assert run(spark, rows, CONNS, "isw") == {(0, 1): 1}


def test_gap_gives_empty_panes(spark):
    rows = [packet(0, 0), packet(100 * MS, 1), packet(1000 * MS, 2)]
    assert run(spark, rows, CONNS, "isw") == {(0, 2): 1, (1, 2): 2, (2, 2): 2, (3, 2): 2, (4, 2): 2, (5, 2): 1}


def test_open_tail_is_not_reported(spark):
    rows = [packet(0, 0), packet(100 * MS, 1), packet(130 * MS, 2)]
    assert run(spark, rows, CONNS, "isw") == {(0, 2): 1}


def test_dead_time(spark):
    rows = [packet(0, 0, flag=16), packet(10 * MS, 1), packet(20 * MS, 2), packet(600 * MS, 3, flag=16)]
    assert run(spark, rows, CONNS, "tw1") == {(0, 2): 1}
    assert run(spark, rows, CONNS, "itw") == {(0, 2): 2}


def test_distinct_scopes_differ(spark):
    rows = [packet(i * 100 * MS + 1, i) for i in (0, 3, 6)] + [packet(1201 * MS, 99, dst=9)]
    isw, osw, itw = (run(spark, rows, DDOS, m) for m in ("isw", "osw", "itw"))
    assert all(v == 1 for (w, k), v in isw.items() if k == 2)
    assert osw[(4, 2)] == 1 and max(osw.values()) == 1 and (5, 2) not in osw and (5, 2) in isw
    assert itw == {(0, 2): 1, (1, 2): 1}


def test_burst_over_a_boundary_is_seen_by_sliding_windows_only(spark):
    rows = [packet(0, 0, dst=9)] + [packet(480 * MS + i * 4 * MS, i + 1, src=i) for i in range(10)] + [packet(1500 * MS, 99, dst=9)]
    query = library.ddos(10)
    assert not run(spark, rows, query, "itw")
    assert {w for w, _ in run(spark, rows, query, "isw")} == {5, 6, 7, 8}


def test_differences(spark):
    idle = [packet(0, 0, flag=2), packet(1, 1, flag=2), packet(210 * MS, 2, flag=1), packet(900 * MS, 3, flag=18)]
    query = library.completed_flow(1)
    found = plans.run(frame(spark, idle), query, SPEC, "isw").collect()
    assert {(r.win, r.opened, r.closing) for r in found} == {(0, 2, 0), (1, 2, 0), (2, 2, 1), (3, 2, 1), (4, 2, 1)}
    negative = [packet(0, 0, flag=2), packet(1, 1, flag=1), packet(2, 2, flag=1), packet(3, 3, dst=5, flag=1), packet(900 * MS, 4, flag=18)]
    assert not plans.run(frame(spark, negative), query, SPEC, "itw").collect()
    low = plans.run(frame(spark, negative), library.completed_flow(-9), SPEC, "itw").collect()
    assert [(r.dst_ip, r.opened, r.closing) for r in low] == [(2, 1, 2)]  # a key without SYN isn't reported


def test_syn_flood_counts_fin_ack_for_the_source(spark):
    rows = [packet(0, 0, src=7, dst=2, flag=2), packet(1, 1, src=2, dst=7, flag=17), packet(2, 2, src=7, dst=2, flag=16), packet(900 * MS, 9, flag=18)]
    found = plans.run(frame(spark, rows), library.syn_flood(1), SPEC, "itw").collect()
    assert [(r.host, r.syn, r.synack, r.ack) for r in found] == [(2, 1, 1, 1)]


def test_slowloris_needs_bytes_and_connections(spark):
    rows = [packet(i, i, src=i, size=100) for i in range(8)] + [packet(900 * MS, 99, flag=18)]
    found = plans.run(frame(spark, rows), library.slowloris(800, 0.01), SPEC, "osw").collect()
    assert {(r.bytes, r.conns) for r in found} == {(800, 8)}
    assert not plans.run(frame(spark, rows), library.slowloris(801, 0.01), SPEC, "isw").collect()


def test_set_form(spark):
    rows = [packet(i, i, src=i % 4, dport=22, size=40 + i % 2) for i in range(16)] + [packet(900 * MS, 99)]
    query = library.ssh_brute(2)
    full = plans.run(frame(spark, rows), query, SPEC, "itw")
    assert full.count() == 2 and [tuple(x) for x in plans.hits(full, query).collect()] == [(0, 2)]


def test_drifting_panes(spark):
    rows = [packet(us * MS, i) for i, us in enumerate([0, 150, 240, 260])]
    found = drifting_panes(frame(spark, rows), 100 * MS).select("us", "pane").collect()
    assert sorted(map(tuple, found)) == [(0, 0), (150 * MS, 1), (240 * MS, 1), (260 * MS, 2)]
    assert drifting_panes(frame(spark, []), 100 * MS).count() == 0


def test_drifting_panes_model(spark):
    rng, us, rows = random.Random(5), 0, []
    for i in range(300):
        us += rng.choice([0, 7, 60, 101, 9000]) * MS
        rows.append(packet(us, i))
    expect, start, pane = [], None, -1
    for p in rows:
        if start is None or p[0] > start + 100 * MS:
            start, pane = p[0], pane + 1
        expect.append((p[1], pane))
    found = drifting_panes(frame(spark, rows), 100 * MS).select("seq", "pane").collect()
    assert sorted(map(tuple, found)) == expect


def restarts(times, pane):
    out = []
    for us in sorted(times):
        if not out or us > out[-1] + pane:
            out.append(us)
    return out


@pytest.mark.parametrize("few", [0, 40])
def test_drifting_starts_by_blocks(spark, few):
    rng = random.Random(few)
    for steps, first in (([1, 2, 30], -900), ([101, 102, 5000], 7), ([50], 0), ([1, 99, 100, 101, 90_000], -5)):
        us, times = first, []
        for _ in range(400):
            times.append(us)
            us += rng.choice(steps)
        rows = frame(spark, [packet(t, i) for i, t in enumerate(times)])
        assert sorted(r.start for r in drifting_starts(rows, 100, times[0], times[-1], few).collect()) == restarts(times, 100)


def test_drifting_panes_dont_join_all_times(spark):
    rows = spark.range(100_000).selectExpr("id * 7 + id % 3 AS us", "id AS seq")
    began = time.monotonic()
    got = drifting_panes(rows, 1000).groupBy("pane").agg(F.min("us").alias("start")).collect()
    assert time.monotonic() - began < 30
    assert [r.start for r in sorted(got)] == restarts([i * 7 + i % 3 for i in range(100_000)], 1000)


def test_empty_input_and_unknown_mechanism(spark):
    for m in plans.MECHANISMS:
        assert run(spark, [], DDOS, m) == {}
    with pytest.raises(ValueError):
        plans.run(frame(spark, []), DDOS, SPEC, "weekly")


def test_packets_that_lack_what_a_query_needs_are_left_out(spark):
    rows = [packet(0, 0), packet(1, 1), packet(900 * MS, 9)]
    df = frame(spark, rows)
    lacking = df.selectExpr("us", "seq", "src_ip", "CASE WHEN seq <> 1 THEN dst_ip END AS dst_ip", "src_port", "dst_port", "proto", "tcp_flag", "CASE WHEN seq <> 0 THEN size END AS size")
    assert [(r.win, r.conns) for r in plans.run(lacking, CONNS, SPEC, "itw").collect()] == [(0, 1)]
    assert not plans.run(lacking, library.slowloris(1, 0.0), SPEC, "isw").collect()


def test_a_query_reads_only_its_columns(spark):
    from paneflow import catalog

    plan = catalog.queries()["ddos_isw"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    reads = [x.split("ReadSchema: ")[1].split("\n")[0] for x in plan.split("FileScan")[1:]]
    assert reads and all("event_type" not in x and "value" not in x for x in reads)
    assert "CartesianProduct" not in plan
