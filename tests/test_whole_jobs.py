"""Registered queries of the engine over all closed windows, against plain loops or SQL without a cap."""

from collections import defaultdict

import duckdb
import numpy as np

from paneflow import catalog
from paneflow.functions import hashing
from paneflow.operators import sketches
from paneflow.sources.packets import PACKETS_SQL

SF = "/root/testdata/sf0.001"


def packets():
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    return con.execute(f"SELECT us, seq, src_ip, dst_ip, dst_port, size FROM ({PACKETS_SQL}) ORDER BY us, seq").fetchall()


def test_sliding_cm_reports_every_closed_pane(spark):
    rows = packets()
    first, pane, panes = rows[0][0], catalog.PLAIN.pane, catalog.PLAIN.panes
    closed = (rows[-1][0] - first) // pane
    added = defaultdict(int)
    for us, _, _, dst, _, size in rows:
        for i in range(2):
            added[(us - first) // pane, i, int(hashing.numpy_position(np.array([dst % hashing.PRIME]), i, 257)[0])] += size
    new, old, expect = defaultdict(int), defaultdict(int), {}
    for w in range(closed):
        for i in range(2):
            for p in range(257):
                new[i, p] += added.get((w, i, p), 0)
                if p * panes // 257 == w % panes:
                    old[i, p], new[i, p] = new[i, p], 0
                if new[i, p] + old[i, p]:
                    expect[w, i, p] = new[i, p] + old[i, p]
    got = {(r.win, r.row, r.pos): r.val for r in catalog.sliding_cm(spark, SF).collect()}
    assert closed > 100 and max(w for w, _, _ in got) == closed - 1
    assert got == expect


def test_hot_keys_are_pinned_in_every_closed_window(spark):
    rows = packets()
    first, window = rows[0][0], catalog.PLAIN.window
    closed = (rows[-1][0] - first) // window
    whole, expect = defaultdict(int), defaultdict(int)
    for us, _, src, _, port, _ in rows:
        whole[src, port] += 1
        if (w := (us - first) // window) < closed:
            expect[w, src, port] += 1
    hot = sorted(whole, key=lambda k: (-whole[k], k))[:25]
    for w in range(closed):
        for k in hot:
            expect[w, *k] += 0
    got = [((r.win, r.src_ip, r.dst_port), r.packets) for r in catalog.pinned_hotkeys(spark, SF).collect()]
    assert closed > 1 and len(got) == len(dict(got)) and dict(got) == expect and 0 in expect.values()


def test_digest_is_as_large_as_the_loss(spark, tmp_path):
    n = 1_200_000  # loses 12,372 packets, more than 12,288 cells can tell apart
    events = spark.range(n).selectExpr(
        "id AS event_id", "CAST(timestamp_micros(1704067200000000 + id * 1000000) AS timestamp_ntz) AS ts", "id % 50 AS user_id",
        "'click' AS event_type", "1.0D AS value", "'{\"k\": 7}' AS props",
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = [r.seq for r in catalog.ibf_decode(spark, str(tmp_path)).collect()]
    assert sorted(got) == list(range(0, n, 97))


def test_cells_left_over_are_looked_up(spark):
    twice = spark.createDataFrame([(i // 2,) for i in range(40)], "seq long")  # two rows of an id never make a cell of one
    got = [r.seq for r in sketches.lost_ids(twice, twice.filter("seq > 3"), "seq", 400, 4).collect()]
    assert sorted(got) == [0, 0, 1, 1, 2, 2, 3, 3]
