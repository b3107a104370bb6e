"""SQL for DuckDB that says what each query returns: every window looks at its packets afresh, nothing is shared or merged."""

from __future__ import annotations

from .catalog import DEPTH, FLOW, LATE, PAIR, PLANE, QUERIES, SHAPE, SPEC, WIDTH
from .functions.hashing import fold_sql, position_sql, trailing_zeros_sql
from .operators.sketches import hyperloglog_sql, slice_rows
from .sources.packets import PACKETS_SQL

N, PANE, WINDOW = SPEC.panes, SPEC.pane, SPEC.window
_HEAD = f"""WITH packets AS ({PACKETS_SQL}), t AS (SELECT min(us) AS t0, max(us) AS t1 FROM packets),
p AS (SELECT packets.*, (us - t0) // {PANE} AS pane, (t1 - t0) // {PANE} AS closed, (us - t0) // {WINDOW} AS turn, (t1 - t0) // {WINDOW} AS turns,
  (us - t0) % {WINDOW} AS elapsed FROM packets, t)"""
#: Rows of closed tumbling windows, as win; and of every sliding window.
_TUMBLING = "SELECT *, turn AS win FROM p WHERE turn < turns"
_SLIDING = f"SELECT p.*, w.win FROM p JOIN (SELECT unnest(range((SELECT max(closed) FROM p))) AS win) w ON w.win BETWEEN p.pane AND p.pane + {N - 1}"


def _query(name: str, mechanism: str) -> str:
    q = QUERIES[name]
    rows = {
        "itw": _TUMBLING,
        "tw1": f"{_TUMBLING} AND elapsed >= {SPEC.dead}",
        "isw": _SLIDING,
        "otw": f"SELECT *, pane // {N} AS win FROM p WHERE pane < closed AND pane // {N} < closed // {N}",
        "osw": _SLIDING,
    }[mechanism]
    where = q.where
    keys = ", ".join(f"{e} AS {k}" for k, e in q.key)
    measures = [f"CAST(sum({e}) AS BIGINT) AS {m}" for m, e in q.sums]
    first = ""
    if q.distinct:
        element = ", ".join([*(e for _, e in q.key), *q.elements])
        if mechanism == "osw":
            first = f", first AS (SELECT *, row_number() OVER (PARTITION BY pane // {N}, {element} ORDER BY us, seq) AS nth FROM p WHERE ({where}) AND pane < closed)"
            rows = rows.replace("FROM p JOIN", "FROM first AS p JOIN")
            measures.append(f"count(*) FILTER (WHERE nth = 1) AS {q.distinct}")
        else:
            measures.append(f"count(DISTINCT ({element}, 0)) AS {q.distinct}")
    names = ", ".join(["win", *q.keys])
    return f"""{_HEAD}{first}, r AS ({rows}), s AS (SELECT CAST(win AS BIGINT) AS win, {keys}, {', '.join(measures)} FROM r WHERE ({where}) GROUP BY ALL)
SELECT {', '.join([names, *q.measures])} FROM s WHERE {q.having}"""


def _switch(name: str, mechanism: str) -> str:
    """tw1a, tw2a, otwa, oswa with one hash: a packet is new if it is the first at its bit, a key is listed if it is the first at its counter."""
    q = QUERIES[name]
    tumbling = mechanism in ("tw1a", "tw2a")
    times = 4 if tumbling else 1
    dead = f" AND elapsed >= {SPEC.dead}" if mechanism == "tw1a" else ""
    rows = f"SELECT *, turn AS cell, turn AS scope FROM p WHERE turn < turns{dead}" if tumbling else f"SELECT *, pane AS cell, pane // {N} AS scope FROM p WHERE pane < closed"
    names, element = ", ".join(q.keys), [*q.keys, *(f"element_{c}" for c in q.elements)]
    keys = ", ".join([*(f"{e} AS {k}" for k, e in q.key), *(f"{c} AS element_{c}" for c in q.elements), *(f"CAST({e} AS BIGINT) AS {m}" for m, e in q.sums)])
    ctes, parts = [f"r AS (SELECT cell, scope, closed, us, seq, {keys} FROM ({rows}) WHERE ({q.where}))"], []
    for i, m in enumerate(q.measures):
        if m == q.distinct:
            bit = position_sql(fold_sql(*element), 0, times * PLANE.bits)
            ctes.append(f"d{i} AS (SELECT *, 1 AS val FROM r QUALIFY row_number() OVER (PARTITION BY scope, {bit} ORDER BY us, seq) = 1)")
        else:
            ctes.append(f"d{i} AS (SELECT *, {m} AS val FROM r WHERE {m} <> 0)")
        place = position_sql(fold_sql(*q.keys), 0, times * PLANE.counters)
        ctes.append(f"s{i} AS (SELECT *, row_number() OVER w AS nth, sum(val) OVER (PARTITION BY cell, {place}) AS est FROM d{i} WINDOW w AS (PARTITION BY cell, {place} ORDER BY us, seq))")
        parts.append(f"SELECT cell, closed, {names}, {', '.join(f'est AS {x}' if x == m else f'0 AS {x}' for x in q.measures)} FROM s{i} WHERE nth = 1")
    win = "cell AS win" if tumbling else f"cell // {N} AS win" if mechanism == "otwa" else "w.win"
    bound = "" if tumbling else f" WHERE cell // {N} < closed // {N}" if mechanism == "otwa" else f" JOIN (SELECT unnest(range((SELECT max(closed) FROM p))) AS win) w ON w.win BETWEEN cell AND cell + {N - 1}"
    sums = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in q.measures)
    return f"""{_HEAD}, {', '.join(ctes)}, u AS ({' UNION ALL '.join(parts)}), f AS (SELECT CAST({win.split(' AS ')[0]} AS BIGINT) AS win, {names}, {sums} FROM u{bound} GROUP BY ALL)
SELECT win, {names}, {', '.join(q.measures)} FROM f WHERE {q.having}"""


def _sets(name: str, mechanism: str) -> str:
    q = QUERIES[name]
    key = (q.output or q.keys)[0]
    return f"SELECT DISTINCT '{name}' AS query, '{mechanism}' AS mechanism, CAST({key} AS BIGINT) AS key FROM ({_switch(name, mechanism) if mechanism.endswith('a') else _query(name, mechanism)})"


def _flow_windows(where: str = "true") -> str:
    flow = ", ".join(FLOW)
    return f"{_HEAD}, r AS ({_SLIDING}), f AS (SELECT CAST(win AS BIGINT) AS win, {flow}, CAST(sum(size) AS BIGINT) AS bytes FROM r WHERE win >= {N - 1} GROUP BY ALL)"


def _spread(aligned: str) -> str:
    return f"""{_HEAD}, r AS ({_SLIDING}) SELECT DISTINCT src_ip FROM (SELECT win, src_ip, count(DISTINCT dst_ip) AS n FROM r WHERE win >= {N - 1}{aligned} GROUP BY ALL) WHERE n > 5"""


def _count_min(rows: str, keys: list[str], depth: int, width: int, by: str = "") -> str:
    """CTEs x (keys' sums), c (counters) and e (estimates); by: a column and a comma, or nothing."""
    names = ", ".join(keys)
    places = " UNION ALL ".join(f"SELECT {by}{names}, val, {i} AS row, {position_sql('folded', i, width)} AS pos FROM x" for i in range(depth))
    on = " AND ".join(f"a.{c} = c.{c}" for c in [*([by.rstrip(', ')] if by else []), "row", "pos"])
    return f"""x AS (SELECT {by}{names}, CAST(sum(size) AS BIGINT) AS val, {fold_sql(*keys)} AS folded FROM ({rows}) GROUP BY ALL), a AS ({places}),
c AS (SELECT {by}row, pos, CAST(sum(val) AS BIGINT) AS val FROM a GROUP BY ALL),
e AS (SELECT {', '.join(f'a.{k}' for k in [*([by.rstrip(', ')] if by else []), *keys])}, min(c.val) AS est, min(a.val) AS exact FROM a JOIN c ON {on} GROUP BY ALL)"""


def _bloom(hashes: int, bits: int, name: str = "new") -> str:
    """CTE of the packets that a Bloom filter calls new, by window."""
    row = [f"row_number() OVER (PARTITION BY win, {position_sql('folded', i, bits // hashes)} ORDER BY us, seq) = 1" for i in range(hashes)]
    return f"b AS (SELECT *, {fold_sql(*PAIR)} AS folded FROM ({_TUMBLING})), {name} AS (SELECT * FROM b QUALIFY {' OR '.join(row)})"


def _merged(having: str, pane: str = "") -> str:
    pair = ", ".join(PAIR)
    return f"""{_HEAD}, {_count_min('SELECT * FROM p WHERE pane < closed', PAIR, DEPTH, WIDTH, 'pane, ')}
SELECT CAST(win AS BIGINT) AS win, {pair}, CAST(sum(est) AS BIGINT) AS est FROM e JOIN (SELECT unnest(range((SELECT max(closed) FROM p))) AS win) w ON w.win BETWEEN pane AND pane + {N - 1}
WHERE win >= {N - 1}{pane} GROUP BY ALL{having}"""


def _cells(where: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS row, {position_sql('(seq % 2147483647)', i, 3072)} AS pos, seq FROM packets WHERE {where}" for i in range(4))


def _resolution(rows: str, element: str, by: str) -> str:
    """CTEs u (hashes), v (levels), z (set bits by level) of a multi-resolution bitmap."""
    level = SHAPE.level_sql("x")
    sums = ", ".join(f"CAST(sum(CASE WHEN level = {i} THEN 1 ELSE 0 END) AS BIGINT) AS s{i}" for i in range(SHAPE.levels))
    return f"""u AS (SELECT DISTINCT {by}, {position_sql(element, 2, 2**31 - 1)} AS x FROM ({rows})), v AS (SELECT DISTINCT {by}, level, {SHAPE.bit_sql('x', 'level')} AS bit FROM (SELECT *, {level} AS level FROM u)),
z AS (SELECT {by}, {sums} FROM v GROUP BY {by})"""


def _held(rows: str, turn: str) -> str:
    """Rows of panes once for each complete window in which a sliding sketch holds them; turn: when their cell is aged."""
    wins = "SELECT CAST(unnest(range((SELECT max(closed) FROM p))) AS BIGINT) AS win"
    return f"SELECT c.*, w.win FROM ({rows}) c JOIN ({wins}) w ON w.win >= {N - 1} AND w.win >= c.pane AND c.pane > w.win - ((w.win - {turn}) % {N} + {N}) % {N} - {N}"


def _spread_sketch(rows: str = _TUMBLING, win: str = "win", least: int = 3, turn: str = "") -> str:
    level, bit = SHAPE.level_sql("x"), SHAPE.bit_sql("x", "level")
    places = " UNION ALL ".join(f"SELECT *, {i} AS row, {position_sql('(src_ip % 2147483647)', i, 257)} AS pos FROM l" for i in range(DEPTH))
    sums = ", ".join(f"CAST(count(DISTINCT CASE WHEN level = {i} THEN bit END) AS BIGINT) AS s{i}" for i in range(SHAPE.levels))
    asked = " UNION ALL ".join(f"SELECT DISTINCT {win}, src_ip, {i} AS row, {position_sql('(src_ip % 2147483647)', i, 257)} AS pos FROM k" for i in range(DEPTH))
    return f"""{_HEAD}, l AS (SELECT *, {bit} AS bit FROM (SELECT *, {level} AS level FROM (SELECT *, {position_sql(fold_sql(*PAIR), 2, 2**31 - 1)} AS x FROM ({rows})))),
m AS ({_held(places, turn) if turn else places}), k AS (SELECT {win}, row, pos, arg_max(src_ip, (level, us, seq)) AS src_ip FROM m GROUP BY ALL),
z AS (SELECT {win}, row, pos, {sums} FROM m GROUP BY {win}, row, pos), q AS (SELECT {win}, row, pos, {SHAPE.estimate_sql([f's{i}' for i in range(SHAPE.levels)])} AS one FROM z), a AS ({asked})
SELECT CAST({win} AS BIGINT) AS {win}, src_ip, min(one) AS est FROM a JOIN q USING ({win}, row, pos) GROUP BY ALL HAVING min(one) > {least}"""


def _vector(sliding: bool = False) -> str:
    rows, width = 1024, 257
    by, of = ("pane", "SELECT * FROM p WHERE pane < closed") if sliding else ("win", _TUMBLING)
    places = " UNION ALL ".join(f"SELECT DISTINCT {by}, src_ip, dst_ip, {i} AS arr, {e} AS row, {position_sql(fold_sql(*PAIR), 4, width)} AS col FROM ({of})" for i, e in enumerate(slice_rows("src_ip", rows)))
    m, own = places, "m"
    if sliding:
        m = _held(places, f"((arr * {rows} + row) * {N} // {5 * rows})")
        own = f"(SELECT s.*, w.win FROM ({places}) s JOIN (SELECT CAST(unnest(range((SELECT max(closed) FROM p))) AS BIGINT) AS win) w ON w.win >= {N - 1} AND w.win BETWEEN pane AND pane + {N - 1})"
    return f"""{_HEAD}, m AS ({m}), bits AS (SELECT DISTINCT win, arr, row, col FROM m), own AS (SELECT DISTINCT win, src_ip, arr, row FROM {own}),
c AS (SELECT win, src_ip, col FROM own JOIN bits USING (win, arr, row) GROUP BY ALL HAVING count(*) = 5), used AS (SELECT win, src_ip, count(*) AS used FROM c GROUP BY ALL),
d AS (SELECT win, -{width} * ln(v * (2 - v)) AS delta FROM (SELECT win, CAST({width * rows} - count(*) AS DOUBLE) / {width * rows} AS v FROM bits WHERE arr = 4 GROUP BY ALL))
SELECT CAST(win AS BIGINT) AS win, src_ip, CAST(floor({width} * ln({float(width)} / greatest({width} - used, 1)) - delta) AS BIGINT) AS est
FROM used JOIN d USING (win) WHERE {width} - used < floor({width} * exp(-(3 + delta) / {width}))"""


def oracle_sql() -> dict[str, str]:
    out = {f"{name}_{m}": _query(name, m) for name in QUERIES for m in ("itw", "isw", "tw1", "otw", "osw")}
    out |= {f"{name}_{m}": _switch(name, m) for name in QUERIES for m in ("tw1a", "tw2a", "otwa", "oswa")}
    flow, pair = ", ".join(FLOW), ", ".join(PAIR)
    out["flow_size_isw"] = f"{_flow_windows()} SELECT * FROM f"
    out["heavy_hitters_isw"] = f"{_flow_windows()} SELECT DISTINCT {flow} FROM f WHERE bytes > 45"
    out["heavy_hitters_tw"] = f"{_flow_windows()} SELECT DISTINCT {flow} FROM f WHERE bytes > 45 AND (win + 1) % {N} = 0"
    out["superspreaders_isw"] = _spread("")
    out["superspreaders_tw"] = _spread(f" AND (win + 1) % {N} = 0")
    out["cardinality_isw"] = f"{_flow_windows()} SELECT win, count(*) AS flows FROM f GROUP BY win"
    every = " UNION ALL ".join(_sets(name, m) for name in QUERIES for m in ("itw", "tw1", "otw", "osw"))
    real = " UNION ALL ".join(_sets(name, "isw") for name in QUERIES)
    out["pr_report"] = f"""WITH r AS ({every}), b AS ({real}), n AS (SELECT query, count(*) AS real FROM b GROUP BY query)
SELECT r.query, r.mechanism, round(coalesce(CAST(count(b.key) AS DOUBLE) / nullif(count(*), 0), 1.0), 9) AS precision, round(coalesce(CAST(count(b.key) AS DOUBLE) / nullif(any_value(n.real), 0), 1.0), 9) AS recall
FROM r LEFT JOIN b ON r.query = b.query AND r.key = b.key JOIN n ON n.query = r.query GROUP BY r.query, r.mechanism"""
    out["pr_windows"] = f"""WITH r AS (SELECT win, dst_ip FROM ({_query('ddos', 'osw')})), b AS (SELECT win, dst_ip FROM ({_query('ddos', 'isw')})),
m AS (SELECT coalesce(r.win, b.win) AS win, r.dst_ip IS NOT NULL AS f, b.dst_ip IS NOT NULL AS t FROM r FULL JOIN b ON r.win = b.win AND r.dst_ip = b.dst_ip),
c AS (SELECT win, count(*) FILTER (WHERE f AND t) AS tp, count(*) FILTER (WHERE f AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT f) AS fn FROM m GROUP BY win)
SELECT *, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 1.0), 9) AS precision, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 1.0), 9) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END, 9) AS f1 FROM c"""
    switch = ("tw1a", "tw2a", "otwa", "oswa", "itw")
    every = " UNION ALL ".join(_sets(name, m) for name in QUERIES for m in switch)
    cells = ", ".join(f"max(CASE WHEN mechanism = '{m}' THEN round({c}, 6) END) AS {c}_{m}" for c in ("precision", "recall") for m in switch)
    out["pr_table"] = f"""WITH r AS ({every}), b AS ({real}), n AS (SELECT query, count(*) AS real FROM b GROUP BY query),
m AS (SELECT r.query, r.mechanism, CAST(count(b.key) AS DOUBLE) / count(*) AS precision, CAST(count(b.key) AS DOUBLE) / any_value(n.real) AS recall
FROM r LEFT JOIN b ON r.query = b.query AND r.key = b.key JOIN n ON n.query = r.query GROUP BY r.query, r.mechanism) SELECT query, {cells} FROM m GROUP BY query"""
    means = []
    for m, sql in (("osw", _query("ddos", "osw")), ("oswa", _switch("ddos", "oswa"))):
        means.append(f"""SELECT '{m}' AS mechanism, round(avg(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 1.0)), 9) AS precision, round(avg(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 1.0)), 9) AS recall
FROM (SELECT coalesce(r.win, b.win) AS win, count(*) FILTER (WHERE r.win IS NOT NULL AND b.win IS NOT NULL) AS tp, count(*) FILTER (WHERE b.win IS NULL) AS fp, count(*) FILTER (WHERE r.win IS NULL) AS fn
FROM ({sql}) r FULL JOIN ({_query('ddos', 'isw')}) b ON r.win = b.win AND r.dst_ip = b.dst_ip GROUP BY 1)""")
    out["pr_average"] = " UNION ALL ".join(means)
    share = "SELECT '{0}' AS measure, round(coalesce(CAST((SELECT count(*) FROM ({2})) AS DOUBLE) / nullif((SELECT count(*) FROM ({1})), 0), 1.0), 9) AS recall"
    out["ideal_recall"] = " UNION ALL ".join(share.format(x, out[f"{x}_isw"], out[f"{x}_tw"]) for x in ("heavy_hitters", "superspreaders"))
    found, exact, aligned = (f"SELECT DISTINCT src_ip FROM ({x})" for x in (_switch("superspreader", "oswa"), _query("superspreader", "isw"), _query("superspreader", "itw")))
    out["restricted_tp"] = f"""WITH r AS ({found}), b AS ({exact}), a AS ({aligned}) SELECT (SELECT count(*) FROM r WHERE src_ip IN (FROM b) AND src_ip IN (FROM a)) AS tp,
(SELECT count(*) FROM r WHERE src_ip NOT IN (FROM b)) AS fp, (SELECT count(*) FROM b WHERE src_ip NOT IN (FROM r)) AS fn"""
    out["relative_errors"] = f"{_HEAD}, {_count_min('SELECT * FROM p', PAIR, 2, 61)} SELECT {pair}, round(CAST(abs(est - exact) AS DOUBLE) / exact, 9) AS error FROM e"
    panes = _spread_sketch("SELECT * FROM p WHERE pane < closed", "pane", 1)
    out["spread_merged"] = f"""SELECT win, src_ip, CAST(sum(est) AS BIGINT) AS est FROM ({panes}) s JOIN (SELECT CAST(unnest(range((SELECT max(closed) FROM ({_HEAD} SELECT closed FROM p)))) AS BIGINT) AS win) w
ON w.win BETWEEN pane AND pane + {N - 1} WHERE win >= {N - 1} GROUP BY ALL HAVING sum(est) > 4"""
    out["collapse_stride"] = f"""SELECT DISTINCT s.step, dst_ip FROM ({_query('new_tcp_connections', 'isw')}) r JOIN (SELECT CAST(unnest(range(1000)) AS BIGINT) AS step) s ON win BETWEEN 4 + 3 * s.step AND 8 + 3 * s.step"""
    out["topk_hotkeys"] = f"{_HEAD} SELECT src_ip, dst_port, count(*) AS packets FROM p GROUP BY ALL ORDER BY packets DESC, src_ip, dst_port LIMIT 25"
    out["pinned_hotkeys"] = f"""{_HEAD}, h AS (SELECT src_ip, dst_port FROM p GROUP BY ALL ORDER BY count(*) DESC, src_ip, dst_port LIMIT 25),
c AS (SELECT turn AS win, src_ip, dst_port, count(*) AS packets FROM p WHERE turn < turns GROUP BY ALL),
w AS (SELECT unnest(range((SELECT max(turns) FROM p))) AS win), k AS (SELECT win, src_ip, dst_port FROM w, h UNION SELECT win, src_ip, dst_port FROM c)
SELECT CAST(win AS BIGINT) AS win, src_ip, dst_port, coalesce(packets, 0) AS packets FROM k LEFT JOIN c USING (win, src_ip, dst_port)"""
    out["quantile_vals"] = f"""{_HEAD}, s AS (SELECT turn AS win, src_ip, CAST(sum(size) AS BIGINT) AS bytes FROM p WHERE turn < turns GROUP BY ALL), l AS (SELECT win, list_sort(list(bytes)) AS v FROM s GROUP BY win)
SELECT CAST(win AS BIGINT) AS win, share, v[CAST(floor(len(v) * share) AS BIGINT) + 1] AS value FROM l, (SELECT CAST(unnest([0.5, 0.9, 0.99]) AS DOUBLE) AS share)"""
    out["cm_point"] = f"{_HEAD}, {_count_min('SELECT * FROM p', PAIR, DEPTH, WIDTH)} SELECT {pair}, est, exact FROM e"
    out["cm_merged"] = _merged("")
    out["hh_merged"] = _merged(" HAVING sum(est) > 100", " AND est > 20")
    for name, n in (("bloom_distinct", 1), ("bloom_distinct_2", 2)):
        out[name] = f"{_HEAD}, {_bloom(n, 1024 * n)} SELECT CAST(win AS BIGINT) AS win, dst_ip, count(*) AS srcs FROM new GROUP BY ALL"
    folded = "(dst_ip % 2147483647)"
    listed = " OR ".join(f"row_number() OVER (PARTITION BY win, {position_sql(folded, i, 17)} ORDER BY us, seq) = 1" for i in range(2))
    counts = _count_min("SELECT win, dst_ip, 1 AS size FROM new", ["dst_ip"], 2, 17, "win, ")
    out["data_plane_ddos"] = f"{_HEAD}, {_bloom(2, 4096)}, k AS (SELECT win, dst_ip FROM new QUALIFY {listed}), {counts} SELECT CAST(win AS BIGINT) AS win, dst_ip, est FROM e WHERE (win, dst_ip) IN (SELECT (win, dst_ip) FROM k)"
    whole = f"SELECT * FROM ({_SLIDING}) WHERE win >= {N - 1}"
    key = fold_sql(*FLOW)
    out["lc_card"] = f"""{_HEAD} SELECT CAST(win AS BIGINT) AS win, CAST(floor(-65537 * ln(CAST(nullif(65537 - count(DISTINCT {position_sql(key, 0, 65537)}), 0) AS DOUBLE) / 65537)) AS BIGINT) AS est FROM ({whole}) GROUP BY win"""
    x = position_sql(key, 1, 2**31 - 1)
    out["hll_card"] = f"""{_HEAD}, g AS (SELECT win, {position_sql(key, 0, 4099)} AS pos, {x} AS x FROM ({whole})), m AS (SELECT win, pos, max({trailing_zeros_sql('x')} + 1) AS rank FROM g GROUP BY win, pos),
s AS (SELECT win, count(*) AS used, sum(pow(0.5, rank)) AS power FROM m GROUP BY win) SELECT CAST(win AS BIGINT) AS win, {hyperloglog_sql(4099)} AS est FROM s"""
    out["mrb_card"] = f"{_HEAD}, {_resolution(whole, key, 'win')} SELECT CAST(win AS BIGINT) AS win, {SHAPE.estimate_sql([f's{i}' for i in range(SHAPE.levels)])} AS est FROM z"
    out["vbf_spread"] = _vector()
    out["spread_candidates"] = _spread_sketch()
    out["loss_anti"] = f"{_HEAD} SELECT seq, {flow} FROM p WHERE seq % 97 = 0"
    out["ibf_cells"] = f"{_HEAD}, c AS ({_cells('seq % 97 = 0')}) SELECT CAST(row AS INTEGER) AS row, pos, count(*) AS count, bit_xor(seq) AS ids FROM c GROUP BY row, pos"
    out["ibf_decode"] = f"{_HEAD} SELECT seq FROM p WHERE seq % 97 = 0"
    single = _count_min("SELECT * FROM p", ["dst_ip"], DEPTH, WIDTH)
    out["lookup_vs_dump"] = f"{_HEAD}, {single} SELECT plan, dst_ip, est FROM e, (SELECT unnest(['lookup', 'dump', 'candidates']) AS plan)"
    turn = f"(pos * {N} // 257)"
    places = " UNION ALL ".join(f"SELECT pane, {i} AS row, {position_sql('(dst_ip % 2147483647)', i, 257)} AS pos, size FROM p WHERE pane < closed" for i in range(2))
    out["sliding_cm"] = f"""{_HEAD}, c AS ({places}) SELECT win, CAST(row AS INTEGER) AS row, pos, CAST(sum(size) AS BIGINT) AS val FROM c JOIN (SELECT CAST(unnest(range((SELECT max(closed) FROM p))) AS BIGINT) AS win) w
ON w.win >= c.pane AND c.pane > win - ((win - {turn}) % {N} + {N}) % {N} - {N} GROUP BY ALL"""
    every = "SELECT * FROM p WHERE pane < closed"
    held = _held(f"SELECT DISTINCT pane, {position_sql(key, 0, 65537)} AS pos FROM ({every})", f"(pos * {N} // 65537)")
    out["sliding_lc"] = f"{_HEAD} SELECT win, CAST(floor(-65537 * ln(CAST(nullif(65537 - count(DISTINCT pos), 0) AS DOUBLE) / 65537)) AS BIGINT) AS est FROM ({held}) GROUP BY win"
    held = _held(f"SELECT pane, {position_sql(key, 0, 4099)} AS pos, {position_sql(key, 1, 2**31 - 1)} AS x FROM ({every})", f"(pos * {N} // 4099)")
    out["sliding_hll"] = f"""{_HEAD}, m AS (SELECT win, pos, max({trailing_zeros_sql('x')} + 1) AS rank FROM ({held}) GROUP BY win, pos),
s AS (SELECT win, count(*) AS used, sum(pow(0.5, rank)) AS power FROM m GROUP BY win) SELECT win, {hyperloglog_sql(4099)} AS est FROM s"""
    out["sliding_vbf"] = _vector(True)
    out["sliding_ss"] = _spread_sketch(every, turn=f"(pos * {N} // 257)")
    out["loss_report"] = f"""{_HEAD}, b AS (SELECT DISTINCT {flow} FROM p WHERE pane < closed AND seq % 97 = 0),
r AS (SELECT DISTINCT {flow} FROM p, t WHERE pane < closed AND (seq % 97 = 0 OR (us - t0) % {PANE} + {LATE} >= {PANE})),
c AS (SELECT (SELECT count(*) FROM r SEMI JOIN b USING ({flow})) AS tp, (SELECT count(*) FROM r ANTI JOIN b USING ({flow})) AS fp, (SELECT count(*) FROM b ANTI JOIN r USING ({flow})) AS fn)
SELECT *, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 1.0), 9) AS precision, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 1.0), 9) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END, 9) AS f1 FROM c"""
    out["pinned_sliding"] = f"""{_HEAD}, h AS (SELECT src_ip, dst_port FROM p GROUP BY ALL ORDER BY count(*) DESC, src_ip, dst_port LIMIT 25),
c AS (SELECT win, src_ip, dst_port, count(*) AS packets FROM ({_SLIDING}) GROUP BY ALL), w AS (SELECT unnest(range((SELECT max(closed) FROM p))) AS win),
k AS (SELECT win, src_ip, dst_port FROM w, h UNION SELECT win, src_ip, dst_port FROM c)
SELECT CAST(win AS BIGINT) AS win, src_ip, dst_port, coalesce(packets, 0) AS packets FROM k LEFT JOIN c USING (win, src_ip, dst_port)"""
    out["drifting"] = f"""WITH RECURSIVE packets AS ({PACKETS_SQL}), s AS (SELECT min(us) AS start FROM packets UNION ALL SELECT (SELECT min(us) FROM packets WHERE us > s.start + {PANE}) FROM s WHERE s.start IS NOT NULL),
n AS (SELECT start, lead(start) OVER (ORDER BY start) AS until, row_number() OVER (ORDER BY start) - 1 AS pane FROM s WHERE start IS NOT NULL)
SELECT pane, start, count(*) AS packets FROM n JOIN packets ON us >= start AND (until IS NULL OR us < until) GROUP BY ALL"""
    out["keys_extracted"] = f"{_HEAD} SELECT {flow}, us, seq FROM p QUALIFY row_number() OVER (PARTITION BY {flow} ORDER BY us, seq) = 1"
    out["error_report"] = f"{_HEAD}, {_count_min(_TUMBLING, PAIR, 2, 61, 'win, ')} SELECT CAST(win AS BIGINT) AS win, round(avg(CAST(abs(est - exact) AS DOUBLE) / exact), 6) AS are FROM e GROUP BY win"
    return out


