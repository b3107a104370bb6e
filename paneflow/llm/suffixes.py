"""Suffix-array dedup by bytes: two-stage suffix sorting (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table, tidy
from .repeats import Bytes, bytes_of, covered, occurrences, parted, repeated_windows

WINDOW = 50
MINIMISER = 25


def smaller_than_successor(codes: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the suffix that starts one further on; the last counts as smaller."""
    change = np.flatnonzero(codes[:-1] != codes[1:])
    out = np.ones(len(codes), bool)
    if len(change):
        out[: change[-1] + 1] = np.repeat(codes[change] < codes[change + 1], np.diff(change, prepend=-1))
    return out


def _chunks(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position, as numbers that compare as the bytes do."""
    return sliding_window_view(padded, 8)[at].view(">u8").ravel().astype(np.uint64)


def _sort_directly(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the `depth` bytes that follow; after each eight bytes only ties go on."""
    key = _chunks(padded, at)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    for more in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        i = np.flatnonzero(tied)
        if not len(i):
            break
        group = np.cumsum(new)[i]
        key = _chunks(padded, at[i] + more)
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(group[order], kind="stable")]
        at[i], key, group = at[i][order], key[order], group[order]
        new[i[1:]] |= (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    return at


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of codes (8-bit, 0 after each string) in the order of their first `depth` symbols.

    Two-stage sorting: the suffixes smaller than their successors are sorted directly. A scan over the buckets by first
    symbol then puts each larger suffix behind those already in its bucket, as its successor is met.
    """
    padded = np.concatenate([codes, np.zeros(depth + 16, np.uint8)])
    smaller = smaller_than_successor(codes)
    direct = _sort_directly(padded, np.flatnonzero(smaller & (codes > 0)), depth)
    edges = np.searchsorted(codes[direct], np.arange(257))
    waiting: list[list] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        larger = waiting[c]
        if c and not larger and edges[c] == edges[c + 1]:
            continue
        last = np.concatenate(larger) if larger else np.zeros(0, np.int64)
        larger = [last]
        while len(last):  # runs of one symbol
            last = last[last > 0] - 1
            last = last[(codes[last] == c) & ~smaller[last]]
            larger.append(last)
        scanned = np.concatenate([*larger, direct[edges[c] : edges[c + 1]] if c else np.flatnonzero(codes == 0)])
        waiting[c] = []
        if not len(scanned):
            continue
        out.append(scanned)
        before = scanned[scanned > 0] - 1
        before = before[codes[before] > c]
        if len(before):
            first = codes[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            at = np.flatnonzero(np.diff(first)) + 1
            for symbol, part in zip(first[np.concatenate(([0], at))].tolist(), np.split(before, at)):
                waiting[symbol].append(part)
    return np.concatenate(out)


def common_prefixes(codes: np.ndarray, suffixes: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, up to limit; 0 for the first."""
    padded = np.concatenate([codes, np.zeros(limit + 16, np.uint8)])
    out = np.zeros(len(suffixes), np.int64)
    open_ = np.arange(1, len(suffixes))
    for at in range(0, limit, 8):
        a, b = _chunks(padded, suffixes[open_] + at), _chunks(padded, suffixes[open_ - 1] + at)
        differ = a ^ b
        equal = np.full(len(open_), 8)
        some = differ > 0
        if some.any():  # leading zero bytes of the difference
            equal[some] = np.argmax(differ[some].astype(">u8").view(np.uint8).reshape(-1, 8) > 0, axis=1)
        out[open_] += equal
        open_ = open_[equal == 8]
    return np.minimum(out, limit)


def _least(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest doc_id of each string number."""
    out = np.full(int(code.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(out, code, doc)
    return out


def _settle(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the occurrences in a batch all but those in the smallest doc_id are settled."""
    first = doc == _least(code, doc)[code]
    return ~first, first, np.zeros(len(code), bool)


def _resolver(k: int):
    """Sorts the suffixes of the strings: a window that a smaller document has as well goes."""

    def resolve(strings: pa.Array, code: np.ndarray, doc: np.ndarray, start: np.ndarray, tells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = bytes_of(strings)
        length = np.diff(offsets)
        codes = parted(data + np.uint8(1), offsets, 0)  # UTF-8 has no byte 255
        offsets = offsets[:-1] + np.arange(len(length))
        least = _least(code, doc)
        order = suffix_array(codes, k)
        string = np.searchsorted(offsets, order, "right") - 1
        whole = order - offsets[string] + k <= length[string]
        order, string = order[whole], string[whole]
        head = np.flatnonzero(common_prefixes(codes, order, k) < k)
        first_doc = np.repeat(np.minimum.reduceat(least[string], head), np.diff(head, append=len(order)))
        later = first_doc < least[string]
        window, string = (order - offsets[string])[later], string[later]
        first = doc == least[code]
        which, at = occurrences(code, np.flatnonzero(first), string)
        greater = np.flatnonzero(~first)  # of these all windows go
        rows = np.concatenate((greater, at))
        a = np.concatenate((start[greater], start[at] + window[which]))
        return rows, a, np.concatenate((start[greater] + length[code[greater]] - k + 1, start[at] + window[which] + 1))

    return resolve


def _keep(k: int):
    def run(batches):
        for batch in portions(batches):
            out = ([], [], [], [])
            for text, doc, found, copies in zip(*(batch.column(c).to_pylist() for c in ("text", "doc", "found", "copies"))):
                text = (text or "").encode()
                copy = len(text) >= k and doc is not None and doc in (copies or ())
                gone = [[0, len(text)]] if copy else covered(found, doc, k).tolist()
                parts, at = [], 0
                for a, b in gone:
                    parts.append(text[at:a])
                    at = b
                kept = b"".join([*parts, text[at:]])
                for o, v in zip(out, (len(text), len(text) - len(kept), len(gone), kept)):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(o, t) for o, t in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, hot_strings: int | None = None) -> DataFrame:
    """Removes each byte that a string of `window` bytes covers which also starts in a document with a smaller doc_id.

    docs needs doc_id and text; other columns are not read. Returns a row for each row: doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept (the remaining bytes; not always whole UTF-8). A null text counts as empty.
    Repeats within a document, and rows that repeat both doc_id and text, are kept, as no doc_id is smaller. A row with
    a null doc_id takes no part: it keeps its bytes and is not compared. An empty table gives an empty table.
    """
    more = {} if hot_strings is None else {"hot_strings": hot_strings}
    found = repeated_windows(docs, Bytes, window, min(minimiser, window), _settle, _resolver(window), first_stays=True, **more)
    return found.select("text", "doc", "found", "copies").mapInArrow(tidy(_keep(window)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT doc_id, i, h[2 * i + 1:2 * i + 100] AS win
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)
), f AS (
  SELECT hash(win) AS key, win, min(doc_id) AS first FROM s GROUP BY ALL HAVING count(*) > 1
), r AS (
  SELECT s.doc_id, s.i FROM s JOIN f ON s.win = f.win WHERE f.first < s.doc_id
), g AS (
  SELECT doc_id, i, CASE WHEN i - 50 > lag(i) OVER (PARTITION BY doc_id ORDER BY i) OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM r
), runs AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY ALL
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs
), kept AS (
  SELECT gaps.doc_id, string_agg(h[2 * p + 1:2 * a], '' ORDER BY a) AS head, max(b) AS b, count(*) AS n, sum(b - a) AS gone
  FROM gaps JOIN d ON gaps.doc_id = d.doc_id GROUP BY gaps.doc_id
)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || h[2 * coalesce(b, 0) + 1:len(h)])) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
