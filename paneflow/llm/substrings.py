"""Substring dedup by words: super-k-mer partitioning (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, spans_hash, table, tidy, word_hashes
from .repeats import Words, bytes_of, covered, occurrences, parted, repeated_windows

WINDOW = 35
MINIMISER = 12


def _settle(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string that occurs twice in a batch is a repeat wherever it occurs, and one row tells so; once is for the bucket to decide."""
    many = np.bincount(code)[code] > 1 if len(code) else np.zeros(0, bool)
    travel = ~many
    travel[np.unique(code, return_index=True)[1]] = True
    return many, travel, many


def _same_windows(text: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """A label for each window start in `at`, equal where the words are; sorted by hash, then compared in full."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    labels = np.empty(len(h), np.int64)
    labels[order] = group
    heads = order[np.flatnonzero(new)]
    a, b = starts[at], ends[at + k - 1]
    extra = len(heads)
    others: dict[tuple, int] = {}
    for i in order[~new].tolist():
        head = heads[labels[i]]
        if (window := text[a[i] : b[i]]) != text[a[head] : b[head]]:  # a collision of hashes
            labels[i] = others.setdefault((int(head), window), extra + len(others))
    return labels


def _resolver(k: int):
    """Sorts the windows of the strings by hash and compares them in full: what is there twice goes."""

    def resolve(strings: pa.Array, code: np.ndarray, doc: np.ndarray, start: np.ndarray, tells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = parted(*bytes_of(strings), 0x20).tobytes()
        offsets = np.concatenate(([0], np.cumsum(pc.binary_length(strings).to_numpy(zero_copy_only=False) + 1)))
        starts, ends, words = word_hashes(text)
        edges = np.searchsorted(starts, offsets)
        count = np.diff(edges) - k + 1
        string = np.repeat(np.arange(len(strings)), count)
        window = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
        at = window + edges[string]
        labels = _same_windows(text, starts, ends, at, spans_hash(words, at, at + k), k)
        weight = np.bincount(code, np.where(tells, 2, 1))
        again = np.bincount(labels, weight[string])[labels] > 1
        window = window[again]
        which, rows = occurrences(code, np.flatnonzero(~tells), string[again])
        return rows, start[rows] + window[which], start[rows] + window[which] + 1

    return resolve


def _keep(k: int):
    def run(batches):
        for batch in portions(batches):
            kept, total, gone = [], [], []
            for text, doc, found in zip(*(batch.column(c).to_pylist() for c in ("text", "doc", "found"))):
                words = (text or "").encode().split()
                total.append(len(words))
                parts, at = [], 0
                for a, b in covered(found, doc, k).tolist():
                    parts += words[at:a]
                    at = b
                parts += words[at:]
                gone.append(len(words) - len(parts))
                kept.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return run


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, hot_strings: int | None = None) -> DataFrame:
    """Removes each word that a window of `window` words covers whose words also start anywhere else.

    docs needs doc_id and text; other columns are not read, so their names may clash with anything. Returns a row for
    each row: doc_id, n_words, n_removed, text (the kept words joined by one space). A null or empty text has no words
    and gives an empty text. Texts shorter than the window keep all words. Rows that repeat another row's text lose
    every word that a window covers, as the windows start elsewhere too. A row with a null doc_id takes no part: it
    keeps its words and is not compared. An empty table gives an empty table.
    """
    more = {} if hot_strings is None else {"hot_strings": hot_strings}
    found = repeated_windows(docs, Words, window, min(minimiser, window), _settle, _resolver(window), first_stays=False, **more)
    return found.select("text", "doc", "found").mapInArrow(tidy(_keep(window)), "doc_id long, n_words long, n_removed long, text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM s) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM r, range(0, 35) AS t(j)
), word AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w
), kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS text, count(*) AS n
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i WHERE gone.i IS NULL GROUP BY word.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
