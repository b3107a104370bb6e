"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage

#: The six ASCII white-space bytes that separate words: space, and \t \n \v \f \r.
WHITE = b"\t\n\x0b\x0c\r "
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True
#: One fixed 64-bit number for each byte value, and an odd base, for polynomial hashes modulo 2**64.
BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, after which shuffle files that nothing refers to any more are freed."""
    out = lineage.cut(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def tidy(run: Callable) -> Callable:
    """run, for Arrow batches or one Arrow table, after which the worker hands memory that it no longer uses back to the machine."""

    def hand_back():
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # other C libraries
            ctypes.CDLL(None).malloc_trim(0)

    def over(batches):
        yield from run(batches)
        hand_back()

    def once(table):
        out = run(table)
        hand_back()
        return out

    return over if inspect.isgeneratorfunction(run) else once


def text_volume(docs: DataFrame) -> tuple[int, int]:
    """Rows of docs and bytes of its texts."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def portions(batches, limit: int = 4 << 20):
    """The rows in batches of about `limit` characters of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
        for a, b in groups_of(sizes, limit):
            yield batch.slice(a, b - a)


#: Bits of the filter that tells most rows that a join will not want: 4 MB, whatever the data.
FILTER_BITS = 1 << 25


def filter_place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def filter_bits(keys: DataFrame, key: str) -> np.ndarray:
    """The bits at the places of the keys. A place may be another key's as well, so the rows that pass still have to be joined."""
    at = keys.select(filter_place(F.col(key)).alias("at")).select(F.expr("at div 32768").alias("part"), F.expr("at % 32768").alias("at"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in at.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect():  # FILTER_BITS in all at most
        out[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (multiply and shift)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def spans_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each codes[start:end], which depends on the content only."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, maximal runs of other than white-space bytes."""
    white = np.ones(len(data) + 2, np.int8)
    white[1:-1] = _IS_WHITE[data]
    step = np.diff(white)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def word_hashes(text: bytes, limit: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word; works through long texts in slices that end at white space."""
    out, at = [], 0
    data = np.frombuffer(text, np.uint8)
    while at < len(data):
        end = min(len(data), at + limit)
        while end < len(data) and not _IS_WHITE[data[end]]:
            end += 1
        starts, ends = word_bounds(data[at:end])
        out.append((starts + at, ends + at, spans_hash(BYTE_CODES[data[at:end]], starts, ends)))
        at = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def groups_of(sizes: list[int], limit: int):
    """Consecutive index ranges whose sizes add up to about limit."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)
