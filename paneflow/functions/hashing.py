"""Hashes that any engine computes alike, and the CRC family."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashes are arithmetic modulo this prime, 2**31 - 1, so that products stay within 64 bits.
PRIME = 2**31 - 1


def factors(row: int) -> tuple[int, int, int]:
    """First factor, offset and second factor (below 2**30) of the hash of a sketch's row, by a rule: powers of primitive roots."""
    return pow(48_271, 3 * row + 5, PRIME), pow(69_621, row + 3, PRIME), pow(39_373, 5 * row + 7, PRIME) % 2**30


def fold_sql(*columns: str) -> str:
    """SQL of one whole number below 2**31 for some columns of whole numbers."""
    out = "CAST(0 AS BIGINT)"
    for c in columns:
        out = f"(({out} * 1000003 + {c}) % {PRIME})"
    return out


def position_sql(folded: str, row: int, width: int) -> str:
    """SQL of the position of a folded key in a row of a sketch. Two rounds, so that keys in a row don't give positions in a row."""
    a, b, c = factors(row)
    x = f"(({folded} * {a} + {b}) % {PRIME})"
    return f"((({x} + ({x} >> 13)) * {c} % {PRIME}) % {width})"


def fold(*columns: str) -> Column:
    return F.expr(fold_sql(*columns))


def position(folded: str, row: int, width: int) -> Column:
    return F.expr(position_sql(folded, row, width))


def next_prime(n: int) -> int:
    """The least prime that is at least n; sketches round their widths up to it."""
    n = max(n, 2)
    while any(n % i == 0 for i in range(2, int(n**0.5) + 1)):
        n += 1
    return n


# Name, polynomial, initial value, reflected, final exclusive-or, of the 32-bit CRCs.
CRCS = {
    "crc32": (0x04C11DB7, 0xFFFFFFFF, True, 0xFFFFFFFF),
    "crc32c": (0x1EDC6F41, 0xFFFFFFFF, True, 0xFFFFFFFF),
    "crc32d": (0xA833982B, 0xFFFFFFFF, True, 0xFFFFFFFF),
    "jamcrc": (0x04C11DB7, 0xFFFFFFFF, True, 0x00000000),
    "xfer": (0x000000AF, 0x00000000, False, 0x00000000),
    "posix": (0x04C11DB7, 0x00000000, False, 0xFFFFFFFF),
    "bzip2": (0x04C11DB7, 0xFFFFFFFF, False, 0xFFFFFFFF),
    "mpeg": (0x04C11DB7, 0xFFFFFFFF, False, 0x00000000),
    "crc32q": (0x814141AB, 0x00000000, False, 0x00000000),
}


def crc(data: bytes, kind: str = "crc32") -> int:
    """One of the 32-bit CRCs of some bytes."""
    poly, value, reflected, final = CRCS[kind]
    if reflected:
        poly = int(f"{poly:032b}"[::-1], 2)
        for byte in data:
            value ^= byte
            for _ in range(8):
                value = value >> 1 ^ (poly if value & 1 else 0)
    else:
        for byte in data:
            value ^= byte << 24
            for _ in range(8):
                value = (value << 1 ^ (poly if value >> 31 else 0)) & 0xFFFFFFFF
    return value ^ final


def crc_column(data: Column, kind: str = "crc32") -> Column:
    """The CRC of a binary column; crc32 is Spark's own function, the others are worked out in Arrow batches."""
    if kind == "crc32":
        return F.crc32(data)
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else crc(x, kind)).astype("Int64"), T.LongType())(data)


def format_ip(ip: str) -> Column:
    """Dotted form of a 32-bit address."""
    return F.concat_ws(".", *(F.shiftright(F.col(ip), n).bitwiseAND(255).cast("string") for n in (24, 16, 8, 0)))


def parse_ip(text: str) -> Column:
    """32-bit address of the dotted form."""
    parts = F.split(F.col(text), r"\.")
    return sum((parts[i].cast("long") * 256 ** (3 - i) for i in range(1, 4)), parts[0].cast("long") * 256**3)


def trailing_zeros_sql(x: str) -> str:
    """SQL of the number of zero bits below the lowest one of x > 0; 31 for 0."""
    return f"CASE WHEN {x} = 0 THEN 31 ELSE bit_count(({x} & -({x})) - 1) END"


def trailing_ones_sql(x: str) -> str:
    return f"bit_count(({x} & ~({x} + 1)) & ((({x} + 1) & -({x} + 1)) - 1))"


def numpy_position(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    """position for an array of folded keys."""
    a, b, c = factors(row)
    x = (keys.astype(np.int64) * a + b) % PRIME
    return (x + (x >> 13)) * c % PRIME % width
