"""CRC-32C as Arrow functions: of binary values, and of moved values.

A CRC is linear over GF(2), so a long value is cut into equal stripes that are
looked up in lockstep by numpy, and stripes are joined by moving each one past the
bytes behind it.  Moving by ``n`` bytes multiplies by x^(8n); x has the order
2^31 - 1, so a negative ``n`` is a move too.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Reflected Castagnoli polynomial, and the order of x modulo it.  Fixed values.
POLYNOMIAL, ORDER = 0x82F63B78, 2**31 - 1
ONES = np.uint32(0xFFFFFFFF)
#: Bytes that one lockstep pass holds.
PASS_BYTES = 32 << 20


@cache
def byte_table() -> np.ndarray:
    """CRC of each byte alone."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


@cache
def mover(power: int) -> np.ndarray:
    """Tables (4, 256) that move a CRC by 2**power bytes, one for each of its bytes."""
    if power == 0:
        values = np.arange(256, dtype=np.uint32)
        return np.stack([byte_table()[(v := values << np.uint32(8 * i)) & 255] ^ (v >> np.uint32(8)) for i in range(4)])
    half = mover(power - 1)
    return _through(half, half.reshape(-1)).reshape(4, 256)


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def move(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC moved by ``n`` bytes, either sign."""
    crc, n = crc.astype(np.uint32), np.mod(n, ORDER)
    for power in range(31):
        at = (n >> power) & 1 == 1
        if at.any():
            crc[at] = _through(mover(power), crc[at])
    return crc


def crcs(values: list[bytes]) -> np.ndarray:
    """CRC-32C of each value; an empty one has 0."""
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(len(values), dtype=np.uint32)
    # At most about a quarter of a value, else many short values would be mostly the zeros before them.
    stripe = 1 << int(np.clip(np.log2(min(sizes.sum() / 4096, sizes.mean() / 4) + 1), 4, 12))
    counts = np.maximum(-(-sizes // stripe), 1)
    ends = np.cumsum(counts)
    buffer = np.zeros(int(ends[-1]) * stripe, dtype=np.uint8)
    for value, end in zip(values, ends):  # zeros before a value don't change its CRC
        buffer[end * stripe - len(value) : end * stripe] = np.frombuffer(value, dtype=np.uint8)
    columns, table = np.ascontiguousarray(buffer.reshape(-1, stripe).T), byte_table()
    state = np.zeros(int(ends[-1]), dtype=np.uint32)
    for column in columns:
        state = table.take(state.astype(np.uint8) ^ column) ^ (state >> np.uint32(8))
    behind = (np.repeat(ends, counts) - 1 - np.arange(ends[-1])) * stripe
    whole = np.bitwise_xor.reduceat(move(state, behind), ends - counts)
    start = move(np.full(len(values), ONES), sizes)
    return np.where(sizes > 0, whole ^ start ^ ONES, 0).astype(np.uint32)


def _crcs(content: pd.Series) -> pd.Series:
    """CRC-32C of each value, null for null; passes are bounded by bytes, not by rows."""
    present = [bytes(v) for v in content if v is not None]
    parts, batch, held = [], [], 0
    for value in present:
        batch.append(value)
        held += len(value)
        if held >= PASS_BYTES:
            parts.append(crcs(batch))
            batch, held = [], 0
    if batch:
        parts.append(crcs(batch))
    found = iter(np.concatenate(parts).tolist() if parts else [])
    return pd.Series([None if v is None else next(found) for v in content], dtype="Int64")


def _moved(crc: pd.Series, n: pd.Series) -> pd.Series:
    known = (crc.notna() & n.notna()).to_numpy()
    out = pd.Series([pd.NA] * len(crc), dtype="Int64")
    if known.any():
        out[known] = move(crc[known].to_numpy(dtype=np.int64).astype(np.uint32), n[known].to_numpy(dtype=np.int64)).astype(np.int64)
    return out


@F.pandas_udf(LongType())
def crc32c(content: pd.Series) -> pd.Series:
    """CRC-32C of a binary value, null for null."""
    return _crcs(content)


@F.pandas_udf(LongType())
def crc32c_shift(crc: pd.Series, n: pd.Series) -> pd.Series:
    """``crc`` as it counts with ``n`` bytes behind it (before it, if negative); null if either is."""
    return _moved(crc, n)


@F.pandas_udf(LongType())
def crc32c_moved(content: pd.Series, n: pd.Series) -> pd.Series:
    """``crc32c_shift(crc32c(content), n)`` in one Python worker; Spark gives each of two that are nested a worker of its own."""
    return _moved(_crcs(content), n)
