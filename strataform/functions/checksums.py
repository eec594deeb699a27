"""CRC-32 (built in) and CRC-32C (table driven), the windowed rolling hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The reversed Castagnoli polynomial; the rolling hash's base.
CASTAGNOLI = 0x82F63B78
BASE = 0x9E3779B97F4A7C15


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        out = np.where(out & np.uint64(1), (out >> np.uint64(1)) ^ np.uint64(CASTAGNOLI), out >> np.uint64(1))
    return out.astype(np.uint32)


_CRC32C = _table()


def _advance() -> np.ndarray:
    """By byte of the register, what it becomes after ``STRIDE`` zero bytes: a linear map."""
    one = np.arange(256, dtype=np.uint32)
    out = np.stack([one << np.uint32(8 * k) for k in range(4)])
    for _ in range(STRIDE):
        out = _CRC32C[out & np.uint32(255)] ^ out >> np.uint32(8)
    return out


STRIDE = 256
_ADVANCE = _advance()


def crc32c_many(contents: list[bytes]) -> list[int]:
    """Castagnoli CRC of each content. Contents are cut from their ends into runs of ``STRIDE`` bytes, all runs
    go through the table side by side, and a content's runs are joined by the map of ``STRIDE`` zero bytes."""
    lead = [(4, b"\xff" * 4)]  # the register begins with ones, which is to flip the first four bytes
    rows = []
    for x in contents:
        x = x.ljust(4, b"\0") if len(x) < 4 else x
        rows.append(bytes(a ^ b for a, b in zip(x[:4], lead[0][1])) + x[4:])
    n = [-(-len(x) // STRIDE) for x in rows]
    runs = np.frombuffer(b"".join(x.rjust(k * STRIDE, b"\0") for x, k in zip(rows, n)), np.uint8).reshape(-1, STRIDE)
    reg = np.zeros(len(runs), np.uint32)
    for t in range(STRIDE):
        reg = _CRC32C[(reg ^ runs[:, t]) & np.uint32(255)] ^ reg >> np.uint32(8)
    first = np.cumsum([0, *n])[:-1]
    order = np.argsort(-np.array(n, np.int64), kind="stable")
    out = np.zeros(len(rows), np.uint32)
    for j in range(max(n, default=0)):  # the j-th run of every content that has one
        some = order[: np.searchsorted(-np.array(n)[order], -j, "left")]
        c = out[some]
        c = _ADVANCE[0][c & 255] ^ _ADVANCE[1][c >> 8 & 255] ^ _ADVANCE[2][c >> 16 & 255] ^ _ADVANCE[3][c >> 24]
        out[some] = c ^ reg[first[some] + j]
    # shorter than four bytes: bit by byte from the register of ones
    return [crc32c_short(x) if len(x) < 4 else int(c) ^ 0xFFFFFFFF for x, c in zip(contents, out.tolist())]


def crc32c_short(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = int(_CRC32C[(c ^ b) & 255]) ^ c >> 8
    return c ^ 0xFFFFFFFF


def crc32(data: Column) -> Column:
    return F.crc32(data)


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """Castagnoli CRC of a binary column; null stays null."""
    out = pd.Series([None] * len(data), dtype="Int64")
    some = np.flatnonzero(data.notna())
    for at in range(0, len(some), 512):
        part = some[at : at + 512]
        out.iloc[part] = crc32c_many([bytes(data.iloc[i]) for i in part])
    return out


def rolling(data: np.ndarray, window: int) -> np.ndarray:
    """At each position, the polynomial hash modulo 2 ** 64 of the last ``window`` bytes, fewer at the start."""
    out = np.zeros(len(data), np.uint64)
    x = data.astype(np.uint64)
    for k in range(min(window, len(data)) - 1, -1, -1):
        out *= np.uint64(BASE)
        out[k:] += x[: len(x) - k]
    return out
