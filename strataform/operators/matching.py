"""Repeated substrings: greedy hash-chain matches and the hashed duplicate counter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.functions.checksums import rolling

from .apply import table_function


def matches_of(raw: bytes, least: int = 4, depth: int = 64, most: int = 4096, window: int = 1 << 24) -> list[tuple[int, int, int]]:
    """(pos, length, distance): at each position the longest earlier copy among the ``depth``
    latest places with its folded 4-byte hash; the nearest among equals; matches are skipped over."""
    n, out = len(raw), []
    if n < 4:
        return out
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    word = x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]
    keys = ((word ^ word >> 16) & 0xFFFF).tolist()
    head: dict[int, int] = {}
    older = [-1] * n
    pos = 0
    while pos + 3 < n:
        best, dist, cand = 0, 0, head.get(keys[pos], -1)
        for _ in range(depth):
            if cand < 0 or pos - cand > window:
                break
            if pos + best < n and raw[cand + best] == raw[pos + best]:
                size, step = 0, 16
                limit = min(most, n - pos)
                while size < limit:
                    step = min(16, limit - size)
                    a, b = raw[cand + size : cand + size + step], raw[pos + size : pos + size + step]
                    if a == b:
                        size += step
                        continue
                    size += next(i for i in range(step) if a[i] != b[i])
                    break
                if size > best:
                    best, dist = size, pos - cand
            cand = older[cand]
        taken = best if best >= least else 1
        for k in range(pos, min(pos + taken, n - 3)):
            older[k] = head.get(keys[k], -1)
            head[keys[k]] = k
        if best >= least:
            out.append((pos, best, dist))
        pos += taken
    return out


def rebuild(raw_literals: bytes, n: int, matches: list[tuple[int, int, int]]) -> bytes:
    """The content from the bytes outside the matches and the matches."""
    out, used = bytearray(), 0
    for pos, size, dist in matches:
        lead = pos - len(out)
        out += raw_literals[used : used + lead]
        used += lead
        for _ in range(size):
            out.append(out[-dist])
    return bytes(out + raw_literals[used : used + n - len(out)])


def hash_chain_matches(df: DataFrame, key: str, content: str, **options: int) -> DataFrame:
    return table_function(df, key, content, lambda raw: matches_of(raw, **options), "pos long, length long, distance long")


def match_stats(matches: DataFrame, key: str) -> DataFrame:
    return matches.groupBy(key).agg(F.count("*").alias("matches"), F.sum("length").alias("match_bytes"))


def repeats_of(raw: bytes, window: int = 16, slots: int = 1 << 20) -> int:
    """Windows whose hash slot was met before, without checking the bytes; early windows are shorter."""
    x = np.frombuffer(raw, np.uint8)
    if len(x) < window:
        return 0
    h = (rolling(x, window)[: len(x) - window + 1] & np.uint64(slots - 1)).astype(np.int64)
    return len(h) - len(np.unique(h))


def rolling_repeats(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, matches, match_bytes) of the hashed duplicate counter."""
    return table_function(df, key, content, lambda raw: [(m := repeats_of(raw), 16 * m)], "matches long, match_bytes long")
