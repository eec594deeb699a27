"""Distinct word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import Memo

WIDTH = 5
_WORDS = Memo(lambda w: xxhash.xxh64_intdigest(w), 500_000)
forget = _WORDS.clear
ODD = np.uint64(0x9E3779B97F4A7C15)


def hashes(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hash and summed word bytes of every run of ``width`` lower-cased words; of all words where
    they are fewer; none without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = out * ODD + h[k : k + n]
        out ^= out >> np.uint64(32)
    if len(words) < width:
        out += np.uint64(len(words))
        return out * ODD, size[-1:]
    return out * ODD, size[width - 1 :] - np.concatenate([[0], size[:-width]])


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(hashes(text, width)[0])


def ranked(text: str | None, frequent: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """A text's ``shingles``, and the same in one global order as numbers in that order: the
    longest words first, as they are rarest; those in the sorted ``frequent`` hashes last."""
    h, size = hashes(text, width)
    h, first = np.unique(h, return_index=True)
    late = np.uint64(255) - np.minimum(size[first], 254).astype(np.uint64)
    if len(frequent) and len(h):
        at = np.searchsorted(frequent, h)
        at[at == len(frequent)] = 0
        late[frequent[at] == h] = 255
    return h, np.sort(late << np.uint64(56) | h >> np.uint64(8))


def key(sorted_hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return xxhash.xxh3_64_intdigest(sorted_hashes.tobytes()) - (1 << 63)


def similar(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, of sorted distinct hashes."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
