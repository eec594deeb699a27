"""Op 4: LM scoring by online logistic context mixing over the bits of whole texts.

A text is its lower-cased words, then one end token. A prefix code, built from the training
counts, turns a token into yes/no decisions (its bits): those of a frequent word's leaf, or
of an escape and then of the word's bytes. Four predictors look up counts of 0 and 1 in
hashed slots for a bit. For a word's bits their contexts are: none, the class of the text so
far, the word before, and the two words before; for a byte's bits: the byte before, the class and two
bytes, four bytes, and the word so far. Stretched probabilities are combined by weights that a
gate chooses by how often the two longest contexts were seen, and the sum is refined by an
adaptive map from (gate, sum) to the rate met there. While a text is scored, weights and
map go on learning from it after every bit. The score is the sum of the bits' log10
probabilities; each bit's depends on earlier ones only, so 10 ** score sums to one over all texts.

The class is the most likely one of the words so far, by the frequent words' shares in the
commonest values of ``lang`` in training. Online learning runs over segments of about
``SEGMENT`` bits, each begun with the trained weights (contexts reach back across segments), so a
long text is many short chains, and all segments of a batch advance a bit at a time side
by side. Texts above ``PIECE`` bytes are read in pieces of that size, which begin with empty contexts.

Learning reads all training texts: words and slots are counted over every occurrence, task by
task, and summed; weights and map are then learned online over all texts, each bit judged by
counts without itself, and averaged over tasks. What is sent to every worker is bounded: one
16-bit code a slot for both counts (6 to 13 million slots, by the number of distinct words), and
the most frequent words (``HEAD`` at most). Rarer words meet their counts for the base score in a join.

The walk over texts (counting, learning, scoring) is ``Mixing.java``, run in the executors' JVM; the plain numpy
version below (``Units``, ``Model``, ``Scorer``) is what it is tested against, and runs where ``NATIVE`` is false.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, sole
from .native import over_partitions
from .tokens import chunks

END = "\n"
ORDERS = 4
#: log2 of each predictor's slots at least; the last two grow with the words up to ``MOST_BITS``.
SIZES = (18, 22, 20, 20)
MOST_BITS = 22
CHUNK = 1 << 14
HEAD = 120_000
#: Words met less often are spelled, so that spelling is learned from words as rare as new ones.
LEAST = 4
#: Classes of documents at most, the last for all other values of ``lang``.
CLASSES = 8
GATES, APM = 72, 24
SEGMENT, PIECE, BATCH = 4096, 1 << 18, 1 << 21
#: Bytes whose contexts are made at a time; the longest run of bytes spelled after one escape.
STEP, LONG = 1 << 16, 1 << 16
#: Bits whose predictions are looked up at a time.
SOME = 1 << 15
#: Bits a step of learning.
RUN = 1 << 13
#: Whether texts are walked in the executors' JVM (``Mixing.java``) or by the plain version here, which tests hold it against.
NATIVE = True
#: Rates of the online steps: trained weights, weights and map while a text is scored.
LEARN, WEIGHT_RATE, MAP_RATE = 0.05, 0.01, 0.02
MIX, MIX2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
INVERSE = pow(int(MIX), -1, 1 << 32)
_SCORERS: dict[str, Scorer] = {}
#: What a worker that counts or learns gives up when another operator comes: it keeps nothing.
_STATELESS = dict[str, None]().clear


def stretch(p):
    return np.log(p / (1 - p))


def sizes_for(distinct: int) -> tuple[int, ...]:
    """log2 of the slots for a number of distinct words: four slots or more a word, within the bounds."""
    bits = min(MOST_BITS, max(SIZES[2], int(np.ceil(np.log2(max(1, 4 * distinct))))))
    return (*SIZES[:2], bits, bits)


def offsets(sizes: tuple[int, ...]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([1 << b for b in sizes])])


# the code


def paths(counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Huffman's code for counts, each raised by one: of each symbol its decisions' number, nodes (0 is the root) and bits."""
    n = len(counts)
    heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    up, bit_of = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    for inner in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y], bit_of[y] = inner, inner, 1
        heapq.heappush(heap, (a + b, inner))
    depth, nodes, bits = np.zeros(n, np.int64), [], []
    at, root = np.arange(n), 2 * n - 2
    while (live := at != root).any():  # all symbols climb a step
        depth += live
        bits.append(np.where(live, bit_of[at], 0))
        at = np.where(live, up[at], at)
        nodes.append(np.where(live, root - at, -1))
    return depth, nodes, bits


class Code:
    """Decisions of symbols: head words in order, the escape, then the 256 bytes; word and byte nodes are numbered apart."""

    def __init__(self, head_n: np.ndarray, escapes: int, byte_n: np.ndarray):
        self.escape = len(head_n)
        length, node, bit, base = [], [], [], 0
        for counts in (np.append(head_n, escapes), byte_n):
            depth, nodes, bits = paths(counts)
            own = np.repeat(np.arange(len(depth)), depth)
            j = depth[own] - 1 - (np.arange(len(own)) - np.repeat(np.cumsum(depth) - depth, depth))  # climbed last is first
            node.append((np.array(nodes, np.int64).reshape(-1, len(depth))[j, own] + base).astype(np.uint32))
            bit.append(np.array(bits, np.uint8).reshape(-1, len(depth))[j, own])
            length.append(depth)
            base += len(counts) - 1
        self.length, self.node, self.bit = np.concatenate(length).astype(np.int32), np.concatenate(node), np.concatenate(bit)
        self.first = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.turn = self.node << np.uint32(1) | self.bit  # node and bit at once


class Known(dict):
    """Numbers of head words; -1 for any other."""

    def __missing__(self, key):
        return -1

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.get, words, repeat(-1)), np.int32, len(words))


class Vocabulary:
    """Head words, most frequent first; the code, whose leaves are the first of them; and their class likelihoods, a last row for all others."""

    def __init__(self, head: list[bytes], likely: np.ndarray, code: Code):
        self.head, self.likely, self.code = Known(zip(head, range(len(head)))), likely, code

    def pieces(self, datas: list[tuple[list[bytes], int]], size: int, known: list[np.ndarray] | None = None) -> Iterator[tuple[list[list[bytes]], list[int], list[np.ndarray] | None]]:
        """Texts' tokens with their owners, cut to pieces, about ``size`` bytes at a time; with ``known``,
        the texts' head numbers, those of the pieces too."""
        out, owner, ids, held = [], [], [], 0
        for i, (words, n) in enumerate(datas):
            at = [0, len(words)]
            if n > PIECE:
                sums = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) // PIECE
                at[1:1] = (np.nonzero(np.diff(sums))[0] + 1).tolist()
            for a, b in zip(at, at[1:]):
                c = words if len(at) == 2 else words[a:b]
                n_c = n if len(at) == 2 else sum(map(len, c)) + len(c)
                if held and held + n_c > size:
                    yield out, owner, known and ids
                    out, owner, ids, held = [], [], [], 0
                out.append(c)
                owner.append(i)
                if known:
                    ids.append(known[i][a:b])
                held += n_c
        if out:
            yield out, owner, known and ids


# contexts

_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """The first n powers, at least, of the hash's multiplier and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        p = np.full((2, n + PIECE), [[MIX], [np.uint32(INVERSE)]], np.uint32)
        p[:, 0] = 1
        _POWERS[:] = np.cumprod(p, 1, dtype=np.uint32)
    return _POWERS


class Units:
    """Pieces of texts as symbols in order (a token's, and the bytes after an escape), their contexts and bits."""

    def __init__(self, pieces: list[list[bytes]], voc: Vocabulary, sizes: tuple[int, ...], known: list[np.ndarray] | None = None):
        code = voc.code
        tokens = [w for p in pieces for w in p]
        n_tokens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.concatenate(known) if known else voc.head.of(tokens)
        at[at >= code.escape] = -1
        starts = np.cumsum(n_tokens) - n_tokens
        if (rare := np.nonzero(at < 0)[0]).size and max(len(tokens[i]) for i in rare.tolist()) >= LONG:
            tokens, at, starts = self.broken(tokens, at, starts)
            rare = np.nonzero(at < 0)[0]
        raw = [tokens[i] if tokens[i][-1:] == b"\n" and len(tokens[i]) > 1 else tokens[i] + b" " for i in rare.tolist()]
        n = np.ones(len(at), np.int32)
        n[rare] += np.fromiter(map(len, raw), np.int32, len(raw))
        ends = np.cumsum(n)
        first = (ends - n).astype(np.int32)
        total = int(ends[-1]) if len(ends) else 0
        spelled = np.ones(total, bool)
        spelled[first] = False
        symbol = np.empty(total, np.int32)
        symbol[first] = np.where(at < 0, code.escape, at)
        byte = np.frombuffer(b"".join(raw), np.uint8)
        symbol[spelled] = byte + np.int32(code.escape + 1)
        # tokens' contexts: hashes of the two before, and the likeliest class so far
        c = np.zeros(total, np.uint32)
        c[spelled] = byte + np.uint32(1)
        up, down = powers(total)
        sums = np.zeros(total + 1, np.uint32)
        np.cumsum(c * up[:total], out=sums[1:])
        name = (at.astype(np.uint32) + np.uint32(1)) * MIX2
        name[rare] = (sums[ends[rare]] - sums[first[rare]]) * down[first[rare]] + np.uint32(7)
        back = [np.zeros(len(at), np.uint32) for _ in range(2)]
        for j, b in enumerate(back, 1):
            b[j:] = name[:-j]
            for i in range(j):
                b[(starts + i)[starts + i < len(at)]] = 0
        n_piece, best, kind = np.diff(np.append(starts, len(at))), None, np.zeros(len(at), np.uint32)
        for z, likely in enumerate(voc.likely.T):
            votes = np.zeros(len(at) + 1)
            np.cumsum(likely[at], out=votes[1:])  # the last place is of other words
            votes = votes[:-1] - np.repeat(votes[starts], n_piece)
            if best is None:
                best = votes
            else:
                kind[votes > best + 1e-6] = z
                best = np.maximum(best, votes)
        kind[starts] = CLASSES
        # symbols' contexts
        own = np.repeat(np.arange(len(at), dtype=np.int32), n)
        place = np.arange(total, dtype=np.int32) - first[own]
        past = []
        for j in range(1, 5):
            p = np.zeros(total, np.uint32)
            p[j:] = c[:-j]
            p[place <= j] = 0
            past.append(p)
        prefix = (sums[:total] - sums[first[own]]) * down[first[own]]
        kind = kind[own] + np.uint32(1)
        two = past[0] | past[1] << np.uint32(9)
        base0 = np.where(spelled, np.uint32(1 << 17) + (past[0] << np.uint32(8)) - np.uint32(code.escape), np.uint32(0))
        self.base = np.empty((total, ORDERS), np.uint32)  # a symbol's contexts lie together
        self.base[:, 0] = base0
        ctx = (
            kind * MIX + np.where(spelled, two + np.uint32(1), np.uint32(0)),
            np.where(spelled, two * MIX2 + (past[2] | past[3] << np.uint32(9)), back[0][own] * MIX),
            np.where(spelled, prefix, (back[0] * MIX2 ^ back[1] + (back[1] << np.uint32(7)))[own]),
        )
        for k, h in enumerate(ctx):
            h = (h ^ h >> np.uint32(15)) * MIX2
            h += np.uint32(2 * k) + spelled
            h ^= h >> np.uint32(13)
            h *= MIX
            h ^= h >> np.uint32(16)
            self.base[:, k + 1] = h
        # bits
        self.symbol, self.spelled, self.starts = symbol, spelled, first[starts] if len(first) else first
        self.length = code.length[symbol]
        self.n = int(self.length.sum())

    def turns(self, code: Code) -> np.ndarray:
        """Node and value of each bit, as twice the node and the value."""
        ends = np.cumsum(self.length, dtype=np.int32)
        j = np.repeat(code.first[self.symbol] - ends + self.length, self.length)
        j += np.arange(self.n, dtype=np.int32)
        return code.turn.take(j, mode="clip")

    def bits(self, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts [bit, predictor], node and value of each bit."""
        turn = self.turns(code)
        return np.repeat(self.base, self.length, 0), turn >> np.uint32(1), (turn & np.uint32(1)).astype(np.uint8)

    @staticmethod
    def broken(tokens: list[bytes], at: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words of ``LONG`` bytes or more as several tokens; a line break, which no word holds, says that it goes on."""
        out, ids, new = [], [], {}
        begins = set(starts.tolist())
        for i, (w, h) in enumerate(zip(tokens, at.tolist())):
            if i in begins:
                new[i] = len(out)
            parts = [w] if h >= 0 else [w[a : a + LONG - 1] for a in range(0, len(w), LONG - 1)]
            out += [p + b"\n" for p in parts[:-1]] + parts[-1:]
            ids += [h] * len(parts)
        return out, np.array(ids, np.int32), np.array([new[i] for i in starts.tolist()], np.int64)


def slots(base: np.ndarray, node: np.ndarray, sizes: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Slot numbers within each predictor, of contexts [bit, predictor] and nodes."""
    yield base[:, 0] + node
    mixed = node * MIX
    for k in range(1, ORDERS):
        out = mixed + base[:, k]
        out >>= np.uint32(32 - sizes[k])
        yield out


# counts


def levels() -> np.ndarray:
    """The value that each of 256 levels of a count stands for: whole up to 16, then four steps an octave."""
    return np.concatenate([np.arange(17), 16 * 2 ** ((np.arange(239) + 1) / 4)])


LEVELS = levels()
EDGES = np.concatenate([LEVELS[:16] + 0.5, np.sqrt(LEVELS[16:-1] * LEVELS[17:])])


def coded(counts: np.ndarray) -> np.ndarray:
    """Both counts [slot, bit] as one 16-bit code: a level each, with no largest count."""
    small = np.concatenate([np.arange(17), np.searchsorted(EDGES, np.arange(17, 4096))]).astype(np.uint16)
    at = small[np.minimum(counts, 4095).astype(np.int64)]
    big = counts > 4095
    at[big] = np.searchsorted(EDGES, counts[big].astype(float))
    return at[:, 0] << np.uint16(8) | at[:, 1]


def step(n: np.ndarray) -> np.ndarray:
    """How often a context was seen, in six steps."""
    return np.minimum(5, np.log2(n + 1) * 0.6).astype(np.int8)


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code: the stretched probability and step; the same without one occurrence of a bit [bit, code]."""
    none, one = (x.ravel() for x in np.meshgrid(LEVELS, LEVELS, indexing="ij"))
    x = lambda a, b: np.log((b + 0.4) / (a + 0.4)).astype(np.float32)
    less = [(np.maximum(none - 1, 0), one), (none, np.maximum(one - 1, 0))]
    return x(none, one), step(none + one), np.stack([x(*p) for p in less]), np.stack([step(a + b) for a, b in less])


def packed(counts: np.ndarray) -> bytes:
    """64-bit counts by byte planes, compressed: most are small."""
    return zlib.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


# mixing


def fresh() -> tuple[np.ndarray, np.ndarray]:
    """Weights and map to begin with: the class's context counts most."""
    return np.tile(np.array([0.1, 0.6, 0.5, 0.3], np.float32), (GATES, 1)), np.zeros((GATES, APM, 2))


def refined(apm: np.ndarray) -> np.ndarray:
    """The map as stretched probabilities [gate, place], nearer the rates met the more there are."""
    n = apm.sum(2)
    rate, trust = (apm[:, :, 1] + 0.5) / (n + 1), n / (n + 50)
    mids = (np.arange(APM) - APM / 2 + 0.5) * (24 / APM)
    return (trust * stretch(rate) + (1 - trust) * mids).astype(np.float32)


def place_of(dot: np.ndarray) -> np.ndarray:
    return (dot + 12 if APM == 24 else (dot + 12) * (APM / 24)).astype(np.intp)


class Model:
    """Slots' codes, vocabulary, weights and map, as every worker holds them.

    The first predictor's slots are few, so they have their probabilities at once. For ``learning``
    a code stands for two of them, by counts without an occurrence of either bit."""

    def __init__(self, voc: Vocabulary, codes: list[np.ndarray], sizes: tuple[int, ...], weights: np.ndarray, apm: np.ndarray, learning: bool = False):
        self.voc, self.codes, self.sizes, self.weights, self.apm, self.learning = voc, codes, sizes, weights, apm, learning
        self.x, self.step, x_less, step_less = tables()
        self.refined = refined(apm)
        values, steps = (x_less.T, step_less.T) if learning else (self.x, self.step)
        self.values, self.steps, self.narrow = values.ravel(), steps.ravel(), values.take(codes[0], 0, mode="clip").ravel()

    def inputs(self, base: np.ndarray, node: np.ndarray, bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictors' stretched probabilities [predictor, bit], gates, and the weighted sums, of contexts [bit, predictor]
        and nodes; with ``bit``, in learning, by counts without this occurrence."""
        x, gate = np.empty((ORDERS, len(node)), np.float32), (node >= self.voc.code.escape) * np.intp(36)
        for k, at in enumerate(slots(base, node, self.sizes)):
            if k:  # "clip": no place is out of bounds, and none is looked at twice
                at = self.codes[k].take(at, mode="clip")
            if bit is not None:
                at = at.astype(np.uint32) << np.uint32(1) | bit
            (self.values if k else self.narrow).take(at, out=x[k], mode="clip")
            if k >= ORDERS - 2:
                gate += self.steps.take(at, mode="clip") * np.int8(6 if k == ORDERS - 2 else 1)
        w = self.weights.take(gate, 0, mode="clip")
        dot = w[:, 0] * x[0]
        for k in range(1, ORDERS):
            dot += w[:, k] * x[k]
        return x, gate, dot

    def learn(self, u: Units, seen: np.ndarray, apm: np.ndarray, some: int = RUN) -> int:
        """Weights one pass down the coding cost's gradient over texts, ``some`` bits a step, and counts for the map."""
        contexts, nodes, values = u.bits(self.voc.code)
        for at in range(0, u.n, some):
            part = slice(at, at + some)
            bit = values[part]
            x, gate, dot = self.inputs(contexts[part], nodes[part], bit)
            dot = np.clip(dot, -11.9, 11.9)
            error = bit - 1 / (1 + np.exp(-dot))
            mass = np.bincount(gate, minlength=GATES) + 1e-9
            for k in range(ORDERS):
                g = np.bincount(gate, error * x[k], minlength=GATES) / mass
                seen[:, k] += g * g
                self.weights[:, k] += (LEARN * g / np.sqrt(seen[:, k])).astype(np.float32)
            apm += np.bincount((gate * APM + place_of(dot)) * 2 + bit, minlength=apm.size).reshape(apm.shape)
        return u.n

    def scores(self, pieces: list[list[bytes]], known: list[np.ndarray] | None = None) -> np.ndarray:
        """log10 probability of each piece: its segments advance side by side, a bit at a time, each learning on."""
        parts, offset, sizes = [], 0, np.fromiter((sum(map(len, p)) + len(p) for p in pieces), np.int64, len(pieces))
        group = np.cumsum(sizes) // STEP
        edges = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), len(pieces)]
        for a, b in zip(edges, edges[1:]):
            parts.append(Units(pieces[a:b], self.voc, self.sizes, known and known[a:b]))
        code, units = self.voc.code, np.cumsum([0, *[len(p.spelled) for p in parts]])
        base, of_unit = np.concatenate([p.base for p in parts]), np.concatenate([p.length for p in parts])
        ends = np.cumsum(of_unit, dtype=np.int64)
        first, total = ends - of_unit, int(ends[-1]) if len(ends) else 0
        starts = np.concatenate([p.starts + o for p, o in zip(parts, units)]).astype(np.int64)
        # segments: a piece's bits by SEGMENT, cut between symbols
        length = np.diff(np.append(starts, len(first)))
        run = (first - np.repeat(first[starts], length)) // SEGMENT
        opens = np.ones(len(run), bool)
        opens[1:] = run[1:] != run[:-1]
        opens[starts] = True
        segments = np.nonzero(opens)[0]
        owner = np.searchsorted(starts, segments, "right") - 1
        begin = first[segments]
        length = np.diff(np.append(begin, total))
        by = np.argsort(-length, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        steps = int(length[by[0]]) if len(by) else 0
        active = len(by) - np.searchsorted(np.sort(length), np.arange(steps), side="right")
        # unit and turn of each bit of the batch, as one number
        bits = np.empty((total, 2), np.uint32)
        for i, o in enumerate(units[:-1].tolist()):
            p, parts[i] = parts[i], None
            part = bits[int(first[o]) : int(first[o]) + p.n] if p.n else bits[:0]
            part[:, 0] = p.turns(code)
            part[:, 1] = np.repeat(np.arange(o, o + len(p.length), dtype=np.uint32), p.length)
        bits = bits.view(np.uint64).ravel()
        del first, ends, run, opens
        flat, begin = self.refined.ravel(), begin[by]
        w, seen, cost = np.zeros((ORDERS, len(by)), np.float32), np.zeros(len(by) * APM, np.float32), np.zeros(len(by))
        lane = np.arange(len(by)) * APM
        t = 0
        while t < steps:
            # a block of steps of the segments that last till its begin; none is done for many that have ended
            lanes = int(active[t])
            end = min(steps, t + max(1, SOME // lanes), max(t + 1, int(np.searchsorted(-active, -(lanes // 2)))))
            got = bits.take((np.arange(t, end)[:, None] + begin[:lanes]).ravel(), mode="clip").view(np.uint32).reshape(-1, 2)
            x, gate, dots = self.inputs(base.take(got[:, 1], 0, mode="clip"), got[:, 0] >> np.uint32(1), None)
            gate *= APM
            sign = 1 - 2 * (got[:, 0] & np.uint32(1)).astype(np.float32)
            for s in range(t, end):
                m, at = int(active[s]), (s - t) * lanes
                part = slice(at, at + m)
                xs, ws, turn = x[:, part], w[:, :m], sign[part]
                dot = np.add.reduce(ws * xs, 0)
                dot += dots[part]
                np.maximum(dot, -11.9, out=dot)
                np.minimum(dot, 11.9, out=dot)
                place = place_of(dot)
                here = lane[:m] + place
                place += gate[part]
                own = seen.take(here, mode="clip")
                dot += flat.take(place, mode="clip")
                dot *= 0.5
                dot += own
                dot *= turn
                np.exp(dot, out=dot)  # odds against the bit
                more = 1 + dot
                dot /= more
                cost[:m] += np.log(more, out=more)
                dot *= turn  # the bit's probability less the bit
                own -= np.float32(MAP_RATE) * dot
                seen[here] = own
                dot *= np.float32(WEIGHT_RATE)
                ws -= dot * xs
            t = end
        return np.bincount(owner, (-cost / np.log(10))[rank], minlength=len(pieces))


def split_words(text: str) -> list[bytes]:
    """``bytes`` lower and split exactly by A-Z and the six white space bytes."""
    return text.encode().lower().split()


def size_of(words: list[bytes]) -> int:
    """Bytes of a text's words and one between each two, without the end."""
    return sum(map(len, words)) + len(words) - (1 if len(words) == 1 else 2)


def streams(batches: Iterator[pa.RecordBatch], voc: Vocabulary) -> Iterator[list[list[bytes]]]:
    """Pieces of texts (the second column), some at a time."""
    for _, texts in chunks(batches, BATCH):
        datas = [(words, size_of(words)) for words in ([*split_words(t), END.encode()] for t in texts)]
        for pieces, _, _ in voc.pieces(datas, STEP):
            yield pieces


# in the JVM


COUNT, LEARNING, SCORING = range(3)


def walked(docs: DataFrame, mode: int, schema: str, voc: Vocabulary, sizes: tuple[int, ...], base: np.ndarray | None = None, codes: list[bytes] | None = None, weights: np.ndarray | None = None, apm: np.ndarray | None = None) -> DataFrame:
    """``Mixing.java`` over all texts, UTF-8 in the first column: counts, learned state or scores. ``codes``: as ``sendable`` makes them."""
    words, code = list(voc.head), voc.code
    ints = lambda x: np.asarray(x).astype("<i4", copy=False).tobytes()
    sent = {
        "words": b"".join(words), "lengths": ints([len(w) for w in words]), "likely": np.ascontiguousarray(voc.likely, "<f8").tobytes(), "base": np.asarray(np.zeros(len(words)) if base is None else base, "<f8").tobytes(),
        "length": ints(code.length), "first": ints(code.first), "turn": ints(code.turn.view(np.int32)), "bits": ints(sizes),
        "numbers": ints([code.escape, voc.likely.shape[1], CLASSES, PIECE, LONG, SEGMENT, RUN, CHUNK]),
    }
    if codes is not None:
        x, steps, x_less, step_less = tables()
        values, steps = (x_less.T, step_less.T) if mode == LEARNING else (x, steps)
        sent |= {f"codes{k}": c for k, c in enumerate(codes)}
        sent |= {"values": values.astype("<f4").tobytes(), "steps": steps.astype(np.int8).tobytes(), "weights": weights.astype("<f4").tobytes(), "refined": refined(apm).astype("<f4").tobytes(), "rates": np.array([LEARN, WEIGHT_RATE, MAP_RATE], "<f8").tobytes()}
    return over_partitions(docs, "Mixing.java", "strataform.Mixing", mode, sent, schema)


# learning


def count_words(docs: DataFrame, classes: list[str]) -> DataFrame:
    """(word, n, by): counts over all texts, an end token for each, in all and by class; summed
    in each task before the exchange."""
    width = len(classes) + 1
    place = {x: i for i, x in enumerate(classes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[Counter] = [Counter() for _ in range(width)]

        def flush() -> Iterator[pa.RecordBatch]:
            for i, c in enumerate(got):
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()).cast(pa.string()), pa.array([i] * len(c), pa.int32()), pa.array(c.values(), pa.int64())], ["word", "z", "n"])
                c.clear()

        for langs, texts in chunks(batches):
            for z, t in zip(langs, texts):
                c = got[place.get(z, width - 1)]
                c.update(split_words(t))
                c[END.encode()] += 1
            if sum(map(len, got)) > 400_000:
                yield from flush()
        yield from flush()

    rows = docs.select("lang", "text").mapInArrow(run, "word string, z int, n long")
    each = [F.coalesce(F.sum(F.when(F.col("z") == i, F.col("n"))), F.lit(0)) for i in range(width)]
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.array(*each).alias("by"))


def count_bytes(words: DataFrame) -> np.ndarray:
    """Bytes of spelled words (all that are not in the head), from their counts; a task gives 256 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(256)
        for batch in batches:
            words = [w.encode() + b" " for w in batch.column(0).to_pylist()]
            n = np.repeat(batch.column(1).to_numpy(), [len(w) for w in words])
            got += np.bincount(np.frombuffer(b"".join(words), np.uint8), n, minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(got.astype(np.int64))], ["byte", "n"])

    out = np.zeros(256, np.int64)
    for r in words.select("word", "n").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r.byte] = r.n
    return out


def tasks_of(docs: DataFrame, tokens: int) -> DataFrame:
    """``docs`` in fewer tasks, each of up to eight scan splits and a million tokens at least: a task
    holds a whole table of slots, and learns weights of its own."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    most = max(cores, docs.rdd.getNumPartitions() // 8)
    return docs.coalesce(max(1, min(most, tokens // 1_000_000)))


def count_slots(docs: DataFrame, voc, tokens: int, sizes: tuple[int, ...] = SIZES) -> list[np.ndarray]:
    """Each predictor's counts [slot, bit] over every bit of all texts, summed exactly, as 16-bit
    codes. ``voc``: the broadcast vocabulary."""
    offset = offsets(sizes)
    total = int(offset[-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("lm learning", _STATELESS)  # the scorer of an earlier model goes
        got = np.zeros(2 * total, np.uint32)  # some 100 MB
        parts = [got[2 * a : 2 * b] for a, b in zip(offset, offset[1:])]

        def flush() -> Iterator[pa.RecordBatch]:
            for c in range(0, total, CHUNK):
                if (part := got[2 * c : 2 * (c + CHUNK)]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK]), pa.array([packed(part)], pa.binary())], ["chunk", "counts"])

        bits_seen = 0
        for pieces in streams(batches, voc.value):
            u = Units(pieces, voc.value, sizes)
            contexts, node, bit = u.bits(voc.value.code)
            for counts, at in zip(parts, slots(contexts, node, sizes)):
                at <<= np.uint32(1)
                at |= bit
                np.add.at(counts, at.astype(np.intp), np.uint32(1))
            bits_seen += u.n
            if bits_seen > 1 << 31:  # no 32-bit count overflows
                yield from flush()
                got[:] = 0
                bits_seen = 0
        yield from flush()

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"chunk": table["chunk"][:1], "counts": [packed(sum(map(unpacked, table["counts"].to_pylist())))]})

    if NATIVE:
        parts = walked(tasks_of(docs.select(F.col("text").cast("binary")), tokens), COUNT, "chunk long, counts binary", voc.value, sizes)
    else:
        parts = tasks_of(docs.select(F.lit(0).alias("k"), "text"), tokens).mapInArrow(count, "chunk long, counts binary")
    salts = max(1, int(docs.sparkSession.sparkContext.defaultParallelism ** 0.5))
    first = parts.withColumn("salt", F.spark_partition_id() % salts).groupBy("chunk", "salt").applyInArrow(add, "chunk long, counts binary")
    out = np.zeros(total, np.uint16)
    # at most total / CHUNK rows of 256 kB
    for r in first.groupBy("chunk").applyInArrow(add, "chunk long, counts binary").toLocalIterator():
        part = coded(unpacked(r.counts).reshape(-1, 2))
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(part)] = part
    return [out[a:b] for a, b in zip(offset, offset[1:])]


def sendable(codes: list[np.ndarray]) -> list[bytes]:
    """Codes by byte planes, compressed for the copies that every executor holds on disk."""
    return [zlib.compress(c.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 1) for c in codes]


def received(sent: list[bytes]) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(zlib.decompress(s), np.uint8).reshape(2, -1).T).view("<u2").ravel() for s in sent]


def learn_mixing(docs: DataFrame, voc, sent, tokens: int, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Mixing weights and map counts from one pass over all texts. ``voc``, ``sent``: broadcast vocabulary and codes."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("lm learning", _STATELESS)
        model, mass, seen, apm = Model(voc.value, received(sent.value), sizes, *fresh(), learning=True), 0, np.full((GATES, ORDERS), 1e-6), np.zeros((GATES, APM, 2))
        for pieces in streams(batches, voc.value):
            mass += model.learn(Units(pieces, voc.value, sizes), seen, apm)
        state = np.concatenate([model.weights.ravel() * mass, apm.ravel(), [mass]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(state))), pa.array(state)], ["k", "v"])

    if NATIVE:
        weights, apm = fresh()
        parts = walked(tasks_of(docs.select(F.col("text").cast("binary")), tokens), LEARNING, "k long, v double", voc.value, sizes, codes=sent.value, weights=weights, apm=apm)
    else:
        parts = tasks_of(docs.select(F.lit(0).alias("k"), "text"), tokens).mapInArrow(learn, "k long, v double")
    state = np.zeros(GATES * ORDERS + GATES * APM * 2 + 1)
    for r in parts.groupBy("k").agg(F.sum("v").alias("v")).toLocalIterator():
        state[r.k] = r.v
    if not state[-1]:
        return fresh()
    w, apm = np.split(state[:-1], [GATES * ORDERS])
    return (w / state[-1]).reshape(GATES, ORDERS).astype(np.float32), apm.reshape(GATES, APM, 2)


def fit(docs: DataFrame) -> tuple[DataFrame, dict]:
    """The training documents' (text, lang) word counts and the model. A null lang is of the last class."""
    spark = docs.sparkSession
    per = docs.groupBy("lang").agg(F.count("*").alias("k")).orderBy(F.col("lang").isNull(), F.desc("k"), "lang").limit(CLASSES - 1).collect()
    classes = [r.lang for r in per if r.lang is not None]
    words = cut(count_words(docs, classes), "words")
    width = range(len(classes) + 1)
    got = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), *[F.coalesce(F.sum(F.get("by", F.lit(i))), F.lit(0)) for i in width]).first()
    n_all, distinct, of_class = got[0], got[1], np.array(got[2:], float)
    # the least count that at most HEAD words reach: one row a count
    least, so_far = None, 0
    for c, k in words.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(HEAD).collect():
        if so_far + k > HEAD:
            break
        least, so_far = c, so_far + k
    head = sorted(words.where(F.col("n") >= least).collect(), key=lambda r: (-r.n, r.word)) if least is not None else []
    head_n = np.array([r.n for r in head], np.int64)
    leaves = [r for r in head if r.n >= LEAST]
    by = np.array([r.by for r in leaves], float).reshape(len(leaves), len(width))
    likely = np.log((by + 0.2) / (of_class + 0.2 * max(1, len(leaves))))
    likely[:, of_class == 0] = likely.min(initial=0) - 10  # a class without words is never the likeliest
    likely = np.asfortranarray(np.vstack([likely - likely.max(1, keepdims=True), np.zeros(len(width))]))
    rare = words.where(F.col("n") < max(LEAST, least)) if least is not None else words
    code = Code(head_n[: len(leaves)], n_all - sum(r.n for r in leaves), count_bytes(rare))
    voc = Vocabulary([r.word.encode() for r in head], likely, code)
    sizes, sent_voc = sizes_for(distinct), spark.sparkContext.broadcast(voc)
    sent = spark.sparkContext.broadcast(sendable(count_slots(docs, sent_voc, n_all, sizes)))
    weights, apm = learn_mixing(docs, sent_voc, sent, n_all, sizes)
    return words, {"name": uuid.uuid4().hex, "voc": sent_voc, "codes": sent, "sizes": sizes, "weights": weights, "apm": apm, "n_all": n_all, "denominator": n_all + distinct + 1, "head_n": head_n, "least": least}


# scoring


def base_of(model: dict) -> np.ndarray:
    """log10 of head words' base probabilities."""
    return np.log10((model["head_n"] + 1) / model["denominator"])


class Scorer:
    """A worker's copy of the model."""

    def __init__(self, model: dict):
        self.voc = model["voc"].value
        self.model = Model(self.voc, received(model["codes"].value), model["sizes"], model["weights"], model["apm"])
        self.base = base_of(model)

    def texts(self, texts: list[str]) -> list[tuple]:
        """(n_tokens, bytes, head's n_known, base of head words, score, [(rarer word, n)]) of each text."""
        datas, out, known = [], [], []
        for t in texts:
            words = [*split_words(t), END.encode()]
            n_bytes = size_of(words)
            datas.append((words, n_bytes))
            at = self.voc.head.of(words)
            known.append(at)
            got = at[at >= 0]
            rare = Counter(words[i] for i in np.nonzero(at < 0)[0].tolist())
            out.append((len(words), n_bytes, len(got), self.base[got].sum(), rare))
        score = np.zeros(len(texts))
        for pieces, owner, ids in self.voc.pieces(datas, BATCH, known):
            np.add.at(score, owner, self.model.scores(pieces, ids))
        return [(*x[:4], s, x[4]) for x, s in zip(out, score.tolist())]


def score(docs: DataFrame, words: DataFrame, model: dict) -> DataFrame:
    """One row a document (doc_id, held_out, text): n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Null texts count as empty: the end token alone. Rows are told apart by position, so
    repeated ids and rows each give their own row; equal texts have equal scores. Without
    training documents every base probability is 1 and the mixer is untrained.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("lm", _SCORERS.clear)
        if model["name"] not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[model["name"]] = Scorer(model)
        scorer = _SCORERS[model["name"]]
        for whole in batches:
            at = 0
            slim = pa.RecordBatch.from_arrays([pa.array(range(whole.num_rows)), whole.column(3)], ["k", "text"])
            for _, texts in chunks(iter([slim]), BATCH):
                got = scorer.texts(texts)
                rid = whole.column(0).slice(at, len(texts)).to_pylist()
                rare = [(r, w, n) for r, g in zip(rid, got) for w, n in g[5].items()]
                none = [None] * len(rare)
                ids, held = (whole.column(i).slice(at, len(texts)).to_pylist() for i in (1, 2))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid + [r[0] for r in rare], pa.int64()), pa.array(ids + none, pa.int64()), pa.array(held + none, pa.bool_()),
                        pa.array([f"\t{r}" for r in rid] + [r[1].decode() for r in rare], pa.string()), pa.array([0] * len(rid) + [r[2] for r in rare], pa.int64()),
                        *[pa.array([g[i] for g in got] + none, kind) for i, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64()))],
                    ],
                    ["rid", "doc_id", "held_out", "word", "cnt", "n_tokens", "n_bytes", "n_known", "base", "score"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    schema = "rid long, doc_id long, held_out boolean, word string, cnt long, n_tokens long, n_bytes long, n_known long, base double, score double"
    if NATIVE:
        rows = rows.select(F.col("text").cast("binary"), "rid", "doc_id", "held_out")
        rows = walked(rows, SCORING, schema, model["voc"].value, model["sizes"], base_of(model), model["codes"].value, model["weights"], model["apm"])
    else:
        rows = rows.mapInArrow(run, schema)
    rest = words.where(F.col("n") < model["least"]) if model["least"] is not None else words
    rows = rows.join(rest.hint("shuffle_hash"), "word", "left")
    c, d = F.coalesce("n", F.lit(0)), F.lit(float(model["denominator"]))
    total = lambda whole, part: F.sum(F.coalesce(whole, F.lit(0)) + F.when(F.col("cnt") > 0, F.col("cnt") * part).otherwise(0))
    out = rows.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.max("n_bytes").alias("n_bytes"), F.max("score").alias("score"),
        total(F.col("n_known"), (c > 0).cast("long")).alias("n_known"), total(F.col("base"), F.log10((c + 1) / d)).alias("base_score"),
    )
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model["n_all"]).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op4_context_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = read(spark, sf_dir, "documents").select("doc_id", mark.alias("held_out"), "text", "lang")
    words, model = fit(docs.where("not held_out"))
    return score(docs, words, model)
