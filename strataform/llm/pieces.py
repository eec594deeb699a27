"""Op 3: SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from the model file:

- the normaliser, of two states: the start emits the dummy prefix, the other maps a character by its arcs (white
  space to the escape mark) and any other one to itself;
- the piece transducer, a trie of states and arcs by character: a final state emits its piece with its weight and
  goes back to the root; a character that is no piece goes back emitting its UTF-8 bytes' fallback pieces;
- for BPE models, the pair machine: its states are the last piece emitted, and the arc from piece a to piece b
  weighs 0 if the merges leave the string a + b as exactly (a, b), and infinity otherwise. A sequence of
  pieces is the BPE result exactly if every neighbouring pair is: merges inside one piece never see the
  rest, and the first merge across a border would also happen in the pair alone. BPE scores order merges and are no
  weights of paths, so pieces weigh 0 there. Unigram models need no pair machine; their pieces weigh minus the score.

An input, itself a chain of states, is composed with the three: states of the composition are (position,
last piece), made as they are reached, and the shortest path in the tropical semiring (least sum of weights)
is found best first. It equals the reference library's ids.

The composition is cut where no arc can cross: before a word's escape mark (compilation checks
that no piece has the mark after another character), and between two characters that are neighbours in no
piece, such as a word and the comma after it. Paths of such chunks are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, read, sole

MARK = "\u2581"
INF = float("inf")
#: Added to the least score for a character outside every piece (a fixed value).
UNKNOWN_PENALTY = 10.0
_MACHINES: dict[str, Machine] = {}


class Machine:
    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(model_path, "rb") as f:
            m.ParseFromString(f.read())
        kind = type(m.pieces[0]).Type
        norm = m.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models whose normaliser is the identity with escaped white space are compiled")
        self.dummy = norm.add_dummy_prefix
        self.bpe = m.trainer_spec.model_type == m.trainer_spec.BPE
        self.surface = {i: p.piece for i, p in enumerate(m.pieces)}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kind.BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        self.control = {i for i, p in enumerate(m.pieces) if p.type in (kind.CONTROL, kind.UNKNOWN)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        normal = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type == kind.NORMAL}
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in m.pieces):
            raise ValueError("user-defined and unused pieces are not compiled")
        self.pieces = normal
        self.rank, self.halves = {}, {}
        if self.bpe:
            self.derive(normal)
        worst = UNKNOWN_PENALTY - min(s for _, s in normal.values())
        self.fallback = 0.0 if self.bpe else worst
        self.normaliser = (" ", MARK)  # its one arc; every other character to itself
        self.arcs, self.label, self.weight = self.trie()
        if self.bpe:
            self.offers, self.longest = self.offered(), max(map(len, self.pieces))
        self.alphabet = set("".join(normal))
        self.neighbours = {p[i : i + 2] for p in normal for i in range(len(p) - 1)}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(len(m.pieces))]
        if any(MARK in p.strip(MARK) or p[-1] == MARK and p.strip(MARK) for p in normal):
            raise ValueError("a piece goes on after a word's end")
        self.pair = Memo(self.pair_weight, 400_000) if self.bpe else None
        self.chunk = Memo(self.composed, 400_000)

    @classmethod
    def of(cls, path: str) -> Machine:
        """The worker's own machine, kept from task to task."""
        sole("pieces", _MACHINES.clear)
        if path not in _MACHINES:
            _MACHINES[path] = cls(path)
        return _MACHINES[path]

    # compilation
    def merged(self, text: str) -> list[str]:
        """What the merges leave of ``text``: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.pieces[parts[i] + parts[i + 1]][1], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.pieces), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def derive(self, normal: dict[str, tuple[int, float]]) -> None:
        """Each piece's last merge, and its merges' order; pieces that merges never give emit nothing."""
        order = sorted((p for p in normal if len(p) > 1), key=lambda p: -normal[p][1])
        rank, previous = 0, None
        for p in order:
            rank += normal[p][1] != previous
            previous = normal[p][1]
            parts = list(p)
            while len(parts) > 2:
                found = [(normal[parts[i] + parts[i + 1]][1], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in normal]
                if not found:
                    break
                i = -max(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                self.rank[p], self.halves[p] = rank, (parts[0], parts[1])
        self.pieces = {p: v for p, v in normal.items() if len(p) == 1 or p in self.rank}

    def pair_weight(self, pair: tuple[int, int]) -> bool:
        """Whether the pair machine's arc from one emitted to the next is finite."""
        a, b = pair
        return self.pair_allowed((self.surface[a] if a >= 0 else chr(-1 - a), self.surface[b] if b >= 0 else chr(-1 - b)))

    def pair_allowed(self, pair: tuple[str, str]) -> bool:
        """Whether the merges of a + b end as (a, b).

        The merges are undone, latest first, on either side of the border; the pair falls if
        the two pieces at the border could have been merged before the one undone last. Of
        equal merges the left one comes first.
        """
        a, b = pair
        if b[0] == MARK and a.strip(MARK) == "":  # several such pieces share one score
            return self.merged(a + b) == [a, b]
        rank, limit = self.rank, INF
        while True:
            if rank.get(a + b, INF) < limit:
                return False
            x, y = rank.get(a, 0), rank.get(b, 0)
            if not x and not y:
                return True
            if x > y:
                a, limit = self.halves[a][1], x
            else:
                b, limit = self.halves[b][0], y + 1

    def trie(self) -> tuple[list[dict[str, int]], list[int], list[float]]:
        """States' arcs by character, the piece that a final state emits (-1: not final) and its weight; the root is 0."""
        arcs, label, weight = [{}], [-1], [0.0]
        for piece, (i, score) in self.pieces.items():
            state = 0
            for c in piece:
                if c not in arcs[state]:
                    arcs[state][c] = len(arcs)
                    arcs.append({})
                    label.append(-1)
                    weight.append(0.0)
                state = arcs[state][c]
            label[state], weight[state] = i, 0.0 if self.bpe else -score
        return arcs, label, weight

    def offered(self) -> list[tuple[tuple[int, int], ...]]:
        """Of each of the trie's states the pieces that end on the way to it, itself included: (length, id), longest first."""
        out: list[tuple[tuple[int, int], ...]] = [()] * len(self.arcs)
        depth = [0] * len(self.arcs)
        for state, arcs in enumerate(self.arcs):  # a state's number is above those before it
            for to in arcs.values():
                depth[to] = depth[state] + 1
                out[to] = ((depth[to], self.label[to]), *out[state]) if self.label[to] >= 0 else out[state]
        return out

    # composition
    def composed(self, text: str) -> bytes:
        """Ids of a chunk: those of its parts, cut between characters that are neighbours in no piece."""
        path = self.finite_path if self.bpe else self.shortest_path
        if text[1:].isalpha():
            return path(text)
        near, start, parts = self.neighbours, 0, []
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in near:
                parts.append(text[start:i])
                start = i
        if not start:
            return path(text)
        return b"".join([self.chunk[p] for p in (*parts, text[start:])])

    def shortest_path(self, text: str) -> bytes:
        """Ids of the composition's shortest path, as little-endian 32-bit integers.

        States are (position, last emitted): a piece's id, or minus a character's number for its bytes. Of equal
        sums the state farthest on is taken first. A pair's weight, 0 or infinity, is met when its state is taken.
        """
        n, arcs, label, weight, pair = len(text), self.arcs, self.label, self.weight, self.pair
        root, total, end, now = arcs[0], 0.0, 0, None
        open_: list[tuple] = []  # (sum, -position, order, what was emitted, the state before)
        done, order = set(), 0
        while end < n:
            c = text[end]
            node = root.get(c, 0)
            if not node or label[node] < 0:
                order += 1
                heappush(open_, (total + self.fallback, -end - 1, order, -1 - ord(c), now))
            at = end
            while node:
                at += 1
                if label[node] >= 0:
                    order += 1
                    heappush(open_, (total + weight[node], -at, order, label[node], now))
                if at == n:
                    break
                node = arcs[node].get(text[at], 0)
            while True:
                now = heappop(open_)
                total, end, _, piece, before = now
                key = end, piece
                if key in done or before is not None and pair is not None and not pair[before[3], piece]:
                    continue
                done.add(key)
                end = -end
                break
        return self.emit(now)

    def finite_path(self, text: str) -> bytes:
        """``shortest_path`` where all weights are 0 or infinity: every finite sum is 0, so the open states are a
        stack, and the first to reach the end is the least."""
        n, arcs, offers, pair, most = len(text), self.arcs, self.offers, self.pair, self.longest
        end, piece = 0, None
        open_: list[tuple] = []  # (arcs not taken yet, position, what was emitted before)
        failed: set[tuple] = set()
        while end < n:
            node = 0
            for c in text[end : end + most]:
                if (below := arcs[node].get(c)) is None:
                    break
                node = below
            found = offers[node]
            if not found or found[-1][0] > 1:
                found = (*found, (1, -1 - ord(text[end])))
            ways = iter(found)
            while True:
                for size, to in ways:
                    if (piece is None or pair[piece, to]) and not (failed and (end + size, to) in failed):
                        break
                else:  # no way on from here
                    failed.add((end, piece))
                    ways, end, piece = open_.pop()
                    continue
                open_.append((ways, end, piece))
                end, piece = end + size, to
                break
        return self.joined([*[x for _, _, x in open_[1:]], piece] if open_ else [])

    def joined(self, path: list[int]) -> bytes:
        ids = self.id_bytes
        return b"".join([ids[x] if x >= 0 else b"".join([ids[self.bytes[b]] for b in chr(-1 - x).encode()]) for x in path])

    def emit(self, state: tuple | None) -> bytes:
        path = []
        while state is not None:
            x, state = state[-2:]
            path.append(x)
        return self.joined(path[::-1])

    # whole texts
    def normalise(self, text: str) -> str:
        """The normaliser's output: its one path over the text's chain."""
        return (MARK if self.dummy and text else "") + text.replace(*self.normaliser)

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut where no arc crosses; runs of marks stay whole with the word they precede."""
        t = self.normalise(text).replace(MARK, "\x00" + MARK)
        if MARK + "\x00" in t or "\x00" in text:
            t = re.sub(f"(?<={MARK})\x00(?={MARK})", "", t)
        if "\n" not in self.alphabet:
            t = t.replace("\n", "\x00\n\x00")
        return [c for c in t.split("\x00") if c] if "\x00" not in text else [self.normalise(text)]

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.chunk.__getitem__, self.chunks(text))) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        """Pieces' surfaces joined; bytes as UTF-8, each bad one U+FFFD; the dummy prefix dropped; control ids give nothing."""
        out, held = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(utf8(bytes(held)))
                held.clear()
            if i not in self.control:
                out.append(self.surface[i])
        if held:
            out.append(utf8(bytes(held)))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.prefixed(ids) else text

    def prefixed(self, ids: np.ndarray) -> bool:
        """Whether the first piece carries the dummy prefix; a byte piece never does."""
        first = next((i for i in ids.tolist() if i not in self.control), None)
        return self.dummy and first is not None and first not in self.byte_of and self.surface[first].startswith(MARK)

    def surfaces(self, ids: np.ndarray) -> str:
        """``decode`` for long runs: joins remembered bytes of each id, all UTF-8 by then."""
        if not hasattr(self, "_raw"):
            self._raw = [b"" if i in self.control else bytes([self.byte_of[i]]) if i in self.byte_of else self.surface[i].replace(MARK, " ").encode() for i in range(len(self.surface))]
        raw = b"".join(map(self._raw.__getitem__, ids.tolist()))
        raw = raw[1:] if self.prefixed(ids) else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self.decode(ids)


def utf8(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


def each(machine: Machine, texts: list[str | None]) -> tuple[dict[str | None, np.ndarray], dict[str | None, str]]:
    """Ids of every different text, and the text that they decode to."""
    of = {t: np.frombuffer(machine.encode(t), "<i4") for t in dict.fromkeys(texts)}
    return of, {t: machine.surfaces(p) for t, p in of.items()}


def encode(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """``keep`` columns with ids (array<int>), n_ids, decoded (the ids' text, if asked for) and lossless (the ids' text = text).
    Texts that come again within 512 rows are encoded and decoded once.

    Null and empty texts: no ids, an empty decoded text; lossless is true but for a null text,
    where it is null. Every row, repeated or not, gives one row; other columns are dropped.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), *[T.StructField("decoded", T.StringType())] * decoded, T.StructField("lossless", T.BooleanType())])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.of(model_path)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 512):
                batch = whole.slice(at, 512)
                texts = batch.column(n_keep).to_pylist()
                of, back = each(machine, texts)
                parts = [of[t] for t in texts]
                ends = np.cumsum([0, *map(len, parts)]).astype("<i4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, "<i4")])))
                same = [None if t is None else t == back[t] for t in texts]
                whole_texts = [pa.array([back[t] for t in texts], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], ids, pa.array(np.diff(ends).astype(np.int64)), *whole_texts, pa.array(same, pa.bool_())], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def op3_sentencepiece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", "n_ids", F.sha2("decoded", 256).alias("decoded_sha256"), "lossless")
