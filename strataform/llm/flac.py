"""Op 1: FLAC media columns, written and read by numpy over many frames at once.

A payload is a mono stream of signed samples in 8 bits: STREAMINFO with the samples' MD5, a
SEEKTABLE with every frame's sample number and byte offset, then frames of ``BLOCK``
samples. A frame predicts by a fixed polynomial or by four quantised linear coefficients,
whichever costs least, and codes residuals by Rice parameters per partition; constant and
incompressible frames are kept as such. Reading checks CRC-8 of every header, CRC-16 of
every frame and the MD5, finds the codes of all frames in step, undoes the prediction in
step, and gives PCM blocks by sample offset. Escaped partitions, other orders and streams
without a seek table are read too; more channels than one, or other sample depths, are refused.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .tokens import chunks

BLOCK = 1024
#: Frames that are coded or read at a time, however long their text: some 50 MB of arrays.
FRAMES = 1024
RATE = 8000
ORDER, SHIFT, PRECISION = 4, 9, 12
CHUNK_CHARS = 1_000_000
#: Coefficients of the format's fixed predictors.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table


CRC8 = crc_table(0x07, 8).tolist()
CRC16 = crc_table(0x8005, 16)


def crc8(raw: bytes) -> int:
    c = 0
    for b in raw:
        c = CRC8[c ^ b]
    return c


def crc16(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, one byte of all at a time, longest first."""
    by = np.argsort(-length, kind="stable")
    start, left = start[by], length[by]
    crc = np.zeros(len(by), np.uint32)
    alive = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
    for t, k in enumerate(alive.tolist()):
        c = crc[:k]
        crc[:k] = ((c << np.uint32(8)) & np.uint32(0xFFFF)) ^ CRC16[(c >> np.uint32(8)) ^ buf[start[:k] + t]]
    out = np.empty_like(crc)
    out[by] = crc
    return out


def number(n: int) -> bytes:
    """A frame number in the format's UTF-8 style code."""
    if n < 0x80:
        return bytes([n])
    k = 1
    while n >> (6 * k + 6 - k):
        k += 1
    return bytes([(0xFF << (7 - k)) & 0xFF | n >> (6 * k), *[0x80 | n >> (6 * i) & 0x3F for i in range(k - 1, -1, -1)]])


def read_number(raw: bytes, at: int) -> tuple[int, int]:
    b = raw[at]
    if b < 0x80:
        return b, at + 1
    k = 8 - (b ^ 0xFF).bit_length() - 1
    if not 1 <= k <= 6:
        raise ValueError("bad frame number")
    n = b & (1 << (6 - k)) - 1 if k < 6 else 0
    for i in range(k):
        n = n << 6 | raw[at + 1 + i] & 0x3F
    return n, at + 1 + k


# writing


def linear(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients [frame, ORDER] by the autocorrelation method."""
    x = x.astype(np.float64)
    r = np.stack([(x[:, i:] * x[:, : x.shape[1] - i]).sum(1) for i in range(ORDER + 1)], 1)
    a, err = np.zeros((len(x), ORDER)), r[:, 0] + 1e-9
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        err = err * (1 - k * k) + 1e-12
    return np.clip(np.round(a * (1 << SHIFT)), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int32)


def folded(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def rice(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rice parameters from summed folded residuals."""
    mean = total / np.maximum(count, 1)
    return np.clip(np.floor(np.log2(np.maximum(mean * 0.75, 1))), 0, 14).astype(np.int32)


def frame_bytes(num: list[int], rows: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The frames of some blocks of samples, each with its number in its stream, and their sizes."""
    n = [len(r) for r in rows]
    rows = [r.ljust(BLOCK, b"\x80") for r in rows]
    n = np.array(n)
    x = (np.frombuffer(b"".join(rows), np.uint8).reshape(-1, BLOCK).astype(np.int32)) - 128
    t = np.arange(BLOCK)
    inside = t < n[:, None]
    coef = linear(np.where(inside, x, 0))
    predicted = np.zeros_like(x)
    for i in range(ORDER):
        predicted[:, i + 1 :] += coef[:, i : i + 1] * x[:, : BLOCK - i - 1]
    first = np.diff(x, axis=1, prepend=0)
    best, order, bits = None, None, None
    for o, r in ((0, x), (1, first), (2, np.diff(first, axis=1, prepend=0)), (32, x - (predicted >> SHIFT))):
        warm = ORDER if o == 32 else o
        u = np.where(inside & (t >= warm), folded(r), 0)
        k = rice(u.sum(1), n - warm)
        cost = (n - warm) * (k + 1) + (u >> k[:, None]).sum(1) + 8 * warm + (9 + PRECISION * ORDER if o == 32 else 0)
        if best is None:
            best, order, bits = u, np.zeros(len(n), np.int64), cost
        else:
            win = cost < bits
            best[win], order[win], bits = u[win], o, np.minimum(cost, bits)
    flat = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(1)
    verbatim = (bits >= 8 * n) & ~flat
    coded = ~flat & ~verbatim
    warm = np.where(order == 32, ORDER, order)
    parts = np.where(coded & (n == BLOCK), 4, 1)
    per = np.where(parts == 4, BLOCK // 4, BLOCK)
    part = np.minimum(t // per[:, None], 3)
    u = best
    valid = inside & (t >= warm[:, None]) & coded[:, None]
    sums = u.reshape(len(n), 4, -1).sum(2)
    sums[parts == 1, 0] = sums[parts == 1].sum(1)
    count = np.full((len(n), 4), BLOCK // 4) - np.where(np.arange(4) == 0, warm[:, None], 0)
    count[parts == 1, 0] = (n - warm)[parts == 1]
    k4 = rice(sums, count)
    k = np.take_along_axis(k4, np.where(parts[:, None] == 4, part, 0), 1)
    q = u >> k
    length = np.where(valid, q + 1 + k, 0)
    opens = valid & ((t == warm[:, None]) | ((parts[:, None] == 4) & (t % (BLOCK // 4) == 0)))
    end = np.cumsum(length + 4 * opens, 1)
    # fields before the residuals, as (value, width) of each frame
    heads, fields = [], []
    for i in range(len(n)):
        h = struct.pack(">BBBB", 0xFF, 0xF8, 0x70, 0x02) + number(num[i]) + struct.pack(">H", n[i] - 1)
        heads.append(h + bytes([crc8(h)]))
        w, o = int(warm[i]), int(order[i])
        if flat[i]:
            f = [(0, 8), (int(x[i, 0]) & 255, 8)]
        elif verbatim[i]:
            f = [(1 << 1, 8), *[(int(v) & 255, 8) for v in x[i, : n[i]]]]
        else:
            f = [((32 + ORDER - 1 if o == 32 else 8 + o) << 1, 8), *[(int(v) & 255, 8) for v in x[i, :w]]]
            if o == 32:
                f += [(PRECISION - 1, 4), (SHIFT, 5), *[(int(c) & (1 << PRECISION) - 1, PRECISION) for c in coef[i]]]
            f += [(0, 2), (2 if parts[i] == 4 else 0, 4)]
        fields.append([(b, 8) for b in heads[-1]] + f)
    before = np.array([sum(w for _, w in f) for f in fields])
    size = (before + end[:, -1] + 7) // 8 + 2
    start = np.cumsum(size) - size
    put = [(8 * start[:, None] + before[:, None] + end - k - 1)[valid], ((1 << k) | (u & ((1 << k) - 1)))[valid], (k + 1)[valid]]
    put_k = [(8 * start[:, None] + before[:, None] + end - length - 4)[opens], k[opens], np.full(int(opens.sum()), 4)]
    wide = np.array([w for f in fields for _, w in f])
    where = np.concatenate([[0], np.cumsum(wide)[:-1]]) - np.repeat(np.cumsum(before) - before, [len(f) for f in fields]) + np.repeat(8 * start, [len(f) for f in fields])
    put_f = [where, np.array([v for f in fields for v, _ in f]), wide]
    pos, val, width = (np.concatenate(z) for z in zip(put, put_k, put_f))
    out = np.zeros(8 * int(size.sum()), np.uint8)
    for b in range(int(width.max())):
        some = (width > b) & (val >> b & 1).astype(bool)
        out[pos[some] + width[some] - 1 - b] = 1
    buf = np.packbits(out)
    crc = crc16(buf, start, size - 2)
    buf[start + size - 2], buf[start + size - 1] = crc >> 8, crc & 255
    return buf.tobytes(), size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload; lengths are positive multiples of 64. ``FRAMES`` frames are coded at a time."""
    parts: list[list[bytes]] = [[] for _ in payloads]
    sizes: list[list[int]] = [[] for _ in payloads]
    held: list[tuple[int, int]] = []

    def flush() -> None:
        raw, size = frame_bytes([k for _, k in held], [payloads[i][k * BLOCK : (k + 1) * BLOCK] for i, k in held])
        at = 0
        for (i, _), z in zip(held, size.tolist()):
            parts[i].append(raw[at : at + z])
            sizes[i].append(z)
            at += z
        held.clear()

    for i, p in enumerate(payloads):
        for k in range(-(-len(p) // BLOCK)):
            held.append((i, k))
            if len(held) >= FRAMES:
                flush()
    if held:
        flush()
    media = []
    for p, part, size in zip(payloads, parts, sizes):
        start = np.cumsum(size) - size
        seek = b"".join(struct.pack(">QQH", f * BLOCK, o, min(BLOCK, len(p) - f * BLOCK)) for f, o in enumerate(start.tolist()))
        pcm = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(size).to_bytes(3, "big") + max(size).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        media.append(b"".join([b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek, *part]))
    return media


# reading


@dataclass
class Stream:
    samples: int
    md5: bytes
    audio: int
    seek: list[tuple[int, int, int]]


def stream(raw: bytes) -> Stream:
    """Metadata of a stream; ``seek``: (sample, byte offset in ``raw``, samples) of frames."""
    if raw[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, seek = 4, False, None, []
    while not last:
        last, kind, size = raw[at] >> 7, raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        body = raw[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            seek = [struct.unpack_from(">QQH", body, i) for i in range(0, size, 18)]
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    if (packed >> 41 & 7) != 0 or (packed >> 36 & 31) != 7:
        raise ValueError("only mono streams of 8 bits a sample are read")
    return Stream(packed & (1 << 36) - 1, info[18:34], at, [(s, at + o, n) for s, o, n in seek if s != 0xFFFFFFFFFFFFFFFF])


@dataclass
class Frame:
    start: int
    n: int
    at: int  # bit of the first partition's parameter
    kind: int  # 0 constant, 1 verbatim, else coded
    warm: list[int]
    coef: list[int]
    shift: int
    partitions: int


def signed(v: int, bits: int) -> int:
    return v - (1 << bits) if v >> (bits - 1) & 1 else v


def head(raw: bytes, start: int) -> Frame:
    if raw[start] != 0xFF or raw[start + 1] >> 2 != 0x3E:
        raise ValueError("no frame where one should be")
    code = raw[start + 2] >> 4
    _, at = read_number(raw, start + 4)
    if code == 6:
        n, at = raw[at] + 1, at + 1
    elif code == 7:
        n, at = int.from_bytes(raw[at : at + 2], "big") + 1, at + 2
    else:
        n = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    rate = raw[start + 2] & 15
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(raw[start:at]) != raw[at]:
        raise ValueError("a frame header's checksum is wrong")
    at += 1
    kind = raw[at] >> 1 & 63
    if raw[at] & 1:
        raise ValueError("wasted bits are not read")
    at += 1
    if kind < 2:
        return Frame(start, n, 8 * at, kind, [], [], 0, 0)
    order = kind - 31 if kind >= 32 else kind - 8
    warm = [signed(raw[at + i], 8) for i in range(order)]
    window = int.from_bytes(raw[at + order : at + order + 72].ljust(72, b"\0"), "big")
    bit = 0

    def take(k: int) -> int:
        nonlocal bit
        bit += k
        return window >> (576 - bit) & (1 << k) - 1

    if kind >= 32:
        precision, shift = take(4) + 1, signed(take(5), 5)
        coef = [signed(take(precision), precision) for _ in range(order)]
    else:
        coef, shift = FIXED[order], 0
    method, partitions = take(2), 1 << take(4)
    if method:
        raise ValueError("only 4-bit Rice parameters are read")
    return Frame(start, n, 8 * (at + order) + bit, 2, warm, coef, shift, partitions)


def bits_at(buf: np.ndarray, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Up to 16 bits from each bit position; ``buf`` has three spare bytes."""
    byte = at >> 3
    w = buf[byte].astype(np.int64) << 16 | buf[byte + 1].astype(np.int64) << 8 | buf[byte + 2]
    return w >> (24 - (at & 7) - width) & ((1 << width) - 1)


def frames(raw: bytes, starts: list[int]) -> tuple[list[np.ndarray], list[int]]:
    """Samples of the frames at byte offsets, and the offsets after them; CRCs are checked."""
    heads = [head(raw, s) for s in starts]
    buf = np.frombuffer(raw + bytes(8), np.uint8)
    ones = np.unpackbits(buf)
    following = np.where(ones, np.arange(len(ones), dtype=np.int32), np.int32(len(ones)))
    following = np.minimum.accumulate(following[::-1])[::-1]
    n = np.array([h.n for h in heads])
    most = int(n.max()) if len(n) else 0
    res = np.zeros((most, len(heads)), np.int32)  # time first: a step touches one row
    at = np.array([h.at for h in heads], np.int64)
    order = np.array([len(h.warm) for h in heads])
    parts = np.array([h.partitions for h in heads])
    for i, h in enumerate(heads):
        if h.kind == 0:
            res[: h.n, i] = signed(raw[h.at >> 3], 8)
            at[i] += 8
        elif h.kind == 1:
            res[: h.n, i] = buf[h.at >> 3 : (h.at >> 3) + h.n].view(np.int8)
            at[i] += 8 * h.n
    for r in range(int(parts.max()) if len(parts) else 0):
        some = np.nonzero(parts > r)[0]
        size = n[some] // parts[some]
        first = np.where(r == 0, order[some], r * size)
        count = (r + 1) * size - first
        k = bits_at(buf, at[some], 4)
        at[some] += 4
        for i in np.nonzero(k == 15)[0].tolist():
            f, width = some[i], int(bits_at(buf, at[some[i]], 5))
            at[f] += 5
            v = bits_at(buf, at[f] + width * np.arange(count[i]), width) if width else np.zeros(count[i], np.int64)
            res[first[i] : first[i] + count[i], f] = v - ((v >> max(0, width - 1) & 1) << width) if width else 0
            at[f] += width * count[i]
        plain = k < 15
        some, first, count, k = some[plain], first[plain], count[plain], k[plain]
        by = np.argsort(-count, kind="stable")
        some, first, count, k = some[by], first[by], count[by], k[by]
        steps = int(count[0]) if len(count) else 0
        alive = np.searchsorted(-count, -np.arange(steps), "left")
        pos, base = at[some].astype(np.int32), np.zeros(len(some), np.int32)
        stop = np.zeros((steps, len(some)), np.int32)
        step = (k + 1).astype(np.int32)
        base = stop.copy()
        for t, m in enumerate(alive.tolist()):
            p = pos[:m]
            base[t, :m] = p
            one = following[p]
            stop[t, :m] = one
            pos[:m] = one + step[:m]
        at[some] = pos
        live = np.arange(steps)[:, None] < count
        tt, ff = np.nonzero(live)
        one, kk = stop[tt, ff].astype(np.int64), k[ff]
        if (one >= len(ones)).any():
            raise ValueError("a stream ends within a frame")
        u = (one - base[tt, ff]) << kk | bits_at(buf, one + 1, kk)
        res[first[ff] + tt, some[ff]] = (u >> 1) ^ -(u & 1)
    for o in np.unique(order[order > 0]).tolist():
        some = np.nonzero(order == o)[0]
        some = some[np.argsort(-n[some], kind="stable")]
        x = np.ascontiguousarray(res[:, some])
        x[:o] = np.array([heads[f].warm for f in some]).T
        c = np.array([heads[f].coef for f in some], np.int32).T.copy()
        shift = np.array([heads[f].shift for f in some], np.int32)
        alive = np.searchsorted(-n[some], -np.arange(most), "left").tolist()
        for t in range(o, most):
            m = alive[t]
            acc = c[0, :m] * x[t - 1, :m]
            for i in range(1, o):
                acc += c[i, :m] * x[t - 1 - i, :m]
            x[t, :m] += acc >> shift[:m]
        res[:, some] = x
    ends = (at + 7) >> 3
    got = crc16(buf, np.array(starts, np.int64), ends - np.array(starts, np.int64))
    if (got != (buf[ends].astype(np.uint32) << 8 | buf[ends + 1])).any():
        raise ValueError("a frame's checksum is wrong")
    by_frame = np.ascontiguousarray(res.T)
    return [by_frame[i, : h.n].astype(np.int8) for i, h in enumerate(heads)], (ends + 2).tolist()


def decode(media: list[bytes]) -> list[bytes]:
    """The signed 8-bit PCM of each stream; MD5s are checked."""
    infos = [stream(m) for m in media]
    base = np.cumsum([0, *map(len, media)]).tolist()
    raw = b"".join(media)
    pcm: list[list[np.ndarray]] = [[] for _ in media]
    starts = [(i, base[i] + o) for i, s in enumerate(infos) for _, o, _ in s.seek]
    for k in range(0, len(starts), FRAMES):
        some = starts[k : k + FRAMES]
        lo = some[0][1]
        hi = starts[k + FRAMES][1] if k + FRAMES < len(starts) else len(raw)
        got, _ = frames(raw[lo:hi], [o - lo for _, o in some])
        for (i, _), g in zip(some, got):
            pcm[i].append(g)
    now = {i: base[i] + s.audio for i, s in enumerate(infos) if not s.seek and base[i] + s.audio < base[i + 1]}
    while now:  # without a seek table the next frame is found by reading this one
        got, ends = frames(raw, list(now.values()))
        for i, g, e in zip(list(now), got, ends):
            pcm[i].append(g)
            now[i] = e
        now = {i: e for i, e in now.items() if e < base[i + 1]}
    out = [np.concatenate([*p, np.zeros(0, np.int8)]).tobytes() for p in pcm]
    for s, p in zip(infos, out):
        if len(p) != s.samples or hashlib.md5(p).digest() != s.md5:
            raise ValueError("a stream's samples are not those that were written")
    return out


def decode_range(media: bytes, first: int, count: int) -> bytes:
    """PCM from sample ``first`` on, reading only the frames that hold it."""
    wanted = [(s, o, n) for s, o, n in stream(media).seek if s < first + count and s + n > first]
    if not wanted:
        return b""
    got = []
    for k in range(0, len(wanted), FRAMES):
        lo, last = wanted[k][1], wanted[k : k + FRAMES][-1]
        hi = next((o for s, o, _ in stream(media).seek if s > last[0]), len(media))
        got += frames(media[lo:hi], [o - lo for _, o, _ in wanted[k : k + FRAMES]])[0]
    pcm = np.concatenate(got)
    return pcm[first - wanted[0][0] :][:count].tobytes()


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def to_flac(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes (of the text, null as empty) and media (the FLAC stream)."""
    from pyspark.sql import types as T

    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            slim = pa.RecordBatch.from_arrays([pa.array(range(whole.num_rows)), whole.column(len(keep))], ["k", "text"])
            for _, texts in chunks(iter([slim]), CHUNK_CHARS):
                media = encode([payload(t) for t in texts])
                batch = whole.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def groups(batch: pa.RecordBatch, column: int, size: int = CHUNK_CHARS) -> Iterator[tuple[int, list[bytes]]]:
    at, held, total = 0, [], 0
    for i, m in enumerate(batch.column(column)):
        held.append(m.as_py())
        total += len(held[-1])
        if total >= size:
            yield at, held
            at, held, total = i + 1, [], 0
    if held:
        yield at, held


def pcm_blocks(media: DataFrame, key: str = "doc_id", samples: int = 4096) -> DataFrame:
    """(key, sample_offset, n_samples, pcm): blocks of decoded signed 8-bit PCM. Null media give none."""
    from pyspark.sql import types as T

    schema = T.StructType([media.schema[key], T.StructField("sample_offset", T.LongType()), T.StructField("n_samples", T.LongType()), T.StructField("pcm", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in groups(batch, 1):
                keys = batch.column(0).slice(at, len(some)).to_pylist()
                rows = [(k, o, len(b), b) for k, p in zip(keys, decode(some)) for o in range(0, len(p), samples) for b in [p[o : o + samples]]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column(0).type), *[pa.array([r[i] for r in rows], kind) for i, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.binary()))]], names=schema.names)

    return media.where("media is not null").select(key, "media").mapInArrow(run, schema)


def feature(pcm: np.ndarray) -> str:
    """Sample count, sum, energy, sign changes and largest step of PCM."""
    x = pcm.astype(np.int64)
    return f"n={len(x)};sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero((pcm[1:] ^ pcm[:-1]) < 0)};step={np.abs(np.diff(x)).max(initial=0)}"


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads media back: payload and media digests and the feature string of each row; nulls stay null."""
    from pyspark.sql import types as T

    names = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType()}
    schema = T.StructType([media.schema[key], media.schema["n_bytes"], *[T.StructField(k, v) for k, v in names.items()]])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in groups(batch, 2):
                rows = []
                for m, p in zip(some, decode(some)):
                    back = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(np.frombuffer(p, np.int8))))
                own = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], names=schema.names)

    return media.select(key, "n_bytes", "media").mapInArrow(run, schema)


def op1_flac_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(to_flac(read(spark, sf_dir, "documents").select(F.col("doc_id"), "text")))
