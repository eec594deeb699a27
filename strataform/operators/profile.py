"""Byte statistics of content and its class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes counted at once, which bounds memory and not what is measured.
BLOCK = 1 << 20
#: File signatures (fixed values), tested in this order at the start of the content.
SIGNATURES = {
    "PE": b"MZ",
    "ELF": b"\x7fELF",
    "gzip": b"\x1f\x8b",
    "zlib": b"\x78\x9c",
    "png": b"\x89PNG\r\n\x1a\n",
    "jpg": b"\xff\xd8\xff",
    "pdf": b"%PDF",
    "zip": b"PK\x03\x04",
    "7z": b"7z\xbc\xaf\x27\x1c",
    "tar": b"ustar",
    "lzma": b"\x5d\x00\x00",
}
COUNTS = ("sample_size", "distinct_bytes", "top8", "printable", "zeros", "runs", "newlines", "braces", "quotes", "commas", "angles", "code", "sum_bytes")
PRINTABLE = np.isin(np.arange(256), [*range(0x20, 0x7F), 9, 10, 13])


def _of(chars: str) -> list[int]:
    return [ord(c) for c in chars]


def histogram(x: np.ndarray) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for at in range(0, len(x), BLOCK):
        out += np.bincount(x[at : at + BLOCK], minlength=256)
    return out


def columns(raws: list[bytes], sample: int | None = None) -> list[list]:
    """``COUNTS``, then entropy, fold_xor (hex of the 8 interleaved bytes) and signature, each of all contents;
    their bytes are counted together, by content and byte.

    With ``sample``, statistics are of that many first bytes; sum_bytes and fold_xor are of all bytes always.
    """
    h, total = np.zeros((len(raws), 256), np.int64), np.zeros(len(raws), np.int64)
    runs, folded = np.zeros(len(raws), np.int64), []
    some, held = [], 0

    def count() -> None:
        size = np.array([len(raws[i]) for i in some])
        x = np.frombuffer(b"".join(raws[i] for i in some), np.uint8)
        own = np.repeat(np.arange(len(some)), size)
        full = np.bincount(own * 256 + x, minlength=256 * len(some)).reshape(-1, 256)
        total[some] = full @ np.arange(256)
        seen = np.ones(len(x), bool)
        if sample is not None:
            seen = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) < sample
            full = np.bincount((own * 256 + x)[seen], minlength=256 * len(some)).reshape(-1, 256)
        h[some] = full
        same = (x[1:] == x[:-1]) & (own[1:] == own[:-1]) & seen[1:]
        runs[some] = np.bincount(own[1:][same], minlength=len(some))

    for i, raw in enumerate(raws):
        if len(raw) > BLOCK:  # a long one by blocks, so memory stays bounded
            every = np.frombuffer(raw, np.uint8)
            x = every if sample is None else every[:sample]
            h[i] = histogram(x)
            total[i] = histogram(every) @ np.arange(256)
            runs[i] = sum(int((x[a + 1 : a + BLOCK + 1] == x[a : min(a + BLOCK, len(x) - 1)]).sum()) for a in range(0, max(0, len(x) - 1), BLOCK))
            continue
        some.append(i)
        held += len(raw)
        if held > BLOCK:
            count()
            some, held = [], 0
    if some:
        count()
    for raw in raws:
        padded = np.frombuffer(raw + bytes(-len(raw) % 8), np.uint8).reshape(-1, 8)
        folded.append(np.bitwise_xor.reduce(padded, 0).tobytes().hex() if len(raw) else "0" * 16)
    n = h.sum(1)
    p = h / np.maximum(n, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1) + 0.0
    of = lambda chars: h[:, _of(chars)].sum(1)
    counts = [n, (h > 0).sum(1), np.sort(h, 1)[:, -8:].sum(1), h[:, PRINTABLE].sum(1), h[:, 0], runs, h[:, 10], of("{}[]"), h[:, 34], h[:, 44], of("<>"), of("{}()=;"), total]
    names = [next((k for k, s in SIGNATURES.items() if raw.startswith(s)), "") for raw in raws]
    return [*[c.tolist() for c in counts], entropy.tolist(), folded, names]


def measure(raw: bytes, sample: int | None = None) -> tuple:
    return tuple(c[0] for c in columns([raw], sample))


def measured(df: DataFrame, key: str, content: str, sample: int | None = None) -> DataFrame:
    """(key, counts, entropy, fold_xor, subtype) of a string or binary column, of whole contents unless
    ``sample`` bounds the bytes; null content counts as empty."""
    schema = T.StructType([df.schema[key], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("entropy", T.DoubleType()), T.StructField("fold_xor", T.StringType()), T.StructField("subtype", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * len(COUNTS) + [pa.float64(), pa.string(), pa.string()]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                cols = columns([x.as_py() or b"" for x in batch.column(1)], sample)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=schema.names)

    return df.select(key, F.col(content).cast("binary")).mapInArrow(run, schema)


def content_class() -> Column:
    """The class by ordered rules over measured columns; the first that holds wins."""
    n = F.greatest(F.col("sample_size"), F.lit(1)).cast("double")
    share = lambda c: F.col(c) / n
    nl = F.col("newlines") / (n / 1024.0)
    e = F.col("entropy")
    codey = (share("printable") >= 0.75) & (nl > 8)
    texty = (share("printable") >= 0.85) | codey
    rules = [
        (F.col("sample_size") == 0, "UNKNOWN"),
        (F.col("subtype") != "", "EXECUTABLE"),
        ((e >= 7.85) & (F.col("distinct_bytes") >= 200), "RANDOM"),
        ((share("runs") >= 0.30) | ((e < 2.0) & (share("top8") >= 0.7)), "REPETITIVE"),
        (texty & (share("braces") >= 0.03) & (share("quotes") >= 0.01) & (nl < 15), "JSON"),
        (texty & (share("angles") >= 0.03), "XML"),
        (texty & (nl > 40) & (e < 5.5), "LOG"),
        (texty & (share("commas") >= 0.01) & (nl > 10) & (e < 5), "CSV"),
        (codey & (share("code") >= 0.02), "SOURCE_CODE"),
        (texty, "TEXT"),
        (share("zeros") < 0.35, "BINARY"),
        (F.col("distinct_bytes") < 160, "DATABASE"),
    ]
    out = F.when(*rules[0][:1], rules[0][1])
    for test, name in rules[1:]:
        out = out.when(test, name)
    return out.otherwise("MIXED")


def estimated_ratio() -> Column:
    n = F.greatest(F.col("sample_size"), F.lit(1)).cast("double")
    run = F.col("runs") / n
    ratio = 8.0 / F.col("entropy") * F.when(run > 0.2, 1 + (run - 0.2) * 4).otherwise(1.0)
    return F.when((F.col("sample_size") == 0) | (F.col("entropy") <= 0), 1.0).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), ratio)))


def incompressible(cls: Column, threshold: float = 0.10) -> Column:
    return (F.col("entropy") >= 8 - threshold) | (cls == "RANDOM")


def profile(df: DataFrame, key: str, content: str, sample: int | None = None) -> DataFrame:
    """One analysis row per input row: rates, class, signature, estimated ratio; of whole contents unless ``sample`` is given."""
    m = measured(df, key, content, sample)
    n = F.greatest(F.col("sample_size"), F.lit(1)).cast("double")
    rate = lambda c, by=n: F.round(F.col(c) / by, 6)
    cls = content_class()
    return m.select(
        key, "sample_size", F.round("entropy", 6).alias("entropy"), "distinct_bytes", rate("printable").alias("printable_fraction"), rate("zeros").alias("zero_fraction"),
        rate("runs").alias("run_fraction"), rate("newlines", n / 1024.0).alias("newline_density"), rate("top8").alias("top8_fraction"), cls.alias("cls"), "subtype",
        F.round(estimated_ratio(), 6).alias("estimated_ratio"), incompressible(cls).alias("incompressible"),
    )


def periods_of(raw: bytes, gaps: int = 1 << 12) -> list[tuple[int, float]]:
    """The two best repetition periods with scores: gaps to a byte's last occurrence (from 0 at
    first), a gap's count against what longer gaps leave."""
    x = np.frombuffer(raw, np.uint8)
    n = len(x)
    order = np.argsort(x, kind="stable")
    gap = np.zeros(n, np.int64)
    if n:
        same = np.concatenate([[False], x[order][1:] == x[order][:-1]])
        before = np.concatenate([[0], order[:-1]])
        gap[order] = order - np.where(same, before, 0)
    r = np.bincount(gap[(gap > 0) & (gap < gaps)], minlength=gaps)
    n1, out = n - int(r[1:4].sum()), []
    for _ in range(2):
        t = np.concatenate([[0], np.cumsum(r[5:])[:-1]])
        s = np.where(t < n1, r[5:] / np.where(t < n1, 256.0 + n1 - t, 1), 0)
        j = int(s.argmax())
        if not s[j] > 0.1:
            break
        out.append((j + 5, float(s[j])))
        n1 -= int(r[j + 5])
        r[j + 5] = 0
    return out + [(0, 0.0)] * (2 - len(out))


def periods(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, period1, score1, period2, score2); 0 where no period scores above 0.1."""
    schema = T.StructType([df.schema[key], *[T.StructField(f"{a}{i}", k) for i in (1, 2) for a, k in (("period", T.LongType()), ("score", T.DoubleType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sum(periods_of(x.as_py() or b""), ()) for x in batch.column(1)]
            cols = [pa.array([g[i] for g in got], pa.int64() if i % 2 == 0 else pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=schema.names)

    out = df.select(key, F.col(content).cast("binary")).mapInArrow(run, schema)
    return out.withColumns({f"score{i}": F.round(f"score{i}", 6) for i in (1, 2)})


def report_json(analysis: DataFrame, key: str) -> DataFrame:
    """One JSON document for each analysis row."""
    return analysis.select(key, F.to_json(F.struct(*[c for c in analysis.columns if c != key])).alias("report"))


def byte_counts(df: DataFrame, by: str, content: str) -> DataFrame:
    """(by, byte, n): how often each byte occurs in a group's contents; summed in each task first."""
    schema = T.StructType([df.schema[by], T.StructField("byte", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict = {}
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = histogram(np.frombuffer(x.as_py() or b"", np.uint8))
                got[k] = got[k] + h if k in got else h
            rows = [(k, b, int(h[b])) for k, h in got.items() for b in np.flatnonzero(h).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=schema.names)

    return df.select(by, F.col(content).cast("binary")).mapInArrow(run, schema).groupBy(by, "byte").agg(F.sum("n").alias("n"))
