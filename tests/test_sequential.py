"""Byte algorithms against slow, plain versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataform.functions.checksums import BASE, rolling
from strataform.operators import chunking, matching, profile, transforms

RAW = st.one_of(st.binary(max_size=300), st.lists(st.sampled_from([b"ab", b"abc", b"\xe8\x01\x02\x03\x00", b"\x00"]), max_size=60).map(b"".join))


@settings(max_examples=60, deadline=None)
@given(RAW)
def test_transforms_undo(raw):
    assert transforms.unbwt(transforms.bwt(raw)) == raw
    assert transforms.call_addresses(transforms.call_addresses(raw), False) == raw
    assert transforms.unlz77(transforms.lz77(raw, 9)) == raw
    assert transforms.suffixes(raw).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


@settings(max_examples=20, deadline=None)
@given(RAW, st.sampled_from(sorted(transforms.METHODS)))
def test_blocks(raw, method):
    block = transforms.compress_block(raw, method, "a name", "a comment")
    assert transforms.read_block(block) == (raw, "a name", "a comment")
    if method == "store" and raw:
        with pytest.raises(ValueError):
            transforms.read_block(block[:-1] + bytes([block[-1] ^ 1]))


def test_rolling_hash():
    raw = bytes(random.Random(1).choices(range(256), k=100))
    want = []
    for i in range(100):
        h = 0
        for c in raw[max(0, i - 31) : i + 1]:
            h = (h * BASE + c) % 2**64
        want.append(h)
    assert rolling(np.frombuffer(raw, np.uint8), 32).tolist() == want


def plain_cuts(raw, least, target, most):
    out, start, mask = [], 0, (1 << (target.bit_length() - 1)) - 1
    while start < len(raw):
        lo, end, window = min(len(raw), start + least), min(len(raw), start + most), []
        for i in range(lo, end):
            window = [*window, raw[i]][-32:]
            h = 0
            for c in window:
                h = (h * BASE + c) % 2**64
            if h & mask == 0:
                end = i + 1
                break
        out.append(end)
        start = end
    return out


def test_chunks():
    r = random.Random(2)
    for raw in (bytes(r.choices(range(256), k=3000)), bytes(500), b"", b"x", b"abc" * 400):
        assert chunking.cut_points(raw, 16, 64, 200) == plain_cuts(raw, 16, 64, 200)
    assert chunking.cut_points(bytes(100), 10, 64, 50)[0] == 11  # a zero byte cuts at once


def plain_fragments(raw, shift):
    """(n, offset, length), byte by byte from the definition."""
    least, most, bound, out, at = 64 << shift, 8128 << shift, 1 << (22 - shift) if shift <= 22 else 0, [], 0
    while at < len(raw):
        table, last, h, size = {}, 0, 0, 0
        for c in raw[at : at + most]:
            right = table.get(last, 0) == c
            h = (h + c + 1) * (314159265 if right else 271828182) % 2**32
            table[last] = c
            last = c
            size += 1
            if h < bound and size >= least:
                break
        out.append((len(out), at, size))
        at += size
    return out


def test_fragments_and_packing():
    raw = b"The quick brown fox. " * 3000
    got = chunking.fragments_of(raw, 0)
    assert sum(f[2] for f in got) == len(raw) and all(f[2] <= 8128 for f in got) and all(f[2] >= 64 for f in got[:-1])
    assert all(0 <= f[4] <= f[2] for f in got)
    r = random.Random(12)
    for raw in (raw, b"", b"x", bytes(r.choices(range(256), k=30_000)), bytes(20_000), "Größe und 漢字 im Text. ".encode() * 900, bytes(r.choices(b"\x8b\x00ab", k=9000))):
        for shift in (0, 1, 23):
            assert [f[:3] for f in chunking.fragments_of(raw, shift, run=1000)] == plain_fragments(raw, shift)
    assert chunking.vote(np.zeros(256, np.uint8), 0, 100, [np.ones(256, np.uint8)] * 4)[0] == 100  # no context was seen
    half = np.zeros(256, np.uint8)
    half[48:53] = 139
    assert chunking.vote(half, 3, 100, [np.zeros(256, np.uint8)] * 4)[1:] == (False, True)
    half[48:51] = 32
    assert chunking.vote(half, 3, 100, [half] * 4) == (100, True, False)
    p = chunking.Packer(40_000)
    # a poor block closes before a file; one that shares predictions, or holds redundancy, goes on; a file that would not fit opens another
    assert [p.add(9000, 9000), p.add(9000, 9000), p.add(9000, 9000, 500, 100), p.add(100), p.add(5000, 5000), p.add(9000, 20_000), p.add(30_950)] == [0, 1, 1, 1, 1, 2, 3]
    assert sum(b[1] for b in chunking.journal_blocks(raw, 1 << 14, 0)) == len(chunking.fragments_of(raw, 0))
    assert chunking.pack([10, 10, 10], 110) == [0, 0, 1] and chunking.pack([], 10) == []


def test_matches():
    r = random.Random(3)
    for _ in range(30):
        raw = bytes(r.choices(b"abc", k=r.randint(0, 200)))
        got = matching.matches_of(raw)
        literal, at = b"", 0
        for pos, size, dist in got:
            assert size >= 4 and raw[pos : pos + size] == bytes(raw[pos - dist + i] for i in range(size))
            literal, at = literal + raw[at:pos], pos + size
        assert matching.rebuild(literal + raw[at:], len(raw), got) == raw
    assert matching.repeats_of(b"") == 0 and matching.repeats_of(b"a" * 40) == 24 - 15 + 0


@pytest.mark.parametrize(
    "raw,cls",
    [(b"", "UNKNOWN"), (b"MZ123", "EXECUTABLE"), (bytes(range(256)) * 8, "RANDOM"), (b"a" * 500, "REPETITIVE"), (b'{"a":[1,2]}' * 40, "JSON"), (b"<p>x</p>" * 40, "XML"), (b"1,2,3,4,5\n" * 60, "LOG"), (b"Plain words in a row here. " * 30, "TEXT"), (b"if (a) { b(); }\n" * 30, "LOG"), (bytes(range(128, 200)) * 9, "BINARY")],
)
def test_classes(spark, raw, cls):
    df = spark.createDataFrame([(1, bytearray(raw))], "k long, b binary")
    assert profile.profile(df, "k", "b").first().cls == cls


def test_one_damaged_block_costs_no_other():
    raw = b"sample block content " * 900
    got = transforms.recover(transforms.blocks_of(raw, 4096, "store", 2))
    assert [g for _, _, g, _ in got] == [True, True, False, True, True] and sum(x[3] for x in got) == len(raw) - 4096
    assert transforms.recover(b"") == [] and [g for _, _, g, _ in transforms.recover(b"xxSFB1yy")] == [False]


def test_random_bytes_never_escape():
    r = random.Random(9)
    for k in range(300):
        data = bytes(r.choices(range(256), k=r.randint(1, 400)))
        transforms.recover(b"SFB1" + data if k % 3 == 0 else data)
