import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataform.llm import flac, pieces, tokens

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=3000), st.integers(0, 255).map(lambda b: bytes([b]) * 700), st.integers(1, 90).map(lambda k: (np.sin(np.arange(2500) / k) * 120).astype(np.int8).tobytes())), min_size=1, max_size=4))
def test_flac_round_trip(raw):
    p = [x + bytes(-len(x) % 64 or (0 if x else 64)) for x in raw]
    media = flac.encode(p)
    pcm = flac.decode(media)
    assert [(np.frombuffer(a, np.uint8) ^ 0x80).tobytes() for a in pcm] == p
    assert flac.decode_range(media[0], 30, 2000) == pcm[0][30:2030]


def test_flac_checksums_and_other_streams():
    p = flac.payload("some words that repeat, some words that do not. " * 60)
    m = flac.encode([p])[0]
    s = flac.stream(m)
    bare = m[:4] + b"\x80" + m[5:42] + m[s.audio :]  # no seek table
    assert flac.decode([bare]) == flac.decode([m])
    for at in (s.audio + 3, len(m) - 40):
        bad = bytearray(m)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    # an escaped partition: 16 samples of 5 raw bits
    samples = [3, -4, 7, 0, -16, 15, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    head = b"\xff\xf8\x60\x02\x00" + bytes([15])
    bits = "00010000" + "00" + "0000" + "1111" + "00101" + "".join(f"{x & 31:05b}" for x in samples)
    body = head + bytes([flac.crc8(head)]) + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    crc = flac.crc16(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0]
    got, _ = flac.frames(body + int(crc).to_bytes(2, "big"), [0])
    assert got[0].tolist() == samples


def test_flac_query(docs, rows, empty):
    got = flac.features(flac.to_flac(docs)).collect()
    want = sorted((x[0] if x[0] is not None else -1, hashlib.sha256(flac.payload(x[1])).hexdigest(), zlib.crc32(flac.payload(x[1])[-64:]), len((x[1] or "").encode())) for x in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.payload_sha256, r.tail_crc32, r.n_bytes) for r in got) == want
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert flac.features(flac.to_flac(empty)).count() == 0
    blocks = flac.pcm_blocks(flac.to_flac(docs.where("doc_id = 63")), samples=1000).orderBy("sample_offset").collect()
    long = next(x[1] for x in rows if x[0] == 63)
    assert (np.frombuffer(b"".join(b.pcm for b in blocks), np.uint8) ^ 0x80).tobytes() == flac.payload(long)
    assert [b.sample_offset for b in blocks] == list(range(0, len(flac.payload(long)), 1000))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"abZé1 ,.'\n\t \x01", " the", "it's", "  ", "word,", "漢"]), max_size=30).map("".join))
def test_tokens_are_the_librarys(text):
    w = tokens.WordCache.of(BPE)
    assert w.encode([text]) == w.raw([text])


def test_sequence_files(docs, rows, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    manifest = tokens.write_sequences(docs, BPE, length=64, parts=3)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_sequences(manifest).collect()))
    ids = {}
    for x in rows:
        ids.setdefault(x[0], []).append(lib.encode(x[1] or "", add_special_tokens=False).ids + [0])
    start, seen = 0, []
    for s, k, n, crc in got:
        assert s == start
        start += n
        seen.append(k)
        match = next(i for i in ids[k] if zlib.crc32(np.array(i, "<u4").tobytes()) == crc)
        ids[k].remove(match)
    assert seen == sorted(seen, key=lambda k: (k is not None, k)) and not any(ids.values())
    assert tokens.read_sequences(tokens.write_sequences(empty, BPE)).count() == 0
    file = manifest.first().path
    batches, _ = tokens.open_sequences(file)
    values, mask = tokens.sequence(batches, 0)
    assert len(values) == len(mask) == 64 and not values.flags.owndata and mask.sum() == min(64, manifest.first().n_ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"abcZé1 ,.\n\t \x00▁漢😀", " the", "ing", "   ", "▁▁"]), max_size=30).map("".join))
def test_pieces_are_the_librarys(text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    m = pieces.Machine.of(SP)
    ids = np.frombuffer(m.encode(text), "<i4")
    assert ids.tolist() == sp.encode(text) and m.decode(ids) == m.surfaces(ids) == sp.decode(ids.tolist())


def test_pair_weights_and_paths_by_brute_force():
    import itertools
    import random

    m, r = pieces.Machine.of(SP), random.Random(1)
    some = r.sample(sorted(m.pieces), 300)
    for pair in itertools.product(some[:60], some[60:120]):
        assert m.pair_allowed(pair) == (m.merged("".join(pair)) == list(pair))
    for _ in range(40):
        text = pieces.MARK + "".join(r.choices("theandingtionré漢", k=r.randint(1, 9)))
        assert m.surfaces(np.frombuffer(m.shortest_path(text), "<i4")).strip() == text[1:]
        assert m.shortest_path(text) == b"".join(np.array([m.pieces[p][0]] if p in m.pieces else [m.bytes[b] for b in p.encode()], "<i4").tobytes() for p in m.merged(text))


def test_chunks_are_cut_where_no_piece_crosses(monkeypatch):
    """A word and the mark after it are sought apart, so a known word with another mark after it is not sought again."""
    import sentencepiece

    sp, m, sought = sentencepiece.SentencePieceProcessor(model_file=SP), pieces.Machine(SP), []
    monkeypatch.setattr(m, "finite_path", lambda t, f=m.finite_path: sought.append(t) or f(t))
    for text in ("onere tionheth", "onere, tionheth.", "(onere) \"tionheth\", re-onere!?"):
        assert np.frombuffer(m.encode(text), "<i4").tolist() == sp.encode(text)
    assert sought.count("▁onere") == sought.count("▁tionheth") == 1
    assert len(sought) == len(set(sought)) and not any(c.isalpha() for x in sought for c in x if not x.strip("▁").isalpha())
    for x in list(sought):
        assert m.finite_path(x) == m.shortest_path(x)


def test_memo_keeps_what_is_asked_for():
    from strataform.llm.common import Memo

    made = []
    memo = Memo(lambda k: made.append(k) or -k, 100)
    for k in range(1, 1000):
        assert memo[k] == -k and memo[0] == 0 and len(memo) + len(memo.older) <= 100
    assert made.count(0) == 1 and len(made) == 1000


def test_unigram_paths_by_brute_force():
    """The same composition without the pair machine, pieces weighing minus their scores: the least sum over all segmentations."""
    import itertools
    import random

    m, r = pieces.Machine(SP), random.Random(2)
    m.bpe, m.pair, m.fallback = False, None, pieces.UNKNOWN_PENALTY - min(s for _, s in m.pieces.values())
    m.arcs, m.label, m.weight = m.trie()
    weigh = {i: -s for i, s in m.pieces.values()}
    for _ in range(60):
        text = pieces.MARK + "".join(r.choices("theandingtionré漢", k=r.randint(0, 8)))
        costs = []
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
            parts = [text[a:b] for a, b in zip(edges, edges[1:])]
            if all(p in m.pieces or len(p) == 1 for p in parts):
                costs.append(sum(-m.pieces[p][1] if p in m.pieces else m.fallback for p in parts))
        ids = np.frombuffer(m.shortest_path(text), "<i4").tolist()
        strange = sum(c not in m.pieces for c in text)
        assert sum(weigh.get(i, 0.0) for i in ids) + strange * m.fallback == pytest.approx(min(costs))


def test_finite_paths_are_the_shortest():
    import random

    m, r = pieces.Machine.of(SP), random.Random(3)
    for _ in range(300):
        text = pieces.MARK * r.randint(0, 2) + "".join(r.choices("theandingtionré漢Üx😀", k=r.randint(1, 14)))
        assert m.finite_path(text) == m.shortest_path(text)
    assert m.finite_path("") == m.shortest_path("") == b""


def test_texts_that_come_again_are_encoded_once(spark, docs, monkeypatch):
    """A document that the mixture takes twice costs the last stage one encoding; its rows are as before, without the decoded text."""
    import corpus_pipeline

    m, asked = pieces.Machine.of(SP), []
    monkeypatch.setattr(m, "encode", lambda t, f=m.encode: asked.append(t) or f(t))
    of, back = pieces.each(m, ["one text", "one text", None, "", "two", "one text"])
    assert asked == ["one text", None, "", "two"] and back["one text"] == "one text" and back[None] == "" and len(of[None]) == 0
    twice = docs.unionByName(docs).orderBy("doc_id")
    got = corpus_pipeline.tokenise(spark, twice, "")
    assert got.columns == ["doc_id", "source", "lang", "ids", "n_ids", "lossless"]
    assert sorted(map(str, got.collect())) == sorted(map(str, pieces.encode(docs, SP, keep=("doc_id", "source", "lang")).drop("decoded").collect() * 2))


def test_pieces_query(docs, rows, empty):
    got = pieces.encode(docs, SP).collect()
    assert len(got) == len(rows) and all(r.lossless is not False for r in got)
    assert sorted(r.n_ids for r in got) == sorted(len(np.frombuffer(pieces.Machine.of(SP).encode(x[1]), "<i4")) for x in rows)
    assert pieces.encode(empty, SP).count() == 0


def test_long_payloads_in_bounded_memory(monkeypatch):
    """Frames of one and of many texts are coded some at a time, to the same bytes; a long text takes no more than a few times its size."""
    import resource

    texts = [flac.payload("ab " * 900), flac.payload("x"), flac.payload("the river " * 700)]
    whole = flac.encode(texts)
    monkeypatch.setattr(flac, "FRAMES", 2)
    assert flac.encode(texts) == whole and [bytes(np.frombuffer(p, np.uint8) ^ 0x80) for p in flac.decode(whole)] == texts
    assert bytes(np.frombuffer(flac.decode_range(whole[2], 100, 4000), np.uint8) ^ 0x80) == texts[2][100:4100]
    monkeypatch.undo()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    long = flac.payload("some words go on and on, number 12345. " * 200_000)
    assert bytes(np.frombuffer(flac.decode(flac.encode([long]))[0], np.uint8) ^ 0x80) == long
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kB


def test_added_tokens_as_the_library_has_them():
    """Against an untouched tokenizer: texts that hold an added token's string, whole, in parts, repeated, beside words and spaces."""
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(BPE), tokens.WordCache(BPE)
    assert own.added
    r = np.random.default_rng(6)
    parts = [*own.added, "<|endof", "text|>", "a", " b", "  ", "\n", "word", "don't", "é", "12"]
    texts = ["a<|endoftext|>b", *("".join(r.choice(parts, r.integers(0, 7))) for _ in range(800))]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
