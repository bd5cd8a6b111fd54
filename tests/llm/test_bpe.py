import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from heddle.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return bpe.Transducer(open(PATH, encoding="utf-8").read())


def ids(machine, text):
    return np.frombuffer(machine.encode(text), dtype="<u4").tolist()


def test_every_character(machine):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        text = "a".join(points[at : at + 4000])
        got, want = ids(machine, text), LIB.encode(text, add_special_tokens=False).ids
        assert machine.decode(got) == LIB.decode(want, skip_special_tokens=False)
        if got != want:
            bad = [hex(ord(c)) for c in points[at : at + 4000] if ids(machine, f"a{c}b {c}") != LIB.encode(f"a{c}b {c}", add_special_tokens=False).ids]
            assert not bad, bad


def test_odd_texts(machine):
    draw = random.Random(5)
    letters = ["a", "e", "the", "ing", " ", "  ", "\n", "é", "ß", "1", "00", ".", "'s", "###", "<|endoftext|>", "<|", "漢", "🙂", "‍", "\x1c", "\x85", "\t", "Ġ", "aaaa"]
    for _ in range(3000):
        text = "".join(draw.choices(letters, k=draw.randint(0, 40)))
        want = LIB.encode(text, add_special_tokens=False).ids
        assert ids(machine, text) == want, text
        assert machine.decode(want) == LIB.decode(want, skip_special_tokens=False)


def test_long_pieces_are_streamed(machine):
    draw = random.Random(7)
    for text in ("a" * 20001, "-=" * 9999, "".join(draw.choices("abcdehilnorst", k=30000)), "0" * 5003 + "1", "".join(draw.choices("aeiouthng", k=20000)) + "🙂" * 3000):
        assert ids(machine, text) == LIB.encode(text, add_special_tokens=False).ids
    seen = []
    source = machine.stream(b"ab" * 50_000)
    for i in source:
        seen.append(i)
        if len(seen) == 10:
            assert source.gi_frame.f_locals["at"] < 60_000  # emitted before the end is read
            break


def test_broken_bytes_decode(machine):
    draw = random.Random(3)
    for _ in range(300):
        some = [draw.randrange(50257) for _ in range(draw.randint(1, 30))]
        assert machine.decode(some) == LIB.decode(some, skip_special_tokens=False)
        assert machine.decode(some, block=1) == machine.decode(some)


def test_whole_table_and_nulls(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op7_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = LIB.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(want, skip_special_tokens=False).encode()).hexdigest()
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (1, "x " * 100_000, 3), (1, "x " * 100_000, 4)], "doc_id long, text string, ids int")
    out = bpe.digests(df).collect()
    assert sorted(r.n_tokens for r in out)[:2] == [0, 0] and out[2] == out[3]
    assert bpe.digests(df.filter("false")).count() == 0
    back = bpe.decode(bpe.encode(df, ids="tokens"), ids="tokens", text="back")
    assert [r.back for r in back.collect()] == [r.text or "" for r in df.collect()]


def test_digests_as_they_stream(machine, monkeypatch):
    """Pieces found one after the other, digested in small blocks, across special tokens and split characters."""
    monkeypatch.setattr(bpe, "LONG", 40)
    monkeypatch.setattr(bpe, "BLOCK", 12)
    for text in ("", "one two  three\n" * 30, "漢🙂é" * 50 + "<|endoftext|>" + "漢" * 60 + " end", "\x00\x1c" * 40):
        want = LIB.encode(text, add_special_tokens=False).ids
        n, a, b = machine.digest(text)
        assert (n, a) == (len(want), hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest())
        assert b == hashlib.sha256(LIB.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_a_bound_that_is_too_short_costs_no_result(machine, monkeypatch):
    monkeypatch.setattr(machine, "lookahead", 0)
    draw = random.Random(8)
    for text in ("".join(draw.choices("aeiouthng", k=3000)), "".join(draw.choices("tionsae", k=3000))):
        assert ids(machine, text) == LIB.encode(text, add_special_tokens=False).ids


def test_a_long_piece_is_passed_on_in_blocks(machine):
    t = machine
    draw = random.Random(3)
    piece = "".join(draw.choice("abcdefgh") for _ in range(150_000))
    blocks = list(t.flow(piece))
    assert len(blocks) > 2 and max(map(len, blocks)) <= bpe.BLOCK
    assert np.frombuffer(b"".join(blocks), "<u4").tolist() == LIB.encode(piece, add_special_tokens=False).ids
    n, ids, _ = t.digest(piece)
    assert (4 * n, ids) == (len(b"".join(blocks)), hashlib.sha256(b"".join(blocks)).hexdigest())


def small(draw):
    """A random merge list over a few letters, whose tokens have one merge each unless texts repeat."""
    import json

    letters = {b: c for c, b in bpe.byte_alphabet().items()}
    words, merges = [letters[b] for b in range(256)], []
    tokens = ["a", "b", "c"]
    for _ in range(draw.randint(1, 25)):
        a, b = draw.choice(tokens), draw.choice(tokens)
        if len(a + b) > 12 or (a, b) in merges or (a + b in words and draw.random() < 0.9):
            continue
        merges.append((a, b))
        if a + b not in words:
            words.append(a + b)
            tokens.append(a + b)
    return bpe.Transducer(json.dumps({"added_tokens": [], "model": {"vocab": {w: i for i, w in enumerate(words)}, "merges": merges}}))


def test_neighbours_are_tried_along_their_merges(machine):
    """Undoing merges tells the same as merging all bytes of two tokens, on this vocabulary and on small odd ones."""
    draw = random.Random(11)
    assert machine.plain
    machines, seen = [small(draw) for _ in range(300)], 0
    for m, n in [(machine, 4000), *((m, 60) for m in machines if m.plain)]:
        known = list(m.token.values())
        some = [i for i in known if len(m.text[i]) > 1 or m.text[i] in b"abc"]
        for _ in range(n):
            a, b = draw.choice(some), draw.choice(some)
            assert m.stays(a, b) == (m.merged(m.text[a] + m.text[b]) == [a, b]), (m.text[a], m.text[b])
            seen += 1
    assert seen > 15000
    for m in machines:  # also where a text has two merges, so that neighbours' bytes are merged
        for _ in range(20):
            raw = bytes(draw.choices(b"abc", k=draw.randint(1, 14)))
            assert np.frombuffer(m.piece(raw.decode()), dtype="<u4").tolist() == m.merged(raw)
    assert any(not m.plain for m in machines)
