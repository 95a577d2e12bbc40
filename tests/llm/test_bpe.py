import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from corvane.llm import bpe, packing

LETTERS = [*"ab eE'\n\t  .,!1290éß日²½ 😀x's\r_- \xa0\x1c", "'s", "'ll", "'re", "'ve", " the", "ing", "  ", "\n\n"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of(bpe.read_vocabulary())


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=codec.v.rank, special_tokens={})


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_pieces_are_the_patterns_whatever_the_engine():
    for t in texts(500, 1):
        assert bpe.pieces(t) == bpe._EXACT.findall(t)
    for c in map(chr, range(0x250)):
        assert bpe.pieces(f"a{c}b {c}1") == bpe._EXACT.findall(f"a{c}b {c}1")


def test_encoding_is_bpe(codec, reference):
    for t in texts(1500, 2):
        want = reference.encode_ordinary(t)
        assert codec.encode(t).tolist() == want
        assert codec.count(t) == len(want)
        assert codec.decoder.decode(want) == t


def test_encoders_agree_with_merging_by_definition(codec):
    rnd = random.Random(3)
    for _ in range(500):
        data = bytes(rnd.choice(b"abcdeinst ho\xc3\xa9\xe2\x82") for _ in range(rnd.randrange(40)))
        want = codec.v.merge(data)
        assert codec.transducer.encode(data) == want
        assert bpe.longest_first(codec.v, data) == want


def test_transducer_forgets_and_finds_again(codec):
    small = bpe.Transducer(codec.v, max_states=5)
    for w in (b" hello", b" world", b"transducers", b" hello"):
        assert small.encode(w) == codec.v.merge(w)


def test_lookahead_is_bounded(codec):
    """Tokens come out of a stream while it is read, at most two longest tokens behind, whatever the bytes."""
    rnd, longest = random.Random(7), max(map(len, codec.v.rank))
    for letters in (b"abcdefghijklmnopqrstuvwxyz      ", b" ", b"ab", bytes(range(256)), "日本語 один два".encode()):
        data = bytes(rnd.choice(letters) for _ in range(3000))
        read, owed, out = 0, 0, []

        def watched():
            nonlocal read, owed
            for b in data:
                owed = max(owed, read - sum(codec.v.size[t] for t in out))
                read += 1
                yield b

        for t in codec.transducer.stream(watched(), every=1):
            out.append(t)
        assert out == bpe.longest_first(codec.v, data) and owed <= 2 * longest


def test_long_pieces_are_streamed_with_the_same_tokens(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_PIECE", 20)
    rnd = random.Random(8)
    for n in (21, 200, 3000):
        text = "".join(rnd.choice("abcdeinst") for _ in range(n))
        assert codec.transducer.encode(text.encode()) == reference.encode_ordinary(text)
    small = bpe.Transducer(codec.v, max_states=5)
    assert small.encode(b"antidisestablishmentarianism" * 9) == codec.v.merge(b"antidisestablishmentarianism" * 9)


def test_memos_take_no_more_than_they_may(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 2)
    memo = bpe.Memo(len)
    assert [memo[p] for p in ("a", "bb", "ccc", "ccc")] == [1, 2, 3, 3] and len(memo) == 2


def test_white_space_of_any_length_moves_counts_without_overflow(codec, reference):
    for text in (" " * 400 + "x", "\n" * 300 + " y", "-" * 300, "\t \n" * 150):
        want = [len(reference.encode_ordinary(text[: i + 1])) for i in range(len(text))]
        assert bpe.unpack_counts(codec.prefix_deltas(text).tobytes()).tolist() == want


def test_prefix_counts_are_what_encoding_each_prefix_gives(codec, reference):
    for t in texts(400, 4):
        want = [len(reference.encode_ordinary(t[: i + 1])) for i in range(len(t))]
        got = bpe.unpack_counts(codec.prefix_deltas(t).tobytes()).tolist()
        assert got == want
        for budget in (0, 1, 5):
            assert bpe.fits(bpe.unpack_counts(codec.prefix_deltas(t).tobytes()), budget) == max([0, *(i + 1 for i, c in enumerate(want) if c <= budget)])


def test_streaming_decoder_is_an_incremental_utf8_machine(codec):
    rnd = random.Random(5)
    for _ in range(400):
        data = bytes(rnd.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(12))
        d = bpe.Decoder(codec.v)
        parts = [d.feed([codec.v.rank[bytes([b])]]) for b in data] + [d.finish()]
        assert "".join(parts) == data.decode(errors="replace")


def test_pieces_are_encoded_together_as_merging_by_definition(codec, reference, monkeypatch):
    """The short pieces of many texts go through one call, and no piece alone, whatever the memo holds."""
    rnd = random.Random(8)
    data = [bytes(rnd.choice(b"abcdeinst ho\xc3\xa9\xe2\x82") for _ in range(rnd.randrange(bpe.SHORT_PIECE + 1))) for _ in range(2000)]
    flat, n = codec.merges.encode(data)
    assert n.tolist() == [len(codec.v.merge(d)) for d in data]
    assert flat.tolist() == [t for d in data for t in codec.v.merge(d)]
    assert [[x.tolist() for x in codec.merges.encode(d)] for d in ([], [b""])] == [[[], []], [[], [0]]]

    docs = [*texts(600, 9), None, "", "word " * 50]
    want = [None if t is None else reference.encode_ordinary(t) for t in docs]
    monkeypatch.setattr(bpe, "longest_first", None)
    for most in (0, 50, 10**6):
        monkeypatch.setattr(bpe, "MEMO_ENTRIES", most)
        monkeypatch.setattr(bpe, "QUICK_ENTRIES", most)
        own = bpe.Codec(bpe.read_vocabulary())
        for _ in range(2):
            assert own.counted(iter(docs)) == [None if w is None else len(w) for w in want]
            assert own.joined(docs) == [None if w is None else b"".join(t.to_bytes(4, "little") for t in w) for w in want]
        assert len(own.n) <= most and len(own.quick) <= most


def test_long_pieces_are_counted_alone(codec, reference):
    docs = ["ab" * 300 + " x", "é" * (bpe.SHORT_PIECE // 2 + 1), "!" * 5000]
    want = [reference.encode_ordinary(t) for t in docs]
    assert codec.counted(docs) == [len(w) for w in want]
    assert [len(x) // 4 for x in codec.joined(docs)] == [len(w) for w in want]


def test_ids_that_fit_two_bytes_take_two(spark, codec):
    """What the packing carries along: half of the bytes, the same ids; 4 bytes for a vocabulary that needs them."""
    data = bpe.read_vocabulary()
    assert bpe.id_bytes(data) == 2 and bpe.id_bytes(data + b"\nYWJjYWJjYWJj 65536\n") == 4
    docs = [*texts(300, 10), None, "", "ab" * 300]
    for short, full in zip(codec.joined(docs, 2), codec.joined(docs)):
        assert short is full is None or np.frombuffer(short, "<u2").tolist() == np.frombuffer(full, "<i4").tolist()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.quick_tokens(df, id_bytes=2).collect()}
    assert all(rows[i].tokens is rows[i].length is None if t is None else len(rows[i].tokens) == 2 * rows[i].length == 2 * codec.count(t) for i, t in enumerate(docs))


def test_ids_of_either_width_are_unpacked_alike():
    lists = [[1, 50_000, 65_535], [], None, [7]]
    for width in (2, 4):
        held = pa.array([None if x is None else np.array(x, f"<u{width}").tobytes() for x in lists], pa.binary())
        assert packing._as_ids(held, width).to_pylist() == [x or [] for x in lists]
        assert packing._as_ids(held.slice(1, 3), width).to_pylist() == [[], [], [7]]
        assert packing._as_ids(held.slice(1, 1), width).to_pylist() == [[]]
