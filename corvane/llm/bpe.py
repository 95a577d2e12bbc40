"""Operators 1 and 2: byte-level BPE encoding and decoding, and token counts of every prefix.

Encoding.  A token sequence is the BPE encoding of its bytes exactly when each pair of
neighbours is *stable*: encoding the two tokens' bytes together gives the two tokens back
(Berglund and van der Merwe, "Formalizing BPE Tokenization", 2023).  That makes encoding a
finite-state relation: read bytes along the trie of tokens, and at a token's end go on to the
trie's root if the token is stable after the one before.  :class:`Transducer` determinises
this machine lazily by the subset construction.  A state holds all live trie positions, each
with the token before it; a transition puts out the last token of the prefix read so far.
From these, tokens are settled as soon as all live positions agree on them
(:meth:`Transducer.stream`), or all at once at the end of a piece.

Counting.  The last token of each prefix is what the transducer puts out, so the count at a
prefix is one more than at the prefix before that token (:meth:`Transducer.counts`).

Pieces.  Text is first cut by the tokenizer's pattern; encodings and counts are memoised by
piece in each Python worker, up to a fixed number of entries.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import gc
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import pick
from corvane.session import spread

#: The cutting pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts in which ``re`` and Unicode agree on classes; about twice as fast.
_PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_EXACT = regex.compile(PATTERN)
_SPACES = re.compile(r"\s\s")
_ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ɏ]")
#: Where the public vocabulary lies on this machine; every function takes another path.
DEFAULT_VOCABULARY = os.environ.get("CORVANE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: A vocabulary file larger than this is not sent to executors.
MAX_VOCABULARY_BYTES = 64 << 20
#: Bounds of what a worker keeps; a full memo takes no more, states and pairs are dropped and met again.
MEMO_ENTRIES = 400_000
#: Where whole texts' tokens travel on with their rows, workers hold fewer.
QUICK_ENTRIES = 100_000
MAX_STATES = 100_000
MAX_PAIRS = 300_000
#: Pieces of more bytes are encoded as a stream, so that not all of their prefixes are held at once.
LONG_PIECE = 1 << 16
#: Pieces of at most so many bytes are encoded many at once, so many in a matrix.
SHORT_PIECE = 48
MERGED_ROWS = 4096
#: Texts whose pieces are looked up together: so many, or fewer of this many characters.
TOGETHER, TOGETHER_CHARS = 500, 1 << 20
#: A stream looks for settled tokens after so many bytes each time.
STREAM_STEP = 64
NONE = -1


def pieces(text: str) -> list[str]:
    """The text cut by the tokenizer's pattern; joined, the pieces are the text."""
    return _EXACT.findall(text) if _ODD.search(text) else _PLAIN.findall(text)


def _blank(text: str) -> bool:
    """All white space, as Unicode defines it (Python adds the separators 1C to 1F)."""
    return text.isspace() and not any("\x1c" <= ch <= "\x1f" for ch in text)


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The vocabulary file's bytes: a line ``base64 rank`` for each token."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes; too many to broadcast")
    with open(path, "rb") as f:
        return f.read()


def id_bytes(data: bytes) -> int:
    """How many bytes hold any token id of a vocabulary file: 2 or 4."""
    return 2 if max(int(x.split()[1]) for x in data.splitlines() if x.strip()) < 1 << 16 else 4


class Vocabulary:
    """Token bytes by rank; which pairs of tokens are stable side by side."""

    def __init__(self, data: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}
        self.bytes = {r: t for t, r in self.rank.items()}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self._split: dict[int, tuple[int, int]] = {}
        self.known: dict[int, bool] = {}
        self.size = [0] * (max(self.bytes) + 1)
        for t, r in self.rank.items():
            self.size[r] = len(t)

    def __getattr__(self, name: str):
        """The trie is built when it is first asked for; what merges pieces together does without."""
        if name not in ("children", "token", "depth"):
            raise AttributeError(name)
        self._build()
        return self.__dict__[name]

    def _build(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [NONE]
        self.depth: list[int] = [0]
        for t, r in self.rank.items():
            if len(t) > 1 and self.merge(t) != [r]:
                continue  # no text encodes to it
            at = 0
            for b in t:
                nxt = self.children[at].get(b)
                if nxt is None:
                    nxt = self.children[at][b] = len(self.children)
                    self.children.append({})
                    self.token.append(NONE)
                    self.depth.append(self.depth[at] + 1)
                at = nxt
            self.token[at] = r

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """BPE by definition: merge the pair of least rank, leftmost first, until none is left (or none below a rank)."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None or (below is not None and best >= below):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def split(self, t: int) -> tuple[int, int]:
        """The two tokens whose merge made ``t``; a byte gives itself twice."""
        got = self._split.get(t)
        if got is None:
            data = self.bytes[t]
            got = self._split[t] = (t, t) if len(data) == 1 else tuple(self.merge(data, t))  # type: ignore[assignment]
        return got

    def stable(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together encode to just these two tokens.

        Only merges across the border could part them.  The border's two sides grow as the
        merges are replayed, so undo the later-ranked side step by step: the pair is broken
        if, at some step, the sides then present would have merged before the next one grew.
        """
        key = a << 32 | b
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= MAX_PAIRS:
                self.known.clear()
            got = self.known[key] = self._replay(a, b)
        return got

    def _replay(self, a: int, b: int) -> bool:
        rank, data = self.rank, self.bytes
        limit = 1 << 60
        while True:
            joined = rank.get(data[a] + data[b])
            if joined is not None and joined < limit:
                return False
            inner, outer = self.split(a)[1], self.split(b)[0]
            if inner == a and outer == b:
                return True
            if outer == b or (inner != a and a > b):
                limit, a = a, inner
            else:
                limit, b = b + 1, outer


class Transducer:
    """The lazily determinised transducer of a vocabulary; see the module's text.

    A state is a dictionary from bytes to transitions ``(next state, last token)``, and under
    :data:`NONE` its live positions: trie node and token before, longest first, the last of them
    the root with the last token itself.
    """

    def __init__(self, vocabulary: Vocabulary, max_states: int = MAX_STATES):
        self.v, self.max_states = vocabulary, max_states
        self.states: dict[tuple[int, ...], dict] = {}
        self.start: dict = {NONE: (0, NONE)}

    def reset(self) -> None:
        """Forget all states; they are built again as they are met."""
        for s in (*self.states.values(), self.start):
            s.clear()  # transitions are the only cycles
        self.states.clear()
        self.start = {NONE: (0, NONE)}

    def step(self, s: dict, byte: int) -> tuple[dict, int]:
        """Build the transition by a byte.

        Of the tokens that end here the longest that is stable after the one before it is the
        encoding's; there is always one, since every prefix has one encoding.
        """
        v = self.v
        children, token, known = v.children, v.token, v.known
        live, last = [], NONE
        each = iter(s[NONE])
        for node, before in zip(each, each):
            nxt = children[node].get(byte)
            if nxt is None:
                continue
            if last == NONE:
                t = token[nxt]
                if t != NONE:
                    fine = before == NONE or known.get(before << 32 | t)
                    if fine or (fine is None and v.stable(before, t)):
                        last = t
            if children[nxt]:
                live += (nxt, before)
        live += (0, last)
        key = tuple(live)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = {NONE: key}
        got = s[byte] = (to, last)
        return got

    def lasts(self, data: bytes) -> list[int]:
        """The last token of each prefix."""
        if len(self.states) > self.max_states:
            self.reset()
        s, out = self.start, []
        for byte in data:
            got = s.get(byte)
            if got is None:
                got = self.step(s, byte)
            s, t = got
            out.append(t)
        return out

    def encode(self, data: bytes) -> list[int]:
        if len(data) > LONG_PIECE:
            return list(self.stream(data))
        last, size, at, out = self.lasts(data), self.v.size, len(data), []
        while at:
            t = last[at - 1]
            out.append(t)
            at -= size[t]
        out.reverse()
        return out

    def counts(self, data: bytes) -> list[int]:
        """The number of tokens of each prefix."""
        size, out = self.v.size, [0]
        for at, t in enumerate(self.lasts(data), 1):
            out.append(out[at - size[t]] + 1)
        return out[1:]

    def stream(self, data: Iterable[int], every: int = STREAM_STEP) -> Iterator[int]:
        """Tokens as soon as they are settled, looked for after every so many bytes.

        A token is settled once it is in the encoding of every prefix that a live position
        starts from, whatever follows.  How many bytes that takes is bounded by the vocabulary
        alone (Berglund and van der Merwe); only the bytes since the last settled token are held.
        """
        size, depth = self.v.size, self.v.depth
        s, last = self.start, []
        for n, byte in enumerate(data, 1):
            got = s.get(byte)
            if got is None:
                got = self.step(s, byte)
            s, t = got
            last.append(t)
            if n % every:
                continue
            starts = {len(last) - depth[node] for node in s[NONE][::2]}
            while len(starts) > 1:  # of two prefixes the longer one's encoding goes back until both meet
                at = max(starts)
                starts.discard(at)
                starts.add(at - size[last[at - 1]])
            settled = starts.pop()
            if settled > 0:
                yield from self._back(last, settled)
                del last[:settled]
            if len(self.states) > self.max_states:
                live = s[NONE]
                self.reset()
                s = self.states[live] = {NONE: live}
        yield from self._back(last, len(last))

    def _back(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at - 1])
            at -= self.v.size[out[-1]]
        return out[::-1]


def longest_first(v: Vocabulary, data: bytes) -> list[int]:
    """The encoding by the longest stable token at each place, going back where none is stable.

    The same tokens as the transducer's without building its states; for texts that are only
    to be counted.  A place that led nowhere isn't tried again, so the work is linear.
    """
    children, token, known, n = v.children, v.token, v.known, len(data)
    out: list[int] = []
    starts: list[int] = []
    dead: set[int] = set()
    at, options = 0, None
    held: list[list[tuple[int, int]]] = []  # by token taken, the shorter ones not yet tried
    while at < n:
        if options is None:
            options, node = [], 0
            for end in range(at, n):
                node = children[node].get(data[end])
                if node is None:
                    break
                if token[node] != NONE:
                    options.append((token[node], end + 1))
        before = out[-1] if out else NONE
        while options:
            t, end = options.pop()
            if end in dead:
                continue
            if before != NONE:
                fine = known.get(before << 32 | t)
                if fine is None:
                    fine = v.stable(before, t)
                if not fine:
                    continue
            out.append(t)
            starts.append(at)
            held.append(options)
            at, options = end, None
            break
        else:
            dead.add(at)
            out.pop()
            at, options = starts.pop(), held.pop()
    return out


class Merges:
    """BPE by definition, of many short pieces at once: each round merges every piece's leftmost pair of least rank.

    A row of a matrix holds a piece's tokens, and another one the ranks of its pairs; rows that have
    nothing left to merge leave.  The same tokens as :meth:`Vocabulary.merge`.
    """

    #: No rank: what a pair that isn't in the vocabulary has.
    NO = np.int32(2**31 - 1)

    def __init__(self, rank: dict[bytes, int]):
        self.pad = max(rank.values()) + 1  # after a piece's end; in no pair
        found = {}
        for t, r in rank.items():
            for i in range(1, len(t)):
                a = rank.get(t[:i])
                if a is not None and (b := rank.get(t[i:])) is not None:
                    found[a * (self.pad + 1) + b] = r
        self.keys = np.fromiter(sorted(found), np.int64, len(found))
        self.ranks = np.array([found[k] for k in self.keys.tolist()] + [self.NO], np.int32)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.byte = np.array([*(rank[bytes([b])] for b in range(256)), self.pad], np.int32)
        self.first = self.of(np.repeat(self.byte, 257), np.tile(self.byte, 257)).reshape(257, 257)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs."""
        key = a.astype(np.int64) * (self.pad + 1) + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], self.NO)

    def encode(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' tokens one after another, and how many each has; for pieces of up to :data:`SHORT_PIECE` bytes."""
        size = np.fromiter(map(len, data), np.int64, len(data))
        rows = np.full((len(data), int(size.max(initial=1))), self.pad, np.int32)
        n = size.copy()
        order = np.argsort(size, kind="stable")
        flat, start = np.frombuffer(b"".join(data), np.uint8), np.cumsum(size) - size
        for lo in range(0, len(order), MERGED_ROWS):
            some = order[lo : lo + MERGED_ROWS]
            wide = np.arange(max(1, int(size[some[-1]])))
            inside = wide < size[some, None]
            raw = np.full(inside.shape, 256, np.int64)
            raw[inside] = flat[(start[some, None] + wide)[inside]]
            at = some
            tokens, ranks = self.byte[raw], np.full(raw.shape, self.NO, np.int32)
            ranks[:, :-1] = self.first[raw[:, :-1], raw[:, 1:]]
            while len(at):
                left = ranks.argmin(1)
                each = np.arange(len(at))
                best = ranks[each, left]
                done = best == self.NO
                if done.any():
                    rows[at[done], : tokens.shape[1]] = tokens[done]
                    go = ~done
                    at, tokens, ranks, left, best = at[go], tokens[go], ranks[go], left[go], best[go]
                    if not len(at):
                        break
                    each = each[: len(at)]
                n[at] -= 1
                after = wide[1 : tokens.shape[1]] > left[:, None]
                tokens[:, :-1][after], ranks[:, :-1][after] = tokens[:, 1:][after], ranks[:, 1:][after]
                tokens[:, -1], ranks[:, -1] = self.pad, self.NO
                tokens[each, left] = best
                last = tokens.shape[1] - 1
                ranks[each, left] = np.where(left < last, self.of(best, tokens[each, np.minimum(left + 1, last)]), self.NO)
                inner = np.flatnonzero(left)
                ranks[inner, left[inner] - 1] = self.of(tokens[inner, left[inner] - 1], best[inner])
                keep = int(n[at].max())
                tokens, ranks = tokens[:, :keep], ranks[:, :keep]
        return rows[np.arange(rows.shape[1]) < n[:, None]], n


class Decoder:
    """Streaming decoder: tokens in, text out as soon as its characters are whole.

    An incremental UTF-8 machine whose states are the bytes still pending (at most three).
    Bytes that can't be UTF-8 become U+FFFD, one for each maximal ill-formed part, as
    ``bytes.decode(errors="replace")`` does.  Steps by token are memoised.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.steps: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self.pending = b""
        #: By token, its text if it is whole characters by itself.
        self.whole: list[str | None] = [None] * (max(vocabulary.bytes) + 1)
        for t, b in vocabulary.bytes.items():
            if b.decode(errors="ignore").encode() == b:
                self.whole[t] = b.decode()

    @staticmethod
    def _expects(lead: int) -> tuple[int, int, int]:
        """How many bytes follow a lead byte, and the bounds of the first of them; 0 for none."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0, 0

    @classmethod
    def advance(cls, pending: bytes, data: bytes) -> tuple[str, bytes]:
        """The machine itself, by bytes: the text that is whole now, and the bytes pending."""
        out, held = [], bytearray(pending)
        for b in data:
            if held:
                follow, low, high = cls._expects(held[0])
                if len(held) > 1:
                    low, high = 0x80, 0xBF
                if low <= b <= high:
                    held.append(b)
                    if len(held) == follow + 1:
                        out.append(held.decode())
                        held.clear()
                    continue
                out.append("�")
                held.clear()
            if b < 0x80:
                out.append(chr(b))
            elif cls._expects(b)[0]:
                held.append(b)
            else:
                out.append("�")
        return "".join(out), bytes(held)

    def feed(self, tokens: Iterable[int]) -> str:
        out, at = [], self.pending
        tokens = list(tokens)
        if not at and len(tokens) > 1:
            text = itemgetter(*tokens)(self.whole)
            if None not in text:
                return "".join(text)
        steps = self.steps[at]
        for t in tokens:
            got = steps.get(t)
            if got is None:
                got = steps[t] = self.advance(at, self.v.bytes[t])
                self.steps.setdefault(got[1], {})
            text, nxt = got
            out.append(text)
            if nxt != at:
                at, steps = nxt, self.steps[nxt]
        self.pending = at
        return "".join(out)

    def finish(self) -> str:
        """The end of the stream: pending bytes are an ill-formed part."""
        rest, self.pending = ("�" if self.pending else ""), b""
        return rest

    def decode(self, tokens: Iterable[int]) -> str:
        self.pending = b""
        return self.feed(tokens) + self.finish()


@functools.cache
def pack(n: int) -> Callable[..., bytes]:
    """Packs ``n`` token ids as little-endian int32."""
    return struct.Struct(f"<{n}i").pack


class Memo(dict):
    """Results by piece; a full memo takes no more, and what it lacks is worked out each time."""

    def __init__(self, work: Callable, most: int | None = None):
        super().__init__()
        self.work, self.most = work, MEMO_ENTRIES if most is None else most

    def __missing__(self, piece: str):
        got = self.work(piece)
        if len(self) < self.most:
            self[piece] = got
        return got


@contextlib.contextmanager
def no_cycle_search() -> Iterator[None]:
    """Off while texts are encoded: no cycles arise there, and searching millions of small objects
    for some costs more than the work.  What is held by then isn't searched later either."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        if was:
            gc.enable()


def _together(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of up to :data:`TOGETHER`, of no more than :data:`TOGETHER_CHARS` but for their last text."""
    held, chars = [], 0
    for t in texts:
        held.append(t)
        chars += len(t or "")
        if len(held) == TOGETHER or chars >= TOGETHER_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


class Codec:
    """What a Python worker keeps: vocabulary, transducer, decoder and memos by piece."""

    _held: dict[int, Codec] = {}

    def __init__(self, data: bytes):
        self.v = Vocabulary(data)
        self.ids, self.deltas = Memo(self._packed), Memo(self.piece_deltas)
        self.n: dict[str, int] = {}
        self.quick: dict[str, bytes] = {}
        self.quick_short: dict[str, bytes] = {}

    @functools.cached_property
    def merges(self) -> Merges:
        return Merges(self.v.rank)

    @functools.cached_property
    def transducer(self) -> Transducer:
        return Transducer(self.v)

    @functools.cached_property
    def decoder(self) -> Decoder:
        return Decoder(self.v)

    @classmethod
    def of(cls, data: bytes) -> Codec:
        key = hash(data)
        if key not in cls._held:
            cls._held.clear()
            cls._held[key] = cls(data)
        return cls._held[key]

    def _packed(self, piece: str) -> bytes:
        tokens = self.transducer.encode(piece.encode())
        return pack(len(tokens))(*tokens) if len(tokens) < 64 else np.array(tokens, "<i4").tobytes()

    def _size(self, piece: str) -> int:
        return len(self.transducer.encode(piece.encode()))

    def encode(self, text: str) -> np.ndarray:
        """Token ids (int32) of a whole text."""
        return np.frombuffer(b"".join(map(self.ids.__getitem__, pieces(text))), "<i4")

    def counted(self, texts: Iterable[str | None]) -> list[int | None]:
        """The number of tokens of each text; None for None."""
        return self._looked_up(texts, self.n, MEMO_ENTRIES, lambda flat, n: n.tolist(), sum, len)

    def joined(self, texts: Iterable[str | None], id_bytes: int = 4) -> list[bytes | None]:
        """Each text's token ids as little-endian integers of 4 or 2 bytes; None for None."""

        def parts(flat: np.ndarray, n: np.ndarray) -> list[bytes]:
            data, ends = flat.astype(f"<u{id_bytes}").tobytes(), (np.cumsum(n) * id_bytes).tolist()
            return [data[a:b] for a, b in zip([0, *ends], ends)]

        memo = self.quick if id_bytes == 4 else self.quick_short
        return self._looked_up(texts, memo, QUICK_ENTRIES, parts, b"".join, lambda tokens: np.array(tokens, f"<u{id_bytes}").tobytes())

    def _looked_up(self, texts: Iterable[str | None], memo: dict, most: int, short: Callable, join: Callable, long: Callable) -> list:
        """``join`` of the results of each text's pieces; those that ``memo`` lacks are encoded together.

        A full memo takes no more, so that it holds ``most`` of them between calls.
        """
        out: list = []
        for some in _together(texts):
            cut = [None if t is None else pieces(t) for t in some]
            new = list(set().union(*(c for c in cut if c)).difference(memo))
            data = [p.encode() for p in new]
            brief = [i for i, d in enumerate(data) if len(d) <= SHORT_PIECE]
            memo.update(zip((new[i] for i in brief), short(*self.merges.encode([data[i] for i in brief]))))
            if len(brief) < len(new):
                memo.update((p, long(longest_first(self.v, d))) for p, d in zip(new, data) if len(d) > SHORT_PIECE)
            out += [None if c is None else join(map(memo.__getitem__, c)) for c in cut]
            for p in new[max(0, most - len(memo) + len(new)) :]:
                del memo[p]
        return out

    def count(self, text: str) -> int:
        """The number of tokens of a whole text."""
        return self.counted([text])[0]

    def _piece_counts(self, piece: str) -> list[int]:
        """Token counts at each character of a piece, as if the text ended there."""
        data = piece.encode()
        at = self.transducer.counts(data)
        if len(data) != len(piece):
            at = [at[e - 1] for e in np.cumsum([len(ch.encode()) for ch in piece]).tolist()]
        if piece in ("'re", "'ve", "'ll"):
            at[1] = 2  # "'r" alone is cut into "'" and "r"
        return at

    @staticmethod
    def _steps(at: list[int]) -> bytes:
        steps = [b - a for a, b in zip([0, *at], at)]
        return struct.pack(f"<{len(steps)}h", *steps)

    def piece_deltas(self, piece: str) -> bytes:
        """For each character of a piece, by how much the count grows there, as int16 (a token would need 32,768 bytes to move it further)."""
        return self._steps(self._piece_counts(piece))

    def prefix_deltas(self, text: str) -> np.ndarray:
        """int16 for each character; the running sum is the token count of ``text[:k + 1]``."""
        if _SPACES.search(text):
            return self._spaced_deltas(pieces(text))
        return np.frombuffer(b"".join(map(self.deltas.__getitem__, pieces(text))), "<i2")

    def _spaced_deltas(self, parts: list[str]) -> np.ndarray:
        """The same where white space follows white space: a prefix that ends within the run
        ends in one piece, while with text after it the run is cut before its last character."""
        out, run, owed = [], "", 0
        for i, p in enumerate(parts):
            more = i + 1 < len(parts)
            if run or (_blank(p) and more and _blank(parts[i + 1][0])):
                run += p
                if _blank(p) and more and _blank(parts[i + 1][0]):
                    continue
                got = self._run_deltas(run, p)
                if _blank(p) and more:
                    late = self._size(run[: len(run) - len(p)]) + self._size(p) - self._size(run)
                else:
                    late = 0
                run = ""
            else:
                got, late = self.piece_deltas(p), 0
            if owed:
                got = struct.pack("<h", struct.unpack("<h", got[:2])[0] + owed) + got[2:]
            out.append(got)
            owed = late
        return np.frombuffer(b"".join(out), "<i2")

    def _run_deltas(self, run: str, last: str) -> bytes:
        """Deltas over a run of white space and the piece that takes its last character along.

        Within the run, a prefix's white space is one piece; beyond it, the run without its
        last character is one piece and ``last`` another.
        """
        space = next((i for i, ch in enumerate(run) if not _blank(ch)), len(run))
        at = self._piece_counts(run[:space])
        if space < len(run):
            base = self._size(run[: len(run) - len(last)])
            at += [base + c for c in self._piece_counts(last)[space - len(run) + len(last) :]]
        return self._steps(at)


def unpack_counts(deltas: bytes | None) -> np.ndarray | None:
    """Token counts of all prefixes from a stored ``prefix_deltas`` value."""
    return None if deltas is None else np.cumsum(np.frombuffer(deltas, "<i2"), dtype=np.int64)


def fits(counts: np.ndarray, budget: int) -> int:
    """How many leading characters of the text fit a budget of tokens: the longest prefix within it."""
    if len(counts) == 0 or counts[-1] <= budget:
        return len(counts)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def _broadcast(df: DataFrame, vocabulary: str):
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))


def encode_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Operator 1: ``(id, n_tokens, token_ids, round_trip)`` for each row of ``docs``.

    ``round_trip`` says whether the streaming decoder gives the text back.  A null text has
    nulls in all three; an empty text has no tokens, 0 and true.  Rows are kept as often as
    they occur, also with null ids; other columns are ignored.
    """
    held = _broadcast(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, same = [], []
                with no_cycle_search():
                    for text in part.column(1):
                        text = text.as_py()
                        ids.append(None if text is None else codec.encode(text))
                        same.append(None if text is None else codec.decoder.decode(ids[-1].tolist()) == text)
                n = [None if x is None else len(x) for x in ids]
                ends = np.cumsum([0, *(x or 0 for x in n)], dtype=np.int32)
                flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, "<i4")])
                nulls = pa.array([x is None for x in ids], pa.bool_()) if None in n else None
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=nulls)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), lists, pa.array(same, pa.bool_())], names=names)

    names = [id_col, "n_tokens", "token_ids", "round_trip"]
    kind = docs.schema[id_col].dataType.simpleString()
    return spread(pick(docs, id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int, token_ids array<int>, round_trip boolean")


def decode_tokens(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", tokens_col: str = "token_ids") -> DataFrame:
    """Operator 1, backwards: ``(id, text)`` from token ids.

    Null ids lists give null; an empty list the empty text; bytes that aren't UTF-8 U+FFFD.
    An id that the vocabulary lacks raises ``KeyError``.
    """
    held = _broadcast(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Codec.of(held.value).decoder
        for batch in batches:
            text = [None if x is None else decoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(pick(df, id_col, tokens_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def token_counts(docs: DataFrame, budgets: tuple[int, ...] = (512, 2048, 8192), vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Operator 2: ``(id, n_tokens, prefix_deltas, keep_<budget>...)`` for each row of ``docs``.

    ``prefix_deltas`` has a signed 16-bit number (little-endian) for each character; its running sum (see
    :func:`unpack_counts`) is the exact token count of every prefix, as encoding that prefix
    alone gives it.  ``keep_<budget>`` is the number of leading characters of the longest
    prefix that has at most so many tokens.  A null text has nulls; an empty text 0 and an
    empty value.  Repeated rows are kept; other columns are ignored.
    """
    held = _broadcast(docs, vocabulary)
    names = [id_col, "n_tokens", "prefix_deltas", *(f"keep_{b}" for b in budgets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows: list[list] = [[] for _ in names[1:]]
                with no_cycle_search():
                    for text in part.column(1):
                        text = text.as_py()
                        if text is None:
                            for r in rows:
                                r.append(None)
                            continue
                        deltas = codec.prefix_deltas(text)
                        counts = np.cumsum(deltas, dtype=np.int32)
                        rows[0].append(int(counts[-1]) if len(counts) else 0)
                        rows[1].append(deltas.tobytes())
                        for r, b in zip(rows[2:], budgets):
                            r.append(fits(counts, b))
                kinds = [pa.int32(), pa.binary(), *(pa.int32() for _ in budgets)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    keep = "".join(f", keep_{b} int" for b in budgets)
    return spread(pick(docs, id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int, prefix_deltas binary{keep}")


def count_column(df: DataFrame, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY):
    """A column with the number of tokens of ``text``; null for null."""
    held = _broadcast(df, vocabulary)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        codec = Codec.of(held.value)
        with no_cycle_search():
            return pd.Series(codec.counted(texts), dtype="Int32")

    return count(df[f"`{text}`"])


def quick_tokens(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 4) -> DataFrame:
    """``(id, length, tokens)``: token ids as little-endian integers of 4 or 2 bytes, found as in :func:`count_column`; null for null."""
    held = _broadcast(docs, vocabulary)
    names = [id_col, "length", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                with no_cycle_search():
                    out = codec.joined((x.as_py() for x in part.column(1)), id_bytes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else len(x) // id_bytes for x in out], pa.int32()), pa.array(out, pa.binary())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return pick(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, length int, tokens binary")
