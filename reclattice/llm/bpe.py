"""Byte-level BPE from a rank file, without the library that the file was made for.

A text is cut by a pattern; every match is encoded on its own. Inside a match the encoder takes
the longest token at each position (an Aho-Corasick automaton over bytes written as Latin-1) and
steps back to shorter ones whenever two neighbours would have been merged differently. Whether
two tokens may stand side by side depends on those two alone, so it is worked out once per pair,
and no position is given up twice: the number of steps is linear in the length of the match.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from reclattice.llm.common import TEXTS, add_columns

# Memoised pairs per Python worker; a full memo is emptied, which costs time only.
MEMO_ENTRIES = 300_000
# Memoised pieces in each of two generations: when the younger one is full it becomes the older, so
# what was used since stays.
GENERATION = 200_000
# Texts that are turned into Python strings at a time.
GROUP = 256
# Ids decoded at a time.
DECODED = 1 << 18
# Longer pieces are encoded but not remembered.
MEMO_LENGTH = 64
# Below this code point a word of letters, with at most one mark after it, needs no pattern.
LATIN_END, MARKS = "\u0250", (".", ",")
UNSAFE_SPACE = re.compile(r"[^\S \n]|  | \n|\n |\n\n")


class Codec:
    """Encoder and decoder of one rank file (bytes of a token -> rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.reach = max(map(len, ranks))
        self.shorter: dict[int, int] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.forget()

    def forget(self) -> None:
        """Empties the memos of parts and pairs; what follows from the file alone stays."""
        self.fits: dict[int, bool] = {}
        self.memo = Memo(self)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one last; None for a single byte, and (-1, -1)
        for a token that plain merging of its own bytes never makes."""
        known = self.splits.get(token, 0)
        if known == 0:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            known = None
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    rank = self.ranks.get(parts[i] + parts[i + 1])
                    if rank is not None and (best is None or rank < best):
                        best, at = rank, i
                if best is None:
                    known = (-1, -1)
                    break
                known = (self.ranks[parts[at]], self.ranks[parts[at + 1]])
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.splits[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives exactly these two; ``left`` is -1 at
        the start of a piece, where the token must come out of its own bytes."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= MEMO_ENTRIES:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Takes the merges back, latest first. Should the ends that touch at some stage make a
        token of a lower rank than the merge just undone, plain merging would have chosen it."""
        ranks, bytes_of = self.ranks, self.bytes_of
        if self.split(right) == (-1, -1):
            return False
        if left < 0:
            return True
        if self.split(left) == (-1, -1):
            return False
        bound = len(ranks) + 256
        while True:
            rank = ranks.get(bytes_of[left] + bytes_of[right])
            if rank is not None and rank < bound:
                return False
            one, two = self.split(left), self.split(right)
            if one is None and two is None:
                return True
            # Of equal merges the left one comes first, so it is undone last.
            if two is None or (one is not None and left > right):
                bound, left = left, one[1]
            else:
                bound, right = right + 1, two[0]

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        known = self.shorter.get(token)
        if known is None:
            data = self.bytes_of[token]
            known = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
            self.shorter[token] = known
        return known

    def backtrack(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, end = data.decode("latin-1"), len(data)
        # The longest matches one after the other are the answer unless two neighbours clash.
        longest = [rank for _, rank in self.automaton.iter_long(text)]
        last = -1
        for n, token in enumerate(longest):
            if not self.compatible(last, token):
                return self._step_back(text, longest[:n], token)
            last = token
        return longest

    def _step_back(self, text: str, ids: list[int], token: int) -> list[int]:
        """Goes on from ``ids``, which fit, with ``token`` as the next candidate."""
        end, reach = len(text), self.reach
        at = sum(len(self.bytes_of[i]) for i in ids)
        closed = bytearray(end + 1)
        while True:
            last = ids[-1] if ids else -1
            stop = at + len(self.bytes_of[token])
            if not closed[stop] and self.compatible(last, token):
                ids.append(token)
                if stop == end:
                    return ids
                at = stop
                token = next(self.automaton.iter_long(text[at:at + reach]))[1]
                continue
            token = self.next_shorter(token)
            if token < 0:
                # Nothing fits here: this position is closed for good and the last token shrinks.
                closed[at] = 1
                token = ids.pop()
                at -= len(self.bytes_of[token])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if UNSAFE_SPACE.search(text):
            return b"".join(map(self.memo.__getitem__, self.find(text)))
        # A single space or line break between two other characters always starts a match, so
        # the text may be cut there and each part, word and punctuation together, remembered.
        parts = text.replace("\n", "\x1f\n\x1f").replace(" ", "\x1f ").split("\x1f")
        return b"".join(map(self.memo.__getitem__, parts))


class Memo(dict):
    """Parts of texts, from a word with its marks to a single match -> id bytes."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self._encoded(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= GENERATION:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value

    def _encoded(self, key: str) -> bytes:
        word = key[1:] if key[:1] == " " else key
        if word.isalpha() and max(word) < LATIN_END:
            return _packed(self.codec.backtrack(key.encode()))
        if word[-1:] in MARKS and word[:-1].isalpha() and max(word) < LATIN_END:
            return self[key[:-1]] + self[key[-1]]
        return b"".join([_packed(self.codec.backtrack(p.encode())) for p in self.codec.find(key)])


def _packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}i", *ids)


class Decoder:
    """Bytes of id lists, by gathers from one array of all tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted((rank, token) for token, rank in ranks.items())
        size = tokens[-1][0] + 1
        self.known, self.length = np.zeros(size, bool), np.zeros(size, np.int64)
        places = np.array([rank for rank, _ in tokens])
        self.known[places] = True
        self.length[places] = [len(token) for _, token in tokens]
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(token for _, token in tokens), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        """Unknown ids raise KeyError."""
        if ids.size and not (ids.min() >= 0 and ids.max() < self.known.size and self.known[ids].all()):
            raise KeyError(int(next(i for i in ids if not 0 <= i < self.known.size or not self.known[i])))
        out = []
        for lo in range(0, ids.size, DECODED):
            part = ids[lo : lo + DECODED]
            length = self.length[part]
            at = np.repeat(self.start[part] - (np.cumsum(length) - length), length)
            at += np.arange(at.size)
            out.append(self.blob[at].tobytes())
        return b"".join(out)


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


@lru_cache(maxsize=2)
def _codec(digest: str, pattern: str, held: "_Held") -> Codec:
    return Codec(parse_ranks(held.content), pattern)


class _Held:
    """Carries the file to the cache above without being part of its key."""

    def __init__(self, content: bytes):
        self.content = content

    def __hash__(self):
        return 0

    def __eq__(self, other):
        return isinstance(other, _Held)


def codec_of(content: bytes, pattern: str) -> Codec:
    """The codec of a rank file, built once per Python process."""
    return _codec(hashlib.sha256(content).hexdigest(), pattern, _Held(content))


def _ship(df: DataFrame, path: str):
    """The rank file, read on the driver and broadcast: its size is that of the vocabulary."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", forget: bool = False) -> DataFrame:
    """``df`` with ``out``, the token ids of each text (null: empty). No shuffle. ``forget`` frees the
    memos when a task ends, for workers that go on to other work."""
    sent = _ship(df, ranks_path)

    def make():
        codec = codec_of(sent.value, pattern)

        def step(texts):
            # A few texts at a time, so that a batch is never held as Python strings.
            data = [
                codec.encode(t) if t else b""
                for start in range(0, len(texts), GROUP) for t in texts.slice(start, GROUP).to_pylist()
            ]
            offsets = np.zeros(len(data) + 1, np.int32)
            np.cumsum([len(d) // 4 for d in data], out=offsets[1:])
            values = np.frombuffer(b"".join(data), "<i4")
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))]

        if forget:
            step.close = codec.forget
        return step

    return add_columns(df, [text], f"`{out}` array<int>", make, TEXTS)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the bytes of each id list (null: empty). Unknown ids raise KeyError."""
    sent = _ship(df, ranks_path)

    def make():
        decode_ids = Decoder(parse_ranks(sent.value))

        def step(lists):
            # Neighbouring documents together; a long one by itself, in parts.
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy().astype(np.int64))
            found, first = [], 0
            while first < len(ends):
                at = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, at + DECODED, side="right")))
                ids_here = flat[at : int(ends[last - 1])]
                data = decode_ids(ids_here)
                sizes = np.r_[0, np.cumsum(decode_ids.length[ids_here])]
                cuts = sizes[np.r_[0, ends[first:last] - at]]
                found += [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                first = last
            return [pa.array(found, pa.binary())]

        return step

    return add_columns(df, [ids], f"`{out}` binary", make, TEXTS)
