"""Word shingles as 64-bit hashes, and two similarity sketches of such sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Frequent words; a hash costs little more than a look at the memo.
MEMO_ENTRIES = 50_000
ODD = np.uint64(0x9E3779B97F4A7C15)
M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word bytes -> 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


class Shingler:
    """Set of the ``width``-word shingles of a text, A-Z lower-cased, words between white space.

    A text of fewer words is one shingle; one without words has none.
    """

    def __init__(self, width: int):
        self.width = width
        self.hashes = WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        codes = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        key = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            key = mix(key * ODD + codes[k:len(codes) - width + 1 + k])
        return np.unique(key)


# Bytes of texts that are cut at a time.
GROUP_BYTES = 1 << 17
# Places in a word and code points whose hashes are tabulated.
PLACES, POINTS = 32, 1024


def text_groups(*columns: pa.Array, size: int | None = None) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, texts of every column) of neighbouring rows, null as empty: at most ``GROUP_BYTES``
    (or ``size``) or one row."""
    most = size or GROUP_BYTES
    texts, size, begin = [], 0, 0
    for row in range(len(columns[0])):
        if row % 64 == 0:
            some = [c.slice(row, 64).cast(pa.binary()).to_pylist() for c in columns]
        each = [found[row % 64] or b"" for found in some]
        more = sum(map(len, each))
        if texts and size + more > most:
            yield begin, [list(x) for x in zip(*texts, strict=True)]
            texts, size, begin = [], 0, row
        texts.append(each)
        size += more
    if texts:
        yield begin, [list(x) for x in zip(*texts, strict=True)]


def _lowered(code: np.ndarray) -> np.ndarray:
    return code.astype(np.uint64) + np.where((code >= 65) & (code <= 90), 32, 0).astype(np.uint64)


def _blank(code: np.ndarray) -> np.ndarray:
    return (code == 32) | ((code >= 9) & (code <= 13))


def _point_hashes(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of a code point at a place of a word, A-Z lower-cased; white space has none."""
    return np.where(_blank(code), np.uint64(0), mix(_lowered(code) * ODD + place.astype(np.uint64) * M1))


TABLE = _point_hashes(np.tile(np.arange(POINTS), PLACES), np.repeat(np.arange(PLACES), POINTS))


class Words:
    """Words of some UTF-8 texts as arrays, one text after the other: where they start and end in
    their text (code points), their hash, their text; A-Z lower-cased, words between white space.
    ``first`` has the first word of every text, then the number of all words."""

    def __init__(self, texts: list[bytes]):
        # Every text ends with a line.
        data = b"\n".join([*texts, b""])
        if data.isascii():
            self.data, self.code = data, np.frombuffer(data, np.uint8)
            size = [len(text) for text in texts]
        else:
            self.data = data.decode()
            self.code = np.frombuffer(self.data.encode("utf-32-le"), np.uint32)
            size = [len(text) if text.isascii() else len(text.decode()) for text in texts]
        edge = np.flatnonzero(np.diff(_blank(self.code), prepend=True))
        self.place, self.stop = edge[::2], edge[1::2]
        size = np.array(size, np.int64) + 1
        base = np.cumsum(size) - size
        self.first = np.searchsorted(self.place, np.append(base, len(self.code)))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.start, self.end = self.place - base[self.text], self.stop - base[self.text]
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        if not len(self.place):
            return np.zeros(0, np.uint64)
        code = self.code[self.place[0]:]
        place = np.arange(len(code)) - np.repeat(self.place - self.place[0], np.diff(np.append(self.place, len(self.code))))
        far = place >= PLACES
        if code.dtype == np.uint8:
            each = TABLE[np.minimum(place, PLACES - 1) * POINTS + code]
        else:
            far |= code >= POINTS
            each = TABLE[np.minimum(place, PLACES - 1) * POINTS + np.minimum(code, POINTS - 1)]
        far = np.flatnonzero(far)
        each[far] = _point_hashes(code[far], place[far])
        return mix(np.add.reduceat(each, self.place - self.place[0]))

    def shingles(self, first: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(which, hash) of the distinct runs of ``width`` words inside each of the runs at ``first``,
        one after the other; none of these is shorter."""
        many = length - width + 1
        which = np.repeat(np.arange(len(first)), many)
        place = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        last = len(self.hash) - width + 1
        every = np.full(max(0, last), width, np.uint64)
        for k in range(width if last > 0 else 0):
            every = mix(every * ODD + self.hash[k:last + k])
        key = every[place]
        # Most runs occur once: only those that share a hash with another are sorted by run and hash.
        both = key ^ mix(which.astype(np.uint64) * ODD)
        order = np.sort(both)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            some = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, both), len(twice) - 1)] == both)
            some = some[np.lexsort((key[some], which[some]))]
            equal = (which[some[1:]] == which[some[:-1]]) & (key[some[1:]] == key[some[:-1]])
            keep = np.ones(len(key), bool)
            keep[some[1:][equal]] = False
            which, key = which[keep], key[keep]
        return which, key

    def sets(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the distinct runs of ``width`` words of every text, in the order of the texts. A
        text of fewer words is one run; one without words has none."""
        count = np.diff(self.first)
        long, short = np.flatnonzero(count >= width), np.flatnonzero((count > 0) & (count < width))
        which, key = self.shingles(self.first[long], count[long], width)
        if not len(short):
            return long[which], key
        first, words = self.first[short], count[short]
        single = words.astype(np.uint64)
        for k in range(width - 1):
            more = words > k
            single[more] = mix(single[more] * ODD + self.hash[first[more] + k])
        text, key = np.append(long[which], short), np.append(key, single)
        order = np.argsort(text, kind="stable")
        return text[order], key[order]


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that are equal for equal sets, whatever the order."""
    one, two = set_keys(hashes, np.zeros(1, np.int64))
    return int(one[0]), int(two[0])


def set_keys(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for sets that lie one after the other from ``starts`` on; none of them is empty."""
    return tuple(np.add.reduceat(part, starts).view(np.int64) for part in (mix(hashes ^ ODD), mix(hashes + M1)))


class FastSimilarity:
    """Fast similarity sketching with ``size`` coordinates, a power of two.

    In round i every element is thrown into a random bin with the value (i, hash); in rounds
    size..2 size - 1 all elements go to bin i - size, so that every coordinate is filled at the
    end. A coordinate keeps its least value, hence the earliest round that reached it, and work
    stops with the round that fills the last one: large sets need a few rounds only. Coordinates
    of two sets are equal with the probability of their Jaccard similarity, and their number is
    concentrated as for independent ones.
    """

    def __init__(self, size: int):
        self.size = size
        self.bits = np.uint64(64 - int(size).bit_length() + 1)
        self.low = np.uint64((1 << 54) - 1)
        self.seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * ODD)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        size, filled = self.size, np.full(self.size, EMPTY)
        at = 0
        while at < 2 * size:
            # Small sets take several rounds at once: more rounds than needed change nothing.
            rounds = np.arange(at, min(2 * size if at >= size else size, at + max(1, 1024 // len(hashes))))
            thrown = mix(hashes[None, :] ^ self.seeds[rounds][:, None])
            values = (thrown & self.low) | (rounds.astype(np.uint64) << np.uint64(54))[:, None]
            if at < size:
                np.minimum.at(filled, (thrown >> self.bits).astype(np.int64).ravel(), values.ravel())
            else:
                filled[rounds - size] = np.minimum(filled[rounds - size], values.min(axis=1))
            at = int(rounds[-1]) + 1
            if filled.max() != EMPTY:
                break
        return filled


class MinHash:
    """Classic MinHash: coordinate i is the least hash of the set under the i-th function."""

    def __init__(self, size: int):
        self.size = size
        self.seeds = mix(np.arange(1, size + 1, dtype=np.uint64) * M2)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(self.size, EMPTY)
        for start in range(0, len(hashes), 512):
            part = mix(hashes[None, start:start + 512] ^ self.seeds[:, None])
            np.minimum(found, part.min(axis=1), out=found)
        return found

    def many(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The sketches, one per row, of sets that lie one after the other from ``starts`` on."""
        found = np.empty((len(starts), self.size), np.uint64)
        for k, seed in enumerate(self.seeds):
            found[:, k] = np.minimum.reduceat(mix(hashes ^ seed), starts)
        return found


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per ``rows`` neighbouring coordinates of a sketch, or of each row of several;
    keys of different bands differ."""
    parts = sketch.reshape(*sketch.shape[:-1], -1, rows)
    key = mix(np.arange(1, parts.shape[-2] + 1, dtype=np.uint64) * ODD)
    for k in range(rows):
        key = mix(key * ODD + parts[..., k])
    return key.view(np.int64)


def miss_probability(similarity: float, bands: int, rows: int) -> float:
    """Chance that a pair of this similarity shares no band."""
    return (1 - similarity**rows) ** bands


def tune_bands(similarity: float, miss: float, size: int) -> tuple[int, int]:
    """(bands, rows) within ``size`` coordinates with the most rows, so the fewest false
    candidates, that miss a pair of ``similarity`` with a chance of at most ``miss``."""
    for rows in range(size, 0, -1):
        bands = size // rows
        if miss_probability(similarity, bands, rows) <= miss:
            return bands, rows
    return size, 1
