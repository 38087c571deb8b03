"""Cut texts into pre-tokens with numpy, and turn repeated pre-tokens into token ids once.

The patterns of the public tokenizers split text into runs of letters, numbers, white space and
the rest. The class of every code point is looked up in one table, the cuts follow from where the
class changes, and no regular expression is matched over the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex

LETTER, NUMBER, SPACE, REST, SPECIAL = 1, 2, 3, 0, 4
#: Stands for a special string in a text; no valid text holds a lone surrogate.
MARK = "\udc00"
#: The contractions that the patterns name.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Modulus of the rolling hashes, a Mersenne prime, and two bases below it. (Modulo a power of two, words such as
#: those of Thue and Morse collide for every base.)
PRIME = np.uint64((1 << 31) - 1)
BASES = (1_288_490_189, 773_094_113)
#: Characters of a span whose key is the span itself.
SHORT = 7
HASHED = np.uint64(1 << 63)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, by the Unicode properties that the patterns use."""
    table = np.zeros(0x110000, np.uint8)
    points = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            table[m.start() : m.end()] = kind
    table[ord(MARK)] = SPECIAL
    return table


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """The same modulo PRIME, and smaller."""
    return (x & PRIME) + (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = _fold(_fold(_fold(x)))
    return np.where(x >= PRIME, x - PRIME, x)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo PRIME for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        made = []
        for b in (base, pow(base, -1, int(PRIME))):
            own = np.ones(1, np.uint64)
            while len(own) < max(n, 1 << 16):
                own = np.concatenate((own, _reduced(own * np.uint64(pow(b, len(own), int(PRIME))))))
            made.append(own)
        _powers[base] = made[0], made[1]
    up, down = _powers[base]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal spans: polynomials at two bases modulo a prime."""
    n = len(values)
    plus = values.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    lanes = []
    for base in BASES:
        up, down = powers(base, n + 1)
        terms = plus * up[:n]
        if values.dtype.itemsize > 1 or n > 1 << 24:  # else no span's sum reaches 2**64
            terms = _fold(terms)
        np.cumsum(terms, out=sums[1:])
        lanes.append(_reduced(_reduced(sums[ends] - sums[starts]) * down[starts]))
    return mix((lanes[0] << np.uint64(31) | lanes[1]) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A key of each span of code points: the characters themselves of up to SHORT below U+0100, else a hash with HASHED set."""
    sizes = ends - starts
    wide = np.flatnonzero(points > 255)
    plain = sizes <= SHORT
    if len(wide):
        plain &= np.searchsorted(wide, starts) == np.searchsorted(wide, ends)
    data = np.concatenate((points.astype(np.uint8), np.zeros(8, np.uint8)))
    eights = np.ndarray((len(points) + 1,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    masks = np.array([(1 << 8 * i) - 1 for i in range(SHORT + 1)], np.uint64)
    short = np.minimum(sizes, SHORT)
    keys = eights[starts] & masks[short] | short.astype(np.uint64) << np.uint64(56)
    rest = np.flatnonzero(~plain)
    if len(rest):
        own, upto = gather(points, starts[rest], sizes[rest]), np.cumsum(sizes[rest])
        keys[rest] = span_hashes(own, upto - sizes[rest], upto) | HASHED
    return keys


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a and b hold the same ``sizes`` values from each pair of places on."""
    if not len(sizes):
        return np.zeros(0, bool)
    differ = np.concatenate(([0], np.cumsum(gather(a, a_starts, sizes) != gather(b, b_starts, sizes))))
    upto = np.cumsum(sizes)
    return differ[upto] == differ[upto - sizes]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _contractions(points: np.ndarray, edge: np.ndarray, candidates: np.ndarray) -> list[tuple[int, int]]:
    """(position of the apostrophe, length) where a contraction stands at a token's start."""
    found = []
    n = len(points)
    for s in candidates.tolist():
        for c in CONTRACTIONS:
            if s + len(c) <= n and not edge[s + 1 : s + len(c)].any() and all(points[s + i] == ord(x) for i, x in enumerate(c)):
                found.append((int(s), len(c)))
                break
    return found


def cut(points: np.ndarray, bounds: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of texts that lie one after another.

    ``bounds`` are the starts of the texts and, last, the length; no pre-token crosses them.
    ``spaced``: a single space joins the run after it and white space is kept (the pattern of the
    rank files); else white space is dropped and each number stands alone (the word pattern).
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[1:n] = kind[1:] != kind[:-1]
    first[bounds] = True
    special = np.flatnonzero(kind == SPECIAL)
    first[special] = first[special + 1] = True
    if not spaced:
        first[:n] |= kind == NUMBER
    edge = np.zeros(n + 1, bool)
    edge[bounds] = edge[special] = True
    # an apostrophe that is a run of its own and starts a token may begin a contraction
    lone = np.flatnonzero((points == 39) & first[:n] & first[1:])
    if spaced and len(lone):
        before = np.maximum(lone - 1, 0)
        lone = lone[edge[lone] | (points[before] != 32)]
    for s, length in _contractions(points, edge, lone):
        first[s + 1 : s + length] = False
        first[s + length] = True
    if spaced:
        # the last white space before other text: a space joins that text, another stands alone
        last = np.flatnonzero((kind == SPACE) & ~np.append(kind[1:] == SPACE, False) & ~edge[1:])
        first[last] = True
        joins = last[points[last] == 32]
        first[joins + 1] = False
    starts = np.flatnonzero(first[:n])
    ends = np.append(starts[1:], n)
    if not spaced:
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s:s+n] of every pair, one after another."""
    total = int(lengths.sum())
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
    return values[at]


class Strings:
    """Distinct strings as arrays of code points; ``find`` compares the text itself, not hashes alone."""

    def __init__(self):
        self.keys, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.points, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def find(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each span's string, -1 where it is none of them."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = np.where(self.keys[near] == keys, self.order[near], -1)
        doubt = np.flatnonzero((found >= 0) & (keys >= HASHED))
        equal = self.sizes[found[doubt]] == sizes[doubt]
        found[doubt[~equal]] = -1
        doubt = doubt[equal]
        found[doubt[~same_spans(self.points, self.starts[found[doubt]], points, starts[doubt], sizes[doubt])]] = -1
        return found

    def add(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new strings. Of two with one key only one is found again."""
        numbers = len(self) + np.arange(len(keys))
        self.starts = np.concatenate((self.starts, len(self.points) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.points = np.concatenate((self.points, gather(points, starts, sizes)))
        order = np.argsort(keys, kind="stable")
        to = np.searchsorted(self.keys, keys[order])
        self.keys, self.order = np.insert(self.keys, to, keys[order]), np.insert(self.order, to, numbers[order])
        return numbers


def grouped(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each span the number of its text, and of each distinct text its key and the first span that has it."""
    sizes, keys = ends - starts, span_keys(points, starts, ends)
    codes, unique = pd.factorize(keys)
    first = np.zeros(len(unique), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    doubt = np.flatnonzero((keys >= HASHED) & (first[codes] != np.arange(len(codes))))
    like = first[codes[doubt]]
    odd = sizes[like] != sizes[doubt]
    same = np.flatnonzero(~odd)
    odd[same] = ~same_spans(points, starts[like[same]], points, starts[doubt[same]], sizes[doubt[same]])
    odd = doubt[odd]  # another text with the same hash: a text of its own each
    codes[odd] = len(unique) + np.arange(len(odd))
    return codes, np.concatenate((unique, keys[odd])), np.concatenate((first, odd))


class Memo:
    """Token ids of pre-tokens, each worked out once; emptied when it holds too many."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 1_000_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.strings = Strings()
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def look_up(self, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (for ``ids_of``) and numbers of ids for each span of the text."""
        if len(self.strings) > self.most or len(self.strings.points) > 16 * self.most:
            self.clear()
        codes, keys, first = grouped(points, starts, ends)
        sizes = ends[first] - starts[first]
        where = self.strings.find(keys, points, starts[first], sizes)
        new = np.flatnonzero(where < 0)
        if len(new):
            made = self.encode([text[starts[i] : ends[i]] for i in first[new].tolist()])
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            offsets = len(self.ids) + np.concatenate(([0], np.cumsum(lengths)[:-1]))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(made), np.int32, int(lengths.sum()))))
            self.starts, self.lengths = np.concatenate((self.starts, offsets)), np.concatenate((self.lengths, lengths))
            where[new] = self.strings.add(keys[new], points, starts[first[new]], sizes[new])
        place = where[codes]
        return place, self.lengths[place]

    def ids_of(self, place: np.ndarray) -> np.ndarray:
        return gather(self.ids, self.starts[place], self.lengths[place])


def joined(texts: list) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts one after another (null: empty), their code points, and where each begins, with the end."""
    texts = [t or "" for t in texts]
    text = "".join(texts)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return text, code_points(text), bounds
