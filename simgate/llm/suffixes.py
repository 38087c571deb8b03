"""Anchors, contexts, front-coded sorted runs, and the merge that never compares a known prefix again.

Suffixes are sorted where anchors stand: of the grams of GRAM bytes that begin in a window of
LENGTH bytes, the one with the least hash (of equal ones the last). Equal windows have their anchor
at the same place, so every window is judged at its anchor. A context is what stands at an anchor:
up to LENGTH bytes from it on and, backwards, up to LENGTH - GRAM bytes before it.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import zstandard

from simgate.llm.pretokens import mix, span_hashes

LENGTH, GRAM = 200, 64
LEFT = LENGTH - GRAM  # most bytes of a window before its anchor
WIDTH = LENGTH + LEFT
#: Window starts of one document that are looked at together; longer documents are cut, with overlaps.
PIECE = 500_000
POSITION = np.uint64((1 << 22) - 1)
#: Stands where a document ends; no byte of UTF-8.
END = 0xFF


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


#: Odd multiplier of the hash by which anchors are chosen, its inverse modulo 2**64, and a number for each byte.
#: Equal grams have equal hashes; nothing is decided by two grams' having the same.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, as far as a piece goes."""
    steps = [np.full(PIECE + 2 * LENGTH, b, np.uint64) for b in (BASE, BASE_INVERSE)]
    for s in steps:
        s[0] = 1
    return np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of the GRAM bytes from each place on."""
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])


def _group_anchors(raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts of LENGTH bytes at least that lie one after another."""
    data = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws])
    begins = np.cumsum(sizes) - sizes
    grams = gram_hashes(data)
    place = POSITION - np.arange(len(grams), dtype=np.uint64)
    chosen = (POSITION - (least_in_windows(grams & ~POSITION | place, LEFT + 1) & POSITION)).astype(np.int64)
    owner = np.repeat(np.arange(len(raws)), sizes)[: len(chosen)]
    start = np.flatnonzero(np.arange(len(chosen)) <= (begins + sizes - LENGTH)[owner])  # windows that don't cross an end
    chosen, owner = chosen[start], owner[start]
    first = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.append(first[1:], len(start)) - 1
    at, cuts = chosen[first], np.searchsorted(owner[first], np.arange(len(raws) + 1)).tolist()
    columns = at, grams[at].view(np.int64), start[first], start[last]
    return [(columns[0][a:b] - k, columns[1][a:b], columns[2][a:b] - k, columns[3][a:b] - k) for a, b, k in zip(cuts[:-1], cuts[1:], begins.tolist(), strict=True)]


def anchors_of(raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of each document: place, gram hash, and the first and last start of the windows it is the anchor of."""
    out = [tuple(np.zeros(0, np.int64) for _ in range(4))] * len(raws)
    held, size = [], 0

    def flush() -> None:
        for i, found in zip(held, _group_anchors([raws[i] for i in held]), strict=True):
            out[i] = found

    for i, raw in enumerate(raws):
        n = len(raw) - LENGTH + 1
        if n > PIECE:
            parts = []
            for k in range(0, n, PIECE):
                at, gram, lo, hi = _group_anchors([raw[k : min(k + PIECE, n) + LENGTH - 1]])[0]
                parts.append((at + k, gram, lo + k, hi + k))
            out[i] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        elif n > 0:
            if held and size + len(raw) > PIECE:
                flush()
                held, size = [], 0
            held.append(i)
            size += len(raw)
    if held:
        flush()
    return out


def tight_hashes(raws: list[bytes], anchors: list[tuple]) -> list[np.ndarray]:
    """Hash of all bytes of each anchor's windows, and of where the anchor is among them."""
    begins = np.cumsum([0, *map(len, raws)])
    at, _, lo, hi = (np.concatenate([a[i] + k for a, k in zip(anchors, begins.tolist(), strict=False)]) for i in range(4))
    both = span_hashes(np.frombuffer(b"".join(raws), np.uint8), lo, hi + LENGTH)
    return np.split(mix(both + (at - lo).astype(np.uint64) * np.uint64(BASE)).view(np.int64), np.cumsum([len(a[0]) for a in anchors])[:-1])


def contexts(raw: bytes, at: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Rows of WIDTH bytes: ``right`` bytes from the anchor on, then ``left`` backwards before it, END elsewhere."""
    data = np.concatenate((np.full(LEFT, END, np.uint8), np.frombuffer(raw, np.uint8), np.full(LENGTH, END, np.uint8)))
    rows = data[at[:, None] + (np.concatenate((np.arange(LENGTH), -1 - np.arange(LEFT))) + LEFT)]
    inside = np.concatenate((np.arange(LENGTH) < right[:, None], np.arange(LEFT) < left[:, None]), 1)
    return np.where(inside, rows, np.uint8(END))


def backward(rows: np.ndarray) -> np.ndarray:
    """Contexts with the part before the anchor first."""
    return np.concatenate((rows[:, LENGTH:], rows[:, :LENGTH]), 1)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1]).astype(np.int64)


def order_of(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


#: What goes with each suffix: document, number and gram of the anchor, real lengths after and before it.
TAIL = np.dtype([("id", "<i8"), ("c", "<i8"), ("gram", "<i8"), ("k", "<i4"), ("right", "<u2"), ("left", "<u2")])


def pack(rows: np.ndarray, tails: np.ndarray) -> bytes:
    """A sorted run, front-coded: of each row what it has in common with the one before, and the rest."""
    shared = np.zeros(len(rows), np.uint16)
    shared[1:] = common(rows[1:], rows[:-1])
    rest = rows[np.arange(rows.shape[1]) >= shared[:, None]]
    return zstandard.compress(struct.pack("<i", len(rows)) + shared.tobytes() + tails.tobytes() + rest.tobytes(), 1)


class Run:
    """Reads a packed run, a suffix at a time."""

    def __init__(self, blob: bytes):
        raw = zstandard.decompress(blob)
        (self.n,) = struct.unpack_from("<i", raw)
        at = 4 + 2 * self.n
        self.shared = np.frombuffer(raw, "<u2", self.n, 4).tolist()
        self.tails = np.frombuffer(raw, TAIL, self.n, at)
        self.raw, self.at, self.i, self.key = raw, at + TAIL.itemsize * self.n, -1, b""

    def next(self) -> int | None:
        """Go to the next suffix: what it shares with the one before; None at the end."""
        self.i += 1
        if self.i >= self.n:
            return None
        shared = self.shared[self.i]
        end = self.at + WIDTH - shared
        self.key = self.key[:shared] + self.raw[self.at : end]
        self.at = end
        return shared


def differing(a: bytes, b: bytes, start: int) -> int:
    """The first place from ``start`` on where two keys of WIDTH bytes differ; WIDTH if nowhere."""
    step = 16
    while start < WIDTH:
        if a[start : start + step] != b[start : start + step]:
            while a[start] == b[start]:
                start += 1
            return start
        start += step
        step = 64
    return WIDTH


def merged(runs: list[Run]):
    """(run, its place, common prefix with the suffix put out before) in order, by a tree of losers.

    Every contender knows what it shares with the suffix put out last. Of two, the one that shares
    more comes first, without a comparison; only where they share equally much are bytes compared,
    and from there on. The loser then knows what it shares with the winner.
    """
    size = 1
    while size < len(runs):
        size *= 2
    gone = -1
    share = [gone] * size  # with the suffix put out last; gone: the run is at its end
    for i, r in enumerate(runs):
        if r.next() is not None:
            share[i] = 0
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's share is set to what it has in common with the winner."""
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        if share[a] == gone:
            return a, b
        d = differing(runs[a].key, runs[b].key, share[a])
        if d == WIDTH or runs[a].key[d] < runs[b].key[d]:
            share[b] = d
            return a, b
        share[a] = d
        return b, a

    winners = list(range(size)) if size > 1 else []
    level = size
    standing = winners
    while len(standing) > 1:
        level //= 2
        following = []
        for j in range(level):
            w, lost = play(standing[2 * j], standing[2 * j + 1])
            loser[level + j] = lost
            following.append(w)
        standing = following
    top = standing[0] if standing else 0
    while share[top] != gone:
        run = runs[top]
        yield top, run.i, share[top]
        shared = run.next()
        share[top] = gone if shared is None else shared
        node = (top + size) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2
