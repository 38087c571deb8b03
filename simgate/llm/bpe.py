"""Byte-pair encoding: vocabulary files, merging in numpy matrices, and decoding.

Ids are the ranks of a rank file. ``Merger`` encodes many pre-tokens at once: they are padded to
rows of matrices by length; in each round every row merges its leftmost pair of the lowest rank
and closes the gap, and rows without a pair that merges leave the matrix.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
#: Rows longer than this are merged one at a time with a heap, in n log n instead of n**2 steps.
LONGEST_ROW = 1024
#: Cells of one matrix.
CELLS = 1 << 21


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_one(ids: list[int], pair_rank, merged_id) -> list[int]:
    """Merge the leftmost pair of the lowest rank until none merges. pair_rank(a, b): None if it does not merge."""
    n = len(ids)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    alive, heap = [True] * n, []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (r := pair_rank(ids[i], ids[j])) is not None:
            heapq.heappush(heap, (r, i, ids[i], ids[j]))

    ids = list(ids)
    for i in range(n):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j] = merged_id(a, b), False
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [x for x, ok in zip(ids, alive, strict=True) if ok]


class PairTable:
    """Rank (and id) of the token that two neighbouring tokens make; open addressing in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slots, todo = self._slots(keys), np.arange(len(keys))
        self.probes = 1
        while len(todo):
            free = self.keys[slots[todo]] == -1
            at = slots[todo[free]]
            self.keys[at] = keys[todo[free]]  # of several keys the last one stays
            done = self.keys[slots[todo]] == keys[todo]
            self.values[slots[todo[done]]] = values[todo[done]]
            todo = todo[~done]
            slots[todo] = (slots[todo] + 1) & self.mask
            self.probes += bool(len(todo))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it does not merge or a side is padding (-1)."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        shape, keys = keys.shape, keys.ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero(keys >= 0)
        todo = todo[b.ravel()[todo] >= 0]
        slots = self._slots(keys[todo])
        for _ in range(self.probes):
            held = self.keys[slots]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slots[hit]]
            more = ~hit & (held != -1)
            todo, slots = todo[more], (slots[more] + 1) & self.mask
            if not len(todo):
                break
        return out.reshape(shape)

    def rank(self, a: int, b: int) -> int | None:
        slot = ((a << 32 | b) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - self.bits)
        while self.keys[slot] != -1:
            if self.keys[slot] == a << 32 | b:
                return int(self.values[slot])
            slot = (slot + 1) & int(self.mask)
        return None


class Merger:
    """Encode pre-tokens by the ranks of their pieces, as the rank files' library does."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        rows: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = [whole]
            elif len(p) > LONGEST_ROW:
                out[i] = merge_one(self.byte_ids[np.frombuffer(p, np.uint8)].tolist(), self.pairs.rank, self.pairs.rank)
            elif p:
                rows.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, members in rows.items():
            step = max(1, CELLS // width)
            for k in range(0, len(members), step):
                self._matrix(pieces, members[k : k + step], width, out)
        return out

    def _matrix(self, pieces: list[bytes], members: list[int], width: int, out: list[list[int]]) -> None:
        lengths = np.fromiter((len(pieces[i]) for i in members), np.int64, len(members))
        rows = np.full((len(members), width), -1, np.int32)
        rows[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in members), np.uint8)]
        ranks = np.full((len(members), width), NONE, np.int32)
        ranks[:, :-1] = self.pairs.ranks(rows[:, :-1], rows[:, 1:])
        names = np.array(members)
        while len(names):
            at = ranks.argmin(1)  # the first of the lowest: the leftmost
            each = np.arange(len(names))
            low = ranks[each, at]
            done = low == NONE
            if done.any():
                for i, row, n in zip(names[done].tolist(), rows[done].tolist(), lengths[done].tolist(), strict=True):
                    out[i] = row[:n]
                keep = ~done
                names, rows, ranks, lengths, at, low = names[keep], rows[keep], ranks[keep], lengths[keep], at[keep], low[keep]
                if not len(names):
                    return
                width = int(lengths.max())
                rows, ranks, each = rows[:, :width], ranks[:, :width], np.arange(len(names))
            # close the gap: what stands right of the merged pair moves left by one
            columns = np.arange(width)
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            rows, ranks = np.take_along_axis(rows, source, 1), np.take_along_axis(ranks, source, 1)
            lengths = lengths - 1
            rows[each, lengths], ranks[each, lengths] = -1, NONE
            rows[each, at] = low
            # only the pairs on both sides of the new token have another rank
            after = np.minimum(at + 1, width - 1)
            right = np.where(at + 1 < lengths, rows[each, after], -1)
            ranks[each, at] = self.pairs.ranks(low, right)
            has = at > 0
            before = np.maximum(at - 1, 0)
            ranks[each[has], before[has]] = self.pairs.ranks(rows[each, before], low)[has]


class Decoder:
    """Bytes of token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, i in ranks.items():
            tokens[i] = token
        self.tokens = tokens

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))
