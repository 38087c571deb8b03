"""Words and shingles of many texts at once, as numpy arrays of positions and 64-bit hashes."""

from __future__ import annotations

import numpy as np

from simgate.llm.pretokens import mix, span_hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _alphanumeric() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing: digits, a-z, and all beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def _not_space() -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    table = np.ones(256, bool)
    table[0x20] = table[0x09:0x0E] = False
    return table


ALPHANUMERIC, NOT_SPACE = _alphanumeric(), _not_space()


class Words:
    """The words of texts that lie one after another, lower-cased (A-Z only).

    ``first`` has the number of the first word of each text, and last the number of all words.
    """

    def __init__(self, texts: list, kind: np.ndarray):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        data = LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
        inside = np.zeros(len(data) + 1, bool)
        inside[1:] = kind[data]
        flips = np.flatnonzero(inside[1:] != inside[:-1])  # a space ends the data, so they come in pairs
        self.data, self.starts, self.ends = data, flips[::2], flips[1::2]
        begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        self.first = np.searchsorted(self.starts, begins)
        self.sizes = np.diff(self.first)
        self.hashes = span_hashes(data, self.starts, self.ends)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.left = np.repeat(self.first[1:], self.sizes) - np.arange(len(self.starts))  # words from here to the text's end

    def grams(self, n: int) -> np.ndarray:
        """A hash of the n words from each word on; only those that end in the same text mean something."""
        total = np.zeros(len(self.hashes), np.uint64)
        weight = 1
        for i in range(n):
            weight = weight * 0xD1342543DE82EF95 % (1 << 64)
            m = max(len(total) - i, 0)
            total[:m] += self.hashes[i : i + m] * np.uint64(weight)
        return mix(total + np.uint64(n))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def window(self, i: int, n: int) -> bytes:
        """The n words from word i on, joined by spaces."""
        return b" ".join(self.word(j) for j in range(i, i + n))
