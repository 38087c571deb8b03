"""Min-max hashing of shingle sets: signatures and band keys of many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

from simgate.llm.pretokens import mix
from simgate.llm.words import NOT_SPACE, Words

SHINGLE = 4
#: Permutations; each gives its minimum and its maximum, so a signature has twice as many values.
HASHES = 64
#: Signature values that make one band: 128 values in bands of 4 are 32 bands. Two sets of Jaccard
#: similarity 0.8 agree in none of them with probability (1 - 0.8**4)**32 = 5e-8.
ROWS = 4


def _multipliers() -> np.ndarray:
    """Odd multipliers from a fixed rule."""
    return mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles (repeats included), one text after another, and where each begins, with the end.

    A text of fewer than n words has one shingle, all its words; one without words has none.
    """
    keep = words.left >= n
    hashes, owner = words.grams(n)[keep], words.owner[keep]
    few = [k for k in np.flatnonzero((words.sizes > 0) & (words.sizes < n)).tolist()]
    if few:
        for size in sorted({int(words.sizes[k]) for k in few}):
            own = [k for k in few if words.sizes[k] == size]
            hashes = np.concatenate((hashes, words.grams(size)[words.first[own]]))
            owner = np.concatenate((owner, own))
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, np.searchsorted(owner, np.arange(len(words.sizes) + 1))


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, 2 * HASHES) minima and maxima under each permutation; texts without shingles get rows of no meaning."""
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(at) - 1, 2 * HASHES), np.uint64)
    if len(full):
        for i, a in enumerate(_multipliers()):
            permuted = hashes * a
            permuted ^= permuted >> np.uint64(32)
            out[full, 2 * i] = np.minimum.reduceat(permuted, at[full])
            out[full, 2 * i + 1] = np.maximum.reduceat(permuted, at[full])
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One key for each band; keys of different bands differ.

    A permutation's minimum and maximum go to different bands.
    """
    n = len(signature)
    values = np.concatenate((signature[:, ::2], signature[:, 1::2]), 1).reshape(n, -1, ROWS)
    key = np.broadcast_to(np.arange(1, values.shape[1] + 1, dtype=np.uint64), values.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
    return key.view(np.int64)


def sequence_keys(texts: list) -> np.ndarray:
    """Two longs of each text's word sequence, from one digest of 128 bits."""
    digests = (hashlib.blake2b(b" ".join((t or "").encode("utf-8", "replace").lower().split()), digest_size=16).digest() for t in texts)
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def described(texts: list, n: int = SHINGLE) -> dict:
    """Columns of the first pass: size of the set, the key of the word sequence, band keys."""
    hashes, at = shingles(Words(texts, NOT_SPACE), n)
    sizes = [len(np.unique(hashes[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    keys = sequence_keys(texts)
    return {"n_shingles": sizes, "key_a": keys[:, 0], "key_b": keys[:, 1], "bands": list(bands(signatures(hashes, at)))}


def sets(texts: list, n: int = SHINGLE) -> dict:
    """The column of the second pass: the shingle set in order."""
    hashes, at = shingles(Words(texts, NOT_SPACE), n)
    return {"shingles": [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]}
