"""Token counts with a whole-token shortcut.

``whole_tokens`` proves, once and on the driver, which strings of the vocabulary come out as one
token when encoded alone; the vocabulary bounds its size. Pre-tokens among them count one without
any merging, and only the other distinct pre-tokens are merged.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside a text count
one each, as the library does by default; a null id stays null; repeated rows give repeated rows;
texts of any length are counted whole; extra columns are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from simgate.llm.bpe import merge_one
from simgate.llm.pretokens import MARK, Memo, Strings, cut, grouped, joined, span_keys
from simgate.llm.tables import documents, map_texts

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CONTEXT = 1024


def byte_alphabet() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The merges of a tokenizer file, over bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank, self.made = {}, {}
        for n, (a, b) in enumerate(spec["model"]["merges"]):
            a, b = raw(a), raw(b)
            pair = self.vocab[a], self.vocab[b]
            self.rank[pair], self.made[pair] = n, self.vocab[a + b]
        self.byte_ids = [self.vocab[bytes([i])] for i in range(256)]

    def encode(self, piece: bytes) -> list[int]:
        return merge_one([self.byte_ids[b] for b in piece], lambda a, b: self.rank.get((a, b)), lambda a, b: self.made[a, b])


def whole_tokens(merges: Merges) -> list[str]:
    """Strings of the vocabulary that are one pre-token and merge into one token."""
    texts, raws = [], []
    for raw, i in merges.vocab.items():
        try:
            texts.append(raw.decode("utf-8"))
            raws.append((raw, i))
        except UnicodeDecodeError:
            pass  # part of a character: never a pre-token
    _, points, bounds = joined(texts)
    starts, _ = cut(points, bounds, spaced=True)
    alone = np.diff(np.searchsorted(starts, bounds)) == 1
    proven = [t for t, (raw, i), one in zip(texts, raws, alone, strict=True) if one and merges.encode(raw) == [i]]
    return proven


def count_tokens(df: DataFrame, path: str = TOKENIZER, limit: int = CONTEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text."""
    proven = whole_tokens(Merges(path))
    _, points, bounds = joined(proven)
    whole = Strings()
    whole.add(span_keys(points, bounds[:-1], bounds[1:]), points, bounds[:-1], np.diff(bounds))
    shared = df.sparkSession.sparkContext.broadcast(whole)  # as large as the vocabulary

    def make() -> Callable[[list], dict]:
        merges, single = Merges(path), shared.value
        memo = Memo(lambda pieces: [[0] if p == MARK else merges.encode(p.encode("utf-8", "replace")) for p in pieces])

        def fn(texts: list) -> dict:
            plain = texts
            for s in merges.special:
                texts = [t.replace(s, MARK) if t and s in t else t for t in texts]
            text, points, bounds = joined(texts)
            starts, ends = cut(points, bounds, spaced=True)
            counts = np.ones(len(starts), np.int64)
            if len(starts):
                codes, keys, first = grouped(points, starts, ends)
                known = single.find(keys, points, starts[first], ends[first] - starts[first]) >= 0
                rest = np.flatnonzero(~known[codes])
                if len(rest):
                    counts[rest] = memo.look_up(text, points, starts[rest], ends[rest])[1]
            upto = np.concatenate(([0], np.cumsum(counts)))
            n = np.diff(upto[np.searchsorted(starts, bounds)])
            return {"n_bytes": [len(t.encode()) if t else 0 for t in plain], "n_tokens": n, "over_limit": n > limit}

        return fn

    return map_texts(df, make, "n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
