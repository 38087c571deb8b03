"""Byte-level BPE encoding and decoding of whole texts.

``encode(df)`` gives each text's token ids; ``decode(df)`` gives the bytes of an ids column back;
``encoded(df)`` does both in one pass and adds counts and digests.

Defined results: a null or empty text has no ids (digests are those of the empty string); a null
id stays null; repeated rows give repeated rows; texts of any length are encoded whole, pre-tokens
over 1,024 bytes by a heap instead of a matrix row; extra columns are dropped, or kept where said.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.llm.bpe import Decoder, Merger, read_ranks
from simgate.llm.pretokens import Memo, cut, joined
from simgate.llm.tables import documents, map_texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Codec:
    def __init__(self, path: str):
        ranks = read_ranks(path)
        merger = Merger(ranks)
        self.memo = Memo(lambda pieces: merger.encode([p.encode("utf-8", "replace") for p in pieces]))
        self.decoder = Decoder(ranks)

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin, with the end."""
        text, points, bounds = joined(texts)
        starts, ends = cut(points, bounds, spaced=True)
        place, counts = self.memo.look_up(text, points, starts, ends)
        upto = np.concatenate(([0], np.cumsum(counts)))
        return self.memo.ids_of(place), upto[np.searchsorted(starts, bounds)]


def encode(df: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make() -> Callable[[list], dict]:
        codec = Codec(path)

        def fn(texts: list) -> dict:
            ids, at = codec.encode(texts)
            return {"ids": [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]}

        return fn

    return map_texts(df, make, "ids array<int>", id_col, text_col)


@lru_cache(4)
def _decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def decode(df: DataFrame, path: str = RANKS, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes of an ids column; null ids give null. Unknown ids are an error."""

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        decoder = _decoder(path)
        return ids.map(lambda x: None if x is None else decoder.decode(list(x)))

    return df.withColumn(out_col, run(F.col(ids_col)))


def encoded(df: DataFrame, path: str = RANKS, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids (where wanted), their number, and digests of the ids (decimal, with commas) and of the bytes they decode to."""

    def make() -> Callable[[list], dict]:
        codec = Codec(path)
        names = [str(i) for i in range(len(codec.decoder.tokens))]

        def fn(texts: list) -> dict:
            ids, at = codec.encode(texts)
            ids, at = ids.tolist(), at.tolist()
            own = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            return {
                "ids": own if with_ids else None, "n_tokens": [len(x) for x in own],
                "ids_sha256": [hashlib.sha256(",".join(map(names.__getitem__, x)).encode()).hexdigest() for x in own],
                "decoded_sha256": [hashlib.sha256(codec.decoder.decode(x)).hexdigest() for x in own],
            }

        return fn

    return map_texts(df, make, "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), with_ids=False)
