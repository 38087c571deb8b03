"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the 300 most frequent n-grams of one to three letters, words padded with a space, in
order of frequency. A text's own profile is compared with that of each language by the sum of the
differences in rank, a missing n-gram counting 300. Profiles are learned from at most
``SAMPLE_ROWS`` texts a language (about; by a hash of the id), all of whose n-grams count.

Defined results: a null text, or one without a letter, is ``und`` with score 0; of languages at
equal distance the first in order of name is taken; without any learned language all is ``und``;
repeated rows give repeated rows; a null id stays null, is not held out and not learned from;
texts of any length are read whole; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simgate.llm.pretokens import LETTER, classes, joined, mix
from simgate.llm.tables import byte_slices, documents, map_texts

PROFILE = 300
#: Rows a language from which profiles are learned, in expectation; the bound of the fit.
SAMPLE_ROWS = 2_000
LOW = np.int64((1 << 23) - 1)


def ngrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, n-gram (40-bit hash) and count, ordered by text and n-gram."""
    _, points, bounds = joined(["\n" + t.lower() + "\n" if t else "\n" for t in texts])
    letters = classes()[points] == LETTER
    keep = letters | np.concatenate(([False], letters[:-1])) | np.concatenate((letters[1:], [False]))
    chars = np.where(letters, points, 32).astype(np.uint64)[keep]
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[keep]
    # two neighbours that aren't letters are the end of one word and the start of the next
    c0, c1, c2 = chars, chars[1:], chars[2:]
    shift = np.uint64(21)
    pair, triple = c0[:-1] << shift | c1, (c0[:-2] << shift | c1[:-1]) << shift | c2
    space = np.uint64(32)
    one = c0 != space
    two = (owner[1:] == owner[:-1]) & (one[1:] | one[:-1])
    three = (owner[2:] == owner[:-2]) & one[1:-1]
    grams = np.concatenate((c0[one], pair[two], triple[three]))
    owners = np.concatenate((owner[one], owner[:-1][two], owner[:-2][three])).astype(np.int64)
    keys = np.sort(owners << 40 | (mix(grams) >> np.uint64(24)).astype(np.int64))
    if not len(keys):
        return keys, keys, keys
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    return keys[first] >> 40, keys[first] & ((1 << 40) - 1), counts


def ranked(owner: np.ndarray, grams: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent n-grams of each text with their ranks; equal counts in order of hash."""
    order = np.lexsort((grams & LOW, -counts, owner))
    owner, grams = owner[order], grams[order]
    begins = np.searchsorted(owner, owner)
    rank = np.arange(len(owner)) - begins
    top = rank < most
    return owner[top], grams[top], rank[top]


class Profiles:
    """Ranks of the n-grams of all languages."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.names = sorted({r[0] for r in rows})
        self.size = size
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.names), len(self.grams)), -1, np.int64)
        for name, gram, rank in rows:
            self.ranks[self.names.index(name), np.searchsorted(self.grams, gram)] = rank

    def judge(self, texts: list) -> dict:
        owner, grams, rank = ranked(*ngrams(texts), self.size)
        n = len(texts)
        if not self.names:
            return {"lang_pred": ["und"] * n, "score": np.zeros(n)}
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        known = self.grams[at] == grams
        sizes = np.bincount(owner, minlength=n)
        far = np.empty((len(self.names), n))
        for k in range(len(self.names)):
            own = self.ranks[k, at]
            away = np.where(known & (own >= 0), np.abs(own - rank), self.size)
            far[k] = np.bincount(owner, away, n)
        far /= np.maximum(sizes * self.size, 1)
        best = far.argmin(0)
        return {"lang_pred": [self.names[b] if s else "und" for b, s in zip(best.tolist(), sizes.tolist(), strict=True)], "score": np.where(sizes > 0, 1 - far.min(0), 0.0)}

    def keeps(self, texts: list) -> list[bool]:
        """Whether a text shares an n-gram with a learned language; where none was learned, whether it has a letter."""
        if not self.names:
            return (np.bincount(ngrams(texts)[0], minlength=len(texts)) > 0).tolist()
        return (self.judge(texts)["score"] > 0).tolist()


def held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(df: DataFrame, size: int = PROFILE, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from the rows of df that have a language."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND id IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, sample_rows / n) * (1 << 20))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).select("lang", "text")
    out = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                langs, texts = (batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1))
                for lang in sorted(set(langs)):
                    _, grams, counts = ngrams(["\n".join(t for t, own in zip(texts, langs, strict=True) if own == lang and t)])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], schema=out)

    summed = picked.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram").bitwiseAND(int(LOW)), "gram")
    top = summed.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    return Profiles([(r["lang"], r["gram"], r["rank"]) for r in top.collect()], size)  # size rows a language


def predict(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score of every text."""
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    return map_texts(df, lambda: shared.value.judge, "lang_pred string, score double", id_col, text_col)


def op5_language_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, fit(docs.where(~held_out("doc_id", 5, 0))))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
