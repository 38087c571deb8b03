"""Phrases whose words stand together more often than their parts explain, language by language.

Every contiguous phrase of 1 to ``max_n`` words of every text becomes a row and is counted by hash aggregation
per language; phrases of two words and more with ``min_count`` occurrences are joined with the counts of their
first and remaining words at each cut, scored in exact decimals by the cut that explains them best, dropped (anti
join) where a phrase with one word more at either end has at least ``share`` hundredths of their occurrences, and
ranked in a window. A longer phrase that covers a candidate covers it through phrases of one word more, which stand
at least as often, so one-word extensions decide for all.

Most long phrases stand once, so what crosses the network is made small first: a task counts the phrases of a few
hundred thousand words at a time and sends them as sorted blocks, one for each bucket of a hash of the phrase. The
blocks are exploded into rows where the bucket is, and aggregated there without a further exchange. A very frequent
phrase is one entry for each such step; only phrases that pass ``min_count`` are kept, with one row for each
language that holds its number of words.

Defined results: a null or empty text has no words; a null language is ``und``; bytes beyond ASCII, punctuation
other than ``.,;:!?`` and control characters but tab and line ends are parts of words; equal scores rank by count,
then by phrase in byte order; repeated rows count each; texts of any length are counted whole, in steps; empty
tables give no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simgate.llm.pretokens import gather, span_hashes
from simgate.llm.shared import discard, written
from simgate.llm.tables import byte_slices, documents
from simgate.llm.words import LOWER

MAX_N, MIN_COUNT, SHARE, TOP = 3, 10, 50, 2_000
#: Bytes of text that a task reads at a time, and words whose phrases it counts in one step.
SLICE, STEP = 3_000_000, 200_000
#: Phrases that are hashed or copied at a time.
AT_ONCE = 100_000
#: Parts of a language that are ranked by themselves before what is left of them meets.
SALTS = 64
WORD, BLANK, END = 0, 1, 2


def _kinds() -> np.ndarray:
    table = np.full(256, WORD, np.uint8)
    table[[0x20, 0x09]] = BLANK
    table[list(b".,;:!?")] = table[0x0A:0x0E] = END
    return table


KINDS = _kinds()


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[s:s+n] of every pair, one after another; a part at a time, as places take eight times the room of bytes."""
    upto = np.cumsum(sizes)
    out = np.empty(int(upto[-1]) if len(upto) else 0, values.dtype)
    for k in range(0, len(starts), AT_ONCE):
        part = slice(k, k + AT_ONCE)
        out[upto[k] - sizes[k] : upto[part][-1]] = gather(values, starts[part], sizes[part])
    return out


class Pieces:
    """The words of texts, lower-cased (A-Z only), one space behind each, and the number of the piece that each is in."""

    def __init__(self, texts: list):
        raw = b"\n".join((t or "").encode("utf-8", "replace") for t in texts) + b"\n"
        data = LOWER[np.frombuffer(raw, np.uint8)]
        kind = KINDS[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[1:] = kind == WORD
        flips = np.flatnonzero(inside[1:] != inside[:-1])  # the last byte ends a piece, so they come in pairs
        starts, stops = flips[::2], flips[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == END), starts)
        self.sizes = stops - starts + 1
        self.data = gathered(data, starts, self.sizes)
        self.stops = np.cumsum(self.sizes)
        self.data[self.stops - 1] = 32

    def __len__(self) -> int:
        return len(self.sizes)

    def phrases(self, start: int, stop: int, n: int) -> pa.Array:
        """The phrases of n words whose first is one of start to stop."""
        first = np.arange(start, min(stop, len(self) - n + 1))
        first = first[self.piece[first] == self.piece[first + n - 1]]
        begins = self.stops[first] - self.sizes[first]
        sizes = self.stops[first + n - 1] - 1 - begins
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(gathered(self.data, begins, sizes)))


def blocks(pieces: Pieces, start: int, stop: int, max_n: int, buckets: int) -> pa.RecordBatch:
    """bucket, phrases (a line end behind each) and counts of the phrases that begin at the words start to stop; the empty phrase counts these words."""
    counted = [pieces.phrases(start, stop, n).value_counts() for n in range(1, max_n + 1)]
    values = pa.concat_arrays([*(c.field(0) for c in counted), pa.array([""], pa.large_string())])
    counts = np.concatenate([*(c.field(1).to_numpy() for c in counted), [stop - start]])
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.concatenate((np.frombuffer(data, np.uint8)[: offsets[-1]], np.zeros(8, np.uint8)))
    bucket = np.empty(len(values), np.uint64)
    for k in range(0, len(values), AT_ONCE):
        own = offsets[k : k + AT_ONCE + 1]
        bucket[k : k + AT_ONCE] = span_hashes(data[own[0] : own[-1]], own[:-1] - own[0], own[1:] - own[0]) % np.uint64(buckets)
    eights = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    second = eights[np.minimum(offsets[:-1] + 8, len(eights) - 1)]
    order = np.lexsort((second, eights[offsets[:-1]], bucket))  # almost sorted by phrase, which packs well
    sizes = np.diff(offsets)[order] + 1
    lines = gathered(data, offsets[:-1][order], sizes)
    upto = np.cumsum(sizes)
    lines[upto - 1] = 10
    bucket, counts = bucket[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.append(first, len(bucket))
    at = np.concatenate(([0], upto))[ends]
    phrases = pa.StringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(lines))
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), phrases, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int32()))], names=["bucket", "phrases", "counts"])


def phrase_counts(df: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang", buckets: int | None = None) -> DataFrame:
    """lang, phrase and f of the phrases of 1 to max_n words with min_count occurrences; the empty phrase has each language's number of words."""
    parts = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(1), SLICE):
                langs, texts = (batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1))
                for lang in sorted(set(langs)):
                    pieces = Pieces([t for t, own in zip(texts, langs, strict=True) if own == lang])
                    for start in range(0, len(pieces), STEP):
                        made = blocks(pieces, start, min(start + STEP, len(pieces)), max_n, parts)
                        yield made.add_column(1, "lang", pa.array([lang] * len(made), pa.string()))

    picked = df.select(F.coalesce(df[lang_col].cast("string"), F.lit("und")).alias("lang"), df[text_col].cast("string").alias("text"))
    dealt = picked.mapInArrow(run, "bucket int, lang string, phrases string, counts array<int>").repartitionById(parts, F.col("bucket"))
    rows = dealt.select("bucket", "lang", F.split("phrases", "\n").alias("phrase"), F.col("counts").alias("n")).select("bucket", "lang", F.expr("inline(arrays_zip(phrase, n))"))
    summed = rows.where("n IS NOT NULL").groupBy("bucket", "lang", "phrase").agg(F.sum("n").alias("f"))
    return summed.where((F.col("f") >= min_count) | (F.col("phrase") == "")).select("lang", "phrase", "f")


def _exact(c: Column) -> Column:
    """A count as a decimal: products of two counts and a million fit in 38 digits."""
    return c.cast("decimal(15,0)")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of the counted phrases of two words and more, by their lowest-scoring cut."""
    parts = counts.where("phrase <> ''")
    phrases = parts.select("lang", "phrase", F.col("f").alias("a"), F.size(F.split("phrase", " ")).alias("words")).where("words >= 2")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    a, both = _exact(F.col("a")), _exact(F.col("l")) * _exact(F.col("r"))
    cuts = cuts.withColumn("over", F.lit(1_000_000).cast("decimal(7,0)") * (a * a)).withColumn("under", both).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """The candidates that no phrase of one word more covers in ``share`` hundredths of their occurrences."""
    longer = candidates.where("words >= 3")
    inner = [F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")]
    covering = longer.select("lang", F.explode(F.array(*inner)).alias("part"), F.col("a").alias("more")).groupBy("lang", "part").agg(F.max("more").alias("more"))
    covering = covering.select(F.col("lang").alias("in_lang"), "part", "more")
    covered = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("part")) & (100 * F.col("more") >= share * F.col("a"))
    return candidates.join(covering, covered, "left_anti")


def ranked(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language, in two steps so that no language meets in one task whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(df: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    counts = written(phrase_counts(df, max_n, min_count, text_col, lang_col), "phrases")
    candidates = written(scored(counts), "candidates")
    totals = written(counts.where("phrase = ''").select("lang", F.col("f").alias("n")), "totals")
    discard(counts)
    return ranked(uncovered(candidates, share), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), rows AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM pieces
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM pieces
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM pieces
), counts AS (SELECT lang, words, phrase, count(*) AS f FROM rows GROUP BY lang, words, phrase HAVING count(*) >= 10
), cuts AS (
  SELECT lang, words, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, words)) AS k FROM counts WHERE words >= 2)
), valued AS (
  SELECT c.lang, c.words, c.phrase, c.a, c.k, h.f AS l, t.f AS r, (1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f) AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail
), best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), left_over AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM counts c WHERE c.words = b.words + 1 AND c.lang = b.lang AND 100 * c.f >= 50 * b.a AND array_to_string(string_split(c.phrase, ' ')[:c.words - 1], ' ') = b.phrase
  ) AND NOT EXISTS (
    SELECT 1 FROM counts c WHERE c.words = b.words + 1 AND c.lang = b.lang AND 100 * c.f >= 50 * b.a AND array_to_string(string_split(c.phrase, ' ')[2:], ' ') = b.phrase
  )
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM left_over JOIN totals USING (lang) QUALIFY rank <= 2000
"""
