"""Token ids in Parquet files that can be read selectively.

``write_ids`` encodes texts with the tokenizers library (each distinct pre-token once), appends an
end id, and writes one row for each document in ascending id order: ``doc_id``, ``part`` (the file's
range), ``local_start`` (ids before it in its range), ``n_tokens`` and the list ``ids``. The list
is dictionary encoded, or delta encoded where asked; row groups and pages have set sizes; the
writer adds page indexes, so a reader of a few documents or of the lengths alone skips the rest.
``starts`` adds each document's place in the whole run of ids: only the sums of the ranges meet in
one place, a row for each file.

Defined results: a null or empty text has the end id alone; rows with a null id come first, in text
order (a null text before all), over all files, as do repeated ids among themselves; long texts are encoded whole; extra columns are
dropped; an empty table gives files without rows.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simgate.llm.pretokens import Memo, cut, joined
from simgate.llm.shared import shared_folder
from simgate.llm.tables import byte_slices, documents

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
#: Characters by which texts of one id are dealt to ranges.
RANGED = 64


def normalized(text: str) -> str:
    """What the tokenizer file's normalizer does, but for white space, which its pre-tokenizer drops."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Encoder:
    """Ids by the library, of distinct pre-tokens; special strings in a text are its default: one id each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.special_ids = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

        #: A pre-token's last id ends a word, and no other does; so many words go through one call.
        final = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            final[i] = token.endswith("</w>")

        def encode(pieces: list[str]) -> list[list[int]]:
            pieces = [p.encode("utf-8", "replace").decode() for p in pieces]
            out: list[list[int]] = []
            for k in range(0, len(pieces), 4096):
                own = pieces[k : k + 4096]
                ids = tokenizer.encode(" ".join(own), add_special_tokens=False).ids
                ends = (np.flatnonzero(final[ids]) + 1).tolist()
                if len(ends) == len(own):
                    out += [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                else:
                    out += [e.ids for e in tokenizer.encode_batch(own, add_special_tokens=False)]
            return out

        self.memo = Memo(encode)

    def encode(self, texts: list, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end ids, and where each text's begin, with the end."""
        parts, owner, extra = [], [], []
        for n, t in enumerate(texts):
            for s, i in self._pieces(t or ""):
                owner.append(n)
                parts.append(normalized(s))
                extra.append(i)
            extra[-1] = end
        text, points, bounds = joined(parts)
        starts, ends = cut(points, bounds, spaced=False)
        place, counts = self.memo.look_up(text, points, starts, ends)
        upto = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, bounds)]
        ids = np.insert(self.memo.ids_of(place), upto[1:], np.array(extra, np.int32))
        sizes = np.bincount(np.array(owner), np.diff(upto) + 1, len(texts)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(sizes)))

    def _pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """The text between special strings, each with the id of the special string after it."""
        while True:
            at, s = min(((k, s) for s in self.special_ids if (k := text.find(s)) >= 0), default=(-1, ""))
            if at < 0:
                yield text, -1
                return
            yield text[:at], self.special_ids[s]
            text = text[at + len(s) :]


def write_ids(
    df: DataFrame,
    folder: str,
    path: str = TOKENIZER,
    end: int = END_ID,
    delta: bool = False,
    ranges: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = ranges or picked.rdd.getNumPartitions()  # as many as the input's own, so it follows its size
    # texts are ranged by their beginning, so that what is sampled of them stays small; equal beginnings share a range
    dealt = picked.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, RANGED).asc_nulls_first())
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    out = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = Encoder(path), 0
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                ids, at = encoder.encode(batch.column(1).slice(a, b - a).to_pylist(), end)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(before + at[:-1]), pa.array(np.diff(at)), lists]
                yield pa.RecordBatch.from_arrays(columns, schema=out)
                before += int(at[-1])

    rows = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids array<int>")
    writer = rows.write.option("compression", "zstd")
    for key, value in {
        "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": str(not delta).lower(), "parquet.writer.version": "PARQUET_2_0" if delta else "PARQUET_1_0",
    }.items():
        writer = writer.option(key, str(value))
    writer.parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    rows = read_ids(spark, folder)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each file
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    digests = rows.select("doc_id", "part", "local_start", "n_tokens", "ids").mapInArrow(_crc32, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    joined = digests.join(F.broadcast(before), "part")
    return joined.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def _crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        raw, at = lists.values.to_numpy().astype("<i4", copy=False).view(np.uint8).data, (lists.offsets.to_numpy() * 4).tolist()
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(crc, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token_files/{uuid.uuid4().hex}"
    write_ids(documents(spark, sf_dir), folder)
    return starts(spark, folder)

