"""Media columns: texts as FLAC audio, and PCM blocks with seekable sample offsets.

``encode(df)`` makes a binary column of FLAC streams from any bytes; ``decode(df)`` gives the PCM
blocks of a media column (FLAC of any form), a row for some blocks with the number of the first
sample, and seeks to a range of samples; ``features(df)`` reads stored streams of one 8-bit channel
back, verifies their checksums and describes the samples.

Defined results: null or empty bytes are one block of padding; padding (byte 255) fills the last
block of 576; a damaged stream fails the job with ``FlacError``; null ids stay null; repeated
rows give repeated rows; texts of any length are stored whole; other columns are dropped; null media
have no blocks and null features.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.llm import flac, flac_frames
from simgate.llm.shared import written
from simgate.llm.tables import byte_slices, documents

PAD, TAIL = b"\xff", 32
#: Bytes that are encoded or decoded together; one longer payload stands alone.
TOGETHER = 1 << 20
#: How media columns are written: equal streams of a row group once (a dictionary of up to 64 MB), pages of 8 MB, since frames repeat far apart.
STORED = {"parquet.dictionary.page.size": str(64 << 20), "parquet.page.size": str(8 << 20), "parquet.compression.codec.zstd.level": "9"}


def padded(raw: bytes | None) -> bytes:
    raw = raw or b""
    return raw + PAD * (-len(raw) % flac.BLOCK or (0 if raw else flac.BLOCK))


def encode(df: DataFrame, id_col: str = "doc_id", bytes_col: str = "text") -> DataFrame:
    """id, n_bytes (without padding) and media: a FLAC stream of every row's bytes (a text's are UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(1), TOGETHER, flac.BLOCK):
                raw = batch.column(1).slice(a, b - a).to_pylist()
                media = flac.encode([padded(r) for r in raw])
                sizes = pa.array([len(r or b"") for r in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sizes, pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(bytes_col).cast("binary").alias("raw"))
    return picked.mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", blocks: int = 64, first: int = 0, last: int | None = None) -> DataFrame:
    """id, first_sample, n_samples, channels, bits and pcm: rows of up to ``blocks`` FLAC blocks each.

    Samples are interleaved, of up to 8 bits unsigned and of more signed little-endian. With ``first`` or ``last``, only
    the rows that hold samples of [first, last) are made: the seek points lead to their frames, and no others are read
    (checksums of frames are verified always, the digest of all samples only without a range).
    """

    def cut(media: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
        info = flac.Stream(media)
        if info.offsets is not None:
            try:
                if first <= 0 and last is None:
                    a, stored = 0, flac.decode([media])[0]
                else:
                    step, count = blocks * flac.BLOCK, len(info.offsets)
                    a, b = max(first, 0) // step * blocks, count if last is None else min(count, -(-last // step) * blocks)
                    stored = flac.blocks(media, info, a, b) if a < b else ()
                for k in range(0, len(stored), blocks):
                    piece = stored[k : k + blocks]
                    yield (a + k) * flac.BLOCK, piece.size, 1, 8, piece.tobytes()
                return
            except flac.OtherForm:  # raised before the first row
                pass
        found = flac_frames.whole(media, info) if first <= 0 and last is None else flac_frames.frames(media, info, first, last)
        for f in found:
            yield f.first, len(f.samples), info.channels, f.bits, flac_frames.pcm(f.samples, f.bits)

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                media = batch.column(1)[i].as_py()
                rows = [] if media is None else list(cut(media))
                if rows:
                    arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.int64()), *arrays], names=["id", "first_sample", "n_samples", "channels", "bits", "pcm"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return picked.mapInArrow(run, "id long, first_sample long, n_samples long, channels int, bits int, pcm binary").withColumnRenamed("id", id_col)


def _samples(media: list[bytes]) -> list[np.ndarray]:
    """Stored bytes of streams of one 8-bit channel, whoever encoded them; all at once where the fast path reads them."""
    try:
        return flac.decode(media)
    except flac.OtherForm:
        if len(media) > 1:
            return [x for m in media for x in _samples([m])]
    info = flac.Stream(media[0])
    if (info.channels, info.bits) != (1, 8):
        raise flac.FlacError("features are of one channel of 8 bits")
    return [np.frombuffer(b"".join(flac_frames.pcm(f.samples, 8) for f in flac_frames.whole(media[0], info)), np.uint8)]


def describe(pcm: np.ndarray) -> str:
    """Whole numbers of the samples: mean, mean square, crossings of the middle, least and most."""
    x = pcm.ravel().astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"mean={int(x.sum()) // len(x)};power={int((x * x).sum()) // len(x)};crossings={crossings};min={int(x.min())};max={int(x.max())}"


def features(df: DataFrame, id_col: str = "doc_id", size_col: str = "n_bytes", media_col: str = "media") -> DataFrame:
    """Digests and features of the samples that the stored streams hold."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(2), TOGETHER):
                media = batch.column(2).slice(a, b - a).to_pylist()
                samples = iter(_samples([m for m in media if m is not None]))
                rows = []
                for stored in media:
                    if stored is None:
                        rows.append((None,) * 6)
                        continue
                    pcm = next(samples)
                    payload = pcm.tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(pcm)))
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types[2:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(size_col).alias("n_bytes"), F.col(media_col).alias("media"))
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(written(encode(documents(spark, sf_dir)), "media", STORED))
