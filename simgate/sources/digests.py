"""A fingerprint of a table of vectors, as a tree of digests worked out by Spark: nothing is collected but its root.

A leaf is the digest of a row: its ``ord``, its name and the bytes of its vector as 32-bit floats. Rows whose ``ord``
falls into one range of ``FAN`` numbers, counted from the least, are one node, the digest of the leaves in order; so are nodes, level by level,
until one is left. The tree depends on the rows alone, not on how they are dealt out, and a group has ``FAN`` rows at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgate.operators import guards

FAN = 4_096


def leaves(rows: DataFrame) -> DataFrame:
    """(ord, digest) of rows (ord, name, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for at, name, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                known = b"\1" if vector.is_valid else b"\0"
                numbers = np.asarray(vector.values, "<f4").tobytes() if vector.is_valid else b""
                title = (name or "").encode("utf-8", "replace")
                made.append(hashlib.sha256(b"%d:%d:" % (at, len(title)) + title + known + numbers).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["ord", "digest"])

    picked = rows.select(F.col("ord").cast("long").alias("ord"), F.col("name").cast("string").alias("name"), F.col("embedding").cast("array<float>").alias("embedding"))
    return picked.mapInArrow(run, "ord long, digest string")


def fingerprint(rows: DataFrame) -> str:
    """The root of the tree over rows (ord, name, embedding), whose ``ord`` tells them apart; of no rows, the digest of nothing."""
    level = leaves(rows)
    span = level.agg(F.min("ord"), F.max("ord"), F.count(F.lit(1)), F.countDistinct("ord")).first()
    guards.require(span[2] == span[3], "ord must tell the rows of a fingerprint apart")
    if not span[2]:
        return hashlib.sha256(b"").hexdigest()
    guards.require(span[1] - span[0] < 1 << 62, "ord spans too many numbers")
    level = level.withColumn("ord", F.col("ord") - F.lit(span[0]))
    last = span[1] - span[0]
    while True:
        node, last = F.expr(f"ord div {FAN}"), last // FAN
        held = F.array_sort(F.collect_list(F.struct("ord", "digest")))  # FAN of them at most
        text = F.array_join(F.transform(held, lambda x: F.concat_ws("=", x["ord"].cast("string"), x["digest"])), ",")
        level = level.groupBy(node.alias("node")).agg(F.sha2(text.cast("binary"), 256).alias("digest")).select(F.col("node").alias("ord"), "digest")
        if last == 0:
            return level.first()["digest"]
