"""Embedding caches: one Parquet table a variant, with its identity beside it.

A cache is ``<root>/<model slug>/<crop slug>/{embeddings,identity}``. Identity is stored in
columns and compared with what is asked for; it is never read from a path.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from simgate.functions.scalars import crop_slug, try_number
from simgate.operators import guards
from simgate.sources.shared import published

IDENTITY = "format_version int, model_id string, embedding_dim int, normalized boolean, detect boolean, margin double, min_confidence double, row_count long"
EMBEDDINGS = "row long, source_filename string, detect_used boolean, confidence double, x1 int, y1 int, x2 int, y2 int, area_fraction double, group string, embedding array<float>"
VERSION = 1


def variant_dir(root: str, model_id: str, detect: bool, margin: float | None) -> str:
    return f"{root.rstrip('/')}/{model_id.replace('/', '--')}/{crop_slug(detect, margin)}"


def write_cache(rows: DataFrame, folder: str, model_id: str, detect: bool, margin: float | None = None, min_confidence: float | None = None, normalized: bool = False) -> None:
    """Write rows and their identity, both or neither; detector settings are null where no detector ran.

    What the identity says of the rows is observed while they are written.
    """
    spark = rows.sparkSession

    def write(part: str) -> None:
        seen = Observation("cache")
        size = F.size("embedding")
        rows.observe(seen, F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high")).write.parquet(f"{part}/embeddings")
        got = seen.get
        guards.require(got["low"] == got["high"], f"embeddings of differing width: {got['low']} and {got['high']}")
        identity = Row(VERSION, model_id, got["high"], normalized, detect, margin if detect else None, min_confidence if detect else None, got["n"])
        spark.createDataFrame([identity], IDENTITY).coalesce(1).write.json(f"{part}/identity")

    published(spark, folder, write)


def read_identity(spark: SparkSession, folder: str) -> dict:
    found = spark.read.schema(IDENTITY).json(f"{folder}/identity").collect()
    guards.require(len(found) == 1, f"{folder} has {len(found)} identities")
    guards.equal_version(found[0]["format_version"], VERSION, "the cache")
    return found[0].asDict()


def read_cache(spark: SparkSession, folder: str, wanted: dict | None = None) -> tuple[DataFrame, dict]:
    """The rows and the identity of a cache, which must hold as many rows as it says and be what was asked for."""
    identity = read_identity(spark, folder)
    if wanted is not None:
        guards.same_variant(identity, wanted, "the cache and the request")
    rows = spark.read.parquet(f"{folder}/embeddings")
    n = rows.count()
    guards.require(n == identity["row_count"], f"{folder} has {n} rows, its identity says {identity['row_count']}")
    return rows, identity


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, embedding) of a two-dimensional NPY file, numbered from 0; the file is one value of at most 2 GB."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["content"]:
                values = np.load(io.BytesIO(raw), allow_pickle=False)
                if values.ndim != 2:
                    raise ValueError(f"an NPY file of vectors has two dimensions, not {values.ndim}")
                for a in range(0, len(values), 1000):
                    part = values[a : a + 1000].astype(np.float32)
                    yield pd.DataFrame({"row": np.arange(a, a + len(part)), "embedding": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, embedding array<float>")


def read_pair(spark: SparkSession, metadata_csv: str, vectors: DataFrame) -> DataFrame:
    """A metadata CSV with the vectors of the same row numbers; both must have the same rows."""
    meta = spark.read.csv(metadata_csv, header=True)
    numbers = {"row": "long", "x1": "int", "y1": "int", "x2": "int", "y2": "int"}
    meta = meta.withColumns({c: F.col(c).try_cast(t) for c, t in numbers.items()} | {c: try_number(F.col(c)) for c in ("confidence", "area_fraction")})
    meta = meta.withColumn("detect_used", F.lower("detect_used") == "true")
    a, b = meta.count(), vectors.count()
    both = meta.join(vectors, "row")
    guards.require(a == b == both.count(), f"{a} metadata rows and {b} vectors do not match row by row")
    return both
