"""Input tables and the Arrow batch loop that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one call of a batch function gets (one row may be longer).
CHUNK_BYTES = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def byte_slices(texts: pa.Array, limit: int = CHUNK_BYTES, each: int = 0) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive rows that hold about ``limit`` bytes (with ``each`` more a row), so that only so much becomes Python strings; a longer row stands alone."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + each)
    start = 0
    while start < len(texts):
        before = int(upto[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + limit, "right")))
        yield start, stop
        start = stop


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list], dict]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Apply a function of a list of texts (str or None) to every row, in bounded slices.

    ``make`` runs once in each task and returns the function; that returns the output columns
    after the id, a value for each text. Other columns of ``df`` are dropped before Python.
    """
    out_type = pa.schema([("id", pa.int64()), *((f.split()[0], ARROW[f.split()[1]]) for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in byte_slices(texts):
                cols = fn(texts.slice(a, b - a).to_pylist())
                arrays = [ids.slice(a, b - a)] + [pa.array(cols[f.name], f.type) for f in list(out_type)[1:]]
                yield pa.RecordBatch.from_arrays(arrays, schema=out_type)

    picked = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, " + schema).withColumnRenamed("id", id_col)


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()), "array<binary>": pa.list_(pa.binary()),
}


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list], list]], text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, for which a function of a list of texts says true."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = batch.column(at)
            keep = [bool(x) for a, b in byte_slices(texts) for x in fn(texts.slice(a, b - a).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
