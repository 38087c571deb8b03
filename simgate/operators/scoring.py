"""Cosine scores of queries against a reference set, as products of matrices in Arrow batches.

A reference set of up to ``BLOCK`` vectors (the usual case, checked by reading so many) is broadcast as one matrix, and
every query is scored where it lies, without a shuffle. A larger one is cut into blocks; queries are numbered, written,
and dealt out to every block, in parts of about ``PART`` queries: a task holds one block, streams its queries past
it (the sort puts a block before them), and gives a few numbers for each. They are merged by the number of the query's
row, so rows that share a key or a name stay apart in any number of blocks.

Defined results: a zero vector has similarity 0 with all; a null vector, or one of another width than the references,
has null scores and no match; a null inside a vector counts as NaN, and a NaN similarity ranks above all numbers and
never passes a threshold; the best match is the most similar reference, on ties the first by ``ord``, then the largest
by name, whatever the aggregation; an empty reference set, null vectors in it or vectors of differing width are errors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, LongType, StructField, StructType

from simgate.functions.vectors import DIGITS, EPSILON
from simgate.operators.guards import GuardError
from simgate.sources.shared import kept

#: Reference vectors in a block: with 768 dimensions 12 MB as doubles.
BLOCK = 2_000
#: Queries in one part of those that meet a block, and of them in one product.
PART, ROWS = 100_000, 1_024
TOP = 3
AGGREGATIONS = ("max", "mean-top3")


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have ``width`` numbers, and the places of these rows."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    return values / np.maximum(np.sqrt((values * values).sum(1)), EPSILON)[:, None], rows


@dataclass
class Block:
    """References in order of ``ord`` (of equal ones the largest name first): names, their ``ord`` and unit vectors."""

    names: pa.Array
    ords: np.ndarray
    units: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, width: int) -> Block:
        rows = rows.take(pc.sort_indices(rows, [("ord", "ascending"), ("name", "descending")])).combine_chunks()
        column = lambda name: pa.concat_arrays(rows.column(name).chunks) if rows.column(name).num_chunks else pa.array([], rows.schema.field(name).type)
        return cls(column("name"), column("ord").to_numpy(), matrix(column("vector"), width)[0])

    def similarities(self, queries: np.ndarray) -> np.ndarray:
        """Rounded, so that equal scores are equal on every engine."""
        return np.round(queries @ self.units.T, DIGITS)

    def best(self, vectors: pa.Array) -> list[pa.Array]:
        """For each vector its highest similarities, falling, and the first reference that has the highest: top, best_ord, best_match."""
        units, rows = matrix(vectors, self.units.shape[1])
        n, k = len(vectors), min(TOP, len(self.ords))
        top, first = np.zeros((len(rows), k)), np.zeros(len(rows), np.int64)
        for a in range(0, len(rows), ROWS):
            sims = self.similarities(units[a : a + ROWS])
            first[a : a + ROWS] = sims.argmax(1)
            top[a : a + ROWS] = np.sort(np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k :], axis=1)[:, ::-1]
        at = np.full(n, -1, np.int64)
        at[rows] = first
        known = at >= 0
        places = pa.array(at, mask=~known)
        sizes = np.concatenate(([0], np.cumsum(known * k)))
        offsets = pa.array(sizes.astype(np.int32), mask=np.append(~known, False))
        return [pa.ListArray.from_arrays(offsets, pa.array(top.ravel())), pa.array(self.ords).take(places), self.names.take(places)]


@dataclass
class References:
    """A reference set: one block in hand, or a table of ``blocks`` (block, ord, name, vector)."""

    width: int
    name_type: DataType
    block: Block | None = None
    table: DataFrame | None = None
    blocks: int = 1


def _vector(c: Column, df: DataFrame, name: str) -> Column:
    """The column, in the width of its numbers (floats stay floats) where it has some."""
    kind = df.schema[name].dataType
    return c if isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType)) else c.cast("array<double>")


def reference_set(vectors: DataFrame, name: str = "name", embedding: str = "embedding", ord_: str = "ord", block: int | None = None) -> References:
    most_rows = block or BLOCK
    rows = vectors.select(F.col(ord_).cast("long").alias("ord"), F.col(name).alias("name"), _vector(F.col(embedding), vectors, embedding).alias("vector"))
    first = rows.limit(most_rows + 1).toArrow()  # bounded
    size, name_type = F.size("vector"), rows.schema["name"].dataType
    if len(first) <= most_rows:
        sizes = pc.list_value_length(first.column("vector"))
        n, whole, least, most = len(first), len(first) - sizes.null_count, pc.min(sizes).as_py(), pc.max(sizes).as_py()
    else:
        rows = kept(rows, "references")
        n, whole, least, most = rows.agg(F.count(F.lit(1)), F.count("vector"), F.min(F.when(F.col("vector").isNotNull(), size)), F.max(size)).first()
    if not n or n != whole or least != most:
        raise GuardError(f"the reference set must be non-empty and row-aligned: {n} names, {whole} vectors, {least} to {most} wide")
    if n <= most_rows:
        return References(most, name_type, Block.of(first, most))
    blocks = -(-n // most_rows)
    return References(most, name_type, None, rows.withColumn("block", F.pmod(F.xxhash64("name", "ord"), F.lit(blocks)).cast("int")), blocks)


def _mean(values: Column) -> Column:
    return F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values), DIGITS)


Emit = Callable[[Block, pa.Array, pa.Array], pa.RecordBatch]


def _met(queries: DataFrame, n: int, references: References, emit: Emit, schema: StructType) -> DataFrame:
    """What ``emit`` makes of (id, vector) queries and each block: blocks and parts of the queries meet, a block ahead of its queries."""
    parts = max(1, -(-n // PART))
    id_type, vector = queries.schema["id"].dataType, "array<double>"
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(references.blocks - 1))).alias("block"), part("id").alias("part"), F.lit(True).alias("query"), "id",
        F.lit(None).cast("long").alias("ord"), F.lit(None).cast(references.name_type).alias("name"), F.col("vector").cast(vector).alias("vector"),
    )
    known = references.table.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("query"), F.lit(None).cast(id_type).alias("id"), "ord", "name", F.col("vector").cast(vector).alias("vector"),
    )
    tasks = max(references.blocks * parts, 1)
    dealt = known.unionByName(asked).repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "query")
    width = references.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                stretch, key = batch.slice(a, b - a), tuple(keys[:2, a])
                if key != at:
                    at, rows, block = key, [], None
                if not keys[2, a]:
                    rows.append(stretch)
                elif rows or block is not None:
                    if block is None:
                        block, rows = Block.of(pa.Table.from_batches(rows).select(["ord", "name", "vector"]), width), []
                    yield emit(block, stretch.column("id"), stretch.column("vector"))

    return dealt.mapInArrow(run, schema)


def _numbered(queries: DataFrame) -> tuple[DataFrame, int]:
    """The rows written once with a number each, ``query_row``, and how many they are."""
    rows = kept(queries.withColumn("query_row", F.monotonically_increasing_id()), "queries")
    return rows, rows.count()


def score(queries: DataFrame, references: References, embedding: str = "embedding") -> DataFrame:
    """The query rows without their vectors, with score_max, score_mean_top3, best_match and best_ord."""
    top = StructField("top", ArrayType(DoubleType()))
    best = [StructField("best_ord", LongType()), StructField("best_match", references.name_type)]
    if references.block is not None:
        rest = [c for c in queries.columns if c != embedding]
        shared = None if queries.isStreaming else queries.sparkSession.sparkContext.broadcast(references.block)
        block = references.block if shared is None else None
        schema = StructType([*(queries.schema[c] for c in rest), top, *best])
        names = schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = block or shared.value
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), *own.best(batch.column(len(rest)))], names=names)

        found = queries.select(*(F.col(f"`{c}`") for c in rest), _vector(F.col(embedding), queries, embedding).alias("vector")).mapInArrow(run, schema)
    else:
        rows, n = _numbered(queries)
        rest = [c for c in rows.columns if c not in (embedding, "query_row")]
        emit: Emit = lambda own, ids, vectors: pa.RecordBatch.from_arrays([ids, *own.best(vectors)], names=["query_row", "top", "best_ord", "best_match"])
        parts = _met(rows.select(F.col("query_row").alias("id"), F.col(embedding).alias("vector")), n, references, emit, StructType([StructField("query_row", LongType()), top, *best]))
        first = F.struct(F.element_at("top", 1).alias("sim"), (-F.col("best_ord")).alias("back"), F.col("best_match").alias("name"))
        merged = parts.groupBy("query_row").agg(F.max(F.when(F.col("top").isNotNull(), first)).alias("best"), F.flatten(F.collect_list("top")).alias("all"))
        merged = merged.select("query_row", F.when(F.col("best").isNotNull(), F.slice(F.sort_array("all", asc=False), 1, TOP)).alias("top"), (-F.col("best.back")).alias("best_ord"), F.col("best.name").alias("best_match"))
        found = rows.drop(embedding).join(merged, "query_row").select(*(F.col(f"`{c}`") for c in rest), "top", "best_ord", "best_match")
    scores = {"score_max": F.element_at("top", 1), "score_mean_top3": _mean(F.col("top"))}
    return found.select(*(F.col(f"`{c}`") for c in rest), *(c.alias(n) for n, c in scores.items()), "best_match", "best_ord")


def score_all(queries: DataFrame, vectors: DataFrame, **names) -> DataFrame:
    """Build the reference set from vectors and score all queries against it."""
    return score(queries, reference_set(vectors, **names))


def chosen(scored: DataFrame, aggregation: str) -> DataFrame:
    """Name the score of an aggregation ``score``."""
    if aggregation not in AGGREGATIONS:
        raise GuardError(f"aggregation must be one of {AGGREGATIONS}, not {aggregation!r}")
    return scored.withColumn("score", F.col("score_max" if aggregation == "max" else "score_mean_top3"))


def pairs(queries: DataFrame, vectors: DataFrame, key: str, name: str = "name", embedding: str = "embedding") -> DataFrame:
    """(key, reference, sim) for every pair of vectors of one width: the relational form, for inspection; as many rows as there are pairs."""
    references = reference_set(vectors.withColumn("at", F.lit(0)), name=name, embedding=embedding, ord_="at")
    schema = StructType([queries.schema[key], StructField("reference", references.name_type), StructField("sim", DoubleType())])

    def emit(block: Block, ids: pa.Array, vectors: pa.Array) -> pa.RecordBatch:
        units, rows = matrix(vectors, block.units.shape[1])
        sims = block.similarities(units).ravel()
        at = pa.array(np.repeat(rows, len(block.names)))
        return pa.RecordBatch.from_arrays([ids.take(at), block.names.take(pa.array(np.tile(np.arange(len(block.names)), len(rows)))), pa.array(sims)], names=schema.names)

    picked = queries.select(F.col(key).alias("id"), _vector(F.col(embedding), queries, embedding).alias("vector"))
    if references.block is None:
        picked = kept(picked, "queries")
        return _met(picked, picked.count(), references, emit, schema)
    shared = picked.sparkSession.sparkContext.broadcast(references.block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                yield emit(shared.value, part.column(0), part.column(1))

    return picked.mapInArrow(run, schema)
