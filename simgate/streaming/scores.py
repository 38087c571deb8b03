"""Scores of a stream of embeddings against a fixed reference set, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgate.functions.scalars import passes
from simgate.operators import scoring


def score_stream(stream: DataFrame, reference_vectors: DataFrame, threshold: float, aggregation: str = "max") -> DataFrame:
    """Each row of a stream (with ``embedding``) with its score, best match and verdict, as it arrives.

    The reference set must fit one block, so no query is merged across rows and no state is kept; ``score_batches`` takes any.
    """
    references = scoring.reference_set(reference_vectors)
    if references.block is None:
        raise scoring.GuardError(f"a stream is scored in place against at most {scoring.BLOCK} references; score its batches")
    rows = scoring.chosen(scoring.score(stream, references), aggregation)
    return rows.withColumn("hit", passes(F.col("score"), threshold))


def score_batches(stream: DataFrame, reference_vectors: DataFrame, threshold: float, sink: Callable[[DataFrame, int], None], aggregation: str = "max"):
    """A writer that scores each micro-batch against a reference set of any size and gives it, with its number, to ``sink``."""
    references = scoring.reference_set(reference_vectors)

    def one(batch: DataFrame, number: int) -> None:
        rows = scoring.chosen(scoring.score(batch, references), aggregation)
        sink(rows.withColumn("hit", passes(F.col("score"), threshold)), number)

    return stream.writeStream.foreachBatch(one)
