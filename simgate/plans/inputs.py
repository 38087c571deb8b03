"""The domain's relations over the driver's test tables.

Embeddings of label 0 are the positives; other labels are groups of negatives, 1 to 3 the hard ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.operators import scoring, splits
from simgate.operators.metrics import NEGATIVE, POSITIVE

SEED, REFERENCE, CALIBRATION, TEST, TEST_FRACTION = 20240601, 15, 10, 10, 0.3
HARD = ["1", "2", "3"]
THRESHOLD = 0.3
STEP = 0.05


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("label = 0").select(F.col("vec_id").alias("name"), "embedding")


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("label <> 0").select(F.col("vec_id").alias("name"), F.col("label").alias("group"), "embedding")


def positive_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.positive_roles(positives(spark, sf_dir).select("name"), SEED, REFERENCE, CALIBRATION, TEST)
    return rows.select(F.lit(POSITIVE).alias("dataset"), "role", F.col("ord").cast("long").alias("ord"), "name", F.lit(None).cast("string").alias("group"))


def negative_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.stratified(negatives(spark, sf_dir).select("name", "group"), SEED, TEST_FRACTION)
    return rows.select(F.lit(NEGATIVE).alias("dataset"), "role", "ord", "name", F.col("group").cast("string").alias("group"))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, role, ord, name, group) of the split with the standard parameters."""
    return positive_roles(spark, sf_dir).union(negative_roles(spark, sf_dir))


def to_score(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """kind, role, ord (the name), name, group and embedding of all members of query roles, and the reference set."""
    own = positive_roles(spark, sf_dir)
    cache = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), "embedding")
    vectors = cache.join(F.broadcast(own.where("role = 'reference'")), "name")  # as many as the role has
    members = own.where("role <> 'reference'").union(negative_roles(spark, sf_dir))
    queries = members.join(cache, "name").select(F.col("dataset").alias("kind"), "role", F.col("name").alias("ord"), "name", "group", "embedding")
    return queries, vectors


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, role, ord (the name), name, group, both scores and the best match of all members of query roles."""
    return scoring.score_all(*to_score(spark, sf_dir))


def setup(spark: SparkSession, sf_dir: str, aggregation: str = "max") -> DataFrame:
    """What a threshold is chosen on: calibration positives and setup negatives."""
    return scoring.chosen(scored(spark, sf_dir), aggregation).where("role IN ('calibration', 'setup')")


def held_out(spark: SparkSession, sf_dir: str, aggregation: str = "max") -> DataFrame:
    """What a frozen threshold is graded on: the test roles."""
    return scoring.chosen(scored(spark, sf_dir), aggregation).where("role = 'test'")
