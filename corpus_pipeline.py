"""From raw documents to token ids: five stages, each a filter or a rewrite over all documents.

Stages take and return the columns of ``documents`` (extra columns pass through); the last returns
token ids. Documents without a letter or in no learned language go, of each group of near duplicates the smallest id stays,
contaminated documents go, personal data get surrogates, and what is left is encoded.

Defined results: a null or empty text, or one without a letter, goes in the first stage; of repeated rows, and of rows
without an id that are near duplicates, one stays; other rows without an id are kept like any other; between equally
good rows the smallest id stays; texts of any length go through whole; empty tables give an empty result, an empty
benchmark drops nothing; columns whose names clash with those that stages make are kept until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.llm import bpe_codec, language, near_dedup, pii, winnowing
from simgate.llm.shared import written
from simgate.llm.tables import documents, filter_texts, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that share an n-gram with a learned language; where none was learned, those with a letter."""
    profiles = spark.sparkContext.broadcast(language.fit(docs.where(~language.held_out("doc_id", 5, 0))))
    return filter_texts(docs, lambda: profiles.value.keeps)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document (of the smallest id) of each group of near duplicates, on shingles of five words."""
    return near_dedup.deduplicated(docs, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark windows cover a twentieth or more."""
    return winnowing.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates in the place of personal data."""
    changed = pii.surrogates(docs, pii.session_key(spark)).select(*docs.columns)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of the bytes that they decode to."""
    return bpe_codec.encoded(docs)


STAGES = [
    ("language", identify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("personal_data", replace_personal_data),
    ("token_ids", encode),
]
#: Profiles, near duplicates by signature and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

