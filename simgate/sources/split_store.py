"""Frozen splits: the role table and a one-row header. A split that was stored is never drawn again."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.operators import guards
from simgate.sources.shared import published

VERSION = 2
ROLES = "dataset string, role string, ord long, name string, group string"


def _groups(roles: DataFrame) -> dict:
    rows = roles.where("dataset = 'negative'").groupBy("role", "group").count().collect()  # a row for each group and role
    return {role: {r["group"]: r["count"] for r in sorted(rows, key=lambda r: str(r["group"])) if r["role"] == role} for role in ("setup", "test")}


def write_split(roles: DataFrame, folder: str, identity: dict, parameters: dict) -> DataFrame:
    """Store a split and return the roles as they are stored; drawn once, and checked where they lie."""
    spark = roles.sparkSession

    def write(part: str) -> None:
        roles.select("dataset", "role", F.col("ord").cast("long").alias("ord"), "name", "group").write.parquet(f"{part}/roles")
        stored = spark.read.schema(ROLES).parquet(f"{part}/roles")
        guards.disjoint(stored)
        header = {"format_version": VERSION, "generated_at": datetime.now(UTC).isoformat(), "parameters": parameters, "identity": identity, "groups": _groups(stored)}
        spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.text(f"{part}/header")

    published(spark, folder, write)
    return spark.read.schema(ROLES).parquet(f"{folder}/roles")


def read_split(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """The roles as they were stored, and the header; checks version, disjoint roles and the stored group counts."""
    header = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/header").collect()))
    guards.equal_version(header["format_version"], VERSION, "the split")
    roles = spark.read.schema(ROLES).parquet(f"{folder}/roles")
    guards.disjoint(roles)
    guards.require(_groups(roles) == header["groups"], "the stored group counts differ from the roles")
    return roles, header
