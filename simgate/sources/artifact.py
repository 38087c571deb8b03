"""Model artifacts: the frozen threshold with its reference set, provenance and curve.

A JSON document, and the reference set (vectors with their names and poses) as Parquet, with a fingerprint over its
rows, so that neither can be changed alone. Both are written to a new folder that takes the artifact's place when it is
whole. The reference set may be of any size: rows are counted and digested where they lie.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.functions.scalars import crop_slug
from simgate.operators import guards
from simgate.sources.digests import fingerprint
from simgate.sources.shared import published

VERSION = 3
COMPARISON = ">="


def _shape(rows: DataFrame) -> dict:
    """How many rows there are, and how wide their vectors."""
    n, whole, least, most = rows.agg(F.count(F.lit(1)), F.count("embedding"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    guards.require(n == whole, f"{n} references, {whole} vectors")
    guards.require(least == most, f"reference vectors of another width: {least} and {most}")
    return {"rows": n, "dim": most or 0}


def write_artifact(folder: str, reference: DataFrame, threshold: float, aggregation: str, identity: dict, metrics: dict, comparison: dict, curve: DataFrame, provenance: dict) -> dict:
    """reference: (ord, name, position, view, embedding). Returns the document."""
    spark = reference.sparkSession
    names = {"fpr_overall": "fpr_all", "fpr_hard": "fpr_look_alike", "fpr_easy": "fpr_easy", "recall": "recall", "cutoff": "cutoff"}

    def write(part: str) -> dict:
        reference.select("ord", "name", "position", "view", "embedding").repartitionByRange("ord").sortWithinPartitions("ord").write.parquet(f"{part}/reference")
        stored = spark.read.parquet(f"{part}/reference")
        document = {
            "format_version": VERSION, "threshold": threshold, "aggregation": aggregation, "comparison": COMPARISON, "embedding": identity,
            "reference": _shape(stored) | {"sha256": fingerprint(stored)}, "metrics": metrics, "comparison_of_aggregations": comparison,
            "curve": [{names.get(k, k): v for k, v in r.asDict().items()} for r in curve.orderBy("cutoff").collect()], "provenance": provenance,
        }
        spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.text(f"{part}/document")
        return document

    return published(spark, folder, write)


def read_artifact(spark: SparkSession, folder: str) -> tuple[dict, DataFrame]:
    """The document and the reference rows (ord, name, position, view, embedding); every guard must hold."""
    document = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/document").collect()))
    guards.equal_version(document["format_version"], VERSION, "the artifact")
    guards.require(document["comparison"] == COMPARISON, f"unknown comparison {document['comparison']!r}")
    rows, stored = spark.read.parquet(f"{folder}/reference"), document["reference"]
    found = _shape(rows)
    guards.require(found["rows"] == stored["rows"], f"{found['rows']} reference vectors, the artifact says {stored['rows']}")
    guards.require(found["dim"] == stored["dim"], "reference vectors of another width")
    guards.require(fingerprint(rows) == stored["sha256"], "the reference vectors were changed")
    return document, rows


def find_artifacts(spark: SparkSession, folder: str) -> list[str]:
    """The artifacts (folders with a document) right below a folder, by name; none where there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    inside = [s.getPath() for s in files.listStatus(path) if s.isDirectory() and not s.getPath().getName().startswith(".")]
    return sorted(str(p) for p in inside if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "document")))


def default_name(kind: str, settings: dict, identity: dict, *rest: str) -> str:
    """A name that tells kind, seed, role sizes, model and crop settings, so that runs that differ in one do not overwrite one another."""
    slug = f"{identity['model_id'].replace('/', '--')}-{crop_slug(identity['detect'], identity.get('margin'))}"
    return "-".join([kind, "three-way", f"seed{settings['seed']}", f"g{settings['reference']}", f"c{settings['calibration']}", f"t{settings['test']}", slug, *rest])
