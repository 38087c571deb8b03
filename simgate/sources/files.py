"""Files that datasets come in: image folders, annotation lists, attribute tables, detections."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.functions.scalars import group_of_filename, is_yes
from simgate.operators import guards, relations

#: The suffixes of images, in any case and as a glob, so that other files are not even listed.
IMAGES = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[wW][eE][bB][pP]}"
ATTRIBUTES = ["number", "new_filename", "original_filename", "position", "location", "view", "head_visible", "tail_visible", "notes"]


def _part(back: int):
    """A part of the path, from its end."""
    return F.element_at(F.split("path", "/"), -back)


def image_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(source_filename, path, content) of the images right in a folder, by suffix whatever its case; content is read only where it is used."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).load(folder)
    return rows.select(_part(1).alias("source_filename"), "path", "content")


def grouped_images(spark: SparkSession, root: str) -> DataFrame:
    """(group, source_filename, path, content) of *.jpg in the folders right below root, named by their folder."""
    rows = spark.read.format("binaryFile").load(f"{root}/*/*.jpg")
    return rows.select(_part(2).alias("group"), _part(1).alias("source_filename"), "path", "content")


def read_chosen(chosen: DataFrame) -> DataFrame:
    """The rows of a listing (with ``path``, without content) with the content of their files; no other file is read.

    The paths go through the driver, as those of any scan do: Spark's index of files lists them there. What else is known
    of a picture comes from the same list by broadcast, so contents are not moved.
    """
    spark = chosen.sparkSession
    rows = chosen.drop("content").collect()
    if not rows:
        return chosen.drop("content").limit(0).withColumn("content", F.lit(None).cast("binary"))
    literal = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r["path"]) for r in rows]  # a path is no glob
    known = spark.createDataFrame(rows, chosen.drop("content").schema)
    return spark.read.format("binaryFile").load(literal).select("path", "content").join(F.broadcast(known), "path").select(*known.columns, "content")


def annotations(spark: SparkSession, path: str, species: str = "1") -> DataFrame:
    """(group, source_filename) of an annotation list: four fields a line, # comments, one species kept."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    fields = lines.select("line", F.split("line", r"\s+").alias("f"))
    wrong = fields.where(F.size("f") != 4).limit(1).collect()
    guards.require(not wrong, f"an annotation line without four fields: {wrong[0]['line'] if wrong else ''}")
    kept = fields.where(F.element_at("f", 3) == species).select(F.element_at("f", 1).alias("id"))
    return kept.select(group_of_filename(F.col("id")).alias("group"), F.concat("id", F.lit(".jpg")).alias("source_filename"))


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file on any file system that Spark knows, in place of one that stood there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = found.getFileSystem(spark._jsc.hadoopConfiguration()).create(found, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def attribute_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The attribute CSV, all strings; quoted commas stay in their field, blanks are empty. None where there is no such file."""
    if not exists(spark, path):
        return None
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in ATTRIBUTES), quote='"', escape='"')
    return rows.na.fill("")


def positive_records(metadata: DataFrame, attributes: DataFrame) -> DataFrame:
    """(source_filename, head_visible, tail_visible, position, view) of every metadata row; a row without attributes is an error.

    Of several rows for one name the last by ``number`` counts (as a number; of equal ones the largest in all its fields).
    """
    flags = attributes.select(
        F.col("new_filename").alias("source_filename"), is_yes(F.col("head_visible")).alias("head_visible"), is_yes(F.col("tail_visible")).alias("tail_visible"),
        "position", "view", F.struct(F.col("number").try_cast("double").alias("at"), "number", "head_visible", "tail_visible", "position", "view").alias("ord"),
    )
    return relations.with_attributes(metadata.select("source_filename"), flags, "source_filename", "ord")


def negative_records(metadata: DataFrame) -> DataFrame:
    guards.require("group" in metadata.columns, "metadata of negatives needs a group column")
    return metadata.select("source_filename", "group")


def detections(spark: SparkSession, path: str) -> DataFrame:
    """The detections CSV, all strings, blanks empty."""
    return spark.read.csv(path, header=True).na.fill("")


def write_detections(images: DataFrame, path: str) -> None:
    """One line a detection; an image with none has one too."""
    relations.detection_rows(images).orderBy("name", "detection_index").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_catalog(rows: DataFrame, path: str) -> None:
    rows.select("source_filename", "group").orderBy("group", "source_filename").coalesce(1).write.mode("overwrite").csv(path, header=True)
