"""Joins and rollups around scores: attributes, misses, detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simgate.functions.scalars import passes
from simgate.operators.guards import all_present

LOW_CONFIDENCE, FULL_FRAME = 0.8, 0.9


#: What tells an embedding apart: equal names may stand in several datasets, and in several groups of one.
KEY = ["dataset", "group", "name"]


def last_by(rows: DataFrame, key: str | list[str], ord_: str) -> DataFrame:
    """One row for each key (of one column or several), the last by ord."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ord_)).alias("row"))
    return best.select(*keys, *(F.col(f"row.`{c}`").alias(c) for c in rest))


def keyed(rows: DataFrame, dataset: str, ord_: str | None = None) -> DataFrame:
    """(dataset, group, name, ord, embedding) of a cache: no group is the empty one; ``ord`` (else the cache's row number, if it has one) tells which of equal keys is the last."""
    ord_ = ord_ or ("row" if "row" in rows.columns else None)
    group = F.coalesce(F.col("group").cast("string"), F.lit("")) if "group" in rows.columns else F.lit("")
    return rows.select(F.lit(dataset).alias("dataset"), group.alias("group"), F.col("name").cast("string").alias("name"), (F.col(ord_).cast("long") if ord_ else F.lit(0).cast("long")).alias("ord"), "embedding")


def vectors_of(listed: DataFrame, cache: DataFrame, what: str) -> DataFrame:
    """Listed rows (with KEY) with the vector that the cache (of ``keyed``) holds for each: of several rows the last; a missing one is an error.

    The listing and the cache are dealt out by the key once. Rows of one key with equal ``ord`` give the largest vector.
    """
    all_present(listed.withColumn("group", F.coalesce(F.col("group").cast("string"), F.lit(""))), cache, KEY, what)
    return vectors_or_none(listed, cache).drop("found")


def vectors_or_none(listed: DataFrame, cache: DataFrame) -> DataFrame:
    """As ``vectors_of``, but a row without a vector stays, and ``found`` tells it: for whoever counts them when the rows are written anyway."""
    rows = listed.withColumn("group", F.coalesce(F.col("group").cast("string"), F.lit("")))
    found = cache.join(rows.select(*KEY).distinct(), KEY, "left_semi")
    last = found.groupBy(*KEY).agg(F.max(F.struct("ord", "embedding")).alias("last")).select(*KEY, F.col("last.embedding").alias("embedding"), F.lit(True).alias("found"))
    return rows.join(last, KEY, "left").withColumns({"group": F.nullif(F.col("group"), F.lit("")), "found": F.coalesce("found", F.lit(False))})


def with_attributes(rows: DataFrame, attributes: DataFrame, key: str, ord_: str, total: bool = True) -> DataFrame:
    """Rows with their attributes (of repeated keys the last); every row must have some if ``total``."""
    if total:
        all_present(rows, attributes, key, "the attribute table")
    return rows.join(last_by(attributes, key, ord_).drop(ord_), key, "left")


def with_notes(detections: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Detections with the notes of their image: a row for each note of a repeated key, one without notes where there is none."""
    return detections.join(notes.select(key, "notes"), key, "left")


def zipped(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, place, left, right): two arrays by place; arrays of different lengths are an error."""
    sizes = F.coalesce(F.size(left), F.lit(0)) == F.coalesce(F.size(right), F.lit(0))
    checked = F.when(sizes, F.arrays_zip(F.col(left).alias("left"), F.col(right).alias("right"))).otherwise(F.raise_error(F.concat(F.lit(f"{left} and {right} differ in length for "), F.col(key).cast("string"))))
    return rows.select(key, F.posexplode(checked).alias("at", "both")).select(key, (F.col("at") + 1).alias("place"), "both.left", "both.right")


def select_role(roles: DataFrame, cache: DataFrame, key: str | list[str] = "name") -> DataFrame:
    """Cache rows of the names that roles list, an output for each listing; a missing name is an error."""
    all_present(roles, cache, key, "the embeddings cache")
    return roles.join(cache, key)


def pose_of(matches: DataFrame, poses: DataFrame) -> DataFrame:
    """Position and view of each best match, empty where unknown."""
    got = matches.join(poses.withColumnRenamed("name", "best_match"), "best_match", "left")
    return got.withColumns({c: F.coalesce(c, F.lit("")) for c in ("position", "view")})


def misses(catalog: DataFrame, embedded: DataFrame, key: str) -> DataFrame:
    """Catalog rows (repeats kept) that have no embedding."""
    return catalog.join(embedded.select(key).distinct(), key, "left_anti")


def any_hit(images: DataFrame, crops: DataFrame, threshold: float, key: str = "image_id") -> DataFrame:
    """One row an image: crops, whether any passes, the best score; an image without crops is no hit."""
    hits = crops.groupBy(key).agg(F.count(F.lit(1)).alias("crops"), F.bool_or(passes(F.col("score"), threshold)).alias("hit"), F.max("score").alias("best_score"))
    got = images.join(hits, key, "left").withColumns({"crops": F.coalesce("crops", F.lit(0).cast("long")), "hit": F.coalesce("hit", F.lit(False))})
    return got.withColumn("status", F.when(F.col("crops") == 0, "no_crop").when(F.col("hit"), "hit").otherwise("miss"))


def ranked_detections(detections: DataFrame, key: str, ord_: str = "detection_ord") -> DataFrame:
    """Detections of each image by falling confidence, numbered from 1."""
    order = Window.partitionBy(key).orderBy(F.desc("confidence"), F.col(ord_))
    return detections.withColumn("detection_index", F.row_number().over(order))


def detection_rows(images: DataFrame) -> DataFrame:
    """A row for each detection of (name, detections array); an image without any keeps a row with count 0."""
    rows = images.select("name", F.coalesce(F.size("detections"), F.lit(0)).alias("size"), F.posexplode_outer("detections").alias("at", "detection"))
    return rows.select("name", F.greatest("size", F.lit(0)).alias("n_detections"), (F.col("at") + 1).alias("detection_index"), "detection.*")


def detection_rollup(detections: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """One row: images with none, several, low-confidence, full-frame and clean detections, and all crops."""
    per = detections.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.max("area_fraction").alias("area"))
    all_ = images.select(key).distinct().join(per, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    low: Column = (F.col("n") > 0) & (F.col("confidence") < LOW_CONFIDENCE)
    full: Column = (F.col("n") > 0) & (F.col("area") > FULL_FRAME)
    return all_.agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("n") == 0).alias("none"), F.count_if(F.col("n") > 1).alias("several"), F.count_if(low).alias("low_confidence"),
        F.count_if(full).alias("full_frame"), F.count_if((F.col("n") == 1) & ~low).alias("clean"), F.sum("n").alias("crops"),
    )


def detection_text(rows: DataFrame) -> DataFrame:
    """(name, text): what a person reads about each image of (name, detections, crops), in words.

    The detections are in order of confidence; ``crops`` names the file of each, or is null where none was saved.
    """
    flags = lambda d: F.concat(F.when(d["confidence"] < LOW_CONFIDENCE, ", LOW CONFIDENCE").otherwise(""), F.when(d["area_fraction"] > FULL_FRAME, ", NEARLY FULL FRAME").otherwise(""))
    share = lambda d: F.bround(d["area_fraction"] * 100, 0).cast("int").cast("string")
    line = lambda d, c: F.concat(F.lit("confidence "), F.format_string("%.2f", d["confidence"]), F.lit(", "), share(d), F.lit("% of frame"), flags(d), F.coalesce(F.concat(F.lit(" -> "), c), F.lit(" (crop not saved)")))
    n = F.coalesce(F.size("detections"), F.lit(0))
    same = F.when(n == F.size("crops"), F.zip_with("detections", "crops", line)).otherwise(F.raise_error(F.lit("detections and crops differ in length")))
    several = F.concat(F.col("name"), F.lit(": MULTIPLE CATS ("), n.cast("string"), F.lit(")\n"), F.array_join(F.transform(same, lambda x: F.concat(F.lit("  "), x)), "\n"))
    text = F.when(n < 1, F.concat("name", F.lit(": NO CAT DETECTED"))).when(n == 1, F.concat("name", F.lit(": 1 cat, "), F.element_at(same, 1))).otherwise(several)
    return rows.select("name", text.alias("text"))


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """How many rows were used or skipped, by status."""
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
