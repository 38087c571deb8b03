"""Caches of embeddings, and detections with their crops, from folders of pictures.

Models are callables (see ``operators.inference``); ``named`` finds one by module and name, for the command line.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from importlib import import_module

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgate.operators import guards, inference, ranges, relations, splits
from simgate.sources import cache, files
from simgate.sources.shared import kept

#: The detector's least confidence, and how much a box is widened.
MIN_CONFIDENCE, MARGIN = 0.25, 0.1
#: Names of each kind of anomaly that a text shows.
SHOWN = 20


def named(path: str) -> Callable:
    """What ``module:name`` names."""
    module, _, name = path.partition(":")
    guards.require(bool(module and name), f"a model is named module:name, not {path!r}")
    return getattr(import_module(module), name)


def with_image(images: DataFrame) -> DataFrame:
    """(source_filename, group, image, content): ``image`` tells pictures of one name in two groups apart."""
    rows = images if "group" in images.columns else images.withColumn("group", F.lit(None).cast("string"))
    rows = rows.withColumn("image", F.concat_ws("/", "group", "source_filename")).select("source_filename", "group", "image", "content")
    guards.not_empty(rows.select("image"), "the folder of pictures")
    guards.unique(rows, "image", "pictures")
    return rows


def sampled(images: DataFrame, per_group: int = 0, limit: int | None = None, seed: int = 0) -> DataFrame:
    """At most ``per_group`` pictures of each group (0: all), and of these the first ``limit`` by group and name.

    Names are drawn from the listing, whose content is not read, and then only the chosen files are.
    """
    guards.require(per_group == 0 or "group" in images.columns, "a limit for each group needs groups")
    if per_group <= 0 and limit is None:
        return images if "content" in images.columns else files.read_chosen(images)
    names = [c for c in ("group", "source_filename") if c in images.columns]
    chosen = splits.sample_per_group(images.select(*names, "path"), per_group, seed, "source_filename")
    if limit is not None:
        chosen = chosen.orderBy(*names).limit(limit)
    return files.read_chosen(chosen)


def build_cache(
    images: DataFrame, folder: str, model_id: str, embedder: inference.Load, detector: inference.Load | None = None, cut: Callable | None = None, margin: float = MARGIN,
    min_confidence: float = MIN_CONFIDENCE, batch: int = inference.BATCH,
) -> DataFrame:
    """Embed the surest crop of each picture (all of it without a detector) and write the cache; (status, n) of all pictures.

    ``images`` is (source_filename, content[, group]). Rows are numbered from 0 by group and name; skipped pictures have none.
    """
    rows = with_image(images)
    if detector is None:
        found = inference.embed(rows, "content", embedder, batch)
        empty = {"confidence": "double", "x1": "int", "y1": "int", "x2": "int", "y2": "int", "area_fraction": "double"}
        found = found.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    else:
        guards.require(cut is not None, "a detector needs a function that cuts")
        found = inference.embedded_crops(rows, "content", detector, cut, embedder, margin, min_confidence, batch)
    found = kept(found, "embedded")
    placed = ranges.placed(found.where("status = 'ok'"), {"group": F.coalesce("group", F.lit("")), "name": F.col("source_filename")}, "place")
    columns = {"row": F.col("place") - 1, "detect_used": F.lit(detector is not None)}
    wanted = [f.split()[0] for f in cache.EMBEDDINGS.split(", ")]
    cache.write_cache(placed.select(*(columns.get(c, F.col(f"`{c}`")).alias(c) for c in wanted)), folder, model_id, detector is not None, margin, min_confidence)
    return relations.status_counts(found)


def detected(images: DataFrame, detector: inference.Load, cut: Callable, margin: float = MARGIN, min_confidence: float = MIN_CONFIDENCE, all_crops: bool = False) -> DataFrame:
    """A row for each detection, the surest first, with the crop and its file name; only the first has them unless ``all_crops``."""
    found = inference.detect_and_crop(with_image(images), "content", detector, cut, margin, min_confidence)
    saved = F.col("crop").isNotNull() & (F.lit(all_crops) | (F.col("detection_index") == 1))
    stem, suffix = F.regexp_replace("image", r"\.[^./]*$", ""), F.lower(F.regexp_extract("image", r"\.[^./]*$", 0))
    name = F.concat(F.replace(stem, F.lit("/"), F.lit("_")), F.lit("_crop"), F.col("detection_index").cast("string"), suffix)
    return kept(found.withColumns({"crop_filename": F.when(saved, name), "crop": F.when(saved, F.col("crop"))}), "detected")


def write_crops(found: DataFrame, folder: str) -> int:
    """Write the crops as files into a folder that the driver and all executors mount alike; how many there are.

    Crops of an earlier run in it go first. A task that runs twice writes the same files again.
    """
    os.makedirs(folder, exist_ok=True)
    for old in os.scandir(folder):
        if old.is_file() and "_crop" in old.name:
            os.unlink(old.path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, crop in zip(frame.crop_filename, frame.crop, strict=True):
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(crop)
                os.replace(part, os.path.join(folder, name))
            yield pd.DataFrame({"n": [len(frame)]})

    return found.where("crop IS NOT NULL").select("crop_filename", "crop").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def described(found: DataFrame) -> DataFrame:
    """(name, text) of each picture; detections of one picture meet in one row."""
    own = F.struct("detection_index", "confidence", "area_fraction", "crop_filename")
    rows = found.groupBy(F.col("image").alias("name")).agg(F.array_sort(F.collect_list(F.when(F.col("detection_index").isNotNull(), own))).alias("own"))
    return relations.detection_text(rows.select("name", F.col("own").alias("detections"), F.col("own.crop_filename").alias("crops")))


def anomalies(found: DataFrame) -> DataFrame:
    """(problem, name, value) of pictures without a detection, with several, with a low best confidence or a box of nearly all of it."""
    per = found.groupBy(F.col("image").alias("name")).agg(F.count("detection_index").alias("n"), F.max("confidence").alias("confidence"), F.max("area_fraction").alias("area"))
    number = F.col("n").cast("double")
    problems = F.array(
        F.when(F.col("n") == 0, F.struct(F.lit("none").alias("problem"), number.alias("value"))), F.when(F.col("n") > 1, F.struct(F.lit("several").alias("problem"), number.alias("value"))),
        F.when(F.col("confidence") < relations.LOW_CONFIDENCE, F.struct(F.lit("low_confidence").alias("problem"), F.col("confidence").alias("value"))),
        F.when(F.col("area") > relations.FULL_FRAME, F.struct(F.lit("full_frame").alias("problem"), F.col("area").alias("value"))),
    )
    return per.select("name", F.explode(F.array_compact(problems)).alias("p")).select("p.problem", "name", "p.value")


def detection_summary(found: DataFrame) -> str:
    """The rollup in words, with the first names of each anomaly."""
    counts = relations.detection_rollup(found.where("detection_index IS NOT NULL"), found, "image").first()
    saved = found.where("crop_filename IS NOT NULL").count()
    lines = [f"{counts['images']} pictures, {saved} crops saved", f"  {counts['clean']} with exactly one detection at confidence {relations.LOW_CONFIDENCE} or more"]
    odd = anomalies(found)
    for problem, words in (("none", "without a detection"), ("several", "with several detections"), ("low_confidence", f"with a best confidence below {relations.LOW_CONFIDENCE}"), ("full_frame", f"with a detection over {relations.FULL_FRAME:.0%} of the frame")):
        if counts[problem]:
            first = odd.where(F.col("problem") == problem).orderBy("name").limit(SHOWN).collect()
            shown = ", ".join(r["name"] if problem in ("none", "full_frame") else f"{r['name']} ({r['value']:.{3 if problem == 'low_confidence' else 0}f})" for r in first)
            lines.append(f"  {counts[problem]} {words}: {shown}" + (f", +{counts[problem] - SHOWN} more" if counts[problem] > SHOWN else ""))
    return "\n".join(lines if len(lines) > 2 else [*lines, "  no anomalies"])


def write_detections(found: DataFrame, path: str) -> None:
    """A line for each detection, in CSV; a picture without any has one with empty fields."""
    size = found.groupBy("image").agg(F.count("detection_index").alias("n_detections"))
    four = {c: F.format_string("%.4f", c) for c in ("confidence", "area_fraction")}
    rows = found.drop("crop").join(size, "image").withColumns({c: F.when(F.col(c).isNotNull(), v) for c, v in four.items()})
    columns = [F.col("image").alias("source_filename"), "n_detections", "detection_index", "crop_filename", "confidence", "x1", "y1", "x2", "y2", "image_width", "image_height", "area_fraction"]
    rows.orderBy("image", "detection_index").select(*columns).write.mode("overwrite").csv(path, header=True)
