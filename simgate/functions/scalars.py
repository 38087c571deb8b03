"""Scalar expressions: flags, groups, verdicts, file names, crop geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_GROUP = "(unknown)"


def is_yes(flag: Column) -> Column:
    """Trimmed, lower-cased 'yes'; anything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(flag)) == "yes", F.lit(False))


def group_or_unknown(group: Column) -> Column:
    return F.coalesce(F.nullif(group, F.lit("")), F.lit(UNKNOWN_GROUP))


def is_hard(group: Column, hard: list[str]) -> Column:
    """Whether a group is one of the hard ones; null is easy."""
    return F.coalesce(group.cast("string"), F.lit("")).isin(list(hard)) if hard else F.lit(False)


def passes(score: Column, threshold: Column | float) -> Column:
    """score >= threshold; NaN, which Spark orders above all numbers, never passes."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce((score >= threshold) & ~F.isnan(score), F.lit(False))


def group_of_filename(name: Column) -> Column:
    """The name up to its last underscore."""
    return F.regexp_replace(name, r"_[^_]*$", "")


def model_slug(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("--"))


def crop_slug(detect: bool, margin: float | None) -> str:
    return f"detect-m{margin or 0.0:g}" if detect else "no-detect"


def variant_key(model: Column, detect: Column, margin: Column, min_confidence: Column) -> Column:
    """What must be equal for two caches to be comparable; settings of a detector that is off are null."""
    on = lambda c: F.when(detect, c)
    return F.struct(model.alias("model_id"), detect.alias("detect"), on(margin).alias("margin"), on(min_confidence).alias("min_confidence"))


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, margin: float, width: Column, height: Column) -> Column:
    """The box widened by a share of its sides (rounded half to even) and clamped to the image."""
    dx, dy = (F.bround((b - a) * F.lit(float(margin)), 0).cast("int") for a, b in ((x1, x2), (y1, y2)))
    return F.struct(
        F.greatest(F.lit(0), x1 - dx).alias("left"), F.greatest(F.lit(0), y1 - dy).alias("top"),
        F.least(width, x2 + dx).alias("right"), F.least(height, y2 + dy).alias("bottom"),
    )


def area_fraction(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    return F.try_divide((x2 - x1) * (y2 - y1), width * height)


def try_number(text: Column) -> Column:
    """A number from text; blank or malformed is null."""
    return text.try_cast("double")
